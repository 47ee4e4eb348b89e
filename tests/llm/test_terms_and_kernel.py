"""The vocabulary of the url filter from a table, and the string kernel against an enumeration of subsequences."""
import itertools

import numpy as np
import pytest

from placewright.llm import string_kernel, url_filter


def test_vocabulary_from_a_table(spark, tmp_path):
    rows = [(" Bad ", True), ("soft", False), ("SOFT", None), ("mild", None), (None, True), ("", False), ("both", False), ("both", True)]
    spark.createDataFrame(rows, "term string, strict boolean").write.parquet(str(tmp_path / "terms"))
    v = url_filter.vocabulary_of(spark.read.parquet(str(tmp_path / "terms")), soft_needed=2)
    assert v.strict == ("bad", "both") and v.soft == ("mild", "soft")
    urls = spark.createDataFrame([(0, "http://x/bad"), (1, "http://x/mild"), (2, "http://x/mild-soft"), (3, "http://x/badly"), (4, None)], "page_id bigint, url string")
    out = {r.page_id: r.verdict for r in url_filter.filter_urls(urls, vocabulary=v).collect()}
    assert out == {0: "block", 1: "allow", 2: "block", 3: "allow", 4: "allow"}
    assert url_filter.vocabulary_of(spark.createDataFrame([], "term string, strict boolean")) == url_filter.Vocabulary((), (), 2)


def plain_profile(word: bytes) -> dict:
    """Every subsequence of three bytes whose span is at most SPAN, the word's start and end counting as bytes, weighted by its span."""
    chars, out = [1, *word, 2], {}
    for i, j, k in itertools.combinations(range(len(chars)), 3):
        if k - i < string_kernel.SPAN:
            key = (chars[i], chars[j], chars[k])
            out[key] = out.get(key, 0.0) + string_kernel.DECAY ** (k - i + 1)
    return out


@pytest.mark.parametrize("pair", [(b"idiot", b"idiot"), (b"idiot", b"i.d.i.o.t"), (b"idiot", b"idiiot"), (b"stupid", b"stoopid"), (b"abc", b"xyz"), (b"a", b"ab"), (b"kind", b"unkind")])
def test_kernel_is_that_of_gapped_subsequences(pair):
    """Hashing adds what collides by chance, so the hashed kernel is compared within that."""
    a, b = pair
    plain = sum(w * plain_profile(b).get(key, 0.0) for key, w in plain_profile(a).items())
    rows = string_kernel.profile([a, b]).astype(np.float64)
    norms = string_kernel._NORM[[len(a), len(b)]]
    assert float(rows[0] @ rows[1]) * norms[0] * norms[1] == pytest.approx(plain, abs=0.02 * max(plain, 1.0))


def test_folded_weights_rate_like_landmarks():
    """A word's margin from folded weights is the sum over landmarks of their weight times the kernel."""
    landmarks, weights = [b"idiot", b"stupid", b"loser"], np.array([1.5, 0.5, -0.25])
    folded = string_kernel.profile(landmarks).T @ weights
    words = [b"idiot", b"idi0t", b"st.upid", b"winner"]
    by_code = string_kernel.profile(landmarks).T
    kernel = string_kernel._kernel(words, by_code)
    assert string_kernel.rate(words, folded.astype(np.float32), 0.1) == pytest.approx(kernel @ weights + 0.1, abs=1e-4)
