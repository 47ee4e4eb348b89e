"""SentencePiece encoding and decoding with the tokenizers library as the backend.

The model file is a protobuf message; its few needed fields (pieces, scores, kinds, model type, normaliser flags) are
read here. From them a tokenizers backend is rebuilt: normaliser (precompiled map if there is one), the metaspace marker,
unigram scores or, for a BPE model, merges ranked by the scores of what they make, and byte fallback for characters
without a piece.

A normalised text falls into units: a run of markers and what follows it. No piece of the model reaches over the start
of a unit (checked when the model is read; otherwise the text is one unit), so each unit is encoded once per task and
kept in a bounded table, in batches on as many threads as a task has cores. Parity: every text is also encoded whole by
the sentencepiece library, and its ids are compared with the joined ids of the units. Units whose pieces, put together,
are the unit are their own decoded text; all others are decoded by the backend.

Empty and null texts have no tokens. Each input row gives one output row; other columns are not carried. One pass without
shuffle; memory in a task is bounded by one block of text and the unit table (``UNITS`` entries of at most ``LONGEST``
bytes; longer units are encoded every time).
"""
from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, table

MARK = "▁"
UNITS, LONGEST = 800_000, 64
#: kinds of pieces in the model format, fixed values
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def default_model() -> str:
    """The public 32,000-piece model of the tokenizer folder."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """(field, wire type, value) of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7
    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, kind, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, kind, data[at:at + n]
            at += n
        else:
            n = {1: 8, 5: 4}[kind]
            yield key >> 3, kind, data[at:at + n]
            at += n


@dataclass(frozen=True)
class Model:
    pieces: tuple[tuple[str, float, int], ...]
    kind: int = UNIGRAM
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @property
    def unk(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    @property
    def byte_fallback(self) -> bool:
        return any(p[2] == BYTE for p in self.pieces)

    @property
    def divisible(self) -> bool:
        """Whether no piece has a marker after another character, so that units are encoded apart."""
        return not any(MARK in p.lstrip(MARK) for p, _, k in self.pieces if k in (NORMAL, USER_DEFINED))


def read_model(data: bytes) -> Model:
    """The fields of a serialized model that encoding needs (field numbers of the public model format)."""
    pieces, kind, charsmap, flags = [], UNIGRAM, b"", {3: 1, 4: 1, 5: 1}
    for field, _, value in _fields(data):
        if field == 1:
            piece, score, type_ = "", 0.0, NORMAL
            for f, _, v in _fields(value):
                if f == 1:
                    piece = v.decode("utf-8")
                elif f == 2:
                    score = struct.unpack("<f", v)[0]
                elif f == 3:
                    type_ = v
            pieces.append((piece, score, type_))
        elif field == 2:
            kind = next((v for f, _, v in _fields(value) if f == 3), UNIGRAM)
        elif field == 3:
            for f, _, v in _fields(value):
                if f == 2:
                    charsmap = v
                elif f in flags:
                    flags[f] = v
    if kind not in (UNIGRAM, BPE):
        raise ValueError(f"model type {kind} is neither unigram nor BPE")
    return Model(tuple(pieces), kind, charsmap, bool(flags[3]), bool(flags[4]), bool(flags[5]))


def _merges(model: Model) -> list[tuple[str, str]]:
    """Every way to make a piece of two pieces, the best score first (earlier id at ties)."""
    ids = {p: i for i, (p, _, k) in enumerate(model.pieces) if k in (NORMAL, USER_DEFINED)}
    found = [(-model.pieces[i][1], i, p[:j], p[j:]) for p, i in ids.items() for j in range(1, len(p)) if p[:j] in ids and p[j:] in ids]
    return [(a, b) for _, _, a, b in sorted(found, key=lambda m: (m[0], m[1], ids[m[2]], ids[m[3]]))]


class Backend:
    """Encodes and decodes with tokenizers; ``units`` cuts a normalised text."""

    def __init__(self, model: Model):
        import regex
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        self.model = model
        if model.kind == BPE:
            vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
            core = models.BPE(vocab=vocab, merges=_merges(model), byte_fallback=model.byte_fallback, unk_token=model.pieces[model.unk][0],
                              fuse_unk=True, cache_capacity=0)
        else:
            core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unk, byte_fallback=model.byte_fallback)
        self.tokenizer = Tokenizer(core)
        steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
        if model.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        self.normalizer = normalizers.Sequence(steps)
        self.plain = not steps
        self.tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        self.pattern = regex.compile(f"{MARK}*[^{MARK}]+|{MARK}+$") if model.divisible else None
        #: whether every unit starts with a marker, so that the words of a text with single blanks inside are its units without it
        self.marked = self.plain and model.dummy_prefix and model.escape and model.divisible
        # pieces as text; a lone surrogate, which no text holds, for those that decode to something else
        self.spelled = [p if k in (NORMAL, USER_DEFINED) and not p.startswith("<0x") else "\udfff" for p, _, k in model.pieces]

    def normalise(self, text: str) -> str:
        t = text if self.plain else self.normalizer.normalize_str(text)
        if not t:
            return ""
        if self.model.dummy_prefix:
            t = " " + t
        return t.replace(" ", MARK) if self.model.escape else t

    def units(self, normal: str) -> list[str]:
        return self.pattern.findall(normal) if self.pattern else [normal] if normal else []

    def keys(self, text: str) -> list[str]:
        """The units of a text, without their first marker if all have one."""
        if not self.marked:
            return self.units(self.normalise(text))
        if text and "  " not in text and MARK not in text and text[0] != " " != text[-1]:
            return text.split(" ")
        return [u[1:] for u in self.units(self.normalise(text))]

    def altered(self, units: list[str], ids: list[list[int]]) -> dict[str, str]:
        """The decoded text of the units that don't come back."""
        spelled = self.spelled.__getitem__
        odd = [(u, a) for u, a in zip(units, ids) if "".join(map(spelled, a)) != u]
        back = self.tokenizer.decode_batch([a for _, a in odd], skip_special_tokens=False)
        return {u: t for (u, _), t in zip(odd, back) if t != u.replace(MARK, " ")}

    def encode(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids, without the dummy blank in front."""
        t = self.tokenizer.decode(ids, skip_special_tokens=False)
        return t[1:] if self.model.dummy_prefix and t[:1] == " " else t


def encode_texts(df: DataFrame, ident: str = "doc_id", text: str = "text", model_path: str | None = None, check: bool = True,
                 threads: int | None = None) -> DataFrame:
    """(id, ids, n_bytes, round_trip, parity) per row.

    ``round_trip``: the decoded ids give the text back (a literal marker counts as the blank that the model makes of it).
    The model file, a parameter, is read once by the driver and sent to tasks (its size is that of a vocabulary).
    """
    with open(model_path or default_model(), "rb") as f:
        data = f.read()
    sent = df.sparkSession.sparkContext.broadcast(data)
    threads = threads or int(df.sparkSession.sparkContext.getConf().get("spark.task.cpus", "1"))
    kind = df.schema[ident].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "true" if threads > 1 else "false", str(threads)
        import sentencepiece

        backend = Backend(read_model(sent.value))
        other = sentencepiece.SentencePieceProcessor(model_proto=sent.value) if check else None
        known: dict[str, bytes] = {}  # ids as 32-bit numbers: plain bytes, which the collector of Python has no need to visit
        unlike: dict[str, str] = {}  # the decoded text of units that don't come back
        mark = MARK if backend.marked else ""
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                texts = [t or "" for t in part["text"].to_pylist()]
                cut = [backend.keys(t) for t in texts]
                seen = set(chain.from_iterable(cut))
                fresh = list(seen.difference(known))
                if len(known) + len(fresh) > UNITS:
                    known, unlike, fresh = {}, {}, list(seen)
                full = [mark + u for u in fresh]
                made = backend.encode(full)
                told = other.encode_as_numpy(texts, num_threads=threads) if check else [None] * len(texts)
                unlike.update((u[len(mark):], t) for u, t in backend.altered(full, made).items())
                known.update((u, array("i", a).tobytes()) for u, a in zip(fresh, made))
                rows = []
                for t, units, ref in zip(texts, cut, told):
                    ids = np.frombuffer(b"".join(map(known.__getitem__, units)), np.int32)
                    # units that come back are their own decoded text
                    whole = ("".join([unlike.get(u, mark + u) for u in units]) if unlike else mark[:len(units)] + mark.join(units)).replace(MARK, " ")
                    whole = whole[1:] if backend.model.dummy_prefix else whole
                    rows.append((ids, len(t.encode("utf-8", "surrogatepass")), whole == t.replace(MARK, " "),
                                 ref is None or np.array_equal(ids, ref)))
                for u in fresh:
                    if len(u) > LONGEST:
                        del known[u]
                        unlike.pop(u, None)
                ids, size, same, parity = zip(*rows)
                at = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in ids]))), pa.int32())
                yield pa.RecordBatch.from_arrays([part["id"], pa.ListArray.from_arrays(at, pa.array(np.concatenate(ids))), pa.array(size, pa.int64()),
                                                  pa.array(same), pa.array(parity)], ["id", "ids", "n_bytes", "round_trip", "parity"])
    rows = df.select(F.col(ident).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(encode, f"id {kind}, ids array<int>, n_bytes bigint, round_trip boolean, parity boolean").withColumnRenamed("id", ident)


def decode_texts(df: DataFrame, ident: str = "doc_id", ids: str = "ids", model_path: str | None = None) -> DataFrame:
    """(id, text) of token ids; null or no ids give the empty text."""
    with open(model_path or default_model(), "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = Backend(read_model(sent.value))
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "text": [backend.decode(list(x)) if x is not None and len(x) else "" for x in batch["ids"]]})
    said, back = carried(df, ident)
    return df.select(said.alias("id"), F.col(ids).alias("ids")).mapInPandas(decode, "id string, text string").select(back("id").alias(ident), "text")


def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_texts(table(spark, sf_dir, "documents"))
    said = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "n_bytes", "round_trip", "parity",
                      F.sha2(said.cast("binary"), 256).alias("ids_sha256"))
