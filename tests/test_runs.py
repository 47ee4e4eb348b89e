"""Whole runs: curation, normaliser steps, sources, streaming, and the registry."""
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from placewright import queries, schemas
from placewright.operators import normalize as N
from placewright.operators import resolve, tables
from placewright.plans import curation, runs
from placewright.queries.inputs import curation_places, places
from placewright.sources import readers, sinks
from placewright.sources.store import Change, Store, current, latest
from placewright.streaming import jobs, matching

from .conftest import rows

SF = "/root/testdata/sf0.001"


def test_curation_statuses(spark):
    df = curation_places(spark, SF).withColumn("name", F.when(F.col("seq") == 0, "").otherwise(F.col("name")))
    out = curation.curate(df)
    counts = {r["status"]: r["count"] for r in out.groupBy("status").count().collect()}
    assert sum(counts.values()) == df.count() and counts["error"] == 1 and counts["duplicate"] > 0


def test_normaliser_steps(spark):
    df = spark.createDataFrame([("blue  LOTUS", "an amazing place", "silom", ["A b"], ["C d"])], "name string, description string, area string, tags array<string>, flags array<string>")
    n = N.Normalizer().with_step("shout", lambda d: d.withColumn("name", F.upper("name")))
    assert n(df).first()["name"] == "BLUE LOTUS" and n.enable("shout", False)(df).first()["name"] == "Blue Lotus"


def test_sources(spark, tmp_path):
    rec = [{"id": "1", "name": "A", "tags": ["x"], "rating": 4.5}, {"id": "2", "name": "B"}]
    (tmp_path / "a.json").write_text(json.dumps(rec))
    df = readers.json_array(spark, str(tmp_path / "a.json"))
    assert df.count() == 2 and rows(df, "id", "name") == [("1", "A"), ("2", "B")]
    assert readers.newest_file(spark, str(tmp_path / "*.json"), schemas.CATALOGUE_PLACE).count() == 2
    (tmp_path / "g.json").write_text(json.dumps({"categories": {"food": {"level": "A", "priority": 1, "en_synonyms": ["eat"], "th_synonyms": []}}, "combinations": [{"name": "c", "tags": ["food"], "weight": 1.5}]}))
    tags, syn, combos = readers.tag_grammar(spark, str(tmp_path / "g.json"))
    assert tags.count() == 1 and syn.count() == 1 and combos == [("c", ["food"], 1.5)]
    facets = spark.createDataFrame([("c", dt.date(2024, 1, 1), "flag", "a", "1"), ("c", dt.date(2024, 1, 2), "flag", "a", "2")], schemas.FACET_ROW)
    out = str(tmp_path / "facets")
    sinks.write_facets(facets, out)
    sinks.write_facets(facets.where("day = date '2024-01-02'").withColumn("id", F.lit("9")), out)
    assert rows(spark.read.parquet(out), "id") == [("1",), ("9",)]
    sinks.write_report(df.select("name"), str(tmp_path / "r"), "text")
    assert spark.read.text(str(tmp_path / "r")).count() == 2


def test_stream_batches(spark, tmp_path):
    src, schema = tmp_path / "in", "id string, v string, ord long, fetched_at timestamp"
    t = dt.datetime(2024, 1, 1)
    spark.createDataFrame([("a", "1", 1, t), ("b", "1", 2, t)], schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = jobs.file_stream(spark, str(src), spark.read.parquet(str(src)).schema)
    sink = jobs.keyed_upsert(str(tmp_path / "t"), "id", "fetched_at", "ord", "v")
    jobs.run_batches(stream, sink, str(tmp_path / "c")).awaitTermination()
    late = spark.createDataFrame([("a", "2", 3, t - dt.timedelta(days=1))], schema)
    late.coalesce(1).write.mode("append").parquet(str(src))
    jobs.run_batches(stream, sink, str(tmp_path / "c")).awaitTermination()
    want = [("a", "2", t), ("b", "1", t)]
    assert rows(jobs.upserted(spark, str(tmp_path / "t"), "id", "fetched_at"), "id", "v", "fetched_at") == want
    sink(late.withColumn("v", F.lit("replayed")), 1)  # a batch that is in the manifest is not applied again
    assert rows(jobs.upserted(spark, str(tmp_path / "t"), "id", "fetched_at"), "id", "v", "fetched_at") == want
    assert rows(Store(spark, str(tmp_path / "t")).read("log"), "source", "count", "batch_id") == [("1", 2, 0), ("2", 1, 1)]


def test_stream_faults(spark, tmp_path):
    """A lost part stops the read; many files are many batches; a folder of parts is one table; open windows are kept."""
    import shutil
    schema = "id string, v string, ord timestamp, fetched_at timestamp"
    t = dt.datetime(2024, 1, 1)
    src = str(tmp_path / "events.parquet")
    spark.createDataFrame([(f"k{i % 7}", str(i), t + dt.timedelta(milliseconds=i), t + dt.timedelta(days=(i * 5) % 11)) for i in range(120)], schema) \
        .repartition(120).write.parquet(src)
    stream = jobs.file_stream(spark, src, spark.read.parquet(src).schema, files_per_batch=30)
    sink = jobs.keyed_upsert(str(tmp_path / "t"), "id", "fetched_at", "ord", most_parts=2)
    jobs.run_batches(stream, sink, str(tmp_path / "c")).awaitTermination()
    got = jobs.upserted(spark, str(tmp_path / "t"), "id", "fetched_at")
    assert got.count() == 7 and got.agg(F.max("fetched_at")).first()[0] == t + dt.timedelta(days=10)
    store = Store(spark, str(tmp_path / "t"))
    assert store.state()["run"] > 1
    shutil.rmtree(tmp_path / "t" / store.state()["tables"]["rows"]["parts"][-1]["path"])
    with pytest.raises(Exception):
        jobs.upserted(spark, str(tmp_path / "t"), "id", "fetched_at").collect()
    wins = jobs.rolling_metrics(stream.withColumn("n", F.lit(1.0)), ["id"], "fetched_at", "n", delay="30 days")
    jobs.run_batches(wins, jobs.keyed_states(str(tmp_path / "w"), ["id", "window_start"]), str(tmp_path / "cw"), mode="update").awaitTermination()
    last = jobs.last_states(spark, str(tmp_path / "w"), ["id", "window_start"])
    assert last.agg(F.sum("n")).first()[0] == 120 * 15


def _bytes(folder) -> int:
    return sum(p.stat().st_size for p in folder.rglob("*.parquet"))


def test_keyed_table(spark, tmp_path):
    """A batch writes its own bytes whatever is stored, reads of keys touch their buckets, compaction keeps the rows, lost runs leave no trace."""
    store = Store(spark, str(tmp_path / "s"), buckets=8, bucket_rows=200)
    make = lambda lo, hi, v: spark.range(lo, hi).select("id", F.lit(v).alias("v"), F.sha2(F.col("id").cast("string"), 512).alias("pad"))
    sizes = []
    for run in range(6):
        change = store.change(run)
        change.put("t", make(0, 4000, "old") if run == 0 else make(run * 10, run * 10 + 20, f"r{run}"), ["id"])
        before = _bytes(tmp_path / "s")
        sizes.append(sum(_bytes(tmp_path / "s" / p["path"]) for p in change.state["tables"]["t"]["parts"] if p["run"] == run))
        if run == 3:
            assert change.compact("t", latest(["id"]), most_parts=2) != []
        change.commit()
        assert store.change(run) is None and before > 0
    assert max(sizes[1:]) < sizes[0] / 10
    state = store.state()["tables"]["t"]
    assert state["buckets"] == 32 and state["rows"] >= 4000  # doubled as its buckets were full
    got = {r.id: r.v for r in current(store, "t", ["id"]).collect()}
    want = {i: "old" for i in range(4000)} | {i: f"r{run}" for run in range(1, 6) for i in range(run * 10, run * 10 + 20)}
    assert got == want
    some = spark.createDataFrame([(15,), (3999,)], "id long")
    part = current(store, "t", ["id"], wanted=some)
    assert part.count() <= 4000 * 2 / 32 * 2 and {r.id: r.v for r in part.join(some, "id").collect()} == {15: want[15], 3999: "old"}
    lost = store.change(9)
    lost.put("t", make(0, 4000, "lost"), ["id"])
    lost.put("u", make(0, 5, "lost"))
    assert {r.id: r.v for r in current(store, "t", ["id"]).collect()} == want and not store.has("u")
    assert len(store.sweep()) >= 2 and {r.id: r.v for r in current(store, "t", ["id"]).collect()} == want
    other = store.change(9)
    store.change(9).commit()
    with pytest.raises(RuntimeError):
        other.commit()
    wider = store.change(10)
    wider.put("t", make(0, 1, "new").withColumn("more", F.lit(1)), ["id"])
    wider.commit()
    assert sorted((r.v, r.more) for r in current(store, "t", ["id"]).where("id in (0, 1)").collect()) == [("new", 1), ("old", None)]


def test_matching_against_stored_rows(spark, tmp_path):
    """Batches in order match as one run over all rows does, and a batch reads and writes by its own size."""
    df = places(spark, SF).select("seq", "name", "city", "domain", "address", "geo_lat", "geo_lng")
    hard = [(10 ** 6 + i, n, c, "", a, la, ln) for i, (n, c, a, la, ln) in enumerate([
        ("", "x", None, None, None), (None, None, "1 A Road", 1.0, 2.0), ("blue moon cafe", "x", "1 A Road", 1.0, 2.0), ("blue mooon", "x", None, 1.0005, 2.0),
        ("blue moon", "y", None, None, None), ("Blue Moon", "x", "", 1.0, 2.0), ("a", "x", None, 50.0, 50.0), ("a", "x", None, 50.0009, 50.0), ("ab", "x", None, None, None)])]
    df = df.unionByName(spark.createDataFrame(hard, df.schema)).orderBy("seq")
    sink, ids = matching.against_stored(str(tmp_path / "m"), buckets=8), sorted(r.seq for r in df.select("seq").collect())
    cuts = [ids[0], ids[len(ids) // 2], ids[-6], ids[-3], ids[-1] + 1]
    for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        sink(df.where((F.col("seq") >= lo) & (F.col("seq") < hi)), i)
    assert rows(matching.matched(spark, str(tmp_path / "m")), "seq", "match", "strategy") == rows(resolve.match_rows(df), "seq", "match", "strategy")
    kept = {r.seq for r in matching.kept_rows(spark, str(tmp_path / "m")).select("seq").collect()}
    assert kept == set(ids) - {r.seq for r in resolve.match_rows(df).collect()}


def test_upsert_order(spark):
    """Rows of one second are told apart, text orders hold, and the first write keeps the highest stamp."""
    t = dt.datetime(2024, 1, 1)
    early, late = (t + dt.timedelta(milliseconds=k) for k in (1, 900))
    schema = "id string, v string, ord timestamp, at timestamp"
    for batch in ([("a", "old", early, late), ("a", "new", late, early)], [("a", "new", late, early), ("a", "old", early, late)]):
        df = spark.createDataFrame(batch, schema).coalesce(1)
        assert rows(tables.first_version(df, "id", "at", "ord"), "v", "at") == [("new", late)]
        assert rows(tables.upsert_events(df.where("v = 'old'"), df.where("v = 'new'"), "id", "at", "ord"), "v", "at") == [("new", late)]
        by_text = df.withColumn("ord", F.when(F.col("v") == "new", "b").otherwise("a"))
        assert rows(tables.first_version(by_text, "id", "at", "ord"), "v") == [("new",)]


def test_registry():
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and set(queries.QUERIES) <= set(names) and len(queries.QUERIES) > 150
    assert all(queries.OPERATORS[n] for n in queries.QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["flag", "rank", "seq", "overall"] and df.count() > 0


def test_retry_then_give_up(spark):
    tried = []

    def read():
        tried.append(1)
        if len(tried) < 3:
            raise OSError("not yet")
        return spark.range(2)
    assert readers.retried(read, 3, 0).count() == 2 and len(tried) == 3
    tried.clear()
    with pytest.raises(OSError):
        readers.retried(read, 2, 0)
    tried.clear()
    assert readers.readable(read, spark.range(0), 2, 0).count() == 0
    tried.clear()
    gone, log = readers.read_and_log(read, spark.range(0), "site", F.lit(dt.datetime(2024, 1, 1)), 2, 0)
    assert gone.count() == 0 and rows(log, "source", "count", "ok", "note") == [("site", 0, False, "OSError: not yet")]
    here, log = readers.read_and_log(read, spark.range(0), "site", F.lit(dt.datetime(2024, 1, 1)), 2, 0)
    assert here.count() == 2 and rows(log, "count", "ok", "note") == [(2, True, None)]


def test_a_lost_run_leaves_the_old_state(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    df = curation_places(spark, SF).where("seq < 90")
    half = [df.where("seq < 60"), df.where("seq >= 60")]
    assert runs.curation_run(store, 0, half[0], dt.date(2024, 1, 1)) is not None
    before = (store.state(), store.read("places").count(), runs.stored_facets(store).count())
    with monkeypatch.context() as m:
        m.setattr(Change, "commit", lambda self: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            runs.curation_run(store, 1, half[1], dt.date(2024, 1, 2))
    assert (store.state(), store.read("places").count(), runs.stored_facets(store).count()) == before
    assert runs.curation_run(store, 1, half[1], dt.date(2024, 1, 2)) is not None and runs.curation_run(store, 1, half[1], dt.date(2024, 1, 2)) is None
    assert store.read("places").count() > before[1] and runs.index_size(store).first().docs == store.read("places").count()
    assert runs.status_rates(store).first().total == 90


def test_live_rows_by_the_nearest_second(spark, tmp_path):
    t = [dt.datetime(2024, 1, 1, 0, 0, 0, 400000), dt.datetime(2024, 1, 1, 0, 0, 0, 600000), dt.datetime(2024, 1, 1, 12, 0, 0, 600000)]
    spark.createDataFrame(list(enumerate(t)), "user_id long, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    from placewright.queries import QUERIES
    assert {tuple(r) for r in QUERIES["live_index_rows"](spark, str(tmp_path)).collect()} == {(0, "stale"), (1, "fresh"), (2, "fresh")}


def test_places_are_dealt_out(spark):
    """The one small file of customers makes as many tasks as the session asks for, below filters on derived columns too."""
    found = places(spark, SF).where("length(name) > 3").groupBy(F.spark_partition_id()).count().collect()
    assert len(found) > 1


def test_stored_names_of_a_common_word(spark, tmp_path):
    """Names that share a word meet under it: signatures go before the distance, inside the join, and matches are those of one run over all rows."""
    import random
    rnd = random.Random(3)
    stems = ["".join(rnd.choice("aeioubdfgklmnprs") for _ in range(12)) for _ in range(40)]
    places = [(i, f"{s} gallery", "bangkok", None, None, None, None) for i, s in enumerate([*stems, *(t[:5] + "x" + t[6:] for t in stems[:20]), *(t + "s" for t in stems[10:30])])]
    df = spark.createDataFrame(places, "seq long, name string, city string, domain string, address string, geo_lat double, geo_lng double")
    root = str(tmp_path / "s")
    matching.against_stored(root)(df.where("seq < 40"), 0)
    found, _ = matching.match_batch(Store(spark, root), df.where("seq >= 40"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line and "levenshtein" in line]
    assert joins and all(0 < line.find("bit_count") < line.find("levenshtein") for line in joins)
    want = {tuple(r) for r in resolve.match_rows(df).where("seq >= 40").collect()}
    assert len(want) == 40 and {tuple(r) for r in found.collect()} == want
