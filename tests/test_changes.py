"""Uploads in any order, folders that lose files, votes on answers, durations that merge."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioquery.operators import generations as G, index as I, reconcile, telemetry
from folioquery.plans.pipeline import ingest, open_search, sync
from folioquery.schema import FEEDBACK_LOG, QUERY_LOG
from folioquery.streaming import coverage
from folioquery.streaming.reindexing import watch_folder


def texts(spark, path):
    return sorted(r.text for r in I.read_index(spark, path).select("text").collect())


def upload(landing, name, text, when):
    folder = landing / name
    folder.mkdir(parents=True)
    (folder / "a b.md").write_text(text, encoding="utf-8")
    os.utime(folder / "a b.md", (when, when))


def test_uploads_in_any_order(spark, tmp_path):
    landing, path = tmp_path / "landing", str(tmp_path / "ix")

    def watch():
        watch_folder(spark, str(landing / "*"), path, str(tmp_path / "ck"), buckets=4).awaitTermination()

    upload(landing, "1", "## Uno\nnew", 2_000_000)
    watch()
    assert texts(spark, path) == ["## Uno\nnew"]
    first = G.generation(spark, path).number
    upload(landing, "2", "## Uno\nolder", 1_000_000)      # an older upload that comes later
    upload(landing, "3", "## Uno\nnew", 3_000_000)        # the same contents again
    watch()
    upload(landing, "4", "## Uno\nbetween", 2_500_000)    # older than the repeated upload
    watch()
    assert texts(spark, path) == ["## Uno\nnew"] and G.generation(spark, path).number == first
    upload(landing, "5", "## Uno\nfirst", 4_000_000)      # two in one batch
    upload(landing, "6", "## Uno\nlast", 5_000_000)
    watch()
    assert texts(spark, path) == ["## Uno\nlast"] and G.generation(spark, path).number == first + 1


def test_index_follows_a_folder(spark, tmp_path):
    docs, path = tmp_path / "docs", str(tmp_path / "ix")
    docs.mkdir()
    for name, text in (("a.md", "alfa"), ("b c.md", "beta"), ("d.md", "delta"), ("e.txt", "no")):
        (docs / name).write_text(f"## Uno\n{text}", encoding="utf-8")
    assert sync(spark, str(docs), path, buckets=4) == {"new": 4}
    (docs / "b c.md").write_text("## Uno\ngamma", encoding="utf-8")
    (docs / "d.md").unlink()
    (docs / "f.csv").write_text("k\nv\n", encoding="utf-8")
    assert sync(spark, str(docs), path, buckets=4) == {"same": 2, "changed": 1, "gone": 1, "new": 1}
    assert texts(spark, path) == ["## Uno\nalfa", "## Uno\ngamma", "k: v"]
    number = G.generation(spark, path).number
    assert sync(spark, str(docs), path, buckets=4) == {"same": 4}
    assert G.generation(spark, path).number == number
    assert {r.term for r in open_search(spark, path).terms.collect()} == {None, "uno", "alfa", "gamma", "k", "v"}


def test_gone_files_leave_an_index_without_digests(spark, tmp_path):
    docs, path = tmp_path / "docs", str(tmp_path / "ix")
    docs.mkdir()
    for name in ("a.md", "b.md"):
        (docs / name).write_text(f"## Uno\n{name[0]}lfa", encoding="utf-8")
    ingest(spark, str(docs), path, buckets=4)
    (docs / "a.md").unlink()
    assert sync(spark, str(docs), path, buckets=4) == {"changed": 1, "gone": 1}  # read anew once
    assert texts(spark, path) == ["## Uno\nblfa"]


def test_states_of_files(spark):
    files = lambda rows: spark.createDataFrame(rows, "file_name string, digest string, listed int")
    got = reconcile.reconciled(files([("a", "1", 7), ("b", "2", 7), ("c", None, 7), ("d", "4", 7)]), files([("a", "1", 7), ("b", "x", 7), ("c", None, 7), ("e", "5", 7)]))
    assert sorted(map(tuple, got.collect())) == [("a", "same"), ("b", "changed"), ("c", "changed"), ("d", "new"), ("e", "gone")]
    assert reconcile.reconciled(files([]), files([])).collect() == []


def test_audit_of_streams_equals_tables(spark, tmp_path):
    rnd, start = random.Random(4), datetime(2024, 5, 1)
    long = "x" * 500
    asked = [(f"q{rnd.randrange(6)}", rnd.choice([long, "short", None]), ["f"], rnd.random() < 0.6, 1.0, start + timedelta(minutes=rnd.randrange(3000)))
             for _ in range(80)]
    asked += [asked[0], (None, "short", [], True, 1.0, start)]
    votes = [(f"q{rnd.randrange(6)}", rnd.choice([long[:300], "short", None]), rnd.choice(["positivo", "negativo"]), start + timedelta(minutes=rnd.randrange(3400)))
             for _ in range(120)]
    end = start + timedelta(days=30)  # late enough to pass all watermarks
    queries = spark.createDataFrame(asked + [("end", "end", [], True, 1.0, end)], QUERY_LOG)
    feedback = spark.createDataFrame(votes + [("end", "end", "positivo", end)], FEEDBACK_LOG)
    places = {}
    for name, rows in (("q", queries), ("f", feedback)):
        places[name] = str(tmp_path / name)
        telemetry.append_log(rows, places[name])
    want = sorted(map(tuple, coverage.windowed_audit(queries, feedback, within="5 hours").where(F.col("window_start") < end).collect()))

    seen = {}
    for row in set((a[0], a[1], a[3], a[5]) for a in asked):
        mine = [v[2] for v in votes if v[0] == row[0] and row[1] is not None and v[1] == row[1][:300] and row[3] <= v[3] <= row[3] + timedelta(hours=5)]
        w = seen.setdefault(row[3].replace(minute=0), [0, 0, 0, 0, 0])
        for i, x in enumerate((row[2], not row[2], "negativo" in mine, mine.count("positivo"), mine.count("negativo"))):
            w[i] += x
    assert want == sorted((k, *v) for k, v in seen.items())

    streams = coverage.windowed_audit(coverage.query_stream(spark, places["q"]), coverage.feedback_stream(spark, places["f"]), within="5 hours")
    query = (streams.writeStream.outputMode("append").format("memory").queryName("audit")
             .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("audit").where(F.col("window_start") < end).collect())) == want


@pytest.mark.parametrize("size, bound", [(4096, 0.0), (64, 0.06)])
def test_merged_sketches_stay_within_their_rank_error(spark, size, bound):
    rnd = random.Random(1)
    rows = [(datetime(2024, 5, 1) + timedelta(hours=rnd.randrange(24 * 40)), rnd.choice([None, rnd.expovariate(1.0)])) for _ in range(6000)]
    log = spark.createDataFrame(rows, "timestamp timestamp, duracion_s double")
    got = telemetry.merged_durations(telemetry.daily_sketches(log, size), F.trunc("day", "month").alias("month"), size=size).collect()
    assert sorted(str(r.month) for r in got) == ["2024-05-01", "2024-06-01"]
    for r in got:
        values = sorted(d for t, d in rows if d is not None and t.month == r.month.month)
        assert r.questions == len(values)
        for share, value in ((0.5, r.median_s), (0.95, r.p95_s)):
            rank = sum(v <= value for v in values) / len(values)
            assert abs(rank - share) <= bound + 1 / len(values)
