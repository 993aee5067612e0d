from datetime import datetime

from pyspark.sql import functions as F

from folioquery.operators import index as I, telemetry
from folioquery.plans.pipeline import answer, ingest, open_search, reindex
from folioquery.streaming import coverage
from folioquery.streaming.reindexing import watch_folder

CHUNKS = "file_name string, category string, text string"


def content(spark, path, **kw):
    return sorted(map(tuple, I.read_index(spark, path, **kw).select("file_name", "category", "text").collect()))


def test_build_append_filter(spark, tmp_path):
    path = str(tmp_path / "ix")
    rows = [("a", "L", "1"), ("b", "C", "2")]
    df = spark.createDataFrame(rows, CHUNKS)
    I.build_index(df, path, buckets=4)
    I.build_index(df, path, buckets=4)
    assert content(spark, path) == rows
    I.build_index(df, path, reset=False, buckets=4)
    assert content(spark, path) == sorted(rows * 2)
    assert content(spark, path, category="C") == [rows[1]] * 2
    assert content(spark, path, file_name="a", buckets=4) == [rows[0]] * 2
    assert [r.category for r in I.index_categories(I.read_index(spark, path)).collect()] == ["C", "L"]


def test_replace_is_whole_and_idempotent(spark, tmp_path):
    path = str(tmp_path / "ix")
    I.build_index(spark.createDataFrame([(f"f{i}", "L", f"t{i}-{j}") for i in range(20) for j in range(3)], CHUNKS), path, buckets=4)
    files = spark.createDataFrame([("f3",), ("f4",), ("new",)], "file_name string")
    fresh = spark.createDataFrame([("f3", "C", "n3"), ("new", "C", "n")], CHUNKS)
    want = sorted([(f"f{i}", "L", f"t{i}-{j}") for i in range(20) if i not in (3, 4) for j in range(3)]
                  + [("f3", "C", "n3"), ("new", "C", "n")])
    for _ in range(2):
        I.replace_files(spark, path, fresh, files, buckets=4)
        assert content(spark, path) == want


def test_emptied_bucket(spark, tmp_path):
    path = str(tmp_path / "ix")
    I.build_index(spark.createDataFrame([("only", "L", "t")], CHUNKS), path, buckets=4)
    files = spark.createDataFrame([("only",)], "file_name string")
    I.replace_files(spark, path, spark.createDataFrame([], CHUNKS), files, buckets=4)
    assert content(spark, path) == []


def test_ingest_reindex_and_stream(spark, tmp_path):
    docs, path = tmp_path / "docs", str(tmp_path / "ix")
    docs.mkdir()
    (docs / "a.md").write_text("## Uno\nalfa\n## Dos\nbeta", encoding="utf-8")
    (docs / "b.csv").write_text("k,v\n1,x\n", encoding="utf-8")
    counts = ingest(spark, str(docs), path, buckets=4)
    assert sorted(map(tuple, counts.collect())) == [("a.md", 2, 2), ("b.csv", 1, 1)]
    ids = I.read_index(spark, path).orderBy("chunk_id").select("chunk_id", "text").collect()
    assert [tuple(r) for r in ids] == [(0, "## Uno\nalfa"), (1, "## Dos\nbeta"), (2, "k: 1. v: x")]

    def found(index):
        asked = spark.createDataFrame([(1, "gamma epsilon", None), (2, "alfa", None)], "question_id long, question string, category string")
        rows = answer(asked, I.read_index(spark, path), index, threshold=0.1)
        return sorted((r.question_id, r.context, r.used_retrieval) for r in rows.select("question_id", "context", "used_retrieval").collect())

    assert [used for _, _, used in found(open_search(spark, path))] == [False, True]
    (docs / "a.md").write_text("## Tres\ngamma", encoding="utf-8")
    reindex(spark, [str(docs / "a.md")], path, buckets=4)
    expected = [("a.md", "General", "## Tres\ngamma"), ("b.csv", "General", "k: 1. v: x")]
    assert content(spark, path) == expected
    assert found(open_search(spark, path)) == found(None)  # as if the search index were built for the question

    landing = tmp_path / "landing"
    for upload, text in (("1", "## Cuatro\ndelta"), ("2 x", "## Cinco\nepsilon")):
        (landing / upload).mkdir(parents=True)
        (landing / upload / "c d.md").write_text(text, encoding="utf-8")
        for _ in range(2):
            watch_folder(spark, str(landing / "*"), path, str(tmp_path / "ck"), buckets=4).awaitTermination()
        assert content(spark, path) == sorted(expected + [("c d.md", "General", text)])


def test_names_with_glob_characters(spark, tmp_path):
    docs, path, landing = tmp_path / "docs", str(tmp_path / "ix"), tmp_path / "landing"
    docs.mkdir()
    (docs / "faq[1] {a} b%41.md").write_text("## Uno\nalfa", encoding="utf-8")
    (docs / "z.json").write_text('{"casos_de_uso": [{"k": "v"}]}', encoding="utf-8")
    (docs / "_categorias.json").write_text('{"z.json": "Legal"}', encoding="utf-8")
    ingest(spark, str(docs), path, buckets=4)
    assert content(spark, path) == [("faq[1] {a} b%41.md", "General", "## Uno\nalfa"), ("z.json", "Legal", "K: v.")]
    for n, name in enumerate(("faq[1] {a} b%41.md", "x[2].md")):
        (docs / name).write_text(f"## Dos\n{n}", encoding="utf-8")
        reindex(spark, [str(docs / name)], path, buckets=4)
    (landing / "1").mkdir(parents=True)
    (landing / "1" / "x[2].md").write_text("## Tres\n", encoding="utf-8")
    watch_folder(spark, str(landing / "*"), path, str(tmp_path / "ck"), buckets=4).awaitTermination()
    assert [r[2] for r in content(spark, path)] == ["## Dos\n0", "## Tres", "K: v."]


def test_replace_reads_its_buckets_only(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ix")
    I.build_index(spark.createDataFrame([(f"f{i}", "L", str(i)) for i in range(40)], CHUNKS), path, buckets=8)
    plans = []
    write = I._write
    monkeypatch.setattr(I, "_write", lambda rows, *a: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), write(rows, *a)))
    new = spark.createDataFrame([("f3", "L", "new")], CHUNKS)
    I.replace_files(spark, path, new, new.select("file_name"), buckets=8)
    number = spark.range(1).select(I.bucket(F.lit("f3"), 8)).first()[0]
    filters = next(line for line in plans[0].splitlines() if "PartitionFilters" in line)
    assert f"(bucket#" in filters and f"= {number})" in filters.split("PartitionFilters:")[1]
    assert len(content(spark, path)) == 40 and ("f3", "L", "new") in content(spark, path)


def test_logs_and_windows(spark, tmp_path):
    stamp = lambda h, m: datetime(2024, 5, 1, h, m)
    rows = [("q1", "ñ", [("a.md",), ("b.md",)], True, 1.234, stamp(9, 5)), ("q2", "no", [], False, 0.5, stamp(9, 50)),
            ("q2", "no", [], False, 0.7, stamp(10, 5))]
    answered = spark.createDataFrame(rows, "question string, answer string, sources array<struct<file_name:string>>, "
                                           "used_retrieval boolean, duration_s double, at timestamp")
    queries = str(tmp_path / "q")
    telemetry.append_log(telemetry.query_log(answered, F.col("at")), queries)
    log = telemetry.read_query_log(spark, queries)
    first = log.where("pregunta = 'q1'").first()
    assert (first.respuesta, first.fuentes, first.duracion_s, first.timestamp) == ("ñ", ["a.md", "b.md"], 1.23, stamp(9, 5))
    report = telemetry.coverage_report(log).first()
    assert (report.questions, report.answered, report.uncovered, report.median_s) == (3, 1, 2, 0.7)
    assert [tuple(r) for r in telemetry.uncovered_questions(log).collect()] == [("q2", 2)]

    feedback = str(tmp_path / "f")
    votes = spark.createDataFrame([("q", "x" * 400, True), ("q", "y", False)], "question string, answer string, positive boolean")
    telemetry.append_log(telemetry.feedback_log(votes), feedback)
    got = {r.feedback: r for r in telemetry.read_feedback_log(spark, feedback).collect()}
    assert len(got["positivo"].respuesta) == 300 and got["negativo"].timestamp is not None
    assert telemetry.feedback_report(telemetry.read_feedback_log(spark, feedback)).first().positive_rate == 0.5

    def stream(df, name):
        q = df.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(map(tuple, spark.table(name).collect()))

    windows = stream(coverage.windowed_coverage(coverage.query_stream(spark, queries)), "windows")
    assert windows == [(stamp(9, 0), 1, 1), (stamp(10, 0), 0, 1)]
    assert windows == sorted(map(tuple, coverage.windowed_coverage(log).collect()))
    assert [r[1:] for r in stream(coverage.windowed_feedback(coverage.feedback_stream(spark, feedback)), "votes")] == \
        [("negativo", 1), ("positivo", 1)]
