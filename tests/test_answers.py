import random

import pytest

from folioquery import constants as K
from folioquery.functions import text as tx
from folioquery.operators import answers as A
from folioquery.operators.history import feedback_pairs, with_history
from folioquery.operators.index import missing_files
from folioquery.plans.pipeline import answer
from pyspark.sql import functions as F

HITS = ("question_id long, rank int, score double, file_name string, category string, page int, slide int, "
        "section string, row_no long, text string")


@pytest.fixture(scope="module")
def hits(spark):
    return spark.createDataFrame([
        (1, 2, 0.81249, "b.pptx", "Legal", None, 0, None, None, "dos"),
        (1, 1, 0.9, "a.pdf", "Comercial", 4, None, None, None, "x" * 200),
        (1, 3, 0.8, "c.xlsx", "Legal", None, None, "Hoja", 7, "tres"),
        (1, 4, 0.79, "d.csv", "Legal", None, None, None, 9, "cuatro"),
        (1, 5, 0.78, "a.pdf", "Legal", 0, None, "s", None, "cinco"),
        (2, 1, 0.95, "e.txt", "General", None, None, None, None, "seis")], HITS)


def test_context(hits):
    got = dict(map(tuple, A.cited_context(hits).collect()))
    heads = [part.split("\n")[0] for part in got[1].split("\n\n---\n\n")]
    assert heads == ["[Fragmento 1 — Fuente: a.pdf, página 4 — Categoría: Comercial]",
                     "[Fragmento 2 — Fuente: b.pptx, diapositiva 0 — Categoría: Legal]",
                     "[Fragmento 3 — Fuente: c.xlsx, sección 'Hoja', fila 7 — Categoría: Legal]",
                     "[Fragmento 4 — Fuente: d.csv, fila 9 — Categoría: Legal]",
                     "[Fragmento 5 — Fuente: a.pdf, página 0 — Categoría: Legal]"]
    assert got[2] == "[Fragmento 1 — Fuente: e.txt — Categoría: General]\nseis"


def test_sources(hits):
    got = {r.question_id: r.sources for r in A.source_lists(hits).collect()}
    assert [(s.file_name, s.location, s.score) for s in got[1]] == [
        ("a.pdf", "4", 0.9), ("b.pptx", "", 0.812), ("c.xlsx", "Hoja", 0.8), ("d.csv", "9", 0.79), ("a.pdf", "s", 0.78)]
    assert len(got[1][0].extract) == 180
    assert {r.question_id: r.files for r in A.cited_files(hits).collect()}[1] == ["a.pdf", "b.pptx", "c.xlsx", "d.csv"]


def test_prompt_and_fallback(spark, hits):
    asked = spark.createDataFrame([(2, "¿qué?", None), (3, "¿dónde queda la oficina?", None)],
                                  "question_id long, question string, category string")
    past = spark.createDataFrame([(2, [("user", "hola"), ("system", "nota")])],
                                 "question_id long, history array<struct<role:string,text:string>>")
    got = {r.question_id: r for r in A.answers(asked, hits, past, system_prompt="C: {context} / {fallback}",
                                               fallback="nada").collect()}
    assert [tuple(m) for m in got[2].prompt] == [
        ("system", "C: [Fragmento 1 — Fuente: e.txt — Categoría: General]\nseis / nada"),
        ("user", "hola"), ("assistant", "nota"), ("user", "¿qué?")]
    assert (got[2].used_retrieval, got[2].answer, len(got[2].sources)) == (True, None, 1)
    assert (got[3].used_retrieval, got[3].answer, got[3].sources, got[3].prompt) == (False, "nada", [], None)


def test_category_reaches_the_search(spark):
    chunks = spark.createDataFrame(
        [("k1", "a.md", "Legal", "contrato de servicio"), ("k2", "b.md", "Comercial", "contrato de venta")],
        "chunk_key string, file_name string, category string, text string")
    for name in ("page", "slide", "section", "row_no"):
        chunks = chunks.withColumn(name, F.lit(None).cast("int" if name != "section" else "string"))
    asked = spark.createDataFrame([(1, "contrato", "Legal"), (2, "contrato", None), (3, "contrato", "Interno")],
                                  "question_id long, question string, category string")
    got = {r.question_id: r for r in answer(asked, chunks, threshold=0.1).collect()}
    assert {q: sorted(s.file_name for s in r.sources) for q, r in got.items()} == {1: ["a.md"], 2: ["a.md", "b.md"], 3: []}
    assert "No encontré esta información" in got[3].answer


def test_history_over_blocks(spark):
    rnd = random.Random(1)
    rows = [(c, t, rnd.choice(["user", "assistant"]), f"m{c}-{t}") for c in range(3)
            for t in sorted(rnd.sample(range(60), 25))]
    got = with_history(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"), block=4).collect()
    for r in got:
        before = [x[3] for x in rows if x[0] == r.conv_id and x[1] < r.turn][-K.HISTORY_MESSAGES:]
        assert [m.text for m in r.history] == before


def test_feedback_pairs(spark):
    rows = [(1, 0, "assistant", "hola"), (1, 1, "user", "¿y?"), (1, 2, "assistant", "pues")]
    got = feedback_pairs(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    assert [(r.question, r.answer) for r in got.orderBy("turn").collect()] == [("", "hola"), ("¿y?", "pues")]


def test_text_functions(spark):
    row = spark.createDataFrame([("  a \t b\n\n\n\nc ", "ÀÉñçÖ ßøİ", "dir/x.y.CSV", [("uno",), (None,)])],
                                "t string, a string, p string, b array<struct<text:string>>").select(
        tx.clean(F.col("t")).alias("clean"), tx.fold_accents(F.col("a")).alias("fold"), tx.suffix(F.col("p")).alias("suffix"),
        tx.base_name(F.col("p")).alias("base"), tx.reply_text(F.col("b")).alias("reply"),
        tx.utc_stamp(F.lit("2024-05-01 10:00:00").cast("timestamp")).alias("stamp"),
        tx.cells_sentence(F.array(F.lit("h"), F.lit("i")), F.array(F.lit("v"), F.lit(""), F.lit("z"))).alias("cells")).first()
    assert (row.clean, row.suffix, row.base, row.reply, row.cells) == ("  a b\n\nc".strip(), ".csv", "x.y.CSV", "uno ", "h: v")
    assert row.fold.startswith("aenco ßø") and row.stamp == "2024-05-01T10:00:00.000000+00:00"


def test_missing_files(spark):
    one = spark.createDataFrame([("a",), ("a",), ("b",), ("b",)], "file_name string")
    two = spark.createDataFrame([("a",)], "file_name string")
    assert [r.file_name for r in missing_files(one, two).collect()] == ["b"]
