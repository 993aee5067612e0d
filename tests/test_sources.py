import json
import zlib

import office_files as office
import pytest
from pyspark.sql import functions as F

from folioquery.operators.index import units_per_file
from folioquery.schema import DOCUMENTS
from folioquery.sources import corpus, html, office as office_source, sections, tables
from folioquery.sources.categories import category_map, folder_categories, with_category


def rows(df, *columns):
    return [tuple(r) for r in df.orderBy("file_name", "doc_seq").select(*columns).collect()]


def test_csv_rows_become_sentences(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,x\n,y\n,\n\n"two\nlines",NA\n2,"say ""hi"""\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("only\nz\n", encoding="utf-8")
    got = rows(tables.csv_documents(spark, str(tmp_path)), "file_name", "row_no", "text")
    assert got == [("a.csv", 2, "a: 1. b: x"), ("a.csv", 3, "b: y"), ("a.csv", 4, ""), ("a.csv", 5, "a: two\nlines"),
                   ("a.csv", 6, 'a: 2. b: say "hi"'), ("b.csv", 2, "only: z")]


def test_csv_split_over_tasks_keeps_row_numbers(spark, tmp_path):
    (tmp_path / "big.csv").write_text("n,sq\n" + "".join(f"{i},{i * i}\n" for i in range(5000)), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        df = tables.csv_documents(spark, str(tmp_path), multi_line=False)
        got = df.select("row_no", "text").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(tuple, got)) == [(i + 2, f"n: {i}. sq: {i * i}") for i in range(5000)]


@pytest.mark.parametrize("width, empty", [(70, 64), (200, None)])
def test_csv_of_any_width(spark, tmp_path, width, empty):
    head = ["" if i == empty else f"h{i}" for i in range(width)]
    cells = ["" if i == empty else str(i) for i in range(width)]
    (tmp_path / "w.csv").write_text(",".join(head) + "\n" + ",".join(cells) + "\n", encoding="utf-8")
    (tmp_path / "n.csv").write_text('"a\nb",c\n1,2\n', encoding="utf-8")
    got = rows(tables.csv_documents(spark, str(tmp_path)), "file_name", "text")
    assert got == [("n.csv", "a\nb: 1. c: 2"), ("w.csv", ". ".join(f"h{i}: {i}" for i in range(width) if i != empty))]


def test_csv_record_wider_than_every_header_fails(spark, tmp_path):
    (tmp_path / "w.csv").write_text("a,b\n1,2,3\n", encoding="utf-8")
    with pytest.raises(Exception, match="widest header"):
        tables.csv_documents(spark, str(tmp_path)).collect()


def test_markdown_sections(spark, tmp_path):
    (tmp_path / "f.md").write_text("# Top\r\nintro  text\r\n## One\n\n\n\nbody\n### Sub\nmore\n## Two\n", encoding="utf-8")
    got = rows(sections.markdown_documents(spark, str(tmp_path)), "section", "text")
    assert got == [("Top", "# Top\nintro text"), ("One", "## One\n\nbody\n### Sub\nmore"), ("Two", "## Two")]


def test_entities(spark, tmp_path):
    case = {"industria": "Retail", "problemas_tipicos": ["p1", "p2"], "solucion_acme": "s",
            "servicios_relacionados": ["a", "b"], "resultado_esperado": "r"}
    (tmp_path / "c.json").write_text(json.dumps({"x": 1, "casos_de_uso": [case]}), encoding="utf-8")
    (tmp_path / "none.json").write_text("{}", encoding="utf-8")
    fields = sections.use_case_fields("Acme")
    got = rows(sections.entity_documents(spark, str(tmp_path), fields), "section", "text")
    assert got == [("Retail", "Industria: Retail.\nProblemas típicos: p1; p2.\nSolución de Acme: s.\n"
                              "Servicios relacionados: a, b.\nResultado esperado: r.")]
    del case["resultado_esperado"]
    (tmp_path / "c.json").write_text(json.dumps({"casos_de_uso": [case]}), encoding="utf-8")
    with pytest.raises(Exception, match="missing field"):
        sections.entity_documents(spark, str(tmp_path), fields).collect()
    loose = rows(sections.entity_documents(spark, str(tmp_path), fields, strict=False), "text")
    assert loose[0][0].endswith("Servicios relacionados: a, b.")


def test_entities_of_unknown_layout(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"x": 1, "casos_de_uso": [{"area": "Moss", "known_uses": ["roof", "pot"], "n": 2}]}', encoding="utf-8")
    (tmp_path / "none.json").write_text("{}", encoding="utf-8")
    got = rows(corpus.load_documents(spark, str(tmp_path)), "section", "text")
    assert got == [("Moss", "Area: Moss.\nKnown uses: roof; pot.\nN: 2.")]


def test_html_sections(spark, tmp_path):
    (tmp_path / "moss.html").write_text(
        "<html><head><title>Moss</title><style>p {}</style></head>"
        "<body><h2>Shade</h2><p>Grows on the north side.</p><h2>Water</h2><p>Drinks <i>fog</i>.</p></body></html>",
        encoding="utf-8")
    got = rows(html.html_documents(spark, str(tmp_path)), "section", "text", "format")
    assert got == [("Shade", "Shade\nGrows on the north side.", "html"), ("Water", "Water\nDrinks fog .", "html")]


def test_html_long_runs_and_odd_references(spark):
    pages = {"br": "<p>a" + "<br>" * 100_000 + "b</p>", "space": "<h2>" + " " * 100_000 + "Head</h2><p>x</p>",
             "empty": "<p>u</p><h2>" + " <b> </b>" * 50_000 + "</h2><p>v</p>",
             "refs": "<p>&apos;&#9999999;&#xD800;&#0;&#150;&#99999999999;&NotEqualTilde;&CounterClockwiseContourIntegral;</p>"}
    df = html.html_sections(spark.createDataFrame(list(pages.items()), "file_name string, content string"))
    got = {r.file_name: (r.section, r.text) for r in df.collect()}
    odd = "'\ufffd\ufffd\ufffd\u2013\ufffd\u2242\u0338\u2233"
    assert got == {"br": ("Inicio", "Inicio\na b"), "space": ("Head", "Head\nx"), "empty": ("Inicio", "Inicio\nu v"),
                   "refs": ("Inicio", "Inicio\n" + odd)}


def test_html_quirks(spark):
    page = ("<HTML><BODY><nav><li>menu</li></nav><p>a<b>b</b> c&amp;d &eacute;&#233;&#xE9;&nope;</p>"
            "<h1> </h1><ul><li>x <p>y</p> z</li></ul><div>lost</div><!-- gone --><h3>Empty</h3><h3>End</h3><td>t</td>"
            "<p>open <footer>f</footer>tail")
    df = html.html_sections(spark.createDataFrame([("f", page)], "file_name string, content string"))
    got = rows(df, "section", "text")
    assert got == [("Inicio", "Inicio\na b c&d ééé&nope; x y z"), ("End", "End\nt open tail")]


def test_docx(spark, tmp_path):
    office.write_docx(tmp_path / "p.docx", office.par("before") + office.par("Lichens", "T1") + office.par(" slow growth ")
                      + office.word_table([["Kind", "Hue"], ["Crust", "grey 80"], ["Leaf", ""]])
                      + office.word_table([["lonely"]]) + office.par("Nada", "T1"))
    got = rows(office_source.office_documents(spark, str(tmp_path), None, office_source.word_sections), "section", "text")
    assert got == [("Inicio", "Inicio\nbefore"), ("Lichens", "Lichens\nslow growth"),
                   ("tabla 1", "Kind: Crust. Hue: grey 80"), ("tabla 1", "Kind: Leaf")]


def test_xlsx(spark, tmp_path):
    office.write_xlsx(tmp_path / "i.xlsx", {
        "Seeds": [["Bed", "Rows"], ["N", 10], [None, None], ["S", 2.5], [None, (45292,)]], "Vacía": [["x"]]})
    got = rows(office_source.office_documents(spark, str(tmp_path), None, office_source.sheet_sentences),
               "section", "row_no", "text")
    assert got == [("Seeds", 2, "Bed: N. Rows: 10"), ("Seeds", 4, "Bed: S. Rows: 2.5"),
                   ("Seeds", 5, "Rows: 2024-01-01 00:00:00")]


def test_pptx(spark, tmp_path):
    office.write_pptx(tmp_path / "s.pptx", [(["Pond plants", "uno\ndos"], "Mention frogs."), ([], None), (["Fin"], None)])
    got = rows(office_source.office_documents(spark, str(tmp_path), None, office_source.slide_documents), "slide", "text")
    assert got == [(1, "Pond plants\nuno\ndos\nNotas del orador: Mention frogs."), (3, "Fin")]


def test_pages_keep_their_numbers(spark):
    pages = spark.createDataFrame([("a.pdf", 1, " x  y "), ("a.pdf", 2, " \n"), ("a.pdf", 3, "z"), ("a.pdf", 4, None)],
                                  "file_name string, page int, text string")
    assert rows(sections.page_documents(pages), "page", "text") == [(1, "x y"), (3, "z")]


def test_corpus_scan_and_categories(spark, tmp_path):
    (tmp_path / "B.MD").write_text("## Uno\nx", encoding="utf-8")
    (tmp_path / "a.csv").write_text("k\nv\n", encoding="utf-8")
    (tmp_path / "c.htm").write_text("<p>hola</p>", encoding="utf-8")
    (tmp_path / "_d.csv").write_text("k\nv\n", encoding="utf-8")
    (tmp_path / "e.txt").write_text("no", encoding="utf-8")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "f.md").write_text("## no", encoding="utf-8")
    office.write_xlsx(tmp_path / "g.xlsx", {"H": [["c"], ["1"]]})
    (tmp_path / "_categorias.json").write_text('{"a.csv": "Ventas", "B.MD": ""}', encoding="utf-8-sig")
    docs = corpus.load_documents(spark, str(tmp_path), configured=category_map(spark, {"a.csv": "X", "B.MD": "Legal"}),
                                 override=folder_categories(spark, str(tmp_path / "_categorias.json")))
    assert docs.schema.fieldNames() == DOCUMENTS.fieldNames()
    assert rows(docs, "file_name", "category", "format") == [
        ("B.MD", "Legal", "markdown"), ("a.csv", "Ventas", "csv"), ("c.htm", "General", "html"), ("g.xlsx", "General", "xlsx")]
    assert [r.units for r in units_per_file(docs).collect()] == [1, 1, 1, 1]


def test_category_without_maps(spark):
    df = spark.createDataFrame([("a",)], "file_name string")
    assert with_category(df).first().category == "General"


def test_sheets_of_a_workbook_are_read_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(office_source, "SHEET_ROWS", 7)
    sheets = {f"S{i}": [["k", "v"]] + [[f"{i}-{j}", str(j)] for j in range(40)] for i in range(8)}
    office.write_xlsx(tmp_path / "b.xlsx", sheets)
    files = spark.read.format("binaryFile").load(str(tmp_path)).select(F.lit("b.xlsx").alias("file_name"), "content")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cells = office_source.sheet_cells(files).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.task for r in cells}) > 1
    assert sorted((r.section, r.ordinal, tuple(r.cells)) for r in cells) == sorted(
        (name, i, tuple(row)) for name, rows in sheets.items() for i, row in enumerate(rows))


def test_elements_of_a_part_do_not_add_up():
    text = b"<a><rows>" + b"".join(b"<r><c>%d</c></r>" % i for i in range(5000)) + b"</rows></a>"
    for packed in (b"\0" + text, b"\1" + zlib.compress(text, wbits=-15)):
        found = [e.findtext("c") for e in office_source._elements(packed, "r", 100)]
        assert found == [str(i) for i in range(5000)]
