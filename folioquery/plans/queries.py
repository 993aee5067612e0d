"""Registered queries: every operator over the given tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioquery import constants as K
from folioquery.functions import prices, text as tx, vectors as vec
from folioquery.operators import answers as ans, chunking, dense, hashing, history, index as idx, lexical, postings, quotes, reconcile, telemetry
from folioquery.operators.generations import Draft, drop_old
from folioquery.session import dropped, scratch_folder, spread, written
from folioquery.sources import sections
from folioquery.sources.categories import category_map, with_category
from folioquery.sources.files import as_documents
from folioquery.sources.html import html_sections
from folioquery.streaming import coverage

Query = Callable[[SparkSession, str], DataFrame]

# Category maps of the demo corpus; an empty override falls through to the configured map.
CONFIGURED = {"src0": "Comercial", "src1": "Comercial", "src2": "Legal", "src3": "Interno", "src4": "Operacional",
              "src5": "Legal", "src6": "Comercial"}
OVERRIDE = {"src2": "Operacional", "src3": "", "src7": "Interno"}
DENSE_THRESHOLD = 0.3
RELEVANCE_THRESHOLD = 0.1
VECTOR_LENGTH = 64
SEARCH_BUCKETS = 16  # few files come in again, and each costs its bucket


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """``documents`` as units of source files; the language decides which location a unit has."""
    lang = F.col("lang")
    docs = spread(table(spark, sf, "documents")).select(
        F.col("source").alias("file_name"), F.col("doc_id").alias("doc_seq"), "text",
        F.when(lang == "en", (F.col("doc_id") + 1).cast("int")).alias("page"),
        F.when(lang == "de", F.col("doc_id").cast("int")).alias("slide"),
        F.when(lang == "fr", F.concat(F.lit("s"), F.col("doc_id").cast("string"))).alias("section"),
        F.when(lang.isin("fr", "es"), F.col("doc_id") + 2).alias("row_no"))
    return with_category(as_documents(docs, "txt"), category_map(spark, CONFIGURED), category_map(spark, OVERRIDE))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark passages; every third one asks within one category."""
    only = F.when(F.col("item_id") % 3 == 0, F.lit("Comercial"))
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("question_id"), F.col("text").alias("question"), only.alias("category"))


def hits(spark: SparkSession, sf: str) -> DataFrame:
    chunks = chunking.fixed_chunks(corpus(spark, sf))
    found = lexical.lexical_topk(questions(spark, sf), lexical.lexical_index(chunks))
    return lexical.hits_with_text(found, chunks)


def clean_documents(spark, sf):
    docs = spread(table(spark, sf, "documents")).where(tx.has_text(F.col("text")))
    return docs.select("doc_id", tx.clean(F.col("text")).alias("text"))


def _part_units(spark, sf):
    """The part table as the records of one file; its dense key is the record's position."""
    columns = ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
    return table(spark, sf, "part").select(F.lit("part.csv").alias("file_name"), (F.col("p_partkey") + 2).alias("row_no"),
                                           tx.row_sentence(columns).alias("text"))


def row_sentences(spark, sf):
    return _part_units(spark, sf)


def _page_units(spark, sf):
    lines = spread(table(spark, sf, "documents")).select(
        F.concat("source", F.lit("-"), F.col("doc_id").cast("string")).alias("file_name"),
        F.posexplode_outer(F.split("text", "\n")).alias("at", "text"))
    return sections.page_documents(lines.withColumn("page", F.col("at") + 1))


def page_text_units(spark, sf):
    return _page_units(spark, sf).select("file_name", "page", "text")


def markdown_sections(spark, sf):
    contents = spread(table(spark, sf, "documents")).select(
        F.col("doc_id").cast("string").alias("file_name"),
        F.regexp_replace("text", "\n", "\n## ").alias("content"))
    return sections.markdown_sections(contents).select("file_name", "section", "text")


def _html_units(spark, sf):
    return html_sections(spread(table(spark, sf, "pages")).select(
        F.col("page_id").cast("string").alias("file_name"), F.col("html").alias("content")))


def html_units(spark, sf):
    return _html_units(spark, sf).select("file_name", "section", "text")


def category_lookup(spark, sf):
    return corpus(spark, sf).select("file_name", "doc_seq", "category")


def format_union(spark, sf):
    union = (as_documents(_part_units(spark, sf), "csv")
             .unionByName(_html_units(spark, sf)).unionByName(_page_units(spark, sf)))
    return union.groupBy("format").agg(
        F.count("*").alias("units"), F.count("page").alias("with_page"), F.count("section").alias("with_section"),
        F.count("row_no").alias("with_row"), F.sum(F.length("text")).alias("characters"))


def units_per_source(spark, sf):
    return idx.units_per_file(corpus(spark, sf))


def missing_sources(spark, sf):
    name = F.col("doc_id").cast("string").alias("file_name")
    return idx.missing_files(table(spark, sf, "documents").select(name), table(spark, sf, "labels").select(name))


def file_names(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", tx.base_name(url).alias("base_name"), tx.suffix(url).alias("suffix"))


def fixed_chunks(spark, sf):
    return chunking.fixed_chunks(corpus(spark, sf)).select("chunk_key", "category", "text")


def chunk_ids(spark, sf):
    return chunking.with_chunk_id(chunking.fixed_chunks(corpus(spark, sf))).select("chunk_key", "chunk_id")


def recursive_chunks(spark, sf):
    return chunking.recursive_chunks(corpus(spark, sf)).select("chunk_key", "category", "text")


def role_prefixes(spark, sf):
    asked = table(spark, sf, "benchmark").select(tx.as_query(F.col("text")).alias("text"))
    return asked.unionByName(table(spark, sf, "documents").select(tx.as_passage(F.col("text")).alias("text")))


def _vectors(spark, sf):
    return spread(table(spark, sf, "embeddings")).select(
        "vec_id", F.col("label").cast("string").alias("category"), F.col("embedding").alias("vector"))


def _vector_questions(spark, sf, filtered):
    category = F.col("category") if filtered else F.lit(None).cast("string")
    return _vectors(spark, sf).select(F.col("vec_id").alias("question_id"), "vector", category.alias("category"))


def normalise_vectors(spark, sf):
    unit = _vectors(spark, sf).select("vec_id", F.posexplode(vec.l2_normalise(F.col("vector"))).alias("at", "x"))
    return unit.select("vec_id", "at", vec.score(F.col("x")).alias("x"))


def pair_scores(spark, sf):
    one = _vectors(spark, sf).select("vec_id", "vector")
    other = one.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vector").alias("other"))
    both = one.join(other, "vec_id")
    return both.select("vec_id", vec.score(vec.dot(F.col("vector"), F.col("other"))).alias("cosine"),
                       vec.score(vec.l2_relevance(F.col("vector"), F.col("other"))).alias("relevance"))


def dense_topk(spark, sf):
    return dense.dense_topk(_vector_questions(spark, sf, False), _vectors(spark, sf), "vec_id")


def dense_topk_filtered(spark, sf):
    return dense.dense_topk(_vector_questions(spark, sf, True), _vectors(spark, sf), "vec_id")


def dense_threshold(spark, sf):
    return dense.dense_topk(_vector_questions(spark, sf, False), _vectors(spark, sf), "vec_id",
                            threshold=RELEVANCE_THRESHOLD, metric="l2_relevance")


def cell_topk(spark, sf):
    vectors = _vectors(spark, sf)
    return dense.cell_topk(_vector_questions(spark, sf, False), vectors, dense.train_cells(vectors),
                           DENSE_THRESHOLD, "vec_id")


def ann_topk(spark, sf):
    """Only vectors that share a bucket of random projections with the question."""
    return hashing.hashed_topk(_vector_questions(spark, sf, False), _vectors(spark, sf), hashing.projections(VECTOR_LENGTH),
                               DENSE_THRESHOLD, "vec_id")


def lexical_topk(spark, sf):
    """Flagship: the passages that support each question, with their cited text."""
    return hits(spark, sf).select("question_id", "rank", "score", "chunk_key", "category", "text")


def cited_context(spark, sf):
    return ans.cited_context(hits(spark, sf))


def source_records(spark, sf):
    return ans.source_records(hits(spark, sf)).select("question_id", "rank", "source.*")


def cited_files(spark, sf):
    return ans.cited_files(hits(spark, sf)).select("question_id", F.array_join("files", ", ").alias("files"))


def _prompt_text(prompt):
    return F.array_join(F.transform(prompt, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


def answer_or_fallback(spark, sf):
    rows = ans.answers(questions(spark, sf), hits(spark, sf))
    return rows.select("question_id", "used_retrieval", "answer", _prompt_text(F.col("prompt")).alias("prompt"),
                       F.size("sources").alias("sources"))


def history_window(spark, sf):
    past = history.with_history(table(spark, sf, "conversations"))
    said = F.transform("history", lambda m: F.concat(m["role"], F.lit(": "), m["text"]))
    return past.select("conv_id", "turn", F.array_join(said, "\n").alias("history"))


def prompt_table(spark, sf):
    turns = history.with_history(table(spark, sf, "conversations")).where("role = 'user'").select(
        F.concat_ws("-", F.col("conv_id"), F.col("turn")).alias("question_id"),
        F.col("text").alias("question"), F.lit(None).cast("string").alias("category"), "history")
    chunks = chunking.fixed_chunks(corpus(spark, sf))
    found = lexical.lexical_topk(turns, lexical.lexical_index(chunks), threshold=0.1)
    rows = ans.answers(turns.drop("history"), lexical.hits_with_text(found, chunks), turns)
    return rows.select("question_id", "used_retrieval", _prompt_text(F.col("prompt")).alias("prompt"))


def feedback_pairs(spark, sf):
    pairs = history.feedback_pairs(table(spark, sf, "conversations"))
    log = telemetry.feedback_log(pairs.withColumn("positive", F.col("turn") % 4 == 1))
    return log.drop("timestamp")


def accent_fold(spark, sf):
    return spread(table(spark, sf, "documents")).select("doc_id", tx.fold_accents(F.col("text")).alias("folded"))


def _price_text():
    price = F.col("p_retailprice").cast("string")
    return F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" Desde "), price)).otherwise(price)


def price_parse(spark, sf):
    return table(spark, sf, "part").select("p_partkey", prices.price_value(_price_text()).alias("price"),
                                           prices.price_is_from(_price_text()).alias("is_from"))


def _catalogue(spark, sf):
    """Parts as a price list; economy parts stand for the maintenance plans of their brand."""
    service = F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit(K.MAINTENANCE), F.col("p_brand"))) \
        .otherwise(F.initcap("p_name"))
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("cat_ord"), service.alias("servicio"), _price_text().alias("precio_usd"),
        F.col("p_type").alias("plazo_entrega"))


def _lines(spark, sf):
    """Order lines as requested services: the part name alone, with an addition, or something else."""
    items = table(spark, sf, "lineitem").join(
        table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    asked = (F.when(F.col("l_returnflag") == "A", F.concat("p_name", F.lit(" con extras")))
             .when(F.col("l_returnflag") == "R", F.concat("p_type", F.lit(" "), "p_brand")).otherwise(F.col("p_name")))
    return items.select(F.col("l_orderkey").alias("quote_id"), F.col("l_linenumber").alias("line"),
                        asked.alias("requested"))


def _requests(spark, sf):
    """Order headers; the priority digit gives the months, the status letter picks the plan."""
    months = F.substring("o_orderpriority", 1, 1).cast("int") - 2
    plan = F.when(F.col("o_orderstatus") == "F", "Brand#1").when(F.col("o_orderstatus") == "O", "brand#2").otherwise("Oro")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("quote_id"), months.alias("months"), plan.alias("plan"))


def quote_lines(spark, sf):
    return quotes.quote_lines(_lines(spark, sf), _catalogue(spark, sf))


def quote_totals(spark, sf):
    catalogue, requests = _catalogue(spark, sf), _requests(spark, sf)
    totals = quotes.quote_totals(requests.select("quote_id"), quotes.quote_lines(_lines(spark, sf), catalogue),
                                 quotes.maintenance_lines(requests, catalogue))
    return totals.select("quote_id", F.round("subtotal", 2).alias("subtotal"), F.round("total", 2).alias("total"), "has_from")


def quote_unmatched(spark, sf):
    catalogue, requests = _catalogue(spark, sf), _requests(spark, sf)
    return quotes.unmatched_lines(quotes.quote_lines(_lines(spark, sf), catalogue),
                                  quotes.maintenance_lines(requests, catalogue))


def nested_quotes(spark, sf):
    services = _lines(spark, sf).groupBy("quote_id").agg(
        F.sort_array(F.collect_list(F.struct("line", "requested")))["requested"].alias("services"))
    full = quotes.quotes(_requests(spark, sf).join(services, "quote_id", "left"), _catalogue(spark, sf))
    said = F.transform("lines", lambda x: F.concat_ws("|", x["service"], F.round(x["price"], 2).cast("string"),
                                                      x["is_from"].cast("string"), x["delivery"]))
    return full.select("quote_id", F.array_join(said, "; ").alias("lines"), F.round("subtotal", 2).alias("subtotal"),
                       F.col("maintenance.plan").alias("plan"), F.round("maintenance.total", 2).alias("maintenance"),
                       F.round("total", 2).alias("total"), "payment_terms", "note",
                       F.array_join("unmatched", "; ").alias("unmatched"))


def _reissued(spark, sf):
    """(fresh units, files): files with a toxic Spanish text come in again, holding only their labelled texts."""
    rows, labels = corpus(spark, sf), table(spark, sf, "labels")
    toxic = labels.where("toxic = 1").join(table(spark, sf, "documents").where("lang = 'es'"), "doc_id")
    files = written(toxic.select(F.col("source").alias("file_name")).distinct())
    fresh = (rows.join(files, "file_name", "left_semi")
             .join(labels.select(F.col("doc_id").alias("doc_seq")), "doc_seq", "left_semi")
             .withColumn("text", F.concat(F.lit("v2 "), "text")))
    return fresh, files


def index_replace(spark, sf):
    """Files with a toxic Spanish text come in again, holding only their labelled texts."""
    columns = ["file_name", "doc_seq", "text"]
    fresh, files = _reissued(spark, sf)
    return idx.replaced(corpus(spark, sf).select(*columns), fresh.select(*columns), files).select(*columns)


def written_index(spark, sf):
    """The same replacement as commits of a written index, read back from its newest generation."""
    path = scratch_folder(spark)
    idx.build_index(corpus(spark, sf), path)
    fresh, files = _reissued(spark, sf)
    idx.replace_files(spark, path, fresh, files)
    return idx.read_index(spark, path).select("file_name", "doc_seq", "category", "text")


def written_file(spark, sf):
    """One file of one category from a written index: its bucket alone is read."""
    path = scratch_folder(spark)
    idx.build_index(corpus(spark, sf), path)
    return idx.read_index(spark, path, category="Interno", file_name="src7").select("file_name", "doc_seq", "text")


def _search_index(spark, sf, reissue):
    """A written search index, brought up to date after files came in again."""
    path = scratch_folder(spark)
    if reissue:  # before the index is there, as documents are moved for it
        fresh, files = _reissued(spark, sf)
        fresh = written(fresh)
    draft = Draft(spark, path)
    # Chunks are written without counts: these are made, moved and kept once, in the search tables.
    chunks = chunking.fixed_chunks(idx.together(corpus(spark, sf), SEARCH_BUCKETS))
    idx.build_index(chunks, path, buckets=SEARCH_BUCKETS, draft=draft, placed=True)
    postings.add_to_search(draft)
    draft.publish()
    if reissue:
        draft = Draft(spark, path)
        idx.replace_files(spark, path, chunking.fixed_chunks(fresh), files, SEARCH_BUCKETS, draft)
        dropped(fresh)
        postings.add_to_search(draft)
        draft.publish()
        drop_old(spark, path, keep=1)  # nobody reads the first generation
    return postings.read_search(spark, path)


def block_topk(spark, sf):
    """The flagship search over impact-ordered posting blocks."""
    return postings.search(questions(spark, sf), _search_index(spark, sf, False))


def refreshed_topk(spark, sf):
    """Search in an index that followed the replaced files bucket by bucket."""
    return postings.search(questions(spark, sf), _search_index(spark, sf, True))


def refreshed_terms(spark, sf):
    """Document frequencies from the signed deltas of two commits."""
    return _search_index(spark, sf, True).terms.select(F.coalesce("term", F.lit("")).alias("term"), "df")


def index_categories(spark, sf):
    return idx.index_categories(corpus(spark, sf))


def index_file(spark, sf):
    return corpus(spark, sf).where("file_name = 'src3'").select("file_name", "doc_seq", "text")


def _query_log(spark, sf):
    """Events as answered questions: an error is one without support."""
    source = F.concat(F.lit("k"), F.get_json_object("props", "$.k"))
    return table(spark, sf, "events").select(
        F.concat(F.col("event_type"), F.lit(" "), F.col("user_id").cast("string")).alias("pregunta"),
        F.array(source).alias("fuentes"), (F.col("event_type") != "error").alias("uso_rag"),
        F.round("value", 2).alias("duracion_s"), F.col("ts").cast("timestamp").alias("timestamp"))


def coverage_report(spark, sf):
    report = telemetry.coverage_report(_query_log(spark, sf))
    return report.withColumn("answered_rate", F.round("answered_rate", 6))


def uncovered_questions(spark, sf):
    return telemetry.uncovered_questions(_query_log(spark, sf))


def source_usage(spark, sf):
    return telemetry.source_usage(_query_log(spark, sf))


def feedback_report(spark, sf):
    votes = table(spark, sf, "events").where("event_type IN ('purchase', 'error')").select(
        history.feedback_label(F.col("event_type") == "purchase").alias("feedback"),
        F.col("ts").cast("timestamp").alias("timestamp"))
    return telemetry.feedback_report(votes).withColumn("positive_rate", F.round("positive_rate", 6))


def windowed_coverage(spark, sf):
    return coverage.windowed_coverage(_query_log(spark, sf)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _vote_log(spark, sf):
    """Purchases and clicks as votes on what the same user was shown before."""
    return table(spark, sf, "events").where("event_type IN ('purchase', 'click')").select(
        F.col("user_id").cast("string").alias("pregunta"), F.lit("shown").alias("respuesta"),
        history.feedback_label(F.col("event_type") == "purchase").alias("feedback"), F.col("ts").cast("timestamp").alias("timestamp"))


def _answer_log(spark, sf):
    """Views as answers with support, errors as answers without."""
    return table(spark, sf, "events").where("event_type IN ('view', 'error')").select(
        F.col("user_id").cast("string").alias("pregunta"), F.lit("shown").alias("respuesta"),
        (F.col("event_type") == "view").alias("uso_rag"), F.col("ts").cast("timestamp").alias("timestamp"))


def windowed_audit(spark, sf):
    """Answers and the votes of the next twelve hours in one table."""
    found = coverage.windowed_audit(_answer_log(spark, sf), _vote_log(spark, sf), "6 hours", "12 hours")
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def merged_durations(spark, sf):
    """Durations by month and kind of event from daily sketches, which are stored and read back."""
    log = _query_log(spark, sf)
    path = scratch_folder(spark)
    for covered in (True, False):  # the log comes in two parts
        telemetry.append_sketches(log.where(F.col("uso_rag") == covered), path)
    return telemetry.merged_durations(spark.read.parquet(path), F.trunc("day", "week").alias("week"))


def reconciled_files(spark, sf):
    """Files of a source and language: the folder has lost its Spanish files and toxic texts, the index lacks German ones.

    A file's digest is a sum over its texts, so that no file has to meet in one task."""
    docs = table(spark, sf, "documents")
    part = F.conv(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 8), 16, 10).cast("long")
    toxic = table(spark, sf, "labels").where("toxic = 1").select("doc_id").distinct()

    def files(rows):
        named = rows.select(F.concat("source", F.lit("/"), "lang").alias("file_name"), part.alias("part"))
        return named.groupBy("file_name").agg(F.concat(F.count("*"), F.lit("-"), F.sum("part")).alias("digest"))

    listing = files(docs.where("lang <> 'es'").join(toxic, "doc_id", "left_anti"))
    return reconcile.reconciled(listing, files(docs.where("lang <> 'de'")))


def json_lines(spark, sf):
    parsed = F.from_json("props", "k int")
    row = F.struct("event_id", "event_type", parsed["k"].alias("k"), F.array("event_type").alias("fuentes"))
    return table(spark, sf, "events").select("event_id", F.to_json(row).alias("line"))


def elapsed(spark, sf):
    both = table(spark, sf, "lineitem").join(
        table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select("l_orderkey", "l_linenumber", telemetry.elapsed_seconds(
        F.col("o_orderdate"), F.col("l_shipdate")).alias("duration_s"))


REGISTRY: dict[str, Query] = {f.__name__: f for f in (
    lexical_topk, clean_documents, row_sentences, page_text_units, markdown_sections, html_units, category_lookup,
    format_union, units_per_source, missing_sources, file_names, fixed_chunks, chunk_ids, recursive_chunks,
    role_prefixes, normalise_vectors, pair_scores, dense_topk, dense_topk_filtered, dense_threshold, cell_topk,
    ann_topk, cited_context, source_records, cited_files, answer_or_fallback, history_window, prompt_table,
    feedback_pairs, accent_fold, price_parse, quote_lines, quote_totals, quote_unmatched, nested_quotes,
    index_replace, written_index, written_file, block_topk, refreshed_topk, refreshed_terms, index_categories, index_file, coverage_report, uncovered_questions, source_usage,
    feedback_report, windowed_coverage, windowed_audit, merged_durations, reconciled_files, json_lines, elapsed)}
