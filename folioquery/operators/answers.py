"""From hits to cited context, source records, prompts and fallback answers.

hits: (question_id, rank, score, file_name, category, page, slide, section, row_no, text), at most k rows
per question, so the lists collected here are bounded by k.
"""

from pyspark.sql import Column, DataFrame, functions as F

from folioquery import constants as K
from folioquery.functions.citations import fragment, location_label, source_record

DEFAULT_FALLBACK = "No encontré esta información en los documentos disponibles."

# Placeholders: {context} and {fallback}.
DEFAULT_SYSTEM_PROMPT = """\
Responde solo con el contexto y cita sus fuentes. Si no basta, responde: "{fallback}"

CONTEXTO:
{context}"""


def _part(hits: DataFrame) -> Column:
    label = location_label(hits["page"], hits["slide"], hits["section"], hits["row_no"])
    return fragment(hits["rank"], hits["file_name"], label, hits["category"], hits["text"])


def cited_context(hits: DataFrame) -> DataFrame:
    """(question_id, context): numbered fragments with their sources, best first."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", _part(hits).alias("part"))))
    return hits.groupBy("question_id").agg(F.array_join(ordered["part"], K.FRAGMENT_SEPARATOR).alias("context"))


def source_records(hits: DataFrame) -> DataFrame:
    """(question_id, rank, source): one display record per hit."""
    return hits.select("question_id", "rank", _source(hits).alias("source"))


def _source(hits: DataFrame) -> Column:
    return source_record(F.struct(*[hits[c] for c in hits.columns]))


def source_lists(hits: DataFrame) -> DataFrame:
    """(question_id, sources): the records of a question, best first."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", "source")))
    return source_records(hits).groupBy("question_id").agg(ordered["source"].alias("sources"))


def cited_files(hits: DataFrame) -> DataFrame:
    """(question_id, files): distinct cited files in name order."""
    return hits.groupBy("question_id").agg(F.array_sort(F.collect_set("file_name")).alias("files"))


def _filled(template: str, context: Column, fallback: str) -> Column:
    pieces, rest = [], template.replace("{fallback}", fallback)
    while "{context}" in rest:
        before, rest = rest.split("{context}", 1)
        pieces += [F.lit(before), context]
    return F.concat(*pieces, F.lit(rest))


def messages(system: Column, history: Column, question: Column) -> Column:
    """Prompt as (role, content) structs; every history role but the user's speaks as the assistant."""
    def message(role: Column | str, content: Column) -> Column:
        return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))

    past = F.transform(history, lambda m: message(
        F.when(m["role"] == "user", "user").otherwise("assistant"), m["text"]))
    return F.concat(F.array(message("system", system)), past, F.array(message("user", question)))


def answers(questions: DataFrame, hits: DataFrame, history: DataFrame | None = None,
            system_prompt: str = DEFAULT_SYSTEM_PROMPT, fallback: str = DEFAULT_FALLBACK) -> DataFrame:
    """One row per question, with a prompt for the chat model or the honest fallback.

    history: (question_id, history array<struct<role, text>>). A question without hits gets the fallback
    as its answer, no sources and no prompt, so a later model call can skip it.
    """
    ordered = F.sort_array(F.collect_list(F.struct("rank", _part(hits).alias("part"), _source(hits).alias("source"))))
    found = hits.groupBy("question_id").agg(ordered.alias("cited")).select(
        "question_id", F.array_join("cited.part", K.FRAGMENT_SEPARATOR).alias("context"),
        F.col("cited.source").alias("sources"))
    rows = questions.join(found, "question_id", "left")
    if history is not None:
        rows = rows.join(history.select("question_id", "history"), "question_id", "left")
        past = F.coalesce("history", F.array().cast("array<struct<role:string,text:string>>"))
    else:
        past = F.array().cast("array<struct<role:string,text:string>>")
    used = F.col("context").isNotNull()
    prompt = messages(_filled(system_prompt, F.col("context"), fallback), past, F.col("question"))
    no_sources = F.array().cast(dict(found.dtypes)["sources"])
    return rows.select(
        *questions.columns, "context", F.when(used, prompt).alias("prompt"),
        F.coalesce("sources", no_sources).alias("sources"), used.alias("used_retrieval"),
        F.when(~used, F.lit(fallback)).alias("answer"))
