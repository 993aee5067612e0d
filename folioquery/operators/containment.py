"""Which short texts contain which, without comparing every pair.

Texts are searched for a catalogue of patterns in one pass each, by an automaton: a trie of the patterns with links to the
longest suffix that goes on in it. Only real matches come out. A catalogue too large to be sent to every task is looked
up by equi-joins on the heads of patterns instead.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

_HEAD = 3
AUTOMATON_BYTES = 4 << 20   # patterns of more bytes are joined; an automaton takes some forty times as much memory


def matched_patterns(texts: DataFrame, patterns: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, sub): the distinct patterns that occur in ``texts.value``, per row; beyond AUTOMATON_BYTES of patterns,
    substrings that may be one. The empty pattern occurs in every text that is not NULL."""
    import ahocorasick
    if patterns.agg(F.coalesce(F.sum(F.octet_length("pattern")), F.lit(0))).first()[0] > AUTOMATON_BYTES:
        return found_substrings(texts, patterns, keep)
    words = {row.pattern for row in patterns.collect()}
    everywhere = [""] if "" in words else []
    automaton = ahocorasick.Automaton()
    for word in sorted(words - {"", None}):
        automaton.add_word(word, word)
    automaton.make_automaton()
    shared = texts.sparkSession.sparkContext.broadcast(automaton if len(automaton) else None)
    rows = texts.select(*keep, F.col("value").alias("_value"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            owner, subs = [], []
            for at, text in enumerate(batch.column("_value").to_pylist()):
                if text is not None:
                    hits = {word for _, word in found.iter(text)} if found else set()
                    hits.update(everywhere)
                    owner += [at] * len(hits)
                    subs += hits
            part = batch.take(pa.array(owner, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(subs, pa.string())], names=[*keep, "sub"])

    return rows.mapInArrow(search, T.StructType([*rows.schema.fields[:-1], T.StructField("sub", T.StringType())]))


def found_substrings(texts: DataFrame, patterns: DataFrame, keep: list[str]) -> DataFrame:
    """Stretches of ``texts.value`` that could be one of ``patterns.pattern``: (keep, sub).

    Every position of a text is looked up by its first characters. One row per pattern head says how long
    the patterns with that head are, and the stretch of each such length comes out. An equi-join of
    ``sub`` with the patterns then decides; no frequent head or pattern can multiply rows.
    """
    size = F.length("pattern")
    heads = (patterns.select(F.substring("pattern", 1, _HEAD).alias("head"), size.alias("size")).distinct()
             .groupBy("head").agg(F.collect_list("size").alias("sizes")))
    longest = patterns.select(F.max(size)).scalar()
    length = F.length("value")
    starts = F.when(length > 0, F.sequence(F.lit(1), length)).otherwise(F.array(F.lit(1)))
    tails = (texts.withColumn("at", F.explode_outer(starts))
             .select(*keep, "at", F.col("value").substr(F.col("at"), longest).alias("tail")))
    # Patterns shorter than a head are their own head; the empty one is looked up once per text.
    sizes = F.filter(F.array(*[F.lit(i) for i in range(_HEAD + 1)]), lambda n: F.when(
        n == 0, F.col("at") == 1).otherwise(n <= F.length("tail")))
    looked_up = (tails.withColumn("n", F.explode_outer(sizes))
                 .where(F.col("n").isNotNull())
                 .withColumn("head", F.col("tail").substr(F.lit(1), F.col("n"))))
    return (looked_up.join(heads, "head")
            .withColumn("size", F.explode_outer("sizes"))
            .where((F.col("size") <= F.length("tail")) & ((F.col("n") == _HEAD) | (F.col("size") == F.col("n"))))
            .select(*keep, F.col("tail").substr(F.lit(1), F.col("size")).alias("sub")))


def first_containing(requests: DataFrame, names: DataFrame) -> DataFrame:
    """(request, ord): smallest ``ord`` of the names that contain the request.

    requests: distinct ``request``; names: distinct ``name`` with ``ord``.
    """
    patterns = requests.select(F.col("request").alias("pattern"))
    subs = found_substrings(names.select(F.col("name").alias("value"), "ord"), patterns, ["ord"])
    first = subs.groupBy("sub").agg(F.min("ord").alias("ord"))
    return requests.join(first, F.col("request") == F.col("sub")).select("request", "ord")


def first_contained(requests: DataFrame, names: DataFrame) -> DataFrame:
    """(request, ord): smallest ``ord`` of the names that occur inside the request."""
    patterns = names.select(F.col("name").alias("pattern"))
    subs = matched_patterns(requests.select("request", F.col("request").alias("value")), patterns, ["request"])
    return (subs.distinct().join(names, F.col("sub") == F.col("name"))
            .groupBy("request").agg(F.min("ord").alias("ord")))
