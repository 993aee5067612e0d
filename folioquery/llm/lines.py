"""Line de-duplication by a suffix array over line ids.

Lines get ids that keep an order, and a document is the sequence of its line ids. Prefix doubling ranks the suffixes of
all sequences by their first 1, 2, 4 ... lines up to the shortest run looked for; suffixes whose prefix occurs once are
settled and leave. At that depth the suffixes of one rank are a longest-common-prefix interval of at least
``least`` lines. The union of the intervals' later members is every later copy of a maximal repeated run, so deeper
ranks would not change what is deleted. With a least number of words, ranks of every smaller depth count as well, as far
as their lines hold that many words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from folioquery.llm.common import spare_names, text_key, written

LEAST = 3            # lines of the shortest repeated run
WORDS = 50           # words that make a run of fewer lines long enough where runs are measured by content
DOC = ["doc_id", "text_key"]


def line_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, pos, words, k1, k2): words between blanks, and as keys a 128-bit fingerprint of the line."""
    lines = docs.where(F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select(*DOC, "pos", F.regexp_count("line", F.lit("[^ \t\n\r]+")).alias("words"), F.xxhash64("line").alias("k1"), F.xxhash64("line", F.lit(1)).alias("k2"))


def ranked(suffixes: DataFrame) -> DataFrame:
    """Replace the keys (k1, k2) of suffixes by one order-preserving rank; suffixes with a key of their own leave.

    Keys are counted before they are sorted, so a frequent key is one row of a range; the join back leaves large
    partitions of suffixes to be split.
    """
    place = F.struct(*DOC, "pos")
    keys = suffixes.groupBy("k1", "k2").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x <> y").select("k1", "k2")
    order = written(keys.repartitionByRange("k1", "k2").sortWithinPartitions("k1", "k2")
                    .withColumn("rank", F.monotonically_increasing_id()))
    return suffixes.join(order, ["k1", "k2"]).drop("k1", "k2")


def later_copies(suffixes: DataFrame, depth: int) -> DataFrame:
    """(doc_id, text_key, pos, size): suffixes of a rank behind the first one, by document and position."""
    first = suffixes.groupBy("rank").agg(F.min(F.struct(*DOC, "pos")).alias("first"))
    return suffixes.join(first, "rank").where(F.struct(*DOC, "pos") > F.col("first")).select(*DOC, "pos", F.lit(depth).alias("size"))


def repeated_runs(docs: DataFrame, least: int = LEAST, words: int | None = None) -> DataFrame:
    """(doc_id, text_key, pos, size): starts and lines of runs that occur earlier, by document and position.

    Runs have ``least`` lines or, with ``words``, fewer lines that hold so many words.
    """
    ids = line_ids(docs)
    suffixes, depth, found = ranked(written(ids.drop("words") if words is None else ids.withColumn("held", F.col("words")))), 1, []
    while depth < least:
        if words is not None:
            suffixes = written(suffixes)
            found.append(later_copies(suffixes.where(F.col("held") >= words), depth))
        step = min(depth, least - depth) if words is None else 1
        ahead = W.partitionBy(*DOC).orderBy("pos").rangeBetween(step, step)
        pairs = suffixes.withColumn("k2", F.first("rank").over(ahead))
        if words is not None:
            pairs = pairs.withColumn("held", F.col("words") + F.first("held").over(ahead))
        suffixes, depth = ranked(written(pairs.where("k2 IS NOT NULL").withColumnRenamed("rank", "k1"))), depth + step
    out = later_copies(written(suffixes), depth)
    for runs in found:
        out = out.union(runs)
    return out


def without_repeated_lines(docs: DataFrame, least: int = LEAST, texts: bool = False, words: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_removed, n_runs, kept_sha256: one row per input row.

    ``docs`` needs ``doc_id`` and ``text``. Lines are separated by line feeds and compared as they are. A run of
    ``least`` or more lines that occurs earlier - in a document of smaller doc_id, or above in the same one - is
    deleted, with ``words`` also a run of fewer lines that holds so many words or more (split at blanks, tabs and line
    ends); runs are judged on the input and may overlap, and runs that touch count once. A null text has no lines; an
    empty one has one empty line. A null doc_id comes first. Rows equal in doc_id and text are one document and share its result. With ``texts`` all
    columns of ``docs`` are returned instead, with the remaining text and, if there is such a column, its n_chars.
    """
    doc, its_key, key, runs_found = spare_names(docs, "doc", "text_key", "key", "starts")
    starts = (repeated_runs(docs, least, words).groupBy(*DOC).agg(F.sort_array(F.collect_set(F.struct("pos", "size"))).alias(runs_found))
              .withColumnsRenamed({"doc_id": doc, "text_key": its_key}))
    base = docs if texts else docs.select("doc_id", "text")
    names = base.columns  # task code must not hold a DataFrame
    joined = (base.withColumn(key, text_key())
              .join(starts, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(its_key)), "left")
              .select(*base.columns, runs_found))

    def cleaned(batch: pa.RecordBatch) -> Iterator[tuple[str | None, int, int, int]]:
        for text, starts_ in zip(batch.column("text").to_pylist(), batch.column(runs_found).to_pylist()):
            lines = text.split("\n") if text is not None else []
            gone, runs, reach = set(), 0, -1
            for run in starts_ or ():
                start, end = run["pos"], run["pos"] + run["size"]
                runs += start > reach
                reach = max(reach, end)
                gone.update(range(start, end))
            rest = text if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone)
            yield rest, len(lines), len(gone), runs

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, gone, runs, hashlib.sha256((rest or "").encode()).hexdigest()) for rest, n, gone, runs in cleaned(batch)]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *(pa.array(x, pa.int64()) for x in columns[:3]), pa.array(columns[3], pa.string())],
                ["doc_id", "n_lines", "n_removed", "n_runs", "kept_sha256"])

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [rest for rest, *_ in cleaned(batch)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(new, pa.string()) if x == "text" else batch.column(x) for x in names], names)

    if not texts:
        return joined.mapInArrow(digests, "doc_id long, n_lines long, n_removed long, n_runs long, kept_sha256 string")
    out = joined.mapInArrow(rewritten, base.schema)
    return out.withColumn("n_chars", F.length("text").cast(base.schema["n_chars"].dataType)) if "n_chars" in base.columns else out
