"""MinHash near-duplicates with sequential Bayesian verification.

Texts with equal shingle sets form a class. Classes that share a band of their signature are candidates. A candidate
pair is compared signature batch by signature batch; it is dropped as soon as the posterior chance that its similarity
reaches the threshold falls below the chosen miss probability, and survivors are verified on their full sets.

Buckets are not expanded into pairs. First every member is held against two hubs of its bucket. Where the links found
leave a bucket of four or more in several components, the members outside its largest component are compared, in blocks
inside the tasks, with the members of other components; only verified links leave a task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from folioquery.llm.common import WordHashes, mix, spare_names, text_key, worker_state, written
from folioquery.llm.components import components

BANDS, BAND_ROWS = 32, 4     # a pair at similarity 0.85 shares no band with a chance of 4e-11, at 0.8 of 5e-8
SIGNATURE = BANDS * BAND_ROWS
BATCH = 32                   # signature rows compared between two looks at the posterior
MISS = 1e-6                  # posterior chance below which a pair is dropped
BLOCK = 1024                 # bucket members compared at once in a task
ODD, EVEN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


# -- sets and signatures -----------------------------------------------------------------------------------------------
def shingle_set(text: str | None, width: int, words: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct word shingles; ASCII capitals are lowered and ASCII white space separates."""
    w = words.of((text or "").encode("utf-8", "replace").lower().split())
    if not len(w):
        return w
    span = min(width, len(w))
    h = np.full(len(w) - span + 1, np.uint64(span))
    for k in range(span):
        h = mix(h * ODD + w[k:len(w) - span + 1 + k])
    return np.unique(h)


def coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    a = (rng.integers(1, 2**63, SIGNATURE, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
    return a, rng.integers(0, 2**63, SIGNATURE, dtype=np.uint64)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lowest = np.full(SIGNATURE, np.uint32(2**32 - 1))
    for start in range(0, len(shingles), 1024):
        values = ((shingles[start:start + 1024, None] * a + b) >> np.uint64(32)).astype(np.uint32)
        lowest = np.minimum(lowest, values.min(axis=0))
    return lowest


def band_hashes(signatures: np.ndarray) -> np.ndarray:
    """(rows x BANDS) bucket numbers of (rows x SIGNATURE) signatures."""
    parts = signatures.reshape(len(signatures), BANDS, BAND_ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2])
    for k in range(BAND_ROWS):
        h = mix(h * ODD + parts[:, :, k] * EVEN)
    return h.view(np.int64) if h.flags.c_contiguous else np.ascontiguousarray(h).view(np.int64)


# -- verification ------------------------------------------------------------------------------------------------------
@lru_cache
def least_matches(percent: int) -> tuple[int, ...]:
    """For 0, BATCH, 2 BATCH ... rows compared: the fewest matches with which a pair is kept.

    With a uniform prior, P(similarity >= t | m of n match) is a binomial tail: P(Binomial(n + 1, t) <= m).
    """
    t, least = percent / 100, [0]
    for n in range(BATCH, SIGNATURE + 1, BATCH):
        tail, m = 0.0, 0
        while (tail := tail + math.comb(n + 1, m) * t**m * (1 - t)**(n + 1 - m)) < MISS:
            m += 1
        least.append(m)
    return tuple(least)


def surviving(one: np.ndarray, others: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``others`` that stay possible partners of ``one``, and how many signature rows agree."""
    rows, agree = np.arange(len(others)), np.zeros(len(others), dtype=np.int64)
    for k, least in enumerate(least_matches(percent)[1:]):
        part = slice(k * BATCH, (k + 1) * BATCH)
        agree = agree + (others[rows, part] == one[part]).sum(axis=1)
        rows, agree = rows[agree >= least], agree[agree >= least]
    return rows, agree


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact test on full sets, in integers."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
    return 100 * common >= percent * (len(a) + len(b) - common)


def unpack(column, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=kind) for x in column]


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    def side(name: str) -> DataFrame:
        return sets.select(F.col("node").alias(name), F.col("signature").alias(f"sig_{name}"), F.col("shingles").alias(f"set_{name}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(x).to_pylist() for x in ("sig_a", "sig_b", "set_a", "set_b")]
            keep = []
            for sig_a, sig_b, set_a, set_b in zip(*columns):
                rows, _ = surviving(np.frombuffer(sig_a, "<u4"), np.frombuffer(sig_b, "<u4")[None, :], percent)
                keep.append(bool(len(rows)) and similar(np.frombuffer(set_a, "<u8"), np.frombuffer(set_b, "<u8"), percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a binary, b binary")


def across_components(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components inside a bucket that hubs have not shown.

    ``members`` has bucket, node and root, for buckets with several components. Rows are dealt to blocks of a bucket,
    so that no task gets a whole frequent bucket.
    """
    sized = members.groupBy("bucket", "root").count()
    largest = sized.groupBy("bucket").agg(F.max(F.struct("count", "root")).alias("top"), F.sum("count").alias("all"))
    marked = (members.join(largest, "bucket").withColumn("major", F.col("root") == F.col("top.root"))
              .withColumn("blocks", F.ceil(F.col("all") / BLOCK).cast("int"))
              .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
              .join(sets.select("node", "signature", "shingles"), "node"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    columns = ["bucket", "node", "root", "major", "signature", "shingles"]
    minor = marked.where(~F.col("major")).select(*columns, F.lit(True).alias("asks"), F.col("own").alias("ub"), F.explode(every).alias("vb"))
    others = marked.select(*columns, F.lit(False).alias("asks"), F.explode(every).alias("ub"), F.col("own").alias("vb"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        asking, asked = rows[rows["asks"]], rows[~rows["asks"]]
        found = []
        if len(asking) and len(asked):
            bucket = rows["bucket"].iloc[0]
            sig_u, sig_v = (np.stack(unpack(x["signature"], "<u4")) for x in (asking, asked))
            set_u, set_v = (unpack(x["shingles"], "<u8") for x in (asking, asked))
            bands_u, bands_v = band_hashes(sig_u), band_hashes(sig_v)
            node_v, root_v, major_v = (asked[x].to_numpy() for x in ("node", "root", "major"))
            size_v = np.array([len(x) for x in set_v])
            for i, (node, root) in enumerate(zip(asking["node"], asking["root"])):
                here = int(np.flatnonzero(bands_u[i] == bucket)[0])
                possible = (root_v != root) & (major_v | (node_v > node))
                possible &= ~(bands_v[:, :here] == bands_u[i, :here]).any(axis=1)  # compared in an earlier band
                size = len(set_u[i])
                possible &= 100 * np.minimum(size, size_v) >= percent * np.maximum(size, size_v)
                at = np.flatnonzero(possible)
                rows_left, agree = surviving(sig_u[i], sig_v[at], percent)
                linked = set()
                for k in at[rows_left[np.argsort(-agree, kind="stable")]].tolist():
                    if root_v[k] not in linked and similar(set_u[i], set_v[k], percent):
                        linked.add(root_v[k])
                        found.append((node, node_v[k]))
        return pd.DataFrame(found, columns=["a", "b"])

    return minor.union(others).groupBy("bucket", "ub", "vb").applyInPandas(compare, "a binary, b binary")


# -- operator ----------------------------------------------------------------------------------------------------------
def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Null, empty and blank texts have an empty set,
    are linked with nothing and are kept. Texts with fewer words than ``width`` have one shingle, the whole sequence.
    component_id is the smallest doc_id that links lead to. Rows that repeat a doc_id share its fate if their texts
    are linked. A row without doc_id gets the component of its text; it is kept only if no row with an id is in it.
    """
    return grouped(docs, width, percent).select(
        "doc_id", "n_shingles", "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns: of each group of near-duplicates the document of smallest doc_id stays.

    Rows without doc_id come last in a group; of rows equal in doc_id and text one stays, also if the text is empty.
    """
    doc, its_key, key = spare_names(docs, "doc", "text_key", "key")
    stays = grouped(docs, width, percent).where("stays").select(F.col("doc_id").alias(doc), F.col("text_key").alias(its_key)).distinct()
    keyed = docs.withColumn(key, text_key())
    return (keyed.join(stays, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(its_key)), "left_semi")
            .dropDuplicates(["doc_id", key]).select(*docs.columns))


def grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Each input row with its set size, component and whether its document is the one that stays."""
    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (a, b) = worker_state(("shingle words",), WordHashes), coefficients()
        for batch in batches:
            sizes, nodes, signatures = [], [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), width, words)
                sizes.append(len(s))
                nodes.append(hashlib.md5(s.tobytes()).digest())
                signatures.append(signature(s, a, b).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("text_key"), pa.array(sizes, pa.int64()),
                 pa.array(nodes, pa.binary()), pa.array(signatures, pa.binary())],
                ["doc_id", "text_key", "n_shingles", "node", "signature"])

    def buckets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                hashes = band_hashes(np.stack(unpack(batch.column("signature").to_pylist(), "<u4")))
                nodes = batch.column("node").take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS)))
                yield pa.RecordBatch.from_arrays([pa.array(hashes.ravel()), nodes], ["bucket", "node"])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (a, b) = worker_state(("shingle words",), WordHashes), coefficients()
        for batch in batches:
            rows = []
            for text, node in zip(batch.column("text"), batch.column("node").to_pylist()):
                s = shingle_set(text.as_py(), width, words)
                if hashlib.md5(s.tobytes()).digest() == node:
                    rows.append((node, signature(s, a, b).astype("<u4").tobytes(), s.astype("<u8").tobytes()))
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in columns], ["node", "signature", "shingles"])

    facts = written(docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(
        prepare, "doc_id long, text_key long, n_shingles long, node binary, signature binary"))
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_key")
    classes = facts.where("n_shingles > 0").groupBy("node").agg(
        F.min("doc_id").alias("first_doc"), F.min(place).alias("first_place"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    # Sets of five or fewer shingles reach 0.85 only with an equal set, which is the same class.
    fewest = next(n for n in range(1, 101) if 100 * n >= percent * (n + 1))
    buckets = (classes.where(F.col("n_shingles") >= fewest).select("node", "signature")
               .mapInArrow(buckets_of, "bucket long, node binary"))
    buckets = written(buckets)
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).where("n > 1")
    members = written(buckets.join(shared, "bucket"))
    wanted = members.select("node").distinct().join(classes.select("node", "first_doc"), "node")
    sets = written(docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("first_doc"))).select("text", "node")
                   .mapInArrow(sets_of, "node binary, signature binary, shingles binary").dropDuplicates(["node"]))
    stars = members.select("node", F.explode(F.array("low", "high")).alias("hub")).where("node <> hub")
    pairs = stars.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    links = written(verified(pairs, sets, percent))
    roots = written(components(links))
    rooted = (members.where("n > 3").select("bucket", "node").join(roots, "node", "left")
              .withColumn("root", F.coalesce("root", "node")))
    split = rooted.groupBy("bucket").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("bucket")
    more = written(across_components(rooted.join(split, "bucket"), sets, percent))
    if not more.isEmpty():
        roots = components(links.union(more))
    of_class = classes.select("node", "first_doc", "first_place")
    lowest = of_class.join(roots, "node").groupBy("root").agg(F.min("first_doc").alias("low_doc"), F.min("first_place").alias("low_place"))
    component = (of_class.join(roots, "node", "left").join(lowest, "root", "left").select(
        "node", F.coalesce("low_doc", "first_doc").alias("low_doc"), F.coalesce("low_place", "first_place").alias("low_place")))
    some = F.col("n_shingles") > 0
    return (facts.select("doc_id", "text_key", "n_shingles", "node").join(component, "node", "left")
            .select("doc_id", "text_key", "n_shingles", F.when(some, F.col("low_doc")).otherwise(F.col("doc_id")).alias("component_id"),
                    (~some | (place == F.col("low_place"))).alias("stays")))
