"""Token counts as rollups kept up to date by signed changes.

A batch of changes is turned into one delta per (source, lang, version): an insert adds a document and its tokens, a
delete takes them away, a revised count takes the old ones away and adds the new ones. Deltas are additive, so the
totals are the sum of all committed batches. A batch is committed by renaming its finished folder to its id; a second
commit under the same id changes nothing, also after a crash half-way.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioquery.llm.bpe import BytePairEncoder, WordEndEncoder
from folioquery.llm.common import worker_state

KEYS = ["source", "lang", "version"]


def counted(docs: DataFrame, versions: dict[str, Column]) -> DataFrame:
    """(doc_id, source, lang, version, tokens): a row per document and tokenizer version; null counts are 0."""
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("version"), F.coalesce(c.cast("long"), F.lit(0).cast("long")).alias("tokens"))
                               for v, c in versions.items())))
    return docs.select("doc_id", "source", "lang", each.alias("_n")).select("doc_id", "source", "lang", "_n.version", "_n.tokens")


def tokenized(docs: DataFrame, encoders: dict[str, tuple[type[BytePairEncoder], str]]) -> DataFrame:
    """(doc_id, source, lang, version, tokens): tokens of each whole text under each tokenizer version, given as its
    encoder and vocabulary file. A null or empty text has none. One pass over the texts, no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for version, (kind, path) in encoders.items():
                encoder = worker_state(("rollup", kind.__name__, path), lambda: kind(path))  # noqa: B023
                tokens = np.fromiter((len(ids) // 4 for ids in encoder.encode(texts)), dtype=np.int64, count=len(texts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()), batch.column("source"), batch.column("lang"),
                     pa.array([version] * len(texts), pa.string()), pa.array(tokens)], ["doc_id", *KEYS, "tokens"])

    return docs.select("doc_id", F.col("source").cast("string"), F.col("lang").cast("string"), "text").mapInArrow(
        run, "doc_id long, source string, lang string, version string, tokens long")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("documents"), F.col("tokens").cast("long").alias("tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    return inserts(counts).withColumns({"documents": -F.col("documents"), "tokens": -F.col("tokens")})


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Replace ``old`` counts by ``new`` ones; source, language and version may change too."""
    return deletes(old).unionByName(inserts(new))


class TokenRollup:
    """Totals in a folder that driver and executors share. Null keys are a group of their own."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.jvm = spark.sparkContext._jvm

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch; False if one of this id is there already. Changes are summed before and after one shuffle."""
        if not batch_id or "/" in batch_id or batch_id.startswith(("_", ".")):
            raise ValueError("a batch id is a plain file name")
        files, target = self._files(), self._path(f"batch={batch_id}")
        if files.exists(target):
            return False
        delta = changes.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        pending = self._path(f"_pending/{uuid.uuid4().hex}")
        delta.write.parquet(pending.toString())
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(pending, target, options)  # fails where the target exists
        except Exception:
            if files.exists(target):
                files.delete(pending, True)
                return False
            raise
        return True

    def batches(self) -> list[str]:
        files = self._files()
        if not files.exists(self._path("")):
            return []
        names = [s.getPath().getName() for s in files.listStatus(self._path(""))]
        return sorted(n.removeprefix("batch=") for n in names if n.startswith("batch="))

    def totals(self) -> DataFrame:
        """source, lang, version, documents, tokens over all committed batches; groups that have come to nothing go.

        Batches may be committed in any order: a delete whose insert is still to come shows as a negative count."""
        schema = "source string, lang string, version string, documents long, tokens long"
        if not (names := self.batches()):
            return self.spark.createDataFrame([], schema)
        deltas = self.spark.read.schema(schema).parquet(*(f"{self.folder}/batch={n}" for n in names))
        sums = deltas.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.where("documents <> 0 OR tokens <> 0")
