"""Helpers that the operators share: written cut points, document keys, per-worker state."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one named in spark.checkpoint.dir, which driver and executors share.

    Only a local session without that setting, as in tests, gets a folder of its own machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="folioquery-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/folioquery-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: later stages read it and survive lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Delete the files of a table of ``written`` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {name.rpartition("/")[0] for name in df.inputFiles() if "/folioquery-" in name}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spare_names(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own beside those of ``df``, whatever it calls its columns."""
    taken, prefix = {name.lower() for name in df.columns}, "_"
    while any(prefix + name in taken for name in names):
        prefix += "_"
    return [prefix + name for name in names]


def text_key() -> Column:
    """Tells rows of one doc_id apart; rows equal in doc_id and text count as one document."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def same_document(left: DataFrame, right: DataFrame) -> Column:
    """Null-safe equality of doc_id and text key."""
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_key"] == right["text_key"])


def worker_state(key: tuple, build: Callable):
    """An object built once per Python worker and used by all of its tasks, such as a vocabulary.

    Task code is shipped by value, so a global of this module would live for one task only. The first word of a key names
    its operator. A worker holds the objects of one operator at a time: when the next one of a pipeline asks for its own,
    those of the last one are let go.
    """
    holder = sys.modules.setdefault("_folioquery_worker_state", types.ModuleType("_folioquery_worker_state"))
    owner = key[0].split(" ")[0]
    if getattr(holder, "owner", None) != owner:
        holder.owner, holder.kept = owner, {}
    if key not in holder.kept:
        holder.kept[key] = build()
    return holder.kept[key]


def held_out(doc_id: Column) -> Column:
    """The third of the documents whose labels are never learnt from; a null id is held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (finaliser with two multiplications)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of byte words, remembered up to ``most`` words."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.most:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))
