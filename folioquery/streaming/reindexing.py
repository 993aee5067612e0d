"""Files that arrive in a landing folder are re-indexed as they come."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioquery.plans.pipeline import reindex

_FILES = "path string, modificationTime timestamp, length bigint, content binary"
_CHANGED = "name string, path string"
_KNOWN = "modified long, path string, digest string"


def _newest_change(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The newest upload of one file name, if it is newer than the one known and has other contents."""
    order = max((modified, path, digest) for frame in frames
                for modified, path, digest in zip(frame["modified"].tolist(), frame["path"], frame["digest"]))
    known = state.get if state.exists else (-1, "", None)
    if order[:2] <= (known[0], known[1]):
        return
    state.update(order)
    if order[2] != known[2]:
        yield pd.DataFrame({"name": [key[0]], "path": [order[1]]})


def changed_files(arrivals: DataFrame) -> DataFrame:
    """(name, path) of uploads that change their file, from a stream of (path, modificationTime, content).

    For each file name the stream remembers the time, place and digest of the newest upload it has seen, in this batch or
    any before. An upload that is older than that changes nothing, and neither does one with the same contents. Uploads of
    one time are ordered by their path.
    """
    uploads = arrivals.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path",
                              F.unix_micros("modificationTime").alias("modified"), F.sha2("content", 256).alias("digest"))
    return uploads.groupBy("name").applyInPandasWithState(
        _newest_change, _CHANGED, _KNOWN, "update", GroupStateTimeout.NoTimeout)


def watch_folder(spark: SparkSession, landing: str, index_path: str, checkpoint: str,
                 files_per_batch: int = 1000, trigger: dict | None = None, **options) -> StreamingQuery:
    """Re-index new files below ``landing`` (a folder or a glob), each micro-batch replacing its files.

    An upload lands under a path of its own, for example ``landing/<upload>/<file name>`` with the glob
    ``landing/*``; the file name decides what it replaces. A batch that runs again replaces the same rows,
    so a restart does not duplicate any. Of several uploads of one name the newest counts, whatever order they arrive in
    and whichever batch brings them; uploads without a change are left out (``changed_files``).
    """
    arrivals = (spark.readStream.format("binaryFile").schema(_FILES)
                .option("maxFilesPerTrigger", files_per_batch).load(landing))

    def apply(batch: DataFrame, _: int) -> None:
        # Paths only, and no more than files_per_batch of them.
        paths = [row.path for row in batch.select("path").collect()]
        if paths:
            reindex(batch.sparkSession, paths, index_path, **options)

    return (changed_files(arrivals).writeStream.outputMode("update").foreachBatch(apply)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())
