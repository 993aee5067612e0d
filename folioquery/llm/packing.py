"""Packing of token sequences by multiway differencing (Karmarkar-Karp).

Documents are cut at full windows; what is left of each becomes an item. Items are gathered into groups of a fixed
number of windows, and each group is partitioned by differencing: every item starts as a partial partition with one
non-empty window, and the two partial partitions of largest imbalance are merged with their loads opposed, until one is
left. If a window then exceeds the capacity, the group is partitioned again into one more window.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from folioquery.llm.bpe import WordEndEncoder
from folioquery.llm.common import worker_state

WINDOW = 4096
END_ID = 2
GROUP_WINDOWS = 48   # windows partitioned together; bounds the state of a task
ITEM = 512           # most tokens of an item: smaller ones balance better, larger ones cut less
SLACK = 1 / 256      # share of a group's capacity left free, so that near-equal windows fit


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Indexes of ``sizes`` by window, with near-equal loads.

    A partial partition is its loads in descending order, less the smallest, and the members of each window. Heap
    order is the imbalance; ties go to the one made first, so the result depends on the input alone.
    """
    order = count()
    empty: list[list[int]] = [[] for _ in range(windows - 1)]
    heap = []
    for i, size in enumerate(sizes):
        loads = np.zeros(windows, dtype=np.int64)
        loads[0] = size
        heap.append((-size, next(order), loads, [[i], *empty]))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a, members_a = heapq.heappop(heap)
        _, _, b, members_b = heapq.heappop(heap)
        loads = a + b[::-1]
        rank = np.argsort(-loads, kind="stable")
        joined = [x + y if y else x for x, y in zip(members_a, reversed(members_b))]
        loads = loads[rank]
        loads -= loads[-1]
        heapq.heappush(heap, (-int(loads[0]), next(order), loads, [joined[k] for k in rank.tolist()]))
    return heap[0][3] if heap else [[] for _ in range(windows)]


def fitted(sizes: list[int], capacity: int) -> list[list[int]]:
    """``differencing`` with as few windows as hold the total; one more whenever a window exceeds the capacity."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = differencing(sizes, windows)
        if max(sum(sizes[i] for i in part) for part in parts) <= capacity:
            return [part for part in parts if part]
        windows += 1


class Packer:
    """Cuts documents and fills groups of windows; keeps no more than one group of pieces."""

    def __init__(self, first_sequence: int, capacity: int, group_windows: int, with_ids: bool):
        self.next_sequence, self.capacity, self.with_ids = first_sequence, capacity, with_ids
        self.most = int(capacity * group_windows * (1 - SLACK)) if group_windows > 1 else capacity
        self.items: list[tuple] = []
        self.gathered = 0
        self.rows: list[tuple] = []

    def piece(self, doc_id, ids: np.ndarray, start: int, length: int) -> tuple:
        data = ids[start:start + length]
        return (doc_id, start, length, zlib.crc32(data), len(ids), data if self.with_ids else None)

    def place(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, length, crc, total, ids in pieces:
            self.rows.append((doc_id, start, length, crc, total, self.next_sequence, offset, ids))
            offset += length
        self.next_sequence += 1

    def close_group(self) -> None:
        if self.items:
            for part in fitted([x[2] for x in self.items], self.capacity):
                self.place([self.items[i] for i in part])
        self.items, self.gathered = [], 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        start = 0
        while len(ids) - start >= self.capacity:
            self.place([self.piece(doc_id, ids, start, self.capacity)])
            start += self.capacity
        while start < len(ids):
            length = min(len(ids) - start, self.most - self.gathered, ITEM)
            self.items.append(self.piece(doc_id, ids, start, length))
            self.gathered += length
            start += length
            if self.gathered == self.most:
                self.close_group()


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID,
         group_windows: int = GROUP_WINDOWS, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place in a sequence of at most ``window`` tokens.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. A null or empty text is the end id alone. Rows
    that repeat a doc_id are packed as documents of their own. ``with_ids`` adds the ids of each piece.

    Each partition packs its own documents, so nothing is shuffled and a task holds one group of windows; a partition
    wastes less than one window at its end. Sequence ids start with the number of the partition.
    """
    schema = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
              + (", ids array<int>" if with_ids else ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_state(("word end bpe", path), lambda: WordEndEncoder(path))
        packer = Packer(TaskContext.get().partitionId() << 36, window, group_windows, with_ids)
        end = np.array([end_id], dtype="<u4").tobytes()

        def out() -> pa.RecordBatch:
            columns = list(zip(*packer.rows)) or [()] * 8
            packer.rows = []
            arrays = [pa.array(x, pa.int64()) for x in columns[:7]]
            if with_ids:
                arrays.append(pa.array([x.astype("<i4") for x in columns[7]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(
                arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][:len(arrays)])

        for batch in batches:
            texts = (x.as_py() or "" for x in batch.column("text"))
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), words.encode(texts)):
                packer.add(doc_id, np.frombuffer(ids + end, dtype="<u4"))
                if len(packer.rows) > 20_000:
                    yield out()
        packer.close_group()
        yield out()

    return docs.select("doc_id", "text").mapInArrow(run, schema)
