"""Suffix-array de-duplication of bytes.

Sorting every suffix of a corpus would move it hundreds of times, so only the suffixes that can decide are sorted. Each
window of ``least`` bytes has an anchor, the position in it whose 64 bytes hash lowest; equal windows have equal anchors
at equal offsets. The windows of one anchor form a stretch. Suffixes at anchors are sorted by their leading tokens: the
first 64 bytes and the bytes of the stretch, each as a fingerprint. A suffix equal to a neighbour in both tokens is a
copy as a whole; one that shares only the first is looked at more closely, first in blocks of 32 windows - by the bytes
that all windows of the block have in common, and by all bytes they cover - and, where a block stays open, window by
window. All three sorts work alike: sampled splitters cut the order into buckets (the place of a suffix is the last part
of the key, so equal suffixes also spread over buckets), each bucket is sorted by multikey quicksort, and neighbours are
compared, also those across two buckets.

Repeats can also be measured in words: a text is then the sequence of the hashes of its words, and all of the above holds
with words in place of bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioquery.llm.common import WordHashes, mix, removed, spare_names, text_key, worker_state, written

LEAST = 400
LEAST_WORDS = 50
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
BLOCK = 32
SEGMENT_BITS = 20    # texts are handled in segments of 2^20 windows
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
NO_ID = -2**63       # stands for a null doc_id


class Unit(NamedTuple):
    """What texts are measured in: the symbols of a text, and how many of them an anchor is hashed from."""
    name: str
    gram: int
    symbols: Callable[[str | None], np.ndarray]


def text_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def word_hashes(text: str | None) -> np.ndarray:
    return worker_state(("suffix words",), WordHashes).of(WORD.findall(text_bytes(text)))


BYTES = Unit("byte", 64, lambda text: np.frombuffer(text_bytes(text), dtype=np.uint8))
WORDS = Unit("word", 8, word_hashes)


# -- fingerprints ------------------------------------------------------------------------------------------------------
class Powers:
    """Powers of a base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, factor in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, np.uint64(factor))
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))


class Fingerprints:
    """Polynomial fingerprints of all substrings of one byte string."""

    def __init__(self, data: np.ndarray, powers: Powers):
        powers.reach(len(data) + 1)
        self.powers, self.sums = powers, np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers.up[:len(data)], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.powers.down[start])


def powers() -> tuple[Powers, Powers]:
    return worker_state(("suffix powers",), lambda: tuple(map(Powers, BASES)))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of each ``width`` neighbours, from running minima inside blocks of that width."""
    blocks = np.full(-(-len(x) // width) * width, x.max(), dtype=x.dtype)
    blocks[:len(x)] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def stretches(data: np.ndarray, least: int, gram: int = BYTES.gram) -> np.ndarray:
    """Rows (anchor, first window, last window, gram token, stretch token), as 64-bit integers."""
    gram = min(gram, least)
    windows, step = len(data) - least + 1, (1 << SEGMENT_BITS) - least  # a segment numbers its grams in SEGMENT_BITS bits
    out = [_segment(data, start, min(step, windows - start), least, gram) for start in range(0, windows, step)]
    return np.concatenate(out) if out else np.zeros((0, 5), dtype=np.int64)


def _segment(data: np.ndarray, start: int, windows: int, least: int, gram: int) -> np.ndarray:
    first, second = powers()
    part = data[start:start + windows + least - 1]
    prints = Fingerprints(part, first)
    at = np.arange(len(part) - gram + 1)
    grams = prints.of(at, at + gram)
    low = np.uint64((1 << SEGMENT_BITS) - 1)
    lowest = sliding_min((grams & ~low) | at.astype(np.uint64), least - gram + 1)
    anchor = (lowest & low).astype(np.int64)
    begin = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    end = np.append(begin[1:], windows) - 1
    anchor = anchor[begin]
    stretch = Fingerprints(part, second).of(begin, end + least)
    stretch = mix(stretch ^ (anchor - begin).astype(np.uint64) * np.uint64(BASES[0]) ^ (end - begin).astype(np.uint64))
    return np.column_stack([anchor + start, begin + start, end + start,
                            grams[anchor].view(np.int64), stretch.view(np.int64)])


# -- sorted buckets --------------------------------------------------------------------------------------------------
SMALL = 2048         # rows that multikey quicksort leaves to a plain sort


def multikey_order(columns: list[np.ndarray]) -> np.ndarray:
    """Order of rows by several keys: three-way quicksort that looks at one key at a time and goes on to the next key only
    within rows equal in the ones before."""
    order = np.arange(len(columns[0]))
    todo = [(0, len(order), 0)]
    while todo:
        start, end, depth = todo.pop()
        rows = order[start:end]
        if len(rows) <= SMALL or depth == len(columns):
            if depth < len(columns):
                order[start:end] = rows[np.lexsort([c[rows] for c in reversed(columns[depth:])])]
            continue
        key = columns[depth][rows]
        pivot = np.sort(key[[0, len(key) // 2, -1]])[1]
        less, equal = key < pivot, key == pivot
        order[start:end] = np.concatenate([rows[less], rows[equal], rows[~less & ~equal]])
        low, high = start + int(less.sum()), start + int(less.sum() + equal.sum())
        todo += [(start, low, depth), (low, high, depth + 1), (high, end, depth)]
    return order


def sorted_bucket(batches: Iterator[pa.RecordBatch], key: tuple[str, ...], block: int = 100_000) -> Iterator[pa.RecordBatch]:
    """The rows of one bucket in order. A bucket is a range between two splitters, of bounded size as places are part of
    the key."""
    held = [batch for batch in batches if batch.num_rows]
    if held:
        table = pa.Table.from_batches(held)
        order = multikey_order([table.column(x).to_numpy() for x in key])
        for at in range(0, len(order), block):
            yield from table.take(pa.array(order[at:at + block])).combine_chunks().to_batches()


def neighbours(batches: Iterator[pa.RecordBatch], tokens: tuple[str, ...], place: tuple[str, ...]) -> Iterator[tuple[dict, list, list, np.ndarray]]:
    """A bucket sorted by tokens and place, in blocks: columns; for each token, equality with the row before and after (all tokens up to it
    equal); and whether the row is the first or last of its range, where one of the two is unknown and given as False.

    Rows that repeat a place altogether stand for one. One row is held back, to be compared with the next block.
    """
    held, before, names = None, None, None
    for batch in chain(sorted_bucket(batches, (*tokens, *place)), [None]):
        if batch is not None:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            new = {x: batch.column(x).to_numpy(zero_copy_only=False) for x in names}
            block = {x: np.concatenate([held[x], new[x]]) for x in names} if held else new
            fresh = np.zeros(len(block[names[0]]), dtype=bool)
            fresh[0] = True
            for x in names:
                fresh[1:] |= block[x][1:] != block[x][:-1]
            block = {x: block[x][fresh] for x in names}
            size = len(fresh[fresh])
            held, use = {x: block[x][size - 1:] for x in names}, size - 1
            if not use:
                continue
        elif held is None:
            return
        else:
            block, use, size = held, 1, 1
        same_before, same_after = [], []
        prior, after = np.ones(use, dtype=bool), np.ones(use, dtype=bool)
        for t in tokens:
            previous = np.append(block[t][:1] if before is None else before[t], block[t][:use - 1])
            prior = prior & (block[t][:use] == previous)
            if before is None:
                prior[0] = False
            following = block[t][1:use + 1] if batch is not None else block[t]
            after = after & (block[t][:use] == following)
            if batch is None:
                after[-1] = False
            same_before.append(prior)
            same_after.append(after)
        edge = np.zeros(use, dtype=bool)
        edge[0] |= before is None
        edge[-1] |= batch is None
        yield {x: block[x][:use] for x in names}, same_before, same_after, edge
        before = {x: block[x][use - 1:use] for x in names}


def int_batch(schema: list[tuple[str, pa.DataType]], columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema)], [n for n, _ in schema])


PLACE = [("doc", pa.int64()), ("text_key", pa.int64())]
FOUND = [*PLACE, ("kind", pa.int32()), ("anchor", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())]
FOUND_SQL = "doc long, text_key long, kind int, anchor long, lo long, hi long"
SPAN, OPEN = 0, 1


def anchor_rows(docs: DataFrame, least: int, unit: Unit) -> DataFrame:
    schema = [*PLACE, *((x, pa.int64()) for x in ("anchor", "lo", "hi", "gram", "stretch"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, owner = [], []
            for k, text in enumerate(batch.column("text")):
                rows = stretches(unit.symbols(text.as_py()), least, unit.gram)
                parts.append(rows)
                owner.append(np.full(len(rows), k))
            if parts:
                rows, owner = np.concatenate(parts), np.concatenate(owner)
                yield int_batch(schema, [*(batch.column(x).to_numpy(zero_copy_only=False)[owner] for x, _ in PLACE), *rows.T])

    return docs.mapInArrow(run, "doc long, text_key long, anchor long, lo long, hi long, gram long, stretch long")


def sort_anchors(rows: DataFrame, least: int) -> DataFrame:
    """Stretches that occur elsewhere as spans, and those to be looked at more closely (with one of each kind of copy)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, before, after, edge in neighbours(batches, ("gram", "stretch"), ("doc", "text_key", "lo")):
            copy = before[1] | after[1]
            near = (before[0] & ~before[1]) | (after[0] & ~after[1]) | edge
            place = [c["doc"], c["text_key"]]
            for kind, rows, extra in ((SPAN, copy, least), (OPEN, near, 0)):
                yield int_batch(FOUND, [*(x[rows] for x in place), np.full(int(rows.sum()), kind),
                                        c["anchor"][rows], c["lo"][rows], c["hi"][rows] + extra])

    return rows.repartitionByRange("gram", "stretch", "doc", "text_key", "lo").mapInArrow(run, FOUND_SQL)


# -- open stretches ----------------------------------------------------------------------------------------------------
def with_text(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Open rows collected per document (bounded by the document itself), with its text."""
    grouped = rows.groupBy("doc", "text_key").agg(F.collect_list(F.struct("anchor", "lo", "hi")).alias("rows"))
    return docs.join(grouped, ["doc", "text_key"])


def open_rows(batch: pa.RecordBatch, unit: Unit) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    texts, lists = batch.column("text"), batch.column("rows")
    for k in range(batch.num_rows):
        data = unit.symbols(texts[k].as_py())
        values = lists[k].values
        yield k, data, np.column_stack([values.field(x).to_numpy() for x in ("anchor", "lo", "hi")])


TOKENS = [("first", pa.int64()), ("second", pa.int64()), *PLACE, ("anchor", pa.int64()), ("at", pa.int64())]
TOKENS_SQL = "first long, second long, doc long, text_key long, anchor long, at long"


def token_batch(batch: pa.RecordBatch, owner: list, firsts: list, seconds: list, anchors: list, ats: list) -> pa.RecordBatch:
    cat = lambda x: np.concatenate([*x, np.zeros(0, dtype=np.int64)]).astype(np.int64)
    own = cat(owner)
    return int_batch(TOKENS, [cat(firsts), cat(seconds), *(batch.column(x).to_numpy(zero_copy_only=False)[own] for x, _ in PLACE),
                              cat(anchors), cat(ats)])


def block_tokens(opened: DataFrame, least: int, unit: Unit) -> DataFrame:
    """Two suffixes for each block of windows of an open stretch; ``at`` = 2 x block + (1: bytes of all windows)."""
    size = min(BLOCK, least)  # all windows of a block overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, firsts, seconds, anchors, ats = [], [], [], [], []
            for k, data, rows in open_rows(batch, unit):
                prints = [Fingerprints(data, p) for p in powers()]
                anchor = rows[:, 0]
                low, high = (anchor - rows[:, 2]) // size, (anchor - rows[:, 1]) // size
                each = high - low + 1
                row = np.repeat(np.arange(len(rows)), each)
                block = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each) + low[row]
                p = anchor[row]
                near, far = p - block * size, p - block * size - (size - 1)  # last and first window of the block
                whole = (far >= 0) & (near + least <= len(data))
                for start, end, use, kind in ((near, far + least, np.ones(len(row), dtype=bool), 0), (far, near + least, whole, 1)):
                    s, e = start[use], end[use]
                    tag = mix((2 * block[use] + kind).astype(np.uint64) + np.uint64(9))
                    firsts.append((prints[0].of(s, e) ^ tag).view(np.int64))
                    seconds.append((prints[1].of(s, e) + tag).view(np.int64))
                    anchors.append(p[use])
                    ats.append(2 * block[use] + kind)
                    owner.append(np.full(len(s), k))
            yield token_batch(batch, owner, firsts, seconds, anchors, ats)

    return opened.mapInArrow(run, TOKENS_SQL)


def repeated_blocks(tokens: DataFrame) -> DataFrame:
    """(place, block, state, stands, token): state is 2 if all windows of the block occur elsewhere, 1 if some may;
    ``stands`` marks one of the blocks that are equal as a whole; ``token`` is that of the common bytes."""
    schema = [*PLACE, ("anchor", pa.int64()), ("block", pa.int64()), ("state", pa.int32()), ("stands", pa.bool_()), ("token", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, before, after, edge in neighbours(batches, ("first", "second"), ("doc", "text_key", "anchor", "at")):
            copy, whole = before[1] | after[1], c["at"] % 2 == 1
            rows = copy | (edge & ~whole)
            yield int_batch(schema, [c["doc"][rows], c["text_key"][rows], c["anchor"][rows], c["at"][rows] // 2,
                                     np.where(whole, 2, 1)[rows], (whole & ~before[1])[rows], np.where(whole, NO_ID, c["first"])[rows]])

    found = tokens.repartitionByRange("first", "second", "doc", "text_key", "anchor", "at").mapInArrow(
        run, "doc long, text_key long, anchor long, block long, state int, stands boolean, token long")
    return found.groupBy("doc", "text_key", "anchor", "block").agg(
        F.max("state").alias("state"), F.max("stands").alias("stands"), F.max("token").alias("token"))


def window_tokens(opened: DataFrame, least: int, unit: Unit) -> DataFrame:
    """One suffix for each window of an open block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, firsts, seconds, anchors, ats = [], [], [], [], []
            for k, data, rows in open_rows(batch, unit):
                each = rows[:, 2] - rows[:, 1] + 1
                row = np.repeat(np.arange(len(rows)), each)
                at = np.unique(np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each) + rows[row, 1])
                for tokens, p in zip((firsts, seconds), powers()):
                    tokens.append(Fingerprints(data, p).of(at, at + least).view(np.int64))
                anchors.append(np.zeros(len(at)))
                ats.append(at)
                owner.append(np.full(len(at), k))
            yield token_batch(batch, owner, firsts, seconds, anchors, ats)

    return opened.mapInArrow(run, TOKENS_SQL)


def repeated_windows(tokens: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Spans of windows that occur elsewhere, and the written table they are read from. The two ends of each range are
    compared with those of the others."""
    schema = [*PLACE, ("at", pa.int64()), ("edge", pa.bool_()), ("first", pa.int64()), ("second", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, before, after, edge in neighbours(batches, ("first", "second"), ("doc", "text_key", "at")):
            copy = before[1] | after[1]
            for rows, is_edge in ((copy, False), (edge, True)):
                yield int_batch(schema, [c["doc"][rows], c["text_key"][rows], c["at"][rows], np.full(int(rows.sum()), is_edge),
                                         c["first"][rows], c["second"][rows]])

    found = written(tokens.repartitionByRange("first", "second", "doc", "text_key", "at").mapInArrow(
        run, "doc long, text_key long, at long, edge boolean, first long, second long"))
    place = F.struct("doc", "text_key", "at")
    edges = found.where("edge")  # at most two rows per range
    across = edges.groupBy("first", "second").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x <> y")
    copies = found.where("not edge").select("doc", "text_key", "at").union(
        edges.join(across, ["first", "second"]).select("doc", "text_key", "at"))
    return copies.select("doc", "text_key", F.col("at").alias("lo"), (F.col("at") + least).alias("hi")), found


# -- operator ----------------------------------------------------------------------------------------------------------
def repeated_spans(docs: DataFrame, least: int = LEAST, unit: Unit = BYTES) -> DataFrame:
    """(doc, text_key, lo, hi): spans, in symbols, whose windows of ``least`` symbols start elsewhere too; spans may overlap.

    What is written on the way is deleted when the spans are written."""
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), text_key().alias("text_key"), "text")
    long_enough = keyed.where(F.octet_length("text") >= least)
    anchors = written(anchor_rows(long_enough, least, unit))
    found = written(sort_anchors(anchors, least))
    opened = found.where(F.col("kind") == OPEN).select("doc", "text_key", "anchor", "lo", "hi")
    block_rows = written(block_tokens(with_text(long_enough, opened), least, unit))
    blocks = written(repeated_blocks(block_rows))
    for table in (anchors, block_rows):
        removed(table)
    size = min(BLOCK, least)
    joined = opened.join(blocks, ["doc", "text_key", "anchor"])
    cut = joined.select("doc", "text_key", "anchor", "state", "stands", "token",
                        F.greatest("lo", F.col("anchor") - F.col("block") * size - (size - 1)).alias("lo"),
                        F.least("hi", F.col("anchor") - F.col("block") * size).alias("hi")).where("lo <= hi")
    # Open blocks are compared window by window with each other and with one of each kind of settled block like them.
    like_open = cut.where("state = 1").select("token").distinct()
    pending = cut.where("state = 1").unionByName(cut.where("state = 2 AND stands").join(like_open, "token", "left_semi"))
    window_rows = written(window_tokens(with_text(long_enough, pending), least, unit))
    windows, ends = repeated_windows(window_rows, least)
    spans = written(found.where(F.col("kind") == SPAN).select("doc", "text_key", "lo", "hi")
                    .union(cut.where("state = 2").select("doc", "text_key", "lo", (F.col("hi") + least).alias("hi")))
                    .union(windows))
    for table in (found, blocks, window_rows, ends):
        removed(table)
    return spans


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of (lo, hi) rows."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > reach[:-1])
    first = np.flatnonzero(new)
    return np.column_stack([spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]])


def byte_spans(data: bytes, spans: np.ndarray) -> np.ndarray:
    """Spans of words as spans of bytes: up to the next word, or the end of the text."""
    starts = np.array([m.start() for m in WORD.finditer(data)] + [len(data)])
    return starts[spans]


def without_repeats(docs: DataFrame, least: int = LEAST, texts: bool = False, words: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per input row.

    ``docs`` needs ``doc_id`` and ``text``. Every byte covered by a string of ``least`` bytes that also starts
    elsewhere is removed, first copies too. With ``words`` repeats are measured in words instead (runs of other signs than
    white space, which may differ between two copies): every word covered by a string of that many words that also starts
    elsewhere goes, with the white space behind it; a text without white space is one word. Null and short texts are kept.
    Rows equal in doc_id and text are one document: they are no copies of each other and get the same result. With
    ``texts`` all columns of ``docs`` are returned instead, with the remaining text (bytes of a character that was cut are
    left out) and, if there is such a column, its n_chars.
    """
    doc, key, spans_found = spare_names(docs, "doc", "text_key", "spans")
    found = repeated_spans(docs, least) if words is None else repeated_spans(docs, words, WORDS)
    spans = (found.groupBy("doc", "text_key").agg(F.collect_list(F.struct("lo", "hi")).alias(spans_found))
             .select(F.col("doc").alias(doc), F.col("text_key").alias(key), spans_found))
    base = docs if texts else docs.select("doc_id", "text")
    names = base.columns  # task code must not hold a DataFrame
    keyed = base.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), key: text_key()})
    joined = keyed.join(spans, [doc, key], "left").select(*base.columns, spans_found)

    def kept(batch: pa.RecordBatch) -> Iterator[tuple[bytes, int, int, int]]:
        for text, found in zip(batch.column("text"), batch.column(spans_found)):
            data = text_bytes(text.as_py())
            if not found.is_valid:
                yield data, len(data), 0, 0
                continue
            runs = merged(np.column_stack([found.values.field(x).to_numpy() for x in ("lo", "hi")]))
            runs = (runs if words is None else byte_spans(data, runs)).tolist()
            ends = [0, *(hi for _, hi in runs)]
            rest = b"".join(data[a:b] for a, b in zip(ends, [*(lo for lo, _ in runs), len(data)]))
            yield rest, len(data), len(data) - len(rest), len(runs)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, gone, runs, hashlib.sha256(rest).hexdigest()) for rest, n, gone, runs in kept(batch)]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *(pa.array(x, pa.int64()) for x in columns[:3]), pa.array(columns[3], pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [old.as_py() if not gone else rest.decode("utf-8", "ignore")
                   for old, (rest, _, gone, _) in zip(batch.column("text"), kept(batch))]
            columns = [pa.array(new, pa.string()) if x == "text" else batch.column(x) for x in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    if not texts:
        return joined.mapInArrow(digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    out = joined.mapInArrow(rewritten, base.schema)
    return out.withColumn("n_chars", F.length("text").cast(base.schema["n_chars"].dataType)) if "n_chars" in base.columns else out
