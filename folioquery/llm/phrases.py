"""Phrase collocations by vertically partitioned suffix trees.

The text is written once as numbers: 64-bit hashes of words, zero between pieces. Every position starts a suffix, cut
after four words. Suffixes are partitioned by their word prefixes: prefixes share buckets by hash, buckets whose suffixes
fit the memory budget together form a group, and a bucket over the budget is split by a prefix one word longer. A group
is the unit of work: one task sorts its suffixes, which lays the leaves of its truncated suffix tree in order, and reads
the count of each node from the leaves below it. Groups know nothing of each other; only nodes shorter than the prefix
that split a bucket are spread over several groups and added up at the end.

Equal suffixes of one block of text are counted before they move, so neither a frequent word (split by longer prefixes)
nor a frequent phrase (one row with a count) makes a group large.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioquery.llm.common import mix, worker_state, written

DEPTH = 4                # words of the longest phrase
LEAST = 30               # occurrences of a candidate
COVER = 80               # per cent of a phrase's occurrences that a longer one must have to replace it
FACTOR = 2_000_000       # scale of a score
BEST = 2_000             # phrases reported per language
MEMORY = 1 << 20         # suffixes of a group
BUCKETS = (1 << 10, 1 << 22)   # prefix buckets: four for each group, within these bounds
BLOCK_WORDS = 1_500_000  # words of a block of text
BLOCK_BYTES = 2_000_000  # bytes hashed at once; a longer text is hashed alone
BREAKS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
KEYS = [f"h{i}" for i in range(1, DEPTH + 1)]


# -- text as numbers ---------------------------------------------------------------------------------------------------
class WordHasher:
    """Hashes of all words of a byte string at once: random values of the bytes times powers by place in the word."""

    def __init__(self, seed: int):
        random = np.random.default_rng(seed + 12)
        self.value = random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(random.integers(1, 2**62)) * 8 + 3
        self.power = np.ones(1, dtype=np.uint64)
        self.kind = np.zeros(256, dtype=np.uint8)    # 0: part of a word, 1: blank, 2: end of a piece
        self.kind[list(BLANKS)] = 1
        self.kind[list(BREAKS)] = 2
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32

    def powers(self, n: int) -> np.ndarray:
        if len(self.power) < n:
            steps = np.full(1 << (n - 1).bit_length(), np.uint64(self.base % 2**64))
            steps[0] = 1
            self.power = np.cumprod(steps)
        return self.power

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, start, end) of each word, and whether a piece ends before it."""
        raw = self.lower[np.frombuffer(data, dtype=np.uint8)]
        kind = self.kind[raw]
        inside = np.concatenate([[False], kind == 0, [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        if not len(start):
            return np.zeros(0, np.uint64), start, end, np.zeros(0, bool)
        breaks = np.concatenate([[0], np.cumsum(kind == 2)])
        fresh = np.append(True, breaks[start[1:]] != breaks[start[:-1]])
        length = end - start
        # One entry per byte of a word: its value times the power of its place.
        at = np.flatnonzero(inside[1:-1])
        first = np.cumsum(length) - length
        place = np.arange(len(at)) - np.repeat(first, length)
        spread = self.value[raw[at]] * self.powers(int(length.max()))[place]
        found = mix(np.add.reduceat(spread, first) + length.astype(np.uint64))
        return np.where(found == 0, np.uint64(1), found), start, end, fresh


def hasher(seed: int) -> WordHasher:
    return worker_state(("phrase words", seed), lambda: WordHasher(seed))


class Block:
    """Words of one language, gathered until there are enough for a block."""

    def __init__(self, lang: str):
        self.lang, self.held, self.words, self.size = lang, [], 0, 0

    def add(self, data: bytes, seed: int) -> None:
        hashes, start, end, fresh = hasher(seed).words(data)
        if len(hashes):
            self.held.append((data, hashes, start, end, fresh))
            self.words += len(hashes)
            self.size += len(data)

    def rows(self) -> tuple[list, list]:
        """The dictionary (lang, hash, word, n) and the block (lang, n, hashes, codes): a word's code is its place among
        the hashes plus one, zero ends a piece."""
        hashes = np.concatenate([x[1] for x in self.held])
        fresh = np.concatenate([x[4] for x in self.held])
        names, first, code, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        codes = np.zeros(len(hashes) + int(fresh.sum()), dtype="<u4")
        codes[np.arange(len(hashes)) + np.cumsum(fresh)] = code + 1
        size = np.array([len(x[1]) for x in self.held])
        owner = np.searchsorted(np.cumsum(size), first, side="right")
        place = first - (np.cumsum(size) - size)[owner]
        spelled = [self.held[o][0][self.held[o][2][p]:self.held[o][3][p]].lower().decode()
                   for o, p in zip(owner.tolist(), place.tolist())]  # bytes.lower() changes A-Z alone
        signed = names.view(np.int64)
        return (list(zip([self.lang] * len(names), signed.tolist(), spelled, count.tolist())),
                [(self.lang, len(hashes), signed.astype("<i8").tobytes(), codes.tobytes())])


CORPUS_SQL = "lang string, hash long, word string, n long, hashes binary, codes binary"
CORPUS = pa.schema([("lang", pa.string()), ("hash", pa.int64()), ("word", pa.string()), ("n", pa.int64()),
                    ("hashes", pa.binary()), ("codes", pa.binary())])


def numbered(docs: DataFrame, seed: int) -> DataFrame:
    """Dictionary rows (lang, hash, word, n) and blocks of text (lang, n, hashes, codes), in one table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_blocks: dict[str, Block] = {}

        def closed(block: Block) -> Iterator[pa.RecordBatch]:
            if block.held:
                words, text = block.rows()
                columns = [list(x) for x in zip(*words)]
                nothing = [None] * len(words)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([*columns, nothing, nothing], CORPUS.types)], schema=CORPUS)
                lang, n, hashes, codes = text[0]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((lang, None, None, n, hashes, codes), CORPUS.types)], schema=CORPUS)

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            yield from closed(open_blocks.pop(lang))

        for batch in batches:
            pending: dict[str, list[bytes]] = {}
            size: dict[str, int] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if not text:
                    continue
                pending.setdefault(lang, []).append(text.encode())
                size[lang] = size.get(lang, 0) + len(pending[lang][-1])
                if size[lang] >= BLOCK_BYTES:
                    block = open_blocks.setdefault(lang, Block(lang))
                    block.add(b"\n".join(pending.pop(lang)), seed)
                    size[lang] = 0
                    if block.words >= BLOCK_WORDS:
                        yield from flush(lang)
            for lang, texts in pending.items():
                open_blocks.setdefault(lang, Block(lang)).add(b"\n".join(texts), seed)
            for lang in [x for x, block in open_blocks.items() if block.words >= BLOCK_WORDS]:
                yield from flush(lang)
            # Many languages at once must not add up: the fullest go first.
            while sum(block.words for block in open_blocks.values()) > 2 * BLOCK_WORDS:
                yield from flush(max(open_blocks, key=lambda x: open_blocks[x].words))
        for lang in list(open_blocks):
            yield from flush(lang)

    return docs.select(F.coalesce("lang", F.lit("und")).cast("string").alias("lang"), F.col("text").cast("string").alias("text")
                       ).mapInArrow(run, CORPUS_SQL)


def numbered_corpus(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, words): the text as numbers and (lang, hash, word, n). Two words with one hash are found by their
    spelling; the text is then numbered again with other hashes."""
    seed = 0
    while True:
        corpus = written(numbered(docs, seed))
        words = written(corpus.where("hash IS NOT NULL").groupBy("lang", "hash").agg(
            F.sum("n").alias("n"), F.min("word").alias("word"), F.max("word").alias("other")))
        if words.where("word <> other").isEmpty():
            return corpus.where("hash IS NULL").select("lang", "n", "hashes", "codes"), words.drop("other")
        seed += 1


# -- vertical partitioning ---------------------------------------------------------------------------------------------
def windows(hashes: bytes, codes: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(names, rows of DEPTH codes): the suffixes of all positions, cut at the end of their piece; code 0 is no word."""
    names = np.append(np.int64(0), np.frombuffer(hashes, dtype="<i8"))
    text = np.concatenate([np.frombuffer(codes, dtype="<u4").astype(np.int64), np.zeros(DEPTH, dtype=np.int64)])
    start = np.flatnonzero(text[:-DEPTH])
    out = np.empty((len(start), DEPTH), dtype=np.int64)
    out[:, 0] = text[start]
    for k in range(1, DEPTH):
        out[:, k] = np.where(out[:, k - 1] > 0, text[start + k], 0)
    return names, out


def prefix_buckets(lang: str, names: np.ndarray, suffixes: np.ndarray, level: int, buckets: int) -> np.ndarray:
    """Bucket of each suffix by its first ``level`` words and its language."""
    import xxhash
    key = np.full(len(suffixes), np.uint64(xxhash.xxh3_64_intdigest(lang.encode())))
    spread = mix(names.view(np.uint64) + np.uint64(level))
    for k in range(level):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + spread[suffixes[:, k]])
    return (key >> np.uint64(20)).astype(np.int64) % buckets


class Plan:
    """Which group a suffix belongs to: for each prefix length the group of each bucket, -1 where it is split further."""

    def __init__(self, buckets: int, memory: int):
        self.buckets, self.memory = buckets, memory
        self.group_of: list[np.ndarray] = []
        self.groups, self.load = 0, 0

    def add_level(self, loads: np.ndarray) -> bool:
        """Gather the buckets of one more prefix length into groups; whether any is to be split further."""
        group = np.full(self.buckets, -1, dtype=np.int32)
        last = len(self.group_of) + 1 == DEPTH
        for bucket in np.flatnonzero(loads).tolist():
            if loads[bucket] <= self.memory or last:
                if self.load and self.load + loads[bucket] > self.memory:
                    self.groups, self.load = self.groups + 1, 0
                group[bucket] = self.groups
                self.load += int(loads[bucket])
        self.groups, self.load = self.groups + bool(self.load), 0  # a group holds prefixes of one length
        self.group_of.append(group)
        return bool((loads[group < 0] > 0).any())

    def place(self, lang: str, names: np.ndarray, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(group or -1, length of the prefix that decides) of each suffix."""
        group, level = np.full(len(suffixes), -1, dtype=np.int32), np.zeros(len(suffixes), dtype=np.int8)
        left = np.arange(len(suffixes))
        for k, table in enumerate(self.group_of, 1):
            found = table[prefix_buckets(lang, names, suffixes[left], k, self.buckets)]
            group[left], level[left] = found, k
            left = left[found < 0]
            if not len(left):
                break
        return group, level


def bucket_loads(blocks: DataFrame, plan: Plan) -> np.ndarray:
    """Suffixes per bucket of the next prefix length, among those no group takes yet. A task sends a row per bucket it
    met; the totals, one row per bucket, reach the driver (at most BUCKETS[1] of them)."""
    shared, level = blocks.sparkSession.sparkContext.broadcast(plan), len(plan.group_of) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shared.value.buckets, dtype=np.int64)
        for batch in batches:
            for lang, hashes, codes in zip(*(batch.column(x).to_pylist() for x in ("lang", "hashes", "codes"))):
                names, suffixes = windows(hashes, codes)
                group, _ = shared.value.place(lang, names, suffixes)
                rest = suffixes[group < 0]
                total += np.bincount(prefix_buckets(lang, names, rest, level, len(total)), minlength=len(total))
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met], pa.int64())], ["bucket", "n"])

    out = np.zeros(plan.buckets, dtype=np.int64)
    for row in blocks.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def partition_plan(blocks: DataFrame, memory: int) -> Plan:
    total = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = 1 << max(0, 4 * -(-total // memory) - 1).bit_length()
    plan = Plan(min(max(buckets, BUCKETS[0]), BUCKETS[1]), memory)
    while plan.add_level(bucket_loads(blocks, plan)):
        pass
    return plan


# -- subtrees ----------------------------------------------------------------------------------------------------------
LEAVES_SQL = "grp int, lang string, level int, names binary, codes binary, n binary"
LEAVES = pa.schema([("grp", pa.int32()), ("lang", pa.string()), ("level", pa.int32()), ("names", pa.binary()),
                    ("codes", pa.binary()), ("n", pa.binary())])
NODES_SQL = "lang string, depth int, " + ", ".join(f"{k} long" for k in KEYS) + ", n long"
NODES = pa.schema([("lang", pa.string()), ("depth", pa.int32()), *((k, pa.int64()) for k in KEYS), ("n", pa.int64())])


def runs(*columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows."""
    fresh = np.ones(len(columns[0]), dtype=bool)
    fresh[1:] = False
    for column in columns:
        fresh[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(fresh)


def leaves(blocks: DataFrame, plan: Plan) -> DataFrame:
    """Per block and group its distinct suffixes with counts: names (hashes), rows of codes into them, counts."""
    shared = blocks.sparkSession.sparkContext.broadcast(plan)

    def of_block(lang: str, hashes: bytes, codes: bytes) -> pa.RecordBatch:
        names, suffixes = windows(hashes, codes)
        group, level = shared.value.place(lang, names, suffixes)
        high, low = suffixes[:, 0] << 32 | suffixes[:, 1], suffixes[:, 2] << 32 | suffixes[:, 3]
        order = np.lexsort((low, high, group))
        group, level, high, low = group[order], level[order], high[order], low[order]
        first = runs(group, high, low)
        count = np.diff(np.append(first, len(group)))
        group, level, suffixes = group[first], level[first], suffixes[order[first]]
        starts = runs(group)
        out = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(group)]):
            used, code = np.unique(suffixes[a:b], return_inverse=True)
            wide = "<u2" if len(used) <= 1 << 16 else "<u4"
            out.append((group[a], lang, level[a], names[used].astype("<i8").tobytes(),
                        np.ascontiguousarray(code.reshape(-1, DEPTH).T).astype(wide).tobytes(), count[a:b].astype("<i8").tobytes()))
        columns = list(zip(*out)) or [()] * len(LEAVES)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, LEAVES.types)], schema=LEAVES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(x).to_pylist() for x in ("lang", "hashes", "codes"))):
                yield of_block(*row)

    return blocks.mapInArrow(run, LEAVES_SQL)


def subtree(level: int, suffixes: np.ndarray, count: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, paths, counts) of the nodes of one group: those shorter than its prefixes as a part of the total, the
    others, which no other group has, where they reach ``least``."""
    order = np.lexsort(suffixes.T[::-1])
    suffixes, count = suffixes[order], count[order]
    for depth in range(1, DEPTH + 1):
        real = suffixes[:, depth - 1] != 0       # a suffix that ended earlier has no node of this depth
        suffixes, count = suffixes[real], count[real]
        if not len(count):
            return
        first = runs(*suffixes[:, :depth].T)
        total = np.add.reduceat(count, first)
        wanted = total >= (least if depth >= level else 1)
        yield depth, suffixes[first[wanted], :depth], total[wanted]


def tree_nodes(blocks: DataFrame, plan: Plan, least: int) -> DataFrame:
    """(lang, depth, h1..h4, n): phrases of up to DEPTH words that occur ``least`` times, with their counts."""
    def build(group: pa.Table) -> pa.Table:
        out: list[tuple] = []
        parts: dict[tuple[str, int], list] = {}
        for lang, level, names, codes, n in zip(*(group.column(x).to_pylist() for x in ("lang", "level", "names", "codes", "n"))):
            count, names = np.frombuffer(n, dtype="<i8"), np.frombuffer(names, dtype="<i8")
            wide = "<u2" if len(names) <= 1 << 16 else "<u4"
            parts.setdefault((lang, level), []).append((names[np.frombuffer(codes, dtype=wide).reshape(DEPTH, -1).T], count))
        for (lang, level), held in parts.items():
            suffixes, count = (np.concatenate(x) for x in zip(*held))
            for depth, paths, total in subtree(level, suffixes, count, least):
                full = np.zeros((len(paths), DEPTH), dtype=np.int64)
                full[:, :depth] = paths
                out.append((lang, depth, full, total))
        size = [len(x[3]) for x in out]
        columns = [np.repeat(np.array([x[0] for x in out], dtype=object), size), np.repeat([x[1] for x in out], size),
                   *(np.concatenate([np.zeros((0, DEPTH), np.int64), *(x[2] for x in out)]).T),
                   np.concatenate([np.zeros(0, np.int64), *(x[3] for x in out)])]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, NODES.types)], schema=NODES)

    nodes = leaves(blocks, plan).groupBy("grp").applyInArrow(build, NODES_SQL)
    return nodes.groupBy("lang", "depth", *KEYS).agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def phrase_counts(docs: DataFrame, least: int = LEAST, memory: int = MEMORY) -> tuple[DataFrame, DataFrame]:
    """(nodes, words): counts of all phrases of up to four words that occur ``least`` times, as word hashes, and
    (lang, hash, word, n) of every word."""
    blocks, words = numbered_corpus(docs)
    return written(tree_nodes(blocks, partition_plan(blocks, memory), least)), words


# -- scores ------------------------------------------------------------------------------------------------------------
def key(*parts: Column | str) -> list[Column]:
    """A phrase of fewer words as a full key, with zeros behind."""
    filled = [*(F.col(x) if isinstance(x, str) else x for x in parts), *[F.lit(0).cast("long")] * (DEPTH - len(parts))]
    return [x.alias(k) for x, k in zip(filled, KEYS)]


def cut_scores(nodes: DataFrame) -> DataFrame:
    """Candidates (depth of 2 or more) with l, r and score of the cut that scores lowest."""
    place = ["lang", "depth", *KEYS]
    halves = []
    for depth in range(2, DEPTH + 1):
        these = nodes.where(F.col("depth") == depth)
        for cut in range(1, depth):
            for side, part in (("l", KEYS[:cut]), ("r", KEYS[cut:depth])):
                halves.append(these.select(F.struct("lang", "depth", *KEYS).alias("of"), F.col("n").alias("a"), F.lit(cut).alias("cut"),
                                           F.lit(side).alias("side"), "lang", F.lit(len(part)).alias("depth"), *key(*part)))
    wanted = reduce(DataFrame.union, halves)
    # Every part of a phrase occurs at least as often as the phrase, so it is among the nodes.
    found = wanted.join(nodes, place).groupBy("of", "a", "cut").agg(
        F.max(F.when(F.col("side") == "l", F.col("n"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("n"))).alias("r"))
    wide = "decimal(38,0)"
    score = F.expr(f"(CAST({FACTOR} AS {wide}) * CAST(a AS decimal(20,0))) div (CAST(l AS decimal(20,0)) + CAST(r AS decimal(20,0)))")
    lowest = found.withColumn("score", score).groupBy("of", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low"))
    return lowest.select("of.*", "a", "low.l", "low.r", "low.score")


def covered(nodes: DataFrame, cover: int) -> DataFrame:
    """Keys of candidates that lie inside a longer one with at least ``cover`` per cent of their occurrences."""
    inner = []
    for depth in range(3, DEPTH + 1):
        these = nodes.where(F.col("depth") == depth)
        for size in range(2, depth):
            for at in range(depth - size + 1):
                inner.append(these.select("lang", F.lit(size).alias("depth"), *key(*KEYS[at:at + size]), F.col("n").alias("longer")))
    longest = reduce(DataFrame.union, inner).groupBy("lang", "depth", *KEYS).agg(F.max("longer").alias("longer"))
    return (longest.join(nodes, ["lang", "depth", *KEYS])
            .where(F.col("longer").cast("decimal(20,0)") * 100 >= F.col("n").cast("decimal(20,0)") * cover).select("lang", "depth", *KEYS))


def collocations(docs: DataFrame, best: int = BEST, least: int = LEAST, cover: int = COVER, memory: int = MEMORY) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``best`` phrases of each language.

    ``docs`` needs ``text`` and ``lang``; other columns are ignored, and every row counts, repeated ones too. A-Z count
    as lower case; pieces end at ``.,;:!?`` and line ends, words at spaces and tabs. A null or empty text has no words,
    a null language is ``und``; a language without candidates, such as any of an empty table, has no row.

    Candidates are phrases of two to four words with a >= ``least`` occurrences within pieces. A cut after k words with
    l occurrences of the first part and r of the rest scores floor(2000000 a / (l + r)); the lowest cut counts, ties to
    the smallest k. A candidate inside a longer one that has ``cover`` per cent of its occurrences is dropped. n is
    the number of words of the language. Order: score, then a, descending, then the phrase as UTF-8 bytes.
    """
    nodes, words = phrase_counts(docs, least, memory)
    place = ["lang", "depth", *KEYS]
    scored = cut_scores(nodes).join(covered(nodes, cover), place, "left_anti")
    for k in KEYS:
        named = words.where(F.col("n") >= least).select("lang", F.col("hash").alias(k), F.col("word").alias(f"w_{k}"))
        scored = scored.join(named, ["lang", k], "left")
    scored = scored.withColumn("phrase", F.concat_ws(" ", *(f"w_{k}" for k in KEYS)))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return top.join(sizes, "lang").select("lang", F.col("rank").cast("long"), "phrase", *(F.col(x).cast("long") for x in ("a", "l", "r", "n", "score")))
