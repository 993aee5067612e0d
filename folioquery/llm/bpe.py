"""Byte-level BPE encoding and decoding with a contiguous rank array per word.

A word is an array of part ids (its boundaries) and an array of the ranks of adjacent parts. The lowest rank is looked
up by a scan, its boundary is deleted and the two neighbouring ranks are refreshed, until no pair has a rank. Words of
one length form a matrix, so each step treats all distinct words of a batch at once. Long words use a heap instead,
because scanning is quadratic in the length.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioquery.llm.common import worker_state

NO_RANK = np.int32(2**31 - 1)
SHORT_WORD = 40          # bytes; longer words go through the heap
BATCH_CHARS = 2_000_000  # texts are handled in groups of about this size
REMEMBERED = 600_000     # pieces kept per worker
IRREGULAR = re.compile(r"[^\S \n]|[ \n]{2}")
BEYOND_LATIN = re.compile("[^\x20-ɏ\n]")


def byte_letters() -> list[str]:
    """The public letter for each byte: printable Latin-1 stands for itself, the rest follows from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class BytePairEncoder:
    """Merges of a tokenizer file (``tokenizers`` JSON) applied to the words of its own pre-tokenizer."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        self.latin_words = regex.compile(public_tokenizers.PATTERN).findall
        self.byte_of = {letter: b for b, letter in enumerate(letters)}
        self.first_id = np.array([vocab[x] for x in letters], dtype=np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.rank_of = dict(zip(keys.tolist(), range(len(keys))))
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        suffix = spec["model"].get("end_of_word_suffix") or ""
        plain = ((token.removesuffix(suffix) if suffix else token, i) for token, i in vocab.items())
        names = {i: bytes(self.byte_of.get(c, 32) for c in token) for token, i in plain}
        names |= {i: text.encode() for text, i in self.special.items()}
        self.name = [names.get(i, b"") for i in range(max(names) + 1)]
        self.special_split = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.pieces: dict[str, bytes] = {}

    def letter_ids(self, matrix: np.ndarray) -> np.ndarray:
        return self.first_id[matrix]

    # -- merging ---------------------------------------------------------------------------------------------------
    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.rank[at], NO_RANK)

    def merge_block(self, ids: np.ndarray) -> list[bytes]:
        """Encode words of one length, given as rows of byte ids."""
        out: list[bytes] = [b""] * len(ids)
        rows = np.arange(len(ids))

        def emit(which: np.ndarray, parts: np.ndarray) -> None:
            data, size = parts.astype("<u4").tobytes(), 4 * parts.shape[1]
            for k, row in enumerate(which.tolist()):
                out[row] = data[k * size:(k + 1) * size]

        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        while len(rows) and ids.shape[1] > 1:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            if (ended := best == NO_RANK).any():
                emit(rows[ended], ids[ended])
                go = ~ended
                rows, ids, ranks, at, best = rows[go], ids[go], ranks[go], at[go], best[go]
                if not len(rows):
                    return out
            pick = np.arange(len(rows))
            ids[pick, at] = self.made[best]
            column = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, column + (column > at[:, None]), axis=1)
            ranks = np.take_along_axis(ranks, column[:-1] + (column[:-1] >= at[:, None]), axis=1)
            left = at > 0
            ranks[pick[left], at[left] - 1] = self.pair_ranks(ids[pick[left], at[left] - 1], ids[pick[left], at[left]])
            right = at < ids.shape[1] - 1
            ranks[pick[right], at[right]] = self.pair_ranks(ids[pick[right], at[right]],
                                                           ids[pick[right], at[right] + 1])
        emit(rows, ids)
        return out

    def merge_long(self, word: bytes) -> bytes:
        """Encode one long word: linked parts and a heap of candidate merges."""
        ids = self.letter_ids(np.frombuffer(word, dtype=np.uint8)[None, :])[0].tolist()
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(self.rank_of[k], i, k) for i in range(len(ids) - 1)
                if (k := ids[i] << 32 | ids[i + 1]) in self.rank_of]
        heapq.heapify(heap)
        while heap:
            rank, i, key = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else -1
            if j < 0 or ids[i] << 32 | ids[j] != key:
                continue
            ids[i], ids[j] = int(self.made[rank]), -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (k := ids[a] << 32 | ids[b]) in self.rank_of:
                    heapq.heappush(heap, (self.rank_of[k], a, k))
        return np.array([x for x in ids if x >= 0], dtype="<u4").tobytes()

    def encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        lengths: dict[int, list[bytes]] = {}
        out: dict[bytes, bytes] = {}
        for word in words:
            if len(word) <= SHORT_WORD:
                lengths.setdefault(len(word), []).append(word)
            else:
                out[word] = self.merge_long(word)
        for size, same in lengths.items():
            for start in range(0, len(same), 20_000):
                block = same[start:start + 20_000]
                matrix = np.frombuffer(b"".join(block), dtype=np.uint8).reshape(len(block), size)
                out.update(zip(block, self.merge_block(self.letter_ids(matrix))))
        return out

    # -- splitting -------------------------------------------------------------------------------------------------
    def library_words(self, text: str) -> list[bytes]:
        return [bytes(map(self.byte_of.__getitem__, word)) for word, _ in self.splitter.pre_tokenize_str(text)]

    def words(self, text: str) -> list[bytes]:
        """The words of the pre-tokenizer; Latin text takes the same pattern through ``regex``, which is faster."""
        if not text.isascii() and BEYOND_LATIN.search(text):
            return self.library_words(text)
        return list(map(str.encode, self.latin_words(text)))

    def learn(self, pieces: set[str]) -> None:
        """Encode pieces that are not remembered yet; a piece stands for itself with one space before it."""
        split = {p: self.words(p if p[:1] == "\n" else " " + p) for p in pieces}
        ids = self.encode_words(list({w for words in split.values() for w in words}))
        for piece, words in split.items():
            self.pieces[piece] = b"".join(map(ids.__getitem__, words))

    def encode_group(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers.

        Where white space is single spaces and single line feeds, a text falls into pieces at each of them and no word
        crosses a piece, so each distinct piece is split and merged once. Other texts are split as a whole.
        """
        found: list[bytes | None] = [None] * len(texts)
        regular: list[tuple[int, list[str]]] = []
        for k, text in enumerate(texts):
            if IRREGULAR.search(text) or (self.special_split and self.special_split.search(text)):
                found[k] = self.encode_whole(text)
            elif text:
                pieces = text.replace("\n", " \n").split(" ")
                pieces[0] = "\n" + pieces[0]
                regular.append((k, pieces))
        unknown: set[str] = set()
        for _, pieces in regular:
            unknown.update(pieces)
        if len(self.pieces) + len(unknown) > REMEMBERED:
            self.pieces.clear()
        self.learn(unknown.difference(self.pieces))
        for k, pieces in regular:
            found[k] = b"".join(map(self.pieces.__getitem__, pieces))[4:]  # without the line feed put in front
        return [x or b"" for x in found]

    def encode_whole(self, text: str) -> bytes:
        out, start = [], 0
        for m in self.special_split.finditer(text) if self.special_split else ():
            out += [self.encode_plain(text[start:m.start()]), np.array([self.special[m[0]]], dtype="<u4").tobytes()]
            start = m.end()
        return b"".join([*out, self.encode_plain(text[start:])])

    def encode_plain(self, text: str) -> bytes:
        words = self.library_words(text)
        ids = self.encode_words(list(set(words)))
        return b"".join(map(ids.__getitem__, words))

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= BATCH_CHARS:
                yield from self.encode_group(group)
                group, size = [], 0
        yield from self.encode_group(group)

    def decode(self, ids: bytes) -> str:
        parts = map(self.name.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())
        return b"".join(parts).decode("utf-8", errors="replace")


class LatinWords:
    """Words of Latin text, all at once: letters, single digits, and runs of other signs, cut as the pattern of the
    vocabulary cuts them, with the English endings behind an apostrophe as words of their own."""

    SIZE = 0x250             # code points below this are looked up in tables
    ENDINGS = {1: "stmd", 2: ("re", "ve", "ll")}

    def __init__(self):
        import regex
        signs = [chr(c) for c in range(self.SIZE)]
        self.kind = np.full(self.SIZE, 3, dtype=np.uint8)    # 0 white space, 1 letter, 2 digit, 3 other
        for kind, pattern in ((0, r"\s"), (1, r"\p{L}"), (2, r"\p{N}")):
            self.kind[[c for c, x in enumerate(signs) if regex.match(pattern, x)]] = kind
        random = np.random.default_rng(5)
        self.values = random.integers(1, 2**63, (2, self.SIZE), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.bases = [int(x) * 8 + 3 for x in random.integers(1, 2**60, 2)]
        self.powers = [np.ones(1, dtype=np.uint64)] * 2

    def reach(self, n: int) -> None:
        if len(self.powers[0]) < n:
            for k, base in enumerate(self.bases):
                steps = np.full(1 << (n - 1).bit_length(), np.uint64(base))
                steps[0] = 1
                self.powers[k] = np.cumprod(steps)

    def cut(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each word."""
        kind = self.kind[codes]
        fresh = np.ones(len(codes), dtype=bool)
        fresh[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        mark = np.flatnonzero(codes[:-1] == 39)
        mark = mark[(mark == 0) | (kind[np.maximum(mark - 1, 0)] != 3)]  # an apostrophe that starts its run
        if len(mark):
            padded = np.append(codes, [0, 0])
            first, second = padded[mark + 1], padded[mark + 2]
            long = np.zeros(len(mark), dtype=bool)
            for a, b in self.ENDINGS[2]:
                long |= (first == ord(a)) & (second == ord(b))
            short = np.isin(first, [ord(x) for x in self.ENDINGS[1]])
            for size, at in ((1, mark[short]), (2, mark[long & ~short])):
                fresh[at + 1] = False
                after = at + 1 + size
                fresh[after[after < len(codes)]] = True
        start = np.flatnonzero(fresh)
        end = np.append(start[1:], len(codes))
        word = kind[start] != 0
        return start[word], end[word]

    def distinct(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first occurrence of each distinct word, which of them each word is). Words are told apart by a hash of 64
        bits, and a second one says whether all that share the first are equal; if not, both decide."""
        length = end - start
        first = np.cumsum(length) - length
        at = np.arange(int(length.sum())) - np.repeat(first - start, length)
        place = at - np.repeat(start, length)
        self.reach(int(length.max()))
        one, two = (np.add.reduceat(value[codes[at]] * power[place], first) + length.astype(np.uint64)
                    for value, power in zip(self.values, self.powers))
        _, index, which = np.unique(one, return_index=True, return_inverse=True)
        if (two[index][which] != two).any():
            _, index, which = np.unique(np.column_stack([one, two]), axis=0, return_index=True, return_inverse=True)
        return index, which.ravel()


class WordEndEncoder(BytePairEncoder):
    """The same merges for vocabularies that mark the end of a word, lower-case the text and drop white space.

    The words of Latin texts are cut and told apart in one go for a group of texts; each distinct word is merged once.
    Other texts fall into pieces at white space and each distinct piece is encoded once; pieces beyond the Latin letters,
    and texts with rare white space or the names of special tokens, go through the library itself.
    """

    RARE_SPACE = re.compile(r"[^\S \n\t\r]")
    BEYOND = re.compile("[^\x00-\u024f]")
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        super().__init__(path)
        import regex
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)["model"]
        self.last_id = np.array([spec["vocab"][x + spec["end_of_word_suffix"]] for x in byte_letters()], dtype=np.int32)
        self.latin_words = regex.compile(self.PATTERN).findall
        self.latin = LatinWords()
        self.known_words: dict[str, bytes] = {}
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()

    def letter_ids(self, matrix: np.ndarray) -> np.ndarray:
        ids = self.first_id[matrix]
        ids[:, -1] = self.last_id[matrix[:, -1]]
        return ids

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, pieces: set[str]) -> None:
        split: dict[str, list[bytes]] = {}
        for piece in pieces:
            if not piece.isascii() and BEYOND_LATIN.search(piece):
                self.pieces[piece] = self.whole(piece)
            else:
                plain = piece if piece.isascii() else unicodedata.normalize("NFC", piece)
                split[piece] = list(map(str.encode, self.latin_words(plain.lower())))
        ids = self.encode_words(list({w for words in split.values() for w in words}))
        for piece, words in split.items():
            self.pieces[piece] = b"".join(map(ids.__getitem__, words))

    def word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words; words are remembered up to a number of them, the table then starts anew."""
        known = self.known_words
        unknown = [w for w in words if w not in known]
        if len(known) + len(unknown) > REMEMBERED:
            known.clear()
            unknown = words
        if unknown:
            spelled = list(map(str.encode, unknown))
            ids = self.encode_words(spelled)
            known.update(zip(unknown, map(ids.__getitem__, spelled)))
        return list(map(known.__getitem__, words))

    def encode_latin(self, texts: list[str]) -> list[bytes]:
        """Texts of Latin letters, lower-cased and normalised."""
        joined = "\n".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        start, end = self.latin.cut(codes)
        if not len(start):
            return [b""] * len(texts)
        index, which = self.latin.distinct(codes, start, end)
        ids = self.word_ids([joined[a:b] for a, b in zip(start[index].tolist(), end[index].tolist())])
        size = np.array([len(x) // 4 for x in ids])
        flat, first = np.frombuffer(b"".join(ids), dtype="<u4"), np.cumsum(size) - size
        length = size[which]
        before = np.concatenate([[0], np.cumsum(length)])
        out = flat[np.arange(before[-1]) + np.repeat(first[which] - before[:-1], length)]
        text_start = np.cumsum([0, *(len(x) + 1 for x in texts)])
        bound = before[np.searchsorted(start, text_start)].tolist()
        return [out[a:b].tobytes() for a, b in zip(bound, bound[1:])]

    def encode_group(self, texts: list[str]) -> list[bytes]:
        found: list[bytes] = [b""] * len(texts)
        regular: list[tuple[int, list[str]]] = []
        latin: list[tuple[int, str]] = []
        for k, text in enumerate(texts):
            if self.RARE_SPACE.search(text) or self.special_split.search(text):
                found[k] = self.whole(text)
                continue
            plain = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower()
            if plain.isascii() or not self.BEYOND.search(plain):
                latin.append((k, plain))
            else:
                regular.append((k, text.split()))
        if latin:
            for (k, _), ids in zip(latin, self.encode_latin([plain for _, plain in latin])):
                found[k] = ids
        unknown: set[str] = set()
        for _, pieces in regular:
            unknown.update(pieces)
        if len(self.pieces) + len(unknown) > REMEMBERED:
            self.pieces.clear()
        self.learn(unknown.difference(self.pieces))
        for k, pieces in regular:
            found[k] = b"".join(map(self.pieces.__getitem__, pieces))
        return found


def encoder(path: str) -> BytePairEncoder:
    return worker_state(("bpe", path), lambda: BytePairEncoder(path))


def encode_decode(docs: DataFrame, path: str, texts: bool = False) -> DataFrame:
    """Encode each text and decode the ids again; one row per input row.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. A null or empty text has no tokens. With
    ``texts`` the ids and the decoded text themselves are returned too. Rows stay where they are: no shuffle.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded string" if texts else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            column = batch.column("text")
            rows: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            more: dict[str, list] = {"ids": [], "decoded": []} if texts else {}
            for ids in bpe.encode(x.as_py() or "" for x in column):
                decoded = bpe.decode(ids)
                rows["n_tokens"].append(len(ids) // 4)
                rows["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                rows["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                if texts:
                    more["ids"].append(np.frombuffer(ids, dtype="<i4"))
                    more["decoded"].append(decoded)
            arrays = [batch.column("doc_id").cast(pa.int64()), pa.array(rows["n_tokens"], pa.int64()),
                      pa.array(rows["ids_sha256"], pa.string()), pa.array(rows["decoded_sha256"], pa.string())]
            if texts:
                arrays += [pa.array(more["ids"], pa.list_(pa.int32())), pa.array(more["decoded"], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *rows, *more])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
