"""De-duplication operators against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from folioquery.llm import lines, minhash, suffixes
from folioquery.llm.components import components

DOCS = "doc_id long, text string, pos long, kind string, node string, n_chars long"


def frame(spark, docs, parts=3):
    rows = [(d, t, 7, "k", "n", None if t is None else len(t)) for d, t in docs]
    return spark.createDataFrame(rows, DOCS).repartition(parts)


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(2, 7))) for _ in range(n))


def corpus(seed):
    """Copies, near copies, shared passages, periodic texts, long and empty ones."""
    rnd = random.Random(seed)
    passage = prose(rnd, 90)
    docs = [prose(rnd, rnd.randint(1, 250)) for _ in range(12)]
    docs += [docs[0], docs[0] + " tail", "x" + docs[1], docs[2][:450], docs[2][20:430]]
    for _ in range(12):
        words = docs[3].split() + passage.split()
        for _ in range(rnd.randint(0, 4)):
            words[rnd.randrange(len(words))] = prose(rnd, 1)
        docs.append(" ".join(words))
    docs += [prose(rnd, 20) + " " + passage[: 380 + 10 * k] + " " + prose(rnd, 20) for k in range(8)]
    docs += ["ab" * 450, "x" * 900, "x" * 399, "", "   ", None, "one two", "one two", "é" * 500]
    return list(enumerate(docs)) + [(None, docs[4]), (None, docs[4]), (5, docs[5]), (5, docs[6])]


def covered(docs, least):
    """Bytes of distinct (doc_id, text) documents that a string occurring elsewhere covers."""
    distinct = sorted(set(docs), key=repr)
    seen, out = Counter(), {}
    data = {d: (d[1] or "").encode() for d in distinct}
    for b in data.values():
        seen.update(b[k:k + least] for k in range(len(b) - least + 1))
    for d, b in data.items():
        mask = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - least + 1):
            if seen[b[k:k + least]] > 1:
                mask[k:k + least] = True
        out[d] = mask
    return data, out


@pytest.mark.parametrize("seed", [1, 2])
def test_suffixes_against_brute_force(spark, seed):
    docs = corpus(seed)
    data, masks = covered(docs, 400)
    want = Counter()
    for d in docs:
        b, m = data[d], masks[d]
        kept = bytes(np.frombuffer(b, np.uint8)[~m])
        runs = int((m & ~np.append(False, m[:-1])).sum()) if len(m) else 0
        want[(d[0], len(b), int(m.sum()), runs, hashlib.sha256(kept).hexdigest())] += 1
    got = suffixes.without_repeats(frame(spark, docs))
    assert Counter(map(tuple, got.collect())) == want


def test_suffix_segments_and_texts(spark, monkeypatch):
    text = prose(random.Random(3), 3000)
    data = np.frombuffer(text.encode(), np.uint8)
    one = suffixes.stretches(data, 400)
    monkeypatch.setattr(suffixes, "SEGMENT_BITS", 11)
    many = suffixes.stretches(data, 400)
    cover = lambda rows: np.concatenate([np.arange(a, b + 1) for a, b in rows[:, 1:3]])
    assert (cover(many) == np.arange(len(data) - 399)).all() and (cover(one) == cover(many)).all()
    docs = frame(spark, [(1, "start " + text[:600]), (2, text[:600] + "é end"), (3, None)])
    rows = {r.doc_id: r for r in suffixes.without_repeats(docs, texts=True).collect()}
    assert (rows[1].text, rows[1].n_chars, rows[2].text, rows[3].text, rows[2].kind) == ("start ", 6, "é end", None, "k")
    assert suffixes.without_repeats(docs.limit(0)).collect() == []


@pytest.mark.parametrize("words", [3, 50])
def test_suffixes_in_words_against_brute_force(spark, words):
    rnd = random.Random(words)
    space = lambda: rnd.choice([" ", " ", "  ", "\n", "\t "])
    spell = lambda ws: "".join(w + space() for w in ws)
    shared = [prose(rnd, 60).split() for _ in range(3)]
    docs = [spell(prose(rnd, rnd.randint(1, 90)).split()) for _ in range(15)]
    docs += [" " + spell(prose(rnd, 9).split() + rnd.choice(shared)[rnd.randint(0, 12):] + prose(rnd, 4).split()) for _ in range(20)]
    docs += ["a " * 120, "a\n" * 49, "a b " * 60, "", " \t", None, "x" * 900, "x" * 900, docs[0], "é " + docs[1]]
    docs = list(enumerate(docs)) + [(None, docs[3]), (None, docs[3]), (4, docs[4]), (4, docs[5])]
    data, seen, want = {}, Counter(), Counter()
    for d in set(docs):
        b = (d[1] or "").encode()
        data[d] = [(m.start(), m[0]) for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)]
        seen.update(tuple(w for _, w in data[d][k:k + words]) for k in range(len(data[d]) - words + 1))
    for d in docs:
        b, mask = (d[1] or "").encode(), np.zeros(len(data[d]), dtype=bool)
        for k in range(len(mask) - words + 1):
            if seen[tuple(w for _, w in data[d][k:k + words])] > 1:
                mask[k:k + words] = True
        starts = [at for at, _ in data[d]] + [len(b)]
        gone = np.zeros(len(b), dtype=bool)
        for k in np.flatnonzero(mask):
            gone[starts[k]:starts[k + 1]] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int((mask & ~np.append(False, mask[:-1])).sum()) if len(mask) else 0
        want[(d[0], len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())] += 1
    got = suffixes.without_repeats(frame(spark, docs), words=words)
    assert Counter(map(tuple, got.collect())) == want
    assert sum(n for (*_, gone, _, _), n in want.items() if gone) > 10


def lines_wanted(docs, least):
    distinct = sorted({d for d in docs if d[1] is not None}, key=lambda d: (d[0] is not None, d[0] or 0, 0))
    places = defaultdict(list)
    for d in distinct:
        parts = d[1].split("\n")
        for k in range(len(parts) - least + 1):
            places[tuple(parts[k:k + least])].append((d, k))
    return places


def test_lines_against_brute_force(spark):
    rnd = random.Random(4)
    docs = []
    for i in range(40):
        docs.append((i, "\n".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 12)))))
    docs += [(100, None), (101, ""), (102, "q\nw\ne\nr"), (103, "q\nw\ne\nr"), (102, "q\nw\ne\nr"), (None, "q\nw\ne\nr\nt")]
    gone = defaultdict(set)
    starts = defaultdict(set)
    for where in lines_wanted(docs, 3).values():
        for d, k in where[1:]:
            starts[d].add(k)
            gone[d].update(range(k, k + 3))
    want = Counter()
    for d in docs:
        parts = d[1].split("\n") if d[1] is not None else []
        rest = "\n".join(x for i, x in enumerate(parts) if i not in gone[d]) if d[1] is not None else ""
        runs, reach = 0, -1
        for k in sorted(starts[d]):
            runs += k > reach
            reach = k + 3
        want[(d[0], len(parts), len(gone[d]), runs, hashlib.sha256(rest.encode()).hexdigest())] += 1
    assert Counter(map(tuple, lines.without_repeated_lines(frame(spark, docs)).collect())) == want
    texts = {r.doc_id: r for r in lines.without_repeated_lines(frame(spark, docs), texts=True).collect()}
    assert texts[103].text == "" and texts[103].n_chars == 0 and texts[100].text is None and texts[103].node == "n"
    assert lines.without_repeated_lines(frame(spark, docs).limit(0)).collect() == []


@pytest.mark.parametrize("least", [1, 2, 5])
def test_lines_at_other_depths(spark, least):
    rnd = random.Random(least)
    docs = [(i, "\n".join(rnd.choice("ab") for _ in range(12))) for i in range(12)]
    want = defaultdict(set)
    for where in lines_wanted(docs, least).values():
        for d, k in where[1:]:
            want[d[0]].add(k)
    got = defaultdict(set)
    for r in lines.repeated_runs(frame(spark, docs), least).collect():
        got[r.doc_id].add(r.pos)
    assert got == want


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def near_wanted(docs, width, percent):
    sets = [shingles(t, width) for _, t in docs]
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                root[top(i)] = top(j)
    groups = defaultdict(list)
    for i in range(len(docs)):
        groups[top(i)].append(docs[i][0])
    low = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return Counter((docs[i][0], len(sets[i]), low[top(i)]) for i in range(len(docs))), len({top(i) for i in range(len(docs)) if sets[i]})


def near_corpus(seed):
    rnd = random.Random(seed)
    base = prose(rnd, 120).split()
    docs = corpus(seed)
    for k in range(60):  # near copies of many grades: some link only through others
        words = list(base)
        for _ in range(rnd.randint(0, 9)):
            words[rnd.randrange(len(words))] = prose(rnd, 1)
        docs.append((200 + k, " ".join(words).title() if k % 2 else " ".join(words)))
    return docs


@pytest.mark.parametrize("width, percent, block", [(3, 85, 1024), (5, 80, 8)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, width, percent, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    docs = near_corpus(width)
    got = minhash.near_duplicates(frame(spark, docs), width, percent).collect()
    rows, groups = near_wanted(docs, width, percent)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == rows
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    kept = minhash.without_near_duplicates(frame(spark, docs), width, percent).collect()
    assert len([r for r in kept if (r.text or "").strip()]) == groups and {r.node for r in kept} == {"n"}


def test_near_duplicates_of_nothing(spark):
    none = frame(spark, [(1, "a")]).limit(0)
    assert minhash.near_duplicates(none).collect() == [] and minhash.without_near_duplicates(none).collect() == []
    single = minhash.near_duplicates(frame(spark, [(1, "a"), (2, None), (3, "\n")])).collect()
    assert all(r.kept and r.component_id == r.doc_id for r in single)


def test_posterior_bound():
    least = minhash.least_matches(85)
    assert least[0] == 0 and list(least) == sorted(least) and least[-1] < 0.85 * minhash.SIGNATURE


def test_components_of_a_long_path(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    rows = components(spark.createDataFrame(path, "a long, b long")).collect()
    assert sorted(map(tuple, rows)) == [(i, 0) for i in range(41)] + [(100, 100), (101, 100)]
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_short_runs_of_many_words_against_brute_force(spark):
    rnd = random.Random(6)
    long, half, more = prose(rnd, 50), prose(rnd, 25), prose(rnd, 24)
    pool = [long, half, more, prose(rnd, 70), "a", "b", ""]
    docs = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 5)))) for i in range(30)]
    docs += [(90, prose(rnd, 49)), (100, long), (101, half + "\n" + half), (102, half + "\n" + more + " x"), (103, half + "\n" + more + " x"),
             (104, None), (105, docs[0][1]), (105, docs[0][1])]
    docs += [(106, docs[30][1])]  # 49 words stay
    gone = defaultdict(set)
    for size in (1, 2, 3):
        for run, where in lines_wanted(docs, size).items():
            if size == 3 or sum(len(x.split()) for x in run) >= 50:
                for d, k in where[1:]:
                    gone[d].update(range(k, k + size))
    want = Counter()
    for d in docs:
        parts = d[1].split("\n") if d[1] is not None else []
        rest = "\n".join(x for i, x in enumerate(parts) if i not in gone[d])
        runs = sum(i - 1 not in gone[d] for i in gone[d])
        want[(d[0], len(parts), len(gone[d]), runs, hashlib.sha256(rest.encode()).hexdigest())] += 1
    assert Counter(map(tuple, lines.without_repeated_lines(frame(spark, docs), words=50).collect())) == want
    kept = {r.doc_id: r.text for r in lines.without_repeated_lines(frame(spark, docs), texts=True, words=50).collect()}
    assert kept[100] == kept[101] == kept[103] == "" and kept[106] == docs[30][1]
