"""Phrase collocations against brute force."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioquery.llm import phrases

DOCS = "doc_id long, text string, lang string, n long, rank string"


def documents(spark, rows):
    return spark.createDataFrame([(i, text, lang, 1, "x") for i, (text, lang) in enumerate(rows)], DOCS).repartition(3)


def brute(rows, least, best=2000, cover=80):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for d in range(1, 5):
                for i in range(len(words) - d + 1):
                    f.setdefault(lang, Counter())[tuple(words[i:i + d])] += 1
    out = []
    for lang, counts in f.items():
        kept = []
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        for p, a in candidates.items():
            cuts = [(2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            inside = [b for q, b in candidates.items() if len(q) > len(p)
                      and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * b >= cover * a for b in inside):
                kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def run(spark, rows, **options):
    return sorted(tuple(r) for r in phrases.collocations(documents(spark, rows), **options).collect())


def some_texts(seed, size):
    rng = random.Random(seed)
    words = ["The", "the", "a", "of", "Ünder", "x-y", "zwölf", " ", "end of", "q" * 50, *(f"w{i}" for i in range(30))]
    marks = [" ", " ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "\x0b", "!? "]
    rows = []
    for _ in range(size):
        parts = rng.choices(words, weights=[1 / (1 + i) for i in range(len(words))], k=rng.randrange(60))
        text = "".join(w + rng.choice(marks) for w in parts)
        rows.append((text + " new york city hall" * rng.randrange(3), rng.choice(["en", "en", "en", "de", None, "und", ""])))
    return rows


@pytest.mark.parametrize("memory", [1 << 20, 300, 7])
def test_equals_brute_force_at_any_memory_budget(spark, memory):
    rows = some_texts(4, 400) + [("same old line of text", "en")] * 300 + [(None, "en"), ("", None), (" \t.,", "fr"), ("Very " * 3000, "de")]
    want = brute(rows, 5)
    assert len(want) > 100
    assert run(spark, rows, least=5, memory=memory) == want


def test_limits_ties_and_empty_tables(spark):
    rows = some_texts(6, 200)
    assert run(spark, rows, least=3, best=4, cover=50) == brute(rows, 3, 4, 50)
    assert run(spark, rows[:0]) == []
    assert run(spark, [(None, None), ("", "en")]) == []


def test_buckets_are_split_until_groups_fit(spark):
    rows = [("the cat sat", "en")] * 50 + [(f"the w{i} v{i} u{i}", "en") for i in range(200)]
    blocks, _ = phrases.numbered_corpus(documents(spark, rows))
    plan = phrases.partition_plan(blocks, 60)
    assert len(plan.group_of) > 1  # "the" alone exceeds the budget
    sizes = Counter()
    for row in blocks.collect():
        names, suffixes = phrases.windows(row.hashes, row.codes)
        group, level = plan.place(row.lang, names, suffixes)
        assert (group >= 0).all()
        sizes.update(group.tolist())
    assert max(sizes.values()) <= 60


def test_words_with_one_hash_are_told_apart(spark, monkeypatch):
    real, seeds = phrases.numbered, []

    def clashing(docs, seed):
        seeds.append(seed)
        found = real(docs, seed)
        return found if seed else found.withColumn("hash", F.when(F.col("hash").isNotNull(), F.lit(7).cast("long")))

    monkeypatch.setattr(phrases, "numbered", clashing)
    _, words = phrases.numbered_corpus(documents(spark, [("a b a", "en"), ("B c", "en"), ("a", "de")]))
    assert sorted((r.lang, r.word, r.n) for r in words.collect()) == [("de", "a", 1), ("en", "a", 2), ("en", "b", 2), ("en", "c", 1)]
    assert seeds == [0, 1]
