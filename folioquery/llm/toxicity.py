"""Toxicity by weak supervision.

Voters look for the words of a lexicon, for signs of shouting, and for groups of word stems that the labelled rows tie
to toxicity. A generative label model - voters given the class form a tree of dependences - is fitted by expectation
maximisation to the counts of all vote patterns: it estimates each voter's accuracy and its correlation with the
voter it depends on most. A linear classifier on word and stem features is then trained on the posterior labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioquery.llm.common import held_out, worker_state
from folioquery.llm.labels import fit_sample, label_rows
from folioquery.llm.linear import descend, platt

DIMENSIONS = 1 << 18
FIT_ROWS = 8_000       # labelled rows for stem voters and classifier, chosen by a hash of the id
STEM_VOTERS = 8        # groups of learnt stems
STEMS_EACH = 20
LEAST_SEEN = 5         # sample documents a feature must occur in
THRESHOLD = 0.7
EDGES = ".,;:!?\"'()[]{}|*&%$#<>-_/\\"
BREAKS = str.maketrans({sign: " " for sign in EDGES})
STEM = 8               # letters of the longest stem; longer words have stems in each stretch of as many letters
LEXICON = {
    "en": ("idiot idiots moron morons stupid dumb trash scum loser losers pathetic worthless disgusting clown filth "
           "vermin imbecile freak creep liar coward bastard").split(),
    "de": "idiot dumm dummkopf abschaum trottel versager widerlich ekelhaft wertlos arschloch drecksack lügner".split(),
    "fr": "idiot imbécile crétin ordure salaud abruti minable dégoûtant connard pourriture lâche menteur".split(),
    "es": "idiota imbécil estúpido basura escoria cabrón patético asqueroso inútil payaso cobarde mentiroso".split(),
}
FIXED_VOTERS = len(LEXICON) + 1   # one per language, one for shouting
VOTERS = FIXED_VOTERS + STEM_VOTERS


def word_features(token: str) -> list[int]:
    """Dimensions of a word: itself, and the stems of 4 to 8 letters of each stretch of 8."""
    import xxhash
    parts = ["=" + token, *(token[at:at + n] for at in range(0, len(token), STEM) for n in range(4, min(len(token) - at, STEM) + 1))]
    return [xxhash.xxh3_64_intdigest(p.encode()) & (DIMENSIONS - 1) for p in parts]


def distinct_tokens(text: str | None) -> set[str]:
    return set((text or "").lower().translate(BREAKS).split())


class TokenTable(dict):
    """Value of a token, computed once per worker and remembered up to a bound."""

    def __init__(self, of, most: int = 400_000):
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, token: str):
        value = self.of(token)
        if len(self) < self.most:
            self[token] = value
        return value


# -- voters ------------------------------------------------------------------------------------------------------------
def learnt_stems(rows: list[np.ndarray], labels: np.ndarray) -> list[np.ndarray]:
    """Groups of dimensions tied most closely to label 1, dealt in turn so that groups are alike in strength."""
    seen = [np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)]
    for features, label in zip(rows, labels):
        seen[int(label)][np.unique(features)] += 1
    n1, n0 = max((labels == 1).sum(), 1), max((labels == 0).sum(), 1)
    odds = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
    strength = np.where((odds > 2) & (seen[1] >= 3), odds * np.sqrt(seen[1]), 0)
    best = np.argsort(-strength, kind="stable")[:STEM_VOTERS * STEMS_EACH]
    best = best[strength[best] > 0]
    return [best[k::STEM_VOTERS] for k in range(STEM_VOTERS)]


def token_votes(stems: list[np.ndarray]):
    lexicon = {word: sum(1 << k for k, words in enumerate(LEXICON.values()) if word in words)
               for words in LEXICON.values() for word in words}
    stem = {int(d): 1 << (FIXED_VOTERS + k) for k, group in enumerate(stems) for d in group}

    def of(token: str) -> int:
        votes = lexicon.get(token, 0)
        for d in word_features(token):
            votes |= stem.get(d, 0)
        return votes

    return of


def text_votes(text: str | None, table: TokenTable) -> int:
    """Bits of the voters that fire on a text."""
    votes = 0
    for v in set(map(table.__getitem__, distinct_tokens(text))):
        votes |= v
    text = text or ""
    if text.count("!") * 40 > len(text) or (len(text) > 20 and text.isupper()):
        votes |= 1 << len(LEXICON)
    return votes


# -- label model -------------------------------------------------------------------------------------------------------
@dataclass
class LabelModel:
    """Class shares, the parent of each voter, and P(vote | class, parent's vote)."""
    prior: np.ndarray
    parent: list[int]
    table: np.ndarray     # class x voter x parent's vote: probability that the voter fires
    label_accuracy: float

    def posterior(self, votes: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """P(class 1) for rows of 0/1 votes; ``labels`` -1 where the label voter abstains."""
        log = np.log(self.prior)[:, None].repeat(len(votes), axis=1)
        for v, p in enumerate(self.parent):
            given = votes[:, p] if p >= 0 else np.zeros(len(votes), dtype=np.int64)
            for c in (0, 1):
                fire = self.table[c, v, given]
                log[c] += np.log(np.where(votes[:, v] == 1, fire, 1 - fire))
        for c in (0, 1):
            log[c] += np.where(labels < 0, 0, np.log(np.where(labels == c, self.label_accuracy, 1 - self.label_accuracy)))
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))


def dependence_tree(votes: np.ndarray, weight: np.ndarray, post: np.ndarray) -> list[int]:
    """Parents by the largest spanning tree over mutual information given the class."""
    n = votes.shape[1]
    info = np.zeros((n, n))
    for w in (weight * (1 - post), weight * post):
        total = w.sum() + 1e-9
        for a in range(n):
            for b in range(a):
                for x in (0, 1):
                    for y in (0, 1):
                        joint = w[(votes[:, a] == x) & (votes[:, b] == y)].sum() / total
                        alone = (w[votes[:, a] == x].sum() / total) * (w[votes[:, b] == y].sum() / total)
                        if joint > 0 and alone > 0:
                            info[a, b] = info[b, a] = info[a, b] + joint * np.log(joint / alone) * total / weight.sum()
    parent, inside = [-1] * n, [0]
    while len(inside) < n:
        gain, child, p = max((info[i, o], o, i) for i in inside for o in range(n) if o not in inside)
        parent[child] = p if gain > 1e-6 else -1
        inside.append(child)
    return parent


def fit_label_model(votes: np.ndarray, labels: np.ndarray, weight: np.ndarray, rounds: int = 40) -> LabelModel:
    """EM from labels where there are some and from the number of firing voters elsewhere."""
    post = np.where(labels >= 0, labels, np.minimum(0.02 + 0.3 * votes.sum(axis=1), 0.95))
    model = None
    for step in range(rounds):
        parent = dependence_tree(votes, weight, post) if step in (0, rounds // 2) else model.parent
        table = np.zeros((2, votes.shape[1], 2))
        for c, w in enumerate((weight * (1 - post), weight * post)):
            for v, p in enumerate(parent):
                for given in (0, 1):
                    rows = votes[:, p] == given if p >= 0 else np.ones(len(votes), dtype=bool)
                    table[c, v, given] = (w[rows & (votes[:, v] == 1)].sum() + 0.1) / (w[rows].sum() + 1.0)
        prior = np.array([(weight * (1 - post)).sum() + 1, (weight * post).sum() + 1])
        known = labels >= 0
        right = (weight * np.where(labels == 1, post, 1 - post))[known].sum()
        accuracy = min(max((right + 20) / (weight[known].sum() + 21), 0.8), 0.995)
        model = LabelModel(prior / prior.sum(), parent, np.clip(table, 1e-4, 1 - 1e-4), float(accuracy))
        post = model.posterior(votes, labels)
    return model


# -- classifier --------------------------------------------------------------------------------------------------------
def logistic(rows: list[np.ndarray], target: np.ndarray, l2: float = 5e-4) -> tuple[np.ndarray, float]:
    """Linear classifier on soft labels over the features seen in at least LEAST_SEEN rows.

    A quarter of the rows is kept back to turn margins into probabilities.
    """
    seen = np.zeros(DIMENSIONS, dtype=np.int64)
    for row in rows:
        seen[np.unique(row)] += 1
    used = np.flatnonzero(seen >= LEAST_SEEN)
    column = np.full(DIMENSIONS, -1)
    column[used] = np.arange(len(used))
    rows = [c[c >= 0] for c in (column[row] for row in rows)]
    back = np.arange(len(rows)) % 4 == 3
    front = [row for row, kept in zip(rows, back) if not kept]
    flat = np.concatenate([*front, np.zeros(0, dtype=np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(len(front)), [len(r) for r in front])
    wanted = target[~back]

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        margin = np.clip(np.bincount(owner, x[:-1][flat], len(front)) + x[-1], -30, 30)
        slope = (1 / (1 + np.exp(-margin)) - wanted) / max(len(front), 1)
        value = float((np.logaddexp(0, margin) - wanted * margin).mean()) if len(front) else 0.0
        gradient = np.append(np.bincount(flat, slope[owner], len(used)) + l2 * x[:-1], slope.sum())
        return value + l2 / 2 * float(x[:-1] @ x[:-1]), gradient

    x = descend(loss, np.append(np.zeros(len(used)), -2.0))
    margins = np.array([x[:-1][row].sum() + x[-1] for row, kept in zip(rows, back) if kept])
    weights = np.zeros(DIMENSIONS)
    weights[used] = x[:-1]
    if back.sum() < 8:
        return weights, float(x[-1])
    toxic = target[back] > 0.5
    slope, offset = platt(margins, toxic.astype(np.int64))
    # Toxic rows are rare; half of their log-odds is given back, so that a toxic text is not held below the threshold.
    offset += 0.5 * float(np.log((1 + (~toxic).sum()) / (1 + toxic.sum())))
    return weights * slope, float(x[-1] * slope + offset)


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, float]:
    """Weights and bias. Vote patterns of all documents that are not held out are counted; the driver receives
    the patterns (at most 3 x 2^VOTERS) and the features of at most ``fit_rows`` labelled rows.

    Without labels only the fixed voters speak, and the classifier stays neutral (score below the threshold).
    """
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_state(("toxic features",), lambda: TokenTable(word_features, 150_000))
        for batch in batches:
            rows = [[d for t in distinct_tokens(x) for d in table[t]] for x in batch.column("text").to_pylist()]
            plain = TokenTable(token_votes([]))
            votes = [text_votes(x, plain) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(votes, pa.int32()),
                                              pa.array(rows, pa.list_(pa.int32()))], ["label", "votes", "features"])

    sample = fit_sample(docs, labels, column, fit_rows).select("doc_id", "text", "label")
    got = sample.mapInArrow(features, "label int, votes int, features array<int>").toArrow()
    y = got["label"].to_numpy().astype(np.int64)
    rows = [x.values.to_numpy() for x in got["features"]]
    stems = learnt_stems(rows, y)

    def votes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = TokenTable(token_votes(stems), 300_000)
        for batch in batches:
            votes = [text_votes(x.as_py(), table) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(votes, pa.int32())],
                                             ["doc_id", "votes"])

    voted = (docs.select("doc_id", "text").where(~held_out(F.col("doc_id")))
             .mapInArrow(votes_of, "doc_id long, votes int"))
    counted = (voted.join(label_rows(labels, column), "doc_id", "left")
               .groupBy("votes", F.coalesce("label", F.lit(-1)).alias("label")).count().toArrow())
    bits = lambda v: (v[:, None] >> np.arange(VOTERS)) & 1
    if not len(rows) or not counted.num_rows:
        return np.zeros(DIMENSIONS), -3.0
    model = fit_label_model(bits(counted["votes"].to_numpy().astype(np.int64)), counted["label"].to_numpy(),
                            counted["count"].to_numpy().astype(float))
    stem_bit = np.zeros(DIMENSIONS, dtype=np.int64)
    for k, group in enumerate(stems):
        stem_bit[group] |= 1 << (FIXED_VOTERS + k)
    votes = got["votes"].to_numpy().astype(np.int64) | np.array(
        [np.bitwise_or.reduce(stem_bit[r]) if len(r) else 0 for r in rows], dtype=np.int64)
    return logistic(rows, model.posterior(bits(votes), y))


def scorer(docs: DataFrame, weights: np.ndarray, bias: float):
    """Function from a text to its score; the weights are broadcast (DIMENSIONS floats)."""
    state = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def make():
        w = state.value
        table = TokenTable(lambda token: float(sum(w[d] for d in word_features(token))))

        def of(text: str | None) -> float:
            margin = sum(map(table.__getitem__, distinct_tokens(text))) + bias
            return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))

        return of

    return make


def score(docs: DataFrame, weights: np.ndarray, bias: float, threshold: float = THRESHOLD) -> DataFrame:
    """Score every whole text; one row per input row, a null or empty text included. No shuffle."""
    make = scorer(docs, weights, bias)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in batches:
            scores = [of(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(scores, pa.float64())],
                                             ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``threshold``."""
    make = scorer(docs, *fit(docs, labels, fit_rows=fit_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in batches:
            yield batch.filter(pa.array([of(x.as_py()) < threshold for x in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    return score(docs, *fit(docs, labels, fit_rows=fit_rows), threshold=threshold)
