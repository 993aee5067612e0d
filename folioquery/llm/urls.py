"""URL filters: rules, and for all other URLs a tree of path templates per host.

A template tree has the segments of a host's paths as branches. It grows level by level for all hosts at once:

* a segment is a branch of its own if a fair share of the node's URLs has it; all others are variable and fall into the
  wildcard of their shape (``{#digits}``, ``{#hex}``, ``{#mixed}``, ``{#file}``, ``{#word}``; no path holds a ``#``), so a node has a bounded number
  of branches however many ids it holds;
* branches that look alike are merged: by the Bayes factor of one common against two separate distributions of what
  follows them and of their labels. A branch with labels and one without say nothing about each other and stay apart;
* a branch is judged by its labelled purity, the share of blocked URLs among its labelled ones, smoothed towards the
  purity of its parent, that of a host towards the share of all labelled URLs.

URLs walk down the tree as it grows: one join with the nodes per level, in which rows of the few hottest nodes meet
them by broadcast. A node of few URLs is not split; its URLs end there.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from folioquery.llm.common import written

SHARE = 1 / 32           # share of a node's URLs that makes a segment a branch of its own
VARIABLE_SHARE = 1 / 4   # the same for segments that look like identifiers
SPLIT = 8                # URLs of a node that is split further
PRIOR = 2.0              # weight of the parent's purity, in labelled URLs
REJECT = 0.75            # smoothed purity from which a template is rejected
HOT = 256                # a key with more than this part of all rows is hot: there are fewer than HOT of them
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHAPES = {"{#digits}": "^[0-9]+$", "{#hex}": "^(?=.*[0-9])[0-9a-fA-F]{8,}$", "{#file}": "[.]", "{#mixed}": "[0-9]"}
VARIABLE = ("{#digits}", "{#hex}", "{#mixed}")
FOLLOWERS = ("end", "digits", "file", "other")


class Rule(NamedTuple):
    """``pattern`` is host/path: the host and its subdomains, and paths that start with the path."""
    verdict: str
    pattern: str


# -- parts of a URL ----------------------------------------------------------------------------------------------------
def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``,
    ``#`` or the end. Both empty for a null URL or one without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return (F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER),
            F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def ruled(host: Column, path: Column, rules: Iterable[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. Of rules with one pattern a blocking one counts."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(set(rules), key=lambda x: (len(x.pattern), x.pattern, x.verdict == "block")):
        name, slash, start = rule.pattern.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        out = F.when(fits, F.struct(F.lit(rule.pattern).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def shape(segment: Column) -> Column:
    out = F.lit("{#word}")
    for name, pattern in reversed(SHAPES.items()):
        out = F.when(segment.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def first_segment(rest: Column) -> Column:
    return F.regexp_extract(rest, "^[^/]*", 0)


def after_segment(rest: Column) -> Column:
    return F.ltrim(F.substring(rest, F.length(first_segment(rest)) + 1, F.length(rest)), F.lit("/"))


# -- joins with nodes --------------------------------------------------------------------------------------------------
def hot_join(rows: DataFrame, nodes: DataFrame, on: str, total: int) -> DataFrame:
    """Inner join of rows with their node. Nodes of more than a HOT-th of all rows, fewer than HOT, meet their rows by
    broadcast; the rows of all others are shuffled. ``nodes`` has a count ``node_n`` of its rows."""
    limit = max(1, total // HOT)
    hot = nodes.where(F.col("node_n") > limit)
    warm = rows.join(F.broadcast(hot), on)
    cold = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(nodes.where(F.col("node_n") <= limit), on)
    return warm.unionByName(cold)


# -- branches ----------------------------------------------------------------------------------------------------------
def log_beta(counts: Iterable[float]) -> float:
    """Log probability of counts under a uniform Dirichlet prior (up to a factor that a Bayes factor does not see)."""
    counts = list(counts)
    return sum(map(math.lgamma, (c + 1 for c in counts))) - math.lgamma(sum(counts) + len(counts)) + math.lgamma(len(counts))


def likeness(a: dict, b: dict) -> float:
    """Log Bayes factor for one common against two separate distributions of labels and of what follows."""
    def gain(x: list[float], y: list[float]) -> float:
        return log_beta([p + q for p, q in zip(x, y)]) - log_beta(x) - log_beta(y)

    labels = [[z["bad"], z["lab"] - z["bad"]] for z in (a, b)]
    return gain(*labels) + gain(*[[z[f] for f in FOLLOWERS] for z in (a, b)])


def merged_branches(branches: list[dict]) -> list[dict]:
    """Merge the most alike pair of branches while one is more likely alike than not; names in ``names``.

    Only branches of one kind are merged: both with labels, or both without."""
    left = dict(enumerate(sorted(branches, key=lambda x: x["names"])))

    def pairs(i: int, others: Iterable[int]) -> dict[tuple[int, int], float]:
        return {(min(i, j), max(i, j)): likeness(left[i], left[j]) for j in others
                if j != i and (left[i]["lab"] > 0) == (left[j]["lab"] > 0)}

    gains: dict[tuple[int, int], float] = {}
    for i in left:
        gains |= pairs(i, range(i))
    while gains:
        i, j = max(gains, key=lambda x: (gains[x], -x[0], -x[1]))
        if gains[i, j] <= 0:
            break
        b = left.pop(j)
        left[i] = {k: sorted(x + b[k]) if k == "names" else x + b[k] for k, x in left[i].items()}
        gains = {x: g for x, g in gains.items() if i not in x and j not in x} | pairs(i, left)
    return list(left.values())


def segment_counts(open_rows: DataFrame) -> DataFrame:
    """Per node and segment: URLs, labelled and blocked ones, and what follows the segment."""
    follows = first_segment(after_segment(F.col("rest")))
    kind = (F.when(follows == "", F.lit("end")).when(follows.rlike(SHAPES["{#digits}"]), F.lit("digits"))
            .when(follows.rlike(SHAPES["{#file}"]), F.lit("file")).otherwise(F.lit("other")))
    segment = first_segment(F.col("rest"))
    return (open_rows.select("node", "node_n", "purity", segment.alias("segment"), "lab", "bad", kind.alias("kind"))
            .groupBy("node", "node_n", "purity", "segment")
            .agg(F.count("*").alias("n"), F.sum("lab").alias("lab"), F.sum("bad").alias("bad"),
                 *(F.count(F.when(F.col("kind") == f, 1)).alias(f) for f in FOLLOWERS)))


def branches(counts: DataFrame, share: float, variable_share: float, prior: float) -> DataFrame:
    """(node, child, names, n, lab, bad, purity): the branches of every node. A node has at most 1 / share branches
    before merging, and one for each shape, so a group of this job is small."""
    form = shape(F.col("segment"))
    least = F.when(form.isin(*VARIABLE), variable_share).otherwise(share) * F.col("node_n")
    name = F.when((F.col("n") >= least) & (F.col("n") > 1), F.col("segment")).otherwise(form)
    sums = ["n", "lab", "bad", *FOLLOWERS]
    named = counts.withColumn("name", name).groupBy("node", "purity", "name").agg(*(F.sum(x).alias(x) for x in sums))

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        found = merged_branches([{"names": [row["name"]], **{x: int(row[x]) for x in sums}} for row in group.to_dict("records")])
        node, above = group["node"].iloc[0], float(group["purity"].iloc[0])
        rows = [(node, f"{node}/" + (x["names"][0] if len(x["names"]) == 1 else f"({'|'.join(x['names'])})"), x["names"], x["n"],
                 x["lab"], x["bad"], (x["bad"] + prior * above) / (x["lab"] + prior)) for x in found]
        return pd.DataFrame(rows, columns=["node", "child", "names", "n", "lab", "bad", "purity"])

    return named.groupBy("node").applyInPandas(
        merge, "node string, child string, names array<string>, n long, lab long, bad long, purity double")


def template_tree(urls: DataFrame, share: float = SHARE, variable_share: float = VARIABLE_SHARE, split: int = SPLIT,
                  prior: float = PRIOR) -> tuple[DataFrame, DataFrame]:
    """(urls with ``template`` and ``purity``, templates).

    ``urls`` needs host, path and ``bad`` (1 blocked, 0 allowed, null without a label); its other columns stay, but for
    those named node, node_n, purity, rest, lab and template. Empty segments do not count. ``templates``: template
    (host and path), n, lab, bad, purity, for the host itself and every branch below it.
    """
    start = written(urls.withColumns({"node": F.col("host"), "rest": F.ltrim("path", F.lit("/")),
                                      "lab": F.col("bad").isNotNull().cast("long"), "bad": F.coalesce("bad", F.lit(0)).cast("long")}))
    total, labelled, blocked = start.agg(F.count("*"), F.coalesce(F.sum("lab"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    overall = (blocked + prior / 2) / (labelled + prior)
    roots = written(start.groupBy("node").agg(F.count("*").alias("node_n"), F.sum("lab").alias("l"), F.sum("bad").alias("b"))
                    .withColumn("purity", (F.col("b") + prior * overall) / (F.col("l") + prior)))
    nodes = [roots.select(F.col("node").alias("template"), F.col("node_n").alias("n"), F.col("l").alias("lab"), F.col("b").alias("bad"), "purity")]
    state = written(hot_join(start, roots.drop("l", "b"), "node", total))
    ends = []
    while True:
        goes_on = (F.col("rest") != "") & (F.col("node_n") >= split)
        ends.append(state.where(~goes_on))
        state = state.where(goes_on)
        if state.isEmpty():
            break
        below = written(branches(segment_counts(state), share, variable_share, prior))
        nodes.append(below.select(F.col("child").alias("template"), "n", "lab", "bad", "purity"))
        # One row per node: a map from the names of its branches, bounded as the branches are.
        entry = F.struct("child", F.col("n").alias("node_n"), "purity")
        maps = (below.select("node", "n", F.explode("names").alias("name"), entry.alias("entry")).groupBy("node")
                .agg(F.map_from_entries(F.collect_list(F.struct("name", "entry"))).alias("below")))
        sizes = state.groupBy("node").agg(F.first("node_n").alias("node_n"))
        segment = first_segment(F.col("rest"))
        entry = F.coalesce(F.try_element_at("below", segment), F.element_at("below", shape(segment)))
        walked = hot_join(state.drop("node_n", "purity"), maps.join(sizes, "node"), "node", total)
        state = written(walked.withColumn("entry", entry).withColumns(
            {"node": F.col("entry.child"), "node_n": F.col("entry.node_n"), "purity": F.col("entry.purity"),
             "rest": after_segment(F.col("rest"))}).drop("entry", "below"))
    out = reduce(DataFrame.unionByName, ends).withColumnRenamed("node", "template").drop("node_n", "rest", "lab")
    return out, reduce(DataFrame.unionByName, nodes)


def judged_urls(pages: DataFrame, rules: Iterable[Rule], labels: DataFrame | None = None, reject: float = REJECT,
                id_column: str = "page_id", **options) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity: one row per row of ``pages``.

    ``pages`` needs ``page_id`` and ``url``; other columns are ignored. The longest rule that fits decides. All other
    URLs are judged by their template: ``block`` if its smoothed purity is ``reject`` or more, else ``allow``. What is
    learnt from are the URLs that rules decide and, with ``labels`` (page_id, blocked boolean, one row per page), those.
    Null URLs and URLs without ``://`` share the template of the empty host and path; without any label every URL that no
    rule fits is allowed (a share of one half, which is below ``reject``). ``options`` go to ``template_tree``.
    """
    host, path = host_and_path(F.col("url"))
    urls = (pages.select(F.col(id_column).alias("page_id"), F.col("url").cast("string").alias("url"))
            .select("page_id", host.alias("host"), path.alias("path"))
            .withColumn("ruled", ruled(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "ruled.rule", "ruled.verdict"))
    bad = (F.col("verdict") == "block").cast("int")
    if labels is not None:
        known = labels.groupBy(F.col(id_column).alias("page_id")).agg(F.max("blocked").alias("blocked"))
        urls, bad = urls.join(known, "page_id", "left"), F.coalesce(bad, F.col("blocked").cast("int"))
    judged, _ = template_tree(urls.withColumn("bad", bad).drop("blocked"), **options)
    own = F.when(F.col("purity") >= reject, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "template", "purity")
