"""URL filters against a tree grown one host at a time."""

import random
import re
from collections import defaultdict

import pytest

from folioquery.llm import urls
from folioquery.llm.queries import URL_RULES

PAGES = "page_id long, url string, host string, verdict int, n long"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, "x", 1, 2) for i, u in enumerate(rows)], PAGES).repartition(3)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split("[?#]", rest[len(host):])[0]


def rule_of(host, path, rules):
    best = (None, None)
    for verdict, pattern in rules:
        name, _, start = pattern.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and len(pattern) > len(best[0] or ""):
            best = (pattern, verdict)
    return best


def shape(segment):
    if re.fullmatch("[0-9]+", segment):
        return "{#digits}"
    if re.fullmatch("[0-9a-fA-F]{8,}", segment) and re.search("[0-9]", segment):
        return "{#hex}"
    return "{#file}" if "." in segment else "{#mixed}" if re.search("[0-9]", segment) else "{#word}"


def follower(segments, depth):
    if depth + 1 >= len(segments):
        return "end"
    return {"{#digits}": "digits", "{#file}": "file"}.get(shape(segments[depth + 1]), "other")


def grow(rows, node, purity, depth, out):
    """rows: (id, segments, label); write (template, purity) of each id to ``out``."""
    if len(rows) < urls.SPLIT:
        out.update({i: (node, purity) for i, _, _ in rows})
        return
    out.update({i: (node, purity) for i, s, _ in rows if len(s) <= depth})
    below = [r for r in rows if len(r[1]) > depth]
    seen = defaultdict(int)
    for _, s, _ in below:
        seen[s[depth]] += 1
    named = defaultdict(list)
    for row in below:
        name, form = row[1][depth], shape(row[1][depth])
        least = urls.VARIABLE_SHARE if form in urls.VARIABLE else urls.SHARE
        named[name if seen[name] >= least * len(rows) and seen[name] > 1 else form].append(row)
    stats = []
    for name, mine in named.items():
        labels = [x for *_, x in mine if x is not None]
        follows = [follower(s, depth) for _, s, _ in mine]
        stats.append({"names": [name], "n": len(mine), "lab": len(labels), "bad": sum(labels), **{f: follows.count(f) for f in urls.FOLLOWERS}})
    for x in urls.merged_branches(stats):
        mine = [r for name in x["names"] for r in named[name]]
        title = x["names"][0] if len(x["names"]) == 1 else f"({'|'.join(x['names'])})"
        grow(mine, f"{node}/{title}", (x["bad"] + urls.PRIOR * purity) / (x["lab"] + urls.PRIOR), depth + 1, out)


def brute(rows, rules):
    hosts, out, found = defaultdict(list), [], {}
    for i, url in enumerate(rows):
        host, path = parts(url)
        rule, verdict = rule_of(host, path, rules)
        hosts[host].append((i, [s for s in path.split("/") if s], None if verdict is None else int(verdict == "block")))
        out.append([i, host, path, rule, verdict])
    labels = [x for mine in hosts.values() for *_, x in mine if x is not None]
    overall = (sum(labels) + urls.PRIOR / 2) / (len(labels) + urls.PRIOR)
    for host, mine in hosts.items():
        known = [x for *_, x in mine if x is not None]
        grow(mine, host, (sum(known) + urls.PRIOR * overall) / (len(known) + urls.PRIOR), 0, found)
    for row in out:
        template, purity = found[row[0]]
        row[4] = row[4] or ("block" if purity >= urls.REJECT else "allow")
        row += [template, round(purity, 9)]
    return sorted(map(tuple, out), key=repr)


def run(spark, rows, rules, **options):
    return sorted((tuple(r)[:-1] + (round(r.purity, 9),) for r in urls.judged_urls(pages(spark, rows), rules, **options).collect()), key=repr)


def some_urls(size, seed=2):
    rng = random.Random(seed)
    hosts = ["a.example.com", "A.Example.com", "b.example.org", "example.net", "www.shop.example.net", "com", "xexample.org"]
    rows = []
    for _ in range(size):
        path = "/" + rng.choice(["en", "fr", "de", "es", "blog/2024", "tag", "p%20q", f"u{rng.randrange(9999)}"])
        path += "/" + rng.choice([str(rng.randrange(1000)), f"{rng.getrandbits(64):016x}", "index.html", f"{rng.randrange(99)}.html", "about", ""])
        path += rng.choice(["", "", "/", "/spam/buy", "//x"]) + rng.choice(["", "?q=/fr/1", "#top://x/y"])
        rows.append(f"{rng.choice(['http', 'https', ''])}://{hosts[min(rng.randrange(20), 6)] if rng.random() < .8 else hosts[0]}{path}")
    return rows


def test_equals_a_tree_grown_one_host_at_a_time(spark):
    rows = some_urls(700) + [None, "", "no scheme/fr/", "http://", "x://y://z/de/", "http://a.example.com", "http://a.example.com/" + "d/" * 5000 + "é" * 9,
                             "http://org/\nfr/1", "http://com:80/fr/", "http://net?x/fr/"] + ["http://one.example.com/fr/same"] * 300
    got = run(spark, rows, URL_RULES)
    assert got == brute(rows, URL_RULES)
    assert {r[4] for r in got} == {"allow", "block"}


def test_templates_of_a_host(spark):
    rows = ([f"http://h.net/item/{i}" for i in range(40)] + [f"http://h.net/user/{i}x/page" for i in range(40)]
            + [f"http://h.net/goods/{i}" for i in range(40)])
    blocked = spark.createDataFrame([(i, True) for i in range(40, 60)] + [(i, False) for i in range(0, 20)] + [(i, False) for i in range(80, 99)],
                                    "page_id long, blocked boolean")
    got = run(spark, rows, [], labels=blocked)
    assert {(r[5], r[4]) for r in got} == {("h.net/(goods|item)/{#digits}", "allow"), ("h.net/user/{#mixed}/page", "block")}


def test_odd_tables(spark):
    assert run(spark, [], URL_RULES) == []
    assert [r[4] for r in run(spark, [None, None, "http://x.net/a"], URL_RULES)] == ["allow"] * 3
    assert run(spark, ["http://x.org/a/b"] * 50, [urls.Rule("block", "org/"), urls.Rule("allow", "org/")])[0][3:5] == ("org/", "block")


@pytest.mark.parametrize("hot", [2, 256])
def test_hot_hosts_meet_their_nodes_by_broadcast(spark, monkeypatch, hot):
    monkeypatch.setattr(urls, "HOT", hot)
    rows = [f"http://big.net/{'en' if i % 3 else 'fr'}/{i}" for i in range(300)] + some_urls(100, 5)
    assert run(spark, rows, URL_RULES) == brute(rows, URL_RULES)
