"""Embeddings and URLs against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pacemark.llm import base, embeddings, topk, urls

BAD = [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [math.nan] + [1.0] * 7, [math.inf] + [1.0] * 7, [1.0, 2.0]]


def vectors(seed=1, n=120, groups=6):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((groups, 8))
    rows = []
    for i in range(n):
        near = i % 3 == 0
        v = centers[i % groups] + 0.15 * rng.standard_normal(8) if near else rng.standard_normal(8)
        rows.append((i, np.round(v, 3).tolist(), int(rng.integers(0, 3))))
    rows += [(500 + i, v, 1) for i, v in enumerate(BAD)] + [(600, rows[0][1], None), (700, rows[3][1], rows[3][2])]
    rows += [(3, rows[3][1], rows[3][2]), (3, rows[4][1], rows[4][2]), (None, rows[3][1], rows[3][2])]
    return rows


def fits(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def plain_links(rows, cosine=0.93):
    n = len(rows)
    ok = [i is not None and fits(v) and any(v) and l is not None for i, v, l in rows]
    near = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(a):
            (_, v, k), (_, w, l) = rows[a], rows[b]
            if ok[a] and ok[b] and k == l and len(v) == len(w):
                x, y = np.array(v), np.array(w)
                near[a, b] = near[b, a] = x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= cosine
    root = list(range(n))
    for a, b in zip(*np.nonzero(near)):
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    least = {r: min((rows[i][0] for i in range(n) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    return [(i, int(near[a].sum()), least[root[a]], i is not None and i == least[root[a]]) for a, (i, _, _) in enumerate(rows)]


@pytest.mark.parametrize("rows", [vectors(), vectors(2, 300, 2), [], [(1, None, 1), (2, [1.0], None)]])
def test_embedding_links_and_components(vectors_of, rows):
    found = embeddings.near_duplicates(vectors_of(rows))
    got = Counter(tuple(r) for r in found.select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == Counter(plain_links(rows))


def test_groups_larger_than_window_and_block(vectors_of, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    rng = np.random.default_rng(3)
    center = rng.standard_normal(16)
    rows = [(i, (center + 0.1 * rng.standard_normal(16)).tolist(), 1) for i in range(200)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(150)]  # copies
    found = embeddings.near_duplicates(vectors_of(rows), window=8)
    got = Counter(tuple(r) for r in found.select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == Counter(plain_links(rows))


def test_passes_follow_the_table():
    assert embeddings.passes_for(100) <= embeddings.passes_for(10**6) <= embeddings.passes_for(10**9) < 2_000


def test_components_of_paths_and_stars(spark):
    rnd = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1200)] + [(5, 5), (-3, 9), (9, -3)]
    rnd.shuffle(links)
    got = {r.node: r.root for r in base.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(101, 161)} == {100} and {got[i] for i in range(1000, 1200)} == {7} and got[9] == -3
    assert base.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_numbered(spark):
    df = spark.createDataFrame([(x,) for x in [3, 1, None, 2, 2, 9] * 50], "x int").repartition(7)
    got = [(r.pos, r.x) for r in base.numbered(df, F.col("x").asc_nulls_last()).orderBy("pos").collect()]
    assert [p for p, _ in got] == list(range(300))
    assert [x for _, x in got] == sorted((x for _, x in got), key=lambda x: (x is None, x))


def plain_top(rows, k):
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows if i is not None and fits(v)]
    asked = {}
    for i, v, _ in rows:
        if i is not None and fits(v) and i % 20 == 0 and (i not in asked or (len(v), v) < asked[i]):
            asked[i] = (len(v), v)
    out = []
    for q, (_, v) in asked.items():
        own = [math.floor(1024 * x) for x in v]
        scores = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(own, w)))), i) for i, w in whole if i != q and len(w) == len(own)]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize("rows", [vectors(4, 200), [], vectors(5, 40) + [(800, [1e30] + [0.5] * 7, 1), (801, [-1e30] + [0.5] * 7, 1)]])
def test_top_k(vectors_of, rows):
    found = topk.top_k(vectors_of(rows), F.col("id") % 20 == 0, query_rows=3, candidate_rows=50)
    got = Counter(tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect())
    assert got == Counter(plain_top(rows, 10))


LISTED = [
    urls.site("allow", "com/"), urls.site("block", "example.com/en/"), urls.site("allow", "www.example.com/en/"),
    urls.site("block", "net/es/"), urls.site("block", "net/fr/"),
]
URLS = [
    ("http://a.Example.com/en/1?x=/en/", "example.com/en/", "block"), ("https://www.example.com/en/2#t", "www.example.com/en/", "allow"),
    ("https://www.example.com/EN/2", "com/", "allow"), ("http://example.com", None, "allow"), ("http://xexample.com/en/", "com/", "allow"),
    ("ftp://b.net/fr/", "net/fr/", "block"), ("x://b.net/frx", None, "allow"), ("b.net/fr/", None, "allow"), (None, None, "allow"), ("", None, "allow"),
    ("http://spam-x.org/a", None, "block"), ("http://q.spam-x.org/a", None, "block"), ("http://q.spamx.org/a", None, "allow"), ("a://b://c.com/", None, "allow"),
    ("http://com/", "com/", "allow"), ("http://É.COM/", "com/", "allow"), ("http://spam-x.com/", "com/", "allow"), ("http://x.org/" + "a/" * 20_000, None, "allow"),
]


def test_url_rules(spark):
    rules = [*LISTED, urls.glob("block", "spam-*"), urls.glob("block", "*.spam-*")]
    rows = [(i, u, "h", "r") for i, (u, _, _) in enumerate(URLS)] * 2 + [(None, "http://b.net/es/", "h", "r")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, rule string").repartition(3)
    got = Counter((r.page_id, r.rule, r.verdict) for r in urls.judge(pages, rules).collect())
    assert got == Counter([(i, r, v) for i, (_, r, v) in enumerate(URLS)] * 2 + [(None, "net/es/", "block")])
    assert urls.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judge(pages, []).collect()} == {"allow"}


def test_index_by_rarest_token_loses_no_rule():
    rnd = random.Random(1)
    names = ["a", "bb", "c1", "ads", "x"]
    rules = [urls.glob("block", "*".join("/".join(rnd.choices(names, k=2)) for _ in range(rnd.randint(1, 3)))) for _ in range(60)]
    rules += [urls.glob("block", "*ads*"), urls.site("block", "x/a"), urls.site("block", "bb.c1/ads")]
    index = urls.Index(rules, {n: rnd.randint(0, 9) for n in names})
    import re

    for _ in range(2_000):
        host, path = rnd.choice(names) + "." + rnd.choice(names), "/" + "/".join(rnd.choices(names, k=3))
        fit = [r for r in index.rules if re.search(r.pattern, host + path)]
        assert index.find(host, path) == (fit[0] if fit else None)


FILTERS = [
    ("||ads.net^", "block", ["ads.net", "ads.net/x", "a.ads.net/x", "ADS.net:80/"], ["bads.net/", "ads.net.org/", "x.org/ads.net/"]),
    ("||b.org/track", "block", ["b.org/tracker", "x.b.org/Track/1"], ["b.org/a/track", "bb.org/track"]),
    ("/banner/*/img^", "block", ["a.b/banner/1/img", "a.b/banner/x/y/img?"], ["a.b/banner/img", "a.b/banner/1/imgs"]),
    ("|https://shop.", "block", ["shop.de/x"], ["a.shop.de/"]),
    (".swf|", "block", ["a.b/c.swf", "a.b/c.SWF"], ["a.b/c.swf/d", "a.b/cswf"]),
    ("@@||good.net^*/ok", "allow", ["good.net/a/ok", "c.good.net/ok/ok"], ["good.net", "good.net/o"]),
    ("-ad-", "block", ["x.y/a-ad-b"], ["x.y/a-bad-b"]),
]


def test_filter_lines():
    import re

    for line, action, fit, unfit in FILTERS:
        rule = urls.filter_line(line)
        assert (rule.action, rule.listed) == (action, False)
        assert all(re.search(rule.pattern, x) for x in fit) and not any(re.search(rule.pattern, x) for x in unfit), line
    none = [None, "", "! note", "[Adblock Plus 2.0]", "a.de##.ad", "a.de#@#.ad", "||x.de^$third-party", "/ad[0-9]/", "*", "||", "@@"]
    assert not any(map(urls.filter_line, none))


def test_filter_lists_against_trying_every_rule(spark):
    import re

    rnd = random.Random(3)
    names = [a + b for a in ["ad", "Pix", "cdn", "x", "\u0130k", "\u212a"] for b in ["", "s", "7", "Z"]] + [f"w{i}" for i in range(300)]
    some = lambda marks, n: "".join(rnd.choice(names) + rnd.choice(marks) for _ in range(n))
    lines = [
        rnd.choice(["", "", "|", "||", "@@||", "@@"]) + some(["/", "^", "*", ".", "-", ""], rnd.randint(1, 4)) + rnd.choice(["", "|", "^"])
        for _ in range(4_000)
    ]
    table = spark.createDataFrame([(x,) for x in [*lines, *lines[:50], "! note", None]], "line string")
    rules = urls.filter_rules(table)
    assert {r.name for r in rules} == {x for x in lines if urls.filter_line(x)} and len(rules) > 3_000
    found = [(i, "http://" + some([".", "-", ""], 3) + ".net/" + some(["/", "-", ".", "?", ""], 4)) for i in range(300)]
    pages = spark.createDataFrame([*found, (300, None)], "page_id bigint, url string")
    compiled = [(r, re.compile(r.pattern)) for r in rules]
    want = {300: ("allow", None)}
    for i, url in found:
        text = "".join(urls.split_url(url))
        fit = [r for r, p in compiled if p.search(text)]
        best = min(fit, key=lambda r: (r.action != "allow", -len(r.name), r.name), default=None)
        want[i] = (best.action, best.name) if best else ("allow", None)
    assert {r.page_id: (r.verdict, r.pattern) for r in urls.judge(pages, rules).collect()} == want
    assert sum(p is not None for _, p in want.values()) > 50
    assert urls.filter_rules(table.limit(0)) == []


def crowd(n, pairs, aside, dim=32, seed=5):
    """Vectors of one label around one direction, at a mutual cosine of about 1 - aside**2, and pairs just linked."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    center = unit(rng.standard_normal(dim))
    out = unit(rng.standard_normal((n, dim)))
    x = unit(math.sqrt(1 - aside**2) * center + aside * out)
    to = rng.standard_normal((pairs, dim))
    to = unit(to - (to * x[:pairs]).sum(axis=1, keepdims=True) * x[:pairs])
    x = np.concatenate([x, 0.935 * x[:pairs] + math.sqrt(1 - 0.935**2) * to])
    return [(i, v.tolist(), 1) for i, v in enumerate(x)]


def crowd_links(rows, cosine=0.93):
    """As `plain_links`, of vectors of one label whose ids are their places."""
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    least = np.arange(len(x))
    while True:
        lower = np.minimum(least, np.where(near, least[None, :], len(x)).min(axis=1))
        if (lower == least).all():
            return [(i, int(near[i].sum()), int(c), i == c) for i, c in enumerate(least)]
        least = lower


def linked(df):
    return [tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()]


def test_crowded_label_is_linked_in_full(vectors_of):
    rows = crowd(2_500, 100, 0.32)
    want = Counter(crowd_links(rows))
    assert Counter(linked(embeddings.near_duplicates(vectors_of(rows)))) == want
    assert Counter(linked(embeddings.near_duplicates(vectors_of(rows[:1_500]), complete=True))) == Counter(crowd_links(rows[:1_500]))


def test_passes_go_on_until_made_pairs_are_met(vectors_of, monkeypatch):
    monkeypatch.setattr(embeddings, "PATIENCE", 20)
    monkeypatch.setattr(embeddings, "PROBES", 500)
    rows = crowd(1_500, 60, 0.6)
    begun, real = [], embeddings.hashes
    monkeypatch.setattr(embeddings, "hashes", lambda *a, **k: begun.append(a[1]) or real(*a, **k))
    got, want = linked(embeddings.near_duplicates(vectors_of(rows), window=16)), crowd_links(rows)
    assert sum(begun) > embeddings.passes_for(len(rows), window=16)
    assert len(set(got) & set(want)) >= 0.99 * len(want)


def test_a_label_too_crowded_for_passes_is_compared_in_full(vectors_of, monkeypatch):
    monkeypatch.setattr(embeddings, "PATIENCE", 1)
    rows = crowd(1_500, 60, 0.32)
    begun, real = [], embeddings.hashes
    monkeypatch.setattr(embeddings, "hashes", lambda *a, **k: begun.append(a[1]) or real(*a, **k))
    assert Counter(linked(embeddings.near_duplicates(vectors_of(rows), window=16))) == Counter(crowd_links(rows))
    assert begun
