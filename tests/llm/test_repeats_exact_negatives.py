"""Periodic runs, exact copies and hard negatives against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pacemark.llm import exact, negatives, queries, repeats

BLANKS = " \t\n\v\f\r"


def plain_runs(words, exponent=4, length=6):
    """All maximal stretches with the period p, for every p; the smallest period of a stretch counts."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        at = p
        while at < n:
            end = at
            while end < n and words[end] == words[end - p]:
                end += 1
            if end - at >= p:
                found.setdefault((at - p, end), p)
            at = end + 1
    return sorted(
        ((a, b - a, p) for (a, b), p in found.items() if b - a >= max(length, exponent * p)),
        key=lambda r: (r[0], r[2]),
    )


def periodic_words(rng):
    n = rng.randrange(0, 120)
    words = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(n)]
    for _ in range(rng.randrange(3)):
        if n > 4:
            p, a = rng.randrange(1, n // 2), rng.randrange(n)
            for i in range(a + p, min(n, a + p + rng.randrange(n))):
                words[i] = words[i - p]
    return words


@pytest.mark.parametrize("exponent, length", [(2, 1), (3, 4), (4, 6)])
def test_runs_of_random_words(exponent, length):
    rng = random.Random(exponent)
    for _ in range(700):
        words = periodic_words(rng)
        want = plain_runs(words, exponent, length)
        assert repeats.runs_of(words, exponent, length) == want
        catchers, seq = repeats.Catchers(exponent), repeats.numbers(words)
        while len(seq):  # appended in pieces of any size
            piece = rng.choice([1, 1, 2, 5, 40])
            catchers.append(seq[:piece])
            seq = seq[piece:]
        assert catchers.runs(length) == want


def test_runs_known_as_soon_as_they_are_there():
    words = [b"x", b"y"] * 6 + [b"z"]
    catchers, seq = repeats.Catchers(), repeats.numbers(words)
    for n in range(1, len(seq) + 1):
        catchers.append(seq[n - 1 : n])
        assert catchers.runs() == plain_runs(words[:n])


def test_long_runs_take_near_linear_time():
    n = 100_000
    assert repeats.runs_of([b"a"] * n) == [(0, n, 1)]
    line = [b"w%d" % i for i in range(n // 10)]
    assert repeats.runs_of(line * 10) == [(0, n, n // 10)]
    assert repeats.runs_of([b"u%d" % i for i in range(n)]) == []


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for a, l, p in runs for i in range(a + p, a + l)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(runs, key=lambda r: (-(r[1] * 10**9 // r[2]), r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{a},{l},{p}\n" for a, l, p in runs)
    return (
        doc_id, len(runs), *best, None if not runs else 1000 * best[1] // best[2],
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
    )


def test_periodic_runs_query(docs_of, tmp_path, spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(BLANKS).join(w.decode() for w in periodic_words(rng))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, BLANKS), (None, "a " * 9), (7, rows[7][1]), (7, rows[7][1]), (203, "é é " * 8)]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns[:6] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli"]
    assert Counter(tuple(r) for r in got.collect()) == Counter(plain_row(*r) for r in rows)
    assert repeats.find(docs_of([])).count() == 0


def test_runs_and_collapsed_text(docs_of):
    row = repeats.find(docs_of([(1, "go on on on on on on stop")])).first()
    assert [tuple(r) for r in row.runs] == [(1, 6, 1)] and tuple(row.best) == (1, 6, 1)
    assert bytes(row.collapsed) == b"go on stop"


# --- exact copies


def copies(seed=1):
    rng = random.Random(seed)
    long = "x" * 300
    texts = ["", None, "a", "A", "b", " a", "é", "é", long + "1", long + "2", "y" + long, "z" * 301]
    rows = [(i, rng.choice(texts)) for i in range(200)]
    rows += [(1000 + i, "hot") for i in range(100)]
    return rows + [(1000, "hot"), (None, "hot"), (None, "no id"), (None, "no id"), (3, "a"), (3, "b")]


def plain_groups(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for doc_id, text in rows:
        ids = groups[text or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((doc_id, keep, len(ids), doc_id == keep, len((text or "").encode())))
    return out


@pytest.mark.parametrize("rows", [copies(), [], [(1, None)], [(1, "a" * 2_000_000), (2, "a" * 2_000_000)]])
@pytest.mark.parametrize("sent", [exact.SENT_KEYS, 3, 0])
def test_exact_groups(docs_of, rows, sent, monkeypatch):
    monkeypatch.setattr(exact, "SENT_KEYS", sent)  # with few keys by broadcast, with many by shuffle
    got = exact.groups(docs_of(rows)).select("doc_id", "keep_id", "group_size", "kept", "n_bytes")
    assert Counter(tuple(r) for r in got.collect()) == Counter(plain_groups(rows))


def test_full_hash_only_where_length_and_prefix_came_up_again(docs_of):
    p = "p" * exact.PREFIX
    rows = docs_of([(1, "one"), (2, "two"), (3, "three"), (4, p + "a"), (5, p + "b"), (6, "same"), (7, "same")])
    hashed = {r.doc_id for r in exact.refined(rows).where("full is not null").collect()}
    assert hashed == {4, 5, 6, 7}
    assert exact.refined(rows, every_hash=True).where("full is null").count() == 0


# --- hard negatives


def plain_negatives(rows, positives=5, negatives_=3):
    """Rows are (id, vector, label)."""
    fit = [
        (i, [math.floor(256 * x) for x in v], l)
        for i, v, l in rows
        if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    asked = {}
    for i, v, l in fit:
        if i % 50 == 0:
            asked[i] = min(asked.get(i, (l, len(v), v)), (l, len(v), v))
    out = []
    for a, (l, _, v) in asked.items():
        scored = [(-sum(x * y for x, y in zip(v, w)), i, k) for i, w, k in fit if i != a and len(w) == len(v)]
        for ps, p, _ in sorted(s for s in scored if s[2] == l)[:positives]:
            fits = sorted(s for s in scored if s[2] != l and -50 * ps <= -100 * s[0] <= -95 * ps)
            out += [(a, p, n + 1, i, -ps, -s) for n, (s, i, _) in enumerate(fits[:negatives_])]
    return out


def mined(df):
    out = df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return Counter(tuple(r) for r in out.collect())


def some_vectors(seed, n=400, labels=3):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal(8)
    rows = [(i, np.round(base + rng.standard_normal(8), 2).tolist(), int(rng.integers(labels))) for i in range(n)]
    bad = [None, [], [1.0, None] + [0.0] * 6, [math.nan] + [1.0] * 7, [math.inf] + [1.0] * 7, [1.0, 2.0], [0.0] * 8]
    rows += [(1000 + 50 * i, v, 1) for i, v in enumerate(bad)]
    rows += [(None, rows[0][1], 1), (2000, rows[0][1], None), (50, rows[3][1], 2), (7, rows[7][1], rows[7][2])]
    return rows + [(3000 + i, rows[1][1], 0) for i in range(150)]  # many equal scores


@pytest.mark.parametrize("rows", [some_vectors(1), some_vectors(2, 250, 2), [], [(50, [1.0], 1)], [(1, None, None)]])
@pytest.mark.parametrize("blocks", [(2_048, 8_192), (2, 64)])
def test_hard_negatives(vectors_of, rows, blocks):
    got = negatives.mine(vectors_of(rows), F.col("id") % 50 == 0, anchor_rows=blocks[0], candidate_rows=blocks[1])
    assert mined(got) == Counter(plain_negatives(rows))


def test_components_beyond_bigint(vectors_of):
    rows = [(0, [1e9, 3.0], 0), (1, [2.0, 1.0], 0), (2, [1.5, -2.0], 1), (50, [1e30, 1.0], 0), (3, [1e-30, 0.5], 1)]
    got = negatives.mine(vectors_of(rows), F.col("id") % 50 == 0)
    limit = negatives.LIMIT
    ended = [(a, p, r, n, min(limit, ps), ns) for a, p, r, n, ps, ns in plain_negatives(rows)]
    assert mined(got.where("positive_score < 9223372036854775807")) == Counter(e for e in ended if e[4] < limit)


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 7), (64, 64, 64), (65, 33, 130), (200, 64, 90), (5, 300, 2)])
def test_strassen(shape):
    m, k, n = shape
    rng = np.random.default_rng(m)
    a, b = rng.integers(-(2**20), 2**20, (m, k)), rng.integers(-(2**20), 2**20, (n, k))
    assert (negatives.multiply(a, b, leaf=4) == a @ b.T).all()
    assert (negatives.multiply(a.astype(object), b.astype(object), leaf=32) == a @ b.T).all()
    wide = rng.integers(-(2**62), 2**62, (m, k))  # sums inside the recursion leave int64, the scores do not
    unit = np.zeros((n, k), np.int64)
    unit[np.arange(n), np.arange(n) % k] = 1
    assert (negatives.multiply(wide, unit, leaf=2) == wide @ unit.T).all()


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(4)
    key, score, ids = rng.integers(0, 6, 500), rng.integers(-9, 9, 500), rng.permutation(500)
    want = [(k, s, i) for k in range(6) for s, i in
            [(-s, i) for s, i in sorted((-s, i) for q, s, i in zip(key, score, ids) if q == k)[:4]]]
    for seed in range(3):
        heaps, order = negatives.Heaps(7, 4), np.random.default_rng(seed).permutation(500)
        for part in np.array_split(order, 9):
            heaps.merge(key[part], score[part], ids[part])
        assert list(zip(*(x.tolist() for x in heaps.entries()))) == want
