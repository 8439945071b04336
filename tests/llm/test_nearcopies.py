"""Near copies by shingle sets against brute force over all pairs."""

import random
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from pacemark.llm import nearcopies, simhash
from test_texts import awkward, groups


def plain_set(text, shingle=5):
    words = (text or "").encode().lower().split()
    if len(words) < shingle:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + shingle]) for i in range(len(words) - shingle + 1))


def similar(a, b, at=0.8):
    return a == b or len(a & b) >= at * len(a | b)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def crowd(seed=3):
    """A third of all rows are near copies of one text; others come in twos and threes, or alone."""
    rng = random.Random(seed)
    text = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    base, rows = text(150), []
    rows += [(i, edited(rng, base, rng.randrange(4))) for i in range(100)]
    for i in range(100, 200, 2):
        own = text(rng.choice([20, 60, 200]))
        rows += [(i, " ".join(own)), (i + 1, edited(rng, own, rng.randrange(1, 4)))]
    rows += [(i, " ".join(text(rng.choice([3, 8, 40, 120])))) for i in range(200, 300)]
    rng.shuffle(rows)
    return rows


def expected(rows, at=0.8, shingle=5):
    sets = [plain_set(t, shingle) for _, t in rows]
    return groups([i for i, _ in rows], lambda a, b: similar(sets[a], sets[b], at))


def found(docs, **how):
    return Counter((r.doc_id, r.component_id) for r in nearcopies.near_copies(docs, **how).collect())


def held_against_brute_force(rows, docs, at=0.8, shingle=5):
    """Nothing is grouped that brute force keeps apart; of pairs at the threshold a few may be missed by chance."""
    sets = [plain_set(t, shingle) for _, t in rows]
    _, root = expected(rows, at, shingle)
    root_of = {r.h: r.root for r in nearcopies.near_copies(docs, shingle, at).collect()}
    h_of = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    got = [root_of[h_of[t]] for _, t in rows]
    assert len(set(zip(got, root))) == len(set(got))
    true = [(i, j) for i in range(len(rows)) for j in range(i) if root[i] == root[j] and similar(sets[i], sets[j], at)]
    assert all(got[i] == got[j] for i, j in true if sets[i] == sets[j] or similar(sets[i], sets[j], at + 0.05))
    assert sum(got[i] == got[j] for i, j in true) >= 0.97 * len(true)


@pytest.mark.parametrize("rows", [awkward(), crowd()])
def test_awkward_texts_and_a_crowd(docs_of, rows):
    held_against_brute_force(rows, docs_of(rows))


@pytest.mark.parametrize("rows", [[], [(3, None), (2, ""), (None, " \n")]])
def test_groups_equal_brute_force(docs_of, rows):
    component, root = expected(rows)
    docs = docs_of(rows)
    assert found(docs) == Counter((i, c) for (i, _), c in zip(rows, component))
    kept = simhash.one_of_each(docs, groups=nearcopies.near_copies(docs))
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(component[root.index(r)] for r in set(root))


def test_other_similarity_and_shingle(docs_of):
    rows = crowd(5)
    held_against_brute_force(rows, docs_of(rows), 0.9, 3)


def test_a_crowd_that_is_no_group(docs_of):
    """Many texts share most of their words but stay under the threshold; each has its own copy with one edit."""
    rng = random.Random(8)
    shared = [f"s{i}" for i in range(60)]
    rows = []
    for i in range(0, 80, 2):
        own = shared + [f"o{rng.randrange(10**6)}" for _ in range(60)]
        rows += [(i, " ".join(own)), (i + 1, edited(rng, own, 1))]
    component, _ = expected(rows)
    assert len(set(component)) == 40
    assert found(docs_of(rows)) == Counter((i, c) for (i, _), c in zip(rows, component))


def test_edited_copies_under_the_threshold_do_not_all_meet(docs_of, monkeypatch):
    """Most copies of one text are edited so often that none is near another: few pairs go to the exact check."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    rows = [(i, edited(rng, base, rng.randrange(2) if i % 4 == 0 else rng.randrange(4, 14))) for i in range(320)]
    made, verified = [], nearcopies._verified

    def counted(pairs, *rest):
        made.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(nearcopies, "_verified", counted)
    component, _ = expected(rows)
    assert found(docs_of(rows)) == Counter((i, c) for (i, _), c in zip(rows, component))
    assert sum(made) <= 20 * len(rows)


def test_similar_sets_share_a_rare_shingle_with_room():
    rng = np.random.default_rng(6)
    counts = rng.integers(0, 4, nearcopies.SLOTS).astype(np.int32)
    for size in (1, 4, 5, 9, 60, 300):
        for _ in range(40):
            a = rng.integers(0, 2**62, size)
            gone = rng.integers(0, max(1, size // 9) + 1)
            b = np.append(a[gone:], rng.integers(0, 2**62, rng.integers(0, max(1, size // 9) + 1)))
            common = len(np.intersect1d(a, b))
            if common < 0.8 * (len(a) + len(b) - common):
                continue
            x, y = (nearcopies.rare_first(s, counts, 0.8).tolist() for s in (a, b))
            i, j = next((i, y.index(v)) for i, v in enumerate(x) if v in y)
            assert min(len(a) - i, len(b) - j) >= 0.8 / 1.8 * (len(a) + len(b)) - 1e-6


def test_very_long_text_and_a_near_copy(docs_of):
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**5)}" for _ in range(300_000)]
    rows = [(7, " ".join(words)), (4, edited(rng, words, 5_000)), (1, " ".join(words[:150_000])), (9, "short text")]
    assert found(docs_of(rows)) == Counter({(7, 4): 1, (4, 4): 1, (1, 1): 1, (9, 9): 1})


@pytest.mark.parametrize("distinct", [1, 300_000, 10**9])
def test_plan_meets_pairs_at_the_threshold(distinct):
    """Rings of random sets at the threshold share a segment, and their chains fit, about as often as planned."""
    places, width = nearcopies.plan(distinct)
    assert 2**width >= distinct / 4
    rng = np.random.default_rng(4)
    bits, met, trials = places * width, 0, 60
    for _ in range(trials):
        pool = rng.integers(0, 2**63, 300, dtype=np.uint64)
        rings = [nearcopies.ring_of(s, -(-bits // 64)) for s in (pool[:270], pool[30:])]
        a, b = (np.unpackbits(r.view(np.uint8), bitorder="little")[:bits].reshape(places, width) for r in rings)
        met += (a == b).all(axis=1).any()
    assert met >= 0.85 * trials
