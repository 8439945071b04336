"""Operators on texts against brute force on small tables with the awkward cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from pacemark.llm import bpe, mixing, passages, secrets, simhash, suffixes, toxicity, windows

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = [f"w{i}" for i in range(400)]


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def awkward(seed=1, n=60):
    """Null, empty and blank texts, repeats, near copies, shared passages, null ids, a long text."""
    rnd = random.Random(seed)
    prose = lambda k: " ".join(rnd.choice(WORDS) for _ in range(k))
    passage, base = prose(150), prose(120)
    rows = [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "one"), (1004, "one two"), (None, passage), (None, None)]
    for i in range(n):
        kind = i % 6
        if kind == 0:
            text = base
        elif kind == 1:
            text = base + " " + prose(1)
        elif kind == 2:
            text = prose(20) + "\n" + passage + " " + prose(rnd.randint(0, 30))
        elif kind == 3:
            text = passage[rnd.randint(0, 90) :] + "é" + prose(5)
        else:
            text = prose(rnd.randint(1, 200))
        rows.append((i, text))
    rows.append((5, base))  # an id twice
    rows += [(7, rows[14][1])] * 2  # a row twice
    rows.append((2000, "ab " * 700))
    rows.append((2001, prose(30_000)))
    rnd.shuffle(rows)
    return rows


def same_rows(df, columns, want):
    got = Counter(tuple(r) for r in df.select(*columns).collect())
    assert got == Counter(want)


# --- byte-level BPE -------------------------------------------------------------------------------


def test_bpe_equals_the_tokenizer_library(docs_of):
    ranks = bpe.read_ranks(PATH)
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [*awkward(), (9, "a" * 20_000), (10, "don't'll <|endoftext|> ²Ⅷ\u0301\u3000\x85 中文😀"), (11, "x" * 65 + " " + "y" * 64)]
    want = []
    for i, text in rows:
        ids = ",".join(map(str, coder.encode_ordinary(text or "")))
        want.append((i, len(ids.split(",")) if ids else 0, sha(ids), sha(text or "")))
    docs = docs_of(rows)
    same_rows(bpe.digests(docs, PATH, public_tokenizers.PATTERN), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], want)
    whole = bpe.encode_decode(docs, PATH, public_tokenizers.PATTERN)
    assert Counter((r[0], bytes(r[1]).decode()) for r in whole.select("doc_id", "decoded").collect()) == Counter(
        (i, t or "") for i, t in rows
    )
    assert bpe.digests(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_both_ways_of_merging_agree():
    ranks, rnd = bpe.read_ranks(PATH), random.Random(4)
    pieces = [bytes(rnd.choice(b"abcdeino t") for _ in range(rnd.randint(1, 64))) for _ in range(3_000)]
    pieces = [p for p in pieces if p not in ranks]  # these are ids as they are
    assert bpe.Trees(ranks).merge(pieces) == [bpe.merge(p, ranks) for p in pieces]


# --- SimHash --------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    n = max(1, len(words) - 2)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(n)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(ids, near):
    root = list(range(len(ids)))
    for a in range(len(ids)):
        for b in range(a):
            if near(a, b):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    least = defaultdict(list)
    for i, r in enumerate(root):
        least[r].append(ids[i])
    return [min((x for x in least[r] if x is not None), default=None) for r in root], root


@pytest.mark.parametrize("rows", [awkward(), [], [(3, None), (2, "")]])
def test_simhash_groups(docs_of, rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    component, root = groups([i for i, _ in rows], lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 3)
    docs = docs_of(rows)
    found = simhash.near_duplicates(docs).withColumn("hex", F.lower(F.lpad(F.hex("fp"), 16, "0")))
    same_rows(found, ["doc_id", "hex", "component_id"], [(i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, component)])
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert Counter(ids) == Counter(component[root.index(r)] for r in set(root))


@pytest.mark.parametrize("extra", [0, 1, 3, 5])
def test_simhash_links_whatever_the_key(spark, extra):
    rnd = random.Random(extra)
    base = [rnd.getrandbits(64) for _ in range(60)]
    prints = {b ^ sum(1 << rnd.randrange(64) for _ in range(k)) & (2**64 - 1) for b in base for k in (0, 1, 2, 3, 4)}
    prints = [p - (1 << 64) if p >> 63 else p for p in prints]
    want = {(a, b) for a in prints for b in prints if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    got = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp bigint"), extra)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 50


# --- secrets --------------------------------------------------------------------------------------

SECRETS = [
    (1, "a password = 'hunter22' b"), (2, "TOKEN:abc12 token=token: abcdefgh"), (3, None), (4, ""),
    (5, "é\n" * 5 + "AKIA" + "A" * 16 + " AKIAAKIA0 " + "0af" * 8 + "g" + "0" * 23), (6, "Api_Key=" + "x" * 9),
    (7, "apikey=secret=passwd=12345 \u017fecret=1234567 to\u212aen=1234567"), (1, "a password = 'hunter22' b"),
    (8, "no secret here"), (None, "secret: abcdef"), (9, "-----BEGIN RSA PRIVATE KEY----- " + "deadbeef" * 4),
    (10, "x " * 3_000 + "password=abcdefgh " * 50),
]


def plain_spans(text):
    text = text or ""
    kinds = [
        ("assign", re.compile(secrets.ASSIGN), lambda m: len(m[2]) >= 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
        ("pem", re.compile("-----BEGIN [A-Z ]*PRIVATE KEY-----"), lambda m: True),
    ]
    found = [(m.start(), p, f"{k}:{m.start()}:{m.end()}") for p, (k, r, ok) in enumerate(kinds) for m in r.finditer(text) if ok(m)]
    return ",".join(x[2] for x in sorted(found))


def test_secret_spans(docs_of):
    docs = docs_of(SECRETS)
    ledger = secrets.update(docs)
    found = secrets.findings(docs, ledger, ["doc_id"]).select("doc_id", secrets.as_text(F.col("spans")).alias("s"))
    same_rows(found, ["doc_id", "s"], [(i, plain_spans(t)) for i, t in SECRETS])
    clean = secrets.without_secrets(docs)
    assert clean.columns == docs.columns
    same_rows(clean, ["doc_id", "text"], [(i, t) for i, t in SECRETS if not plain_spans(t)])
    assert secrets.update(docs.limit(0)).count() == 0


def test_ledger_scans_only_unseen_pairs(docs_of):
    old, new = docs_of(SECRETS[:6]), docs_of(SECRETS[4:])
    first = secrets.update(old)
    marked = first.withColumn("found", F.map_concat(F.map_filter("found", lambda k, _: k != "hex@1"), F.create_map(
        F.lit("hex@1"), F.array(F.struct(F.lit(-5).alias("start"), F.lit(-4).alias("end"))))))
    second = secrets.update(new, marked)
    assert second.select("blob").distinct().count() == second.count() == len({t or "" for _, t in SECRETS})
    shown = secrets.findings(new, second, ["doc_id"]).select("doc_id", secrets.as_text(F.col("spans")).alias("s")).collect()
    told = {r.doc_id: r.s for r in shown}
    assert "hex:-5:-4" in told[5] and "hex:-5:-4" not in told[9]  # known pairs are kept as the ledger has them
    newer = (*secrets.BASE[:2], secrets.Rule("hex", "[0-9a-f]{24,}", 24, version=2))
    third = secrets.findings(new, secrets.update(new, second, newer), ["doc_id"], newer)
    assert "hex:-5" not in "".join(r.s for r in third.select(secrets.as_text(F.col("spans")).alias("s")).collect())


# --- mixing ---------------------------------------------------------------------------------------


def test_best_sum_is_the_largest_possible():
    rnd = random.Random(2)
    for _ in range(200):
        lengths = rnd.sample(range(1, 30), rnd.randint(1, 5))
        counts = [rnd.randint(0, 4) for _ in lengths]
        budget = rnd.randint(0, 60)
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + k * n for s in sums for k in range(c + 1)}
        taken = mixing.best_sum(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(taken, counts))
        assert sum(t * n for t, n in zip(taken, lengths)) == max(s for s in sums if s <= budget)


def plain_targets(size):
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: [1, 2, 3][i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:
        free = sum(size.values()) - sum(3 * size[s] for s in capped)
        total = sum(w for s, w in weight.items() if s not in capped)
        over = {s for s in size if s not in capped and free * weight[s] / total > 3 * size[s]}
        if not over:
            return {s: 3.0 * size[s] if s in capped else free * weight[s] / total for s in size}
        capped |= over


def test_mixing_meets_its_targets(docs_of):
    rnd = random.Random(5)
    rows = [
        (i, " ".join(["w"] * rnd.choice([1, 2, 3, 7, 50, rnd.randint(1, 300)])), rnd.choice(["b", "b", "b", "é", "z", None]))
        for i in range(900)
    ]
    rows += [(2000, "a b c", "tiny"), (2001, None, "tiny"), (2002, "", "blank"), (1, rows[1][1], rows[1][2]), (None, "a b", "b")]
    docs = docs_of(rows)
    result = mixing.mix(docs).collect()
    size = defaultdict(int)
    for _, text, source in rows:
        size[source] += len((text or "").split())
    want = plain_targets(size)
    source_of = {i: s for i, _, s in rows}
    assert len(result) == len(rows)
    taken = defaultdict(int)
    for r in result:
        source = source_of[r.doc_id]
        assert r.source_size == size[source] and abs(r.target - want[source]) < 1e-6
        assert 0 <= r.taken <= 3 * r["size"]
        taken[source] += r.taken
    for source in size:
        assert abs(taken[source] - want[source]) <= 1, source
    assert sorted(map(str, mixing.mix(docs.repartition(5)).collect())) == sorted(map(str, result))
    mixed = mixing.take(docs)
    assert mixed.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(taken.values())
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.take(docs.limit(0)).count() == 0


def test_a_length_is_picked_by_parts(docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "PART_ROWS", 10)
    docs = docs_of([(i, "a b c", "x") for i in range(500)] + [(i, "a b", "y") for i in range(500, 2000)])
    by = mixing.mix(docs).groupBy("size").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r.t - r.g) <= 3 for r in by) and len(by) == 2


# --- substring and passage dedup ------------------------------------------------------------------


@pytest.mark.parametrize("rows", [awkward(2), [], [(1, None), (2, "a b c")]])
def test_windows_against_brute_force(docs_of, rows):
    first = {}
    for i, text in rows:
        words = (text or "").encode().split()
        for k in range(len(words) - 12):
            if i is not None:
                w = tuple(words[k : k + 13])
                first[w] = min(first.get(w, i), i)
    want = []
    for i, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for k in range(len(words) - 12):
            if i is not None and first[tuple(words[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        want.append((i, len(words), len(gone), sha(kept)))
    found = windows.dedup(docs_of(rows), hashed=True)
    same_rows(found, ["doc_id", "n_words", "n_removed", "kept_sha256"], want)


@pytest.mark.parametrize("hot", [2_048, 1])
@pytest.mark.parametrize("rows", [awkward(3), [], [(1, None), (2, "é" * 300), (3, "a" * 399), (4, "b" * 400)]])
def test_passages_against_brute_force(docs_of, rows, hot):
    count = Counter(t[k : k + 400] for _, x in rows for t in [(x or "").encode()] for k in range(len(t) - 399))
    want = []
    for i, text in rows:
        data = (text or "").encode()
        change = [0] * (len(data) + 1)
        for k in range(len(data) - 399):
            if count[data[k : k + 400]] > 1:
                change[k] += 1
                change[k + 400] -= 1
        gone, level = [], 0
        for c in change[:-1]:
            level += c
            gone.append(level > 0)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want.append((i, len(data), sum(gone), spans, sha(bytes(b for b, g in zip(data, gone) if not g))))
    found = passages.dedup(docs_of(rows), hashed=True, hot=hot)
    same_rows(found, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], want)


def test_suffix_arrays():
    rnd = random.Random(6)
    for _ in range(150):
        t = [rnd.randint(1, rnd.choice([1, 2, 3, 200])) for _ in range(rnd.choice([1, 2, 10, 200]))]
        t = t * rnd.choice([1, 1, 3]) + [0]
        check_suffix_array(t)
    check_suffix_array([0])
    for times in (1, 2):
        check_suffix_array(list(range(300, 0, -1)) * times + [0])  # every suffix falls into the range walked
        check_suffix_array(list(range(1, 300)) * times + [0])
    check_suffix_array([x for _ in range(30) for x in [rnd.randint(1, 9)] * rnd.randint(1, 40)] + [0])


def test_suffix_array_of_many_symbols():
    """Far more symbols than two bytes hold, with long repeats, so that names are sorted by recursion."""
    numbers = np.random.default_rng(0).integers(1, 90_000, 40_000)
    t = np.concatenate([numbers, numbers[::2], numbers[100:], [0]])
    sa = suffixes.suffix_array(t, 90_000)
    assert sorted(sa.tolist()) == list(range(len(t)))
    after = np.empty(len(t) + 1, np.int64)  # ranks; a suffix is smaller if its symbol is, or its rest where they agree
    after[sa] = np.arange(len(t))
    a, b = sa[:-1], sa[1:]
    assert ((t[a] < t[b]) | ((t[a] == t[b]) & (after[a + 1] < after[b + 1]))).all()


def check_suffix_array(t: list[int]) -> None:
    order = sorted(range(len(t)), key=lambda i: t[i:])
    sa = suffixes.suffix_array(np.array(t), max(t) + 1)
    assert sa.tolist() == order
    shared = suffixes.common_prefixes(np.array(t), sa)
    for before, i in zip(order, order[1:]):
        n = 0
        while t[before + n] == t[i + n]:
            n += 1
        assert shared[i] == n


# --- toxicity -------------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark, docs_of):
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(1500):
        words = [rnd.choice(WORDS) + rnd.choice("abc") for _ in range(rnd.randint(5, 80))]
        toxic = rnd.random() < 0.1
        if toxic:
            words.insert(rnd.randrange(len(words)), "vile" + rnd.choice(["um", "er", "ous"]))
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic), 1.5))
    truth = {i: "vile" in t for i, t in rows}
    rows += [(5000, None), (5001, ""), (None, "vileum"), (3, rows[3][1]), (5002, "vileous " * 20_000)]
    marked = spark.createDataFrame([*labels, (None, 1, 1, 0.0), (4, None, None, None)], "doc_id bigint, quality int, toxic int, score double")
    docs = docs_of(rows)
    model = toxicity.fit(docs, marked)
    scored = toxicity.score(docs, model, ["doc_id"]).withColumn("held", toxicity.held_out("doc_id")).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    import zlib

    for r in scored:
        assert r.held == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if r.doc_id in truth:
            assert (r.score >= 0.7) == truth[r.doc_id], r
    again = toxicity.fit(docs.repartition(5), marked)
    assert again.features == model.features and abs(again.weights - model.weights).max() < 1e-9
    # labels of held-out rows change nothing
    flipped = marked.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, flipped).features == model.features


def plain_risks(pos, unl, w, prior):
    """Both risks row by row: sigmoid loss of calling positives clean, and of calling the rest toxic."""

    def loss(row, sign):
        return 1 / (1 + math.exp(sign * sum(a * b for a, b in zip(row, w))))

    missed = prior * sum(loss(r, 1) for r in pos) / len(pos)
    taken = sum(loss(r, -1) for r in unl) / len(unl) - prior * sum(loss(r, -1) for r in pos) / len(pos)
    return missed, taken


@pytest.mark.parametrize("shift, negative", [(0.0, False), (4.0, True)])
def test_risk_and_gradient_against_plain_ones(shift, negative):
    rng = np.random.default_rng(4)
    pos, unl, w = rng.normal(shift, 1, (7, 3)), rng.normal(-shift, 1, (20, 3)), rng.normal(0.5, 0.1, 3)
    missed, taken, gradient = toxicity.risk(pos, unl, w, 0.3)
    want = plain_risks(pos, unl, w, 0.3)
    assert abs(missed - want[0]) < 1e-12 and abs(taken - want[1]) < 1e-12 and (taken < 0) == negative
    for k in range(3):
        ends = []
        for step in (1e-6, -1e-6):
            a, b = plain_risks(pos, unl, w + step * np.eye(3)[k], 0.3)
            ends.append(-b if negative else a + b)  # below zero the clean part is driven up again
        assert abs(gradient[k] - (ends[0] - ends[1]) / 2e-6) < 1e-7


def test_fit_finds_the_least_risk():
    """One feature: the fitted weights are held against all weights of a grid under the plain risk."""
    rng = np.random.default_rng(5)
    pos = rng.normal(2, 0.5, (200, 1))
    unl = np.concatenate([rng.normal(2, 0.5, (300, 1)), rng.normal(-1, 0.5, (700, 1))])
    w = toxicity.nnpu(pos, unl, 0.3, seed=1, epochs=200, rate=0.05)

    def total(weights):
        missed, taken = plain_risks(
            np.hstack([pos, np.ones((200, 1))]), np.hstack([unl, np.ones((1000, 1))]), weights, 0.3
        )
        return missed + max(0.0, taken)

    best = min(total((a, b)) for a in range(-6, 7, 2) for b in range(-6, 7, 2))
    assert total(w) <= best + 0.02
    assert ((unl[:, 0] * w[0] + w[1] > 0) == (np.arange(1000) < 300)).mean() > 0.98


def test_toxicity_without_labels(docs_of, spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    docs = docs_of([(1, "a"), (2, None)])
    assert [r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()] == [0.0, 0.0]
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), none)).count() == 0
