"""The numbered queries over a whole small table, and the pipeline against its stages' brute force."""

import re
from collections import Counter

import duckdb
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from pacemark.llm import bpe, secrets, toxicity
from pacemark.llm.queries import ORACLE, QUERIES
from test_nearcopies import plain_set, similar
from test_texts import groups, plain_targets, sha

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "documents embeddings pages labels".split():
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr(tuple(r[names.index(c)] for c in sorted(names))) for r in cursor.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*sorted(names)).collect()) == want


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE.keys()))
def test_query_has_a_row_per_document(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES[name](spark, SF)
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        before, after = docs.toPandas(), out.toPandas()
        if name == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            heads = model.heads()
            kept = [i for i, t in zip(before.doc_id, before.text) if model.score(model.counts(t, heads)) < 0.7]
        elif name == "simhash":
            sets = [plain_set(t) for t in before.text]
            least, _ = groups(list(before.doc_id), lambda a, b: similar(sets[a], sets[b]))
            kept = [i for i, c in zip(before.doc_id, least) if i == c]
        elif name == "secrets":
            import re

            rules = [re.compile(r.pattern) for r in secrets.RULES]
            kept = [i for i, t in zip(before.doc_id, before.text) if not any(r.search(t) for r in rules)]
        else:
            assert set(after.doc_id) <= set(before.doc_id) and after.doc_id.value_counts().max() <= 3
            words = lambda df: df.text.str.encode("utf-8").map(lambda x: len(x.split()))
            total = words(before).sum()
            assert abs(words(after).sum() - total) <= 0.01 * total  # a few short documents per source
            kept = sorted(after.doc_id)
        assert sorted(after.doc_id) == sorted(kept), name
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.count() == docs.count()


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() and {"doc_id", "n_tokens"} <= set(out.columns)


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


@pytest.mark.parametrize("piece", [bpe.PIECE, 2_000])
def test_last_stage_returns_ids_and_bytes(spark, monkeypatch, piece):
    monkeypatch.setattr(bpe, "PIECE", piece)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(20)
    docs = docs.unionByName(spark.createDataFrame([(-1, ""), (-2, None), (-3, "a")], docs.schema))
    text_of = {r.doc_id: r.text or "" for r in docs.collect()}
    out = corpus_pipeline.pack(spark, docs, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(text_of)
    for r in out:
        ids = plain_ids(text_of[r.doc_id])
        assert (r.n_tokens, r.ids) == (len(ids), ",".join(map(str, ids))) and bytes(r.decoded) == text_of[r.doc_id].encode()
        assert (r.ids_sha256, r.decoded_sha256) == (sha(r.ids), sha(bytes(r.decoded)))


def plain_ids(text, coder=[]):  # noqa: B006
    if not coder:
        ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
        coder.append(tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    return coder[0].encode_ordinary(text)


def plain_stages(spark, rows, folder):
    """Rows ``doc_id, text, source`` that each stage before mixing leaves, in plain Python but for the fitted model."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    heads = model.heads()
    clean = [r for r in rows if model.score(model.counts(r[1], heads)) < 0.7]
    sets = [plain_set(r[1]) for r in clean]
    least, _ = groups([r[0] for r in clean], lambda a, b: similar(sets[a], sets[b]))
    single = [r for r, c in zip(clean, least) if r[0] == c]
    key = r"(?:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?[A-Za-z0-9+/_.=-]{6,}"
    more = r"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}|-----BEGIN [A-Z ]*PRIVATE KEY-----|gh[pousr]_[A-Za-z0-9]{36,}"
    jwt = r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
    safe = [r for r in single if not re.search(key, r[1], re.I | re.A) and not re.search(f"{more}|{jwt}", r[1])]
    return clean, single, safe


def test_run_equals_plain_stages(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    extra = table[table.text.str.split().str.len().between(60, 200)].head(3).copy()
    extra["doc_id"] = [9001, 9002, 9003]
    extra.iloc[1, extra.columns.get_loc("text")] = "mountain river Password: 'hunter2222' valley " * 3
    extra.iloc[2, extra.columns.get_loc("text")] = "quiet harbour with ghp_" + "a1B2" * 9 + " boats at dawn"
    pd.concat([table, extra]).to_parquet(tmp_path / "documents.parquet", index=False)
    spark.read.parquet(f"{SF}/labels.parquet").toPandas().to_parquet(tmp_path / "labels.parquet", index=False)
    rows = [(r.doc_id, r.text, r.source) for r in pd.concat([table, extra]).itertuples()]
    clean, single, safe = plain_stages(spark, rows, str(tmp_path))
    assert len(rows) >= len(clean) > len(single) > len(safe) > 0
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    text_of, source_of = {r[0]: r[1] for r in safe}, {r[0]: r[2] for r in safe}
    length = {i: len(t.encode().split()) for i, t in text_of.items()}
    times = Counter(r.doc_id for r in out)
    assert set(times) <= set(text_of) and max(times.values()) <= 3
    size, taken = Counter(), Counter()
    for i, n in length.items():
        size[source_of[i]] += n
        taken[source_of[i]] += n * times[i]
    for source, target in plain_targets(size).items():
        room = min((n for i, n in length.items() if source_of[i] == source and times[i] < 3), default=1)
        assert 0.99 * target - room - 1 <= taken[source] <= target + 1, source
    for r in out:
        ids = plain_ids(text_of[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert r.decoded_sha256 == sha(text_of[r.doc_id])
