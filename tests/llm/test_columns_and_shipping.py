"""Columns of any name through the stages, many matches in one text, the kept ledger, executors without the package."""

import os
import subprocess
import sys
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pacemark.llm import exact, repeats, secrets

REPO = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
NAMES = (
    "score _scored _h h _times _rows _blob blob _text_hash _row row _own _address _id id fp root least component_id k r t "
    "keys found size times source_size target _s n_bytes prefix again full _again _text runs best n_words digest chunk"
).split()


@pytest.fixture(scope="module")
def labels(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("labels"))
    rows = [(i, 1, int(i % 4 == 0)) for i in range(60)]
    spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def crowded(spark, rows):
    """Documents with every private name as a further column."""
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return docs.select("*", *[F.concat(F.lit(f"{n}:"), F.coalesce("doc_id", F.lit(-1))).alias(n) for n in NAMES]).repartition(2)


def documents():
    calm = "the quiet river runs past green hills and old stone bridges number {} of many"
    rude = "you vile hateful scum we despise you filthy vermin {} go away"
    rows = [(i, (rude if i % 4 == 0 else calm).format("word%d" % i), "en", "ab"[i % 2], 9) for i in range(60)]
    rows += [(5, rows[5][1], "en", "b", 9), (5, "other text under the same id", "en", "b", 9), (None, None, None, None, None)]
    rows += [(None, "nobody's text", "en", None, 1), (70, "password = hunter22secret", "en", "a", 1), (71, "", "en", "a", 0)]
    return rows


@pytest.mark.parametrize("rows", [documents(), []])
@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stage_keeps_other_columns(spark, labels, name, stage, rows):
    docs = crowded(spark, rows)
    out = stage(spark, docs, labels)
    assert out.columns == docs.columns
    given = Counter(tuple(r) for r in docs.collect())
    got = Counter(tuple(r) for r in out.collect())
    assert got.keys() <= given.keys()  # whole rows with their own values
    if rows and name == "secrets":
        assert not any(r[0] == 70 for r in got) and sum(got.values()) == sum(given.values()) - 1
    if rows and name != "mixing":
        assert got <= given
    plain = stage(spark, docs.select("doc_id", "text", "lang", "source", "n_chars"), labels)
    assert Counter(tuple(r) for r in plain.collect()) == Counter(tuple(r[:5]) for r in got.elements())


def test_new_operators_ignore_other_columns(spark):
    docs = crowded(spark, documents())
    assert exact.groups(docs).count() == docs.count() == repeats.find(docs).count()


def test_many_matches_in_one_text(spark):
    n = 100_000
    text = " ".join("%024x" % i for i in range(n))
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    began = time.monotonic()
    found = secrets.findings(docs, secrets.update(docs), ["doc_id"]).select(F.size("spans"), F.col("spans")[n - 1]).first()
    assert found[0] == n and (found[1].start, found[1].end) == (25 * (n - 1), 25 * n - 1)
    assert time.monotonic() - began < 60


def test_kept_ledger(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(["token = abcdef123", "nothing here", None, "f" * 30, "token = abcdef123"])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    folder = f"{tmp_path}/ledger"

    def added():
        runs = spark.read.parquet(folder).where("run <> 'first'").groupBy("run").count().collect()
        return sorted(r["count"] for r in runs)

    def shown(rules=secrets.RULES):
        found = secrets.findings(docs, secrets.remember(docs, rules, folder=folder), ["doc_id"], rules)
        return {r.doc_id: r.s for r in found.select("doc_id", secrets.as_text(F.col("spans")).alias("s")).collect()}

    first = shown()
    assert first == {0: "assign:0:17", 1: "", 2: "", 3: "hex:0:30", 4: "assign:0:17"} and added() == [4]
    assert shown() == first and added() == [4]  # nothing is scanned, nothing added
    more = docs.unionByName(spark.createDataFrame([(9, "new AKIA" + "B" * 16)], docs.schema))
    secrets.remember(more, folder=folder)
    assert added() == [1, 4]  # the one new text
    newer = (*secrets.BASE[:2], secrets.Rule("hex", "[0-9a-f]{31,}", 31, version=2))
    assert shown(newer)[3] == "" and added() == [1, 4, 4]  # only the new version's pairs
    last = spark.read.parquet(folder).where(F.array_contains("keys", "hex@2"))
    assert {tuple(r["keys"]) for r in last.collect()} == {("hex@2",)}


SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
from pacemark.session import local_session
spark = local_session(cores=4, partitions=4, memory="4g")
for name in {names!r}:
    print(name, entry.queries()[name](spark, "/root/testdata/sf0.001").count(), flush=True)
"""


def test_executors_without_the_package(tmp_path):
    names = [f"op{n}_" for n in (2, 7, 8, 9, 11, 13)]
    from pacemark.llm.queries import QUERIES

    names = [q for q in QUERIES if q.startswith(tuple(names))]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(repo=REPO, names=names)], cwd=tmp_path, env=env, capture_output=True, text=True
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert [line.split()[0] for line in done.stdout.splitlines() if line.startswith("op")] == names
