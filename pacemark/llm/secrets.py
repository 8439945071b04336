"""Secret scans over an incremental blob ledger, with built-in functions only.

Every version of every path is addressed by the SHA-256 of its text. The ledger has one row per address
with the spans that each rule at its version found there: ``blob, found`` where ``found`` maps
``rule@version`` to spans (start, end; code points, end exclusive). A run groups the versions by address,
leaves out addresses whose map has all rules of today, reads one text of each other address and applies
only the rules that its map lacks. The findings are joined back to all paths with that address. `remember` keeps
the ledger in a folder from run to run; the first run begins with an empty one.
Copies, however many, are combined before the shuffle and scanned once.

Positions come from the regular expression's own matches: the text split by the pattern gives what lies
between them, and running sums of both lengths give begins and ends.

Edge cases: a null text counts as empty. Repeated rows and null ids are kept. Patterns do not match over
line ends. Columns of the input other than the named ones are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pacemark.llm.base import shared_folder

SPANS = "array<struct<start:int,end:int>>"
LEDGER = f"blob binary, keys array<string>, found map<string,{SPANS}>"
SENT_BLOBS = 200_000  # known addresses that are broadcast at most, 32 bytes each


@dataclass(frozen=True)
class Rule:
    """``pattern``'s leftmost non-overlapping matches whose group ``group`` has ``least`` characters.

    ``hint`` is a plain string that every match contains; texts without it are not searched.
    """

    name: str
    pattern: str
    least: int
    group: int = 0
    hint: str = ""
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Words in front of an assigned secret, in either case.
WORDS = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
ASSIGN = "(" + WORDS + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: The three base kinds. A run of hex digits or of key characters is matched as a whole, so the length
#: can be asked for in the pattern itself.
BASE = (
    Rule("assign", ASSIGN, 6, group=2),
    Rule("access", "AKIA[A-Z0-9]{16,}", 20, hint="AKIA"),
    Rule("hex", "[0-9a-f]{24,}", 24),
)
#: Kinds that the scan adds.
MORE = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, hint="PRIVATE KEY-----"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", 1, hint="eyJ"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}", 1, hint="_"),
)
RULES = (*BASE, *MORE)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def _total(lengths: Column, first: Column, n: Column) -> Column:
    """Sum of ``n`` lengths from place ``first`` on."""
    return F.aggregate(F.slice(lengths, first + 1, n), F.lit(0), lambda a, x: a + x)


def _placed(pieces: Column) -> Column:
    """Start, end and held length of the match behind each piece's gap.

    A start is the sum of all lengths before it: those of whole blocks, added up once, and of its own block's
    beginning. With blocks of the cube root of the number of pieces, the work is some n to the power 4/3.
    """
    step = F.greatest(F.lit(1), F.ceil(F.cbrt(2 * F.size(pieces))).cast("int"))
    lengths = F.transform(pieces, lambda p: p["gap"] + F.coalesce(p["size"], F.lit(0)))

    def of_blocks(x: Column, b: Column) -> Column:
        count = F.floor((F.size(x) - 1) / b).cast("int")
        sums = F.transform(F.sequence(F.lit(0), count), lambda i: _total(x, i * b, b))
        return _let(sums, lambda t: F.transform(F.sequence(F.lit(0), count), lambda i: _total(t, F.lit(0), i)))

    def starts(x: Column, b: Column, offsets: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            block = F.floor(i / b).cast("int")
            start = offsets[block] + _total(x, block * b, i - block * b) + p["gap"]
            return F.struct(start.alias("start"), (start + p["size"]).alias("end"), p["held"].alias("held"))

        return F.transform(pieces, one)

    return _let(lengths, lambda x: _let(step, lambda b: _let(of_blocks(x, b), lambda o: starts(x, b, o))))


def spans(text: Column, rule: Rule) -> Column:
    """Spans of one rule in a text, in order."""
    pattern = F.lit(rule.pattern)
    match = F.regexp_extract_all(text, pattern, F.lit(0))
    held = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else match
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    pieces = F.arrays_zip(
        gaps.alias("gap"), F.transform(match, F.length).alias("size"), F.transform(held, F.length).alias("held")
    )
    placed = _let(pieces, lambda ps: _placed(ps))
    kept = F.filter(placed, lambda s: s["held"] >= rule.least)
    found = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    worth = text.rlike(rule.pattern)
    if rule.hint:
        worth = text.contains(rule.hint) & worth
    return F.when(worth, found).otherwise(F.array().cast(SPANS)).cast(SPANS)


def _blob(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def update(
    versions: DataFrame,
    ledger: DataFrame | None = None,
    rules: Sequence[Rule] = RULES,
    text_col: str = "text",
) -> DataFrame:
    """The ledger after these versions: ``blob, found``; known pairs of blob and rule are not scanned again."""
    texts = versions.select(_blob(text_col).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    keys = [r.key for r in rules]
    if ledger is not None:
        done = ledger.where(F.size(F.array_except(F.array(*map(F.lit, keys)), F.map_keys("found"))) == 0)
        texts = texts.join(done.select("blob"), "blob", "left_anti")
    one = texts.groupBy("blob").agg(F.first("_text").alias("_text"))
    entries = {r: spans(F.col("_text"), r) for r in rules}
    if ledger is None:
        return one.select("blob", F.create_map(*(x for r in rules for x in (F.lit(r.key), entries[r]))).alias("found"))
    one = one.join(ledger, "blob", "left")
    fresh = F.create_map(
        *(
            x
            for r in rules
            for x in (F.lit(r.key), F.when(F.col("found")[r.key].isNull(), entries[r]).otherwise(F.col("found")[r.key]))
        )
    )
    older = F.map_filter("found", lambda k, _: ~k.isin(keys))
    merged = F.when(F.col("found").isNull(), fresh).otherwise(F.map_concat(older, fresh))
    scanned = one.select("blob", merged.alias("found"))
    return ledger.select("blob", "found").join(scanned, "blob", "left_anti").unionByName(scanned)


def ledger_at(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger kept in a folder: ``blob, keys`` (rules that scanned it) and ``found``, spans of those that hit.

    Each run adds what it scanned in a folder of its own; runs that scanned the same pair found the same.
    """
    spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(f"{folder}/run=first")
    rows = spark.read.schema(LEDGER).parquet(folder).groupBy("blob")
    entries = F.array_distinct(F.flatten(F.collect_list(F.map_entries("found"))))
    return rows.agg(
        F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys"), F.map_from_entries(entries).alias("found")
    )


def remember(
    versions: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", folder: str | None = None
) -> DataFrame:
    """`update` with a ledger that is kept in ``folder`` from run to run: its entries after these versions, ``blob, found``.

    Pairs of blob and rule that the kept ledger has are not scanned. The others are scanned and added to it. Without
    ``folder`` a new ledger is begun in the shared folder.
    """
    spark = versions.sparkSession
    folder = folder or f"{shared_folder(spark).rstrip('/')}/pacemark-llm/secret-ledger-{uuid.uuid4().hex}"
    known = ledger_at(spark, folder)
    keys = [r.key for r in rules]
    done = known.where(F.size(F.array_except(F.array(*map(F.lit, keys)), "keys")) == 0).select("blob")
    texts = versions.select(_blob(text_col).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    few = done.limit(SENT_BLOBS + 1).count() <= SENT_BLOBS
    if few:  # known texts then stay out of the shuffle
        texts = texts.join(F.broadcast(done), "blob", "left_anti")
    one = texts.groupBy("blob").agg(F.first("_text").alias("_text"))
    if not few:
        one = one.join(done, "blob", "left_anti")
    one = one.join(known.select("blob", "keys"), "blob", "left")
    lacks = {r: ~F.coalesce(F.array_contains("keys", r.key), F.lit(False)) for r in rules}
    none = F.array().cast(SPANS)
    entries = F.create_map(
        *(x for r in rules for x in (F.lit(r.key), F.when(lacks[r], spans(F.col("_text"), r)).otherwise(none)))
    )
    scanned = F.filter(F.array(*(F.when(lacks[r], r.key) for r in rules)), lambda k: k.isNotNull())
    fresh = one.select("blob", scanned.alias("keys"), F.map_filter(entries, lambda _, v: F.size(v) > 0).alias("found"))
    fresh.write.parquet(f"{folder}/run={uuid.uuid4().hex}")
    return ledger_at(spark, folder).select("blob", "found")


def findings(
    versions: DataFrame, ledger: DataFrame, keep: Sequence[str], rules: Sequence[Rule] = RULES, text_col: str = "text"
) -> DataFrame:
    """Columns ``keep`` of every version and ``spans``: start, order of the rule, kind, end; sorted."""
    def of_rule(place: int, rule: Rule) -> Column:
        return F.transform(
            F.coalesce(F.col("found")[rule.key], F.array().cast(SPANS)),
            lambda s: F.struct(
                s["start"].alias("start"),
                F.lit(place).alias("place"),
                F.lit(rule.name).alias("kind"),
                s["end"].alias("end"),
            ),
        )

    flat = ledger.select("blob", F.array_sort(F.concat(*map(of_rule, range(len(rules)), rules))).alias("spans")).where(F.size("spans") > 0)
    paths = versions.select(*keep, _blob(text_col).alias("blob"))
    none = F.array().cast("array<struct<start:int,place:int,kind:string,end:int>>")
    return paths.join(flat, "blob", "left").select(*keep, F.coalesce("spans", none).alias("spans"))


def as_text(found: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(
        F.transform(
            found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )


def without_secrets(
    docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", folder: str | None = None
) -> DataFrame:
    """The rows whose text has no finding; ``folder`` as in `remember`. Columns of any name go through."""
    hits = F.map_filter("found", lambda k, v: k.isin([r.key for r in rules]) & (F.size(v) > 0))
    dirty = remember(docs.select(text_col), rules, text_col, folder).where(F.size(hits) > 0).select("blob")
    rows = docs.select(F.struct("*").alias("_row"), _blob(text_col).alias("blob"))
    return rows.join(dirty, "blob", "left_anti").select("_row.*")
