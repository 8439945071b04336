"""URL filters: pattern rules found by their rarest literal token.

A rule is a regular expression over ``host + path`` with an action. Each rule names the whole tokens (runs
of letters and digits) that every match must contain. How often these tokens occur is counted over all
URLs of the run, and the rule is filed under its rarest one; only the rules' own tokens are counted, so the
counts that reach the driver are as few as the rule list is long. A URL is cut into tokens; the rules filed
under them, and those few without any token, are its candidates, and only their expressions run.

Rules come as a list from the driver and are sent to all tasks; the list may have `MAX_RULES` rules, more
are refused. Nothing but the token counts is shuffled.

Host and path: after the first ``://`` the host goes up to ``/``, ``?``, ``#`` or the end, A-Z in lower
case; the path from there up to ``?``, ``#`` or the end. Of the rules that fit, the longest name wins, at
equal length the one with the longer host, then the earlier one; a listed rule goes before a pattern rule.

Rules can also be read from filter lists in the common syntax of ad and tracker lists (`filter_line`, and `filter_rules`
for a table of lines). They compare ASCII letters in either case, so tokens are filed in lower case. Where several fit,
exceptions (``@@``) go first.

Edge cases: a null URL, or one without ``://``, has empty host and path and no rule. Repeated rows and null
ids are kept; other columns are ignored. Without rules every verdict is the default.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacemark.session import runs_in_tasks

runs_in_tasks(__name__)

MAX_RULES = 200_000
TOKEN = re.compile("[A-Za-z0-9]+")
LOWER = {code: code + 32 for code in range(ord("A"), ord("Z") + 1)}


def tokens_of(text: str) -> list[str]:
    """Runs of ASCII letters and digits, in lower case; other letters are left alone."""
    return TOKEN.findall(text.translate(LOWER))


@dataclass(frozen=True)
class Rule:
    """``listed`` rules are reported by name; the others are the method's own patterns."""

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    listed: bool = True
    host_length: int = 0
    exception: bool = False


def site(action: str, name: str) -> Rule:
    """A rule ``host/path``: fits the host and its subdomains where the path starts with the rule's."""
    host, slash, path = name.partition("/")
    path = slash + path
    # the last token of the path may go on in the URL, and is then none of the URL's tokens
    whole = TOKEN.findall(re.sub("[A-Za-z0-9]+$", "", path))
    pattern = r"\A(?:[^/]*\.)?" + re.escape(host) + ("(?=/|\\Z)" if not path else re.escape(path))
    return Rule(name, action, pattern, (*TOKEN.findall(host), *whole), True, len(host))


def glob(action: str, name: str) -> Rule:
    """A pattern over ``host + path`` where ``*`` stands for any characters; from its begin to its end."""
    parts = name.split("*")
    tokens = []
    for i, part in enumerate(parts):  # a token that touches a star may be part of a longer one
        inner = re.sub("^[A-Za-z0-9]+", "", part) if i else part
        tokens += TOKEN.findall(re.sub("[A-Za-z0-9]+$", "", inner) if i < len(parts) - 1 else inner)
    return Rule(name, action, r"(?s:\A" + ".*".join(map(re.escape, parts)) + r"\Z)", tuple(tokens), False)


#: What parts of a filter line stand for: ``^`` is a separator or the end, ``*`` anything.
FILTER_PARTS = {"^": r"(?:[^A-Za-z0-9_.%-]|\Z)", "*": "(?s:.*)"}


def filter_line(line: str | None) -> Rule | None:
    """A rule over ``host + path`` from a line of a filter list, or None where the line holds none.

    ``||`` anchors at the host or one of its parent domains, ``|`` at the begin or the end, ``@@`` makes an
    exception; a scheme behind the anchor is left out, as addresses have none here. Lines that depend on the request
    or page (``$`` options, element rules), regular expressions, comments and heads give None.
    """
    name = (line or "").strip()
    exception = name.startswith("@@")
    body = name[2:] if exception else name
    regular = len(body) > 1 and body[0] == body[-1] == "/"
    if not body or regular or re.match(r"!|\[", name) or re.search(r"#@?[?$%]?#|\$", body):
        return None
    domain = body.startswith("||")
    begin = not domain and body.startswith("|")
    body = re.sub(r"^[A-Za-z*]*://", "", body.lstrip("|")) if domain or begin else body
    end = body.endswith("|")
    body = body[:-1] if end else body
    if not body.strip("*"):
        return None
    # a token at an open side, or beside a star, may be part of a longer one
    bounded = ("" if domain or begin else "*") + body + ("" if end else "*")
    whole = re.sub(r"(?<=\*)[A-Za-z0-9]+|[A-Za-z0-9]+(?=\*)", "", bounded)
    pattern = "".join(FILTER_PARTS.get(c) or re.escape(c) for c in body)
    head = r"\A(?:[^/]*\.)?" if domain else r"\A" if begin else ""
    pattern = f"(?ai:{head}{pattern}{'\\Z' if end else ''})"
    return Rule(name, "allow" if exception else "block", pattern, tuple(tokens_of(whole)), False, 0, exception)


def filter_rules(lines: DataFrame, line_col: str = "line") -> list[Rule]:
    """The rules of a table of filter lines, each once, in the order of their text; more than `MAX_RULES` are refused."""
    rows = lines.select(line_col).where(F.col(line_col).isNotNull()).distinct().orderBy(line_col)
    rows = rows.limit(2 * MAX_RULES).collect()  # as many lines again may hold no rule
    if len(rows) == 2 * MAX_RULES:
        raise ValueError(f"{len(rows)} filter lines or more; at most {MAX_RULES} rules can be sent to the tasks")
    return [rule for r in rows if (rule := filter_line(r[0]))]


def split_url(url: str | None) -> tuple[str, str]:
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    rest = re.split("[?#]", rest, maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), slash + path


def token_counts(pages: DataFrame, rules: Sequence[Rule], url_col: str = "url") -> dict[str, int]:
    """How many URLs hold each token of the rules, over all rows."""
    wanted = frozenset(t.translate(LOWER) for r in rules for t in r.tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count: dict[str, int] = defaultdict(int)
            for url in batch.column(0):
                for t in wanted.intersection(tokens_of("".join(split_url(url.as_py())))):
                    count[t] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["t", "n"]
            )

    counted = pages.select(url_col).mapInArrow(run, "t string, n bigint").groupBy("t").agg(F.sum("n").alias("n"))
    return {r.t: r.n for r in counted.collect()}


class Index:
    """Rules by their rarest token."""

    def __init__(self, rules: Sequence[Rule], counts: dict[str, int]):
        order = lambda r: (not r.listed, not r.exception, -len(r.name), -r.host_length)
        self.rules = sorted(rules, key=order)
        self.by_token: dict[str, list[int]] = defaultdict(list)
        self.always: list[int] = []
        for i, rule in enumerate(self.rules):
            if rule.tokens:
                tokens = (t.translate(LOWER) for t in rule.tokens)
                self.by_token[min(tokens, key=lambda t: (counts.get(t, 0), t))].append(i)
            else:
                self.always.append(i)
        self.by_token = dict(self.by_token)
        self.compiled: dict[int, re.Pattern] = {}

    def find(self, host: str, path: str) -> Rule | None:
        """The first rule, in the order of precedence, among the candidates whose expression fits."""
        text = host + path
        candidates = set(self.always)
        for token in tokens_of(text):
            candidates.update(self.by_token.get(token, ()))
        for i in sorted(candidates):
            if i not in self.compiled:
                self.compiled[i] = re.compile(self.rules[i].pattern)
            if self.compiled[i].search(text):
                return self.rules[i]
        return None


def judge(
    pages: DataFrame,
    rules: Sequence[Rule],
    default: str = "allow",
    keep: Sequence[str] = ("page_id",),
    url_col: str = "url",
) -> DataFrame:
    """Columns ``keep`` of every row with ``host, path, rule`` (listed, else null), ``verdict`` and ``pattern``,
    the method's own rule that gave the verdict where no listed one fits."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} can be sent to the tasks")
    counts = token_counts(pages, rules, url_col)
    rules = list(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(rules, counts)
        for batch in batches:
            rows = []
            for url in batch.column(0):
                host, path = split_url(url.as_py())
                rule = index.find(host, path) if host or path else None
                name = rule.name if rule and rule.listed else None
                own = rule.name if rule and not rule.listed else None
                rows.append((host, path, name, rule.action if rule else default, own))
            made = [pa.array([r[i] for r in rows], pa.string()) for i in range(5)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], *made], names=[*keep, "host", "path", "rule", "verdict", "pattern"]
            )

    narrow = pages.select(F.col(url_col).alias("_url"), *keep)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[1:]]
    kind = "host string, path string, rule string, verdict string, pattern string"
    return narrow.mapInArrow(run, ", ".join([*kept, kind]))
