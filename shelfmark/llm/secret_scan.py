"""Secret scans through trigram indexes.

Each rule's regular expression is turned into a Boolean query over trigrams that every match must contain. Texts are
indexed in segments of bounded size inside each task: postings map a trigram to the segment's documents. A rule's query is
answered by intersecting and uniting postings, and only the candidates it leaves are verified with the expression itself. A
rule from which no mandatory trigram follows (runs of hex digits) scans every text. Postings hold only trigrams that some
rule asks for, so a segment's index is far smaller than its texts, and no text is ever shuffled.

Null text counts as empty. Offsets are code points, ends are exclusive. Spans that start together follow the order of the rules.
Rows, their order within a partition and all other columns stay as they are; repeated rows get equal results, and an empty table
gives an empty one. A column of the input with the result's name stays, as ``<name>_input``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from re import _constants as rx
from re import _parser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import portions, set_aside

SPANS = "array<struct<kind:string,start:int,end:int>>"
SEGMENT_BYTES = 2 << 20
_MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters; matches are leftmost, not overlapping."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The base rules, in their order.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
# Further published token formats.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("hosting_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("url_login", r"https?://[A-Za-z0-9._%-]{1,64}:[A-Za-z0-9._%-]{1,64}@"),
)
RULES = BASE_RULES + MORE_RULES

# A query is None (anything), a trigram, ("and", parts) or ("or", parts).
Query = None | bytes | tuple


def _both(*parts: Query) -> Query:
    parts = [p for p in dict.fromkeys(parts) if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _either(*parts: Query) -> Query:
    if not parts or any(p is None for p in parts):
        return None
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[str]) -> Query:
    """What holds of a text with one of these strings in it."""
    folded = [s.encode().lower() for s in sorted(strings)]
    return _either(*(_both(*(b[i : i + 3] for i in range(len(b) - 2))) for b in folded))


def _walk(nodes) -> tuple[set[str] | None, Query]:
    """The strings that the nodes match, if few, and a query that every match satisfies."""
    known, query, whole = {""}, None, True
    for op, arg in nodes:
        exact, own = _one(op, arg)
        if exact is not None and len(known) * len(exact) <= _MOST_STRINGS:
            known = {a + b for a in known for b in exact}
            continue
        query = _both(query, _of_strings(known), own if exact is None else _of_strings(exact))
        known, whole = {""} if exact is None else exact, False
    return (known, None) if whole else (None, _both(query, _of_strings(known)))


def _one(op, arg) -> tuple[set[str] | None, Query]:
    if op is rx.LITERAL:
        return {chr(arg)}, None
    if op is rx.IN:
        if len(arg) <= 8 and all(kind is rx.LITERAL for kind, _ in arg):
            return {chr(c) for _, c in arg}, None
        return None, None
    if op is rx.SUBPATTERN:
        return _walk(arg[-1])
    if op is rx.BRANCH:
        found = [_walk(x) for x in arg[1]]
        if all(e is not None for e, _ in found) and sum(len(e) for e, _ in found) <= _MOST_STRINGS:
            return set().union(*(e for e, _ in found)), None
        return None, _either(*(q if e is None else _of_strings(e) for e, q in found))
    if op in (rx.MAX_REPEAT, rx.MIN_REPEAT):
        low, high, body = arg
        exact, own = _walk(body)
        if exact is not None and (low, high) == (0, 1):
            return exact | {""}, None
        if exact is not None and low == high and len(exact) == 1:
            return {next(iter(exact)) * low}, None
        return None, (own if exact is None else _of_strings(exact)) if low else None
    if op in (rx.AT, rx.ASSERT, rx.ASSERT_NOT):
        return {""}, None
    return None, None


@lru_cache(maxsize=256)
def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of a regular expression, over texts with A-Z folded; None if nothing is mandatory."""
    exact, query = _walk(_parser.parse(pattern))
    return query if exact is None else _of_strings(exact)


def _trigrams(query: Query) -> set[bytes]:
    if query is None:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(_trigrams, query[1]))


class Segment:
    """Postings of a run of texts, for the wanted trigrams only."""

    def __init__(self, texts: list[bytes], wanted: np.ndarray):
        self.size = len(texts)
        joined = np.frombuffer(b"\0\0".join(texts).lower() + b"\0\0", dtype=np.uint8)
        starts = np.cumsum([0] + [len(t) + 2 for t in texts[:-1]])
        code = joined[:-2].astype(np.int32)
        code <<= 8
        code |= joined[1:-1]
        code <<= 8
        code |= joined[2:]
        at = np.flatnonzero(wanted[code])
        key = np.unique(code[at].astype(np.int64) * self.size + np.searchsorted(starts, at, "right") - 1)
        gram, doc = key // self.size, key % self.size
        edges = np.flatnonzero(np.diff(gram, prepend=-1))
        self.postings = {int(gram[i]): docs for i, docs in zip(edges, np.split(doc, edges[1:]), strict=True)} if len(key) else {}

    def candidates(self, query: Query) -> np.ndarray:
        if query is None:
            return np.arange(self.size)
        if isinstance(query, bytes):
            return self.postings.get(int.from_bytes(query, "big"), np.empty(0, np.int64))
        join = np.intersect1d if query[0] == "and" else np.union1d
        return reduce(join, map(self.candidates, query[1]))


@lru_cache(maxsize=8)
def _plan(rules: tuple[Rule, ...]):
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = np.zeros(1 << 24, dtype=bool)
    for gram in set().union(*map(_trigrams, queries)):
        wanted[int.from_bytes(gram, "big")] = True
    return [(r, re.compile(r.pattern, re.ASCII), q) for r, q in zip(rules, queries, strict=True)], wanted


def _scan(texts: list[str], rules: tuple[Rule, ...]) -> list[list[tuple]]:
    plan, wanted = _plan(rules)
    out: list[list[tuple]] = [[] for _ in texts]
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    begin = 0
    while begin < len(coded):
        end, room = begin + 1, SEGMENT_BYTES - len(coded[begin])
        while end < len(coded) and len(coded[end]) <= room:
            room -= len(coded[end])
            end += 1
        segment = Segment(coded[begin:end], wanted)
        for order, (rule, pattern, query) in enumerate(plan):
            for k in segment.candidates(query):
                for m in pattern.finditer(texts[begin + int(k)]):
                    if len(m[rule.group]) >= rule.least:
                        out[begin + int(k)].append((m.start(), order, m.end()))
        begin = end
    return [[(rules[o].kind, s, e) for s, o, e in sorted(found)] for found in out]


def secret_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of a text, by start and then in the order of the rules."""

    @F.pandas_udf(SPANS)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in portions(batches, SEGMENT_BYTES):
            yield pd.Series(_scan(["" if t is None else t for t in texts], rules), dtype=object)

    return spans(text)


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", out_col: str = "spans") -> DataFrame:
    """``docs`` with a column of the secrets' spans."""
    return set_aside(docs, out_col).withColumn(out_col, secret_spans(F.col(text_col), rules))


def _cut_out(text: str, spans: list[tuple], mark: str) -> str:
    parts, at = [], 0
    for _, start, end in spans:
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join(parts) + text[at:]


def redact(text: Column, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> Column:
    """The text with every span replaced by a mark, overlapping spans becoming one; null stays null."""

    @F.pandas_udf("string")
    def redacted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in portions(batches, SEGMENT_BYTES):
            found = _scan(["" if t is None else t for t in texts], rules)
            yield pd.Series([_cut_out(t, ss, mark) if ss else t for t, ss in zip(texts, found, strict=True)], dtype=object)

    return redacted(text)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, hash of the base spans, and all spans as text."""
    text = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    base = [r.kind for r in BASE_RULES]
    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(text(of(*base)), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )
