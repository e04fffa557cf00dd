"""Windows that also start earlier, found across documents without a row for each window.

A window is ``window`` consecutive units (bytes or words) of one document. Its anchor is the smallest mixed hash of the
``gram``-unit runs in it, so equal windows have equal anchors. Consecutive windows with one anchor form a segment; there is one
for about half a window's length. Only segments are shuffled, as (anchor, hash, document, place); they are computed once and
written as a table:

1. anchors that occur once anywhere hold no repeated window and are dropped after one aggregation;
2. segments with equal anchor and hash (128 bits of the content together) are one class. Its text goes to a shard chosen by the anchor, as
   its first and its last place, and the operator's own method marks the windows there that also start in an earlier one. The
   marks of the last place hold for all places after the first, since they see the same windows before them;
3. an anchor with more than ``HOT`` classes would outgrow its shard. Its windows become classes of their own: those that
   stand once are dropped, and the others go to shards chosen by their hash, to be marked by the same method.

Hashes choose what is looked at; nothing is removed that the operator's method has not marked.

Aggregations have map-side minima and the joins read written tables, so a passage that stands in a third of all documents, or
any number of copies, never gathers in one task. Texts are shuffled two times, as join partners of what concerns them.

A document is a row, known by its key and a hash of its text (``doc``, ``tid``). Repeated equal rows count as one document.
Rows with one key and different texts are different documents, ordered by key and then by that hash, and no span of one of them
is applied to another. Rows with a null key are kept whole and are no one's earlier occurrence. Texts shorter than a window, null
texts and empty tables have no spans.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, unused

HOT = 4_000
SHARD_BYTES = 3 << 18
SPANS = "array<struct<start:int,end:int>>"
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


@dataclass(frozen=True)
class Kind:
    """How texts become units and back.

    units: a text's hashes, one uint64 for each unit. cut: the bytes of the units from start to end, so that ``units`` of them
    gives the same hashes again.
    """

    window: int
    gram: int
    split: Callable[[str | None], object]
    hashes: Callable[[object], np.ndarray]
    cut: Callable[[object, int, int], bytes]
    again: Callable[[bytes], object]

    @property
    def run(self) -> int:
        return self.window - self.gram + 1


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


@lru_cache(maxsize=4)
def _powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        base, back = _BASES[which], np.uint64(_inverse(int(_BASES[which])))
        made = []
        for x in (base, back):
            p = np.full(size + 1, x, dtype=np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
    return made[0], made[1]


def _room(n: int) -> int:
    return 1 << max(12, math.ceil(math.log2(n + 1)))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of each number over all 64."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Sums:
    """Hashes of any run of units, from prefix sums."""

    def __init__(self, units: np.ndarray, which: int):
        n = len(units)
        up, self.down = _powers(which, _room(n))
        self.total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(units * up[:n], out=self.total[1:])

    def of(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start])

    def every(self, size: int) -> np.ndarray:
        """Of each run of this size."""
        n = len(self.total) - size
        return mix((self.total[size:] - self.total[:n]) * self.down[:n])


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """The least of each run of ``size`` numbers."""
    have, out = 1, x
    while have * 2 <= size:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    return out if have == size else np.minimum(out[: len(x) - size + 1], out[size - have : size - have + len(x) - size + 1])


def segments(units: np.ndarray, kind: Kind) -> tuple[np.ndarray, ...]:
    """anchor, hash, start, windows and whether the anchor stands more than once, of each segment of a document."""
    n = len(units) - kind.window + 1
    first, second = Sums(units, 0), Sums(units, 1)
    grams = first.every(kind.gram)
    least = sliding_min(grams, kind.run)
    start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    size = np.diff(np.append(start, n))
    if size.max() > 4 * kind.window:  # a text that repeats itself: pieces of bounded length
        extra = (size - 1) // (4 * kind.window)
        step = np.arange(extra.sum() + len(extra)) - np.repeat(np.concatenate([[0], np.cumsum(extra + 1)[:-1]]), extra + 1)
        start = np.repeat(start, extra + 1) + step * 4 * kind.window
        size = np.diff(np.append(start, n))
    anchor = least[start]
    seen = np.zeros(len(start), dtype=np.int64)
    ordered = np.sort(grams)
    twice = np.flatnonzero(np.isin(anchor, ordered[1:][ordered[1:] == ordered[:-1]]))
    if len(twice):
        reach = size[twice] + kind.run - 1
        head = np.concatenate([[0], np.cumsum(reach)[:-1]])
        at = np.repeat(start[twice] - head, reach) + np.arange(reach.sum())
        seen[twice] = np.add.reduceat(grams[at] == np.repeat(anchor[twice], reach), head, dtype=np.int64)
    return anchor.view(np.int64), second.of(start, start + size + kind.window - 1).view(np.int64), start, size, seen > 1


def _scan(docs: DataFrame, kind: Kind) -> DataFrame:
    """All segments: anchor, seg, doc, tid and span, which packs start, number of windows and whether the anchor stands again."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts: list[tuple] = []
            rows, many, held = [], [], 0
            for doc, tid, text in zip(pdf["doc"].tolist(), pdf["tid"].tolist(), pdf["text"].tolist(), strict=True):
                units = kind.hashes(kind.split(text))
                if len(units) < kind.window:
                    continue
                got = segments(units, kind)
                parts.append(got)
                rows.append((doc, tid))
                many.append(len(got[0]))
                held += len(got[0])
                if held > 200_000:
                    yield _rows(rows, many, parts)
                    parts, rows, many, held = [], [], [], 0
            if parts:
                yield _rows(rows, many, parts)

    return docs.mapInPandas(scan, "anchor long, seg long, doc long, tid long, span long")


def _rows(rows: list[tuple[int, int]], many: list[int], parts: list[tuple]) -> pd.DataFrame:
    anchor, seg, start, size, again = (np.concatenate(c) for c in zip(*parts, strict=True))
    doc, tid = np.array(rows, dtype=np.int64).T
    return pd.DataFrame({"anchor": anchor, "seg": seg, "doc": np.repeat(doc, many), "tid": np.repeat(tid, many), "span": start.astype(np.int64) << 32 | size.astype(np.int64) << 1 | again})


def starts(span):
    return span >> 32


def sizes(span):
    """Numbers of windows."""
    return (span & 0xFFFFFFFF) >> 1


def _start() -> Column:
    return F.shiftright("span", 32).cast("int")


def _size() -> Column:
    return F.shiftright(F.col("span").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), 1).cast("int")


def _texts(docs: DataFrame, reps: DataFrame, kind: Kind) -> DataFrame:
    """The bytes of classes, taken from their first documents: rows of ``_TEXT_COLS``."""
    wanted = reps.groupBy("doc", "tid").agg(F.collect_list(F.struct("anchor", "seg", "span", "two", "last", "hot")).alias("wanted"))

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, tid, text, wanted_ in zip(pdf["doc"], pdf["tid"], pdf["text"], pdf["wanted"], strict=True):
                parts = kind.split(text)
                for w in wanted_:
                    start = starts(w["span"])
                    last = w["last"]
                    rows.append((w["anchor"], w["seg"], doc, tid, w["span"], w["two"], last["doc"], last["tid"], last["span"], w["hot"], kind.cut(parts, start, start + sizes(w["span"]) + kind.window - 1)))
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=_TEXT_COLS)
                    rows = []
            yield pd.DataFrame(rows, columns=_TEXT_COLS)

    return docs.join(wanted, ["doc", "tid"]).select("doc", "tid", "text", "wanted").mapInPandas(take, _TEXT_SCHEMA)


# no column is null: pandas would turn longs with nulls into floats, which cannot hold them. ``two`` tells whether the last place counts.
_TEXT_COLS = ["anchor", "seg", "doc", "tid", "span", "two", "last_doc", "last_tid", "last_span", "hot", "body"]
_TEXT_SCHEMA = "anchor long, seg long, doc long, tid long, span long, two boolean, last_doc long, last_tid long, last_span long, hot boolean, body binary"
_MARKS = "anchor long, seg long, copy int, low int, high int"


def _copies(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows of classes at their first places (copy 0), and again at their last ones (copy 1) where there are such."""
    pdf = pdf.drop_duplicates(["anchor", "seg"])
    again = pdf[pdf["two"].astype(bool)]
    last = again.assign(doc=again["last_doc"], tid=again["last_tid"], span=again["last_span"])
    return pd.concat([pdf.assign(copy=0), last.assign(copy=1)]).drop(columns=["two", "last_doc", "last_tid", "last_span"]).reset_index(drop=True)


def _in_shards(bodies: DataFrame, mark: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """The operator's marks on classes (rows like those of ``_texts``, a written table), dealt to shards by their anchors."""
    held = bodies.agg(F.sum(F.octet_length("body")).alias("n")).first()["n"] or 0
    shards = max(1, math.ceil(held / SHARD_BYTES))
    dealt = bodies.drop("hot").withColumn("shard", F.pmod(F.xxhash64("anchor", F.lit("shard")), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(lambda pdf: mark(_copies(pdf)), _MARKS)


def _by_window(segs: DataFrame, kind: Kind, mark: Callable[[pd.DataFrame], pd.DataFrame], within: bool) -> tuple[DataFrame, list[DataFrame]]:
    """Marks on the classes of anchors with very many, each of their windows a class by itself, and the tables they rest on."""

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            pdf = _copies(pdf)
            for anchor, seg, copy, doc, tid, span, body in zip(*(pdf[c] for c in ("anchor", "seg", "copy", "doc", "tid", "span", "body")), strict=True):
                units = kind.hashes(kind.again(body))
                h = [Sums(units, k).every(kind.window).view(np.int64) for k in (0, 1)]
                off = np.arange(len(h[0]))
                out.append(pd.DataFrame({"h1": h[0], "h2": h[1], "doc": doc, "tid": tid, "place": starts(span) + off, "anchor": anchor, "seg": seg, "copy": copy, "off": off}))
            if out:
                yield pd.concat(out).astype({"place": "int32", "off": "int32", "copy": "int32"})

    def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for body, wanted in zip(pdf["body"], pdf["wanted"], strict=True):
                parts = kind.again(body)
                for w in wanted:
                    (doc, tid, at), (last_doc, last_tid, last_at) = ((x["doc"], x["tid"], x["place"] << 32 | 2) for x in (w["first"], w["last"]))
                    out.append((w["h1"], w["h2"], doc, tid, at, True, last_doc, last_tid, last_at, False, kind.cut(parts, w["off"], w["off"] + kind.window)))
            yield pd.DataFrame(out, columns=_TEXT_COLS)

    rows = cut(segs.mapInPandas(windows, "h1 long, h2 long, doc long, tid long, place int, anchor long, seg long, copy int, off int"), "hot-windows")
    place = F.struct("doc", "tid", F.col("place").cast("long").alias("place"))
    later = F.col("last") > F.col("first") if within else F.col("last.doc") > F.col("first.doc")
    found = cut(rows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.min(F.struct("anchor", "seg", "off")).alias("at")).where(later), "hot-classes")
    # a segment has a bounded number of windows
    wanted = found.groupBy("at.anchor", "at.seg").agg(F.collect_list(F.struct("h1", "h2", F.col("at.off").alias("off"), "first", "last")).alias("wanted"))
    bodies = segs.select("anchor", "seg", "body").join(wanted.hint("merge"), ["anchor", "seg"]).select("body", "wanted")
    bodies = cut(bodies.mapInPandas(cut_out, _TEXT_SCHEMA), "hot-bodies")
    confirmed = _in_shards(bodies, mark).where("copy = 1").select(F.col("anchor").alias("h1"), F.col("seg").alias("h2")).distinct()
    first = cut(found.join(confirmed.hint("merge"), ["h1", "h2"]).select("h1", "h2", "first"), "hot-first")
    after = place > F.col("first") if within else F.col("doc") > F.col("first.doc")
    marked = rows.join(first.hint("merge"), ["h1", "h2"]).where(after).select("anchor", "seg", "copy", F.col("off").alias("low"), (F.col("off") + 1).alias("high"))
    return marked, [rows, found, bodies, first]


def repeated(docs: DataFrame, kind: Kind, mark: Callable[[pd.DataFrame], pd.DataFrame], within: bool) -> DataFrame:
    """For each document with repeated windows, ``doc``, ``tid`` and the merged ``spans`` of units that they cover.

    docs: doc (long), tid (long), text. mark: for a shard's classes (rows of ``_copies``), rows anchor, seg, copy, low, high: window
    offsets that also start earlier. within: whether an earlier start in the same document, or in another one with its key, counts.
    """
    docs = docs.where("doc is not null and text is not null")
    found = cut(_scan(docs, kind), "segments")
    if found.where(_start() == 0).groupBy("doc", "tid").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        discard(found)
        docs = cut(docs.dropDuplicates(["doc", "tid"]), "different-rows")
        found = cut(_scan(docs, kind), "segments")
    live = found.groupBy("anchor").agg(F.min("seg").alias("s0"), F.max("seg").alias("s1"), F.count("*").alias("n"), F.max(F.col("span").bitwiseAND(F.lit(1).cast("long"))).alias("again"))
    live = cut(live.where("n > 1 or again = 1").select("anchor"), "anchors")
    places = cut(found.join(live, "anchor"), "places")
    discard(found)
    place = F.struct("doc", "tid", "span")
    classes = cut(places.groupBy("anchor", "seg").agg(F.min(place).alias("first"), F.max(place).alias("last")), "classes")
    later = F.col("last") > F.col("first") if within else F.col("last.doc") > F.col("first.doc")
    many = cut(classes.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("anchor", F.lit(True).alias("hot")), "hot-anchors")
    reps = classes.select("anchor", "seg", "first.doc", "first.tid", "first.span", later.alias("two"), "last").join(many, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    bodies = cut(_texts(docs, reps, kind), "bodies")
    marked = _in_shards(bodies.where("not hot"), mark)
    hot_tables: list[DataFrame] = []
    if many.limit(1).count():
        by_window, hot_tables = _by_window(bodies.where("hot"), kind, mark, within)
        marked = marked.unionByName(by_window)
    of = lambda k: F.collect_list(F.when(F.col("copy") == k, F.struct("low", "high")))
    marks = marked.groupBy("anchor", "seg").agg(of(0).alias("own"), of(1).alias("after"))
    judged = cut(classes.select("anchor", "seg", "first").join(marks, ["anchor", "seg"]), "judged")
    later = place > F.col("first") if within else F.col("doc") > F.col("first.doc")
    pieces = places.join(judged, ["anchor", "seg"]).select("doc", "tid", _start().alias("start"), F.when(later, F.col("after")).otherwise(F.col("own")).alias("marks")).where(F.size("marks") > 0)
    spans = F.transform("marks", lambda m: F.struct((F.col("start") + m["low"]).alias("start"), (F.col("start") + m["high"] + kind.window - 1).alias("end")))
    done = cut(pieces.select("doc", "tid", spans.alias("spans")).groupBy("doc", "tid").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    discard(docs, live, places, classes, many, bodies, judged, *hot_tables)
    return done


def with_spans(docs: DataFrame, key_col: str, text_col: str, kind: Kind, mark: Callable[[pd.DataFrame], pd.DataFrame], within: bool) -> tuple[DataFrame, str]:
    """``docs`` with a column of each row's own spans (null where there are none), and that column's name."""
    doc, tid = F.col(key_col).cast("long"), F.xxhash64(F.col(text_col))
    spans = repeated(docs.select(doc.alias("doc"), tid.alias("tid"), F.col(text_col).alias("text")), kind, mark, within)
    k, t, s = (unused(docs, n) for n in ("span_doc", "span_tid", "span_list"))
    found = spans.select(F.col("doc").alias(k), F.col("tid").alias(t), F.col("spans").alias(s))
    return docs.join(found, (doc == F.col(k)) & (tid == F.col(t)), "left").drop(k, t), s


def merge_spans(spans) -> list[tuple[int, int]]:
    """Sorted, touching or overlapping ones joined."""
    if spans is None or not len(spans):
        return []
    got = sorted((s["start"], s["end"]) for s in spans)
    out = [list(got[0])]
    for s, e in got[1:]:
        if s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def as_ranges(pdf: pd.DataFrame, row: np.ndarray, off: np.ndarray) -> pd.DataFrame:
    """Marked window offsets of the classes at ``row``, sorted within their classes, as ranges."""
    first = np.flatnonzero(np.concatenate([[True], (off[1:] != off[:-1] + 1) | (row[1:] != row[:-1])])) if len(off) else np.empty(0, np.int64)
    last = np.append(first[1:], len(off)) - 1 if len(off) else first
    named = pdf[["anchor", "seg", "copy"]].iloc[row[first]].reset_index(drop=True)
    return named.assign(low=off[first].astype(np.int32), high=(off[last] + 1).astype(np.int32)).astype({"copy": "int32"})
