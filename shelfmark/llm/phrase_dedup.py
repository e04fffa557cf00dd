"""Substring deduplication with automata of recurring phrases.

A word goes if a window of ``WINDOW`` consecutive words that covers it also starts in a document with a smaller key. Candidate
regions come from ``windows``. A shard confirms by hashes which windows recur in segments of different documents, compiles those
alone, as passages of windows that always follow each other, into an Aho-Corasick automaton over word numbers, and streams the segments
that hold some through it in the order of their documents: the automaton locates every occurrence, and those after the first document's are marked. Segments equal to one another are
streamed at the first and the last of their places, and the marks of the last hold for those between, so every document's occurrences are found. Automata are sharded by
anchor and hold a bounded number of words; they are not broadcast, since the number of recurring phrases grows with the corpus.

Words stand between ASCII white space and stay as they are. Null text has no words. A row with a null key is kept whole. Repeated
equal rows get equal results; of rows with one key and different texts none is the earlier one (see ``windows``). An empty table gives
an empty one. A column of the input with the result's name stays, as ``<name>_input``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import set_aside, space_words
from .windows import Kind, Sums, as_ranges, merge_spans, mix, sizes, with_spans

WINDOW = 50
GRAM = 8
RESULT = "struct<n_words:long,removed:array<struct<start:int,end:int>>,kept:string>"
AUTOMATON_WORDS = 200_000


class _Hashes(dict):
    """The hash of each word met so far."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word, 7) | 1
        return h


_seen = _Hashes()


def _hashes(words: list[bytes]) -> np.ndarray:
    if len(_seen) > 500_000:
        _seen.clear()
    return np.fromiter(map(_seen.__getitem__, words), dtype=np.uint64, count=len(words))


def _kind(window: int, gram: int) -> Kind:
    return Kind(window, gram, space_words, _hashes, lambda w, s, e: b" ".join(w[s:e]), bytes.split)


def _numbered(bodies: pd.Series) -> np.ndarray:
    """A number for each word of all bodies, one after the other. Numbers skip the surrogates."""
    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    words = b" ".join(bodies).split()
    code = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words)) + 1
    return np.where(code < 0xD800, code, code + 0x800)


def _marker(window: int):
    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["anchor", "doc", "tid", "span"]).reset_index(drop=True)
        weight = pd.Series(sizes(pdf["span"].to_numpy()) + window).cumsum()
        # whole anchors, of about AUTOMATON_WORDS words, make one automaton
        bucket = (weight // AUTOMATON_WORDS).groupby(pdf["anchor"]).transform("min")
        return pd.concat([_mark_some(part, window) for _, part in pdf.groupby(bucket)])

    return mark


def passages(h: np.ndarray, row: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the passages that recur in different documents start, their numbers of windows, and the hashes of their first windows.

    h, row: hash and segment of each window, in order. doc: document of each segment. A passage is the longest run of windows that follow
    each other wherever one of them stands, so each window is in one passage only, and one that recurs stands whole at each of its places.
    """
    n = len(h)
    order = np.argsort(h)
    new = np.concatenate([[True], h[order[1:]] != h[order[:-1]]])
    head = np.flatnonzero(new)
    own = np.empty(n, dtype=np.int64)
    own[order] = np.cumsum(new) - 1

    def only(x: np.ndarray) -> np.ndarray:
        least = np.minimum.reduceat(x[order], head)
        return np.where(least == np.maximum.reduceat(x[order], head), least, -1)

    same = row[1:] == row[:-1]
    after, before = only(np.append(np.where(same, own[1:], -1), -1)), only(np.append(-1, np.where(same, own[:-1], -1)))
    joined = (after >= 0) & (before[after] == np.arange(len(head)))
    at = np.flatnonzero(np.append(True, ~joined[own[:-1]]))
    many = np.diff(np.append(at, n))
    of = doc[row][order]
    recur = np.minimum.reduceat(of, head) != np.maximum.reduceat(of, head)
    live = recur[own[at]]
    return at[live], many[live], h[at[live]]


def _mark_some(pdf: pd.DataFrame, window: int) -> pd.DataFrame:
    code, size = _numbered(pdf["body"]), sizes(pdf["span"].to_numpy())
    many = size + window - 1
    begin = np.cumsum(many) - many
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + begin[row]
    doc = pdf["doc"].to_numpy()
    place, count, h = passages(Sums(mix(code.astype(np.uint64)), 0).every(window)[at], row, doc)
    if not len(place):
        return as_ranges(pdf, np.empty(0, np.int64), np.empty(0, np.int64))
    _, one = np.unique(h, return_index=True)
    held, count = np.unique(row[place]), count[one].tolist()
    letters = code.astype("<u4").tobytes().decode("utf-32-le")
    machine = ahocorasick.Automaton()
    for k, (p, n) in enumerate(zip(at[place[one]].tolist(), count, strict=True)):
        machine.add_word(letters[p : p + n + window - 1], k)
    machine.make_automaton()
    first: dict[int, int] = {}
    found, off, length = [], [], []
    # a segment without a window that recurs has no passage
    for k, b, n, own in zip(held.tolist(), begin[held].tolist(), many[held].tolist(), doc[held].tolist(), strict=True):
        for end, which in machine.iter(letters[b : b + n]):
            if first.setdefault(which, own) < own:
                found.append(k)
                off.append(end - window + 2 - count[which])
                length.append(count[which])
    length = np.array(length, dtype=np.int64)
    step = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    return as_ranges(pdf, np.repeat(np.array(found, dtype=np.int64), length), np.repeat(np.array(off, dtype=np.int64), length) + step)


def remove_phrases(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, out_col: str = "dedup") -> DataFrame:
    """``docs`` with a struct of the number of words, the removed runs of words and the kept words."""
    docs, s = with_spans(set_aside(docs, out_col), key_col, text_col, _kind(window, min(GRAM, max(1, window // 3))), _marker(window), within=False)

    @F.pandas_udf(RESULT)
    def strip(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, found in batches:
            rows = []
            for text, ss in zip(texts, found, strict=True):
                words, runs = space_words(text), merge_spans(ss)
                kept, at = [], 0
                for s, e in runs:
                    kept += words[at:s]
                    at = e
                rows.append((len(words), [{"start": s, "end": e} for s, e in runs], b" ".join(kept + words[at:]).decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(rows, columns=["n_words", "removed", "kept"])

    return docs.withColumn(out_col, strip(F.col(text_col), F.col(s))).drop(s)


def digest(done: DataFrame) -> DataFrame:
    removed = F.aggregate("dedup.removed", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return done.select("doc_id", F.col("dedup.n_words").alias("n_words"), removed.alias("n_removed"), F.sha2("dedup.kept", 256).alias("kept_sha256"))
