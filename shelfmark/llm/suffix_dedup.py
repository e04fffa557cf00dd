"""Suffix-array deduplication: later copies of long byte strings go, the first stays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a document with a smaller key, or earlier in
the same document. Candidate regions come from ``windows``; a shard lays its segments end to end, ranks their suffixes, and orders
the window starts by suffix and, among equal ones, by their places. The longest previous factor of a start has the full length if the
start before it in that order shares so much, and then its window is marked. ``longest_previous_factors`` measures shorter ones
too, from previous and next smaller places. Strings are judged on the input, not on what is left.

Texts of any length are read whole, as segments of bounded length. Null text counts as empty. Nothing of a row with a null key is removed. Kept bytes may cut a character in two; the result is
binary. Repeated equal rows get equal results; rows with one key and different texts follow each other in the order of a hash of
their texts, so a string in both goes from the second (see ``windows``). An empty table gives an empty one. A column of the input with the
result's name stays, as ``<name>_input``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import set_aside
from .windows import Kind, as_ranges, merge_spans, sizes, with_spans

LENGTH = 100
GRAM = 32
RESULT = "struct<n_bytes:long,removed:array<struct<start:int,end:int>>,kept:binary>"

# a number for each byte: odd multiples spread over 64 bits
_BYTE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ (np.arange(1, 257, dtype=np.uint64) << np.uint64(40))


def _bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def _kind(length: int, gram: int) -> Kind:
    return Kind(length, gram, _bytes, lambda b: _BYTE[np.frombuffer(b, dtype=np.uint8)], lambda b, s, e: b[s:e], lambda b: b)


def _dense(key: np.ndarray, most: int) -> np.ndarray:
    """The rank of each key (none above ``most``) among the different keys."""
    n = len(key)
    bits = max(1, n.bit_length())
    if most.bit_length() + bits <= 63:  # key and place in one number: sorting numbers is much faster than sorting places
        both = np.sort(key << bits | np.arange(n))
        order, key = both & ((1 << bits) - 1), both >> bits
    else:
        order = np.argsort(key)
        key = key[order]
    rank, new = np.empty(n, dtype=np.int64), np.ones(n, dtype=bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    rank[order] = np.cumsum(new)
    return rank


def prefix_ranks(data: np.ndarray, depth: int) -> list[np.ndarray]:
    """Ranks of the suffixes by their first 1, 2, 4, ... bytes, up to ``depth`` or more; an end sorts first."""
    ranks, size, most = [data.astype(np.int64) + 1], 1, 256
    while size < depth:
        r = ranks[-1]
        nxt = np.zeros_like(r)
        nxt[: len(r) - size] = r[size:]
        key, most = r * (most + 1) + nxt, most * (most + 2)
        size *= 2
        if size > 2:  # two bytes are their own rank
            key = _dense(key, most)
            most = int(key.max(initial=0))
        ranks.append(key)
    return ranks


def common_prefix(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of what the suffixes at i and j share, up to the depth of the ranks."""
    n = len(ranks[0])
    out = np.zeros(len(i), dtype=np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        a, b = i + out, j + out
        inside = np.flatnonzero((a < n) & (b < n))
        # a rank covers ends as well, so only runs that lie inside the text count
        same = inside[(ranks[k][a[inside]] == ranks[k][b[inside]]) & (np.maximum(a[inside], b[inside]) + (1 << k) <= n)]
        out[same] += 1 << k
    return out


def previous_smaller(place: np.ndarray) -> np.ndarray:
    """For each entry, the nearest one before it with a smaller value; -1 if there is none. Candidates jump along each other's candidates."""
    back = np.arange(-1, len(place) - 1)
    todo = np.flatnonzero(back >= 0)
    while len(todo):
        todo = todo[back[todo] >= 0]
        todo = todo[place[back[todo]] > place[todo]]
        back[todo] = back[back[todo]]
    return back


def longest_previous_factors(data: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """For each of the ascending ``starts``, the longest string (up to ``depth`` or more) that also begins at an earlier start."""
    ranks = prefix_ranks(data, depth)
    suffix = starts[np.lexsort((starts, ranks[-1][starts]))]  # equal to full depth: by place
    before = previous_smaller(suffix)
    after = len(suffix) - 1 - previous_smaller(suffix[::-1])[::-1]
    best = np.zeros(len(suffix), dtype=np.int64)
    for other, has in ((before, before >= 0), (after, after < len(suffix))):
        at = np.flatnonzero(has)
        best[at] = np.maximum(best[at], common_prefix(ranks, suffix[at], suffix[other[at]]))
    out = np.empty(len(starts), dtype=np.int64)
    out[np.searchsorted(starts, suffix)] = best
    return out


def repeated_starts(data: np.ndarray, room: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of ``starts``, listed in the order of their places, have a longest previous factor of ``length`` bytes or more; ascending.

    data: segments end to end, each once, however many places it has. room: how many bytes each of their bytes has to the end of its segment.
    Suffixes are ranked by exactly ``length`` bytes, within their segments alone. Equal ones stand together in suffix order, by place, so the
    nearest earlier start of such a factor is the neighbour before; what shorter factors share need not be measured.
    """
    letters = np.flatnonzero(np.bincount(data, minlength=256))
    number = np.zeros(256, dtype=np.int64)
    number[letters] = np.arange(len(letters))
    width, bits = max(1, len(letters) - 1).bit_length(), max(1, len(data).bit_length())
    steps = [length]
    while steps[-1] * width + bits > 62 and steps[-1] > 1:
        steps.append((steps[-1] + 1) // 2)
    size = steps.pop()
    coded, key = np.append(number[data], np.zeros(size, dtype=np.int64)), np.zeros(len(data), dtype=np.int64)
    for k in range(size):
        key = key << width | coded[k : k + len(data)]
    at, most, rank = np.flatnonzero(room >= size), len(data), np.zeros(len(data), dtype=np.int64)
    rank[at] = _dense(key[at], 1 << width * size)
    for longer in reversed(steps):
        at = np.flatnonzero(room >= longer)
        # two runs that may overlap make the longer one
        rank[at], size = _dense(rank[at] * (most + 1) + rank[at + longer - size], most * (most + 2)), longer
    bits = max(1, len(starts).bit_length())
    both = np.sort(rank[starts] << bits | np.arange(len(starts)))
    again = np.flatnonzero(both[1:] >> bits == both[:-1] >> bits) + 1
    return np.sort(both[again] & ((1 << bits) - 1))


def _marker(length: int):
    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc", "tid", "span"])
        size = sizes(pdf["span"].to_numpy())
        # a class stands once in the text, whether it has one place or two
        body = pdf.groupby(["anchor", "seg"], sort=False).ngroup().to_numpy()
        _, one = np.unique(body, return_index=True)
        data = np.frombuffer(b"".join(pdf["body"].iloc[one]), dtype=np.uint8)
        reach = size[one] + length - 1
        begin = np.concatenate([[0], np.cumsum(reach)[:-1]])
        room = np.repeat(begin + reach, reach) - np.arange(len(data))
        row = np.repeat(np.arange(len(size)), size)
        off = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        marked = repeated_starts(data, room, begin[body[row]] + off, length)
        return as_ranges(pdf, row[marked], off[marked])

    return mark


def remove_repeats(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, out_col: str = "dedup") -> DataFrame:
    """``docs`` with a struct of the number of bytes, the removed runs and the kept bytes."""
    docs, s = with_spans(set_aside(docs, out_col), key_col, text_col, _kind(length, min(GRAM, max(1, length // 3))), _marker(length), within=True)

    @F.pandas_udf(RESULT)
    def strip(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, found in batches:
            rows = []
            for text, ss in zip(texts, found, strict=True):
                data, runs = _bytes(text), merge_spans(ss)
                kept, at = [], 0
                for s, e in runs:
                    kept.append(data[at:s])
                    at = e
                rows.append((len(data), [{"start": s, "end": e} for s, e in runs], b"".join([*kept, data[at:]])))
            yield pd.DataFrame(rows, columns=["n_bytes", "removed", "kept"])

    return docs.withColumn(out_col, strip(F.col(text_col), F.col(s))).drop(s)


def digest(done: DataFrame) -> DataFrame:
    removed = F.aggregate("dedup.removed", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return done.select("doc_id", F.col("dedup.n_bytes").alias("n_bytes"), removed.alias("n_removed"), F.size("dedup.removed").cast("long").alias("n_spans"), F.sha2("dedup.kept", 256).alias("kept_sha256"))
