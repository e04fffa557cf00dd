"""Benchmark decontamination as a prefix-filtered set join.

Every item is cut into windows of ``window`` words (an item with fewer words is one window). A window is the set of its word
shingles (one word each); containment must be complete, so the necessary prefix of a window, in the order of rarity, is its
rarest shingle: a text without it cannot contain the window. Rarity is the number of documents with that shingle, counted in one
pass over the whole corpus. Documents are joined on prefix tokens; a meeting at place p of a document and place o of a window is
kept only if the window fits into the document there (length and positional bounds), and then its words are compared.

The windows are a table. If they have at most ``BROADCAST_WORDS`` words together (counted as the operator counts words), the
index of that table is broadcast and the join is a lookup in each task. Otherwise the documents' occurrences of prefix tokens,
each with the words around it, are shuffled to the windows of that token and compared there, and the places come back to their
texts by a hash of the text. Both ways give the same places. A token that is the rarest of many windows and frequent in the corpus
is a skewed join key, which adaptive execution splits.

Texts of any length are read whole. Words are runs of letters, digits and non-ASCII characters with A-Z lower-cased. Null texts and items have no words; items
without words or without a key match nothing. Repeated items count one time for each item key, and different texts of one key are
all windows of it. A document word is hit if any occurrence of a window covers it; a document is contaminated if some word is hit
and hit words are at least a twentieth of all. Repeated documents get equal results; without documents there are none, and without
items nothing is hit. Columns of the input with the outputs' names stay, as ``<name>_input``.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, cut, discard, portions, set_aside, unused

WINDOW = 13
SHARE = 20  # contaminated when hit words * SHARE >= words
BROADCAST_WORDS = 1_300_000
PLACES = "array<struct<item:string,start:int,end:int>>"
FOUND = f"struct<n_words:long,places:{PLACES}>"
MARKS = 24  # bits of the bitmap of words


def item_windows(words: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    if len(words) <= window:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]


def windows_of(items: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The different windows of each item: item, win (an array of words)."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in np.array_split(np.arange(len(pdf)), len(pdf) // 64 + 1):
                rows = [(pdf["item"].iat[k], list(w)) for k in part for w in set(item_windows(alnum_words(pdf["text"].iat[k]), window))]
                yield pd.DataFrame(rows, columns=["item", "win"])

    keyed = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null")
    return keyed.mapInPandas(split, "item string, win array<binary>").distinct()


def _mark(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) >> (64 - MARKS)


class Bitmap:
    """A set of words as a bitmap of fixed size; a few other words seem to be in it."""

    def __init__(self, marks: list[int]):
        self.bits = bytearray(1 << (MARKS - 3))
        for m in marks:
            self.bits[m >> 3] |= 1 << (m & 7)

    def among(self, words: set[bytes]) -> list[bytes]:
        return [w for w in words if self.bits[(m := _mark(w)) >> 3] >> (m & 7) & 1]


class Listed:
    """A set of words as they are, where their number is bounded."""

    def __init__(self, words: list[bytes]):
        self.words = frozenset(words)

    def among(self, words: set[bytes]) -> frozenset[bytes]:
        return self.words.intersection(words)


def _bitmap(words: DataFrame) -> Broadcast:
    """Of the column ``word``. At most 2 ** MARKS different marks reach the driver, whatever the number of words."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"mark": [_mark(bytes(w)) for w in pdf["word"]]}, dtype="int32")

    marks = words.select("word").mapInPandas(mark, "mark int").distinct().toPandas()["mark"]
    return words.sparkSession.sparkContext.broadcast(Bitmap(marks.tolist()))


def document_counts(docs: DataFrame, words: Broadcast, text_col: str = "text") -> DataFrame:
    """In how many documents each word of a set (``Bitmap`` or ``Listed``) occurs, over all documents: word, n."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                total.update(words.value.among(set(alnum_words(text))))
            if len(total) > 200_000:
                yield _counted(total)
                total = Counter()
        yield _counted(total)

    return docs.select(F.col(text_col).alias("text")).mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(total: Counter) -> pd.DataFrame:
    return pd.DataFrame({"word": list(total.keys()), "n": list(total.values())}, columns=["word", "n"]).astype({"n": "int64"})


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Each different window with its rarest word and that word's place in it; ties go to the earlier place: win, token, off, n_words."""
    words = windows.select("win").distinct().select("win", F.posexplode("win").alias("off", "token"))
    rarity = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off")
    best = words.join(counts.withColumnRenamed("word", "token"), "token", "left").groupBy("win").agg(F.min(F.struct(rarity.alias("r"), "token")).alias("b"), F.count("*").alias("n_words"))
    return best.select("win", F.col("b.token").alias("token"), F.col("b.r.off").alias("off"), F.col("n_words").cast("int").alias("n_words"))


class PrefixIndex:
    """Windows by their rarest word, with their items."""

    def __init__(self, rows: pd.DataFrame):
        self.items: dict[tuple[bytes, ...], list[str]] = defaultdict(list)
        self.by_token: dict[bytes, list[tuple[int, tuple[bytes, ...]]]] = defaultdict(list)
        known: dict[bytes, bytes] = {}
        one = lambda w: known.setdefault(b := bytes(w), b)  # noqa: E731  # windows share their words
        for win, token, off, item in zip(rows["win"], rows["token"], rows["off"].tolist(), rows["item"], strict=True):
            w = tuple(map(one, win))
            if w not in self.items:
                self.by_token[one(token)].append((off, w))
            self.items[w].append(item)
        self.tokens = frozenset(self.by_token)

    def places(self, words: list[bytes]) -> list[tuple[str, int, int]]:
        """Item, first word and end of the stretches that the item's windows cover."""
        meet = self.tokens.intersection(words)
        if not meet:
            return []
        hits = []
        for p, word in enumerate(words):
            if word in meet:
                for o, w in self.by_token[word]:
                    start, end = p - o, p - o + len(w)
                    if start >= 0 and end <= len(words) and tuple(words[start:end]) == w:
                        hits += [(item, start, end) for item in self.items[w]]
        return stretches(hits)


def stretches(hits) -> list[tuple[str, int, int]]:
    """Places of each item that touch or overlap, as one; sorted by item and place."""
    found: dict[str, list[list[int]]] = defaultdict(list)
    for item, start, end in sorted(hits):
        runs = found[item]
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    return [(item, s, e) for item in sorted(found) for s, e in found[item]]


def _as_rows(places: list[tuple[str, int, int]]) -> list[dict]:
    return [{"item": i, "start": s, "end": e} for i, s, e in places]


def _look(held: Broadcast):
    @F.pandas_udf(FOUND)
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in portions(batches):
            rows = []
            for text in texts:
                words = alnum_words(text)
                rows.append((len(words), _as_rows(held.value.places(words))))
            yield pd.DataFrame(rows, columns=["n_words", "places"])

    return look


def _meetings(docs: DataFrame, tokens: Broadcast, window: int) -> DataFrame:
    """Occurrences of (seeming) prefix tokens: token, id, p, first (place of the first word around it), around.

    docs: id, text.
    """

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["id"], pdf["text"], strict=True):
                words = alnum_words(text)
                seen = set(tokens.value.among(set(words)))
                for p, w in enumerate(words if seen else ()):
                    if w in seen:
                        first = max(0, p - window + 1)
                        rows.append((w, key, p, first, words[first : p + window]))
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=["token", "id", "p", "first", "around"])
                    rows = []
            yield pd.DataFrame(rows, columns=["token", "id", "p", "first", "around"])

    return docs.mapInPandas(meet, "token binary, id binary, p int, first int, around array<binary>")


def _joined_places(docs: DataFrame, windows: DataFrame, index: DataFrame, window: int) -> DataFrame:
    """Places of items in each different text, by a hash of the text: id, places."""
    tokens = _bitmap(index.select(F.col("token").alias("word")).distinct())
    meetings = _meetings(docs.select(F.unhex(F.sha2(F.col("text"), 256)).alias("id"), "text").where("text is not null"), tokens, window)
    # the window's first word stands p - off - first words into the stretch around the token
    at = F.col("p") - F.col("off") - F.col("first")
    around = F.col("around")
    fits = (at >= 0) & (at + F.col("n_words") <= F.size(around))
    same = F.slice(around, F.greatest(at, F.lit(0)) + 1, F.col("n_words")) == F.col("win")
    hits = meetings.join(index, "token").where(fits & same).select("id", (F.col("p") - F.col("off")).alias("start"), "n_words", "win")
    places = hits.distinct().join(windows, "win").select("id", F.struct("item", "start", (F.col("start") + F.col("n_words")).alias("end")).alias("place"))
    merge = F.pandas_udf(lambda s: pd.Series([_as_rows(stretches((x["item"], x["start"], x["end"]) for x in xs)) for xs in s], dtype=object), PLACES)
    return places.groupBy("id").agg(merge(F.collect_set("place").cast(PLACES)).alias("places"))


def find_items(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", out_col: str = "contamination", window: int = WINDOW) -> DataFrame:
    """``docs`` with a struct of the number of words and the places of item windows."""
    docs = set_aside(docs, out_col)
    windows = cut(windows_of(items, window, item_col, item_text_col), "windows")
    size = windows.agg(F.sum(F.size("win")).alias("n")).first()["n"] or 0
    words = windows.select(F.explode("win").alias("word")).distinct()
    context = docs.sparkSession.sparkContext
    few = size <= BROADCAST_WORDS
    known = context.broadcast(Listed([bytes(r["word"]) for r in words.collect()])) if few else _bitmap(words)
    counts = document_counts(docs, known, text_col) if size else docs.sparkSession.createDataFrame([], "word binary, n long")
    index = cut(prefixes(windows, counts), "prefixes")
    if few:
        rows = windows.join(index, "win").toPandas()
        discard(windows, index)
        return docs.withColumn(out_col, _look(context.broadcast(PrefixIndex(rows)))(F.col(text_col)))
    found = cut(_joined_places(docs.select(F.col(text_col).alias("text")), windows, index, window), "places")
    discard(windows, index)
    count = F.pandas_udf(lambda s: s.map(lambda t: len(alnum_words(t))).astype("int64"), "long")
    key, n, places = (unused(docs, x) for x in ("text_id", "text_words", "text_places"))
    found = found.select(F.col("id").alias(key), F.col("places").alias(places))
    joined = docs.withColumn(n, count(F.col(text_col))).join(found, F.unhex(F.sha2(F.col(text_col), 256)) == F.col(key), "left")
    return joined.withColumn(out_col, F.struct(F.col(n).alias("n_words"), F.coalesce(places, F.array().cast(PLACES)).alias("places"))).drop(key, n, places)


def judge(found: DataFrame, col: str = "contamination") -> DataFrame:
    """n_words, n_hit, items (sorted) and contaminated, from the places."""
    runs = F.array_sort(F.transform(f"{col}.places", lambda p: F.struct(p["start"].alias("s"), p["end"].alias("e"))))
    hit = F.aggregate(
        runs,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, r: F.struct((a["n"] + F.greatest(F.lit(0), r["e"] - F.greatest(r["s"], a["to"]))).alias("n"), F.greatest(a["to"], r["e"]).alias("to")),
        lambda a: a["n"].cast("long"),
    )
    found = set_aside(found, "n_words", "n_hit", "items", "contaminated")
    out = found.withColumns({"n_words": F.col(f"{col}.n_words"), "n_hit": hit, "items": F.array_sort(F.array_distinct(F.transform(f"{col}.places", lambda p: p["item"])))})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


def digest(found: DataFrame) -> DataFrame:
    return judge(found).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )
