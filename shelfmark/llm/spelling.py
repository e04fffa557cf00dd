"""Spelling variants of a vocabulary, found through a dictionary of pairs of trie nodes.

The distinct words are the paths of two tries, one of the words as they are and one of the reversed words, whose nodes are numbered. A
word with a gap is a pair of integers: the node of what stands before the gap, and the reversed trie's node of what stands after it.
A word gives the pairs that skip one of its code points and the pairs that skip none. Words that meet at a pair that both skip differ
by one replaced code point; a word that skips a code point meets the one that lacks it at a pair that skips none there. Of a run of
equal code points only the first is skipped for that, so every neighbour is met exactly once. No strings are compared.

The tries are numbered across partitions: words are range-partitioned and sorted, each task numbers the nodes that its words are the
first to reach, and nodes that reach over a border get the number of the partition where they begin; for that the driver holds one
border (two words and a path) a partition. In sorted order the number of a word's own node rises with the word, so it serves as the
word's name and settles ties as well.

A pair holds at most one word that skips nothing there and one word for each letter, so groups are bounded by the alphabet.
Occurrences are counted within tasks before they are shuffled. Forms lead to more frequent words, so chains are short; roots are found
by pointer jumping in rounds that double.

Null texts have no words; a null key counts as an empty one in the mangling. Repeated rows count each time. Without words there are no rows. Runs of any
length are taken whole: a word costs twice its length in pairs of integers. Only the key and the text are read, so other columns may
have any names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard

LEAST_LENGTH = 5
LEAST_COUNT = 3
EVERY = 97
RATIO = 2
HELD_WORDS = 200_000  # words that a task counts before it hands them on

# A-Z to a-z in bytes; a letter of a-z or of U+00C0 to U+00FF in UTF-8.
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_PART_BITS = 40


def _mangled(run: bytes, h: int) -> bytes:
    """The run without its code point number h modulo its length."""
    letters = run.decode("utf-8")
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode("utf-8")


def document_words(key: object, text: str, every: int = EVERY) -> Counter:
    """The words of one text with their counts; a run whose hash with the key ``every`` divides loses a code point."""
    start = zlib.crc32(f"{'' if key is None else key}:".encode())
    out: Counter = Counter()
    for run, n in Counter(_RUN.findall(text.encode("utf-8", "surrogatepass").translate(_LOWER))).items():
        h = zlib.crc32(run, start)
        out[_mangled(run, h) if h % every == 0 else run] += n
    return out


def vocabulary(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int = EVERY) -> DataFrame:
    """word and n of all words that are long and frequent enough."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def rows() -> pd.DataFrame:
            words = [(w.decode("utf-8"), n) for w, n in held.items()]
            return pd.DataFrame([x for x in words if len(x[0]) >= least_length], columns=["word", "n"]).astype({"n": "int64"})

        for pdf in batches:
            for key, text in zip(pdf["key"], pdf["text"], strict=True):
                held.update(document_words(key, text, every))
                if len(held) > HELD_WORDS:
                    yield rows()
                    held.clear()
        yield rows()

    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(key_col).cast("string").alias("key"), F.col(text_col).alias("text"))
    return rows.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _shared(a: str, b: str) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted paths of a partition to the numbers of their nodes, and how much each shares with the partition's first path."""
    part = TaskContext.get().partitionId()
    following = (part << _PART_BITS) + 1
    first = last = None
    nodes = np.empty(0, dtype=np.int64)
    for pdf in batches:
        out, with_first = [], []
        for path in pdf["path"]:
            same = 0 if last is None else _shared(path, last)
            new = len(path) - same
            nodes = np.concatenate([nodes[:same], np.arange(following, following + new)])
            following += new
            first, last = path if first is None else first, path
            out.append(nodes)
            with_first.append(_shared(path, first))
        yield pd.DataFrame({"part": np.full(len(out), part, dtype=np.int32), "word": pdf["word"], "path": pdf["path"], "nodes": out, "shared": np.array(with_first, dtype=np.int32)})


def trie_nodes(words: DataFrame, reverse: bool = False) -> DataFrame:
    """word and nodes: the numbers of the nodes on its path from the root (which is 0), in the trie of all words or of all reversed words."""
    spark = words.sparkSession
    path = F.reverse("word") if reverse else F.col("word")
    ordered = words.select("word", path.alias("path")).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").sortWithinPartitions("path")
    local = cut(ordered.mapInPandas(_number, "part int, word string, path string, nodes array<long>, shared int"), "nodes")
    borders = local.groupBy("part").agg(F.min("path").alias("first"), F.max("path").alias("last"), F.max_by("nodes", "path").alias("nodes"))
    before, passed, reach = "", [], []
    for b in sorted(borders.collect(), key=lambda r: r["part"]):  # one row a partition
        over = passed[: _shared(before, b["first"])]
        reach.append((b["part"], over))
        keep = min(len(over), _shared(b["first"], b["last"]))
        before, passed = b["last"], over[:keep] + b["nodes"][keep:]
    over = F.broadcast(spark.createDataFrame(reach, "part int, over array<long>"))
    k = F.least("shared", F.size("over"))
    own = F.slice("nodes", k + 1, F.size("nodes"))
    return local.join(over, "part").select("word", F.concat(F.array(F.lit(0).cast("long")), F.slice("over", 1, k), own).alias("nodes"))


def _pairs(named: DataFrame) -> DataFrame:
    """Rows before, after, id, n, skip and first of words (word, id, n, ahead, back): their pairs of nodes."""
    size = F.size("ahead") - 1
    at = lambda nodes, i: F.element_at(nodes, i + 1)
    repeats = lambda i: (i > 0) & (F.substr("word", i + 1, F.lit(1)) == F.substr("word", i, F.lit(1)))
    plain = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(at("ahead", i).alias("before"), at("back", size - i).alias("after"), F.lit(False).alias("skip"), F.lit(True).alias("first")))
    skips = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(at("ahead", i).alias("before"), at("back", size - i - 1).alias("after"), F.lit(True).alias("skip"), (~repeats(i)).alias("first")))
    return named.select("id", "n", F.explode(F.concat(plain, skips)).alias("p")).select("p.*", "id", "n")


def neighbours(named: DataFrame) -> DataFrame:
    """id, n_near and the best near word (best_n, best) of each word with near words."""
    member = F.struct((-F.col("n")).alias("order"), "id", "skip", "first")
    groups = _pairs(named).groupBy("before", "after").agg(F.collect_list(member).alias("all")).where(F.size("all") > 1)
    groups = groups.select(F.array_sort("all").alias("all"))

    def near(x):
        meets = lambda y: (x["skip"] & y["skip"] & (x["id"] != y["id"])) | (x["skip"] & x["first"] & ~y["skip"]) | (~x["skip"] & y["skip"] & y["first"])
        return F.filter("all", meets)

    found = groups.select(F.explode(F.transform("all", lambda x: F.struct(x["id"].alias("id"), near(x).alias("near")))).alias("m")).where(F.size("m.near") > 0)
    one = found.select("m.id", F.size("m.near").alias("k"), F.struct(F.col("m.near")[0]["order"].alias("order"), F.col("m.near")[0]["id"].alias("id")).alias("best"))
    best = one.groupBy("id").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))
    return best.select("id", "n_near", (-F.col("best.order")).alias("best_n"), F.col("best.id").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """id and root of links (id, form): where the chain of forms ends. Words without a form do not appear. Each round doubles the steps."""
    at = cut(links.select("id", F.col("form").alias("root")), "roots")
    while True:
        onward = at.select(F.col("id").alias("root"), F.col("root").alias("next"))
        new = cut(at.join(onward.hint("merge"), "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = not new.where("moved").isEmpty()
        discard(at)
        at = new
        if not moved:
            return at.select("id", "root")


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n and root of each word (word, n): its form is the near word with the largest count, the smallest such word
    among equals, if that count is at least ``ratio`` times its own; the root is where forms lead."""
    words = cut(words, "vocabulary")
    ahead, back = trie_nodes(words), trie_nodes(words, reverse=True)
    own = F.element_at("ahead", -1)
    both = words.join(ahead.withColumnRenamed("nodes", "ahead").hint("merge"), "word").join(back.withColumnRenamed("nodes", "back").hint("merge"), "word")
    named = cut(both.withColumn("id", own), "named")
    near = cut(neighbours(named), "near")
    told = named.select("id", "word", "n").join(near.hint("merge"), "id", "left").withColumn("form", F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best")))
    told = cut(told, "told")
    ends = roots(told.where("form is not null"))
    names = lambda i, w, n: named.select(F.col("id").alias(i), F.col("word").alias(w), F.col("n").alias(n)).hint("merge")
    out = told.join(names("form", "form_word", "form_n"), "form", "left").join(ends.hint("merge"), "id", "left").join(names("root", "root_word", "root_n"), "root", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("form_word").alias("form"), "form_n", F.coalesce("root_word", "word").alias("root"))


def digest(done: DataFrame) -> DataFrame:
    return done.select("word", "form", "root", "n", "n_near", "form_n")
