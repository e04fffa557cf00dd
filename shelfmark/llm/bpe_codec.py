"""BPE encoding and decoding through an index of pair occurrences.

Texts are normalized (NFC, white space, lower case) and split into words. The different words of a portion of a partition are
laid out as one chain of symbols, and an index maps each pair that merges, by its rank, to all its positions. The active ranks
are applied in ascending order: at all positions of a rank that still hold its pair the two symbols become one, and the pairs
that this makes with the neighbours are added to the lists of their own ranks. In a vocabulary where no merge makes a pair of
lower rank than its own (checked when it is loaded) each rank comes up once, and every word ends as if it were merged alone.
Ranks with few positions are applied one by one, others as arrays.

Work is per row: nothing is shuffled, and no text is cut. Null text counts as empty, repeated rows get equal results, and an empty
table gives an empty one. A column of the input with an output's name stays, as ``<name>_input``. The vocabulary is read from a
path that every executor has (a parameter); it is never copied into data.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PORTION, portions, set_aside, unused

MANY = 1 << 17  # positions that enter the index at once
FEW = 40  # positions of a rank that are merged one by one
SLICE = 1 << 19  # characters whose results leave a worker at once

# White space as Unicode's White_Space property has it.
_SPACE = re.compile("[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def _byte_letters() -> dict[int, str]:
    """Printable stand-ins of the 256 bytes: printable Latin-1 stays, the others follow from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Vocabulary:
    """Ids, merges and special tokens of a tokenizers file whose pre-tokenizer is a split by words and bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        ids: dict[str, int] = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        letters = _byte_letters()
        self.inner = np.array([ids[letters[b]] for b in range(256)], dtype=np.int64)
        self.last = np.array([ids[letters[b] + end] for b in range(256)], dtype=np.int64)
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        named = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        self.size = max(named) + 1
        self.names = [named.get(i, "") for i in range(self.size)]
        pairs, made = [], {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, c = ids[left], ids[right], ids[left + right]
            if max(made.get(a, -1), made.get(b, -1)) > rank or c in made:
                raise ValueError("a merge makes a pair of lower rank; words would have to be merged one by one")
            made[c] = rank
            pairs.append((a * self.size + b, rank, c))
        pairs.sort()
        self.pairs, self.ranks, _ = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True))
        by_rank = sorted(pairs, key=lambda x: x[1])
        self.merged = np.array([c for _, _, c in by_rank], dtype=np.int64)
        self.none = len(self.merged)
        self.parts = [(*divmod(pair, self.size), made) for pair, _, made in by_rank]
        self.rank_by_pair = dict(zip(self.pairs.tolist(), self.ranks.tolist(), strict=True))
        self.words = regex.compile(data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        names = sorted(self.special, key=len, reverse=True)
        self.marks = re.compile("|".join(map(re.escape, names))) if names else None

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; ``none`` where it does not merge."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], self.none)

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words one after the other, and how many each has, through the index of pair occurrences."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        chain = Chain(self, b"".join(words), size)
        chain.merge()
        left = np.flatnonzero(chain.symbol >= 0)
        return chain.symbol[left].astype(np.int64), np.bincount(np.repeat(np.arange(len(words)), size)[left], minlength=len(words))

    def pieces(self, chunk: str) -> list[str]:
        """The words of a run without white space."""
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk)
        low = "".join(c.lower() for c in chunk) if "Σ" in chunk else chunk.lower()
        if low.isalpha():
            return [low]
        if low[-1:] in (".", ",") and low[:-1].isalpha():
            return [low[:-1], low[-1]]
        return self.words.findall(low)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        number: dict[str, int] = {}
        numbered = []
        for text in texts:
            parts: list[str] = []
            at = 0
            for m in self.marks.finditer(text) if self.marks else ():
                parts += [*_SPACE.split(text[at : m.start()]), m[0]]
                at = m.end()
            parts += _SPACE.split(text[at:] if at else text)
            numbered.append(np.array([number.setdefault(p, len(number)) for p in parts], dtype=np.int64))
        words: dict[str, int] = {}
        plan: list[int] = []  # the words of each chunk by number, or a special id below zero
        many = []
        for chunk in number:
            if chunk in self.special:
                plan.append(-1 - self.special[chunk])
                many.append(1)
            else:
                own = self.pieces(chunk)
                plan += [words.setdefault(w, len(words)) for w in own]
                many.append(len(own))
        ids, size = self.merge_all([w.encode("utf-8", "surrogatepass") for w in words])
        ids = np.concatenate([ids, np.arange(self.size)])  # special ids stand for themselves, at the end
        begin = np.concatenate([np.cumsum(size) - size, np.arange(self.size) + size.sum()])
        size = np.concatenate([size, np.ones(self.size, dtype=np.int64)])
        step = np.array(plan, dtype=np.int64)
        step = np.where(step < 0, len(words) - 1 - step, step)
        ids, size = _gather(ids, begin, size, step)  # of the chunks' words
        total = np.concatenate([[0], np.cumsum(size)])
        edge = np.concatenate([[0], np.cumsum(many)]).astype(np.int64)
        begin, size = total[edge[:-1]], total[edge[1:]] - total[edge[:-1]]
        ids = ids.astype(np.int32)
        return [_gather(ids, begin, size, own)[0] for own in numbered]

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by spaces, as a tokenizer without a decoder does; unknown ids vanish."""
        try:
            return " ".join(map(self.names.__getitem__, ids))
        except IndexError:
            return " ".join(self.names[i] for i in ids if i < self.size)


def _different(x: np.ndarray) -> np.ndarray:
    """Sorted, each once; the array may be empty."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class Chain:
    """Words as linked symbols, and the positions of every pair that merges, by rank.

    A symbol that went into its left neighbour is -1. The lists may hold positions whose pair has changed since; they are looked
    at again when their rank comes up.
    """

    def __init__(self, vocabulary: Vocabulary, data: bytes, size: np.ndarray):
        self.vocabulary = vocabulary
        bytes_ = np.frombuffer(data, dtype=np.uint8)
        n = len(bytes_)
        ends = np.cumsum(size)[size > 0] - 1
        symbol = vocabulary.inner[bytes_].astype(np.int32)
        symbol[ends] = vocabulary.last[bytes_[ends]]
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends] = -1
        before[ends[:-1] + 1] = -1
        # each column twice: as an array for long lists of positions, as machine integers for short ones
        self.columns = [array("i", x.tobytes()) for x in (symbol, after, before)]
        self.symbol, self.after, self.before = (np.frombuffer(c, dtype=np.int32) for c in self.columns)
        self.waiting: list[int] = []
        self.places: dict[int, list] = {}
        del symbol, after, before
        for begin in range(0, n, MANY):
            self.add(np.flatnonzero(self.after[begin : begin + MANY] >= 0).astype(np.int32) + np.int32(begin))

    def add(self, at: np.ndarray) -> None:
        """Enters the pairs that start at these positions."""
        rank = self.vocabulary.rank_of(self.symbol[at], self.symbol[self.after[at]])
        at, rank = at[rank < self.vocabulary.none], rank[rank < self.vocabulary.none]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        head = np.flatnonzero(np.diff(rank, prepend=-1))
        for r, some in zip(rank[head].tolist(), np.split(at, head[1:]), strict=True):
            self.list_of(r).append(some)

    def list_of(self, rank: int) -> list:
        if rank not in self.places:
            self.places[rank] = []
            heappush(self.waiting, rank)
        return self.places[rank]

    def merge(self) -> None:
        while self.waiting:
            rank = heappop(self.waiting)
            lists = self.places.pop(rank)
            few = sum(1 if isinstance(x, int) else len(x) for x in lists)
            if few <= FEW:
                self.merge_few(rank, sorted({p for x in lists for p in ((x,) if isinstance(x, int) else x.tolist())}))
            else:
                self.merge_many(rank, _different(np.concatenate([[x] if isinstance(x, int) else x for x in lists])))

    def merge_few(self, rank: int, places: list[int]) -> None:
        symbol, after, before = self.columns
        a, b, made = self.vocabulary.parts[rank]
        known, size = self.vocabulary.rank_by_pair, self.vocabulary.size
        for p in places:
            q = after[p]
            if symbol[p] != a or q < 0 or symbol[q] != b:
                continue
            symbol[p], symbol[q] = made, -1
            after[p] = s = after[q]
            if s >= 0:
                before[s] = p
                if (r := known.get(made * size + symbol[s])) is not None:
                    self.list_of(r).append(p)
            t = before[p]
            if t >= 0 and (r := known.get(symbol[t] * size + made)) is not None:
                self.list_of(r).append(t)

    def merge_many(self, rank: int, at: np.ndarray) -> None:
        symbol, after, before = self.symbol, self.after, self.before
        a, b, made = self.vocabulary.parts[rank]
        at = at[symbol[at] == a]
        right = after[at]
        holds = (right >= 0) & (symbol[right] == b)
        at, right = at[holds], right[holds]
        if a == b and len(at):  # in aaa only the first of two overlapping pairs merges
            head = np.flatnonzero(np.concatenate([[True], right[:-1] != at[1:]]))
            first = (np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))) % 2 == 0
            at, right = at[first], right[first]
        symbol[at], symbol[right] = made, -1
        after[at] = beyond = after[right]
        before[beyond[beyond >= 0]] = at[beyond >= 0]
        ahead = before[at]
        self.add(_different(np.concatenate([at[beyond >= 0], ahead[ahead >= 0]])))


def _gather(values: np.ndarray, begin: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``values`` that ``which`` names, one after the other, and their sizes."""
    many = size[which]
    at = np.repeat(begin[which] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    return values[at], many


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)


def _batches(batches: Iterator[pd.Series], vocabulary: Vocabulary) -> Iterator[list[np.ndarray]]:
    """Ids of the texts, indexed by portions and handed on in slices; a worker of the pipeline has room for about a million characters."""
    for texts in portions(batches, PORTION // 4):
        texts = ["" if t is None else t for t in texts]
        ids = vocabulary.encode_batch(texts)
        begin, held = 0, 0
        for end, t in enumerate(texts, 1):
            held += len(t)
            if held > SLICE or end == len(texts):
                yield ids[begin:end]
                begin, held = end, 0


def encode(text: Column, path: str) -> Column:
    """Token ids of a text."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for found in _batches(batches, load(path)):
            yield pd.Series(found, dtype=object)

    return ids(text)


def decode(ids: Column, path: str) -> Column:
    """The decoded text of token ids; null ids decode to an empty text."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = load(path)
        for found in portions(batches, PORTION // 32):
            yield pd.Series(["" if x is None else vocabulary.decode(x.tolist()) for x in found], dtype=object)

    return text(ids)


def encode_and_decode(text: Column, path: str) -> Column:
    """Struct (ids, decoded) in one pass: two chained passes would hold two Python workers, and all ids between them, for each task."""

    @F.pandas_udf("struct<ids:array<int>,decoded:string>")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocabulary = load(path)
        for ids in _batches(batches, vocabulary):
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": [vocabulary.decode(x.tolist()) for x in ids]})

    return both(text)


def encode_documents(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "token_ids", decoded_col: str | None = "decoded") -> DataFrame:
    """``docs`` with the token ids of the text and, if asked for, their decoded text."""
    docs = set_aside(docs, ids_col, *([decoded_col] if decoded_col else []))
    if not decoded_col:
        return docs.withColumn(ids_col, encode(F.col(text_col), path))
    named = unused(docs, "both")
    out = docs.withColumn(named, encode_and_decode(F.col(text_col), path))
    return out.withColumns({ids_col: F.col(f"{named}.ids"), decoded_col: F.col(f"{named}.decoded")}).drop(named)


def digest(done: DataFrame) -> DataFrame:
    """doc_id, number of tokens and hashes of the ids and of the decoded text."""
    return done.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
