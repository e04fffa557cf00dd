"""Toxicity by a classifier chain.

The categories are predicted one after the other: each linear model sees the words of a text and the probabilities of the
categories before it. In training those probabilities are out of fold: every training row gets them from a model that has not
seen it, as the rows to be judged later will.

Each link has words and a ridge of its own. Its words are the first of all the words of a bounded sample of labelled rows, in the order
of how far their document frequencies differ between the link's labels; how many (``SIZES``) and which ridge (``RIDGES``) is chosen by
the least out-of-fold loss. The sample has at most ``MOST_ROWS`` labelled keys, half of each label of the last category where there
are enough, least hash first; a key's label is the largest of its rows. Those keys are broadcast (their number is bounded) to find their texts; a text that
several rows hold counts once, with its largest labels, and where keys have so many texts that there are over ``MOST_ROWS``,
about that many are taken by a hash of the text. The words are counted on Spark, and the driver gets at most the largest of ``SIZES`` words for each
link and the sample's rows over them. Folds follow a hash of the text, so copies never sit in a fitted and a held-out fold.

Texts of any length are read whole. Null texts have no words. Rows whose labels are null or missing are judged, not learned from. Without labelled rows of both
values of a category its probability is the share of ones, or 0. Repeated rows get equal results; an empty table gives an empty one.
A column of the input with the result's name stays, as ``<name>_input``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, set_aside

SIZES = (320, 2048)
RIDGES = (2e-4, 2e-3)
MOST_ROWS = 6000
FOLDS = 4
LEAST_DOCS = 4
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Link:
    """One model of the chain: weights over the words, then over the earlier categories."""

    category: str
    words: np.ndarray
    earlier: np.ndarray
    bias: float


@dataclass(frozen=True)
class Chain:
    vocabulary: dict[str, int]
    links: tuple[Link, ...]

    def judge(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities: a row for each text, a column for each category."""
        known = frozenset(self.vocabulary)
        base = np.zeros((len(texts), len(self.links)))
        weights = np.stack([x.words for x in self.links])
        for k, text in enumerate(texts):
            at = [self.vocabulary[w] for w in known.intersection(words_of(text))]
            if at:
                base[k] = weights[:, at].sum(axis=1)
        out = np.zeros_like(base)
        for c, link in enumerate(self.links):
            out[:, c] = _sigmoid(base[:, c] + out[:, :c] @ link.earlier + link.bias)
        return out


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40.0, 40.0)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 2e-4, rounds: int = 300) -> tuple[np.ndarray, float]:
    """A linear model with logistic loss and equal weight of both labels, by accelerated gradient steps."""
    if y.min(initial=1) == y.max(initial=0) or not len(y):
        share = float(y.mean()) if len(y) else 0.0
        return np.zeros(x.shape[1], dtype=np.float32), 40.0 if share >= 1 else -40.0
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y == 0).sum()).astype(np.float32)
    step = 4.0 / float(weight @ (np.einsum("ij,ij->i", x, x) + 1.0))  # the slope changes by no more than this allows
    w, b = np.zeros(x.shape[1], dtype=np.float32), 0.0
    sw, sb, t = w.copy(), b, 1.0
    for _ in range(rounds):
        pull = (weight * (_sigmoid(x @ sw + sb) - y)).astype(np.float32)
        nw, nb = sw - np.float32(step) * (x.T @ pull + np.float32(ridge) * sw), sb - step * float(pull.sum())
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        sw, sb = nw + np.float32((t - 1) / nt) * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, float(b)


def _loss(p: np.ndarray, y: np.ndarray) -> float:
    """Mean logarithmic loss with equal weight of both labels."""
    p = np.clip(p.astype(np.float64), 1e-6, 1 - 1e-6)
    return -0.5 * (np.log(p[y > 0]).mean() if (y > 0).any() else 0.0) - 0.5 * (np.log(1 - p[y == 0]).mean() if (y == 0).any() else 0.0)


def _out_of_fold(x: np.ndarray, y: np.ndarray, fold: np.ndarray, folds: int, ridge: float) -> np.ndarray:
    """Each row's probability by a model of the other folds."""
    out = np.empty(len(x), dtype=np.float32)
    for k in range(folds):
        w, b = logistic(x[fold != k], y[fold != k], ridge)
        out[fold == k] = _sigmoid(x[fold == k] @ w + b)  # an empty fold is none to fill
    return out


def fit(x: np.ndarray, labels: np.ndarray, categories: list[str], vocabulary: list[str], fold: np.ndarray, folds: int = FOLDS, orders: list[np.ndarray] | None = None, sizes: tuple = SIZES, ridges: tuple = RIDGES) -> Chain:
    """x: rows over words (0 or 1). labels: rows over categories. fold: each row's number, below ``folds``. orders: for each category
    the columns of x, the most telling first; without them every link has all words."""
    chain, earlier = [], np.zeros((len(x), 0), dtype=np.float32)
    for c, name in enumerate(categories):
        y = labels[:, c].astype(np.float32)
        order = np.arange(x.shape[1]) if orders is None else orders[c]
        tried = []
        for size in sorted({min(s, len(order)) for s in sizes}):
            some = np.hstack([x[:, order[:size]], earlier])
            for ridge in ridges:
                kept_out = _out_of_fold(some, y, fold, folds, ridge)
                tried.append((_loss(kept_out, y), size, ridge, kept_out))
        _, size, ridge, kept_out = min(tried, key=lambda r: r[:3])
        w, b = logistic(np.hstack([x[:, order[:size]], earlier]), y, ridge)
        words = np.zeros(x.shape[1], dtype=np.float32)
        words[order[:size]] = w[:size]
        chain.append(Link(name, words, w[size:].copy(), b))
        earlier = np.hstack([earlier, kept_out[:, None]])
    return Chain({w: i for i, w in enumerate(vocabulary)}, tuple(chain))


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], key_col: str = "doc_id", text_col: str = "text", most_rows: int = MOST_ROWS) -> Chain:
    """The chain over ``categories`` (name to a 0/1 expression over ``labels``), in their order."""
    names = list(categories)
    flags = labels.select(F.col(key_col).alias("key"), *(c.cast("int").alias(n) for n, c in categories.items())).dropna().groupBy("key").agg(*(F.max(n).alias(n) for n in names))
    order = F.xxhash64(F.col("key").cast("string"), F.lit("toxicity sample"))
    halves = [flags.where(F.col(names[-1]) == v).orderBy(order, "key").limit(most_rows // 2) for v in (0, 1)]
    keys = F.broadcast(halves[0].unionByName(halves[1]))  # most_rows rows at most
    texts = docs.select(F.col(key_col).alias("key"), F.col(text_col).alias("text")).where("text is not null").join(keys, "key")
    mark = F.xxhash64("text", F.lit("toxicity fold"))
    found = cut(texts.groupBy(mark.alias("mark")).agg(F.first("text").alias("text"), *(F.max(n).alias(n) for n in names)), "labelled")
    many = found.count()
    rows = found.where(F.pmod("mark", F.lit(999_983)) < 999_983 * min(1.0, most_rows / max(many, 1)))

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: dict[str, np.ndarray] = {}
            flags_ = pdf[names].to_numpy()
            for text, flag in zip(pdf["text"], flags_, strict=True):
                for w in set(words_of(text)):
                    seen[w] = seen.get(w, 0) + np.concatenate([[1], flag])
            made = np.array(list(seen.values()), dtype=np.int64).reshape(-1, 1 + len(names))
            yield pd.DataFrame({"word": list(seen), "n": made[:, 0], **{f"n_{n}": made[:, i + 1] for i, n in enumerate(names)}})

    schema = "word string, n long, " + ", ".join(f"n_{n} long" for n in names)
    counts = rows.select("text", *names).mapInPandas(words, schema).groupBy("word").agg(F.sum("n").alias("n"), *(F.sum(f"n_{n}").alias(f"n_{n}") for n in names)).where(F.col("n") >= LEAST_DOCS)
    counts = cut(counts, "words")
    size = rows.agg(F.count("*").alias("all"), *(F.sum(n).alias(n) for n in names)).first()
    if not size["all"]:
        discard(found, counts)
        return Chain({}, tuple(Link(n, np.zeros(0), np.zeros(i), -40.0) for i, n in enumerate(names)))
    apart = []
    for n in names:  # difference of the shares in standard errors
        one, rest = max(size[n], 1), max(size["all"] - size[n], 1)
        p = F.col("n") / size["all"]
        apart.append(F.abs(F.col(f"n_{n}") / one - (F.col("n") - F.col(f"n_{n}")) / rest) / F.sqrt(p * (1 - p) * (1 / one + 1 / rest) + 1e-12))
    telling = [[r["word"] for r in counts.orderBy(a.desc(), "word").limit(max(SIZES)).select("word").collect()] for a in apart]
    vocabulary = sorted(set().union(*telling))
    at = {w: i for i, w in enumerate(vocabulary)}
    orders = [np.array([at[w] for w in ws], dtype=np.int64) for ws in telling]
    number = docs.sparkSession.sparkContext.broadcast(at)

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found_at = [sorted(number.value[w] for w in set(words_of(t)) if w in number.value) for t in pdf["text"]]
            yield pd.DataFrame({"mark": pdf["mark"], "at": found_at, **{n: pdf[n] for n in names}})

    got = rows.mapInPandas(places, "mark long, at array<int>, " + ", ".join(f"{n} int" for n in names)).toPandas().sort_values("mark").reset_index(drop=True)
    discard(found, counts)
    x = np.zeros((len(got), len(vocabulary)), dtype=np.float32)
    for k, places_ in enumerate(got["at"]):
        x[k, np.asarray(places_, dtype=np.int64)] = 1.0
    return fit(x, got[names].to_numpy(), names, vocabulary, (got["mark"].to_numpy() % FOLDS).astype(np.int64), orders=orders)


def predict(docs: DataFrame, chain: Chain, text_col: str = "text", out_col: str = "chain") -> DataFrame:
    """``docs`` with a struct of the probability of each category."""
    docs = set_aside(docs, out_col)
    held = docs.sparkSession.sparkContext.broadcast(chain)
    names = [x.category for x in chain.links]

    @F.pandas_udf("struct<" + ",".join(f"{n}:double" for n in names) + ">")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(held.value.judge(list(texts)), columns=names)

    return docs.withColumn(out_col, judge(F.col(text_col)))


def classify(docs: DataFrame, labels: DataFrame, key_col: str = "doc_id", text_col: str = "text", out_col: str = "chain") -> DataFrame:
    """The chain low quality, then toxic, trained on the labels and applied to all documents."""
    chain = train(docs, labels, {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}, key_col, text_col)
    return predict(docs, chain, text_col, out_col)


def digest(done: DataFrame) -> DataFrame:
    p = F.col("chain.toxic")
    return done.select("doc_id", F.col("chain.low_quality").alias("p_low_quality"), p.alias("p_toxic"), (p >= 0.5).alias("toxic"))
