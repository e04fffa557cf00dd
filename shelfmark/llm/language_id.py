"""Language identification by hierarchical discrimination.

A linear one-versus-rest machine picks the language family; within the family one-versus-one linear support vector machines
vote between the languages. Features are relative frequencies of hashed byte n-grams of the whole lower-cased text. Training
uses a bounded sample of labelled rows: of each language about ``PER_LANGUAGE`` different texts, about ``MOST_ROWS`` in all, and
one at least, spread by a hash of the text; a text counts once for a language, however many rows hold it. Every language of
the labels is learned; only their number, that of the world's languages, has no bound of its own. The n-gram frequencies are counted on
Spark and only that many small vectors reach the driver. Prediction is a sum of weights per n-gram inside each task.

Texts of any length are read whole, one over ``CHUNK_BYTES`` by itself. A text that is null or has no letter is ``und`` with score 0. Without any learnable language every text is ``und``. Repeated
rows and keys get equal results for equal texts; an empty table gives an empty one. A null key is not held out. Columns of the input with the
outputs' names stay, as ``<name>_input``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import portions, set_aside, unused

BUCKET_BITS = 12
BUCKETS = 1 << BUCKET_BITS
PER_LANGUAGE = 300
MOST_ROWS = 3000
CHUNK_BYTES = 1 << 20
UNKNOWN = "und"

# Language families by language code.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "fy", "lb", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "ur", "bn", "mr", "ne"),
    "semitic": ("ar", "he"),
    "sinitic": ("zh",),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}


def family_of(lang: str) -> str:
    """A language without a listed family is a family of its own."""
    return _FAMILY.get(lang.split("-")[0].lower(), f"own:{lang}")


def _grams(joined: np.ndarray) -> np.ndarray:
    """Buckets of the 3-byte runs that start at each byte but the last two, mixed from their code."""
    code = joined[:-2].astype(np.uint32)
    code <<= np.uint32(8)
    code |= joined[1:-1]
    code <<= np.uint32(8)
    code |= joined[2:]
    code *= np.uint32(2654435761)
    code >>= np.uint32(32 - BUCKET_BITS)
    return code


def _frame(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all texts one after the other, where each text's begin, and how many are its own."""
    padded = [b" " + t + b" " for t in texts]
    size = np.array([len(p) for p in padded], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    return _grams(np.frombuffer(b"".join(padded) + b"  ", dtype=np.uint8)), starts, np.maximum(size - 2, 1)


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    begin = 0
    while begin < len(texts):
        end, room = begin + 1, CHUNK_BYTES - len(texts[begin])
        while end < len(texts) and len(texts[end]) <= room:
            room -= len(texts[end])
            end += 1
        yield begin, end
        begin = end


def _coded(texts) -> list[bytes]:
    return [b"" if t is None else t.lower().encode("utf-8", "surrogatepass") for t in texts]


@dataclass(frozen=True)
class Machine:
    """A linear machine over n-gram frequencies: positive for ``yes``, negative for ``no``."""

    yes: str
    no: str
    row: int
    bias: float


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]
    languages: dict[str, tuple[str, ...]]
    family_machines: tuple[Machine, ...]
    pair_machines: dict[str, tuple[Machine, ...]]
    weights: np.ndarray  # machines x buckets, float32


def _svm(x: np.ndarray, y: np.ndarray, rounds: int = 40, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss: y is 1 or -1, both sides weigh the same; gradient steps with momentum."""
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    w, b = np.zeros(x.shape[1], dtype=np.float32), 0.0
    seen_w, seen_b, t = w.copy(), b, 1.0
    norm = float(np.einsum("ij,ij->i", x, x).max()) + 1.0
    step = 1.0 / (2.0 * norm + ridge)
    for _ in range(rounds * 5):
        gap = np.maximum(0.0, 1.0 - y * (x @ seen_w + seen_b))
        pull = (-2.0 * share * y * gap).astype(np.float32)
        new_w, new_b = seen_w - step * (x.T @ pull + ridge * seen_w).astype(np.float32), seen_b - step * float(pull.sum())
        nxt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        seen_w, seen_b = new_w + np.float32((t - 1) / nxt) * (new_w - w), new_b + (t - 1) / nxt * (new_b - b)
        w, b, t = new_w, new_b, nxt
    return w, float(b)


def sample(docs: DataFrame, may_learn: Column, per_language: int = PER_LANGUAGE, most_rows: int = MOST_ROWS, text_col: str = "text", lang_col: str = "lang") -> DataFrame | None:
    """Rows (lang, text) to learn from; None if no row may be learned from. A text and language appear once.

    Of each language the texts whose hash falls below a threshold are taken, so that about ``per_language`` are expected, fewer
    where that many for each language would be over ``most_rows``, and the text with the least hash in any case.
    """
    known = docs.where(may_learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    known = known.withColumn("mark", F.xxhash64("text", F.lit("language sample")))
    different = known.groupBy("lang", "mark").agg(F.lit(1).alias("one")).groupBy("lang").agg(F.count("*").alias("n"), F.min("mark").alias("least")).collect()
    if not different:
        return None
    each = min(per_language, most_rows / len(different))
    wanted = docs.sparkSession.createDataFrame([(r["lang"], r["least"], 1_000_000 * min(1.0, each / r["n"])) for r in different], "lang string, least long, below double")
    marked = known.join(F.broadcast(wanted), "lang")  # a row a language
    chosen = marked.where((F.col("mark") == F.col("least")) | (F.pmod("mark", F.lit(1_000_000)).cast("double") < F.col("below")))
    return chosen.dropDuplicates(["lang", "mark"]).select("lang", "text")


def train(docs: DataFrame, may_learn: Column, **params) -> Model | None:
    """A model from a sample of the rows where ``may_learn`` holds and the language is not null; None if there are none."""
    chosen = sample(docs, may_learn, **params)
    if chosen is None:
        return None

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for text in _coded(pdf["text"]):
                grams, _, own = _frame([text])
                made.append((np.bincount(grams[: own[0]], minlength=BUCKETS) / own[0]).astype(np.float32).tobytes())
            yield pd.DataFrame({"lang": pdf["lang"], "x": made})

    got = chosen.mapInPandas(count, "lang string, x binary").toPandas()
    if not len(got):
        return None
    return fit(np.frombuffer(b"".join(got["x"]), dtype=np.float32).reshape(len(got), BUCKETS), got["lang"].to_numpy())


def fit(x: np.ndarray, langs: np.ndarray) -> Model:
    """Family machines and, within each family, a machine for each pair of languages."""
    names = sorted(set(langs))
    families = tuple(sorted({family_of(n) for n in names}))
    languages = {f: tuple(n for n in names if family_of(n) == f) for f in families}
    spread = (1.0 / (np.sqrt(x.mean(axis=0)) + 1e-3)).astype(np.float32)  # frequent n-grams would outweigh the telling ones
    z = x * spread
    of = np.array([family_of(n) for n in langs])
    rows: list[np.ndarray] = []

    def machine(yes: str, no: str, at: np.ndarray, positive: np.ndarray) -> Machine:
        w, b = _svm(z if len(at) == len(z) else z[at], np.where(positive, 1.0, -1.0))
        rows.append((w * spread).astype(np.float32))
        return Machine(yes, no, len(rows) - 1, b)

    everything = np.arange(len(langs))
    if len(families) == 2:
        family_machines = (machine(*families, everything, of == families[0]),)
    elif len(families) > 2:
        family_machines = tuple(machine(f, "", everything, of == f) for f in families)
    else:
        family_machines = ()
    pairs = {f: tuple(machine(a, b, (i := np.flatnonzero((langs == a) | (langs == b))), langs[i] == a) for a, b in combinations(languages[f], 2)) for f in families}
    weights = np.stack(rows) if rows else np.zeros((0, BUCKETS), np.float32)
    return Model(families, languages, family_machines, pairs, weights)


def _sure(margin: float) -> float:
    return float(1.0 / (1.0 + np.exp(-4.0 * min(max(margin, -20.0), 20.0))))


def _decide(model: Model, sums: np.ndarray) -> tuple[str, float]:
    """Family first, then the votes within it; ties go to the larger summed margin, then to the earlier name."""
    at = lambda m: float(sums[m.row] + m.bias)
    if not model.family_machines:
        family, sure = model.families[0], 1.0
    elif len(model.families) == 2:
        m = model.family_machines[0]
        family, sure = (m.yes if at(m) >= 0 else m.no), _sure(abs(at(m)))
    else:
        best = max(model.family_machines, key=at)
        family, sure = best.yes, _sure(at(best))
    votes = {lang: [0, 0.0] for lang in model.languages[family]}
    for m in model.pair_machines[family]:
        margin = at(m)
        winner = m.yes if margin >= 0 else m.no
        votes[winner][0] += 1
        votes[m.yes][1] += margin
        votes[m.no][1] -= margin
    lang = max(votes, key=lambda k: (votes[k], [-ord(c) for c in k]))
    for m in model.pair_machines[family]:
        if lang in (m.yes, m.no):
            sure = min(sure, _sure(at(m) if lang == m.yes else -at(m)))
    return lang, min(1.0, max(0.0, sure))


def predict_texts(model: Model, texts: list[str | None]) -> list[tuple[str, float]]:
    coded, out = _coded(texts), []
    for begin, end in _chunks(coded):
        grams, starts, own = _frame(coded[begin:end])
        mean = np.empty((len(model.weights), end - begin))
        for k, w in enumerate(model.weights):
            total = np.concatenate([[0.0], np.cumsum(w[grams], dtype=np.float64)])
            mean[k] = (total[np.minimum(starts + own, len(grams))] - total[starts]) / own
        for k in range(begin, end):
            text = texts[k]
            out.append(_decide(model, mean[:, k - begin]) if text and any(map(str.isalpha, text)) else (UNKNOWN, 0.0))
    return out


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score. The model goes to the tasks as one bounded broadcast."""
    docs = set_aside(docs, lang_out, score_out)
    if model is None:
        return docs.withColumns({lang_out: F.lit(UNKNOWN), score_out: F.lit(0.0)})
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang:string,score:double>")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in portions(batches, CHUNK_BYTES):
            yield pd.DataFrame(predict_texts(held.value, texts), columns=["lang", "score"])

    named = unused(docs, "language")
    # so that a filter by the result is not pushed below it, which would predict every text twice, in two Python workers for each task
    out = docs.withColumn(named, guess.asNondeterministic()(F.col(text_col)))
    return out.withColumns({lang_out: F.col(f"{named}.lang"), score_out: F.col(f"{named}.score")}).drop(named)


def held_out(key_col: str = "doc_id") -> Column:
    """The fifth of the documents that training never sees; false for a null key."""
    return F.coalesce(F.pmod(F.crc32(F.col(key_col).cast("string")), F.lit(5)) == 0, F.lit(False))


def identify(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", lang_out: str = "lang_pred", score_out: str = "score", **params) -> DataFrame:
    """Train on the documents that are not held out and predict all of them. Rows without a key are predicted, not learned from."""
    learn = F.col(key_col).isNotNull() & ~held_out(key_col)
    return predict(docs, train(docs, learn, text_col=text_col, lang_col=lang_col, **params), text_col, lang_out, score_out)
