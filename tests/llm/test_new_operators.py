"""Importance resampling, streaming deduplication and spelling variants against plain Python."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import importance, spelling, stream_dedup
from shelfmark.llm.common import alnum_words

LONG = " ".join(f"w{i % 700}" for i in range(40_000))


# ---- importance resampling


def _features(text):
    w = alnum_words(text)
    return [zlib.crc32(x) % importance.BUCKETS for x in w] + [zlib.crc32(a + b" " + b) % importance.BUCKETS for a, b in zip(w, w[1:], strict=False)]


@pytest.mark.parametrize("text", [None, "", "...", "one", "A b  a, B!", "Äé 1x\n2y", "z" * 5_000 + " q " + "z" * 3_000 + " q a", LONG])
def test_feature_buckets(text):
    other = "between texts"
    got = list(importance.feature_buckets([other, text, other]))
    assert got[1].tolist() == _features(text)
    assert got[0].tolist() == got[2].tolist() == _features(other)


def test_joined_crc_of_many_lengths():
    words = [bytes([65 + i % 26]) * i for i in range(1, 700)]
    a = np.array([zlib.crc32(b"left " * (i % 3)) for i in range(len(words))], dtype=np.uint32)
    b = np.array([zlib.crc32(w) for w in words], dtype=np.uint32)
    want = [zlib.crc32(w, zlib.crc32(b"left " * (i % 3))) for i, w in enumerate(words)]
    assert importance.joined_crc(a, b, np.array([len(w) for w in words])).tolist() == want


def _resampled(rows, target, percent=25, least=20):
    """Rows (doc_id, text) to (doc_id, n_features, weight, score, rank), ranked by score and key."""
    size = importance.BUCKETS
    s, t = Counter(f for _, x in rows for f in _features(x)), Counter(f for x in target for f in _features(x))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (S + size) / ((s[b] + 1.0) * (T + size)))) for b in set(s) | set(t)}
    out = []
    for k, x in rows:
        f = _features(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{k}".encode()).hexdigest()[:8], 16)
        out.append([k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r, (_, x) in zip(out, rows, strict=True) if len(alnum_words(x)) >= least), key=lambda r: (-r[3], r[0]))
    for i, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = i + 1
    return sorted(map(tuple, out))


def test_resample(make_docs, spark):
    texts = [" ".join(f"{'ab'[(i * j) % 2]}{(i * j) % (3 + i)}" for j in range(i)) for i in range(60)] + [None, "", LONG, "Target words " * 15] * 2
    target = ["target words here", None, "", "a1 b2 a3"]
    got = importance.digest(importance.resample(make_docs(texts), make_docs(target)))
    assert sorted(map(tuple, got.collect())) == _resampled(list(enumerate(texts)), target)


def test_resample_edges(make_docs, spark):
    empty = make_docs([])
    assert importance.resample(empty, empty).count() == 0
    twenty = " ".join(map(str, range(20)))
    # repeated rows have ranks of their own, a null key is ranked first among equals, clashing columns stay
    rows = spark.createDataFrame([(1, twenty, "x")] * 4 + [(None, twenty, "y")] * 4 + [(2, "short", "z")], "doc_id long, text string, rank string")
    done = importance.resample(rows, empty, percent=100)
    assert done.columns == ["doc_id", "rank_input", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(r["rank"] for r in done.where("rank is not null").collect()) == list(range(1, 9))
    assert done.where("doc_id = 2").first()["rank"] is None
    # text and key may have any names, those of results too
    odd = rows.select(F.col("doc_id").alias("score"), F.col("text").alias("weight"))
    assert importance.resample(odd, odd, key_col="score", text_col="weight").columns[0] == "score_input"


def test_ranked_over_partitions(spark):
    rows = spark.range(500).select(F.col("id"), (F.col("id") % 7).alias("g"))
    got = importance.ranked(rows, [F.col("g").desc(), F.col("id").asc()], "place").collect()
    want = {r[1]: i + 1 for i, r in enumerate(sorted((-(k % 7), k) for k in range(500)))}
    assert {r["id"]: r["place"] for r in got} == want


# ---- streaming deduplication


def _written(spark, path, rows, schema="doc_id long, text string, keep string", files=3):
    spark.createDataFrame(rows, schema).repartition(files).write.mode("append").parquet(path)
    return path


def _copies(rows):
    """Rows (doc_id, text) to doc_id, keep_id, group_size, kept, sha of each, where keys differ."""
    fold = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups: dict = {}
    for k, t in rows:
        groups.setdefault(fold(t), []).append(k)
    return sorted((k, max(groups[fold(t)]), len(groups[fold(t)]), k == max(groups[fold(t)]), hashlib.sha256(fold(t).encode()).hexdigest()) for k, t in rows)


TEXTS = ["a", "A", "ä", "Ä", "", None, "b ", "b", LONG, LONG.upper(), "x" * 100_000, "same", "Same", "SAME", *(f"t{i % 40}" for i in range(150)), *["hot"] * 60]


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_stream_dedup(spark, tmp_path, digest_bytes):
    """With digests of one byte, many different texts share one, and their bytes tell them apart."""
    rows = [(i, t, "c") for i, t in enumerate(TEXTS)]
    path = _written(spark, f"{tmp_path}/docs", rows)
    done = stream_dedup.judge_copies(spark, path, digest_bytes=digest_bytes)
    assert sorted(map(tuple, stream_dedup.digest(done).collect())) == _copies([r[:2] for r in rows])
    kept = stream_dedup.kept_documents(spark, path, done)
    assert kept.columns == ["doc_id", "text", "keep"] and {r["doc_id"] for r in kept.collect()} == {r[0] for r in _copies([r[:2] for r in rows]) if r[3]}


def test_stream_dedup_goes_on(spark, tmp_path):
    """A kept checkpoint takes in new files only, in batches of any size, and a later, larger key takes over."""
    path, state = f"{tmp_path}/docs", f"{tmp_path}/state"
    first, later = [(i, t, "") for i, t in enumerate(TEXTS)], [(1000 + i, t, "") for i, t in enumerate(TEXTS[5:40])]
    _written(spark, path, first)
    stream_dedup.judge_copies(spark, path, checkpoint=state, batch_bytes=1)
    before = {bytes(r["digest"]): r["n"] for r in stream_dedup.state_table(spark, state).collect()}
    _written(spark, path, later)
    done = stream_dedup.judge_copies(spark, path, checkpoint=state, batch_bytes=1)
    assert sorted(map(tuple, stream_dedup.digest(done).collect())) == _copies([r[:2] for r in first + later])
    after = {bytes(r["digest"]): r["n"] for r in stream_dedup.state_table(spark, state).collect()}
    assert sum(before.values()) == len(first) and sum(after.values()) == len(first) + len(later) and set(before) <= set(after)


def test_stream_dedup_edges(spark, tmp_path):
    empty = _written(spark, f"{tmp_path}/none", [], files=1)
    assert stream_dedup.judge_copies(spark, empty).count() == 0
    # one row stays, also of repeated rows; a null key only if there is no other
    path = _written(spark, f"{tmp_path}/some", [(3, "t", "")] * 4 + [(None, "T", ""), (None, "u", ""), (None, "U", "")], files=2)
    done = stream_dedup.judge_copies(spark, path).collect()
    assert sorted((r["key"] is None, r["keep"]["key"], r["n"]) for r in done if r["kept"]) == [(False, 3, 5), (True, None, 2)]
    assert len(done) == 7
    # a single file is a table too
    file = next(p for p in (tmp_path / "some").iterdir() if p.suffix == ".parquet")
    assert stream_dedup.judge_copies(spark, str(file)).count() == spark.read.parquet(str(file)).count()


# ---- spelling variants


def _near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _variants(counts):
    near = {w: [x for x in counts if _near(w, x)] for w in counts}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts)


def _key(rows):
    return sorted(tuple("" if x is None else x for x in r) for r in rows)


WORDS = {
    "hello": 100, "hallo": 40, "helloo": 10, "hhello": 3, "hell": 50, "hellö": 3, "aaaaa": 9, "aaaaaa": 4, "aaaaaaa": 3, "baaaa": 9, "abcde": 7, "abcdef": 7, "bcdef": 7, "abdef": 7,
    "ÿÿÿÿÿ": 5, "ÿÿÿÿÿÿ": 30, "chain": 1000, "chaim": 400, "chalm": 150, "chalk": 60, "shalk": 20, "shall": 5, "q" * 900: 8, "q" * 901: 3, "q" * 899 + "z": 20,
}


def test_variants(spark):
    rows = spark.createDataFrame(list(WORDS.items()), "word string, n long")
    assert _key(spelling.digest(spelling.group_variants(rows)).collect()) == _key(_variants(WORDS))


def test_variants_of_a_dense_vocabulary(spark):
    """Every word of five letters a and b, some with more: nodes reach over partitions, and pairs are full."""
    counts = {f"{i:05b}".replace("0", "a").replace("1", "b"): 1 + i * i % 23 for i in range(32)} | {f"{i:06b}".replace("0", "a").replace("1", "b"): 1 + i * 7 % 19 for i in range(64)}
    rows = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert _key(spelling.digest(spelling.group_variants(rows)).collect()) == _key(_variants(counts))


def test_trie_nodes(spark):
    words = sorted(WORDS)
    for reverse in (False, True):
        got = {r["word"]: r["nodes"] for r in spelling.trie_nodes(spark.createDataFrame([(w,) for w in words], "word string"), reverse).collect()}
        number: dict = {}
        for w, nodes in got.items():
            path = w[::-1] if reverse else w
            assert len(nodes) == len(w) + 1
            for i, node in enumerate(nodes):
                assert number.setdefault(path[:i], node) == node
        assert len(set(number.values())) == len(number)
        if not reverse:  # a word's own node rises with the word
            assert [got[w][-1] for w in words] == sorted(got[w][-1] for w in words)


def _counted(rows, least_length=5, least_count=3):
    import re

    found: Counter = Counter()
    for k, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{k}:{run}".encode())
            found[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in found.items() if len(w) >= least_length and n >= least_count}


def test_vocabulary(make_docs):
    texts = [None, "", "1 2 3", "Über-Größe ÜBER größe", "x" * 50_000, *[f"Words wordy{'abc'[i % 3]}word naïve÷times Éclair word{i % 11}" for i in range(300)], " ".join(["letters"] * 20_000)]
    assert {r["word"]: r["n"] for r in spelling.vocabulary(make_docs(texts)).collect()} == _counted(list(enumerate(texts)))


def test_spelling_edges(make_docs, spark):
    assert spelling.group_variants(spelling.vocabulary(make_docs([]))).count() == 0
    assert spelling.group_variants(spelling.vocabulary(make_docs([None, "ab cd"]))).count() == 0
    # repeated rows count each time; other columns are not read
    rows = spark.createDataFrame([(1, "alone", 5)] * 3, "doc_id long, text string, word long")
    assert [tuple(r) for r in spelling.digest(spelling.group_variants(spelling.vocabulary(rows))).collect()] == [("alone", None, "alone", 3, 0, None)]
