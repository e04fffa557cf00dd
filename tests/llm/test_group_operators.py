"""Operators that compare documents, against brute force on small fixtures."""

import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

import corpus_pipeline
from shelfmark.llm import common, decontaminate, embedding_dedup, language_id, phrase_dedup, simhash_dedup, suffix_dedup, toxicity, windows

DOCS = "doc_id long, text string"


def rows(spark, texts, keys=None):
    return spark.createDataFrame([(keys[i] if keys else i, t) for i, t in enumerate(texts)], DOCS)


def union(n, pairs):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    words = ["".join(r.choices("abcdeé", k=r.randint(1, 5))) for _ in range(300)]
    make = lambda n: " ".join(r.choices(words, k=n))
    passage, other = make(70), make(55)
    out = [None, "", " ", "x", "a b", passage, make(200), "y" * 400, "ab" * 150]
    for _ in range(25):
        body = make(r.randint(5, 160)).split(" ")
        for p in r.sample([passage, other, passage[30:], other + " " + other], r.randint(0, 2)):
            body.insert(r.randint(0, len(body)), p)
        out.append(" ".join(body))
    out += [out[10], out[11], out[12].replace(" ", "  ", 1), out[13] + " tail", "new " + out[14]]
    return out


def test_components(spark):
    r = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(r.randint(50, 90), r.randint(50, 90)) for _ in range(30)] + [(100, x) for x in range(101, 140)]
    want = union(200, pairs)
    got = {x["node"]: x["component"] for x in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got.get(n, n) == want[n] for n in range(200)) and set(got) == {n for p in pairs if p[0] != p[1] for n in p}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode()
    words = low.split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, texts):
    r = random.Random(5)
    base = " ".join(r.choices(["alpha", "beta", "gamma", "delta", "Epsilon"], k=400)).split(" ")
    near = []
    for k in range(30):
        w = list(base)
        w[(k * 13) % 400] = f"w{k % 4}"
        near.append(" ".join(w))
    every = texts + near
    f = [plain_fingerprint(t) for t in every]
    want = union(len(every), [(a, b) for a in range(len(every)) for b in range(a) if (f[a] ^ f[b]).bit_count() <= 3])
    got = {x["doc_id"]: x for x in simhash_dedup.digest(simhash_dedup.near_duplicates(rows(spark, every))).collect()}
    assert [int(got[i]["fingerprint"], 16) for i in range(len(every))] == f
    assert [got[i]["component_id"] for i in range(len(every))] == want
    assert len(set(want)) < len(every) - 15


def test_forest_and_hot_buckets(spark, monkeypatch):
    r = np.random.default_rng(2)
    centre = r.integers(0, 1 << 63, size=40, dtype=np.int64)
    fp = np.unique(np.concatenate([centre] + [centre ^ (np.int64(1) << r.integers(0, 63, size=40)) ^ (np.int64(1) << r.integers(0, 63, size=40)) for _ in range(5)]))
    u = fp.view(np.uint64)
    pairs = [(a, b) for a in range(len(u)) for b in range(a) if int(u[a] ^ u[b]).bit_count() <= 3]
    found = {tuple(sorted(p)) for a, b in simhash_dedup.Forest(u, np.zeros(len(u), np.int64)).links(3) for p in zip(a.tolist(), b.tolist(), strict=True)}
    assert found == {tuple(sorted(p)) for p in pairs}
    monkeypatch.setattr(simhash_dedup, "HOT", 5)
    classes = spark.createDataFrame([(int(x), i) for i, x in enumerate(fp)], "fp long, rep long")
    got = {x["node"]: x["component"] for x in common.components(simhash_dedup.links(classes)).collect()}
    want = union(len(fp), pairs)
    assert [got.get(i, i) for i in range(len(fp))] == want


def plain_bytes(texts, length):
    data = [(t or "").encode() for t in texts]
    seen, out = set(), []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [4_000, 1])
def test_suffix_dedup(spark, texts, monkeypatch, hot):
    monkeypatch.setattr(windows, "HOT", hot)
    got = {x["doc_id"]: tuple(x)[1:] for x in suffix_dedup.digest(suffix_dedup.remove_repeats(rows(spark, texts))).collect()}
    want = plain_bytes(texts, 100)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(w[1] for w in want) > 1000


def test_longest_previous_factors():
    r = random.Random(0)
    data = "".join(r.choices("ab", k=120)).encode()
    starts = np.arange(len(data))
    got = suffix_dedup.longest_previous_factors(np.frombuffer(data, dtype=np.uint8), starts, 128)
    want = [max([0, *(next((k for k in range(len(data) - i) if data[i + k] != data[j + k]), len(data) - i) for j in range(i))]) for i in range(len(data))]
    assert got.tolist() == want


def plain_words(texts, keys, window):
    words = [(t or "").encode().split() for t in texts]
    first = {}
    for w, k in zip(words, keys, strict=True):
        for i in range(len(w) - window + 1):
            s = tuple(w[i : i + window])
            first[s] = min(first.get(s, k), k)
    out = {}
    for w, k in zip(words, keys, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < k:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[k] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [4_000, 1])
def test_phrase_dedup(spark, texts, monkeypatch, hot):
    monkeypatch.setattr(windows, "HOT", hot)
    keys = list(range(len(texts)))
    random.Random(4).shuffle(keys)
    got = {x["doc_id"]: tuple(x)[1:] for x in phrase_dedup.digest(phrase_dedup.remove_phrases(rows(spark, texts, keys))).collect()}
    want = plain_words(texts, keys, 50)
    assert got == want and sum(w[1] for w in want.values()) > 300


def test_windows_odd_input(spark):
    docs = spark.createDataFrame([(None, "a " * 120, "v"), (1, "a " * 120, "v"), (1, "a " * 120, "v"), (2, None, "v")], "doc_id long, text string, dedup string")
    got = sorted((x["doc_id"] or 0, x["dedup"]["n_words"], len(x["dedup"]["removed"]), x["dedup_input"]) for x in phrase_dedup.remove_phrases(docs).collect())
    assert got == [(0, 120, 0, "v"), (1, 120, 0, "v"), (1, 120, 0, "v"), (2, 0, 0, "v")]
    assert suffix_dedup.remove_repeats(docs.where("false")).count() == 0
    assert phrase_dedup.remove_phrases(docs.where("false")).count() == 0
    assert simhash_dedup.near_duplicates(docs.where("false")).count() == 0


@pytest.mark.parametrize("hot", [4_000, 1])
def test_one_key_with_different_texts(spark, monkeypatch, hot):
    """Spans stay with their own row; repeated equal rows get equal results; null keys are no one's earlier occurrence."""
    monkeypatch.setattr(windows, "HOT", hot)
    r = random.Random(6)
    make = lambda n: " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(n))
    a, b, c = make(60), make(60), make(60)
    given = [(1, a), (2, a + " tail"), (2, b), (2, b), (3, b + " x"), (None, c), (3, c), (3, c + " " + c), (4, "short")]
    docs = spark.createDataFrame(given, DOCS)
    got = sorted((x["doc_id"] or 0, x["text"], x["dedup"]["kept"]) for x in phrase_dedup.remove_phrases(docs).collect())
    kept = {(2, a + " tail"): "tail", (3, b + " x"): "x"}
    assert got == sorted((k or 0, t, kept.get((k, t), t)) for k, t in given)
    got = sorted((x["doc_id"] or 0, x["text"], x["dedup"]["kept"].decode()) for x in suffix_dedup.remove_repeats(docs).collect())
    one, two = [t for k, t, _ in got if k == 3 and t.startswith(c)]
    kept = {(2, a + " tail"): " tail", (3, b + " x"): " x"}
    want = [sorted((k or 0, t, more.get((k, t), t)) for k, t in given) for more in (kept | {(3, c + " " + c): ""}, kept | {(3, c): "", (3, c + " " + c): c + " "})]
    assert one == c and two == c + " " + c and got in want


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    r = np.random.default_rng(7)
    base = r.normal(size=(40, 8))
    x = np.concatenate([base, base[:30] + r.normal(scale=0.05, size=(30, 8)), base[:5], base[:5] * 3, base[:20] + r.normal(scale=0.12, size=(20, 8))])
    labels = [None if i % 17 == 0 else int(i % 3 if i >= 70 else 1) for i in range(len(x))]
    rows_ = [(i, [float(v) for v in x[i]], labels[i]) for i in range(len(x))]
    rows_ += [(1000, None, 1), (1001, [0.0] * 8, 1), (1002, [float("nan")] * 8, 1), (1003, [1.0, None], 1), (1004, [], 1), (1005, [1.0, 0.0], 1), (1006, [2.0, 0.0], 1)]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType())])
    n = len(x)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    pairs = [(a, b) for a in range(n) for b in range(a) if labels[a] is not None and labels[a] == labels[b] and u[a] @ u[b] >= 0.98]
    want = union(n, pairs)
    got = {g["vec_id"]: g for g in embedding_dedup.near_duplicates(spark.createDataFrame(rows_, schema)).collect()}
    assert [got[i]["component_id"] for i in range(n)] == want and len(pairs) > 20
    assert [got[i]["n_links"] for i in range(n)] == [sum(i in p for p in pairs) for i in range(n)]
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in range(1000, 1005)) and got[1006]["component_id"] == 1005 and not got[1006]["kept"]
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def plain_items(texts, items):
    cut = lambda t: decontaminate.alnum_words(t)
    ws = {k: decontaminate.item_windows(cut(t), 13) for k, t in items}
    out = []
    for t in texts:
        w = cut(t)
        hit, found = set(), []
        for k, windows_ in ws.items():
            own = False
            for v in windows_:
                for i in range(len(w) - len(v) + 1):
                    if tuple(w[i : i + len(v)]) == v:
                        hit.update(range(i, i + len(v)))
                        own = True
            if own:
                found.append(str(k))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("most", [1_300_000, 15])
def test_decontamination(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_WORDS", most)
    r = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    make = lambda n: " ".join(r.choices(words, k=n))
    items = [(i, make(r.choice([3, 13, 20, 30]))) for i in range(8)] + [(8, None), (9, " - "), (10, "Rare Éé")]
    texts = [None, "", "rare Éé", "RARE--Éé x"] + [make(40) for _ in range(5)]
    texts += [f"{make(r.randint(0, 300))}, {items[i][1]}! {make(10)} {items[i][1]}" for i in range(8)] + [" ".join(items[7][1].split()[2:15]) * 1]
    got = {x["doc_id"]: tuple(x)[1:] for x in decontaminate.digest(decontaminate.find_items(rows(spark, texts), spark.createDataFrame(items, "item_id long, text string"))).collect()}
    assert [got[i] for i in range(len(texts))] == plain_items(texts, items)
    again = [(None, texts[9]), (5, texts[9]), (5, texts[9]), (5, texts[10])]
    docs = spark.createDataFrame([(k, t, 9.5, "mine") for k, t in again], DOCS + ", n_words double, contamination string")
    odd = items + [(None, texts[9]), (0, items[0][1]), (3, items[1][1])]
    found = decontaminate.judge(decontaminate.find_items(docs, spark.createDataFrame(odd, "item_id long, text string"))).collect()
    want = plain_items([t for _, t in again], [*items, (3, items[1][1])])
    assert sorted((x["doc_id"] or 0, x["n_words"], x["n_hit"], x["contaminated"], x["n_words_input"], x["contamination_input"]) for x in found) == sorted((k or 0, w[0], w[1], w[4], 9.5, "mine") for (k, _), w in zip(again, want, strict=True))
    assert decontaminate.find_items(docs.where("false"), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    none = decontaminate.judge(decontaminate.find_items(docs, spark.createDataFrame([], "item_id long, text string"))).collect()
    assert len(none) == 4 and not any(x["contaminated"] or x["n_hit"] for x in none)


def test_toxicity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    learn, hold = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    done = toxicity.digest(toxicity.classify(docs, learn)).join(hold.withColumnRenamed("toxic", "truth"), "doc_id").toPandas()
    assert done["p_toxic"].between(0, 1).all() and (done["toxic"] == (done["truth"] == 1)).mean() > 0.985
    assert ((done["p_low_quality"] >= 0.5) == (done["quality"] == 0)).mean() >= 0.86 and done["toxic"][done["truth"] == 1].mean() > 0.9
    empty = toxicity.digest(toxicity.classify(docs.limit(5), labels.where("false"))).collect()
    assert len(empty) == 5 and not any(x["toxic"] for x in empty)


def test_pipeline_odd_tables(spark, tmp_path):
    """Columns with the names of all outputs stay as they came; an empty table stays empty; of a key's rows the choice is fixed."""
    names = ["score", "lang_pred", "n_words", "n_hit", "items", "contaminated", "spans", "row", "token_ids", "decoded", "component_id", "fp"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    given = [(i, f"a house by the river and the road number {i} in the wood", "en", "s", 1, *(f"{n}{i}" for n in names)) for i in range(4)]
    given += [(2, "another text of the same key, with other words in it", "en", "s", 1, *("x" for _ in names)), (None, None, None, None, None, *(None for _ in names))]
    spark.createDataFrame([(1, "none of it")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows_ in (given, []):
        docs = spark.createDataFrame(rows_, schema)
        for name, stage in corpus_pipeline.STAGES:
            done = stage(spark, docs, str(tmp_path))
            if name == "tokens":
                assert done.columns == ["doc_id", "lang", "source", "n_tokens", "token_ids", "decoded_sha256"] and done.count() == len(rows_)
                continue
            got = done.collect()
            assert done.columns == docs.columns and bool(got) == bool(rows_)
            assert all(x[n] in (f"{n}{x['doc_id']}", "x", None) for x in got for n in names)
    docs = spark.createDataFrame(given, schema)
    pick = [sorted(x["text"] or "" for x in corpus_pipeline.drop_near_copies(spark, d, str(tmp_path)).collect()) for d in (docs, docs.orderBy(F.desc("text")), docs.repartition(3))]
    assert pick[0] == pick[1] == pick[2]


def test_sampling_by_text(spark):
    """Many rows under one key, and many copies of one text, leave a sample of different texts, bounded in all."""
    one_key = spark.createDataFrame([(7, f"{'the house' if i % 2 else 'la maison'} {i}", "en" if i % 2 else "fr") for i in range(3000)] + [(7, "copy", "en")] * 500, "doc_id long, text string, lang string")
    got = [(x["lang"], x["text"]) for x in language_id.sample(one_key, F.lit(True)).collect()]
    assert len(got) == len(set(got)) and all(200 < sum(lang == x for lang, _ in got) < 400 for x in ("en", "fr"))
    assert {x["lang_pred"] for x in language_id.identify(one_key.withColumn("doc_id", F.lit(1))).collect()} == {"en", "fr"}
    many = spark.createDataFrame([(i, f"w{i} {i % 7}", f"l{i % 500}") for i in range(5000)], "doc_id long, text string, lang string")
    got = language_id.sample(many, F.lit(True), most_rows=640).collect()
    assert len({x["lang"] for x in got}) == 500 and 700 < len(got) < 1200
    labels = spark.createDataFrame([(7, 1, 1), (7, 0, 0), (8, 1, 0), (8, None, 1)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(7, f"bad w{i}", "c") for i in range(300)] + [(8, "good day", "c")] * 300 + [(None, None, "c")], "doc_id long, text string, chain string")
    done = toxicity.classify(docs, labels)
    assert done.columns == ["doc_id", "text", "chain_input", "chain"]
    by_text = {x["text"]: x["toxic"] for x in done.select("text", (F.col("chain.toxic") >= 0.5).alias("toxic")).collect()}
    assert by_text["bad w5"] and not by_text["good day"] and done.count() == 601
    assert toxicity.digest(toxicity.classify(docs.where("false").drop("chain"), labels)).count() == 0


def test_chain_by_hand():
    """The chain's probabilities, and that earlier ones are out of fold, on tiny data."""
    r = np.random.default_rng(1)
    x = (r.random((40, 5)) < 0.4).astype(np.float32)
    labels = np.stack([x[:, 0], np.maximum(x[:, 0], x[:, 1])], axis=1).astype(np.int64)
    labels[3] = 1 - labels[3]
    fold = np.arange(40) % toxicity.FOLDS
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    chain = toxicity.fit(x, labels, ["one", "two"], words, fold, ridges=(2e-4,))
    out = np.empty(40, dtype=np.float32)
    for k in range(toxicity.FOLDS):
        w, b = toxicity.logistic(x[fold != k], labels[fold != k, 0].astype(np.float32))
        out[fold == k] = [1 / (1 + math.exp(-(float(v @ w) + b))) for v in x[fold == k]]
    w, b = toxicity.logistic(np.hstack([x, out[:, None]]), labels[:, 1].astype(np.float32))
    assert np.allclose(chain.links[1].words, w[:5], atol=1e-4) and np.allclose(chain.links[1].earlier, w[5:], atol=1e-4) and abs(chain.links[1].bias - b) < 1e-4
    for text, have in (("alpha gamma GAMMA", [0, 2]), ("", []), (None, []), ("other", []), ("beta eps", [1, 4])):
        p = []
        for link in chain.links:
            z = sum(float(link.words[i]) for i in have) + sum(q * float(e) for q, e in zip(p, link.earlier, strict=True)) + link.bias
            p.append(1 / (1 + math.exp(-max(-40, min(40, z)))))
        assert np.allclose(chain.judge([text])[0], p, atol=1e-6)


def test_links_choose_their_words():
    """A link whose label hangs on one word takes few, one whose label is spread over many takes more."""
    r = np.random.default_rng(3)
    x = (r.random((600, 60)) < 0.3).astype(np.float32)
    labels = np.stack([(x[:, :40].sum(axis=1) > 12).astype(int), x[:, 50].astype(int)], axis=1)
    orders = [np.arange(60), np.array([50, *range(50), *range(51, 60)])]
    chain = toxicity.fit(x, labels, ["many", "one"], [f"w{i}" for i in range(60)], np.arange(600) % 4, orders=orders, sizes=(2, 40), ridges=(2e-4, 2e-3))
    assert [int((link.words != 0).sum()) for link in chain.links] == [40, 2] and len(chain.links[1].earlier) == 1


def test_language_decision_by_hand():
    """Frequencies, family and votes of each text, computed one n-gram at a time."""
    texts = {"en": ["the cat and the dog", "this is the house", "where is the road"], "de": ["der hund und die katze", "das ist ein haus", "wo ist der weg"], "nl": ["de hond en de kat", "dat is een huis", "waar is de weg"], "fr": ["le chat et la maison", "une rose des bois", "la route et le pont"], "fi": ["talo on suuri", "kissa ja koira", "tie on pitka"]}

    def vector(text):
        data = b" " + text.lower().encode() + b" "
        v = np.zeros(language_id.BUCKETS)
        for i in range(len(data) - 2):
            code = (data[i] << 16 | data[i + 1] << 8 | data[i + 2]) * 2654435761 % (1 << 32)
            v[code >> (32 - language_id.BUCKET_BITS)] += 1
        return v / max(len(data) - 2, 1)

    langs = np.array([lang for lang, ts in texts.items() for _ in ts])
    model = language_id.fit(np.stack([vector(t) for ts in texts.values() for t in ts]).astype(np.float32), langs)
    asked = [t for ts in texts.values() for t in ts] + ["the house and the road", "ein hund", "x", "1 2", None, "la katze on the road"]
    for text, (lang, score) in zip(asked, language_id.predict_texts(model, asked), strict=True):
        if text is None or not any(c.isalpha() for c in text):
            assert (lang, score) == ("und", 0.0)
            continue
        margin = lambda m: float(model.weights[m.row].astype(np.float64) @ vector(text)) + m.bias  # noqa: B023, E731
        family = max(model.family_machines, key=margin).yes
        votes = dict.fromkeys(model.languages[family], 0)
        for m in model.pair_machines[family]:
            votes[m.yes if margin(m) >= 0 else m.no] += 1
        assert language_id.family_of(lang) == family and votes[lang] == max(votes.values()) and 0 <= score <= 1


def test_repeated_rows(spark, texts):
    keys = [(1, texts[10]), (1, texts[10]), (2, texts[11]), (1, texts[11]), (3, None), (3, None), (None, texts[10]), (None, "alone here with no key")]
    got = [(x["doc_id"], x["component_id"]) for x in simhash_dedup.digest(simhash_dedup.near_duplicates(spark.createDataFrame(keys, DOCS))).collect()]
    assert sorted(got, key=repr) == sorted([(1, 1), (1, 1), (2, 1), (1, 1), (3, 3), (3, 3), (None, 1), (None, None)], key=repr)
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.001], 1), (2, [0.0, 1.0], 1), (None, [1.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    got = [tuple(x) for x in embedding_dedup.near_duplicates(vectors).collect()]
    assert len(got) == 5 and len(set(got)) == 3 and [g for g in got if g[0] is None] == [(None, 0, None, False)]


def test_pipeline(spark, tmp_path):
    texts = ["the quick brown fox jumps over the lazy dog " * 5 + str(i) for i in range(3)] + [None, "12 34", "password=abcdefgh the end of it all"]
    texts.append("one two three four five six seven eight nine ten eleven twelve thirteen fourteen")
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, texts[-1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {x["doc_id"]: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 5 in got and 6 not in got and 3 not in got and 4 not in got and 0 in got
    assert got[0]["n_tokens"] > 10 and math.isclose(len(got[0]["token_ids"]), got[0]["n_tokens"])


def test_pipeline_rows(spark, tmp_path):
    """All rows and columns against plain Python; only the languages are the model's."""
    r = random.Random(4)
    make = lambda n: " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 6))) for _ in range(n))
    base = make(400).split(" ")
    near = [" ".join(base[:k] + [f"w{k}"] + base[k + 1 :]) for k in (50, 150, 250, 350)]
    items = [(1, make(20)), (2, make(13)), (3, None)]
    texts = [(7, "Password=abcdefgh and " + make(30)), (8, make(20) + " AKIAAKIA1234567890 token: 'abcdefgh12' " + "0123456789abcdef" * 2), (9, f"{make(5)} {items[0][1]}"), (10, f"{make(600)} {items[1][1]}"), (11, make(60)), (12, None), (13, "12 34"), (None, make(30)), (None, "12"), (None, items[1][1])]
    texts += [(20 + i, t) for i, t in enumerate(near)] + [(None, near[0]), (30, texts[0][1]), (6, texts[4][1])] + [(40, make(25))] * 3
    docs = [(k, t, ("en", "fr")[(k or 0) % 2], f"s{(k or 0) % 3}", len(t or "")) for k, t in texts]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    predicted = {x["text"]: x["lang_pred"] for x in language_id.identify(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    left = [d for d in docs if predicted[d[1]] != language_id.UNKNOWN]
    keyed = sorted({d[0]: d for d in left if d[0] is not None}.items())
    f = [plain_fingerprint(d[1]) for _, d in keyed]
    groups = union(len(f), [(a, b) for a in range(len(f)) for b in range(a) if (f[a] ^ f[b]).bit_count() <= 3])
    left = [d for i, (_, d) in enumerate(keyed) if groups[i] == i] + [d for d in left if d[0] is None]
    left = [d for d, found in zip(left, plain_items([d[1] for d in left], items), strict=True) if not found[-1]]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    want = []
    for key, text, _, source, _ in left:
        spans = [m.span() for m in re.finditer(r"""(?:password|token)["']? *[:=] *["']?[\w+/.=-]{8,}""", text, re.I | re.A)] + [m.span() for m in re.finditer("AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}", text)]
        masked = text
        for start, end in sorted(spans, reverse=True):
            masked = masked[:start] + "[secret]" + masked[end:]
        ids = tokenizer.encode(masked, add_special_tokens=False).ids
        want.append((key, predicted[text], source, len(ids), ids, hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [tuple(x) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = {x[0] for x in got}
    assert {8, 10, 20, 40, None} <= kept and not {9, 12, 13, 21, 22, 23, 30} & kept and [x[0] for x in got].count(40) == 1
