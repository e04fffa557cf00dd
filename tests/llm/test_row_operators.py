"""Operators that work row by row, against plain Python."""

import hashlib
import re
import time

import public_tokenizers
import pyarrow.dataset as ds
import pytest
from tokenizers import Tokenizer

from shelfmark.llm import bpe_codec, language_id, license_scan, secret_scan

ODD = [None, "", " ", "\n\t ", "a", "ſecret=abcdefgh", "x" * 200_000, "é ü ñ", "\x85\x1c nel", "İstanbul ΣΑΣ ὈΔΥΣΣΕΎΣ", "café café"]
SECRETS = ODD + [
    "password=abcdefgh and Api_Key : 'ABCDEFGH12' token=short apikey\"=\"x/y+z=_.-aa",
    "password=secret=abcdefghij AKIAAKIA1234567890 AKIA12 " + "0123456789abcdef" * 2 + " " + "a" * 31,
    "é" * 5 + "SECRET:  0123456789abcdef0123456789abcdef", "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a1" * 18,
    "passwd = \n abcdefgh", "token==abcdefgh", "secret='abcdefg' secret=\"abcdefgh\"",
]


def plain_secrets(text):
    text = text or ""
    found = []
    assign = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")
    found += [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def sample_texts(n=400):
    return ds.dataset("/root/testdata/sf0.01/documents.parquet").to_table(columns=["text"])["text"].to_pylist()[:n]


def test_secrets(make_docs):
    texts = SECRETS + sample_texts()
    got = {r["doc_id"]: r for r in secret_scan.digest(secret_scan.scan_secrets(make_docs(texts))).collect()}
    for i, text in enumerate(texts):
        want = plain_secrets(text)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in want).encode()).hexdigest(), text
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(w[3] == k for w in want) for k in ("assign", "access", "hex")]
    assert "private_key:0:" in got[len(ODD) + 3]["spans"] and "hosting_token" in got[len(ODD) + 3]["spans"]


def test_trigram_queries():
    query = secret_scan.trigram_query(secret_scan.RULES[0].pattern)
    assert query[0] == "or" and b"oke" in secret_scan._trigrams(query)
    assert secret_scan.trigram_query(r"[0-9a-f]{32,}") is None
    assert secret_scan.trigram_query(r"AKIA[A-Z0-9]+") == ("and", (b"aki", b"kia"))
    assert secret_scan.trigram_query(r"abc|x") is None


def test_redaction(make_docs):
    from pyspark.sql import functions as F

    docs = make_docs(["a password=abcdefgh b", None, "x AKIAAKIA1234567890 password=0123456789abcdef0123456789abcdef", ""])
    assert [r[0] for r in docs.select(secret_scan.redact(F.col("text"))).collect()] == ["a [secret] b", None, "x [secret] [secret]", ""]


def test_empty_table_and_clashing_columns(make_docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    names = ["spans", "token_ids", "Decoded", "licenses", "lang_pred", "SCORE", "language", "both", "spans_input"]
    docs = make_docs(["password=abcdefgh by the river", None], langs=["en", "en"]).selectExpr("*", *(f"'mine' as {n}" for n in names))
    for made in (secret_scan.scan_secrets(docs), bpe_codec.encode_documents(docs, path), bpe_codec.encode_documents(docs, path, decoded_col=None), license_scan.scan_licenses(docs), language_id.identify(docs), language_id.identify(docs.withColumn("lang", docs.lang.substr(9, 1)))):
        assert len(set(c.lower() for c in made.columns)) == len(made.columns)
        for row in made.collect():
            assert sum(v == "mine" for v in row) == len(names)
        assert made.where("false").count() == 0
    docs = docs.where("false")
    assert secret_scan.digest(secret_scan.scan_secrets(docs)).count() == 0
    assert bpe_codec.digest(bpe_codec.encode_documents(docs, path)).count() == 0
    assert license_scan.digest(license_scan.scan_licenses(docs)).count() == 0
    assert language_id.identify(docs).count() == 0


def test_bpe(make_docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ODD + ["it's they'll 12 don't<|endoftext|>x <|startoftext|>", "日本語 emoji 👩‍👩‍👧 mixed123abc!!??", "aaaaaaa banana x", "<|endoftext|><|endoftext|>"] + SECRETS + sample_texts()
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    got = {r["doc_id"]: r for r in bpe_codec.digest(bpe_codec.encode_documents(make_docs(texts), path)).collect()}
    for i, text in enumerate(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids), text
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), text
        assert got[i]["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_pair_index(monkeypatch, few):
    """Long and short lists of positions, each way alone, against merging the least rank of one word at a time."""
    monkeypatch.setattr(bpe_codec, "FEW", few)
    vocabulary = bpe_codec.load(public_tokenizers.path("word_bpe_49k.json"))
    words = [w.encode() for w in ["", "a", "aa", "aaaaa", "aaaaaaaa", "banana", "mississippi", "abababab", "the", "ééé", *"it is the house of the people".split()]]
    ids, many = vocabulary.merge_all(words)
    want = []
    for w in words:
        symbols = [int(vocabulary.inner[b]) for b in w[:-1]] + [int(vocabulary.last[b]) for b in w[-1:]]
        while True:
            ranks = [vocabulary.rank_by_pair.get(a * vocabulary.size + b, vocabulary.none) for a, b in zip(symbols, symbols[1:], strict=False)]
            if min(ranks, default=vocabulary.none) == vocabulary.none:
                break
            at = ranks.index(min(ranks))
            symbols[at : at + 2] = [int(vocabulary.merged[ranks[at]])]
        want.append(symbols)
    assert ids.tolist() == [x for s in want for x in s] and many.tolist() == [len(s) for s in want]


LICENSES = ODD + [
    "Released under the MIT License. under the mit license", "Apache License, Version 2.0; CC BY-NC cc-by nc", "under the mit licenses",
    "SPDX-License-Identifier: MIT OR (Apache-2.0 AND BSD-3-Clause)\nrest", "spdx license identifier gpl-2.0 WITH Classpath-exception-2.0", "SPDX-License-Identifier: MIT OR",
    "XSPDX-License-Identifier: MIT", "under the mit license under the mit license version 2 apache license version 2",
]


def test_licenses(make_docs):
    texts = LICENSES + sample_texts()
    got = {r["doc_id"]: r for r in license_scan.digest(license_scan.scan_licenses(make_docs(texts))).collect()}
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(fold))
        places = [(k, label) for phrase, label in license_scan.BASE_PHRASES for k in range(len(words)) if words[k : k + phrase.count(" ") + 1] == phrase.split()]
        assert got[i]["n_words"] == len(words) and got[i]["n_base"] == len(places), text
        assert got[i]["first_word"] == min((k for k, _ in places), default=None) and got[i]["last_word"] == max((k for k, _ in places), default=None)
        assert got[i]["base_labels"] == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, got[i]["base_labels"].split(","))) <= set(got[i]["labels"].split(",")) and 0 <= got[i]["score"] <= 1
    at = len(ODD)
    assert got[at + 3]["labels"] == "apache-2.0,bsd-3-clause,mit" and got[at + 3]["score"] == 1
    assert got[at + 4]["labels"] == "gpl-2.0 with classpath-exception-2.0"
    assert got[at + 5]["labels"] == "" and got[at + 6]["labels"] == ""


@pytest.mark.parametrize("text,want", [("a or b and c", [["a"], ["b", "c"]]), ("(a or b) and c", [["a", "c"], ["b", "c"]]), ("a or (a and b)", [["a"]]), ("a with x or b", [["a with x"], ["b"]])])
def test_expressions(text, want):
    assert license_scan.evaluate(license_scan.to_postfix(text)) == want


def test_long_expressions_and_prose(make_docs):
    ands, ors = [f"x{i}" for i in range(14)], [f"y{i}" for i in range(70)]
    cases = [
        (" AND ".join(f"({a} OR {b})" for a, b in zip(ands[::2], ands[1::2], strict=True)), ands), (" or ".join(ors), ors), ("MIT. Then prose with (brackets", ["mit"]), ("Apache-2.0 (see below) or what", ["apache-2.0"]),
        ("MIT SPDX-License-Identifier: (BSD-3-Clause OR ISC) spdx license identifier GPL-2.0 with x", ["mit", "bsd-3-clause", "isc", "gpl-2.0 with x"]), ("MIT OR SPDX-License-Identifier: ISC", ["isc"]), ("MIT \u00e9 x", ["mit"]),
        ("MIT and then prose", ["mit", "then"]), ("MIT OR (ISC", []), ("(MIT OR ISC more", []), (" WITH ".join(["(a OR b)"] * 40), ["a with a", "a with b", "b with a", "b with b"]),
    ]
    docs = make_docs([f"SPDX-License-Identifier: {text}" for text, _ in cases])
    got = {r["doc_id"]: r for r in license_scan.digest(license_scan.scan_licenses(docs)).collect()}
    for i, (text, want) in enumerate(cases):
        assert got[i]["labels"] == ",".join(sorted(want)) and got[i]["score"] == (1 if want else 0), text
    found = license_scan._expressions("a b SPDX-License-Identifier: MIT c\nd SPDX-License-Identifier: ISC")
    assert [(x["text"], x["word"]) for x in found] == [("MIT", 2), ("ISC", 8)]


def test_other_tags_and_many_tags(make_docs):
    text = "Licence id: MIT or ISC. SPDX-License-Identifier: BSL"
    got = license_scan.digest(license_scan.scan_licenses(make_docs([text]), tags=("licence id",))).first()
    assert got["labels"] == "isc,mit"
    began = time.process_time()
    found = license_scan._expressions("x SPDX-License-Identifier: MIT\n" * 8000)
    assert len(found) == 8000 and found[-1]["word"] == 7999 * 5 + 1 and time.process_time() - began < 2


def plain_added(text):
    """Spans of the added kinds, each found by its expression alone."""
    kinds = {r.kind: r.pattern for r in secret_scan.MORE_RULES}
    return sorted(f"{k}:{m.start()}:{m.end()}" for k, p in kinds.items() for m in re.finditer(p, text or "", re.A))


def test_added_spans(make_docs):
    extra = ["https://me:pw@host/x https://a:b@c", "xoxb-1234567890-abc AIza" + "x" * 35, "eyJhbGciOiJIUzI1.eyJzdWIiOiIxMjM0.SflKxwRJSMeKKF2QT4", "-----BEGIN PRIVATE KEY-----"]
    texts = SECRETS + extra + sample_texts(200)
    got = {r["doc_id"]: r["spans"] for r in secret_scan.digest(secret_scan.scan_secrets(make_docs(texts))).collect()}
    base = {"assign", "access", "hex"}
    for i, text in enumerate(texts):
        spans = [s for s in got[i].split(",") if s]
        assert sorted(s for s in spans if s.split(":")[0] not in base) == plain_added(text)
        assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)
    assert sum(bool(plain_added(t)) for t in texts) >= 5


@pytest.mark.parametrize("text", ["", "or", "a or", "(a", "a)", "a b", "and a", "()"])
def test_bad_expressions(text):
    assert license_scan.to_postfix(text) is None


def test_language(make_docs, spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs).withColumn("held_out", language_id.held_out()).toPandas()
    held = got[got.held_out & got.lang.notna()]
    assert len(held) > 100 and (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_odd(make_docs):
    langs = ["en", "en", "fr", "fr", "de", "de", "xx", None] + [None] * 3
    docs = make_docs(["the cat and the dog", "this is the house", "le chat et la maison", "une rose des bois", "der hund und die katze", "das ist ein haus", "zzz qqq", "the end", None, "", "123 ..."], langs=langs)
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    assert len(got) == 11 and all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (8, 9, 10))
    assert {r["lang_pred"] for r in language_id.identify(make_docs(["x y", "z"])).collect()} == {"und"}
