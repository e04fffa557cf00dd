"""License scans with one Aho-Corasick automaton and a shunting-yard parser.

The automaton runs over each text's words (letters and digits, A-Z lower-cased, joined by single spaces) and finds notice
phrases and the words of identifier tags. After a tag, the longest valid licence expression at the start of the rest of the
line is read; text may follow it, and the next tag ends it. A shunting-yard parser puts identifiers and the operators OR, AND
and WITH (in rising order of binding) into reverse Polish order, which is kept: its identifiers are the labels, without
expansion. ``evaluate`` lists the alternatives that a user may choose from; their number may double with each choice.

An expression that its line or the next tag breaks off after an operator or inside brackets is malformed. There is no list of
known identifiers, so a word of prose after an operator ("MIT and then") is read as one.

Null text counts as empty. Word positions count from 0. A phrase counts at each place where its words stand consecutively,
overlaps included. Rows and all other columns stay as they are; repeated rows get equal results, and an empty table gives an
empty one. A column of the input with the result's name stays, as ``<name>_input``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, set_aside

RESULT = "struct<n_words:long,notices:array<struct<label:string,phrase:string,word:int,base:boolean>>,expressions:array<struct<text:string,word:int,valid:boolean,postfix:array<string>,labels:array<string>>>>"

# Base phrases and labels.
BASE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
# Further notice phrases.
MORE_PHRASES = (
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nd", "cc-by-nd"),
    ("cc0 1 0 universal", "cc0"),
    ("all rights reserved", "all-rights-reserved"),
)
# Identifier tags as words.
TAGS = ("spdx license identifier",)
_LINE_END = re.compile(rb"[\r\n]")
_WORD_BYTES = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
_AROUND = "*/#-;,<>!. \t\"'"  # may stand between tokens
_RANK = {"or": 1, "and": 2, "with": 3}


def longest_expression(line: str) -> str:
    """The longest valid expression at the start of ``line``; empty if there is none or the line ends before the expression does."""
    operand, depth, at, end = True, 0, 0, 0
    for m in _TOKEN.finditer(line):
        token, between = m[0], line[at : m.start()]
        at = m.end()
        if between.strip(_AROUND):
            return line[:end]
        if token.lower() in _RANK:
            if operand:
                return line[:end]
            operand = True
        elif token == "(":
            if not operand:
                return line[:end]
            depth += 1
        elif token == ")":
            if operand or not depth:
                return line[:end]
            depth -= 1
        elif re.search(r"[A-Za-z0-9]", token):
            if not operand:
                return line[:end]
            operand = False
        else:
            continue
        if not operand and not depth:
            end = at
    return line[:end] if line[at:].strip(_AROUND) or not (operand or depth) else ""


def to_postfix(expression: str) -> list[str] | None:
    """Reverse Polish order of a licence expression by the shunting-yard method; None if it is malformed."""
    out: list[str] = []
    waiting: list[str] = []
    operand = True  # what must come next
    rest = _TOKEN.sub("", expression).strip()
    if rest.strip(_AROUND):
        return None
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if low in _RANK:
            if operand:
                return None
            while waiting and waiting[-1] != "(" and _RANK[waiting[-1]] >= _RANK[low]:
                out.append(waiting.pop())
            waiting.append(low)
            operand = True
        elif token == "(":
            if not operand:
                return None
            waiting.append("(")
        elif token == ")":
            if operand:
                return None
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        elif not re.search(r"[A-Za-z0-9]", token):
            continue
        else:
            if not operand:
                return None
            out.append(low.rstrip(".:"))
            operand = False
    while waiting:
        if waiting[-1] == "(":
            return None
        out.append(waiting.pop())
    return out if out and not operand else None


def evaluate(postfix: list[str]) -> list[list[str]] | None:
    """The alternatives of an expression, sorted, supersets dropped; None if an operator lacks an operand. All are listed, however many."""
    stack: list[list[frozenset[str]]] = []
    for token in postfix:
        if token not in _RANK:
            stack.append([frozenset({token})])
            continue
        if len(stack) < 2:
            return None
        right, left = stack.pop(), stack.pop()
        if token == "or":
            made = left + right
        elif token == "and":
            made = [a | b for a in left for b in right]
        else:  # an exception belongs to each licence of its left side
            made = [frozenset(f"{x} with {y}" for x in a for y in b) for a in left for b in right]
        stack.append([a for a in dict.fromkeys(made) if not any(b < a for b in made)])
    return sorted(sorted(a) for a in stack[0]) if len(stack) == 1 else None


def identifiers(postfix: list[str]) -> list[str]:
    """Identifiers of an expression, sorted; licences with exceptions as pairs "x with y", each licence left of WITH with each name right of it."""
    stack: list[tuple[frozenset, frozenset]] = []  # names alone, pairs
    for token in postfix:
        if token not in _RANK:
            stack.append((frozenset({token}), frozenset()))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            licences, exceptions = left[0] | {x for x, _ in left[1]}, right[0].union(*right[1])
            stack.append((frozenset(), left[1] | {(x, y) for x in licences for y in exceptions}))
        else:
            stack.append((left[0] | right[0], left[1] | right[1]))
    return sorted({*stack[0][0], *(f"{x} with {y}" for x, y in stack[0][1])})


@lru_cache(maxsize=8)
def _tag_in_text(tags: tuple) -> re.Pattern:
    """A tag's words as they may stand in a text, and a colon after them."""
    words = [rb"[^a-z0-9\x80-\xff]+".join(re.escape(w) for w in tag.encode().split()) for tag in sorted(tags, key=len, reverse=True)]
    return re.compile(rb"(?:" + b"|".join(words) + rb")(?![a-z0-9\x80-\xff])[ \t]*:?[ \t]*")


@lru_cache(maxsize=8)
def _automaton(phrases: tuple, tags: tuple) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label, base in phrases:
        found.add_word(f" {phrase} ", (phrase, label, base, phrase.count(" ") + 1))
    for tag in tags:
        found.add_word(f" {tag} ", (tag, None, False, tag.count(" ") + 1))
    found.make_automaton()
    return found


def _expressions(text: str, tags: tuple = TAGS) -> list[dict]:
    """Tags whose words stand consecutively in the words of the text, and the expression after each."""
    low = text.encode("utf-8", "surrogatepass")
    folded = low.lower()
    found = [m.span() for m in _tag_in_text(tags).finditer(folded) if not (m.start() and _WORD_BYTES.match(folded[m.start() - 1 : m.start()]))]
    out, word, at = [], 0, 0
    for (start, after), (following, _) in zip(found, [*found[1:], (len(low), 0)], strict=True):
        word, at = word + len(_WORD_BYTES.findall(folded[at:start])), start
        line_end = _LINE_END.search(low, after, following)
        line = low[after : line_end.start() if line_end else following].decode("utf-8", "replace").strip()
        shown = longest_expression(line)
        order = to_postfix(shown) if shown else None
        out.append({"text": shown or line, "word": word, "valid": order is not None, "postfix": order or [], "labels": identifiers(order) if order else []})
    return out


def _scan(text: str | None, machine: ahocorasick.Automaton, tags: tuple) -> dict:
    words = alnum_words(text)
    if not words:
        return {"n_words": 0, "notices": [], "expressions": []}
    line = b" ".join([b"", *words, b""]).decode("latin-1")
    notices, tagged, spaces = [], False, None
    for end, (phrase, label, base, size) in machine.iter(line):
        if label is None:
            tagged = True
            continue
        if spaces is None:
            spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), dtype=np.uint8) == 0x20)
        notices.append({"label": label, "phrase": phrase, "word": int(np.searchsorted(spaces, end)) - size, "base": base})
    notices.sort(key=lambda x: (x["word"], x["phrase"]))
    return {"n_words": len(words), "notices": notices, "expressions": _expressions(text, tags) if tagged else []}


def license_findings(text: Column, base_phrases: tuple = BASE_PHRASES, more_phrases: tuple = MORE_PHRASES, tags: tuple = TAGS) -> Column:
    """Struct of the word count, the notice phrases found and the licence expressions found."""
    phrases = (*((p, l, True) for p, l in base_phrases), *((p, l, False) for p, l in more_phrases))

    @F.pandas_udf(RESULT)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine = _automaton(phrases, tags)
        for texts in batches:
            yield pd.DataFrame([_scan(t, machine, tags) for t in texts], columns=["n_words", "notices", "expressions"])

    return find(text)


def scan_licenses(docs: DataFrame, text_col: str = "text", out_col: str = "licenses", **rules) -> DataFrame:
    """``docs`` with a column of licence findings."""
    return set_aside(docs, out_col).withColumn(out_col, license_findings(F.col(text_col), **rules))


def digest(found: DataFrame) -> DataFrame:
    """Counts, first and last place and labels of the base phrases, all labels, and a score.

    Labels of the method are those of all phrases and all identifiers of a valid expression. The score is
    1 with a valid expression, else 0.9 with a phrase of three words or more, else 0.6 with any phrase, else 0.
    """
    base = F.filter("licenses.notices", lambda x: x["base"])
    at = F.transform(base, lambda x: x["word"].cast("long"))
    labels = lambda xs: F.array_join(F.array_sort(F.array_distinct(xs)), ",")
    named = F.transform("licenses.notices", lambda x: x["label"])
    tagged = F.flatten(F.transform("licenses.expressions", lambda x: x["labels"]))
    return found.select(
        "doc_id",
        F.col("licenses.n_words").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        labels(F.transform(base, lambda x: x["label"])).alias("base_labels"),
        labels(F.concat(named, tagged)).alias("labels"),
        F.when(F.exists("licenses.expressions", lambda x: x["valid"]), 1.0)
        .when(F.exists("licenses.notices", lambda x: F.size(F.split(x["phrase"], " ")) >= 3), 0.9)
        .when(F.size(named) > 0, 0.6)
        .otherwise(0.0)
        .alias("score"),
    )
