"""Person names as column functions.

Rules for one name are expressions. Whole lists of names are arrays of structs that ``with_names`` fills field by field, one
projection for each rule: nested in one expression, the rules would exceed the analyzer's iteration limit.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import CREATORS
from .text import SPACE, WS, bound, filled, js_trim, let

# Role words after a name, neutral words, labels, organisations, variants.
ROLE_SUFFIXES = {
    "著": "author", "作": "author", "撰": "author", "译": "translator", "翻译": "translator", "编": "editor", "主编": "editor",
    "副主编": "editor", "执行主编": "editor", "编辑": "editor", "编著": "editor", "辑校": "editor", "校": "contributor", "校对": "contributor",
    "校注": "contributor", "点校": "contributor", "选注": "contributor", "录": "contributor", "注": "contributor", "注释": "contributor",
    "ed.": "editor", "eds.": "editor",
}
NEUTRAL_SUFFIXES = ("编绘", "供图", "等")
LABEL_ROLES = {"作者": "author", "著者": "author", "译者": "translator", "编者": "editor", "编辑": "editor", "辑校": "editor", "校对": "contributor"}
FIXED_LABELS = (("作者", "author"), ("译者", "translator"), ("编者", "editor"), ("辑校", "editor"), ("校注", "contributor"), ("校对", "contributor"), ("点校", "contributor"))
ORGANISATIONS = ("系统", "干校", "翻译组", "编辑部", "委员会", "出版社", "博物馆", "研究所", "小组", "工作室")
VARIANTS = {"树": "樹"}

# Character ranges, as the inside of a class.
_HAN = "\\u4E00-\\u9FFF\\u3400-\\u4DBF"
_HAN_WIDE = _HAN + "\\x{20000}-\\x{2A6DF}"
_EAST = _HAN_WIDE + "\\x{2A700}-\\x{2B73F}\\x{2B740}-\\x{2B81F}\\u3040-\\u309F\\u30A0-\\u30FF\\uAC00-\\uD7AF\\u1100-\\u11FF\\u3130-\\u318F"
_EAST_MARKS = "\\u00B7\\u2022\\u2027\\u30FB.\\uFF0E\\-\\u2010-\\u2015\\u2018\\u2019\\u201C\\u201D" + WS
_LATIN = "A-Za-z\\u00C0-\\u024F"
_DOTS = "\\u00B7\\u2022\\u2027\\u30FB"

_NEUTRAL = f"(?:{SPACE}*(?:{'|'.join(NEUTRAL_SUFFIXES)}){SPACE}*)+\\z"
_ROLE = f"(?i){SPACE}*[（(]?({'|'.join(w.replace('.', chr(92) + '.') for w in sorted(ROLE_SUFFIXES, key=len, reverse=True))})[）)]?{SPACE}*\\z"
_ORIGINAL = f"{SPACE}*[（(]([^）)]+)[）)]{SPACE}*"
_QUOTED_DOT = "([“‘][\\u4E00-\\u9FFF0-9]+)[\\u00B7\\u2022\\u2027\\u30FB\\uFF0E.]([\\u4E00-\\u9FFF0-9]+[”’])"
_NAME_DOT = f"(?s)^(.*)[·.](?={SPACE}*[{_HAN_WIDE}]|{SPACE}*.[{_HAN_WIDE}])(.*)\\z"


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for x in chain(*table.items()))), key)


def is_east_asian(name: Column) -> Column:
    """Only ideographs, kana, hangul and separators."""
    return js_trim(name).rlike(f"^[{_EAST}{_EAST_MARKS}]+\\z")


@bound
def remove_nationality(name: Column) -> Column:
    plain = js_trim(name)
    bracket = js_trim(F.regexp_replace(name, f"^{SPACE}*\\[[{_HAN}{WS}/／,，、.\\-]{{1,24}}\\]{SPACE}*", ""))
    paren = js_trim(F.regexp_replace(name, f"^{SPACE}*[（(][\\u4E00-\\u9FFF]{{1,4}}[）)]{SPACE}*", ""))
    return F.when(bracket != plain, bracket).otherwise(paren)


def nationality(name: Column) -> Column:
    return F.coalesce(filled(F.regexp_extract(name, f"^{SPACE}*\\[([^\\]]+)\\]", 1)), filled(F.regexp_extract(name, f"^{SPACE}*[（(]([\\u4E00-\\u9FFF]{{1,4}})[）)]", 1)))


def unify_dots(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, f"{SPACE}*\\uFF0E{SPACE}*", "."), f"{SPACE}*[{_DOTS}]{SPACE}*", "·")


@bound
def _without_neutral(name: Column) -> Column:
    return F.coalesce(filled(js_trim(F.regexp_replace(js_trim(name), _NEUTRAL, ""))), js_trim(name))


@bound
def role_suffix(name: Column) -> Column:
    """Struct (clean, role) without neutral words and a role word at the end."""
    def split(plain: Column) -> Column:
        word = F.regexp_extract(plain, _ROLE, 1)
        return F.struct(F.when(word == "", plain).otherwise(_without_neutral(F.regexp_replace(plain, _ROLE, ""))).alias("clean"), _lookup(ROLE_SUFFIXES, F.lower(word)).alias("role"))

    return let(_without_neutral(name), split)


def label_role(label: Column) -> Column:
    return _lookup(LABEL_ROLES, F.regexp_replace(label, f"[:：{WS}]", ""))


@bound
def original_name(name: Column) -> Column:
    """Struct (clean, original) of the first bracketed name."""
    whole = F.regexp_extract(name, _ORIGINAL, 0)
    at = F.instr(name, whole)
    rest = js_trim(F.concat(F.substr(name, F.lit(1), at - 1), F.substr(name, at + F.length(whole))))
    return F.struct(F.when(whole == "", name).otherwise(rest).alias("clean"), F.when(whole != "", js_trim(F.regexp_extract(name, _ORIGINAL, 1))).alias("original"))


@bound
def strip_latin_alias(name: Column) -> Column:
    """Drops what follows the last ideograph of the basic plane if it has Latin letters; a name without any keeps all but an alias."""
    head, tail = (F.regexp_extract(name, f"(?s)^(.*[{_HAN}])(.*)\\z", k) for k in (1, 2))
    alias = name.rlike(f"[{_HAN_WIDE}]") & F.when(head == "", name.rlike(f"[{_LATIN}]")).otherwise(js_trim(tail).rlike(f"[{_LATIN}]"))
    return F.when(alias, js_trim(head)).otherwise(name)


@bound
def squeeze_east_asian(name: Column) -> Column:
    return let(js_trim(name), lambda p: F.when(p.rlike(f"[{_EAST}]") & is_east_asian(p) & ~p.rlike(f"[{_LATIN}]"), F.regexp_replace(p, f"{SPACE}+", "")).otherwise(p))


def is_organisation(name: Column) -> Column:
    return name.rlike(f"[{_HAN_WIDE}]") & name.rlike("|".join(ORGANISATIONS))


def _fold(text: Column) -> Column:
    return F.lower(reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), VARIANTS.items(), unify_dots(text)))


def full_name(c: Column) -> Column:
    return js_trim(F.concat(c["first_name"], F.lit(" "), c["last_name"]))


def name_key(c: Column) -> Column:
    """Name with variants folded."""
    return _fold(full_name(c))


def creator_key(c: Column) -> Column:
    return F.concat(c["creator_type"], F.lit(":"), name_key(c))


def variant_score(c: Column) -> Column:
    name = full_name(c)
    return reduce(lambda s, kv: s + F.when(name.contains(kv[1]), 2).otherwise(0) - F.when(name.contains(kv[0]), 1).otherwise(0), VARIANTS.items(), F.lit(0))


@bound
def dedupe_roles(creators: Column) -> Column:
    """Editors and contributors named like an author go."""
    authors = F.transform(F.filter(creators, lambda c: c["creator_type"] == "author"), name_key)
    return let(authors, lambda known: F.filter(creators, lambda c: ~(c["creator_type"].isin("editor", "contributor") & F.array_contains(known, name_key(c)))))


def name_list(raw: Column, role: Column) -> Column:
    """One list of names, for ``with_names``."""
    return F.array(F.struct(role.alias("role"), F.coalesce(raw, F.lit("")).alias("value"), F.lit(False).alias("linked")))


def page_lists(entries: Column, anchors: Column) -> Column:
    """A page's lists of names: those of the fixed labels, of labels with a role in page order, and of linked authors.

    entries: array of (label, value) with each label once; anchors: linked names of the author label, one string for each label.
    """
    listed = lambda role, value, linked: F.struct(role.alias("role"), value.alias("value"), F.lit(linked).alias("linked"))
    by_label = F.map_from_entries(entries)
    fixed = F.array(*(listed(F.lit(role), F.try_element_at(by_label, F.lit(label)), False) for label, role in FIXED_LABELS))
    others = F.transform(entries, lambda e: listed(_lookup(LABEL_ROLES, e["label"]), e["value"], False))
    linked = F.transform(anchors, lambda a: listed(F.lit("author"), a, True))
    return F.filter(F.concat(fixed, others, linked), lambda x: x["role"].isNotNull() & F.coalesce(x["value"] != "", F.lit(False)))


def _pieces(value: Column) -> Column:
    return F.filter(F.transform(F.split(remove_nationality(value), "[/、，,]"), js_trim), lambda n: n != "")


def _parts_of(name: Column) -> Column:
    """Struct (first, last, mode): at the last dot before an ideograph, else at the last space of a name in other scripts."""
    first, last = (js_trim(F.regexp_extract(name, _NAME_DOT, k)) for k in (1, 2))
    words = F.filter(F.split(name, f"{SPACE}+"), lambda w: w != "")
    whole = is_organisation(name)
    dotted = ~whole & name.rlike(f"[{_HAN_WIDE}]") & (first != "") & (last != "")
    spaced = ~whole & ~is_east_asian(name) & (F.size(words) > 1)
    part = lambda d, s, other: F.when(dotted, d).when(spaced, s).otherwise(other)
    return F.struct(
        part(first, F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), " "), F.lit("")).alias("first"),
        part(last, F.element_at(words, F.when(F.size(words) > 0, -1)), name).alias("last"),
        part(F.lit(0), F.lit(0), F.lit(1)).alias("mode"),
    )


def with_names(df: DataFrame, lists: Column, out: str = "names", whole: bool = False) -> DataFrame:
    """``df`` with the names of its lists, in order, as structs: list, role, linked, raw, name, note, creator, key.

    A list is cut at its separators (not with ``whole``); of a pair of one local and one foreign name only the local one stays.
    ``note`` is a bracketed original name, but for short nationalities; ``key`` tells creators of one list apart.
    """
    cut = (lambda v: F.array(v)) if whole else _pieces
    found = F.transform(lists, lambda x, i: F.transform(cut(x["value"]), lambda n: F.struct(i.alias("list"), x["role"].alias("role"), x["linked"].alias("linked"), n.alias("raw"))))
    df = df.withColumn(out, F.flatten(found))

    def each(field: str, rule: Callable[[Column], Column]) -> None:
        nonlocal df
        df = df.withColumn(out, F.transform(out, lambda x: x.withField(field, rule(x))))

    each("plain", lambda x: remove_nationality(x["raw"]))
    each("suffix", lambda x: role_suffix(unify_dots(x["plain"])))
    each("original", lambda x: original_name(x["suffix"]["clean"]))
    each("base", lambda x: F.when(is_organisation(x["plain"]), F.regexp_replace(x["original"]["clean"], _QUOTED_DOT, "$1$2")).otherwise(x["original"]["clean"]))
    each("name", lambda x: strip_latin_alias(x["base"]))
    each("name", lambda x: squeeze_east_asian(x["name"]))
    if not whole:
        has = lambda y, script: y["name"].rlike(f"[{script}]")
        pair = lambda x: F.filter(out, lambda y: y["list"] == x["list"])
        foreign = lambda x, two: (F.size(two) == 2) & ~has(x, _HAN_WIDE) & F.exists(two, lambda y: has(y, _HAN_WIDE)) & F.exists(two, lambda y: has(y, _LATIN))
        df = df.withColumn(out, F.filter(out, lambda x: ~foreign(x, pair(x))))
    each("part", lambda x: _parts_of(x["name"]))
    role = lambda x: F.coalesce(x["suffix"]["role"], x["role"])
    each("creator", lambda x: F.struct(x["part"]["first"].alias("first_name"), x["part"]["last"].alias("last_name"), role(x).alias("creator_type"), x["part"]["mode"].alias("field_mode"), F.lit(None).cast("boolean").alias("needs_review")))
    each("key", lambda x: F.struct(x["creator"]["creator_type"].alias("role"), name_key(x["creator"]).alias("name")))
    note = lambda x: F.when(~F.coalesce(x["original"]["original"].rlike("^[\\u4E00-\\u9FFF]{1,4}\\z"), F.lit(False)), filled(x["original"]["original"]))
    slim = lambda x: F.struct(*(x[n].alias(n) for n in ("list", "role", "linked", "raw", "name", "creator", "key")), note(x).alias("note"))
    return df.withColumn(out, F.transform(out, slim))


def _first_of_each(names: Column, same: Callable[[Column, Column], Column]) -> Column:
    """The first of the names that are the same. A page's lists are short."""
    return F.filter(names, lambda x, i: ~F.exists(F.slice(names, 1, i), lambda y: same(x, y)))


def first_of_list(names: Column) -> Column:
    """Of each list, the first name of each key."""
    return _first_of_each(names, lambda x, y: (x["list"] == y["list"]) & x["key"].eqNullSafe(y["key"]))


def creators_of(names: Column) -> Column:
    return F.transform(names, lambda x: x["creator"]).cast(CREATORS)


def notes_of(names: Column) -> Column:
    return F.filter(F.transform(names, lambda x: x["note"]), lambda n: n.isNotNull())


def preferred(names: Column) -> Column:
    """Creators; of variants of one name the preferred one, at the first one's place."""
    placed = F.transform(names, lambda x, i: F.struct((-variant_score(x["creator"])).alias("order"), i.alias("i"), x["key"].alias("key"), x["creator"].alias("creator")))

    def best(xs: Column) -> Column:
        firsts = _first_of_each(xs, lambda x, y: x["key"].eqNullSafe(y["key"]))
        return F.transform(firsts, lambda f: F.array_min(F.filter(xs, lambda x: x["key"].eqNullSafe(f["key"])))["creator"])

    return let(placed, best).cast(CREATORS)


def page_people(df: DataFrame, lists: Column, creators: str = "creators", notes: str = "notes") -> DataFrame:
    """``df`` with a page's creators and notes. Linked authors count where no list names an author; copies and role aliases go."""
    own = "page_names"
    df = with_names(df, lists, own)
    df = df.withColumn(own, first_of_list(F.col(own)))
    author = lambda x: F.coalesce(x["creator"]["creator_type"] == "author", F.lit(False))
    named = F.exists(own, lambda x: author(x) & ~x["linked"])
    df = df.withColumn(own, F.filter(own, lambda x: ~x["linked"] | ~named))
    df = df.withColumn(notes, F.array_distinct(notes_of(F.col(own))))
    full = lambda x: F.lower(full_name(x["creator"]))
    df = df.withColumn(own, _first_of_each(F.col(own), lambda x, y: x["creator"]["creator_type"].eqNullSafe(y["creator"]["creator_type"]) & (full(x) == full(y))))
    return df.withColumn(creators, dedupe_roles(creators_of(F.col(own)))).drop(own)


def display_names(creators: Column, role: str) -> Column:
    """Names of a role, as shown."""
    shown = F.transform(F.filter(creators, lambda c: c["creator_type"] == role), lambda c: F.when(c["field_mode"] == 1, c["last_name"]).otherwise(full_name(c)))
    return F.filter(shown, lambda n: n != "")


def role_counts(creators: Column) -> Column:
    """Array of (role, n) in order of first appearance."""
    count = lambda roles: F.transform(F.array_distinct(roles), lambda r: F.struct(r.alias("role"), F.size(F.filter(roles, lambda x: x == r)).alias("n")))
    return let(F.transform(creators, lambda c: c["creator_type"]), count)
