"""Dates, ISBNs, languages, similarity and volume numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, WS, filled, js_trim

_DATE = f"([0-9]{{4}})(?:{SPACE}*(?:年|[-./]){SPACE}*([0-9]{{1,2}})(?:{SPACE}*(?:月|[-./]){SPACE}*([0-9]{{1,2}}){SPACE}*(?:日|号)?)?)?"

# Supported languages.
LANGUAGES = ("zh", "ja", "en", "fr", "es", "de", "ru", "ar", "sv")


def _date(year: Column, month: Column, day: Column) -> Column:
    y, m, d = (x.try_cast("int") for x in (year, month, day))
    leap = (y % 400 == 0) | ((y % 4 == 0) & (y % 100 != 0))
    most = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    month_text = F.concat(year, F.lit("-"), F.lpad(m.cast("string"), 2, "0"))
    return (
        F.when(F.coalesce(y, F.lit(0)) < 1, "")
        .when(F.coalesce(month, F.lit("")) == "", year)
        .when((m < 1) | (m > 12), "")
        .when(F.coalesce(day, F.lit("")) == "", month_text)
        .when((d < 1) | (d > most), "")
        .otherwise(F.concat(month_text, F.lit("-"), F.lpad(d.cast("string"), 2, "0")))
    )


def publication_date(raw: Column) -> Column:
    """``YYYY``, ``YYYY-MM`` or ``YYYY-MM-DD`` as far as the text proves it; empty if there is no date or it is impossible."""
    text = F.coalesce(raw, F.lit(""))
    return _date(*(F.regexp_extract(text, _DATE, k) for k in (1, 2, 3)))


def is_publication_date(value: Column) -> Column:
    text = js_trim(F.coalesce(value, F.lit("")))
    return text.rlike("^[0-9]{4}(-[0-9]{2}(-[0-9]{2})?)?\\z") & (publication_date(text) == text)


def clean_isbn(isbn: Column) -> Column:
    return F.regexp_replace(isbn, f"[-{WS}]", "")


def isbn13(isbn: Column) -> Column:
    """Thirteen digits as they are; ten get the prefix 978 and a new check digit; else null."""
    c = clean_isbn(isbn)
    first = F.concat(F.lit("978"), F.substring(c, 1, 9))
    total = sum((F.substring(first, i + 1, 1).try_cast("int") * (3 if i % 2 else 1) for i in range(12)), F.lit(0))
    return F.when(c.rlike("^[0-9]{13}\\z"), c).when(c.rlike("^[0-9]{9}[0-9Xx]\\z"), F.concat(first, F.pmod(-total, F.lit(10)).cast("string")))


def is_isbn(isbn: Column) -> Column:
    return clean_isbn(isbn).rlike("^97[89][0-9]{10}\\z|^[0-9]{9}[0-9Xx]\\z")


def isbn_keys(*isbns: Column) -> Column:
    """Cleaned and thirteen-digit forms, in order, each once."""
    forms = [f for x in isbns for f in (clean_isbn(x), isbn13(x))]
    return F.array_distinct(F.filter(F.array(*forms), lambda x: x.isNotNull() & (x != "")))


def share_isbn(keys: Column, other: Column) -> Column:
    """Null if either side has no key."""
    return F.when((F.size(keys) > 0) & (F.size(other) > 0), F.arrays_overlap(keys, other))


def language(value: Column) -> Column:
    low = F.lower(js_trim(value))
    return F.when(low.isin(*LANGUAGES), low)


def similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((a == b) | (longest == 0), 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


# Marks that comparison ignores.
_MARKS = "[，。、；：！？（）【】《》\"·—\\-,.;:!?()\\[\\]{}<>']"


def comparable(c: Column) -> Column:
    """Lower case without white space and listed marks."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, f"{SPACE}+", ""), _MARKS, ""))


def normalized_similarity(a: Column, b: Column) -> Column:
    return similarity(comparable(a), comparable(b))


def main_title(title: Column) -> Column:
    return js_trim(F.split(title, "[：:—]")[0])


def pad2(number: Column) -> Column:
    """At least two digits; ``lpad`` alone would cut longer ones."""
    return F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)


# Marks of a volume number, in their order.
_VOLUME = (
    "卷([0-9]+)",
    "第([0-9]+)[卷册话集部]",
    f"(?i)vol\\.?{SPACE}*([0-9]+)",
    f"(?i)volume{SPACE}*([0-9]+)",
    "(?i)(?<![A-Za-z0-9_])v([0-9]+)(?![A-Za-z0-9_])",
    "[(\\[（]([0-9]+)[)\\]）]",
)


def file_stem(filename: Column) -> Column:
    return F.regexp_replace(filename, "\\.[^.]+\\z", "")


def volume_number(filename: Column) -> Column:
    """The number of a file's name, of two digits at least; null if its stem has no digit. Each rule is named once, so it is tried once."""
    name = file_stem(filename)
    # a list of matches is null at its end, where a single extract would be compared with the empty string and made again
    found = [F.try_element_at(F.regexp_extract_all(name, F.lit(p), 1), F.lit(1)) for p in _VOLUME]
    return F.regexp_replace(F.coalesce(*found, F.try_element_at(F.regexp_extract_all(name, F.lit("([0-9]+)"), 1), F.lit(-1))), "^([0-9])\\z", "0$1")
