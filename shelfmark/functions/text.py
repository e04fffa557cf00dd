"""Column functions over text and URLs. White space and trimming follow ECMAScript, not ASCII."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..site import SITE, Site

# Fixed value: ECMAScript white space, as the inside of a character class.
WS = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
SPACE = f"[{WS}]"


def let(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it; expressions would else grow with every level."""
    return F.transform(F.array(c), use)[0]


def bound(f: Callable[..., Column]) -> Callable[..., Column]:
    """A function whose first argument is computed once."""
    return wraps(f)(lambda c, *rest: let(c, lambda x: f(x, *rest)))


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+\\z", "")


def squash(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return js_trim(F.regexp_replace(c, f"{SPACE}+", " "))


def has_text(c: Column) -> Column:
    return F.coalesce(F.length(js_trim(c)) > 0, F.lit(False))


def filled(c: Column) -> Column:
    """Null for the empty string."""
    return F.when(c != "", c)


def strip_tags(c: Column) -> Column:
    return squash(F.regexp_replace(c, "<[^>]*>", ""))


def count_text(c: Column) -> Column:
    """Text of a counter: tags and no-break spaces gone."""
    return squash(F.regexp_replace(strip_tags(c), "(?i)&nbsp;|&#160;|&#xA0;", " "))


def subject_id(url: Column) -> Column:
    """Digits after ``subject/``; empty if absent."""
    return F.regexp_extract(url, "subject/([0-9]+)", 1)


def subject_id_or_null(url: Column) -> Column:
    return filled(F.regexp_extract(url, "/subject/([0-9]+)/?", 1))


def absolute_url(url: Column, site: Site = SITE) -> Column:
    """Form (a): ``//host`` gets https, a path gets the site's root."""
    return F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), url).when(url.startswith("/"), F.concat(F.lit(site.root), url)).otherwise(F.concat(F.lit(site.root + "/"), url))


def https_url(url: Column, site: Site = SITE) -> Column:
    """Form (b): absolute, https, no fragment."""
    return F.regexp_replace(F.regexp_replace(absolute_url(url, site), "^[Hh][Tt][Tt][Pp]:", "https:"), "#.*\\z", "")


def plain_url(url: Column, site: Site = SITE) -> Column:
    """Form (c): as (b), without query."""
    return F.regexp_replace(https_url(url, site), "\\?.*\\z", "")


def strict_subject_url(url: Column, site: Site = SITE) -> Column:
    """Form (d): ``https://host/subject/{id}/``, or null for another protocol, host or path."""
    full = absolute_url(url, site)
    number = F.regexp_extract(full, f"^https://{_quoted(site.host)}/subject/([0-9]+)/?(?:[?#].*)?\\z", 1)
    return F.when(number != "", F.concat(F.lit(f"{site.root}/subject/"), number, F.lit("/")))


def owner_id(url: Column) -> Column:
    """The list's owner in ``/people/{owner}/wish``, percent-decoded; empty if absent."""
    return F.try_url_decode(F.regexp_extract(F.regexp_replace(url, "[?#].*\\z", ""), "/people/([^/]+)/wish", 1))


def readlist(value: Column, site: Site = SITE) -> Column:
    """Struct (uid, url) of a list named by its owner or its address; null for anything else."""
    v = js_trim(value)
    host = _quoted(site.host)
    path = F.regexp_extract(v, f"^[A-Za-z]+://{host}(?::[0-9]*)?/+people/+([^/?#]+)/+wish(?:[/?#].*)?\\z", 1)
    uid = F.when(v.rlike("^[A-Za-z0-9_-]+\\z"), v).otherwise(js_trim(F.try_url_decode(filled(path))))
    return F.when(uid.rlike("^[A-Za-z0-9_-]+\\z"), F.struct(uid.alias("uid"), F.concat(F.lit(f"{site.root}/people/"), uid, F.lit("/wish")).alias("url")))


@bound
def sorted_query_url(url: Column, site: Site = SITE) -> Column:
    """Without fragment, query parts in the order of their names (stable)."""
    full = F.regexp_replace(absolute_url(url, site), "#.*\\z", "")
    query = F.regexp_extract(full, "\\?(.*)\\z", 1)
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    keyed = F.transform(parts, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), p.alias("p")))
    ordered = F.array_join(F.transform(F.array_sort(keyed), lambda s: s["p"]), "&")
    base = F.regexp_replace(full, "\\?.*\\z", "")
    return F.when(query == "", base).otherwise(F.concat(base, F.lit("?"), ordered))


def fnv1a32(c: Column) -> Column:
    """FNV-1a over the characters' codes, as eight hex digits."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    mask = F.lit(0xFFFFFFFF).cast("long")
    # h * 16777619 mod 2^32 with h below 2^32 stays below 2^57
    value = F.aggregate(codes, F.lit(0x811C9DC5).cast("long"), lambda h, x: (h.bitwiseXOR(x) * F.lit(16777619)).bitwiseAND(mask))
    return F.lpad(F.lower(F.hex(value)), 8, "0")


def cache_key(url: Column, site: Site = SITE) -> Column:
    return let(sorted_query_url(url, site), lambda full: F.concat(F.coalesce(F.concat(F.lit("subject-"), subject_id_or_null(full)), F.lit("url")), F.lit("-"), fnv1a32(full)))


def start_offset(url: Column) -> Column:
    """The ``start`` parameter as a number of zero or more; else 0."""
    return F.coalesce(F.regexp_extract(url, "[?&]start=([0-9]{1,9})(?:[&#].*)?\\z", 1).try_cast("int"), F.lit(0))


def page_url(list_url: Column, start: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(list_url, "#.*\\z", ""), "([?&])start=[^&]*&?", "$1")
    bare = F.regexp_replace(bare, "[?&]\\z", "")
    return F.concat(bare, F.when(bare.contains("?"), F.lit("&")).otherwise(F.lit("?")), F.lit("start="), start.cast("string"))


# Query parameters whose values are hidden.
SECRET_PARAMS = "api[-_]?key|access[-_]?token|token|secret|password|authorization|auth|bearer|key"


def redact(text: Column, key: str | None = None) -> Column:
    """Log text without a literal key, user names and passwords in URLs, and values of secret query parameters."""
    if key:
        text = F.replace(text, F.lit(key), F.lit("[redacted-api-key]"))
    text = F.regexp_replace(text, "(?i)(https?://)[^\\s\"'`<>/?#@]+@", "$1redacted@")
    return F.regexp_replace(text, f"(?i)(https?://[^\\s\"'`<>]*?[?&]|(?<=[?&]))({SECRET_PARAMS})=[^&#\\s\"'`<>]*", "$1$2=redacted")


def safe_id(c: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9_.-]", "-"), "-+", "-"), 1, 80)


def candidate_id(record_id: Column) -> Column:
    return F.concat(F.lit("candidate-"), F.substring(F.sha2(record_id, 256), 1, 12))


def fallback_id(text: Column) -> Column:
    """Twelve hex digits for a page without a number."""
    return F.substring(F.sha2(text, 256), 1, 12)


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd-HHmmss")


def collection_name(version: str, test: str, ts: Column, site: Site = SITE) -> Column:
    return F.concat_ws(" ", F.lit(site.collection_prefix), F.lit(version), F.lit(test), stamp(ts))


def bib_escape(c: Column) -> Column:
    """Backslashes first, then braces, so the braces that the first step makes are escaped as well."""
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\textbackslash{}")), "([{}])", "\\\\$1")


def bib_field(name: str, c: Column) -> Column:
    return F.when(c != "", F.concat(F.lit(f"  {name} = {{"), bib_escape(c), F.lit("}")))


def _quoted(host: str) -> str:
    return host.replace(".", "\\.")
