"""Detail pages to book records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as nz
from ..functions.creators import page_lists, page_people
from ..functions.text import SPACE, WS, filled, js_trim, let, subject_id
from ..schemas import BOOK_FIELDS
from ..site import SITE, Site
from .pagehtml import page_fields


def info_entries(info_html: Column) -> Column:
    """Array of (label, value) of an info block's markup: each label once, at its first place, with its last value."""
    lines = F.split(info_html, "(?i)<br\\s*/?>")
    label_rx = "(?i)<span\\s+class=\"pl\">\\s*(.*?)\\s*</span>"

    def entry(line: Column) -> Column:
        whole = F.regexp_extract(line, label_rx, 0)
        label = F.regexp_replace(F.regexp_replace(F.regexp_extract(line, label_rx, 1), "<[^>]*>", ""), f"[:：{WS}]", "")
        value = F.regexp_replace(F.substr(line, F.instr(line, whole) + F.length(whole)), "<[^>]*>", "")
        for mark, plain in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
            value = F.replace(value, F.lit(mark), F.lit(plain))
        value = js_trim(F.regexp_replace(F.regexp_replace(value, f"{SPACE}+", " "), f"^[{WS}:：]+", ""))
        return F.struct(F.when(whole != "", label).otherwise("").alias("label"), value.alias("value"))

    def last_wins(found: Column) -> Column:
        return F.transform(F.array_distinct(F.transform(found, lambda e: e["label"])), lambda k: F.struct(k.alias("label"), F.element_at(F.filter(found, lambda e: e["label"] == k), -1)["value"].alias("value")))

    return let(F.filter(F.transform(lines, entry), lambda e: (e["label"] != "") & (e["value"] != "")), last_wins)


def page_title(raw: Column, site: Site = SITE) -> Column:
    """The heading, else the page's title without the site's name."""
    return F.coalesce(filled(raw["h1_span"]), js_trim(F.regexp_replace(raw["page_title"], f"{SPACE}*\\({site.title_suffix}\\){SPACE}*\\z", "")), F.lit(""))


def merge_subtitle(title: Column, subtitle: Column) -> Column:
    sub = js_trim(F.coalesce(subtitle, F.lit("")))
    plain = lambda c: F.lower(F.regexp_replace(F.regexp_replace(c, "[：:]", ":"), f"{SPACE}+", ""))
    joined = F.concat(title, F.when(title.rlike("[\\u3040-\\u30ff\\u3400-\\u9fff\\uf900-\\ufaff\\uac00-\\ud7af]"), "：").otherwise(": "), sub)
    return F.when((sub == "") | plain(title).contains(F.concat(F.lit(":"), plain(sub))), title).otherwise(joined)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with the helper's ``raw`` fields and without the html."""
    return pages.withColumn("raw", page_fields(F.col(html))).drop(html)


def books(pages: DataFrame, site: Site = SITE, html: str = "html", surfaces: bool = False) -> DataFrame:
    """Pages (url, html, ...) as ``book`` structs. Rows that cannot be read have ``parse_error`` and a null book.

    The html is dropped right after the one helper pass. With ``surfaces`` the page's labels and surfaces stay beside the book.
    """
    raw = extract(pages, html).withColumn("entries", info_entries(F.col("raw.info_html")))
    none = F.array().cast("array<struct<label:string,value:string>>")
    raw = page_people(raw, page_lists(F.coalesce("entries", none), F.col("raw.author_anchors")), "page_creators", "page_notes")
    raw = raw.withColumn("main_title", page_title(F.col("raw"), site))
    raw = raw.withColumn("by_label", F.map_from_entries("entries"))
    value = lambda label: F.try_element_at(F.col("by_label"), F.lit(label))
    either = lambda *labels: F.coalesce(*(filled(value(x)) for x in labels))
    isbn = either("ISBN", "统一书号")
    known = {
        "book_url": F.col("url"), "book_id": subject_id(F.col("url")), "title": merge_subtitle(F.col("main_title"), value("副标题")), "subtitle": value("副标题"),
        "publisher": F.coalesce(value("出版社"), F.lit("")), "publish_date": nz.publication_date(F.coalesce(either("出版年", "出版时间"), F.lit(""))),
        "isbn": isbn, "isbn13": nz.isbn13(isbn), "pages": value("页数"), "price": value("定价"), "format": value("装帧"), "language": value("语言"),
        "series": F.coalesce(filled(F.col("raw.series")), value("丛书")), "original_title": value("原作名"), "abstract_note": F.col("raw.abstract"), "cover_url": F.col("raw.cover"),
        "creators": F.col("page_creators"), "creator_notes": F.when(F.size("page_notes") > 0, F.col("page_notes")),
    }
    error = F.when(F.col("raw.info_html").isNull(), "missing-info-block").when(F.col("main_title") == "", "missing-title")
    book = F.struct(*(known.get(n, F.lit(None).cast("string")).alias(n) for n in BOOK_FIELDS))
    out = raw.withColumn("parse_error", error).withColumn("book", F.when(F.col("parse_error").isNull(), book))
    if surfaces:
        out = out.withColumns({"labels": F.transform("raw.entries", lambda e: e["label"]), "surfaces": F.col("raw.surfaces")})
    return out.drop("entries", "by_label", "main_title", "page_creators", "page_notes", "raw")


def split_failures(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rows of the errors table."""
    return parsed.where("parse_error is null").drop("parse_error"), parsed.where("parse_error is not null").select("url", "parse_error")


def readable_text(url: Column, raw: Column, book: Column, most: int = 12_000) -> Column:
    """Labelled lines for a model, cut to ``most`` characters."""
    lines = [
        F.concat(F.lit("Source URL: "), url),
        F.concat(F.lit("Rule metadata: "), F.to_json(book)),
        F.concat(F.lit("Page title: "), js_trim(F.coalesce(raw["page_title"], F.lit("")))),
        F.concat(F.lit("Heading: "), raw["heading"]),
        F.concat(F.lit("Info: "), raw["info_text"]),
        F.concat(F.lit("Intro: "), raw["intro"]),
    ]
    return F.substring(F.concat_ws("\n", *lines), 1, most)


# Markers of pages that ask for a proof or block the reader.
CHALLENGES = ("captcha", "verify you are human", "unusual traffic", "access denied", "sec.example.org", "检测到有异常请求", "请输入验证码")


def is_challenge(html: Column, markers: tuple[str, ...] = CHALLENGES) -> Column:
    low = F.lower(html)
    found = F.lit(False)
    for m in markers:
        found = found | low.contains(m.lower())
    return F.coalesce(found, F.lit(False))


def http_class(code: Column) -> Column:
    return F.when(code.isin(403, 418), "rate-limited").when(code == 404, "not-found").when(code >= 400, "http-error").otherwise("ok")


def raw_record_ids(url: Column) -> Column:
    """``raw-`` and the page's number, or twelve hex digits where it has none."""
    number = subject_id(url)
    return F.concat(F.lit("raw-"), F.when(number != "", number).otherwise(F.substring(F.sha2(url, 256), 1, 12)))


def raw_records(pages: DataFrame, parsed: DataFrame, context: DataFrame, run_id: str) -> DataFrame:
    """Rows of raw_scraped_records: pages with their hash, list context (by canonical url) and extracted metadata."""
    joined = pages.withColumn("__key", F.regexp_replace("url", "#.*\\z", "")).join(context.withColumnRenamed("url", "__key"), "__key", "left")
    books_ = parsed.select("url", F.to_json("book").alias("extracted_metadata_json"), F.to_json("parser_warnings").alias("extraction_warnings_json"))
    record = raw_record_ids(F.col("url"))
    return joined.join(books_, "url", "left").select(
        record.alias("raw_record_id"), F.lit(run_id).alias("scrape_run_id"), record.alias("internal_id"), F.col("url").alias("source_url"), filled(subject_id(F.col("url"))).alias("subject_id"),
        F.col("owner_id").alias("list_owner_id"), F.lit("subject-page").alias("source_kind"), F.col("html").alias("raw_html"), F.sha2("html", 256).alias("raw_html_sha256"),
        F.to_json(F.struct("list_url", "list_title", "position")).alias("list_context_json"), "extracted_metadata_json", "extraction_warnings_json",
    )


