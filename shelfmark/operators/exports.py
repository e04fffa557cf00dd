"""Records as catalog payloads, bibliography entries, item rows and table rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.creators import display_names
from ..functions.text import bib_field, filled, has_text, js_trim
from ..schemas import PAYLOAD_FIELDS
from ..site import SITE, Site
from .validate import FORMATS, import_status, payload_warnings

_NOTES = "array<struct<note:string,source:string>>"


def payload(book: Column, site: Site = SITE) -> Column:
    """Nested catalog payload; absent fields are empty."""
    own = {"ISBN": F.coalesce(filled(book["isbn13"]), book["isbn"]), "libraryCatalog": F.lit(site.catalog)}
    fields = F.struct(*(F.coalesce(own[n] if source is None else book[source], F.lit("")).alias(n) for n, source in PAYLOAD_FIELDS))
    note = lambda text, source: F.struct(text.alias("note"), F.lit(source).alias("source"))
    title = F.when(F.coalesce(book["original_title"], F.lit("")) != "", F.array(note(F.concat(F.lit("Original title: "), book["original_title"]), "original-title")))
    people = F.transform(book["creator_notes"], lambda n: note(F.concat(F.lit("Creator note: "), n), "creator-note"))
    none = F.array().cast(_NOTES)
    return F.struct(
        F.lit("book").alias("itemType"), fields.alias("fields"), book["creators"].alias("creators"),
        F.concat(F.coalesce(title, none), F.coalesce(people, none)).alias("notes"), F.array().cast("array<string>").alias("attachments"),
    )


def _entry(book: Column, lines: list[Column], site: Site) -> Column:
    return F.concat(F.lit(f"@book{{{site.key_prefix}-"), book["book_id"], F.lit(",\n"), F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), ",\n"), F.lit("\n}"))


def _people(book: Column, role: str) -> Column:
    return F.array_join(display_names(book["creators"], role), " and ")


def bibtex(book: Column, site: Site = SITE) -> Column:
    translators, original = _people(book, "translator"), F.coalesce(book["original_title"], F.lit(""))
    note = F.concat_ws("; ", F.when(translators != "", F.concat(F.lit("Translator: "), translators)), F.when(original != "", F.concat(F.lit("Original title: "), original)))
    return _entry(
        book,
        [
            bib_field("title", book["title"]), bib_field("author", _people(book, "author")), bib_field("editor", _people(book, "editor")), bib_field("publisher", book["publisher"]),
            bib_field("year", F.regexp_extract(book["publish_date"], "[0-9]{4}", 0)), bib_field("isbn", F.coalesce(filled(book["isbn13"]), book["isbn"])), bib_field("pages", book["pages"]),
            bib_field("series", book["series"]), bib_field("url", book["book_url"]), bib_field("abstract", book["abstract_note"]), bib_field("note", note),
        ],
        site,
    )


def biblatex(book: Column, site: Site = SITE) -> Column:
    return _entry(
        book,
        [
            bib_field("title", book["title"]), *(bib_field(r, _people(book, r)) for r in ("author", "translator", "editor")), bib_field("publisher", book["publisher"]), bib_field("date", book["publish_date"]),
            bib_field("isbn", F.coalesce(filled(book["isbn13"]), book["isbn"])), bib_field("pagetotal", book["pages"]), bib_field("series", book["series"]), bib_field("number", book["series_number"]),
            bib_field("url", book["book_url"]), bib_field("abstract", book["abstract_note"]),
        ],
        site,
    )


def short_entry(book: Column, biblatex_style: bool, site: Site = SITE) -> Column:
    """The live capture's form: title, authors, publisher, date or year, isbn, url."""
    date = bib_field("date", book["publish_date"]) if biblatex_style else bib_field("year", F.regexp_extract(book["publish_date"], "[0-9]{4}", 0))
    return _entry(book, [bib_field("title", book["title"]), bib_field("author", _people(book, "author")), bib_field("publisher", book["publisher"]), date, bib_field("isbn", F.coalesce(filled(book["isbn13"]), book["isbn"])), bib_field("url", book["book_url"])], site)


def export_records(cleaned: DataFrame, site: Site = SITE) -> DataFrame:
    """Three rows a record in one pass. cleaned: cleaned_record_id, book, status, warnings."""
    rows = cleaned.withColumn("payload", payload(F.col("book"), site))
    made = F.array(
        F.struct(F.lit(FORMATS[0]).alias("format"), F.lit(None).cast("string").alias("payload_text"), F.to_json("payload").alias("payload_json")),
        F.struct(F.lit(FORMATS[1]).alias("format"), bibtex(F.col("book"), site).alias("payload_text"), F.lit(None).cast("string").alias("payload_json")),
        F.struct(F.lit(FORMATS[2]).alias("format"), biblatex(F.col("book"), site).alias("payload_text"), F.lit(None).cast("string").alias("payload_json")),
    )
    out = rows.select("cleaned_record_id", F.explode(made).alias("e"), F.col("status").alias("validation_status"), F.to_json("warnings").alias("validation_warnings_json"))
    key = F.concat(F.lit("export-"), F.col("e.format"), F.lit("-"), F.regexp_replace("cleaned_record_id", "^cleaned-", ""))
    return out.select(key.alias("export_record_id"), "cleaned_record_id", key.alias("internal_id"), "e.format", "e.payload_text", "e.payload_json", "validation_status", "validation_warnings_json")


def import_records(cleaned: DataFrame, site: Site = SITE) -> DataFrame:
    """One prepared or skipped row a record, with the record's and the payload's warnings."""
    rows = cleaned.withColumn("payload", payload(F.col("book"), site)).withColumn("payload_warnings", payload_warnings(F.col("payload"), site))
    tail = F.regexp_replace("cleaned_record_id", "^cleaned-", "")
    return rows.select(
        F.concat(F.lit(f"import-{FORMATS[0]}-"), tail).alias("import_record_id"), "cleaned_record_id", F.concat(F.lit(f"export-{FORMATS[0]}-"), tail).alias("export_record_id"),
        F.to_json("payload").alias("item_payload_json"), import_status(F.col("eligible")).alias("status"), F.concat("warnings", "payload_warnings").alias("warnings"), "payload_warnings",
    )


def inspection_note(payload_: Column, lines: dict[str, Column], heading: str = "Inspection") -> Column:
    """The payload with one more note of labelled lines."""
    text = F.concat_ws("\n", F.lit(heading), *(F.concat(F.lit(f"{k}: "), F.coalesce(v, F.lit(""))) for k, v in lines.items()))
    return payload_.withField("notes", F.concat(payload_["notes"], F.array(F.struct(text.alias("note"), F.lit("inspection").alias("source")))))


def item_fields(payloads: DataFrame, key: str = "id") -> DataFrame:
    """Field rows (key, field, value) that are not empty; title and catalog always."""
    fields = F.array(*(F.struct(F.lit(n).alias("field"), F.col(f"payload.fields.{n}").alias("value")) for n, _ in PAYLOAD_FIELDS))
    rows = payloads.select(key, F.explode(fields).alias("f")).select(key, "f.field", "f.value")
    return rows.where((F.col("value") != "") | F.col("field").isin("title", "libraryCatalog"))


def item_notes(payloads: DataFrame, key: str = "id") -> DataFrame:
    return payloads.select(key, F.posexplode("payload.notes").alias("pos", "n")).select(key, "pos", js_trim(F.col("n.note")).alias("note")).where(has_text(F.col("note")))


def _readlist_keys() -> list[Column]:
    return [F.asc_nulls_last("position"), F.asc_nulls_last(F.col("subject_id").try_cast("long")), F.asc("raw_record_id")]


def readlist_order(rows: DataFrame, most: int | None = None) -> DataFrame:
    """By position (missing last), subject number, record; the first ``most`` if given."""
    ordered = rows.orderBy(*_readlist_keys())
    return ordered if most is None else ordered.limit(most)


def readlist_places(rows: DataFrame, most: int) -> DataFrame:
    """The first ``most`` in that order, with their ``place`` from 1: an order that survives writing and joining."""
    return readlist_order(rows, most).withColumn("place", F.row_number().over(Window.orderBy(*_readlist_keys())))


def inspection_export(cleaned: DataFrame, raw: DataFrame, run_id: str, most: int | None = None, site: Site = SITE) -> DataFrame:
    """Payloads of one cleaning run with list context and an inspection note, in list order."""
    rows = cleaned.where(F.col("cleaning_run_id") == run_id).join(raw.select("raw_record_id", "source_url", "subject_id", F.get_json_object("list_context_json", "$.position").try_cast("int").alias("position")), "raw_record_id")
    noted = rows.withColumn("payload", inspection_note(payload(F.col("book"), site), {"record": F.col("cleaned_record_id"), "source": F.col("source_url"), "status": F.col("status"), "warnings": F.array_join("warnings", ", ")}))
    return readlist_order(noted, most).select("raw_record_id", "cleaned_record_id", "position", "payload")
