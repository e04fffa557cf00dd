"""Types of books, payloads and the pipeline's tables."""

from __future__ import annotations

from pyspark.sql import types as T

CREATOR = T.StructType(
    [
        T.StructField("first_name", T.StringType()),
        T.StructField("last_name", T.StringType()),
        T.StructField("creator_type", T.StringType()),
        T.StructField("field_mode", T.IntegerType()),
        T.StructField("needs_review", T.BooleanType()),
    ]
)
CREATOR_DDL = "struct<first_name:string,last_name:string,creator_type:string,field_mode:int,needs_review:boolean>"
CREATORS = f"array<{CREATOR_DDL}>"

# The text fields of a book, in their order.
STRING_FIELDS = (
    "title", "subtitle", "publisher", "publish_date", "isbn", "isbn13", "pages", "price", "series", "series_number", "volume",
    "number_of_volumes", "edition", "place", "original_date", "original_publisher", "original_place", "format", "doi",
    "citation_key", "accessed", "issn", "archive", "archive_location", "short_title", "language", "call_number", "license",
    "extra", "original_title", "abstract_note", "cover_url",
)
ID_FIELDS = ("book_url", "book_id")
BOOK_FIELDS = (*ID_FIELDS, *STRING_FIELDS, "creators", "creator_notes")

# Payload fields in their order, and the book field each comes from.
PAYLOAD_FIELDS = (
    ("title", "title"), ("abstractNote", "abstract_note"), ("series", "series"), ("seriesNumber", "series_number"), ("volume", "volume"),
    ("numberOfVolumes", "number_of_volumes"), ("edition", "edition"), ("date", "publish_date"), ("publisher", "publisher"), ("place", "place"),
    ("originalDate", "original_date"), ("originalPublisher", "original_publisher"), ("originalPlace", "original_place"), ("format", "format"),
    ("numPages", "pages"), ("ISBN", None), ("DOI", "doi"), ("citationKey", "citation_key"), ("url", "book_url"), ("accessDate", "accessed"),
    ("ISSN", "issn"), ("archive", "archive"), ("archiveLocation", "archive_location"), ("shortTitle", "short_title"), ("language", "language"),
    ("libraryCatalog", None), ("callNumber", "call_number"), ("rights", "license"), ("extra", "extra"),
)

BOOK = T.StructType(
    [T.StructField(n, T.StringType()) for n in (*ID_FIELDS, *STRING_FIELDS)]
    + [T.StructField("creators", T.ArrayType(CREATOR)), T.StructField("creator_notes", T.ArrayType(T.StringType()))]
)
RAW_PAGE = T.StructType([T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])


def _strings(names: str, **other: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, other.get(n, T.StringType())) for n in names.split()])


# The nine tables and their columns.
TABLES = {
    "pipeline_runs": _strings("run_id execution_mode status source input_manifest_path started_at completed_at notes_json"),
    "scrape_runs": _strings("scrape_run_id pipeline_run_id execution_mode source_kind fixture_manifest_path request_count started_at completed_at provenance_json", request_count=T.IntegerType()),
    "raw_scraped_records": _strings("raw_record_id scrape_run_id internal_id source_url subject_id list_owner_id source_kind raw_html raw_html_sha256 list_context_json extracted_metadata_json extraction_warnings_json provenance_json created_at"),
    "cleaning_runs": _strings("cleaning_run_id pipeline_run_id execution_mode cleaner_kind provider model prompt_template_hash settings_json started_at completed_at"),
    "cleaned_records": _strings("cleaned_record_id cleaning_run_id raw_record_id internal_id cleaned_json validation_status validation_warnings_json field_provenance_json confidence_json created_at"),
    "export_runs": _strings("export_run_id pipeline_run_id format target started_at completed_at settings_json"),
    "export_records": _strings("export_record_id export_run_id cleaned_record_id internal_id format payload_text payload_json validation_status validation_warnings_json created_at"),
    "import_runs": _strings("import_run_id pipeline_run_id execution_mode target status started_at completed_at settings_json"),
    "import_records": _strings("import_record_id import_run_id cleaned_record_id export_record_id internal_id item_id item_payload_json status validation_warnings_json created_at"),
}
PRIMARY = {"pipeline_runs": "run_id", "scrape_runs": "scrape_run_id", "raw_scraped_records": "raw_record_id", "cleaning_runs": "cleaning_run_id", "cleaned_records": "cleaned_record_id", "export_runs": "export_run_id", "export_records": "export_record_id", "import_runs": "import_run_id", "import_records": "import_record_id"}
#: The run that a table's rows belong to, by which it is partitioned.
RUN_OF = {"pipeline_runs": "run_id", "scrape_runs": "pipeline_run_id", "raw_scraped_records": "scrape_run_id", "cleaning_runs": "pipeline_run_id", "cleaned_records": "cleaning_run_id", "export_runs": "pipeline_run_id", "export_records": "export_run_id", "import_runs": "pipeline_run_id", "import_records": "import_run_id"}
UNIQUE = (("raw_scraped_records", ("internal_id",)), ("cleaned_records", ("internal_id",)), ("export_records", ("export_run_id", "cleaned_record_id", "format")), ("import_records", ("import_run_id", "cleaned_record_id")))
FOREIGN = (
    ("scrape_runs", "pipeline_run_id", "pipeline_runs", "run_id"), ("raw_scraped_records", "scrape_run_id", "scrape_runs", "scrape_run_id"),
    ("cleaning_runs", "pipeline_run_id", "pipeline_runs", "run_id"), ("cleaned_records", "cleaning_run_id", "cleaning_runs", "cleaning_run_id"),
    ("cleaned_records", "raw_record_id", "raw_scraped_records", "raw_record_id"), ("export_runs", "pipeline_run_id", "pipeline_runs", "run_id"),
    ("export_records", "export_run_id", "export_runs", "export_run_id"), ("export_records", "cleaned_record_id", "cleaned_records", "cleaned_record_id"),
    ("import_runs", "pipeline_run_id", "pipeline_runs", "run_id"), ("import_records", "import_run_id", "import_runs", "import_run_id"),
    ("import_records", "cleaned_record_id", "cleaned_records", "cleaned_record_id"), ("import_records", "export_record_id", "export_records", "export_record_id"),
)
