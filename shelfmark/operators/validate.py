"""Quality gate, payload checks, table constraints and pipeline audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as nz
from ..functions.text import has_text, js_trim
from ..schemas import FOREIGN, PAYLOAD_FIELDS, PRIMARY, UNIQUE
from ..site import SITE, Site


def _only(*found: Column) -> Column:
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def gate(book: Column) -> Column:
    """Struct (eligible, warnings, missing_fields) of the minimum that a record needs."""
    named = F.coalesce(F.exists(book["creators"], lambda c: c["creator_type"].isin("author", "editor") & (has_text(c["first_name"]) | has_text(c["last_name"]))), F.lit(False))
    lang = book["language"]
    lacks = [("title", "title", ~has_text(book["title"])), ("creator", "author-or-editor", ~named), ("date", "date", ~has_text(book["publish_date"])), ("publisher", "publisher", ~has_text(book["publisher"])), ("language", "language", ~has_text(lang))]
    unsupported = F.when(has_text(lang) & nz.language(lang).isNull(), F.concat(F.lit("minimum-ingest-unsupported-language-"), js_trim(lang)))
    warnings = _only(*(F.when(c, F.lit(f"minimum-ingest-missing-{w}")) for _, w, c in lacks), unsupported)
    return F.struct((F.size(warnings) == 0).alias("eligible"), warnings.alias("warnings"), _only(*(F.when(c, F.lit(n)) for n, _, c in lacks)).alias("missing_fields"))


def record_warnings(book: Column, gate_warnings: Column, ordered: bool = False) -> Column:
    """The gate's warnings and ``missing-isbn``; ``ordered`` sorts them and keeps each once."""
    none = (F.coalesce(book["isbn"], F.lit("")) == "") & (F.coalesce(book["isbn13"], F.lit("")) == "")
    every = F.concat(gate_warnings, F.when(none, F.array(F.lit("missing-isbn"))).otherwise(F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(every)) if ordered else every


def language_warnings(book: Column, warnings: Column) -> Column:
    """Variant of the inspection exports: a missing language counts as its own warning."""
    return F.when(has_text(book["language"]), warnings).otherwise(F.array_union(warnings, F.array(F.lit("missing-language"))))


def status(eligible: Column, warnings: Column) -> Column:
    return F.when(~eligible, "invalid").when(F.size(warnings) > 0, "warning").otherwise("valid")


def parser_warnings(gate_warnings: Column) -> Column:
    """Those of the gate that a page itself can explain."""
    pick = "^minimum-ingest-(missing-author-or-editor|missing-language|unsupported-language-.*)\\z"
    return F.transform(F.filter(gate_warnings, lambda w: w.rlike(f"(?s){pick}")), lambda w: F.regexp_replace(w, "^minimum-ingest-", "parser-"))


def with_validation(books: DataFrame, book: str = "book") -> DataFrame:
    """Columns eligible, gate_warnings, missing_fields, warnings, status, parser_warnings."""
    out = books.withColumn("__gate", gate(F.col(book)))
    out = out.withColumns({"eligible": F.col("__gate.eligible"), "gate_warnings": F.col("__gate.warnings"), "missing_fields": F.col("__gate.missing_fields")})
    out = out.withColumn("warnings", record_warnings(F.col(book), F.col("gate_warnings")))
    return out.withColumns({"status": status(F.col("eligible"), F.col("warnings")), "parser_warnings": parser_warnings(F.col("gate_warnings"))}).drop("__gate")


def payload_warnings(payload: Column, site: Site = SITE) -> Column:
    """Warnings of a typed payload; a null payload is not an object."""
    fields, creators = payload["fields"], payload["creators"]
    per = F.flatten(
        F.transform(
            creators,
            lambda c, i: F.when(c.isNull(), F.array(F.concat(F.lit("creator-"), i.cast("string"), F.lit("-not-object")))).otherwise(
                _only(
                    F.when(~has_text(c["creator_type"]), F.concat(F.lit("creator-"), i.cast("string"), F.lit("-missing-type"))),
                    F.when(~F.coalesce(c["field_mode"].isin(0, 1), F.lit(False)), F.concat(F.lit("creator-"), i.cast("string"), F.lit("-invalid-field-mode"))),
                    F.when(~has_text(c["last_name"]) & ~has_text(c["first_name"]), F.concat(F.lit("creator-"), i.cast("string"), F.lit("-missing-name"))),
                )
            ),
        )
    )
    none = F.array().cast("array<string>")
    inside = _only(
        *(F.when(fields[n].isNull(), F.lit(f"missing-standard-field-{n}")) for n, _ in PAYLOAD_FIELDS),
        F.when(~has_text(fields["title"]), F.lit("missing-title")),
        F.when(~has_text(fields["url"]), F.lit("missing-url")),
        F.when(~F.coalesce(fields["libraryCatalog"] == site.catalog, F.lit(False)), F.lit("libraryCatalog-not-site")),
    )
    every = F.concat(
        F.when(F.coalesce(payload["itemType"] == "book", F.lit(False)), none).otherwise(F.array(F.lit("itemType-not-book"))),
        F.when(fields.isNull(), F.array(F.lit("missing-fields"))).otherwise(inside),
        F.when(creators.isNull(), F.array(F.lit("creators-not-array"))).otherwise(F.coalesce(per, none)),
        _only(F.when(payload["notes"].isNull(), F.lit("notes-not-array")), F.when(payload["attachments"].isNull(), F.lit("attachments-not-array"))),
    )
    return F.when(payload.isNull(), F.array(F.lit("payload-not-object"))).otherwise(every)


def import_status(eligible: Column) -> Column:
    return F.when(eligible, "prepared").otherwise("skipped")


def write_errors(books: DataFrame, book: str = "book") -> DataFrame:
    """Rows that a write refuses: key columns and ``error``."""
    checked = with_validation(books, book).where(~F.col("eligible"))
    return checked.withColumn("error", F.concat(F.lit('"'), F.col(f"{book}.title"), F.lit('": Incomplete metadata: '), F.array_join("gate_warnings", ", ")))


def _violation(df: DataFrame, rule: str | Column, key: Column, severity: str = "error") -> DataFrame:
    return df.select((F.lit(rule) if isinstance(rule, str) else rule).alias("rule"), key.cast("string").alias("key"), F.lit(severity).alias("severity"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


FORMATS = ("catalog-json", "bibtex", "biblatex")
COLLECTION = "\\S+ \\S+ [0-9]{8}-[0-9]{6}\\z"


def audit_pipeline(export_records: DataFrame, pipeline_runs: DataFrame, import_runs: DataFrame, import_records: DataFrame, site: Site = SITE, mode: str = "dry-run") -> DataFrame:
    """Violations (rule, key, severity) of a finished pipeline. import_records: with ``warnings`` (array) and ``payload_warnings`` (array)."""
    spark = export_records.sparkSession
    wanted = spark.createDataFrame([(f,) for f in FORMATS], "format string")
    minimum = F.exists("warnings", lambda w: w.startswith("minimum-ingest-"))
    empty = lambda df, rule: df.agg(F.count("*").alias("n")).where("n = 0").transform(lambda d: _violation(d, rule, F.lit("")))
    return _all(
        [
            _violation(wanted.join(export_records.select("format").distinct(), "format", "left_anti"), "missing-export-format", F.col("format")),
            empty(pipeline_runs, "pipeline-runs-empty"),
            _violation(pipeline_runs.where(F.col("execution_mode") != mode), "run-not-in-mode", F.col("run_id")),
            empty(import_records, "import-records-empty"),
            empty(import_runs, "import-runs-empty"),
            _violation(import_runs.where(~F.coalesce(F.get_json_object("settings_json", "$.targetCollectionName").rlike(f"^{site.collection_prefix} {COLLECTION}"), F.lit(False))), "collection-name", F.col("import_run_id")),
            _violation(import_records.where((F.col("status") == "prepared") & minimum), "prepared-with-minimum-warning", F.col("import_record_id")),
            _violation(import_records.where((F.col("status") == "skipped") & ~minimum), "skipped-without-minimum-warning", F.col("import_record_id")),
            _violation(import_records.where(F.size("payload_warnings") > 0), "invalid-payload", F.col("import_record_id")),
        ]
    )


def write_ready(import_records: DataFrame, import_runs: DataFrame, site: Site = SITE) -> DataFrame:
    """Violations that keep prepared records from being written: several runs, minimum warnings, invalid payloads, names."""
    rows = import_records.where("status = 'prepared'")
    runs = rows.agg(F.count_distinct("import_run_id").alias("n")).where("n <> 1")
    used = import_runs.join(rows.select("import_run_id").distinct(), "import_run_id", "left_semi")
    return _all(
        [
            _violation(runs, "not-one-run", F.col("n")),
            _violation(rows.where(F.exists("warnings", lambda w: w.startswith("minimum-ingest-"))), "minimum-warning", F.col("import_record_id")),
            _violation(rows.where(F.size("payload_warnings") > 0), "invalid-payload", F.col("import_record_id")),
            _violation(used.where(~F.coalesce(F.get_json_object("settings_json", "$.targetCollectionName").rlike(f"^{site.collection_prefix} {COLLECTION}"), F.lit(False))), "collection-name", F.col("import_run_id")),
        ]
    )


# Allowed values of the tables' enumerations.
ENUMS = (
    ("pipeline_runs", "execution_mode", ("dry-run", "live", "fixture")),
    ("cleaned_records", "validation_status", ("valid", "warning", "invalid")),
    ("export_records", "format", FORMATS),
    ("import_records", "status", ("prepared", "skipped", "imported", "failed")),
)


def duplicate_keys(df: DataFrame, keys: tuple[str, ...], rule: str) -> DataFrame:
    found = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return _violation(found, rule, F.concat_ws("|", *(F.col(k).cast("string") for k in keys)))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str, rule: str) -> DataFrame:
    refs = child.where(F.col(key).isNotNull()).select(F.col(key).alias("__k")).distinct()
    return _violation(refs.join(parent.select(F.col(parent_key).alias("__k")), "__k", "left_anti"), rule, F.col("__k"))


def check_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Violations (rule, key, severity) of keys, references, enumerations and counts among the tables given, each key once a rule.

    One pass: each table is read once and gives a row for each of its keys and references (rule, key, and whether it is one that
    must be unique, one that others refer to, one that refers, or a wrong value). One shuffle brings the sides of a rule together. Counts are
    combined before it, so a key that many rows refer to is one row of each task.
    """
    roles: dict[str, list[tuple[str, Column, Column]]] = {t: [] for t in tables}
    text = lambda *ks: F.concat_ws("|", *(F.col(k).cast("string") for k in ks))
    always = F.lit(True)
    for t, k in PRIMARY.items():
        if t in tables:
            roles[t].append((f"primary:{t}", text(k), "own", always))
    for t, ks in UNIQUE:
        if t in tables:
            roles[t].append((f"unique:{t}", text(*ks), "own", always))
    for c, k, p, pk in FOREIGN:
        if c in tables and p in tables:
            roles[c].append((f"foreign:{c}.{k}", F.col(k), "refers", F.col(k).isNotNull()))
            roles[p].append((f"foreign:{c}.{k}", F.col(pk), "named", F.col(pk).isNotNull()))
    for t, c, vs in ENUMS:
        if t in tables:
            roles[t].append((f"enum:{t}.{c}", F.col(PRIMARY[t]), "wrong", ~F.col(c).isin(*vs)))
    if "scrape_runs" in tables:
        roles["scrape_runs"].append(("negative:scrape_runs.request_count", F.col("scrape_run_id"), "wrong", F.col("request_count") < 0))
    parts = []
    for t, rules in roles.items():
        rows = F.array(*(F.when(F.coalesce(where, F.lit(False)), F.struct(F.lit(rule).alias("rule"), key.cast("string").alias("key"), F.lit(role).alias("role"))) for rule, key, role, where in rules))
        parts.append(tables[t].select(F.explode(rows).alias("r")).where("r is not null").select("r.*"))
    count = {role: F.count_if(F.col("role") == role) for role in ("own", "refers", "named", "wrong")}
    sides = _all(parts).groupBy("rule", "key").agg(*(c.alias(role) for role, c in count.items()))
    return _violation(sides.where("own > 1 or wrong > 0 or (refers > 0 and named = 0)"), F.col("rule"), F.col("key"))


def reconcile(items: DataFrame, payloads: DataFrame) -> DataFrame:
    """Differences of written items from payloads (both: id, fields struct, creators, notes; items with ``collections``; payloads with ``collection``)."""
    both = payloads.alias("p").join(items.alias("i"), "id", "left")
    p, i = F.col("p.fields"), F.col("i.fields")
    key = lambda c: F.coalesce(nz.isbn13(c), nz.clean_isbn(c))
    differs = [F.when(~(key(p[n]).eqNullSafe(key(i[n])) if n == "ISBN" else F.coalesce(p[n], F.lit("")).eqNullSafe(F.coalesce(i[n], F.lit("")))), F.lit(f"field-{n}")) for n, _ in PAYLOAD_FIELDS]
    notes = lambda c: F.transform(c, lambda n: js_trim(n["note"]))
    found = _only(
        *differs,
        F.when(~F.col("p.creators").eqNullSafe(F.col("i.creators")), F.lit("creators")),
        F.when((F.size(F.array_except(notes(F.col("p.notes")), notes(F.col("i.notes")))) > 0) | (F.size("p.notes") != F.size("i.notes")), F.lit("notes")),
        F.when(~F.coalesce(F.array_contains(F.col("i.collections"), F.col("p.collection")), F.lit(False)), F.lit("collection")),
    )
    return both.select("id", F.when(i.isNull(), F.array(F.lit("missing-item"))).otherwise(found).alias("differences"))
