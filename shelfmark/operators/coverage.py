"""Coverage statistics over parsed samples, and the picking of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.creators import role_counts
from ..functions.text import filled, has_text

# Fields whose presence is counted.
FIELDS = ("title", "creators", "publisher", "publish_date", "isbn", "isbn13", "pages", "price", "series", "format", "language", "original_title", "abstract_note", "creator_notes")
SURFACES = ("h1_title", "abstract_block", "json_ld", "open_graph_title", "open_graph_description")


def label_coverage(samples: DataFrame, cohorts: tuple[str, str]) -> DataFrame:
    """samples: subject_id, cohort, labels. One row a label: total, n by cohort; ``label_subjects`` has the subject ids."""
    rows = samples.select("cohort", F.explode(F.array_distinct("labels")).alias("label"))
    return rows.groupBy("label").agg(F.count("*").alias("total"), *(F.count_if(F.col("cohort") == c).alias(c) for c in cohorts))


def label_subjects(samples: DataFrame) -> DataFrame:
    """Rows (label, subject_id), one for each sample with the label; a label on every page stays spread over the tasks."""
    return samples.select(F.explode(F.array_distinct("labels")).alias("label"), "subject_id")


def flag_coverage(samples: DataFrame, flags: dict[str, Column], cohorts: tuple[str, str], name: str) -> DataFrame:
    """Total and n by cohort of each flag, in one pass; flags never set keep a row of zeros."""
    sums = [F.count_if(c & ok).alias(f"{k}__{i}") for k, c in flags.items() for i, ok in enumerate([F.lit(True), *(F.col("cohort") == x for x in cohorts)])]
    one = samples.agg(*sums)
    rows = F.array(*(F.struct(F.lit(k).alias(name), *(F.col(f"{k}__{i}").alias(n) for i, n in enumerate(("total", *cohorts)))) for k in flags))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def field_coverage(samples: DataFrame, cohorts: tuple[str, str]) -> DataFrame:
    present = lambda n: F.coalesce(F.size(f"book.{n}") > 0, F.lit(False)) if n in ("creators", "creator_notes") else has_text(F.col(f"book.{n}"))
    return flag_coverage(samples, {n: present(n) for n in FIELDS}, cohorts, "field")


def surface_coverage(samples: DataFrame, cohorts: tuple[str, str]) -> DataFrame:
    return flag_coverage(samples, {s: F.col(f"surfaces.{s}") for s in SURFACES}, cohorts, "surface").where("total > 0")


def creator_coverage(samples: DataFrame, cohorts: tuple[str, str]) -> DataFrame:
    # outer, then filtered: an inner explode would pull the page helper into a filter
    rows = samples.select("cohort", F.explode_outer(role_counts(F.col("book.creators"))).alias("r")).where("r is not null")
    return rows.groupBy(F.col("r.role").alias("role")).agg(F.count("*").alias("records"), F.sum("r.n").alias("creators"), *(F.count_if(F.col("cohort") == c).alias(f"{c}_records") for c in cohorts))


def validation_coverage(samples: DataFrame, cohorts: tuple[str, str]) -> DataFrame:
    return samples.agg(F.count_if("eligible").alias("eligible"), F.count_if(~F.col("eligible")).alias("ineligible"), *(F.count_if(F.col("eligible") & (F.col("cohort") == c)).alias(f"{c}_eligible") for c in cohorts))


def histogram(samples: DataFrame, column: str) -> DataFrame:
    """How often each value of an array column occurs."""
    # outer, then filtered: a plain explode has a filter inferred that repeats the array's expression below it
    values = samples.select(F.posexplode_outer(column).alias("pos", "value")).where("pos is not null")
    return values.groupBy("value").agg(F.count("*").alias("n"))


def sample_counts(samples: DataFrame, cohorts: tuple[str, str]) -> DataFrame:
    return samples.agg(F.count("*").alias("total"), *(F.count_if(F.col("cohort") == c).alias(c) for c in cohorts), F.count_distinct("subject_id").alias("subjects"))


def repeated_subjects(samples: DataFrame) -> DataFrame:
    return samples.groupBy("subject_id").agg(F.count("*").alias("n")).where("n > 1")


def by_batch(samples: DataFrame) -> DataFrame:
    return samples.groupBy("batch").agg(F.count("*").alias("n"))


def report_rows(samples: DataFrame) -> DataFrame:
    """One row a sample for the coverage report; empty fields are absent."""
    parsed = F.struct(*(filled(F.col(f"book.{n}")).alias(n) for n in ("publisher", "publish_date", "language", "series", "original_title", "pages", "format")))
    notes = F.coalesce("book.creator_notes", F.array().cast("array<string>"))
    return samples.select("subject_id", "batch", "cohort", F.col("book.title").alias("title"), "labels", role_counts(F.col("book.creators")).alias("creator_types"), notes.alias("creator_notes"), "eligible", "gate_warnings", "parser_warnings", parsed.alias("parsed"))


def new_labels(samples: DataFrame, old: str, new: str) -> DataFrame:
    """Labels that only the new cohort has."""
    labels = lambda c: samples.where(F.col("cohort") == c).select(F.explode("labels").alias("label")).distinct()
    return labels(new).join(labels(old), "label", "left_anti")


def outside(candidates: DataFrame, chosen: DataFrame) -> DataFrame:
    return candidates.join(chosen.select("subject_id").distinct(), "subject_id", "left_anti")


def inside(chosen: DataFrame, samples: DataFrame, cohort: str) -> DataFrame:
    return chosen.join(samples.where(F.col("cohort") == cohort).select("subject_id").distinct(), "subject_id", "left_semi")


def _joined(prefix: str, values: Column) -> Column:
    return F.when(F.size(values) > 0, F.concat(F.lit(prefix), F.array_join(values, "|")))


def _reasons(*found: Column) -> Column:
    return F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull()))


def _score(reasons: Column, warnings: Column, rare: Column) -> Column:
    beyond = F.size(F.filter(warnings, lambda w: w != "minimum-ingest-missing-language"))
    points = lambda r: (
        F.when(r.startswith("new-labels:"), 4).when(r.startswith("minimum-ingest:"), 1 + beyond).when(r.startswith("creator-type:editor") | r.startswith("creator-type:contributor"), 3)
        .when(r.startswith("creator-type:translator"), 2).when(r == "creator-notes", 3).when(r == "original-title", 2).otherwise(1)
    )
    return F.aggregate(reasons, F.lit(0), lambda a, r: a + points(r)) + F.size(rare)


def _with_labels(samples: DataFrame, labels: DataFrame, fresh: DataFrame) -> DataFrame:
    """Adds rare (labels with a total of at most two) and fresh labels. The label tables have a row a label and are joined by it."""
    spread = samples.select("subject_id", "batch", F.posexplode("labels").alias("pos", "label"))
    marks = spread.join(labels.select("label", "total"), "label", "left").join(fresh.withColumn("is_new", F.lit(True)), "label", "left")
    per = marks.groupBy("subject_id", "batch").agg(F.array_sort(F.collect_list(F.struct("pos", "label", (F.coalesce("total", F.lit(0)) <= 2).alias("rare"), F.coalesce("is_new", F.lit(False)).alias("fresh")))).alias("m"))
    none = F.array().cast("array<string>")
    pick = lambda flag: F.coalesce(F.transform(F.filter("m", lambda x: x[flag]), lambda x: x["label"]), none)
    return samples.join(per, ["subject_id", "batch"], "left").withColumns({"rare": pick("rare"), "fresh": pick("fresh")}).drop("m")


def _messy_pages(book: Column) -> Column:
    return F.coalesce(book["pages"].rlike("[^0-9\\s]"), F.lit(False))


def golden_candidates(samples: DataFrame, old: str, new: str, most: int = 12) -> DataFrame:
    """Diverse candidates of the new cohort: five tiers in order, inside a tier by score and id."""
    labels = label_coverage(samples, (old, new))
    rows = _with_labels(samples, labels, new_labels(samples, old, new)).where(F.col("cohort") == new)
    book, roles = F.col("book"), role_counts(F.col("book.creators"))
    notes, original, series = F.coalesce(F.size(book["creator_notes"]) > 0, F.lit(False)), F.coalesce(book["original_title"] != "", F.lit(False)), F.coalesce(book["series"] != "", F.lit(False))
    types = F.transform(F.filter(roles, lambda r: r["role"] != "author"), lambda r: F.concat(F.lit("creator-type:"), r["role"], F.lit(":"), r["n"].cast("string")))
    head = F.array(_joined("new-labels:", F.col("fresh")))
    tail = F.array(
        F.when(notes, F.lit("creator-notes")), F.when(original, F.lit("original-title")), F.when(series, F.lit("series")), F.when(_messy_pages(book), F.lit("page-count-text-normalization")),
        F.when(~F.col("eligible"), F.concat(F.lit("minimum-ingest:"), F.array_join("gate_warnings", "|"))), _joined("parser-diagnostics:", F.col("parser_warnings")), _joined("rare-labels:", F.col("rare")),
    )
    out = rows.withColumn("reasons", F.array_distinct(F.filter(F.concat(head, types, tail), lambda x: x.isNotNull()))).where(F.size("reasons") > 0)
    out = out.withColumn("score", _score(F.col("reasons"), F.col("gate_warnings"), F.col("rare")))
    helpers = F.exists(roles, lambda r: r["role"].isin("editor", "contributor"))
    tier = F.when(F.size("fresh") > 0, 1).when(F.exists("gate_warnings", lambda w: w != "minimum-ingest-missing-language"), 2).when(helpers, 3).when(notes, 4).when(original & series, 5).otherwise(6)
    return out.withColumn("tier", tier).orderBy("tier", F.desc("score"), "subject_id").limit(most).select("subject_id", "batch", "tier", "score", "reasons")


def review_candidates(samples: DataFrame, old: str, new: str, most: int = 15) -> DataFrame:
    """Candidates of the cleaning review, by score and id."""
    labels = label_coverage(samples, (old, new))
    rows = _with_labels(samples, labels, new_labels(samples, old, new))
    book, roles = F.col("book"), role_counts(F.col("book.creators"))
    only_language = (F.size("gate_warnings") == 1) & (F.get("gate_warnings", F.lit(0)) == "minimum-ingest-missing-language")
    reasons = _reasons(
        F.when(only_language, F.lit("near-prepared-missing-language")), F.when(~F.col("eligible") & ~only_language, F.concat(F.lit("minimum-ingest-review:"), F.array_join("gate_warnings", "|"))),
        F.when(F.coalesce(book["original_title"] != "", F.lit(False)), F.lit("protect-original-title-note")), F.when(F.coalesce(F.size(book["creator_notes"]) > 0, F.lit(False)), F.lit("protect-creator-note-evidence")),
        F.when(F.exists(roles, lambda r: r["role"].isin("editor", "contributor")), F.lit("creator-role-review")), F.when(F.coalesce(book["series"] != "", F.lit(False)), F.lit("series-field-review")), F.when(_messy_pages(book), F.lit("page-count-cleaning")),
    )
    out = rows.withColumn("reasons", reasons).where(F.size("reasons") > 0).withColumn("score", _score(F.col("reasons"), F.col("gate_warnings"), F.col("rare")))
    return out.orderBy(F.desc("score"), "subject_id").limit(most).select("subject_id", "batch", "score", "reasons")
