"""Model-proposed records: requests, responses, merge policy, diff, provenance, review and promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as nz
from ..functions.text import candidate_id, js_trim
from ..schemas import BOOK_FIELDS, CREATOR_DDL, ID_FIELDS, STRING_FIELDS
from ..site import SITE, Site
from ..sources.store import stage
from . import exports, pages, validate

# Field groups of the merge policy.
REQUIRED = ("title", "publisher", "publish_date")
PROTECTED = ("book_url", "book_id", "title", "subtitle", "creators", "publisher", "publish_date", "isbn", "isbn13")
HIGH_RISK = ("title", "subtitle", "creators", "publisher", "publish_date", "isbn", "isbn13")
MINIMUM = ("title", "creators", "publisher", "publish_date", "language")
ROLES = ("author", "translator", "editor", "contributor", "seriesEditor")


def camel(name: str) -> str:
    """Book fields in model JSON: ``publish_date`` is ``publishDate``."""
    head, *rest = name.split("_")
    return head + "".join(w.capitalize() for w in rest)


def variant_string(v: Column, path: str) -> Column:
    """Trimmed text at a path of a variant; null unless it is a JSON string."""
    part = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(part) == "STRING", js_trim(F.try_variant_get(v, path, "string")))


def json_object(text: Column) -> Column:
    """The variant between the first ``{`` and the last ``}``; null if there is none or it does not parse."""
    start, end = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
    inside = F.when((start > 0) & (F.instr(text, "}") > 0) & (end >= start), F.substr(text, start, end - start + 1))
    return F.try_parse_json(inside)


def _parts(v: Column, path: str) -> Column:
    """Elements of a JSON array as variants; null unless it is one."""
    part = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(part).startswith("ARRAY"), F.try_variant_get(v, path, "array<variant>"))


def clean_strings(v: Column, path: str) -> Column:
    """Texts of an array, trimmed, without empty ones; null unless it is an array."""
    return F.filter(F.transform(_parts(v, path), lambda x: variant_string(x, "$")), lambda s: s.isNotNull() & (s != ""))


def clean_creators(v: Column, path: str = "$.creators") -> Column:
    """Creators with a known role and a name; null if none is left."""

    def one(x: Column) -> Column:
        first, last = (F.coalesce(variant_string(x, f"$.{n}"), F.lit("")) for n in ("firstName", "lastName"))
        mode = F.when(F.try_variant_get(x, "$.fieldMode", "double") == 1, 1).otherwise(0)
        review = F.when(F.schema_of_variant(F.try_variant_get(x, "$.needsReview", "variant")) == "BOOLEAN", F.try_variant_get(x, "$.needsReview", "boolean"))
        return F.struct(first.alias("first_name"), last.alias("last_name"), variant_string(x, "$.creatorType").alias("creator_type"), mode.alias("field_mode"), F.when(review, F.lit(True)).alias("needs_review"))

    kept = F.filter(F.transform(_parts(v, path), one), lambda c: F.coalesce(c["creator_type"].isin(*ROLES), F.lit(False)) & ((c["first_name"] != "") | (c["last_name"] != "")))
    return F.when(F.size(kept) > 0, kept).cast(f"array<{CREATOR_DDL}>")


def merge_model(rule: Column, model: Column) -> Column:
    """The book that a model's variant proposes over the rule's book. Ids stay the rule's."""

    def text(n: str) -> Column:
        new = variant_string(model, f"$.{camel(n)}")
        if n == "language":
            new = nz.language(new)
        elif n in REQUIRED:
            new = F.when(new != "", new)
        return F.coalesce(new, rule[n])

    return F.struct(
        *(rule[n].alias(n) for n in ID_FIELDS), *(text(n).alias(n) for n in STRING_FIELDS),
        F.coalesce(clean_creators(model), rule["creators"]).alias("creators"), F.coalesce(clean_strings(model, "$.creatorNotes"), rule["creator_notes"]).alias("creator_notes"),
    )


def changed_fields(a: Column, b: Column, fields: tuple[str, ...] = BOOK_FIELDS) -> Column:
    """Names of fields that differ, sorted; null equals null and differs from the empty text."""
    return F.array_sort(F.filter(F.array(*(F.when(~a[n].eqNullSafe(b[n]), F.lit(n)) for n in fields)), lambda x: x.isNotNull()))


def restrict(rule: Column, merged: Column) -> Column:
    """Struct (book, rejected): protected fields go back to the rule's values."""
    book = F.struct(*((rule if n in PROTECTED else merged)[n].alias(n) for n in BOOK_FIELDS))
    return F.struct(book.alias("book"), changed_fields(rule, merged, PROTECTED).alias("rejected"))


def among(fields: Column, group: tuple[str, ...]) -> Column:
    """The fields of a group, in order."""
    return F.filter(fields, lambda x: x.isin(*group))


def _present(rule: Column, book: Column, value) -> Column:
    """Map of the fields that either record has."""
    pairs = F.filter(F.array(*(F.struct(F.lit(n).alias("key"), F.when(rule[n].isNotNull() | book[n].isNotNull(), value(n)).alias("value")) for n in BOOK_FIELDS)), lambda p: p["value"].isNotNull())
    return F.map_from_entries(pairs)


def provenance(rule: Column, book: Column) -> Column:
    """Field to ``rule-cleaned`` or ``llm-cleaned``; ids are always the rule's."""
    return _present(rule, book, lambda n: F.lit("rule-cleaned") if n in ID_FIELDS else F.when(rule[n].eqNullSafe(book[n]), "rule-cleaned").otherwise("llm-cleaned"))


def constant_provenance(book: Column, source: str) -> Column:
    return _present(book, book, lambda n: F.lit(source))


def confidence(rule: Column, book: Column) -> Column:
    return _present(rule, book, lambda n: F.when(rule[n].eqNullSafe(book[n]), 0.9).otherwise(0.7))


def replay(parsed: Column, stored: Column) -> Column:
    """A newly parsed book with the stored model's language where the parser has none. Struct (book, preserved)."""
    own = F.when(js_trim(F.coalesce(parsed["language"], F.lit(""))) == "", nz.language(stored["language"]))
    return F.struct(parsed.withField("language", F.coalesce(own, parsed["language"])).alias("book"), own.isNotNull().alias("preserved"))


def replay_pages(rows: DataFrame, site: Site = SITE) -> DataFrame:
    """Stored pages (url, raw_html, stored: the model's record) parsed again: book, preserved, and validation. Pages that fail are left out."""
    good, _ = pages.split_failures(pages.books(rows, site, "raw_html"))
    made = good.withColumn("__r", replay(F.col("book"), F.col("stored"))).withColumns({"book": F.col("__r.book"), "preserved": F.col("__r.preserved")})
    return validate.with_validation(made.drop("__r", "stored"))


PROMPT = "Clean the metadata of one book page. Answer with one JSON object. Leave a field out when the page does not prove it."


def requests(rows: DataFrame, policy: str = "unrestricted", prompt: str = PROMPT) -> DataFrame:
    """The batch input of an external model: key, system prompt, JSON payload and the template's hash. rows: key, book, readable."""
    body = F.to_json(F.struct(F.col("book").alias("ruleMetadata"), F.col("readable").alias("readableText"), F.lit(policy).alias("policy")))
    return rows.select("key", F.lit(prompt).alias("system_prompt"), body.alias("user_payload"), F.sha2(F.concat(F.lit(prompt), F.lit("\n"), F.lit(policy)), 256).alias("template_hash"))


def responses(rows: DataFrame) -> DataFrame:
    """Rows (key, status, body) to ``model`` (variant) or ``error``, with ok."""
    content = F.get_json_object("body", "$.choices[0].message.content")
    out = rows.withColumn("content", content).withColumn("model", json_object(F.col("content")))
    error = (
        F.when(F.col("status").isin(403, 418, 429), "rate-limited").when((F.col("status") < 200) | (F.col("status") >= 300), "http-error").when(F.coalesce("content", F.lit("")) == "", "no-content")
        .when(F.col("model").isNull() | (F.instr("content", "{") == 0), "bad-json")
    )
    return out.withColumn("error", error).withColumns({"ok": F.col("error").isNull(), "model": F.when(F.col("error").isNull(), F.col("model"))}).drop("content")


def answered(rows: DataFrame) -> DataFrame:
    """The rows of ``responses`` that are ok."""
    # outer, then filtered: a plain filter would be pushed down to the table and repeat the parsing of the answer
    one = F.when(F.col("ok"), F.array(F.struct(*rows.columns)))
    return rows.select(F.explode_outer(one).alias("r")).where("r is not null").select("r.*")


def request_log(rows: DataFrame) -> DataFrame:
    """Requests and failures by kind and status. rows: kind, status, ok."""
    return rows.groupBy("kind", "status").agg(F.count("*").alias("requests"), F.count_if(~F.col("ok")).alias("failures"))


def clean_rows(rules: DataFrame, answers: DataFrame, key: str = "raw_record_id") -> DataFrame:
    """Rule rows (key, book) with answers (key, model): merged book, changes, provenance, confidence and validation."""
    both = rules.withColumnRenamed("book", "rule").join(answers.select(key, "model"), key)
    out = both.withColumn("book", merge_model(F.col("rule"), F.col("model"))).drop("model")
    out = out.withColumns({"changed": changed_fields(F.col("rule"), F.col("book")), "field_provenance": provenance(F.col("rule"), F.col("book")), "confidence": confidence(F.col("rule"), F.col("book"))})
    return validate.with_validation(out)


def compare_modes(rows: DataFrame) -> DataFrame:
    """Rows (key, mode, rule, merged) with accepted and rejected changes by mode (``restricted`` or not), their kinds and validation."""
    limited = F.col("mode") == "restricted"
    out = rows.withColumn("r", restrict(F.col("rule"), F.col("merged"))).withColumn("book", F.when(limited, F.col("r.book")).otherwise(F.col("merged")))
    out = out.withColumns({"rejected": F.when(limited, F.col("r.rejected")).otherwise(F.array().cast("array<string>")), "accepted": changed_fields(F.col("rule"), F.col("book"))}).drop("r")
    return validate.with_validation(out.withColumns({"high_risk": among(F.col("accepted"), HIGH_RISK), "minimum": among(F.col("accepted"), MINIMUM)}))


def mode_summary(compared: DataFrame) -> DataFrame:
    """One row a mode. compared: compare_modes rows with ok."""
    ok, some = F.col("ok"), lambda c: F.count_if(F.col("ok") & (F.size(c) > 0))
    return compared.groupBy("mode").agg(
        F.count("*").alias("attempted"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), *(F.count_if(ok & (F.col("status") == s)).alias(s) for s in ("valid", "warning", "invalid")),
        F.count_if(ok & (F.size("accepted") == 0)).alias("no_change"), some("accepted").alias("any_change"), some("high_risk").alias("high_risk_changed"), some("minimum").alias("minimum_changed"), some("rejected").alias("rejected_changes"),
    )


def field_changes(compared: DataFrame, column: str = "accepted") -> DataFrame:
    """How often each field changed, by mode."""
    # outer, then filtered: a plain explode has a filter inferred that repeats the merge below it
    return compared.where("ok").select("mode", F.explode_outer(column).alias("field")).where("field is not null").groupBy("mode", "field").agg(F.count("*").alias("n"))


def mode_pairs(compared: DataFrame) -> DataFrame:
    """Pairwise counts of the two modes over all keys."""
    wide = compared.groupBy("key").agg(*(F.first(F.when(F.col("mode") == m, F.struct("ok", "accepted")), ignorenulls=True).alias(m) for m in ("unrestricted", "restricted")))
    u, r = F.col("unrestricted"), F.col("restricted")
    size = lambda c: F.coalesce(F.size(c["accepted"]), F.lit(0))
    none = F.array().cast("array<string>")
    return wide.agg(
        F.count_if(F.coalesce(u["ok"] & r["ok"], F.lit(False))).alias("both_ok"), F.count_if(size(u) > size(r)).alias("unrestricted_more"), F.count_if(size(r) > size(u)).alias("restricted_more"),
        F.count_if(F.coalesce(u["accepted"], none) == F.coalesce(r["accepted"], none)).alias("same"),
    )


def latest_run(runs: DataFrame, key: str, where: Column | None = None) -> DataFrame:
    """The id of the last run by start, then by id: one row, found without a sort."""
    rows = runs if where is None else runs.where(where)
    return rows.agg(F.max(F.struct("started_at", F.col(key).alias("id"))).alias("m")).where("m is not null").select(F.col("m.id").alias(key))


def candidate_rows(cleaned: DataFrame, cleaning_runs: DataFrame, raw: DataFrame, model_run: str | None = None, most: int | None = None) -> DataFrame:
    """Rule and model records of one raw record in one pipeline run. cleaned: with ``book``. Small run tables are joined first."""
    runs = cleaning_runs.select("cleaning_run_id", "pipeline_run_id", "cleaner_kind")
    slim = cleaned.select("cleaned_record_id", "cleaning_run_id", "raw_record_id", "book").join(runs, "cleaning_run_id")
    rule = slim.where("cleaner_kind = 'rule'").select("raw_record_id", "pipeline_run_id", F.col("cleaned_record_id").alias("rule_record_id"), F.col("book").alias("rule"))
    model = slim.where("cleaner_kind = 'llm'")
    model = model if model_run is None else model.where(F.col("cleaning_run_id") == model_run)
    model = model.select("raw_record_id", "pipeline_run_id", F.col("cleaned_record_id").alias("model_record_id"), F.col("book").alias("model_book"))
    out = rule.join(model, ["raw_record_id", "pipeline_run_id"]).join(raw.select("raw_record_id", "source_url"), "raw_record_id")
    return out if most is None else out.orderBy("raw_record_id", "model_record_id").limit(most)


def review_decisions(manifest: DataFrame) -> DataFrame:
    """Decisions of manifest rows with the arrays ``decisions`` and ``candidates``: key, decision, notes; invalid ones out.

    The last of a key wins: by ``file`` (the manifest's name, if there is such a column), then by place; of rows that agree in
    both, the larger decision and note.
    """
    file = F.col("file") if "file" in manifest.columns else F.lit("")
    every = manifest.select(file.alias("file"), F.posexplode(F.concat(F.coalesce("decisions", F.array()), F.coalesce("candidates", F.array()))).alias("pos", "d"))
    rows = every.select("file", "pos", F.coalesce("d.model_record_id", "d.candidate_id").alias("key"), "d.decision", "d.notes").where(F.col("decision").isin("accept", "skip") & F.col("key").isNotNull())
    return rows.groupBy("key").agg(F.max(F.struct("file", "pos", "decision", "notes")).alias("d")).select("key", "d.decision", "d.notes")


def build_candidates(rows: DataFrame, decisions: DataFrame, site: Site = SITE) -> DataFrame:
    """Promotion candidates: changes, validation, decision by record or candidate id, recommendation, status and warnings."""
    out = rows.withColumn("candidate_id", candidate_id(F.col("model_record_id")))
    named = lambda as_: decisions.select(F.col("key").alias(f"{as_}_key"), F.struct("decision", "notes").alias(as_))
    out = out.join(named("by_record"), F.col("model_record_id") == F.col("by_record_key"), "left").join(named("by_candidate"), F.col("candidate_id") == F.col("by_candidate_key"), "left")
    chosen = F.coalesce("by_record", "by_candidate")
    out = out.withColumns({"decision": F.coalesce(chosen["decision"], F.lit("skip")), "decision_notes": F.coalesce(chosen["notes"], F.lit(""))}).drop("by_record", "by_record_key", "by_candidate", "by_candidate_key")
    out = validate.with_validation(out, "model_book").withColumn("warnings", validate.record_warnings(F.col("model_book"), F.col("gate_warnings"), ordered=True))
    out = out.withColumns({"changed": changed_fields(F.col("rule"), F.col("model_book")), "payload": exports.payload(F.col("model_book"), site)})
    out = out.withColumns({"protected": among(F.col("changed"), PROTECTED), "minimum": among(F.col("changed"), MINIMUM), "payload_warnings": validate.payload_warnings(F.col("payload"), site)})
    fine = (F.size("protected") == 0) & F.col("eligible") & (F.size("payload_warnings") == 0)
    accepted = F.col("decision") == "accept"
    every = F.concat("warnings", "payload_warnings", F.transform("protected", lambda f: F.concat(F.lit("protected-field-changed-"), f)), F.when(accepted, F.array().cast("array<string>")).otherwise(F.array(F.lit("review-decision-not-accepted"))))
    return out.withColumns({"recommended": F.when(fine, "accept").otherwise("skip"), "promotion_status": F.when(fine & accepted, "prepared").otherwise("skipped"), "promotion_warnings": F.array_sort(F.array_distinct(every))})


def review_manifest(candidates: DataFrame) -> DataFrame:
    """One row a candidate, as it is written for review."""
    return candidates.select("candidate_id", "raw_record_id", "source_url", "rule_record_id", "model_record_id", "changed", "protected", "minimum", "status", "warnings", "recommended", "decision", "decision_notes")


def promotion_rows(candidates: DataFrame, with_skipped: bool = False) -> tuple[DataFrame, DataFrame]:
    """Export rows and import rows of the candidates that are prepared (and of the others, if asked)."""
    # outer, then filtered: a plain filter would be pushed down and repeat every expression that the status is made of
    kept = F.array(F.struct("candidate_id", "model_record_id", "payload", "status", "promotion_warnings", "promotion_status"))
    chosen = kept if with_skipped else F.when(F.col("promotion_status") == "prepared", kept)
    # written once: the candidates would be built for each of the two tables
    rows = stage(candidates.select(F.explode_outer(chosen).alias("r")).where("r is not null").select("r.*"), "promoted")
    key = F.col("candidate_id")
    exported = rows.select(F.concat(F.lit("export-catalog-json-"), key).alias("export_record_id"), F.col("model_record_id").alias("cleaned_record_id"), F.lit("catalog-json").alias("format"), F.to_json("payload").alias("payload_json"), F.col("status").alias("validation_status"), F.to_json("promotion_warnings").alias("validation_warnings_json"))
    imported = rows.select(F.concat(F.lit("import-catalog-json-"), key).alias("import_record_id"), F.col("model_record_id").alias("cleaned_record_id"), F.concat(F.lit("export-catalog-json-"), key).alias("export_record_id"), F.to_json("payload").alias("item_payload_json"), F.col("promotion_status").alias("status"), F.to_json("promotion_warnings").alias("validation_warnings_json"))
    return exported, imported


def promotion_summary(candidates: DataFrame) -> DataFrame:
    return candidates.agg(
        F.count("*").alias("candidates"), F.count_if(F.col("decision") == "accept").alias("accepted"), F.count_if(F.col("promotion_status") == "prepared").alias("prepared"),
        F.count_if(F.col("promotion_status") == "skipped").alias("skipped"), F.count_if(F.size("protected") > 0).alias("protected_changed"),
    )


def select_records(records: DataFrame, ids: DataFrame | None = None, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Records by an id list (pos, id), in its order, with the missing ids; or those ok, valid and without protected change."""
    if ids is not None:
        return ids.join(records, "id").orderBy("pos"), ids.join(records.select("id"), "id", "left_anti")
    good = records.where("ok and status = 'valid' and size(protected) = 0").orderBy("id")
    return (good if most is None else good.limit(most)), records.select("id").limit(0)


def source_rows(cleaned: DataFrame, cleaning_runs: DataFrame, raw: DataFrame, kind: str = "rule", run_id: str | None = None, most: int | None = None) -> DataFrame:
    """Records of a cleaner's kind with their raw html, ordered; of one run if given. ``one_pipeline`` tells whether a single pipeline run is behind them."""
    runs = cleaning_runs.where(F.col("cleaner_kind") == kind).select("cleaning_run_id", "pipeline_run_id")
    runs = runs if run_id is None else runs.where(F.col("cleaning_run_id") == run_id)
    rows = cleaned.join(runs, "cleaning_run_id").join(raw.select("raw_record_id", "source_url", "raw_html"), "raw_record_id").orderBy("raw_record_id", "cleaned_record_id")
    return rows if most is None else rows.limit(most)


def pipelines_behind(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_distinct("pipeline_run_id").alias("pipeline_runs"))


def last_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the largest order value."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("__n = 1").drop("__n")
