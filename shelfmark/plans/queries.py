"""Registered queries of the catalog operators, and the SQL that their results must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as nz
from ..functions import text as tx
from ..operators import coverage, exports, lists, matching, merge, pages, validate, volumes
from ..schemas import BOOK_FIELDS, CREATORS
from ..sources import store
from . import synth
from .synth import run_sql, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- scalars


@query(f"SELECT k, raw, expected AS normalized, expected <> '' AND expected = raw AS already FROM ({synth.DATES}) d")
def n1_publication_dates(spark, sf):
    d = run_sql(spark, sf, synth.DATES)
    return d.select("k", "raw", nz.publication_date(F.col("raw")).alias("normalized"), nz.is_publication_date(F.col("raw")).alias("already"))


@query(f"SELECT k, expected AS isbn13, (k % 4 < 3) AS valid FROM ({synth.ISBNS}) i")
def n3_isbn13(spark, sf):
    i = run_sql(spark, sf, synth.ISBNS)
    return i.select("k", nz.isbn13(F.col("raw")).alias("isbn13"), nz.is_isbn(F.col("raw")).alias("valid"))


_COMPARABLE = "regexp_replace(lower({0}), '[ ,.;:!?()<>''\"-]', '', 'g')"


@query(
    f"""WITH t AS (SELECT p_partkey AS k, {_COMPARABLE.format("p_name || ', ' || p_type")} AS a, {_COMPARABLE.format("p_name || ' ' || p_brand")} AS b FROM part)
SELECT k, levenshtein(a, b) AS distance, round(CASE WHEN a = b THEN 1.0 ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b)) END, 6) AS similarity FROM t"""
)
def n8_similarity(spark, sf):
    t = table(spark, sf, "part").select("p_partkey", F.concat_ws(", ", "p_name", "p_type").alias("a"), F.concat_ws(" ", "p_name", "p_brand").alias("b"))
    a, b = nz.comparable(F.col("a")), nz.comparable(F.col("b"))
    return t.select(F.col("p_partkey").alias("k"), F.levenshtein(a, b).cast("long").alias("distance"), F.round(nz.normalized_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("""SELECT p_partkey AS k, p_name AS main, CASE p_partkey % 4 WHEN 0 THEN 'zh' WHEN 1 THEN 'en' WHEN 2 THEN NULL ELSE NULL END AS language FROM part""")
def n10_titles_and_languages(spark, sf):
    sep = F.element_at(F.array(F.lit(": "), F.lit("："), F.lit(" — ")), (F.col("p_partkey") % 3 + 1).cast("int"))
    lang = F.element_at(F.array(F.lit("zh"), F.lit(" EN "), F.lit("english"), F.lit("")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), nz.main_title(F.concat("p_name", sep, "p_type")).alias("main"), nz.language(lang).alias("language"))


@query(
    """SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '^http:', 'https:') AS https_url,
  regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '\\?.*$', ''), '^http:', 'https:') AS plain_url FROM pages"""
)
def n11_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.https_url(F.col("url")).alias("https_url"), tx.plain_url(F.col("url")).alias("plain_url"))


@query(
    """WITH u AS (SELECT user_id, event_id, 'https://book.example.org/subject/' || event_id || '/?a=' || user_id || '&b=1' AS url FROM events)
SELECT event_id, 'subject-' || event_id || '-' || lpad(lower(to_hex(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(url, ''), lambda x: ascii(x)::BIGINT)),
  lambda h, x: (xor(h, x) * 16777619) & 4294967295))), 8, '0') AS cache_key FROM u"""
)
def n13_cache_keys(spark, sf):
    url = F.concat(F.lit("/subject/"), F.col("event_id").cast("string"), F.lit("/?b=1&a="), F.col("user_id").cast("string"), F.lit("#x"))
    return table(spark, sf, "events").select("event_id", tx.cache_key(url).alias("cache_key"))


@query("""SELECT l_orderkey, l_linenumber, lpad(cast(l_linenumber AS string), 2, '0') AS volume, count(*) AS n FROM lineitem GROUP BY 1, 2, 3""")
def n15_volume_numbers(spark, sf):
    n = F.col("l_linenumber").cast("string")
    name = F.element_at(F.array(F.concat(F.lit("[x]卷"), n, F.lit(".epub")), F.concat(F.lit("第"), n, F.lit("卷.pdf")), F.concat(F.lit("Vol. "), n, F.lit(".cbz")), F.concat(F.lit("1999 v"), n, F.lit(".cbr")), F.concat(F.lit("2001 ("), n, F.lit(").mobi")), F.concat(F.lit("a 7 "), n, F.lit(".azw3"))), (F.col("l_orderkey") % 6 + 1).cast("int"))
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber", nz.volume_number(name).alias("volume")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, 'GET https://redacted@api.example.org/v1?api_key=redacted&model=m' || user_id || '&token=redacted for [redacted-api-key]' AS line FROM events""")
def n17_redaction(spark, sf):
    line = F.concat(F.lit("GET https://me:pw@api.example.org/v1?api_key=k"), F.col("event_id").cast("string"), F.lit("&model=m"), F.col("user_id").cast("string"), F.lit("&token=t for sk-123"))
    return table(spark, sf, "events").select("event_id", tx.redact(line, "sk-123").alias("line"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE 'u-' || c_custkey END AS uid, CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE 'https://book.example.org/people/u-' || c_custkey || '/wish' END AS url FROM customer""")
def n12_readlist_inputs(spark, sf):
    k = F.col("c_custkey").cast("string")
    value = F.element_at(F.array(F.concat(F.lit(" u-"), k), F.concat(F.lit("https://book.example.org/people/u%2D"), k, F.lit("/wish?start=15")), F.concat(F.lit("https://other.example.org/people/u-"), k, F.lit("/wish"))), (F.col("c_custkey") % 3 + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", tx.readlist(value).alias("r")).select("c_custkey", "r.uid", "r.url")


# ---- books, gate, matching


def incoming(spark, sf) -> DataFrame:
    b = run_sql(spark, sf, synth.BOOKS)
    author = F.array(F.struct(F.lit("").alias("first_name"), F.lit("Author").alias("last_name"), F.lit("author").alias("creator_type"), F.lit(1).alias("field_mode"), F.lit(None).cast("boolean").alias("needs_review"))).cast(CREATORS)
    known = {"creators": F.when(F.col("has_author"), author).otherwise(F.array().cast(CREATORS)), "creator_notes": F.lit(None).cast("array<string>")}
    have = set(b.columns)
    book = F.struct(*(known[n].alias(n) if n in known else F.col(n).alias(n) if n in have else F.lit(None).cast("string").alias(n) for n in BOOK_FIELDS))
    return validate.with_validation(b.withColumn("book", book))


_GATE = f"""
SELECT book_key, concat_ws(',', CASE WHEN NOT has_author THEN 'minimum-ingest-missing-author-or-editor' END, CASE WHEN publisher = '' THEN 'minimum-ingest-missing-publisher' END,
  CASE WHEN language IS NULL THEN 'minimum-ingest-missing-language' WHEN language = 'xx' THEN 'minimum-ingest-unsupported-language-xx' END) AS gate_warnings,
  concat_ws(',', CASE WHEN NOT has_author THEN 'creator' END, CASE WHEN publisher = '' THEN 'publisher' END, CASE WHEN language IS NULL THEN 'language' END) AS missing, isbn FROM ({synth.BOOKS}) b
"""


@query(
    f"""SELECT book_key, gate_warnings, missing, gate_warnings = '' AS eligible, CASE WHEN gate_warnings <> '' THEN 'invalid' WHEN isbn IS NULL THEN 'warning' ELSE 'valid' END AS status FROM ({_GATE}) g"""
)
def v1_minimum_gate(spark, sf):
    return incoming(spark, sf).select("book_key", F.array_join("gate_warnings", ",").alias("gate_warnings"), F.array_join("missing_fields", ",").alias("missing"), "eligible", "status")


_NORM = "regexp_replace(lower({0}), '[ ,.;:!?()<>''\"-]', '', 'g')"
_SIM = "CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b})) END"
_MATCH = f"""
WITH b AS ({synth.BOOKS}), l AS ({synth.LIBRARY}),
ex AS (SELECT b.book_key, min(l.item_id) AS item_id FROM b JOIN l ON replace(l.isbn, '-', '') = b.isbn GROUP BY 1),
p AS (SELECT b.book_key, b.publish_date, l.item_id, l.date, b.publisher AS bp, l.publisher AS lp, {_NORM.format('b.title')} AS bt, {_NORM.format('l.title')} AS lt, {_NORM.format('b.publisher')} AS bpn, {_NORM.format('l.publisher')} AS lpn
  FROM b JOIN l ON contains(lower(l.title), lower(substr(trim(split_part(b.title, ':', 1)), 1, 10)))
  WHERE b.book_key NOT IN (SELECT book_key FROM ex) AND (b.isbn IS NULL OR l.isbn IS NULL)),
s AS (SELECT *, {_SIM.format(a='bt', b='lt')} AS t, {_SIM.format(a='bpn', b='lpn')} AS q FROM p),
c AS (SELECT *, CASE WHEN bp = '' OR lp = '' THEN t WHEN publish_date = date THEN t * 0.6 + q * 0.2 + 0.2 ELSE t * 0.6 + q * 0.2 - 0.1 END AS confidence FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY book_key ORDER BY confidence DESC, item_id) AS n FROM c WHERE confidence > 0.8),
m AS (SELECT b.book_key, CASE WHEN ex.item_id IS NOT NULL THEN 'duplicate' WHEN r.confidence >= 0.95 THEN 'duplicate' WHEN r.confidence IS NOT NULL THEN 'suspect' ELSE 'new' END AS match_type,
  coalesce(ex.item_id, r.item_id) AS matched_item_id, round(CASE WHEN ex.item_id IS NOT NULL THEN 1.0::DOUBLE ELSE r.confidence END, 6) AS match_confidence
  FROM b LEFT JOIN ex USING (book_key) LEFT JOIN r ON r.book_key = b.book_key AND r.n = 1)
"""


def matched(spark, sf) -> DataFrame:
    return matching.check_duplicates(incoming(spark, sf), run_sql(spark, sf, synth.LIBRARY))


@query(_MATCH + "SELECT * FROM m")
def j3_check_duplicates(spark, sf):
    return matched(spark, sf).select("book_key", "match_type", "matched_item_id", F.round("match_confidence", 6).alias("match_confidence"))


@query(
    _MATCH
    + f""", g AS ({_GATE}) SELECT m.book_key, CASE match_type WHEN 'duplicate' THEN 'skip-duplicate' WHEN 'suspect' THEN 'review-suspect' ELSE 'eligible-new' END AS decision,
  match_type = 'new' AND gate_warnings = '' AS selected, match_type = 'duplicate' OR gate_warnings <> '' AS locked,
  CASE WHEN gate_warnings <> '' THEN 'incomplete' WHEN match_type = 'new' THEN 'new' ELSE match_type END AS badge FROM m JOIN g USING (book_key)"""
)
def j4_review_rows(spark, sf):
    return matching.review_rows(matched(spark, sf)).select("book_key", "decision", "selected", "locked", "badge")


@query(
    _MATCH
    + f""", g AS ({_GATE}) SELECT count(*) AS total, count(*) FILTER (match_type = 'new') AS "new", count(*) FILTER (match_type = 'duplicate') AS duplicate, count(*) FILTER (match_type = 'suspect') AS suspect,
  count(*) FILTER (gate_warnings <> '') AS incomplete FROM m JOIN g USING (book_key)"""
)
def a18_review_summary(spark, sf):
    return matching.review_summary(matched(spark, sf))


# ---- detail pages


def parsed_pages(spark, sf) -> DataFrame:
    return validate.with_validation(pages.books(synth.detail_pages(spark, sf)))


_FIELDS = f"""
SELECT k, url, cohort, broken, CASE WHEN subtitle = '' THEN main_title ELSE main_title || ': ' || subtitle END AS title, publisher, pages,
  CASE WHEN date_raw = '' THEN '' ELSE substr(date_raw, 1, 5) || lpad(substr(date_raw, 6), 2, '0') END AS publish_date, nullif(isbn, '') AS isbn, nullif(language, '') AS language, nullif(series, '') AS series, author, translator,
  'About ' || main_title || '.' AS abstract_note, cast(1000000 + k AS string) AS book_id FROM ({synth.PAGE_FIELDS}) f
"""


@query(
    f"""SELECT k, book_id, title, publisher, publish_date, isbn AS isbn13, language, series, pages, abstract_note,
  concat_ws(';', CASE WHEN author <> '' THEN 'author:' || split_part(author, ' ', 1) || '|' || split_part(author, ' ', 2) END, CASE WHEN translator <> '' THEN 'translator:Bob|Smith' END) AS creators
FROM ({_FIELDS}) x WHERE NOT broken"""
)
def e7_book_records(spark, sf):
    good, _ = pages.split_failures(parsed_pages(spark, sf))
    who = F.array_join(F.transform("book.creators", lambda c: F.concat(c["creator_type"], F.lit(":"), c["first_name"], F.lit("|"), c["last_name"])), ";")
    return good.select("k", *(f"book.{n}" for n in ("book_id", "title", "publisher", "publish_date", "isbn13", "language", "series", "pages", "abstract_note")), who.alias("creators"))


@query(f"SELECT url, 'missing-info-block' AS parse_error FROM ({synth.PAGE_FIELDS}) f WHERE broken")
def e7_parse_failures(spark, sf):
    return pages.split_failures(parsed_pages(spark, sf))[1]


@query(
    f"""WITH x AS (SELECT * FROM ({_FIELDS}) y WHERE NOT broken)
SELECT k, '@book{{book-' || book_id || ',' || chr(10) || array_to_string(list_filter([
  '  title = {{' || title || '}}', CASE WHEN author <> '' THEN '  author = {{' || author || '}}' END, CASE WHEN translator <> '' THEN '  translator = {{' || translator || '}}' END,
  CASE WHEN publisher <> '' THEN '  publisher = {{' || publisher || '}}' END, CASE WHEN publish_date <> '' THEN '  date = {{' || publish_date || '}}' END, '  isbn = {{' || isbn || '}}', '  pagetotal = {{' || pages || '}}',
  '  series = {{' || series || '}}', '  url = {{' || url || '}}', '  abstract = {{' || abstract_note || '}}'], lambda v: v IS NOT NULL), ',' || chr(10)) || chr(10) || '}}' AS entry FROM x"""
)
def y3_biblatex(spark, sf):
    return pages.split_failures(parsed_pages(spark, sf))[0].select("k", exports.biblatex(F.col("book")).alias("entry"))


@query(
    f"""WITH x AS (SELECT * FROM ({_FIELDS}) y WHERE NOT broken)
SELECT k, '@book{{book-' || book_id || ',' || chr(10) || array_to_string(list_filter([
  '  title = {{' || title || '}}', CASE WHEN author <> '' THEN '  author = {{' || author || '}}' END, CASE WHEN publisher <> '' THEN '  publisher = {{' || publisher || '}}' END,
  CASE WHEN publish_date <> '' THEN '  year = {{' || substr(publish_date, 1, 4) || '}}' END, '  isbn = {{' || isbn || '}}', '  pages = {{' || pages || '}}', '  series = {{' || series || '}}', '  url = {{' || url || '}}',
  '  abstract = {{' || abstract_note || '}}', CASE WHEN translator <> '' THEN '  note = {{Translator: ' || translator || '}}' END], lambda v: v IS NOT NULL), ',' || chr(10)) || chr(10) || '}}' AS entry FROM x"""
)
def y2_bibtex(spark, sf):
    return pages.split_failures(parsed_pages(spark, sf))[0].select("k", exports.bibtex(F.col("book")).alias("entry"))


_STATUS = f"""SELECT *, concat_ws(',', CASE WHEN author = '' THEN 'minimum-ingest-missing-author-or-editor' END, CASE WHEN publish_date = '' THEN 'minimum-ingest-missing-date' END, CASE WHEN publisher = '' THEN 'minimum-ingest-missing-publisher' END,
  CASE WHEN language IS NULL THEN 'minimum-ingest-missing-language' WHEN language = 'xx' THEN 'minimum-ingest-unsupported-language-xx' END) AS gate FROM ({_FIELDS}) z WHERE NOT broken"""


def cleaned_records(spark, sf) -> DataFrame:
    good, _ = pages.split_failures(parsed_pages(spark, sf))
    return good.withColumn("cleaned_record_id", F.concat(F.lit("cleaned-"), F.col("k").cast("string")))


@query(
    f"""SELECT format, validation_status, count(*) AS n FROM (SELECT unnest(['catalog-json', 'bibtex', 'biblatex']) AS format, CASE WHEN gate <> '' THEN 'invalid' WHEN isbn IS NULL THEN 'warning' ELSE 'valid' END AS validation_status
FROM ({_STATUS}) s) t GROUP BY 1, 2"""
)
def s5_export_records(spark, sf):
    return exports.export_records(cleaned_records(spark, sf)).groupBy("format", "validation_status").agg(F.count("*").alias("n"))


@query(f"SELECT 'import-catalog-json-' || k AS import_record_id, CASE WHEN gate = '' THEN 'prepared' ELSE 'skipped' END AS status, concat_ws(',', nullif(gate, ''), CASE WHEN isbn IS NULL THEN 'missing-isbn' END) AS warnings FROM ({_STATUS}) s")
def s7_import_records(spark, sf):
    return exports.import_records(cleaned_records(spark, sf)).select("import_record_id", "status", F.array_join("warnings", ",").alias("warnings"))


@query(
    f"""WITH s AS ({_STATUS}), f AS (SELECT k, unnest([['title', title], ['abstractNote', abstract_note], ['series', series], ['date', publish_date], ['publisher', publisher], ['numPages', pages], ['ISBN', isbn], ['url', url], ['language', language], ['libraryCatalog', 'Catalog']]) AS e FROM s)
SELECT e[1] AS field, count(*) AS n, max(e[2]) AS largest FROM f WHERE e[2] IS NOT NULL AND e[2] <> '' GROUP BY 1"""
)
def y5_item_fields(spark, sf):
    rows = cleaned_records(spark, sf).select(F.col("k").alias("id"), exports.payload(F.col("book")).alias("payload"))
    return exports.item_fields(rows).groupBy("field").agg(F.count("*").alias("n"), F.max("value").alias("largest"))


@query(
    f"""WITH s AS ({_STATUS}), w AS (SELECT unnest(string_split(gate, ',')) AS warning FROM s WHERE gate <> '')
SELECT replace(warning, 'minimum-ingest-', 'parser-') AS value, count(*) AS n FROM w WHERE warning LIKE '%author%' OR warning LIKE '%language%' GROUP BY 1"""
)
def e21_parser_warnings(spark, sf):
    return coverage.histogram(cleaned_records(spark, sf), "parser_warnings")


# ---- coverage


def samples(spark, sf) -> DataFrame:
    """Parsed pages with their labels and surfaces, from one pass of the helper."""
    good, _ = pages.split_failures(validate.with_validation(pages.books(synth.detail_pages(spark, sf), surfaces=True)))
    return good.withColumns({"subject_id": F.col("k").cast("string"), "batch": F.concat(F.lit("b"), (F.col("k") % 3).cast("string"))})


def stored_samples(spark, sf) -> DataFrame:
    """``samples`` as a table, for statistics that read them more than once."""
    return store.stage(samples(spark, sf), "samples")


_LABELS = f"""SELECT k, cohort, unnest(list_filter([CASE WHEN author <> '' THEN '作者' END, CASE WHEN publisher <> '' THEN '出版社' END, CASE WHEN subtitle <> '' THEN '副标题' END, CASE WHEN translator <> '' THEN '译者' END,
  CASE WHEN date_raw <> '' THEN '出版年' END, '页数', CASE WHEN series <> '' THEN '丛书' END, CASE WHEN isbn <> '' THEN 'ISBN' END, CASE WHEN language <> '' THEN '语言' END], lambda v: v IS NOT NULL)) AS label
FROM ({synth.PAGE_FIELDS}) f WHERE NOT broken"""


@query(f"SELECT label, count(*) AS total, count(*) FILTER (cohort = 'old') AS old, count(*) FILTER (cohort = 'new') AS \"new\" FROM ({_LABELS}) l GROUP BY 1")
def a7_label_coverage(spark, sf):
    return coverage.label_coverage(samples(spark, sf), ("old", "new"))


@query(f"SELECT label, cast(k AS string) AS subject_id FROM ({_LABELS}) l")
def a7_label_subjects(spark, sf):
    return coverage.label_subjects(samples(spark, sf))


@query(
    f"""WITH s AS ({_STATUS}), f AS (SELECT cohort, unnest([['title', title], ['creators', author || translator], ['publisher', publisher], ['publish_date', publish_date], ['isbn', isbn], ['isbn13', isbn], ['pages', pages], ['price', ''], ['series', series],
  ['format', ''], ['language', language], ['original_title', ''], ['abstract_note', abstract_note], ['creator_notes', '']]) AS e FROM s)
SELECT e[1] AS field, count(*) FILTER (e[2] <> '') AS total, count(*) FILTER (e[2] <> '' AND cohort = 'old') AS old, count(*) FILTER (e[2] <> '' AND cohort = 'new') AS "new" FROM f GROUP BY 1"""
)
def a9_field_coverage(spark, sf):
    return coverage.field_coverage(samples(spark, sf), ("old", "new"))


@query(f"SELECT unnest(['h1_title', 'abstract_block']) AS surface, count(*) AS total, count(*) FILTER (cohort = 'old') AS old, count(*) FILTER (cohort = 'new') AS \"new\" FROM ({_STATUS}) s")
def a8_surface_coverage(spark, sf):
    return coverage.surface_coverage(samples(spark, sf), ("old", "new"))


@query(
    f"""SELECT role, count(*) AS records, cast(count(*) AS bigint) AS creators, count(*) FILTER (cohort = 'old') AS old_records, count(*) FILTER (cohort = 'new') AS new_records
FROM (SELECT cohort, 'author' AS role FROM ({_STATUS}) a WHERE author <> '' UNION ALL SELECT cohort, 'translator' FROM ({_STATUS}) b WHERE translator <> '') r GROUP BY 1"""
)
def a10_creator_coverage(spark, sf):
    return coverage.creator_coverage(samples(spark, sf), ("old", "new"))


@query(f"SELECT count(*) FILTER (gate = '') AS eligible, count(*) FILTER (gate <> '') AS ineligible, count(*) FILTER (gate = '' AND cohort = 'old') AS old_eligible, count(*) FILTER (gate = '' AND cohort = 'new') AS new_eligible FROM ({_STATUS}) s")
def a11_validation_coverage(spark, sf):
    return coverage.validation_coverage(samples(spark, sf), ("old", "new"))


@query(
    f"""WITH s AS (SELECT *, string_split(gate, ',') AS g FROM ({_STATUS}) s WHERE cohort = 'new' AND gate <> ''), p AS (SELECT *, list_filter(g, lambda w: w <> 'minimum-ingest-missing-language') AS more, list_filter(g, lambda w: contains(w, 'author') OR contains(w, 'language')) AS pw FROM s)
SELECT cast(k AS string) AS subject_id, 'b' || k % 3 AS batch, CASE WHEN len(more) > 0 THEN 2 ELSE 6 END AS tier, cast(1 + len(more) + CASE WHEN len(pw) > 0 THEN 1 ELSE 0 END AS int) AS score,
  concat_ws(',', 'minimum-ingest:' || replace(gate, ',', '|'), CASE WHEN len(pw) > 0 THEN 'parser-diagnostics:' || replace(array_to_string(pw, '|'), 'minimum-ingest-', 'parser-') END) AS reasons
FROM p ORDER BY tier, score DESC, subject_id LIMIT 12"""
)
def w9_golden_candidates(spark, sf):
    return coverage.golden_candidates(stored_samples(spark, sf), "old", "new").withColumn("reasons", F.array_join("reasons", ","))


@query(
    f"""SELECT cast(k AS string) AS subject_id, 'b' || k % 3 AS batch, cast((gate <> '')::INT + (series IS NOT NULL)::INT AS int) AS score,
  concat_ws(',', CASE WHEN gate = 'minimum-ingest-missing-language' THEN 'near-prepared-missing-language' WHEN gate <> '' THEN 'minimum-ingest-review:' || replace(gate, ',', '|') END, CASE WHEN series IS NOT NULL THEN 'series-field-review' END) AS reasons
FROM ({_STATUS}) s WHERE gate <> '' OR series IS NOT NULL ORDER BY score DESC, subject_id LIMIT 15"""
)
def w10_review_candidates(spark, sf):
    return coverage.review_candidates(stored_samples(spark, sf), "old", "new").withColumn("reasons", F.array_join("reasons", ","))


# ---- lists


def diagnosed(spark, sf) -> DataFrame:
    return synth.list_pages(spark, sf).withColumn("d", lists.page_diagnostics(F.col("html"))).drop("html")


_ENTRIES = f"SELECT *, cast(floor(pos / 15) AS int) AS page FROM ({synth.ENTRIES}) e"


@query(
    f"""SELECT uid, page, count(DISTINCT subject) AS visible, max(n) AS total, (page + 1) * 15 < max(n) AS has_next, cast(page * 15 + 1 AS bigint) AS first, page * 15 + count(*) AS last,
  page * 15 + 15 < max(n) AS more FROM ({_ENTRIES}) e GROUP BY uid, page"""
)
def e15_page_diagnostics(spark, sf):
    d = diagnosed(spark, sf)
    return d.select("uid", "page", F.col("d.visible").cast("long").alias("visible"), F.col("d.total").cast("long").alias("total"), F.col("d.has_next").alias("has_next"), F.col("d.range.start").cast("long").alias("first"), F.col("d.range.end").cast("long").alias("last"), F.col("d.next_url").isNotNull().alias("more"))


@query(f"SELECT uid, row_number() OVER (PARTITION BY uid ORDER BY p) AS position, 'https://book.example.org/subject/' || subject || '/' AS url FROM (SELECT uid, subject, min(pos) AS p FROM ({_ENTRIES}) e GROUP BY 1, 2) f")
def a1_assembled_links(spark, sf):
    return lists.assemble(diagnosed(spark, sf))[0].select("uid", F.col("position").cast("long").alias("position"), "url")


_SUMMARY = f"""SELECT uid, max(n) AS total, count(DISTINCT page) AS pages, (SELECT sum(v) FROM (SELECT uid AS u, page, count(DISTINCT subject) AS v FROM ({_ENTRIES}) i GROUP BY 1, 2) j WHERE j.u = e.uid) AS visible, count(DISTINCT subject) AS unique_links FROM ({_ENTRIES}) e GROUP BY uid"""


@query(f"SELECT uid, total, pages, cast(visible AS bigint) AS visible, unique_links, concat_ws(',', CASE WHEN visible < total THEN 'readlist-visible-count-mismatch' END, CASE WHEN unique_links < visible THEN 'readlist-duplicate-visible-links' END) AS warnings FROM ({_SUMMARY}) s")
def a2_list_completeness(spark, sf):
    s = lists.completeness_warnings(lists.assemble(diagnosed(spark, sf))[1])
    kinds = F.array_join(F.transform("warnings", lambda w: F.substring_index(w, ":", 1)), ",")
    return s.select("uid", *(F.col(c).cast("long").alias(c) for c in ("total", "pages", "visible", "unique_links")), kinds.alias("warnings"))


@query(f"SELECT url, title, count(*) AS n_sources, min(uid) AS first_list FROM (SELECT uid, 'https://book.example.org/subject/' || subject || '/' AS url, 'Book ' || subject AS title FROM ({_ENTRIES}) e GROUP BY uid, subject) f GROUP BY 1, 2")
def a6_merged_candidates(spark, sf):
    links = lists.assemble(diagnosed(spark, sf))[0].select("url", "title", F.struct("uid", "position").alias("seq"), F.struct("uid", "position").alias("source"))
    return lists.merge_candidates(links).select("url", "title", "n_sources", F.col("first_source.uid").alias("first_list"))


@query(
    f"""WITH f AS (SELECT uid, subject, row_number() OVER (PARTITION BY uid ORDER BY p) AS place FROM (SELECT uid, subject, min(pos) AS p FROM ({_ENTRIES}) e GROUP BY 1, 2) g)
SELECT 'https://book.example.org/subject/' || subject || '/' AS url, row_number() OVER (PARTITION BY subject ORDER BY uid, place) AS position, uid AS list, place AS list_position FROM f"""
)
def a6_candidate_sources(spark, sf):
    links = lists.assemble(diagnosed(spark, sf))[0].withColumn("source", F.struct("uid", "position"))
    return lists.candidate_sources(links, "uid", "position").select("url", "position", F.col("source.uid").alias("list"), F.col("source.position").cast("long").alias("list_position"))


@query(
    f"""SELECT url, row_number() OVER (ORDER BY o, url) AS rank FROM (SELECT url, sha256('seed' || chr(0) || url) AS o FROM (SELECT DISTINCT 'https://book.example.org/subject/' || subject || '/' AS url FROM ({_ENTRIES}) e) f
ORDER BY o, url LIMIT 100) g"""
)
def w2_selected_subjects(spark, sf):
    urls = run_sql(spark, sf, synth.ENTRIES).select(F.concat(F.lit("https://book.example.org/subject/"), F.col("subject").cast("string"), F.lit("/")).alias("url")).distinct()
    return lists.select_subjects(urls, 100, "seed").select("url", F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH p AS (SELECT uid, cast(ceil(max(n) / 15.0) AS int) AS k FROM ({synth.ENTRIES}) e GROUP BY 1), g AS (SELECT uid, k, unnest(range(k)) AS page FROM p),
r AS (SELECT *, page = 0 OR (uid % 10 = 0 AND k <= 3) AS fixed, sha256('seed' || chr(0) || uid || chr(0) || page) AS o FROM g), q AS (SELECT *, row_number() OVER (PARTITION BY uid, fixed ORDER BY o) AS n FROM r)
SELECT uid AS person, cast(page AS int) AS page_index FROM q WHERE fixed OR n <= 2"""
)
def w3_selected_pages(spark, sf):
    p = run_sql(spark, sf, synth.ENTRIES).groupBy(F.col("uid").alias("person")).agg(F.max("n").alias("declared_total"))
    people = lists.list_summary(p).withColumn("full", F.col("person") % 10 == 0)
    return lists.choose_pages(people, "seed", 2, 3)


@query(f"SELECT uid AS person, max(n) AS declared_total, cast(ceil(max(n) / 15.0) AS int) AS expected_pages, cast((max(n) - 1) % 15 + 1 AS int) AS last_page_items FROM ({synth.ENTRIES}) e GROUP BY 1")
def a5_list_summary(spark, sf):
    return lists.list_summary(run_sql(spark, sf, synth.ENTRIES).groupBy(F.col("uid").alias("person")).agg(F.max("n").alias("declared_total")))


@query(f"SELECT 'warning' AS severity, count(*) AS n FROM (SELECT uid, page FROM ({_ENTRIES}) e GROUP BY 1, 2 HAVING count(DISTINCT subject) < count(*)) f HAVING count(*) > 0")
def v8_pagination_audit(spark, sf):
    d = store.stage(diagnosed(spark, sf), "diagnosed").withColumnsRenamed({"uid": "person", "page": "page_index", "n": "declared_total"})
    people = lists.list_summary(d.groupBy("person").agg(F.max("declared_total").alias("declared_total")))
    checks = lists.page_checks(d).select("person", "page_index", "expected_start", "expected_end", "visible_links", "d")
    subjects = d.select(F.explode("d.links").alias("l")).select("l.url").distinct().withColumn("subject_id", tx.subject_id(F.col("url")))
    return lists.audit_lists(people, d.select("person", "page_index"), subjects, checks).groupBy("severity").agg(F.count("*").alias("n"))


@query(
    """WITH l AS (SELECT DISTINCT 'u' || event_id AS url, event_id AS e FROM events)
SELECT CASE WHEN e % 2 = 0 AND e % 3 = 0 THEN 'cached' WHEN e % 3 = 0 THEN 'index-repaired' WHEN e % 2 = 0 THEN 'cache-missing-refetch' ELSE 'to-fetch' END AS status, count(*) AS n FROM l GROUP BY 1"""
)
def j15_resume_status(spark, sf):
    l = table(spark, sf, "events").select(F.col("event_id").alias("e")).distinct().withColumn("url", F.concat(F.lit("u"), F.col("e").cast("string")))
    return lists.resume_status(l, l.where("e % 2 = 0"), l.where("e % 3 = 0")).groupBy("status").agg(F.count("*").alias("n"))


@query(
    f"""WITH x AS (SELECT subject, max(struct_pack(a := event_id, uid := uid, pos := pos)) AS m FROM ({_ENTRIES}) e GROUP BY 1)
SELECT k, m.uid::VARCHAR AS owner_id, cast(m.pos + 1 AS bigint) AS position FROM (SELECT p_partkey AS k FROM part) p LEFT JOIN x ON x.subject = p.k"""
)
def j5_list_context(spark, sf):
    e = run_sql(spark, sf, synth.ENTRIES)
    address = lambda c: F.concat(F.lit("https://book.example.org/subject/"), c.cast("string"), F.lit("/"))
    links = e.select(address(F.col("subject")).alias("url"), F.lit("t").alias("title"), F.concat(F.lit("https://book.example.org/people/"), F.col("uid").cast("string"), F.lit("/wish?start=0")).alias("list_url"), (F.col("pos") + 1).cast("long").alias("position"), F.col("event_id").alias("seq"))
    detail = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.concat(address(F.col("p_partkey")), F.lit("#x")).alias("url"))
    return lists.attach_lists(detail, links, tx.https_url).select("k", "owner_id", "position")


@query("SELECT p_partkey AS subject_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)")
def j14_unknown_subjects(spark, sf):
    known = table(spark, sf, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("subject_id"))
    return lists.exclude_known(table(spark, sf, "part").select(F.col("p_partkey").alias("subject_id")), known)


_SERIES = f"""l AS (SELECT *, cast(floor(pos / 2) AS int) AS page, row_number() OVER (PARTITION BY series, subject ORDER BY pos) = 1 AS fresh FROM ({synth.VOLUMES}) v),
r AS (SELECT series, page, declared, count(*) FILTER (fresh) AS new, sum(count(*) FILTER (fresh)) OVER (PARTITION BY series ORDER BY page) AS known FROM l GROUP BY 1, 2, 3),
s AS (SELECT *, coalesce(max((new = 0 OR (declared > 0 AND known >= declared))::INT) OVER (PARTITION BY series ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM r)"""


@query(f"WITH {_SERIES} SELECT series, 'Order ' || series AS name, nullif(max(declared), 0) AS declared, count(*) AS pages, cast(max(known) AS bigint) AS volumes, max(declared) > 0 AND max(declared) <> max(known) AS mismatch FROM s WHERE stopped = 0 GROUP BY 1")
def w6_series_assembly(spark, sf):
    s = lists.assemble_series(synth.series_pages(spark, sf))[1]
    return s.select("series", "name", *(F.col(c).cast("long").alias(c) for c in ("declared", "pages", "volumes")), "mismatch")


@query(f"WITH {_SERIES} SELECT series, row_number() OVER (PARTITION BY series ORDER BY pos) AS position, 'https://book.example.org/subject/' || subject || '/' AS url, 'Part ' || subject AS title FROM l JOIN s USING (series, page) WHERE stopped = 0 AND fresh")
def w6_series_volumes(spark, sf):
    return lists.assemble_series(synth.series_pages(spark, sf))[0].withColumn("position", F.col("position").cast("long"))


_INFO = " || ".join(f"CASE WHEN {c} = '' THEN '' ELSE '{a}: ' || {c} END" for a, c in (("作者", "author"), ("出版社", "publisher"), ("副标题", "subtitle"), ("译者", "translator"), ("出版年", "date_raw"), ("页数", "pages"), ("丛书", "series"), ("ISBN", "isbn"), ("语言", "language")))
_READABLE = f"""SELECT k, 'Source URL: ' || url || chr(10) || 'Rule metadata: {{"title":"' || main_title || '"}}' || chr(10) || 'Page title: ' || main_title || ' (Catalog)' || chr(10) || 'Heading: ' || main_title || chr(10) ||
  'Info: ' || CASE WHEN broken THEN '' ELSE {_INFO} END || chr(10) || 'Intro: About ' || main_title || '.' AS readable, main_title FROM ({synth.PAGE_FIELDS}) f"""


def readable_pages(spark, sf) -> DataFrame:
    raw = pages.extract(synth.detail_pages(spark, sf)).withColumn("book", F.struct(pages.page_title(F.col("raw")).alias("title")))
    return raw.select(F.col("k").alias("key"), "book", pages.readable_text(F.col("url"), F.col("raw"), F.col("book")).alias("readable"))


@query(f"SELECT k, readable FROM ({_READABLE}) r")
def e18_readable_text(spark, sf):
    return readable_pages(spark, sf).select(F.col("key").alias("k"), "readable")


@query(f"""SELECT k AS key, '{{"ruleMetadata":{{"title":"' || main_title || '"}},"readableText":"' || replace(replace(readable, '"', chr(92) || '"'), chr(10), chr(92) || 'n') || '","policy":"restricted"}}' AS user_payload FROM ({_READABLE}) r""")
def m10_page_requests(spark, sf):
    return merge.requests(readable_pages(spark, sf), "restricted").select("key", "user_payload")


# ---- model merge and promotion


def proposals(spark, sf) -> DataFrame:
    """Rule books with model answers: title changed (k % 7), language filled (k % 3), pages as a number (k % 11), publisher emptied (k % 5)."""
    p = synth.dealt(spark, table(spark, sf, "part"), "p_partkey").withColumn("k", F.col("p_partkey"))
    author = F.array(F.struct(F.lit("").alias("first_name"), F.lit("Author").alias("last_name"), F.lit("author").alias("creator_type"), F.lit(1).alias("field_mode"), F.lit(None).cast("boolean").alias("needs_review"))).cast(CREATORS)
    known = {
        "book_url": F.concat(F.lit("https://book.example.org/subject/"), F.col("k").cast("string"), F.lit("/")), "book_id": F.col("k").cast("string"), "title": F.col("p_name"), "publisher": F.col("p_brand"), "publish_date": (F.col("p_size") + 1950).cast("string"),
        "pages": F.lit("100"), "isbn": F.when(F.col("k") % 2 == 0, F.concat(F.lit("978"), F.lpad(F.col("k").cast("string"), 10, "0"))), "creators": author, "creator_notes": F.lit(None).cast("array<string>"),
    }
    rule = F.struct(*(known.get(n, F.lit(None).cast("string")).alias(n) for n in BOOK_FIELDS))
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    answer = F.concat(
        F.lit('Sure: {"title": '), quote(F.when(F.col("k") % 7 == 0, F.concat("p_name", F.lit(" II"))).otherwise(F.concat(F.lit(" "), "p_name"))), F.lit(', "publisher": '), quote(F.when(F.col("k") % 5 == 0, "").otherwise(F.col("p_brand"))),
        F.lit(', "language": '), quote(F.when(F.col("k") % 3 == 0, "EN").otherwise("klingon")), F.lit(', "pages": '), F.when(F.col("k") % 11 == 0, "321").otherwise('"100"'), F.lit("} done"),
    )
    body = F.to_json(F.struct(F.array(F.struct(F.struct(answer.alias("content")).alias("message"))).alias("choices")))
    bad = F.col("k") % 13 == 0
    return p.select(F.col("k").alias("key"), rule.alias("rule"), F.when(bad, 429).otherwise(200).alias("status"), body.alias("body"))


@query("SELECT coalesce(CASE WHEN p_partkey % 13 = 0 THEN 'rate-limited' END, 'ok') AS outcome, count(*) AS n FROM part GROUP BY 1")
def m11_responses(spark, sf):
    return merge.responses(proposals(spark, sf)).groupBy(F.coalesce("error", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"))


_CHANGED = "concat_ws(',', CASE WHEN p_partkey % 3 = 0 THEN 'language' END, CASE WHEN p_partkey % 7 = 0 THEN 'title' END)"


def merged(spark, sf) -> DataFrame:
    r = merge.answered(merge.responses(proposals(spark, sf)))
    return r.withColumn("merged", merge.merge_model(F.col("rule"), F.col("model")))


@query(
    f"""SELECT p_partkey AS key, {_CHANGED} AS changed, CASE WHEN p_partkey % 7 = 0 THEN p_name || ' II' ELSE p_name END AS title, p_brand AS publisher, CASE WHEN p_partkey % 3 = 0 THEN 'en' END AS language, '100' AS pages,
  CASE WHEN p_partkey % 3 = 0 THEN 'llm-cleaned' END AS language_source, CASE WHEN p_partkey % 7 = 0 THEN 0.7 ELSE 0.9 END::DOUBLE AS title_confidence FROM part WHERE p_partkey % 13 <> 0"""
)
def m1_merged_records(spark, sf):
    m, r, b = merged(spark, sf), F.col("rule"), F.col("merged")
    return m.select("key", F.array_join(merge.changed_fields(r, b), ",").alias("changed"), "merged.title", "merged.publisher", "merged.language", "merged.pages", F.try_element_at(merge.provenance(r, b), F.lit("language")).alias("language_source"), F.try_element_at(merge.confidence(r, b), F.lit("title")).alias("title_confidence"))


def compared(spark, sf) -> DataFrame:
    rows = merged(spark, sf).select("key", "rule", "merged", F.explode(F.array(F.lit("unrestricted"), F.lit("restricted"))).alias("mode"))
    return merge.compare_modes(rows).withColumn("ok", F.lit(True))


@query(
    """WITH r AS (SELECT unnest(['unrestricted', 'restricted']) AS mode, p_partkey % 3 = 0 AS l, p_partkey % 7 = 0 AS t, p_partkey % 2 = 0 AS i FROM part WHERE p_partkey % 13 <> 0), x AS (SELECT *, t AND mode = 'unrestricted' AS a FROM r)
SELECT mode, count(*) AS attempted, count(*) AS successful, 0::BIGINT AS failed, count(*) FILTER (l AND i) AS valid, count(*) FILTER (l AND NOT i) AS warning, count(*) FILTER (NOT l) AS invalid, count(*) FILTER (NOT l AND NOT a) AS no_change,
  count(*) FILTER (l OR a) AS any_change, count(*) FILTER (a) AS high_risk_changed, count(*) FILTER (l OR a) AS minimum_changed, count(*) FILTER (t AND mode = 'restricted') AS rejected_changes FROM x GROUP BY 1"""
)
def a15_mode_summary(spark, sf):
    return merge.mode_summary(compared(spark, sf))


@query(
    """SELECT count(*) AS both_ok, count(*) FILTER (p_partkey % 7 = 0) AS unrestricted_more, 0::BIGINT AS restricted_more, count(*) FILTER (p_partkey % 7 <> 0) AS same FROM part WHERE p_partkey % 13 <> 0"""
)
def a16_mode_pairs(spark, sf):
    return merge.mode_pairs(compared(spark, sf))


def candidates(spark, sf) -> DataFrame:
    key = F.col("key").cast("string")
    rows = merged(spark, sf).select("key", F.concat(F.lit("raw-"), key).alias("raw_record_id"), F.col("rule.book_url").alias("source_url"), F.concat(F.lit("rule-"), key).alias("rule_record_id"), F.concat(F.lit("llm-"), key).alias("model_record_id"), "rule", F.col("merged").alias("model_book"))
    p = table(spark, sf, "part").where("p_partkey % 4 <> 0")
    record = F.concat(F.lit("llm-"), F.col("p_partkey").cast("string"))
    decisions = p.select(F.when(F.col("p_partkey") % 2 == 0, record).otherwise(tx.candidate_id(record)).alias("key"), F.lit("accept").alias("decision"), F.lit("fine").alias("notes"))
    return merge.build_candidates(rows, decisions)


@query(
    f"""SELECT p_partkey AS key, {_CHANGED} AS changed, CASE WHEN p_partkey % 7 = 0 THEN 'title' ELSE '' END AS protected, CASE WHEN p_partkey % 4 <> 0 THEN 'accept' ELSE 'skip' END AS decision,
  CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 3 = 0 THEN 'accept' ELSE 'skip' END AS recommended, CASE WHEN p_partkey % 4 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 3 = 0 THEN 'prepared' ELSE 'skipped' END AS promotion_status,
  concat_ws(',', CASE WHEN p_partkey % 3 <> 0 THEN 'minimum-ingest-missing-language' END, CASE WHEN p_partkey % 2 <> 0 THEN 'missing-isbn' END, CASE WHEN p_partkey % 7 = 0 THEN 'protected-field-changed-title' END, CASE WHEN p_partkey % 4 = 0 THEN 'review-decision-not-accepted' END) AS promotion_warnings
FROM part WHERE p_partkey % 13 <> 0"""
)
def m8_promotion_candidates(spark, sf):
    text = lambda c: F.array_join(c, ",").alias(c)
    return candidates(spark, sf).select("key", text("changed"), text("protected"), "decision", "recommended", "promotion_status", text("promotion_warnings"))


@query(
    """SELECT count(*) AS candidates, count(*) FILTER (p_partkey % 4 <> 0) AS accepted, count(*) FILTER (p_partkey % 4 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 3 = 0) AS prepared,
  count(*) FILTER (NOT (p_partkey % 4 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 3 = 0)) AS skipped, count(*) FILTER (p_partkey % 7 = 0) AS protected_changed FROM part WHERE p_partkey % 13 <> 0"""
)
def a17_promotion_summary(spark, sf):
    return merge.promotion_summary(candidates(spark, sf))


# ---- volumes, runs, logs, constraints


@query(
    """WITH f AS (SELECT l_orderkey AS series, lpad(cast(l_linenumber AS string), 2, '0') AS volume_number, max('vol.' || l_linenumber || ' ' || l_partkey || '.epub') AS name FROM lineitem WHERE l_partkey % 3 <> 0 GROUP BY 1, 2),
v AS (SELECT DISTINCT l_orderkey AS series, lpad(cast(l_linenumber AS string), 2, '0') AS volume_number FROM lineitem) SELECT series, volume_number, name AS path, CASE WHEN name IS NULL THEN 'missing' ELSE 'matched' END AS file_status FROM v LEFT JOIN f USING (series, volume_number)"""
)
def j13_volume_files(spark, sf):
    l = table(spark, sf, "lineitem").withColumn("series", F.col("l_orderkey"))
    n = F.col("l_linenumber").cast("string")
    ext = F.when(F.col("l_partkey") % 3 == 0, ".txt").otherwise(".epub")
    files = l.select("series", F.concat(F.lit("vol."), n, F.lit(" "), F.col("l_partkey").cast("string"), ext).alias("name")).withColumn("path", F.col("name"))
    wanted = l.select("series", nz.pad2(n).alias("volume_number")).distinct()
    return volumes.match_files(wanted, files)


@query(
    """WITH v AS (SELECT DISTINCT l_orderkey AS series, l_linenumber AS n FROM lineitem), f AS (SELECT DISTINCT l_orderkey AS series, l_linenumber AS n, TRUE AS m FROM lineitem WHERE l_partkey % 3 <> 0)
SELECT series, count(*) AS volumes, count(*) FILTER (n % 5 = 0) AS incomplete, count(*) FILTER (m) AS matched, count(*) FILTER (m IS NULL) AS missing, count(*) FILTER (n % 5 = 0) = 0 AS ready FROM v LEFT JOIN f USING (series, n) GROUP BY 1"""
)
def a19_volume_summary(spark, sf):
    return volumes.volume_summary(j13_volume_files(spark, sf), F.col("volume_number").cast("int") % 5 != 0)


@query("SELECT p_brand AS series, p_partkey AS k, CASE WHEN n < 10 THEN '0' || n ELSE n::VARCHAR END AS v FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) x")
def w7_numbered_volumes(spark, sf):
    b = table(spark, sf, "part").select(F.col("p_brand").alias("series"), F.col("p_partkey").alias("k"), F.struct(F.col("p_name").alias("title"), F.lit("").alias("series"), F.lit("").alias("series_number")).alias("book"))
    return volumes.number_volumes(b, "k").select("series", "k", F.col("book.series_number").alias("v"))


@query("SELECT event_type AS kind, CASE WHEN value < 5 THEN 403 WHEN value < 10 THEN 404 ELSE 200 END AS status, count(*) AS requests, count(*) FILTER (event_type = 'error' OR value < 10) AS failures FROM events GROUP BY 1, 2")
def s10_request_log(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("kind"), F.when(F.col("value") < 5, 403).when(F.col("value") < 10, 404).otherwise(200).alias("status"), "value")
    return merge.request_log(e.withColumn("ok", ~((F.col("kind") == "error") | (F.col("value") < 10))))


@query("SELECT user_id, max(e) AS run_id FROM (SELECT user_id, event_id AS e, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) x WHERE n = 1 GROUP BY 1")
def w1_latest_runs(spark, sf):
    return merge.last_of(table(spark, sf, "events").withColumn("o", F.struct("ts", "event_id")), ["user_id"], "o").select("user_id", F.col("event_id").alias("run_id"))


@query("SELECT o_custkey % 20 AS run, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ROLLUP (o_custkey % 20, o_orderstatus)")
def a14_status_counts(spark, sf):
    return store.status_counts(table(spark, sf, "orders").select((F.col("o_custkey") % 20).alias("run"), F.col("o_orderstatus").alias("status")), "run")


@query("SELECT 'orders' AS \"table\", count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'customer', count(*) FROM customer")
def a13_row_counts(spark, sf):
    return store.row_counts({n: table(spark, sf, n) for n in ("orders", "lineitem", "customer")})


@query(
    """SELECT 'foreign:lineitem.l_orderkey' AS rule, count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') HAVING count(*) > 0
UNION ALL SELECT 'unique:lineitem' AS rule, count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) x HAVING count(*) > 0"""
)
def v7_constraints(spark, sf):
    l, o = table(spark, sf, "lineitem"), table(spark, sf, "orders").where("o_orderstatus <> 'P'")
    both = validate.orphans(l, "l_orderkey", o, "o_orderkey", "foreign:lineitem.l_orderkey").unionByName(validate.duplicate_keys(l, ("l_orderkey", "l_linenumber"), "unique:lineitem"))
    return both.groupBy("rule").agg(F.count("*").alias("n"))


@query(
    """WITH c AS (SELECT user_id, count(*) AS total, count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS bad, count(*) FILTER (event_type = 'view') AS v FROM events GROUP BY 1)
SELECT CASE WHEN user_id % 10 = 0 THEN 'incomplete-missing-subject-num' WHEN user_id % 10 = 1 THEN 'incomplete-list-capture' WHEN bad > 2 THEN 'incomplete-detail-capture' WHEN user_id % 10 = 2 THEN 'incomplete-row-count'
  WHEN v > 0 THEN 'complete-with-anonymous-visibility-warning' ELSE 'complete' END AS completeness_status, count(*) AS n FROM c GROUP BY 1"""
)
def a3_capture_completeness(spark, sf):
    count = lambda c: F.count_if(c)
    c = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("total"), count(F.col("event_type") == "error").alias("bad"), count(F.col("event_type") == "view").alias("v"))
    n = F.col("total") - F.when(F.col("bad") > 2, F.col("bad")).otherwise(0)
    rows = c.select(
        F.when(F.col("user_id") % 10 != 0, F.col("total")).alias("declared_total"), F.ceil(F.col("total") / 15).alias("expected_pages"), (F.ceil(F.col("total") / 15) - F.when(F.col("user_id") % 10 == 1, 1).otherwise(0)).alias("captured_list_pages"),
        F.lit(False).alias("stopped_by_cap"), F.lit(False).alias("stopped_by_missing_next"), (F.col("total") - n).alias("detail_failures"), n.alias("details_succeeded"), F.col("total").alias("details_attempted"), n.alias("visible_links"),
        (n + F.when(F.col("user_id") % 10 == 2, 1).otherwise(0)).alias("raw_records"), F.col("v").alias("visible_deficit"), F.array().cast("array<string>").alias("discovery_warnings"),
    )
    return lists.capture_completeness(rows).groupBy("completeness_status").agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (html ILIKE '%captcha%') AS challenges, count(*) AS pages FROM pages")
def e19_challenges(spark, sf):
    return table(spark, sf, "pages").agg(F.count_if(pages.is_challenge(F.col("html"), ("captcha",))).alias("challenges"), F.count("*").alias("pages"))
