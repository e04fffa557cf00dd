"""More registered queries: names, page parts, ids, audits, review and statistics, each with the SQL that it must equal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import creators as cr
from ..functions import normalize as nz
from ..functions import text as tx
from ..operators import coverage, exports, lists, matching, merge, pages, validate, volumes
from ..schemas import CREATORS
from ..sources import store
from . import synth
from .queries import QUERIES, _ENTRIES, _FIELDS, _GATE, _LABELS, _MATCH, _STATUS, candidates, cleaned_records, compared, diagnosed, incoming, merged, parsed_pages, proposals, query, samples, stored_samples
from .synth import run_sql, table


def _cases(key: str, *values: Column | str) -> Column:
    """One of the values, by the key's remainder."""
    return F.element_at(F.array(*(F.lit(v) if isinstance(v, str) else v for v in values)), (F.col(key) % len(values) + 1).cast("int"))


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# ---- names: digits of a key become ideographs

_HAN = "'赵钱孙李周吴郑王冯陈'"
_NAMES = f"(SELECT c_custkey AS k, translate(cast(c_custkey AS string), '0123456789', {_HAN}) AS z FROM customer) c"


def _names(spark, sf) -> DataFrame:
    return synth.dealt(spark, run_sql(spark, sf, f"SELECT * FROM {_NAMES}"), "k")


@query(f"SELECT k, k % 3 <> 2 AS east, CASE WHEN k % 3 = 0 THEN z ELSE z || '·' || z END AS dotted FROM {_NAMES}")
def c1_scripts_and_dots(spark, sf):
    n = _names(spark, sf)
    name = _cases("k", F.col("z"), F.concat("z", F.lit(" • "), "z"), F.concat(F.lit("Ann "), "z"))
    dotted = _cases("k", F.col("z"), F.concat("z", F.lit(" • "), "z"), F.concat("z", F.lit("・"), "z"))
    return n.select("k", cr.is_east_asian(name).alias("east"), cr.unify_dots(dotted).alias("dotted"))


@query(f"SELECT k, z AS name, CASE k % 3 WHEN 0 THEN '法' WHEN 1 THEN '美' END AS nation FROM {_NAMES}")
def c2_nationalities(spark, sf):
    name = _cases("k", F.concat(F.lit("[法] "), "z"), F.concat(F.lit("（美）"), "z"), F.col("z"))
    return _names(spark, sf).select("k", cr.remove_nationality(name).alias("name"), cr.nationality(name).alias("nation"))


@query(f"SELECT k, z AS clean, CASE k % 4 WHEN 0 THEN 'author' WHEN 2 THEN 'editor' END AS role, CASE k % 4 WHEN 0 THEN 'author' WHEN 1 THEN 'translator' WHEN 2 THEN 'editor' END AS labelled FROM {_NAMES}")
def c5_roles(spark, sf):
    role = cr.role_suffix(_cases("k", F.concat("z", F.lit(" 著")), F.concat("z", F.lit(" 等")), F.concat("z", F.lit("（编）")), F.col("z")))
    return _names(spark, sf).select("k", role["clean"].alias("clean"), role["role"].alias("role"), cr.label_role(_cases("k", "作者:", " 译者", "编者：", "页数")).alias("labelled"))


@query(f"SELECT k, z AS clean, CASE WHEN k % 2 = 0 THEN 'John ' || k END AS original, z AS no_alias, z || z AS squeezed FROM {_NAMES}")
def c7_original_names(spark, sf):
    o = cr.original_name(_cases("k", F.concat("z", F.lit("（John "), _text("k"), F.lit("）")), F.col("z")))
    return _names(spark, sf).select("k", o["clean"].alias("clean"), o["original"].alias("original"), cr.strip_latin_alias(F.concat("z", F.lit(" John Smith"))).alias("no_alias"), cr.squeeze_east_asian(F.concat("z", F.lit(" "), "z")).alias("squeezed"))


@query(f"SELECT k, CASE k % 3 WHEN 0 THEN z || '|' || z || '一' WHEN 1 THEN z || '|二' || z || '|三' || z ELSE z END AS names FROM {_NAMES}")
def c9_split_names(spark, sf):
    raw = _cases("k", F.concat("z", F.lit(" / "), "z", F.lit("一")), F.concat("z", F.lit("、二"), "z", F.lit("，三"), "z"), F.concat("z", F.lit(" / John Smith")))
    split = cr.with_names(_names(spark, sf), cr.name_list(raw, F.lit("author")))
    return split.select("k", F.array_join(F.transform("names", lambda n: n["raw"]), "|").alias("names"))


def _shown(creators: Column) -> Column:
    return F.array_join(F.transform(creators, lambda c: F.concat_ws("/", c["creator_type"], c["first_name"], c["last_name"], _text(c["field_mode"]))), ";")


@query(f"SELECT k, CASE k % 2 WHEN 0 THEN 'author/' || z || '/' || z || '/0' ELSE 'author//' || z || '/1' END AS creator FROM {_NAMES}")
def c10_creators(spark, sf):
    raw = _cases("k", F.concat("z", F.lit("·"), "z"), F.col("z"))
    made = cr.with_names(_names(spark, sf), cr.name_list(raw, F.lit("author")), whole=True)
    return made.select("k", _shown(cr.creators_of(F.col("names"))).alias("creator"))


@query(f"SELECT k, 'author//' || z || '/1' AS creators, 'John' AS notes FROM {_NAMES}")
def c11_creators_with_notes(spark, sf):
    made = cr.with_names(_names(spark, sf), cr.name_list(F.concat("z", F.lit("（John） 著")), F.lit("author")))
    made = made.withColumn("names", cr.first_of_list(F.col("names")))
    return made.select("k", _shown(cr.creators_of(F.col("names"))).alias("creators"), F.array_join(cr.notes_of(F.col("names")), ",").alias("notes"))


@query(f"SELECT k, 'author//' || z || '樹/1' AS creators FROM {_NAMES}")
def c12_variants(spark, sf):
    made = cr.with_names(_names(spark, sf), cr.name_list(F.concat("z", F.lit("树/"), "z", F.lit("樹")), F.lit("author")))
    return made.select("k", _shown(cr.preferred(F.col("names"))).alias("creators"))


def _people(*who: tuple[str, Column]) -> Column:
    return F.array(*(F.struct(F.lit("").alias("first_name"), name.alias("last_name"), F.lit(role).alias("creator_type"), F.lit(1).alias("field_mode"), F.lit(None).cast("boolean").alias("needs_review")) for role, name in who)).cast(CREATORS)


@query(f"SELECT k, 'author//' || z || '/1;editor//' || z || '一/1' AS creators, z AS authors, 'author:1;editor:2' AS counts FROM {_NAMES}")
def c13_role_aliases(spark, sf):
    who = _people(("author", F.col("z")), ("editor", F.col("z")), ("editor", F.concat("z", F.lit("一"))))
    counts = F.array_join(F.transform(cr.role_counts(who), lambda r: F.concat(r["role"], F.lit(":"), _text(r["n"]))), ";")
    return _names(spark, sf).select("k", _shown(cr.dedupe_roles(who)).alias("creators"), F.array_join(cr.display_names(who, "author"), ";").alias("authors"), counts.alias("counts"))


# ---- page parts


def _raw_pages(spark, sf) -> DataFrame:
    return pages.extract(synth.detail_pages(spark, sf))


@query(
    f"""SELECT e[1] AS label, count(*) AS n, max(e[2]) AS largest FROM (SELECT unnest([['作者', author], ['出版社', publisher], ['副标题', subtitle], ['译者', translator], ['出版年', date_raw], ['页数', pages], ['丛书', series], ['ISBN', isbn], ['语言', language]]) AS e
FROM ({synth.PAGE_FIELDS}) f WHERE NOT broken) x WHERE e[2] <> '' GROUP BY 1"""
)
def e1_info_entries(spark, sf):
    # outer, then filtered: an inner explode would pull the page helper into a filter
    rows = _raw_pages(spark, sf).select(F.explode_outer(pages.info_entries(F.col("raw.info_html"))).alias("e")).where("e is not null")
    return rows.groupBy(F.col("e.label").alias("label")).agg(F.count("*").alias("n"), F.max("e.value").alias("largest"))


@query(f"SELECT k, main_title AS title, CASE WHEN broken THEN '' ELSE series END AS series, 'About ' || main_title || '.' AS abstract, cast(1000000 + k AS string) AS subject_id FROM ({synth.PAGE_FIELDS}) f")
def e2_page_parts(spark, sf):
    r = _raw_pages(spark, sf)
    return r.select("k", pages.page_title(F.col("raw")).alias("title"), F.coalesce("raw.series", F.lit("")).alias("series"), F.col("raw.abstract").alias("abstract"), tx.subject_id(F.col("url")).alias("subject_id"))


_KINDS = "SELECT p_partkey AS k, p_partkey % 4 AS m, p_name AS n, p_type AS t FROM part"


@query(f"SELECT k, CASE m WHEN 0 THEN n || ': ' || t WHEN 1 THEN n || '：' || t WHEN 2 THEN n ELSE '书' || n || '：' || t END AS title FROM ({_KINDS}) x")
def e8_subtitles(spark, sf):
    title = _cases("k", F.col("n"), F.concat("n", F.lit("："), "t"), F.col("n"), F.concat(F.lit("书"), "n"))
    return run_sql(spark, sf, _KINDS).select("k", pages.merge_subtitle(title, _cases("k", F.col("t"), F.col("t"), F.lit(" "), F.col("t"))).alias("title"))


@query(f"SELECT label, count(*) AS n FROM ({_LABELS}) l GROUP BY 1")
def e9_info_labels(spark, sf):
    rows = _raw_pages(spark, sf).select(F.explode_outer("raw.entries").alias("e")).where("e is not null")
    return rows.groupBy(F.col("e.label").alias("label")).agg(F.count("*").alias("n"))


_PAGE_LINKS = f"SELECT uid, page, row_number() OVER (PARTITION BY uid, page ORDER BY p) AS position, 'https://book.example.org/subject/' || subject || '/' AS url, 'Book ' || subject AS title FROM (SELECT uid, page, subject, min(pos) AS p FROM ({_ENTRIES}) e GROUP BY 1, 2, 3) f"


@query(_PAGE_LINKS)
def e11_list_links(spark, sf):
    return synth.list_pages(spark, sf).select("uid", "page", F.posexplode(lists.list_links(F.col("html"))).alias("i", "l")).select("uid", "page", (F.col("i") + 1).cast("long").alias("position"), "l.url", "l.title")


@query(_PAGE_LINKS)
def e12_parsed_links(spark, sf):
    rows = synth.list_pages(spark, sf).select("uid", "page", F.explode_outer(lists.dom_links(F.col("html"))).alias("l")).where("l is not null")
    return rows.select("uid", "page", F.col("l.position").cast("long").alias("position"), "l.url", "l.title")


@query(
    f"""SELECT uid, page, cast(page * 15 + 1 AS bigint) AS first, page * 15 + count(*) AS last, max(n) AS total,
  CASE WHEN (page + 1) * 15 < max(n) THEN 'https://book.example.org/people/' || uid || '/wish?start=' || (page + 1) * 15 END AS next_url FROM ({_ENTRIES}) e GROUP BY uid, page"""
)
def e13_counters_and_next(spark, sf):
    r = synth.list_pages(spark, sf).select("uid", "page", lists.counter(F.col("html")).alias("c"), lists.next_page(F.col("html")).alias("next_url"))
    return r.select("uid", "page", *(F.col(f"c.{a}").cast("long").alias(b) for a, b in (("start", "first"), ("end", "last"), ("total", "total"))), "next_url")


def _series_pages(spark, sf) -> DataFrame:
    """A series page an order, its lines as volumes."""
    anchor = F.concat(F.lit('<a href="https://book.example.org/subject/'), _text("l_partkey"), F.lit('/">Part '), _text("l_partkey"), F.lit("</a>"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", anchor.alias("a")))), lambda s: s["a"])
    made = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(lines.alias("a"))
    text = F.concat(F.lit("<h1><i>Order</i> "), _text("l_orderkey"), F.lit('</h1><div class="subject-list">'), F.array_join("a", ""), F.lit('</div> <div class="paginator">册数: '), _text(F.size("a")))
    return made.select("l_orderkey", text.alias("html"))


@query("SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY n, l_partkey) AS position, 'https://book.example.org/subject/' || l_partkey || '/' AS url, 'Part ' || l_partkey AS title FROM (SELECT l_orderkey, l_partkey, min(l_linenumber) AS n FROM lineitem GROUP BY 1, 2) x")
def e16_series_links(spark, sf):
    return _series_pages(spark, sf).select("l_orderkey", F.posexplode(lists.series_links(F.col("html"))).alias("i", "l")).select("l_orderkey", (F.col("i") + 1).cast("long").alias("position"), "l.url", "l.title")


@query("SELECT l_orderkey, 'Order ' || l_orderkey AS name, count(*) AS volumes, FALSE AS has_next FROM lineitem GROUP BY 1")
def e17_series_info(spark, sf):
    return _series_pages(spark, sf).select("l_orderkey", lists.series_info(F.col("html")).alias("s")).select("l_orderkey", "s.name", F.col("s.count").cast("long").alias("volumes"), "s.has_next")


@query("SELECT c_custkey AS k, CASE c_custkey % 2 WHEN 0 THEN 'u-' || c_custkey ELSE '' END AS owner FROM customer")
def e20_list_owners(spark, sf):
    c = table(spark, sf, "customer").withColumn("k", F.col("c_custkey"))
    url = _cases("k", F.concat(F.lit("https://book.example.org/people/u%2D"), _text("k"), F.lit("/wish?start=15#x")), F.concat(F.lit("https://book.example.org/subject/"), _text("k")))
    return c.select("k", tx.owner_id(url).alias("owner"))


# ---- scalars


@query(f"SELECT k, concat_ws(',', replace(raw, '-', ''), CASE WHEN expected <> replace(raw, '-', '') THEN expected END) AS keys, CASE WHEN k % 2 = 0 THEN TRUE END AS shared FROM ({synth.ISBNS}) i")
def n5_isbn_keys(spark, sf):
    i = run_sql(spark, sf, synth.ISBNS)
    keys = nz.isbn_keys(F.col("raw"))
    return i.select("k", F.array_join(keys, ",").alias("keys"), nz.share_isbn(keys, nz.isbn_keys(F.when(F.col("k") % 2 == 0, F.col("raw")))).alias("shared"))


@query("SELECT p_partkey AS k, p_name || ' x' AS counted, p_name || 'x' AS stripped FROM part")
def n14_stripped_text(spark, sf):
    wrap = lambda tail: F.concat(F.lit(" <b class='a'>"), "p_name", F.lit(f"</b>{tail}<i>x</i>\n"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), tx.count_text(wrap("&nbsp;&#160; ")).alias("counted"), tx.strip_tags(wrap("")).alias("stripped"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_partkey % 4 IN (0, 1) GROUP BY 1, 2")
def n16_supported_files(spark, sf):
    l = table(spark, sf, "lineitem").withColumn("name", F.concat(F.lit("v"), _text("l_linenumber"), _cases("l_partkey", ".EPUB", ".pdf", ".txt", "pdf")))
    return volumes.supported_files(l).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS k, o_orderkey % 100 * 15 AS start, 'https://book.example.org/people/u/wish?x=1&start=' || (o_orderkey % 100 * 15 + 15) AS url FROM orders")
def n18_page_addresses(spark, sf):
    o = table(spark, sf, "orders").withColumn("url", F.concat(F.lit("https://book.example.org/people/u/wish?start="), _text(F.col("o_orderkey") % 100 * 15), F.lit("&x=1")))
    start = tx.start_offset(F.col("url"))
    return o.select(F.col("o_orderkey").alias("k"), start.cast("long").alias("start"), tx.page_url(F.col("url"), start + 15).alias("url"))


@query("SELECT o_orderkey AS k, 'a-b-' || o_orderkey || '-x' AS safe, 'candidate-' || substr(sha256('llm-' || o_orderkey), 1, 12) AS candidate, replace(substr(cast(o_orderdate AS string), 1, 10), '-', '') || '-000000' AS stamp FROM orders")
def n19_record_ids(spark, sf):
    k = _text("o_orderkey")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), tx.safe_id(F.concat(F.lit("a/b  "), k, F.lit("::x"))).alias("safe"), tx.candidate_id(F.concat(F.lit("llm-"), k)).alias("candidate"), tx.stamp(F.to_timestamp(F.to_date("o_orderdate"))).alias("stamp"))


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 5 <> 0 THEN 'a,b' || p_partkey END AS tags, CASE WHEN p_partkey % 5 <> 0 THEN 'author//L' || p_partkey || '/0' END AS creators, CASE WHEN p_partkey % 5 <> 0 THEN 'T ' || p_partkey END AS title FROM part")
def n20_model_values(spark, sf):
    k = _text("p_partkey")
    good = F.concat(F.lit('Sure: {"tags": [" a ", 1, "", "b'), k, F.lit('"], "title": " T '), k, F.lit(' ", "creators": [{"creatorType": "author", "lastName": "L'), k, F.lit('"}, {"creatorType": "x", "lastName": "Q"}, 5]} done'))
    v = merge.json_object(F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("{"), good)).otherwise(good))
    p = table(spark, sf, "part").withColumn("v", v)
    return p.select(F.col("p_partkey").alias("k"), F.array_join(merge.clean_strings(F.col("v"), "$.tags"), ",").alias("tags"), _shown(merge.clean_creators(F.col("v"))).alias("creators"), merge.variant_string(F.col("v"), "$.title").alias("title"))


@query(r"SELECT p_partkey AS k, '  title = {\{' || p_name || '\}}' AS line FROM part")
def n23_bib_fields(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), tx.bib_field("title", F.concat(F.lit("{"), "p_name", F.lit("}"))).alias("line"))


# ---- stored rows


@query(f"SELECT 'raw-' || (1000000 + k) AS raw_record_id, cast(1000000 + k AS string) AS subject_id, sha256(html) AS raw_html_sha256, CASE WHEN k % 2 = 0 THEN 'u' || k END AS list_owner_id, CASE WHEN k % 2 = 0 THEN k END AS position FROM ({synth.PAGES}) p")
def s3_raw_records(spark, sf):
    p = run_sql(spark, sf, synth.PAGES)
    context = p.where("k % 2 = 0").select("url", F.lit("l").alias("list_url"), F.lit("t").alias("list_title"), F.col("k").alias("position"), F.concat(F.lit("u"), _text("k")).alias("owner_id"))
    rows = pages.raw_records(p.select("url", "html"), parsed_pages(spark, sf), context, "run-1")
    return rows.select("raw_record_id", "subject_id", "raw_html_sha256", "list_owner_id", F.get_json_object("list_context_json", "$.position").try_cast("long").alias("position"))


@query(
    """SELECT 'raw-' || p_partkey AS raw_record_id, sha256(CASE WHEN p_partkey % 3 = 0 THEN 'u' || p_partkey || chr(10) || p_partkey ELSE p_name END) AS raw_html_sha256,
  CASE WHEN p_partkey % 2 = 0 THEN 'rule-' || p_partkey END AS rule_id, 'model-' || p_partkey AS model_id FROM part"""
)
def s8_comparison_records(spark, sf):
    k = _text("p_partkey")
    records = table(spark, sf, "part").select(k.alias("id"), F.concat(F.lit("u"), k).alias("url"), _cases("p_partkey", F.lit(""), F.col("p_name"), F.col("p_name")).alias("html"), F.when(F.col("p_partkey") % 2 == 0, "{}").alias("rule_json"), F.lit("{}").alias("model_json"))
    raw, rule, model = store.comparison_rows(records, "run-1")
    ids = lambda df, name: df.select("raw_record_id", F.col("cleaned_record_id").alias(name))
    return raw.select("raw_record_id", "raw_html_sha256").join(ids(rule, "rule_id"), "raw_record_id", "left").join(ids(model, "model_id"), "raw_record_id", "left")


@query(
    """WITH d AS (SELECT l_orderkey || '-' || l_linenumber % 3 AS key, ['accept', 'skip', 'later'][l_partkey % 3 + 1] AS decision, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 2 = 0, l_linenumber, l_partkey) AS pos FROM lineitem)
SELECT key, arg_max(decision, pos) AS decision, cast(arg_max(p, pos) AS string) AS notes FROM d WHERE decision <> 'later' GROUP BY 1"""
)
def s9_review_decisions(spark, sf):
    d = F.struct(F.concat(_text("l_orderkey"), F.lit("-"), _text(F.col("l_linenumber") % 3)).alias("model_record_id"), F.lit(None).cast("string").alias("candidate_id"), _cases("l_partkey", "accept", "skip", "later").alias("decision"), _text("l_partkey").alias("notes"))
    some = lambda odd: F.transform(F.array_sort(F.collect_list(F.when(F.col("l_linenumber") % 2 == odd, F.struct("l_linenumber", "l_partkey", d.alias("d"))))), lambda s: s["d"])
    return merge.review_decisions(table(spark, sf, "lineitem").groupBy("l_orderkey").agg(some(1).alias("decisions"), some(0).alias("candidates")))


@query(
    f"""SELECT 'raw-' || g.book_key AS raw_record_id, g.book_key % 100 AS position, 'Inspection' || chr(10) || 'record: cleaned-' || g.book_key || chr(10) || 'source: s' || chr(10) || 'status: ' ||
  CASE WHEN gate_warnings <> '' THEN 'invalid' WHEN isbn IS NULL THEN 'warning' ELSE 'valid' END || chr(10) || 'warnings: ' || replace(concat_ws(',', nullif(gate_warnings, ''), CASE WHEN isbn IS NULL THEN 'missing-isbn' END), ',', ', ') AS note
FROM ({_GATE}) g WHERE g.book_key % 4 = 0"""
)
def s11_inspection_export(spark, sf):
    k = _text("book_key")
    rows = incoming(spark, sf).withColumns({"cleaned_record_id": F.concat(F.lit("cleaned-"), k), "raw_record_id": F.concat(F.lit("raw-"), k), "cleaning_run_id": F.when(F.col("book_key") % 4 == 0, "r1").otherwise("r2")})
    raw = rows.select("raw_record_id", F.lit("s").alias("source_url"), k.alias("subject_id"), F.to_json(F.struct((F.col("book_key") % 100).alias("position"))).alias("list_context_json"))
    made = exports.inspection_export(rows, raw, "r1")
    return made.select("raw_record_id", F.col("position").cast("long").alias("position"), F.element_at("payload.notes", -1)["note"].alias("note"))


@query(f"SELECT k, title, publish_date AS date, coalesce(isbn, '') AS isbn, url, 'Catalog' AS catalog, 0::BIGINT AS notes FROM ({_FIELDS}) x WHERE NOT broken")
def y1_payloads(spark, sf):
    p = cleaned_records(spark, sf).select("k", exports.payload(F.col("book")).alias("p"))
    f = F.col("p.fields")
    return p.select("k", f["title"].alias("title"), f["date"].alias("date"), f["ISBN"].alias("isbn"), f["url"].alias("url"), f["libraryCatalog"].alias("catalog"), F.size("p.notes").cast("long").alias("notes"))


# ---- audits


@query(f"SELECT book_key, concat_ws(',', CASE WHEN book_key % 3 = 0 THEN 'missing-title' END, CASE WHEN book_key % 4 = 0 THEN 'missing-url' END, CASE WHEN book_key % 5 = 0 THEN 'creators-not-array' END) AS warnings FROM ({synth.BOOKS}) b")
def v4_payload_warnings(spark, sf):
    none = lambda n, then, other: F.when(F.col("book_key") % n == 0, then).otherwise(other)
    book = F.col("book").withField("title", none(3, F.lit(""), F.col("book.title"))).withField("book_url", none(4, F.lit(None), F.lit("u"))).withField("creators", none(5, F.lit(None), F.col("book.creators")))
    return incoming(spark, sf).select("book_key", F.array_join(validate.payload_warnings(exports.payload(book)), ",").alias("warnings"))


@query(f"SELECT book_key, '\"' || b.title || '\": Incomplete metadata: ' || replace(gate_warnings, ',', ', ') AS error FROM ({_GATE}) g JOIN ({synth.BOOKS}) b USING (book_key) WHERE gate_warnings <> ''")
def v5_write_errors(spark, sf):
    return validate.write_errors(incoming(spark, sf)).select("book_key", "error")


def _imports(spark, sf) -> DataFrame:
    part = table(spark, sf, "part").withColumn("k", F.col("p_partkey"))
    note = F.when(F.col("k") % 3 == 0, F.array(F.lit("minimum-ingest-missing-date"))).otherwise(F.array().cast("array<string>"))
    bad = F.when(F.col("k") % 5 == 0, F.array(F.lit("missing-url"))).otherwise(F.array().cast("array<string>"))
    return part.select(_text("k").alias("import_record_id"), F.when(F.col("k") % 2 == 0, "prepared").otherwise("skipped").alias("status"), note.alias("warnings"), bad.alias("payload_warnings"), F.concat(F.lit("run-"), _text(F.col("k") % 2)).alias("import_run_id"))


def _import_runs(spark, sf) -> DataFrame:
    name = _cases("o_orderkey", "shelfmark 1.0 a 20260101-120000", "other 1.0 a 20260101-120000")
    return table(spark, sf, "orders").select(F.concat(F.lit("run-"), _text("o_orderkey")).alias("import_run_id"), F.to_json(F.struct(name.alias("targetCollectionName"))).alias("settings_json"))


@query(
    """SELECT * FROM (SELECT 'missing-export-format' AS rule, 1::BIGINT AS n UNION ALL SELECT 'run-not-in-mode', count(*) FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT 'collection-name', count(*) FROM orders WHERE o_orderkey % 2 = 1
UNION ALL SELECT 'prepared-with-minimum-warning', count(*) FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 = 0 UNION ALL SELECT 'skipped-without-minimum-warning', count(*) FROM part WHERE p_partkey % 2 = 1 AND p_partkey % 3 <> 0
UNION ALL SELECT 'invalid-payload', count(*) FROM part WHERE p_partkey % 5 = 0) x WHERE n > 0"""
)
def v6_pipeline_audit(spark, sf):
    made = table(spark, sf, "part").select(_cases("p_partkey", "catalog-json", "bibtex").alias("format"))
    runs = table(spark, sf, "customer").select(_text("c_custkey").alias("run_id"), F.when(F.col("c_custkey") % 5 == 0, "live").otherwise("dry-run").alias("execution_mode"))
    return validate.audit_pipeline(made, runs, _import_runs(spark, sf), _imports(spark, sf)).groupBy("rule").agg(F.count("*").alias("n"))


@query(
    """SELECT * FROM (SELECT 'minimum-warning' AS rule, count(*) AS n FROM part WHERE p_partkey % 6 = 0 UNION ALL SELECT 'invalid-payload', count(*) FROM part WHERE p_partkey % 10 = 0) x WHERE n > 0"""
)
def v10_write_ready(spark, sf):
    return validate.write_ready(_imports(spark, sf), _import_runs(spark, sf)).groupBy("rule").agg(F.count("*").alias("n"))


@query(
    f"""SELECT book_key AS id, CASE WHEN book_key % 7 = 0 THEN 'missing-item' ELSE concat_ws(',', CASE WHEN book_key % 3 = 0 THEN 'field-title' END, CASE WHEN book_key % 5 = 0 AND has_author THEN 'creators' END, CASE WHEN book_key % 4 = 0 THEN 'collection' END) END AS differences
FROM ({synth.BOOKS}) b"""
)
def v9_reconciled_items(spark, sf):
    k = F.col("book_key")
    p = incoming(spark, sf).select(k.alias("id"), exports.payload(F.col("book")).alias("p")).select("id", "p.fields", "p.creators", "p.notes", F.lit("c").alias("collection"))
    i = F.col("id")
    items = p.where(i % 7 != 0).select(
        "id", F.col("fields").withField("title", F.when(i % 3 == 0, "changed").otherwise(F.col("fields.title"))).alias("fields"), F.when(i % 5 == 0, F.array().cast(CREATORS)).otherwise(F.col("creators")).alias("creators"), "notes",
        F.array(F.when(i % 4 == 0, "d").otherwise("c")).alias("collections"),
    )
    return validate.reconcile(items, p).select("id", F.array_join("differences", ",").alias("differences"))


# ---- matching and record joins


@query(_MATCH + "SELECT book_key, item_id FROM ex")
def j1_isbn_matches(spark, sf):
    return matching.isbn_matches(incoming(spark, sf), run_sql(spark, sf, synth.LIBRARY)).select("book_key", "item_id")


@query(_MATCH + "SELECT book_key, item_id, round(confidence, 6) AS confidence FROM r WHERE n = 1")
def j2_title_matches(spark, sf):
    b, library = incoming(spark, sf), run_sql(spark, sf, synth.LIBRARY)
    rest = b.join(matching.isbn_matches(b, library).select("book_key"), "book_key", "left_anti")
    return matching.title_matches(rest, library).select("book_key", "item_id", F.round("confidence", 6).alias("confidence"))


def _stored(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rule and model records of every part, their runs (a run of models belongs to another pipeline), and raw rows."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), "p_name")
    kinds = p.withColumn("kind", F.explode(F.array(F.lit("rule"), F.lit("llm"))))
    run = F.concat("kind", F.lit("-"), _text(F.col("k") % 5))
    cleaned = kinds.select(F.concat("kind", F.lit("-r"), _text("k")).alias("cleaned_record_id"), run.alias("cleaning_run_id"), F.concat(F.lit("raw-"), _text("k")).alias("raw_record_id"), F.struct(F.col("p_name").alias("title")).alias("book"))
    pipeline = F.when((F.col("kind") == "llm") & (F.col("k") % 5 == 4), "other").otherwise(F.concat(F.lit("p-"), _text(F.col("k") % 5)))
    runs = kinds.select(run.alias("cleaning_run_id"), pipeline.alias("pipeline_run_id"), F.col("kind").alias("cleaner_kind")).distinct()
    raw = p.select(F.concat(F.lit("raw-"), _text("k")).alias("raw_record_id"), F.concat(F.lit("u"), _text("k")).alias("source_url"), F.col("p_name").alias("raw_html"))
    return cleaned, runs, raw


@query("SELECT 'raw-' || p_partkey AS raw_record_id, 'rule-r' || p_partkey AS rule_record_id, 'llm-r' || p_partkey AS model_record_id, 'u' || p_partkey AS source_url FROM part WHERE p_partkey % 5 <> 4")
def j6_record_pairs(spark, sf):
    return merge.candidate_rows(*_stored(spark, sf)).select("raw_record_id", "rule_record_id", "model_record_id", "source_url")


@query("SELECT 'raw-' || p_partkey AS raw_record_id, 'rule-r' || p_partkey AS cleaned_record_id, p_name AS raw_html FROM part WHERE p_partkey % 5 = 1")
def j8_records_to_clean(spark, sf):
    return merge.source_rows(*_stored(spark, sf), run_id="rule-1").select("raw_record_id", "cleaned_record_id", "raw_html")


@query("SELECT count(DISTINCT p_partkey % 5) AS pipeline_runs FROM part")
def j9_replay_pipelines(spark, sf):
    return merge.pipelines_behind(merge.source_rows(*_stored(spark, sf), kind="llm"))


@query("SELECT c_custkey AS pos, c_custkey AS id, CASE WHEN s_suppkey IS NULL THEN 'missing' ELSE 'found' END AS state FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def j10_chosen_records(spark, sf):
    ids = table(spark, sf, "customer").select(F.col("c_custkey").alias("pos"), F.col("c_custkey").alias("id"))
    found, missing = merge.select_records(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")), ids)
    return found.select("pos", "id", F.lit("found").alias("state")).unionByName(missing.select("pos", "id", F.lit("missing").alias("state")))


# ---- model records


@query("""SELECT p_partkey AS key, CASE WHEN p_partkey % 7 = 0 THEN 'title' ELSE '' END AS rejected, p_name AS title, CASE WHEN p_partkey % 3 = 0 THEN 'en' END AS language FROM part WHERE p_partkey % 13 <> 0""")
def m2_restricted_records(spark, sf):
    r = merged(spark, sf).withColumn("r", merge.restrict(F.col("rule"), F.col("merged")))
    return r.select("key", F.array_join("r.rejected", ",").alias("rejected"), "r.book.title", "r.book.language")


@query("SELECT p_partkey AS key, CASE WHEN p_partkey % 3 = 0 THEN 'en' END AS language, p_partkey % 3 = 0 AS preserved FROM part WHERE p_partkey % 13 <> 0")
def m6_replayed_records(spark, sf):
    r = merged(spark, sf).withColumn("r", merge.replay(F.col("rule"), F.col("merged")))
    return r.select("key", "r.book.language", "r.preserved")


@query("SELECT mode, field, count(*) AS n FROM (SELECT unnest(['unrestricted', 'restricted']) AS mode, 'language' AS field FROM part WHERE p_partkey % 13 <> 0 AND p_partkey % 3 = 0 UNION ALL SELECT 'unrestricted', 'title' FROM part WHERE p_partkey % 13 <> 0 AND p_partkey % 7 = 0) x GROUP BY 1, 2")
def m7_field_changes(spark, sf):
    return merge.field_changes(compared(spark, sf), "minimum")


@query(
    """SELECT 'export-catalog-json-candidate-' || substr(sha256('llm-' || p_partkey), 1, 12) AS export_record_id, 'llm-' || p_partkey AS cleaned_record_id, CASE WHEN p_partkey % 2 = 0 THEN 'valid' ELSE 'warning' END AS validation_status, 'prepared' AS import_status
FROM part WHERE p_partkey % 13 <> 0 AND p_partkey % 4 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 3 = 0"""
)
def m9_promotion_rows(spark, sf):
    exported, imported = merge.promotion_rows(candidates(spark, sf))
    return exported.select("export_record_id", "cleaned_record_id", "validation_status").join(imported.select("export_record_id", F.col("status").alias("import_status")), "export_record_id")


@query(f"""SELECT p_partkey AS key, '{{"ruleMetadata":{{"title":"' || p_name || '"}},"readableText":"' || p_type || '","policy":"restricted"}}' AS user_payload, sha256('{merge.PROMPT}' || chr(10) || 'restricted') AS template_hash FROM part""")
def m10_model_requests(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.struct(F.col("p_name").alias("title")).alias("book"), F.col("p_type").alias("readable"))
    return merge.requests(rows, "restricted").select("key", "user_payload", "template_hash")


@query("SELECT CASE WHEN p_partkey % 3 <> 0 THEN 'invalid' WHEN p_partkey % 2 = 0 THEN 'valid' ELSE 'warning' END AS status, count(*) AS n, count(*) FILTER (p_partkey % 3 = 0 OR p_partkey % 7 = 0) AS changed FROM part WHERE p_partkey % 13 <> 0 GROUP BY 1")
def m12_cleaned_rows(spark, sf):
    p = proposals(spark, sf)
    answers = merge.responses(p).where("ok").select("key", "model")
    return merge.clean_rows(p.select("key", F.col("rule").alias("book")), answers, "key").groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.size("changed") > 0).alias("changed"))


# ---- statistics and selections


@query(
    f"""SELECT uid AS person, page AS page_index, cast(page * 15 + 1 AS bigint) AS expected_start, least((page + 1) * 15, max(n)) AS expected_end, count(*) AS range_size, count(DISTINCT subject) AS visible, count(*) - count(DISTINCT subject) AS deficit, TRUE AS total_matches
FROM ({_ENTRIES}) e GROUP BY uid, page"""
)
def a4_page_checks(spark, sf):
    d = lists.page_checks(diagnosed(spark, sf).withColumnsRenamed({"uid": "person", "page": "page_index", "n": "declared_total"}))
    return d.select("person", "page_index", *(F.col(c).cast("long").alias(a) for c, a in (("expected_start", "expected_start"), ("expected_end", "expected_end"), ("range_size", "range_size"), ("visible_links", "visible"), ("deficit", "deficit"))), "total_matches")


@query(f"SELECT count(*) AS total, count(*) FILTER (cohort = 'old') AS old, count(*) FILTER (cohort = 'new') AS \"new\", count(DISTINCT k) AS subjects FROM ({_STATUS}) s")
def a12_sample_counts(spark, sf):
    return coverage.sample_counts(samples(spark, sf), ("old", "new"))


@query(f"SELECT 'b' || k % 3 AS batch, count(*) AS n FROM ({_STATUS}) s GROUP BY 1")
def a12_batches(spark, sf):
    return coverage.by_batch(samples(spark, sf))


@query(f"SELECT cast(k AS string) AS subject_id, 'b' || k % 3 AS batch, cohort, gate = '' AS eligible, nullif(publisher, '') AS publisher, nullif(publish_date, '') AS publish_date, language, series, NULL::VARCHAR AS original_title FROM ({_STATUS}) s")
def a20_report_rows(spark, sf):
    return coverage.report_rows(samples(spark, sf)).select("subject_id", "batch", "cohort", "eligible", *(f"parsed.{n}" for n in ("publisher", "publish_date", "language", "series", "original_title")))


@query(f"SELECT DISTINCT label FROM ({_LABELS}) a WHERE cohort = 'old' AND label NOT IN (SELECT label FROM ({_LABELS}) b WHERE cohort = 'new')")
def x1_labels_of_one_cohort(spark, sf):
    return coverage.new_labels(stored_samples(spark, sf), "new", "old")


@query(f"SELECT cast(k AS string) AS subject_id, k % 5 <> 0 AS outside FROM ({_STATUS}) s WHERE k % 5 <> 0 OR cohort = 'new'")
def x2_outside_and_inside(spark, sf):
    s = stored_samples(spark, sf)
    chosen = s.where("k % 5 = 0").select("subject_id")
    return coverage.outside(s.select("subject_id"), chosen).withColumn("outside", F.lit(True)).unionByName(coverage.inside(chosen, s, "new").withColumn("outside", F.lit(False)))


@query("SELECT 'u' || user_id AS uid, min(event_id) AS pos, 'l' || max(event_id) AS url, arg_max(event_type, event_id) AS label FROM events WHERE user_id % 10 <> 0 GROUP BY user_id")
def x4_readlists(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("pos"), F.concat(F.lit("u"), _text("user_id")).alias("uid"), F.concat(F.lit("l"), _text("event_id")).alias("url"), F.col("event_type").alias("label"), "user_id")
    gone = e.where("user_id % 10 = 0").select("uid").distinct()
    return lists.delete_readlists(lists.upsert_readlists(e), gone).select("uid", "pos", "url", "label")


@query("SELECT series, CASE WHEN n < 10 THEN '0' || n ELSE n::VARCHAR END AS volume_number, series || ' ' || CASE WHEN n < 10 THEN '0' || n ELSE n::VARCHAR END AS title FROM (SELECT p_brand AS series, unnest(range(1, count(*) + 1)) AS n FROM part GROUP BY 1) x")
def w7_generated_volumes(spark, sf):
    return volumes.generated_volumes(table(spark, sf, "part").groupBy(F.col("p_brand").alias("series")).agg(F.count("*").cast("int").alias("count")))
