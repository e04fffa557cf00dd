"""List and series pages: links, counters, assembly, completeness and sampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import absolute_url, count_text, filled, has_text, let, owner_id, strict_subject_url, strip_tags, subject_id
from ..site import SITE, Site
from ..sources.store import stage
from .pagehtml import anchor_links

PAGE = 15
BLOCK = 1_000  # pages whose running sums one task takes
TASK_LINKS = 200_000  # links that one task sorts
LINKS = "array<struct<url:string,title:string>>"


def _subject(site: Site) -> str:
    return f"(?:https?:)?//{site.host.replace('.', chr(92) + '.')}/subject/[0-9]+/?"


def _first_of_each(links: Column, *order) -> Column:
    """Structs (k, i, x) of the elements ``x`` of ``links`` (structs k, x) that come first for their key by ``order`` and place; by key. Sorts, so any number of links is well."""
    keyed = F.array_sort(F.transform(links, lambda s, i: F.struct(s["k"].alias("k"), *(o(s["x"]).alias(f"o{n}") for n, o in enumerate(order)), i.alias("i"), s["x"].alias("x"))))
    return let(keyed, lambda ss: F.filter(ss, lambda s, j: (j == 0) | (s["k"] != F.get(ss, j - 1)["k"])))


def _first_seen(links: Column, key) -> Column:
    """The first link of each key, in order."""
    keyed = F.transform(links, lambda x: F.struct(key(x).alias("k"), x.alias("x")))
    return F.transform(F.array_sort(F.transform(_first_of_each(keyed), lambda s: F.struct(s["i"].alias("i"), s["x"].alias("x")))), lambda s: s["x"])


def list_links(html: Column, site: Site = SITE) -> Column:
    """Links of a list page in order, each address once; titles from the attribute, else from the anchor's text."""
    pieces = F.split(html, "(?i)(?=<a\\s)")
    url = f"href=\"({_subject(site)})\""

    def link(p: Column) -> Column:
        tag = F.regexp_extract(p, "(?is)^<a\\s[^>]*>", 0)
        href = F.regexp_extract(tag, f"(?is)\\b{url}", 1)
        attr = strip_tags(F.regexp_extract(tag, "(?is)\\btitle=\"([^\"]*)\"", 1))
        text = strip_tags(F.regexp_extract(p, "(?is)^<a\\s[^>]*>(.*?)</a>", 1))
        return F.struct(absolute_url(href, site).alias("url"), F.coalesce(filled(attr), text).alias("title"), (href != "").alias("ok"))

    found = F.filter(F.transform(pieces, link), lambda x: x["ok"] & (x["title"] != ""))
    return F.transform(_first_seen(found, lambda x: x["url"]), lambda x: F.struct(x["url"].alias("url"), x["title"].alias("title")))


def dom_links(html: Column, site: Site = SITE, backfill: bool = False) -> Column:
    """Links from the parsed page: strict subject addresses, 1-based positions; ``backfill`` takes an empty title from a later anchor."""
    made = F.transform(anchor_links(html), lambda a: F.struct(strict_subject_url(a["href"], site).alias("url"), F.coalesce(filled(a["title_attr"]), a["text"], F.lit("")).alias("title")))

    def unique(found: Column) -> Column:
        keyed = F.transform(found, lambda x: F.struct(x["url"].alias("k"), x.alias("x")))
        first = _first_of_each(keyed)
        if backfill:  # both are in the order of the addresses
            titled = _first_of_each(keyed, lambda x: x["title"] == "")
            first = F.zip_with(first, titled, lambda a, b: F.struct(a["k"].alias("k"), a["i"].alias("i"), F.struct(a["k"].alias("url"), b["x"]["title"].alias("title")).alias("x")))
        placed = F.array_sort(F.transform(first, lambda s: F.struct(s["i"].alias("i"), s["x"]["url"].alias("url"), s["x"]["title"].alias("title"))))
        return F.transform(placed, lambda s, i: F.struct(s["url"].alias("url"), s["title"].alias("title"), (i + 1).alias("position")))

    return let(F.filter(made, lambda x: x["url"].isNotNull()), unique)


def counter(html: Column) -> Column:
    """Struct (start, end, total) of the page's counter; null if there is none."""
    inner = F.regexp_extract(html, "(?is)<span\\b[^>]*class=[\"'][^\"']*(?<![A-Za-z0-9_])subject-num(?![A-Za-z0-9_])[^\"']*[\"'][^>]*>(.*?)</span>", 1)
    text = count_text(inner)
    part = lambda k: F.regexp_extract(text, "([0-9]+) ?- ?([0-9]+) ?/ ?([0-9]+)", k).try_cast("int")
    return F.when(part(3).isNotNull(), F.struct(part(1).alias("start"), part(2).alias("end"), part(3).alias("total")))


def next_page(html: Column, site: Site = SITE) -> Column:
    inner = F.regexp_extract(html, "(?is)<span\\b[^>]*class=[\"'][^\"']*(?<![A-Za-z0-9_])next(?![A-Za-z0-9_])[^\"']*[\"'][^>]*>(.*?)</span>", 1)
    href = filled(F.regexp_extract(inner, "(?is)(?<![A-Za-z0-9_])href=([\"'])(.*?)\\1", 2))
    return absolute_url(F.regexp_replace(href, "(?i)&amp;|&#38;", "&"), site)


def page_diagnostics(html: Column, site: Site = SITE) -> Column:
    """Struct (links, total, has_next, next_url, range, visible)."""
    links, span, nxt = list_links(html, site), counter(html), next_page(html, site)
    heading = F.regexp_extract(html, "(?s)<h1[^>]*>.*?\\(([0-9]+)\\).*?</h1>", 1).try_cast("int")
    return F.struct(links.alias("links"), F.coalesce(span["total"], heading, F.lit(0)).alias("total"), nxt.isNotNull().alias("has_next"), nxt.alias("next_url"), span.alias("range"), F.size(links).alias("visible"))


def series_links(html: Column, site: Site = SITE) -> Column:
    """Volumes of a series page: heading links of its items, else text links of its list; each subject once."""
    anchor = f"(?is)<a[^>]+href=[\"']({_subject(site)})[\"'][^>]*>(.*?)</a>"
    bare = lambda c: F.regexp_replace(c, "<[^>]*>", "")

    def collect(parts: Column, rx: str) -> Column:
        got = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, rx, 1).alias("href"), F.regexp_extract(p, rx, 2).alias("body")))
        told = F.transform(F.filter(got, lambda x: (x["href"] != "") & ~x["body"].contains("<img")), lambda x: F.struct(absolute_url(x["href"], site).alias("url"), F.trim(bare(x["body"])).alias("title")))
        return _first_seen(F.filter(told, lambda x: x["title"] != ""), lambda x: subject_id(x["url"]))

    items = F.regexp_extract_all(html, F.lit("(?is)<div[^>]+class=[\"'][^\"']*subject-item[^\"']*[\"'][^>]*>(.*?)</div>\\s*</div>"), 1)
    first = collect(items, f"(?is)<h2[^>]*>\\s*<a[^>]+href=[\"']({_subject(site)})[\"'][^>]*>(.*?)</a>")
    area = F.regexp_extract(html, "(?is)<div[^>]+class=[\"'][^\"']*subject-list[^\"']*[\"'][^>]*>(.*?)</div>\\s*(?:<div[^>]+class=[\"'](?:paginator|aside)|\\z)", 1)
    second = collect(F.split(area, "(?i)(?=<a\\s)"), anchor)
    return let(first, lambda xs: F.when(F.size(xs) > 0, xs).otherwise(second))


def series_info(html: Column) -> Column:
    """Struct (name, count, has_next)."""
    name = F.trim(F.regexp_replace(F.regexp_extract(html, "(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]*>", ""))
    return F.struct(name.alias("name"), F.regexp_extract(html, "册\\s*数[：:]\\s*([0-9]+)", 1).try_cast("int").alias("count"), html.rlike("(?i)class=[\"']next[\"'][^>]*>\\s*<a\\s").alias("has_next"))


def assemble(pages: DataFrame, list_col: str = "uid", link_key=lambda x: x["url"], most_pages: int | None = None, need_new: bool = False, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Pages (list_col, page, url, d: page_diagnostics) to links (list_col, position, url, title) and one summary row a list.

    Pages count in order up to the first empty page, repeated address, page without a next one, or the page with which the
    declared total is reached; that page itself counts. ``most_pages`` is a crawler's limit, off unless given. With ``need_new`` a page
    without a new link is the last one too.

    A list may have any number of pages: a link's first sight is found by list and key, and running sums are prefix sums over
    blocks of ``block`` pages. Windows run within a block, or over the totals of a list's blocks; the page that ends a list is an aggregate.
    The pages with their new links are written once, without html, since several passes read them.
    """
    seen = pages if most_pages is None else pages.where(F.col("page") < most_pages)
    shown = seen.select(list_col, "page", "url", *(F.col(f"d.{c}").alias(c) for c in ("visible", "total", "has_next")), F.posexplode_outer("d.links").alias("pos", "l"))
    first = Window.partitionBy(list_col, link_key(F.col("l"))).orderBy("page", "pos", "url")
    fresh = F.when((F.row_number().over(first) == 1) & F.col("pos").isNotNull(), F.struct("pos", F.col("l.url").alias("url"), F.col("l.title").alias("title")))
    same = lambda c: F.first(c).alias(c)
    seen = shown.withColumn("fresh", fresh).groupBy(list_col, "page", "url").agg(same("visible"), same("total"), same("has_next"), F.array_sort(F.collect_list("fresh")).alias("fresh"), F.count_if(F.coalesce("pos", F.lit(0)) == 0).alias("copies"))
    seen = seen.withColumn("again", F.row_number().over(Window.partitionBy(list_col, "url").orderBy("page")) > 1).withColumn("new", F.when(F.col("again"), 0).otherwise(F.size("fresh")))
    seen = stage(seen.withColumn("block", F.floor(F.col("page") / block)), "list-pages")
    at, stated = F.struct("page", "url"), F.when(F.col("total") > 0, F.col("total"))
    totals = seen.groupBy(list_col, "block").agg(F.sum("new").alias("n"), F.min_by(stated, F.when(F.col("total") > 0, at)).alias("stated"))
    earlier = Window.partitionBy(list_col).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(list_col, "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"), F.first("stated", ignorenulls=True).over(earlier).alias("stated"))
    so_far = Window.partitionBy(list_col, "block").orderBy("page", "url").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = seen.withColumn("known", F.sum("new").over(so_far)).withColumn("declared", F.first(stated, ignorenulls=True).over(so_far))
    seen = seen.join(carried, [list_col, "block"]).withColumns({"known": F.col("earlier") + F.col("known"), "declared": F.coalesce("stated", "declared", F.lit(0))})
    looped = F.col("again") | (F.col("copies") > 1)
    stop = looped | (F.col("visible") == 0) | ((F.col("declared") > 0) & (F.col("known") >= F.col("declared"))) | ~F.col("has_next")
    if need_new:
        stop = stop | (F.col("new") == 0)
    last = seen.where(stop).groupBy(list_col).agg(F.min(at).alias("last"))
    used = seen.join(last, list_col, "left").where(F.col("last").isNull() | (at <= F.col("last")))
    spread = used.where(~F.col("again")).select(list_col, (F.col("known") - F.col("new")).alias("before"), F.posexplode("fresh").alias("i", "l"))
    links = spread.select(list_col, (F.col("before") + F.col("i") + 1).cast("int").alias("position"), "l.url", "l.title")
    other = used.where((F.col("total") > 0) & (F.col("total") != F.col("declared"))).groupBy(list_col, "total").agg(F.min(at).alias("at"))
    changed = other.groupBy(list_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "total"))), lambda s: s["total"]).alias("other_totals"))
    summary = used.groupBy(list_col).agg(
        F.max("declared").alias("total"), F.count_if(~F.col("again")).alias("pages"), F.sum(F.when(~F.col("again"), F.col("visible")).otherwise(0)).alias("visible"), F.max("known").cast("int").alias("unique_links"),
        F.max(F.when(looped, F.col("url"))).alias("loop_url"),
    )
    summary = summary.join(changed, list_col, "left")
    return links, summary.withColumn("other_totals", F.coalesce("other_totals", F.array().cast(changed.schema["other_totals"].dataType)))


def assemble_series(pages: DataFrame, list_col: str = "series", site: Site = SITE, most_pages: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Series pages (list_col, page from 0, url, html) to volumes (list_col, position, url, title), each subject once, and a summary row a series.

    The rules of ``assemble``, and a page with nothing new ends the series. Name and declared count are those of page 0; the count
    is null if it is not shown. ``mismatch`` tells of a declared count other than that of the volumes.
    """
    links, info = series_links(F.col("html"), site), series_info(F.col("html"))
    # written once, without html: both results and the names read it
    shown = stage(pages.select(list_col, "page", "url", links.alias("links"), info.alias("i")), "series-pages")
    total = F.when(F.col("page") == 0, F.col("i.count"))
    d = F.struct("links", F.coalesce(total, F.lit(0)).alias("total"), F.col("i.has_next").alias("has_next"), F.size("links").alias("visible"))
    volumes, summary = assemble(shown.select(list_col, "page", "url", d.alias("d")), list_col, lambda x: subject_id(x["url"]), most_pages, need_new=True)
    names = shown.where(F.col("page") == 0).groupBy(list_col).agg(F.min("i.name").alias("name"))
    declared = F.when(F.col("total") > 0, F.col("total"))
    differs = F.coalesce(declared != F.col("unique_links"), F.lit(False))
    out = summary.join(names, list_col, "left").select(list_col, F.coalesce("name", F.lit("")).alias("name"), declared.alias("declared"), "pages", F.col("unique_links").alias("volumes"), differs.alias("mismatch"))
    return volumes, out


def completeness_warnings(summary: DataFrame, site: Site = SITE, page: int = PAGE) -> DataFrame:
    """``summary`` with ``warnings``: loops and changed totals, then what is missing."""
    total, seen, unique, pages = (F.col(c) for c in ("total", "visible", "unique_links", "pages"))
    expected = F.ceil(total / page)
    s = site.name
    found = F.array(
        F.when((total <= 0) & (unique > 0), F.lit(f"readlist-total-unknown: no page of {s} states how long the list is.")),
        F.when((total > 0) & (seen < total), F.format_string(f"readlist-visible-count-mismatch: of %d entries that {s} states, %d are on the pages; %d are not shown to this reader.", total, seen, total - seen)),
        F.when((total > 0) & (unique < seen), F.format_string("readlist-duplicate-visible-links: the %d entries on the pages name %d different subjects.", seen, unique)),
        F.when((total > 0) & (pages < expected) & (seen < total), F.format_string(f"readlist-pagination-incomplete: %d entries fill %d pages of {page}; {s} gave %d.", total, expected, pages)),
    )
    changed = F.transform("other_totals", lambda t: F.format_string(f"readlist-total-changed: {s} stated %d entries first and %d on a later page.", total, t))
    loop = F.array(F.when(F.col("loop_url").isNotNull(), F.concat(F.lit("readlist-pagination-loop: a page came up a second time: "), "loop_url")))
    return summary.withColumn("warnings", F.filter(F.concat(changed, loop, found), lambda w: w.isNotNull()))


def capture_completeness(inputs: DataFrame, site: Site = SITE) -> DataFrame:
    """Adds completeness_status and completeness_warnings to rows of capture counts."""
    c = F.col
    lists = c("stopped_by_cap") | c("stopped_by_missing_next") | (c("captured_list_pages") < c("expected_pages"))
    details = (c("detail_failures") > 0) | (c("details_succeeded") < c("details_attempted")) | (c("details_succeeded") < c("visible_links"))
    status = (
        F.when(c("declared_total").isNull() | c("expected_pages").isNull(), "incomplete-missing-subject-num").when(lists, "incomplete-list-capture").when(details, "incomplete-detail-capture")
        .when(c("raw_records") != c("details_succeeded"), "incomplete-row-count").when(F.coalesce("visible_deficit", F.lit(0)) > 0, "complete-with-anonymous-visibility-warning").otherwise("complete")
    )
    out = inputs.withColumn("completeness_status", status)
    text = (
        F.when(c("completeness_status") == "incomplete-list-capture", F.format_string(f"readlist-pagination-incomplete: the %d entries that {site.name} states fill %d pages; the capture has %d.", "declared_total", "expected_pages", "captured_list_pages"))
        .when(c("completeness_status") == "incomplete-detail-capture", F.format_string("readlist-detail-capture-incomplete: of %d detail pages asked for, %d came and %d failed.", "details_attempted", "details_succeeded", "detail_failures"))
        .when(c("completeness_status") == "incomplete-row-count", F.format_string("row-count-mismatch: %d detail pages came, %d raw records are stored.", "details_succeeded", "raw_records"))
    )
    return out.withColumn("completeness_warnings", F.array_distinct(F.concat("discovery_warnings", F.filter(F.array(text), lambda w: w.isNotNull()))))


def page_checks(pages: DataFrame, page: int = PAGE) -> DataFrame:
    """Rows (person, page_index, declared_total, d) with what the page should show and what is missing."""
    size = F.col("d.range.end") - F.col("d.range.start") + 1
    return pages.withColumns(
        {
            "expected_start": F.col("page_index") * page + 1,
            "expected_end": F.least((F.col("page_index") + 1) * page, F.col("declared_total")),
            "range_size": size,
            "visible_links": F.col("d.visible"),
            "deficit": F.greatest(F.lit(0), size - F.col("d.visible")),
            "total_matches": F.coalesce(F.col("d.range.total") == F.col("declared_total"), F.lit(False)),
        }
    )


def list_summary(people: DataFrame, page: int = PAGE) -> DataFrame:
    """Adds expected_pages and last_page_items to rows with declared_total."""
    total = F.col("declared_total")
    return people.withColumns({"expected_pages": F.ceil(total / page).cast("int"), "last_page_items": F.when(total == 0, 0).otherwise(F.pmod(total - 1, F.lit(page)) + 1).cast("int")})


def choose_pages(people: DataFrame, seed: str, per_person: int, full_pages: int = 0) -> DataFrame:
    """Page 0, all pages of small lists marked ``full``, and ``per_person`` others in the order of a seeded hash: person, page_index."""
    pages = people.select("person", "expected_pages", "full", F.explode(F.when(F.col("expected_pages") > 0, F.sequence(F.lit(0), F.col("expected_pages") - 1)).otherwise(F.array(F.lit(0)))).alias("page_index"))
    fixed = (F.col("page_index") == 0) | (F.col("full") & (F.col("expected_pages") <= full_pages))
    order = F.sha2(F.concat_ws("\0", F.lit(seed), "person", F.col("page_index").cast("string")), 256)
    rank = F.row_number().over(Window.partitionBy("person", "fixed").orderBy("order"))
    return pages.withColumn("fixed", fixed).withColumn("order", order).withColumn("rank", rank).where(F.col("fixed") | (F.col("rank") <= per_person)).select("person", "page_index")


def select_subjects(candidates: DataFrame, n: int, seed: str, url: str = "url") -> DataFrame:
    """The first n by a seeded hash of the address, with their rank. A top-k, not a sort of everything."""
    top = candidates.withColumn("order", F.sha2(F.concat_ws("\0", F.lit(seed), url), 256)).orderBy("order", url).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("order", url))).drop("order")


def merge_candidates(links: DataFrame) -> DataFrame:
    """Rows (url, title, seq, source) to one row a url: first title that is not empty, exact count, first source.

    ``candidate_sources`` has all sources; they are rows, for an address may stand in any number of lists.
    """
    made = links.groupBy("url").agg(F.min_by("title", F.when(F.col("title") != "", F.col("seq"))).alias("title"), F.count("*").alias("n_sources"), F.min_by("source", "seq").alias("first_source"))
    return made.withColumn("title", F.coalesce("title", F.lit("")))


def candidate_sources(links: DataFrame, by: str, within: str) -> DataFrame:
    """Rows (url, position from 1, source) in the order of (by, within), columns of ``links`` (url, source, by, within).

    Positions within one url and ``by`` are ranked and added to the count of those before, so that no task sorts all rows of a
    url; its window has a row for each value of ``by``, with a count only. The links are written once and dealt by their number, so
    that a task sorts about ``TASK_LINKS`` rows at any size.
    """
    links = stage(links.select("url", by, within, "source").withColumn("__key", F.struct("url", by)), "candidate-links")
    parts = max(links.sparkSession.sparkContext.defaultParallelism, math.ceil(links.count() / TASK_LINKS))
    counts = links.groupBy("__key", "url", by).agg(F.count("*").alias("n")).repartition(parts, "url")
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("url").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = links.repartition(parts, "__key").withColumn("i", F.row_number().over(Window.partitionBy("__key").orderBy(within)))
    before = counts.select("__key", earlier.alias("earlier")).repartition(parts, "__key")
    # a key is a struct, whose nulls equal each other
    return ranked.join(before, "__key").select("url", (F.col("earlier") + F.col("i")).alias("position"), "source")


def exclude_known(candidates: DataFrame, known: DataFrame) -> DataFrame:
    return candidates.join(known.select("subject_id").distinct(), "subject_id", "left_anti")


def attach_lists(pages: DataFrame, links: DataFrame, key) -> DataFrame:
    """Detail pages with list_url, list_title, position and owner_id of the last list that names them (links: url, title, list_url, position, seq)."""
    last = links.groupBy(key(F.col("url")).alias("__key")).agg(F.max_by(F.struct("list_url", "title", "position"), F.col("seq")).alias("l"))
    joined = pages.withColumn("__key", key(F.col("url"))).join(last, "__key", "left")
    return joined.select(*pages.columns, F.col("l.list_url").alias("list_url"), F.col("l.title").alias("list_title"), F.col("l.position").alias("position"), owner_id(F.col("l.list_url")).alias("owner_id"))


def resume_status(links: DataFrame, fetched: DataFrame, cached: DataFrame) -> DataFrame:
    """Links (url) with status cached, index-repaired, cache-missing-refetch or to-fetch."""
    mark = lambda df, name: df.select("url").distinct().withColumn(name, F.lit(True))
    both = links.join(mark(fetched, "f"), "url", "left").join(mark(cached, "c"), "url", "left")
    status = F.when(F.col("c") & F.col("f"), "cached").when(F.col("c"), "index-repaired").when(F.col("f"), "cache-missing-refetch").otherwise("to-fetch")
    return both.withColumn("status", status).drop("f", "c")


def audit_lists(people: DataFrame, selected: DataFrame, subjects: DataFrame, checks: DataFrame, site: Site = SITE, page: int = PAGE) -> DataFrame:
    """Violations (severity, message) of a pagination capture.

    people: person, declared_total, expected_pages, last_page_items. selected: person, page_index. subjects: subject_id, url.
    checks: person, page_index, expected_start, expected_end, visible_links (recorded) and d (what the page shows).
    """
    m = F.format_string
    right = list_summary(people.withColumnsRenamed({"expected_pages": "e", "last_page_items": "l"}), page)
    err = lambda df, text: df.select(F.lit("error").alias("severity"), text.alias("message"))
    parts = [
        err(right.where("e <> expected_pages"), m(f"pages of %s: %d recorded, but %d entries of {page} a page were stated", "person", "e", "declared_total")),
        err(right.where("l <> last_page_items"), m("last page of %s: %d entries recorded, which does not go with %d in all", "person", "l", "declared_total")),
        err(selected.join(people, "person").where("page_index < 0 or page_index >= expected_pages"), m("choice for %s: there is no page %d", "person", "page_index")),
        err(subjects.where(~F.col("url").rlike(f"^{site.root}/subject/[0-9]+/\\z")), F.concat(F.lit("chosen subject without a subject's address: "), "url")),
        err(subjects.groupBy("subject_id").agg(F.count("*").alias("n")).where("n > 1"), F.concat(F.lit("subject chosen more than once: "), F.col("subject_id").cast("string"))),
    ]
    joined = checks.join(people.select("person", "declared_total"), "person", "left")
    at = lambda text, *cols: m(f"page %2$d of %1$s: {text}", "person", "page_index", *cols)
    shown = joined.where("d.range is not null")
    parts += [
        err(joined.where("d.range is null"), at("no counter")),
        err(shown.where("d.range.total <> declared_total"), at("its counter ends at %3$d, that of the first page at %4$d", F.col("d.range.total"), "declared_total")),
        err(shown.where("d.range.start <> expected_start"), at("begins with entry %3$d instead of %4$d", F.col("d.range.start"), "expected_start")),
        err(shown.where("d.range.end <> expected_end"), at("ends with entry %3$d instead of %4$d", F.col("d.range.end"), "expected_end")),
        err(shown.where("d.visible <> visible_links"), at("has %3$d links, the capture noted %4$d", F.col("d.visible"), "visible_links")),
        shown.where("d.visible < d.range.end - d.range.start + 1").select(F.lit("warning").alias("severity"), at("counts %3$d entries and shows %4$d different links", F.col("d.range.end") - F.col("d.range.start") + 1, F.col("d.visible")).alias("message")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def upsert_readlists(entries: DataFrame) -> DataFrame:
    """Entries (pos, uid, url, label), normalized: the last of each uid wins, at the first one's place."""
    return entries.where(has_text(F.col("uid"))).groupBy("uid").agg(F.min("pos").alias("pos"), F.max_by("url", "pos").alias("url"), F.max_by(F.coalesce("label", F.lit("")), F.col("pos")).alias("label"))


def fold_readlists(log: DataFrame) -> DataFrame:
    """The registry (uid, pos, url, label) after a log of entries (pos, op, uid, url, label) in the order of ``pos``, ``op`` being upsert or delete.

    An entry's url and label are those of its last upsert, its place that of the first upsert after its last delete. Both steps are aggregates
    with a row for each key from each task, whatever the number of changes to one key. Changes without a key count for nothing.
    """
    log = log.where(has_text(F.col("uid")))
    gone = log.where("op = 'delete'").groupBy("uid").agg(F.max("pos").alias("gone"))
    alive = log.where("op = 'upsert'").join(gone, "uid", "left").where("gone is null or pos > gone")
    return upsert_readlists(alive)


def delete_readlists(entries: DataFrame, uids: DataFrame) -> DataFrame:
    return entries.join(uids, "uid", "left_anti")
