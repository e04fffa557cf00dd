"""Records against an existing library: by ISBN, then by similar titles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as nz
from ..functions.text import filled, let
from ..sources.store import stage

# Thresholds and weights.
DUPLICATE, CANDIDATE = 0.95, 0.8
TITLE, PUBLISHER, SAME_YEAR, NO_YEAR, OTHER_YEAR, STRONG_PUBLISHER = 0.6, 0.2, 0.2, 0.1, 0.1, 0.8
PREFIX = 10

HOT_PAIRS = 250_000  # pairs at one key beyond which they are found by their characters
SHORT = 6
_BOOK = ("b_title", "b_pub", "b_year", "b_isbn")


def isbn_matches(books: DataFrame, library: DataFrame) -> DataFrame:
    """Best library item of each book that shares an ISBN: book_key, item_id, item_title.

    An item with the same text in its field comes first, in the order of the book's keys; then the first item that shares a
    normalized form. The library is reduced to one row a key before the join, so no key multiplies rows.
    """
    keyed = books.select("book_key", F.posexplode(nz.isbn_keys("isbn13", "isbn")).alias("pos", "key"))
    first = F.min(F.struct("item_id", F.col("title").alias("item_title"))).alias("item")
    same = library.where(F.coalesce("isbn", F.lit("")) != "").groupBy(F.col("isbn").alias("key")).agg(first)
    shared = library.select("item_id", "title", F.explode(nz.isbn_keys("isbn")).alias("key")).groupBy("key").agg(first)
    stage = lambda hits, n, pos: hits.select("book_key", F.struct(F.lit(n).alias("stage"), pos.alias("pos"), "item").alias("hit"))
    hits = stage(keyed.join(same, "key"), 0, F.col("pos")).unionByName(stage(keyed.join(shared, "key"), 1, F.lit(0)))
    return hits.groupBy("book_key").agg(F.min("hit").alias("hit")).select("book_key", "hit.item.item_id", "hit.item.item_title")


def _years(date: Column) -> Column:
    return F.substring(filled(date), 1, 4)


def _sides(books: DataFrame, library: DataFrame, ignore_case: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Books as they are; the different ones (b_id and what is compared of them); the different items (item_id being the smallest)."""
    fold = F.lower if ignore_case else lambda c: c
    year = F.coalesce(_years(F.col("publish_date")), F.lit(""))
    b = books.select("book_key", F.col("title").alias("b_title"), F.coalesce("publisher", F.lit("")).alias("b_pub"), year.alias("b_year"), (F.size(nz.isbn_keys("isbn13", "isbn")) > 0).alias("b_isbn"))
    kinds = b.groupBy(*_BOOK).agg(F.min("book_key").alias("b_id")).withColumn("piece", fold(F.substring(nz.main_title(F.col("b_title")), 1, PREFIX))).where(F.length("piece") > 0)
    kinds = kinds.withColumn("b_norm", nz.comparable(F.col("b_title"))).withColumn("b_pub_norm", nz.comparable(F.col("b_pub")))
    it = library.select("item_id", F.col("title").alias("i_title"), F.coalesce("publisher", F.lit("")).alias("i_pub"), F.coalesce(_years(F.col("date")), F.lit("")).alias("i_year"), (F.size(nz.isbn_keys("isbn")) > 0).alias("i_isbn"))
    items = it.groupBy("i_title", "i_pub", "i_year", "i_isbn").agg(F.min("item_id").alias("item_id"))
    return b, kinds, items.withColumn("i_norm", nz.comparable(F.col("i_title"))).withColumn("i_pub_norm", nz.comparable(F.col("i_pub"))).withColumn("low", fold(F.col("i_title")))


def _keyed(kinds: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides by (piece, band, slot); every pair that may reach the threshold meets at exactly one key.

    The item's title is cut into all pieces of the lengths that the books' beginnings have. Titles whose normalized lengths differ by half
    or more cannot reach the threshold, so a book goes to its own band of lengths and both next to it. Where both publishers and both years are known, different
    years cannot reach it either, so such pairs meet by their year; the others meet in slots for what is unknown.
    """
    band = lambda title: F.when(F.length(title) > 0, F.floor(F.log(F.length(title).cast("double")) / math.log(1.5)).cast("int")).otherwise(-9)
    lengths = sorted(r["k"] for r in kinds.select(F.length("piece").alias("k")).distinct().collect())  # ten at most
    low = F.col("low")

    def of_length(k: int) -> Column:
        return F.when(F.length(low) >= k, F.transform(F.sequence(F.lit(1), F.length(low) - k + 1), lambda i: F.substr(low, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))

    pieces = [of_length(k) for k in lengths]
    known = lambda pub, year: (F.col(pub) != "") & (F.col(year) != "")
    near = F.sequence(band(F.col("b_norm")) - 1, band(F.col("b_norm")) + 1)
    by_year = lambda year: F.concat(F.lit("y"), F.col(year))
    left = kinds.select("b_id", "b_isbn", "b_norm", "piece", F.explode(near).alias("band"), F.when(known("b_pub", "b_year"), F.array(by_year("b_year"), F.lit("unknown"))).otherwise(F.array(F.lit("any"))).alias("slots"))
    left = left.withColumn("slot", F.explode("slots")).drop("slots")
    all_pieces = F.array_distinct(F.concat(*pieces)) if pieces else F.array().cast("array<string>")
    cut = items.select("item_id", "i_isbn", "i_norm", band(F.col("i_norm")).alias("band"), F.when(known("i_pub", "i_year"), F.array(by_year("i_year"), F.lit("any"))).otherwise(F.array(F.lit("unknown"), F.lit("any"))).alias("slots"), F.explode(all_pieces).alias("piece"))
    wanted = left.select("piece", "band").distinct()
    right = cut.join(wanted, ["piece", "band"], "left_semi").withColumn("slot", F.explode("slots")).drop("slots")
    return left, right


def _grams(norm: Column) -> Column:
    """The pairs of characters of a title, each with its number among equal ones."""
    pairs = F.array_sort(F.transform(F.sequence(F.lit(1), F.length(norm) - 1), lambda i: F.substr(norm, i, F.lit(2))))
    return let(pairs, lambda g: F.transform(g, lambda x, i: F.concat(x, (i - F.array_position(g, x)).cast("string"))))


def _by_grams(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (b_id, item_id) of crowded keys that share enough pairs of characters to reach the threshold.

    With similarity over 2/3 (by year) or 0.8 the titles share at least a third, or six tenths, of the longer one's pairs, less one; so the rarest of
    each, but for that many less one, have one in common. Beginnings that many titles share are frequent and stand last. Titles
    under ``SHORT`` characters meet as they are: there are few different ones.
    """
    size = F.length("norm")
    rows = left.select("b_norm").union(right.select("i_norm")).toDF("norm").distinct().where(size >= SHORT)
    tokens = stage(rows.select("norm", F.explode(_grams(F.col("norm"))).alias("gram")), "title-grams")
    often = tokens.groupBy("gram").agg(F.count("*").alias("often"))
    ordered = tokens.join(often, "gram").groupBy("norm").agg(F.array_sort(F.collect_list(F.struct("often", "gram"))).alias("grams"))
    needed = lambda share: F.greatest(F.lit(1), F.ceil(size * share).cast("int") - 1)
    first = lambda share: F.transform(F.slice("grams", 1, size - needed(share)), lambda g: g["gram"])
    ordered = stage(ordered.select("norm", first(1 / 3).alias("by_year"), first(0.6).alias("other")), "title-prefixes")
    key = ["piece", "band", "slot"]
    dealt = lambda side, norm, *more: side.join(ordered, side[norm] == ordered["norm"]).select(*more, *key, F.explode(F.when(F.col("slot").startswith("y"), F.col("by_year")).otherwise(F.col("other"))).alias("gram"))
    shared = dealt(left, "b_norm", "b_id").join(dealt(right, "i_norm", "item_id"), [*key, "gram"]).select("b_id", "item_id")
    short = left.where(F.length("b_norm") < SHORT).join(right.where(F.length("i_norm") < SHORT), key).select("b_id", "item_id")
    return shared.unionByName(short).distinct()


def candidate_pairs(kinds: DataFrame, items: DataFrame, hot: int = HOT_PAIRS) -> DataFrame:
    """Pairs (b_id, item_id) that are compared. Keys at which over ``hot`` pairs would meet go by their characters, the others as they are."""
    left, right = (stage(x, f"title-{n}") for x, n in zip(_keyed(kinds, items), ("books", "items"), strict=True))
    key = ["piece", "band", "slot"]
    n = lambda side, name: side.groupBy(*key).agg(F.count("*").alias(name))
    crowded = stage(n(left, "l").join(n(right, "r"), key).where(F.col("l") * F.col("r") > hot).select(*key), "crowded")
    pick = ["b_id", "item_id"]
    comparable = ~(F.col("b_isbn") & F.col("i_isbn"))
    if crowded.isEmpty():
        return left.join(right, key).where(comparable).select(*pick)
    calm = left.join(crowded, key, "left_anti").join(right, key).where(comparable).select(*pick)
    return calm.unionByName(_by_grams(left.join(crowded, key, "left_semi"), right.join(crowded, key, "left_semi")))


def title_matches(books: DataFrame, library: DataFrame, ignore_case: bool = True, hot: int = HOT_PAIRS) -> DataFrame:
    """Best similar item of each book: book_key, item_id, item_title, confidence, reason.

    A pair is compared if the item's title contains the first ten characters of the book's main title; ``candidate_pairs`` finds them by equi-joins.
    Equal books and equal items are compared once. Books come here without an ISBN match, so of a book with ISBNs only items
    without any are comparable.
    """
    b, kinds, items = _sides(books, library, ignore_case)
    kinds, items = stage(kinds, "book-kinds"), stage(items, "item-kinds")
    scored = scored_pairs(candidate_pairs(kinds, items, hot), kinds, items).where(F.col("confidence") > CANDIDATE)
    best = scored.groupBy(*_BOOK).agg(F.max(F.struct("confidence", (-F.col("item_id")).alias("first"), F.col("i_title").alias("item_title"), "reason")).alias("m"))
    return b.join(best, list(_BOOK)).select("book_key", (-F.col("m.first")).alias("item_id"), "m.item_title", "m.confidence", "m.reason")


def scored_pairs(found: DataFrame, kinds: DataFrame, items: DataFrame) -> DataFrame:
    """The pairs with confidence and reason; those that their lengths alone rule out are left out before titles are compared."""
    both = (F.col("b_pub") != "") & (F.col("i_pub") != "")
    la, lb = F.length("b_norm"), F.length("i_norm")
    bound = F.when(F.greatest(la, lb) == 0, 1.0).otherwise(1 - F.abs(la - lb) / F.greatest(la, lb))
    pairs = found.join(kinds, "b_id").join(items, "item_id").where(~(F.col("b_isbn") & F.col("i_isbn"))).where(F.when(both, TITLE * bound + 0.4 + 1e-9).otherwise(bound + 1e-9) > CANDIDATE)
    pairs = pairs.withColumn("t", nz.similarity(F.col("b_norm"), F.col("i_norm"))).withColumn("p", F.when(both, nz.similarity(F.col("b_pub_norm"), F.col("i_pub_norm"))))
    years = (F.col("b_year") != "") & (F.col("i_year") != "")
    weighted = F.col("t") * TITLE + F.col("p") * PUBLISHER
    score = F.when(F.col("p").isNull(), F.col("t")).when(~years, weighted + NO_YEAR).when(F.col("b_year") == F.col("i_year"), weighted + SAME_YEAR).otherwise(weighted - OTHER_YEAR)
    parts = F.concat_ws("+", F.lit("title"), F.when(F.col("p") > STRONG_PUBLISHER, "publisher"), F.when(F.col("p").isNotNull() & years & (F.col("b_year") == F.col("i_year")), "year"))
    return pairs.withColumn("confidence", score).withColumn("reason", F.concat(parts, F.lit(" fuzzy match")))


def pair_counts(books: DataFrame, library: DataFrame, ignore_case: bool = True, hot: int = HOT_PAIRS) -> DataFrame:
    """One row: pairs generated, pairs whose titles were compared, and pairs kept."""
    _, kinds, items = _sides(books, library, ignore_case)
    kinds, items = stage(kinds, "book-kinds"), stage(items, "item-kinds")
    found = stage(candidate_pairs(kinds, items, hot), "pairs")
    scored = scored_pairs(found, kinds, items).agg(F.count("*").alias("compared"), F.count_if(F.col("confidence") > CANDIDATE).alias("kept"))
    return scored.join(found.agg(F.count("*").alias("generated"))).select("generated", "compared", "kept")


def check_duplicates(books: DataFrame, library: DataFrame, ignore_case: bool = True) -> DataFrame:
    """``books`` with match_type (new, suspect, duplicate), matched_item_id, matched_item_title, match_confidence, match_reason."""
    exact = isbn_matches(books, library).select("book_key", "item_id", "item_title", F.lit(1.0).alias("confidence"), F.lit("ISBN match").alias("reason"), F.lit("duplicate").alias("match_type"))
    rest = books.join(exact.select("book_key"), "book_key", "left_anti")
    percent = F.concat(F.lit(" ("), F.round(F.col("confidence") * 100, 0).cast("int").cast("string"), F.lit("%)"))
    similar = title_matches(rest, library, ignore_case).select("book_key", "item_id", "item_title", "confidence", F.concat("reason", percent).alias("reason"), F.when(F.col("confidence") >= DUPLICATE, "duplicate").otherwise("suspect").alias("match_type"))
    found = exact.unionByName(similar).select("book_key", F.col("item_id").alias("matched_item_id"), F.col("item_title").alias("matched_item_title"), F.col("confidence").alias("match_confidence"), F.col("reason").alias("match_reason"), "match_type")
    return books.join(found, "book_key", "left").withColumn("match_type", F.coalesce("match_type", F.lit("new")))


def import_decision(match_type: Column) -> Column:
    return F.when(match_type == "duplicate", "skip-duplicate").when(match_type == "suspect", "review-suspect").otherwise("eligible-new")


def review_rows(matched: DataFrame) -> DataFrame:
    """Needs match_type and eligible; adds decision, selected, locked and badge."""
    new, dup, ok = F.col("match_type") == "new", F.col("match_type") == "duplicate", F.col("eligible")
    return matched.withColumns(
        {
            "decision": import_decision(F.col("match_type")),
            "selected": new & ok,
            "locked": dup | ~ok,
            "badge": F.when(~ok, "incomplete").when(new, "new").when(dup, "duplicate").otherwise("suspect"),
        }
    )


def review_summary(reviewed: DataFrame) -> DataFrame:
    is_ = lambda c: F.count_if(c)
    return reviewed.agg(F.count("*").alias("total"), *(is_(F.col("match_type") == t).alias(t) for t in ("new", "duplicate", "suspect")), is_(~F.col("eligible")).alias("incomplete"))
