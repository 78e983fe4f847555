"""Ranked search over a table of pages: the best few per query by BM25, from the postings of the queries' terms only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.sources.shared import durable

#: BM25's parameters, and the steps that a score is counted in: scores are whole numbers, so that sums don't depend on their order.
K1, B, STEPS = 1.2, 0.75, 1_000_000
#: Sub-groups of a term's postings, as a term may be on most pages.
SALTS = 32
#: (query, page) sums that a task holds, about, and (query, term) rows that are broadcast at most.
PAIRS, ASKED = 1 << 18, 1 << 18


def page_text(html: Column) -> Column:
    """The text of a page: without comments, scripts, styles and tags, and with the five named entities read."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        bare = F.replace(bare, F.lit(f"&{name};"), F.lit(sign))
    return bare


def terms_of(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _counted(terms: Column) -> Column:
    """The (term, tf) of a list, behind one without a term: where a term begins in the sorted list, and where the next one does."""

    def counts(ordered: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(ordered)), lambda k: ~F.get(ordered, k).eqNullSafe(F.get(ordered, k - 1)))
        ends = lambda b, i: F.coalesce(F.get(b, i + 1), F.size(ordered))
        return F.flatten(F.transform(F.array(begins), lambda b: F.transform(b, lambda k, i: F.struct(F.get(ordered, k).alias("term"), (ends(b, i) - k).cast("long").alias("tf")))))

    # by way of arrays of one, so that the list is sorted once
    found = F.flatten(F.transform(F.array(F.sort_array(terms)), counts))
    return F.concat(F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("tf"))), F.filter(found, lambda x: x["term"].isNotNull()))


def top_pages(pages: DataFrame, queries: DataFrame, page: str, text: str, query: str, words: str, top: int = 3) -> DataFrame:
    """(query, page, score, rank): the ``top`` best pages of each query, exact, ties by the smaller page.

    Both tables give an id and a text. A page's score is the sum over the query's distinct terms of
    floor(STEPS * idf * tf (k1 + 1) / (tf + k1 (1 - b + b * length / mean length))), with
    idf = ln(1 + (N - df + 0.5) / (df + 0.5)). Pages without any of the terms are no results, so a query may
    have fewer rows than ``top``, or none; pages without text count in N and the mean.

    Terms are counted within a page, and only those that some query has leave the scan, which is read once. They are
    dealt by page into as many tasks as keep about ``PAIRS`` sums each, where they meet the queries: up to ``ASKED`` terms
    of queries are broadcast, more are joined by term, each term's postings in ``SALTS`` parts. Of the sums each task
    passes on its best. Ids are unique; null texts are empty; an empty table gives an empty result.
    """
    asked = queries.select(F.col(query).alias("query"), F.explode(F.array_distinct(terms_of(F.col(words)))).alias("term"))
    n_asked, n_queries = asked.agg(F.count(F.lit(1)), F.countDistinct("query")).first()
    small = F.broadcast if n_asked <= ASKED else lambda table: table
    wanted = asked.select("term").distinct().withColumn("wanted", F.lit(True))
    split = pages.select(F.col(page).alias("page"), terms_of(F.col(text)).alias("terms"))
    each = split.select("page", F.size("terms").cast("long").alias("length"), F.inline(_counted(F.col("terms"))))
    # a row without a term for each page, so that all pages are counted
    kept = durable(each.join(small(wanted), "term", "left").where("wanted OR term IS NULL").select("page", "length", "term", "tf"), "search-postings")
    n_pages, lengths = kept.where("term IS NULL").agg(F.count(F.lit(1)), F.sum("length")).first()
    postings = kept.where("term IS NOT NULL")
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = df.select("term", F.log(1 + (F.lit(n_pages) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    mean = (lengths or 0) / max(n_pages, 1)
    gains = asked.join(df, "term").agg(F.sum("df")).first()[0] or 0
    parts = max(1, -(-min(gains, n_pages * n_queries) // PAIRS))
    gain = F.floor(STEPS * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(float(mean or 1))))).cast("long")
    weighted = asked.join(weights, "term")
    if n_asked <= ASKED:
        met = postings.repartition(parts, "page").join(F.broadcast(weighted), "term")
    else:
        salted = postings.withColumn("salt", F.pmod(F.xxhash64("page"), F.lit(SALTS)).cast("int")).repartition(parts, "term", "salt")
        spread = weighted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = salted.join(spread, ["term", "salt"]).repartition(parts, "query", "page")
    scores = met.groupBy("query", "page").agg(F.sum(gain).alias("score"))
    best = scores.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "page"))).where(F.col("rank") <= top)
    return best.select(F.col("query").alias(query), F.col("page").alias(page), "score", "rank")


def market_data(found: DataFrame, pages: DataFrame, query: str, page: str, title: str, text: str) -> DataFrame:
    """(query, market_data): what a prompt says of search results, one line a result in rank order."""
    named = found.join(pages.select(page, F.coalesce(title, F.lit("")).alias("title"), F.substring(F.coalesce(text, F.lit("")), 1, 200).alias("content")), page)
    lines = F.sort_array(F.collect_list(F.struct("rank", F.concat(F.lit("- "), "title", F.lit(": "), "content", F.lit("\n")).alias("line"))))
    return named.groupBy(query).agg(F.concat(F.lit("Search results:\n"), F.array_join(lines["line"], "")).alias("market_data"))
