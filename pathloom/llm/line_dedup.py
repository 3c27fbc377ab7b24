"""Line deduplication by site-relative frequency.

Pages are grouped by host. A line is boilerplate of its host when it stands on more than a given share of the host's
pages. Only DataFrame functions are used. The corpus statistics move two hashes per line, never texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import Scratch, deal, heavy_keys, heavy_limit, spread_join, wide_hash

#: Share of a host's pages above which a line is boilerplate.
MAX_RATIO = 0.08
#: A line on fewer pages than this is never boilerplate, however small the host.
MIN_PAGES = 5
#: Boilerplate lines of a host that a line is compared with, about: they are kept in so many lists that each is short.
LIST = 4
#: Boilerplate lines up to which their table is broadcast; beyond, a shuffle join by line replaces that.
BROADCAST_ROWS = 50_000


def _host(col: str):
    return F.coalesce(F.col(col), F.lit(""))


def _lines(col: str):
    return F.split(F.coalesce(F.col(col), F.lit("")), "\n", -1)


def _key(x):
    """128 bits of a line without the white space around it; null for a blank one."""
    t = F.trim(x, F.lit("\t\r\x0b\x0c "))
    a, b = wide_hash(t)
    return F.when(t != "", F.struct(a.alias("a"), b.alias("b")))


def boilerplate(pages: DataFrame, text_col: str = "text", host_col: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line, n_pages, n_total): the lines that stand on more than max_ratio of their host's pages.

    A page counts once for a line however often it repeats it. Blank lines are never boilerplate. A null host is the
    host "".
    """
    keys = F.array_distinct(F.filter(F.transform(_lines(text_col), _key), lambda k: k.isNotNull()))
    each = pages.select(_host(host_col).alias("host"), F.explode(keys).alias("line"))
    counts = each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_pages"))
    totals = pages.groupBy(_host(host_col).alias("host")).agg(F.count(F.lit(1)).alias("n_total"))
    frequent = counts.where(F.col("n_pages") >= min_pages)  # before the join: most lines are on one page
    return frequent.join(totals, "host").where(F.col("n_pages") > max_ratio * F.col("n_total"))


def drop_lines(pages: DataFrame, text_col: str = "text", host_col: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """pages with text_col freed of its host's boilerplate, plus n_lines and n_removed.

    Every row stays, repeated ones too, and other columns pass through; columns of pages that bear the new names are
    replaced. A text that is null stays null (0 lines). An empty text has one empty line. A text whose lines all go
    becomes "".
    """
    scratch = Scratch(pages.sparkSession, "lines")
    bad = scratch.save(boilerplate(pages, text_col, host_col, max_ratio, min_pages).select("host", "line", "n_pages"), "boilerplate")
    with_bad = _by_broadcast if bad.count() <= broadcast_rows else _by_shuffle
    lines = _lines(f"page.{text_col}")
    kept = F.when(F.col("bad").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.coalesce(_in_lists(F.col("bad"), _key(x)), F.lit(False))))
    # the page stays a struct of its own, so that no column of it can clash with those made here
    marked = with_bad(pages, bad, text_col, host_col).select("page", lines.alias("lines"), kept.alias("kept"))
    there = F.col("page")[text_col].isNotNull()
    number = lambda c: F.when(there, F.size(c)).otherwise(0).cast("int")
    fresh = {text_col: F.when(there, F.array_join("kept", "\n")), "n_lines": number("lines"), "n_removed": (number("lines") - number("kept")).cast("int")}
    passed = [fresh.get(c, F.col("page")[c]).alias(c) for c in pages.columns if c == text_col or c not in fresh]
    return marked.select(*passed, *(fresh[c].alias(c) for c in ("n_lines", "n_removed")))


def _in_lists(lists, key):
    """Whether a key is in the list where it must be; null for a null key."""
    return F.transform(F.array(key), lambda k: F.array_contains(F.get(lists, F.pmod(k["a"], F.size(lists)).cast("int")), k))[0]


def _by_broadcast(pages: DataFrame, bad: DataFrame, text_col: str, host_col: str) -> DataFrame:
    """(page, bad): each row of pages as a struct, and lists of the boilerplate of its host; null if it has none."""
    n_lists = F.ceil(F.expr("count(1) OVER (PARTITION BY host)") / LIST).cast("int")
    dealt = bad.select("host", "line", n_lists.alias("lists")).withColumn("i", F.pmod(F.col("line.a"), F.col("lists")).cast("int"))
    each = dealt.groupBy("host", "lists", "i").agg(F.collect_list("line").alias("line")).groupBy("host", "lists").agg(F.map_from_entries(F.collect_list(F.struct("i", "line"))).alias("by_i"))
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    per_host = each.select("host", F.transform(F.sequence(F.lit(0), F.col("lists") - 1), lambda i: F.coalesce(F.try_element_at("by_i", i), none)).alias("bad"))
    return pages.select(F.struct(*pages.columns).alias("page"), _host(host_col).alias("host")).join(F.broadcast(per_host), "host", "left").select("page", "bad")


def _by_shuffle(pages: DataFrame, bad: DataFrame, text_col: str, host_col: str) -> DataFrame:
    """The same, with only the page's own boilerplate: found by a join on host and line, then joined by a hash of the page.

    Lines that many pages have, and pages that are equal, are dealt to several tasks.
    """
    p, q = (h.alias(n) for h, n in zip(wide_hash(_host(host_col), F.coalesce(F.col(text_col), F.lit(""))), "pq", strict=True))
    keys = F.array_distinct(F.filter(F.transform(_lines(text_col), _key), lambda k: k.isNotNull()))
    lines = pages.select(p, q, _host(host_col).alias("host"), F.explode(keys).alias("line"))
    heavy = deal(bad, ["host", "line"], heavy_limit(bad.agg(F.sum("n_pages")).first()[0] or 0), "n_pages")
    found = spread_join(lines, bad.drop("n_pages"), ["host", "line"], heavy, "left_semi").groupBy("p", "q").agg(F.array(F.collect_set("line")).alias("bad"))
    hashed = pages.select(F.struct(*pages.columns).alias("page"), p, q)
    return spread_join(hashed, found, ["p", "q"], heavy_keys(hashed.select("p", "q"), ["p", "q"]), "left").select("page", "bad")
