"""A crawl over landed discovery pages: which pages are reached from where, and where each event is seen first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagelight.functions.urls import resolved
from stagelight.sources.pages import discovery

#: Pages that a crawl visits at most.
MOST_PAGES = 12


def page_links(pages: DataFrame, origin: str) -> DataFrame:
    """url, failed, event_urls and next_urls (absolute) of landed discovery pages (url, html)."""
    found = pages.select("url", discovery(F.col("html")).alias("d"))
    return found.select("url", F.col("d.failed").alias("failed"), F.col("d.event_urls").alias("event_urls"), F.transform("d.next_urls", lambda u: resolved(F.replace(u, F.lit("&amp;"), F.lit("&")), origin)).alias("next_urls"))


def reached(links: DataFrame, start: Sequence[str], most: int = MOST_PAGES) -> DataFrame:
    """(url, n, landed): pages in the order in which a queue that begins with `start` visits them, `most` at most.

    One round for each step away from the start, so `most` rounds at the utmost: the pages of a round are the links of
    the round before, in the order of page and place, without those seen; `landed` tells if the page is there to read.
    """
    spark = links.sparkSession
    level = spark.createDataFrame([(u, i) for i, u in enumerate(dict.fromkeys(start))], "url string, n long").where(F.col("n") < most)
    seen, edges = level, links.select(F.col("url").alias("parent"), F.posexplode("next_urls").alias("i", "url"))
    for _ in range(most):
        if level.isEmpty():
            break
        new = level.select(F.col("url").alias("parent"), "n").join(edges, "parent").groupBy("url").agg(F.min(F.struct("n", "i")).alias("at")).join(seen.select("url"), "url", "left_anti")
        first = seen.count()  # `most` rows at most
        level = new.withColumn("n", F.row_number().over(Window.orderBy("at")) + (first - 1)).where(F.col("n") < most).select("url", F.col("n").cast("long").alias("n"))
        level = spark.createDataFrame(level.collect(), "url string, n long")  # likewise
        seen = seen.unionByName(level)
    return seen.join(links.select("url", F.lit(True).alias("landed")).distinct(), "url", "left").select("url", "n", F.coalesce("landed", F.lit(False)).alias("landed"))


def events_seen(links: DataFrame, visited: DataFrame) -> DataFrame:
    """(event_url, page_url, n): each event once, with the page that first shows it, numbered in that order."""
    rows = visited.where("landed").join(links, "url").select("n", F.col("url").alias("page_url"), F.posexplode("event_urls").alias("i", "event_url"))
    first = rows.groupBy("event_url").agg(F.min(F.struct("n", "i", "page_url")).alias("at"))
    return first.select("event_url", F.col("at.page_url").alias("page_url"), (F.row_number().over(Window.orderBy("at")) - 1).alias("n"))


def failures(links: DataFrame, visited: DataFrame) -> DataFrame:
    """One row: failed, the links that are no event on visited pages, and visited pages that were not there."""
    rows = visited.join(links.select("url", "failed"), "url", "left")
    return rows.agg((F.coalesce(F.sum("failed"), F.lit(0)) + F.count_if(~F.col("landed"))).cast("long").alias("failed"))
