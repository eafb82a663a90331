"""The link graph of stored pages: links, what is new, and what a crawl would reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineward.functions.urls import (
    absolute_url,
    canonical_url,
    hrefs,
    is_skipped,
    netloc,
    same_site,
)
from lineward.session import cut

# Levels of a search that are kept as separate tables before they are merged into one.
_MERGE_EVERY = 10


def extract_links(pages: DataFrame) -> DataFrame:
    """``(url, href, link)`` of every anchor of every page, resolved against the page."""
    anchors = pages.select("url", F.explode(hrefs(F.col("html"))).alias("href"))
    return anchors.withColumn("link", absolute_url(F.col("url"), F.col("href")))


def site_links(pages: DataFrame) -> DataFrame:
    """``(url, link, skipped)``: links within the site of their page, canonical, each once per page."""
    links = extract_links(pages).where(same_site(F.col("link"), netloc(F.col("url"))))
    found = links.select("url", canonical_url(F.col("link")).alias("link"))
    return found.distinct().withColumn("skipped", is_skipped(F.col("link")))


def frontier(links: DataFrame, visited: DataFrame) -> DataFrame:
    """``(link, skipped)``: addresses not visited yet. Links merge before they meet ``visited``."""
    new = links.select("link", "skipped").distinct()
    return new.join(visited.select(F.col("url").alias("link")), "link", "left_anti")


def site_seeds(pages: DataFrame) -> DataFrame:
    """One start address per site: the smallest."""
    addresses = pages.select(canonical_url(F.col("url")).alias("url"))
    return addresses.groupBy(netloc(F.col("url")).alias("site")).agg(F.min("url").alias("url"))


def reachable(pages: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(url, depth)`` of every address found from the seeds by breadth-first search.

    Addresses on the skip list are found but not followed, as are addresses without a stored page.
    All sites are searched side by side, one join per level, and each level is written to the
    checkpoint folder, so a lost executor does not repeat earlier levels. Nothing is left out; who
    wants the first levels or small sites only filters by ``depth`` or by ``site_sizes``.
    """
    edges = cut(
        site_links(pages)
        .select(canonical_url(F.col("url")).alias("url"), "link", "skipped")
        .distinct()
    )
    level = cut(
        seeds.select("url").distinct().select("url", F.lit(0).alias("depth"), F.lit(False).alias("skipped"))
    )
    levels = [level]
    depth = 0
    while not level.isEmpty():
        visited = _united(levels)
        if len(levels) > _MERGE_EVERY:
            visited = cut(visited)
            levels = [visited]
        follow = level.where(~F.col("skipped"))
        found = edges.join(follow.select("url"), "url").select("link", "skipped").distinct()
        depth += 1
        new = found.join(visited.select(F.col("url").alias("link")), "link", "left_anti")
        level = cut(new.select(F.col("link").alias("url"), F.lit(depth).alias("depth"), "skipped"))
        levels.append(level)
    return _united(levels).select("url", "depth")


def site_sizes(found: DataFrame) -> DataFrame:
    """``(site, depth, addresses)`` of what ``reachable`` found."""
    site = netloc(F.col("url")).alias("site")
    return found.groupBy(site, "depth").agg(F.count("*").alias("addresses"))


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
