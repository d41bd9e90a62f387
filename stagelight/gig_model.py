"""The core tables made of the driver's tables, as DataFrames and as the SQL of the same rows.

Nations are sources, customers venues, parts artists, orders gigs, and line items both the artists of a gig and the
rows in which sources list it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HOURS = {"spark": "make_interval(0, 0, 0, 0, CAST({} AS INT))", "duckdb": "to_hours(CAST({} AS INT))"}
_LINE = "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', CAST(round(l_extendedprice * 100) AS BIGINT))"

#: Table to (driver table, column to expression). Both engines read the expressions; {hours:x} is an interval.
MODEL = {
    "sources": ("nation", {"id": "concat('s', n_nationkey)", "slug": "lower(n_name)", "name": "n_name", "priority": "CAST(n_nationkey * 7 % 4 * 10 AS INT)", "is_public_listing_source": "n_regionkey <> 4"}),
    "venues": ("customer", {
        "id": "concat('v', c_custkey)", "slug": "concat('venue-', c_custkey)", "name": "c_name", "suburb": "CASE WHEN c_nationkey = 3 THEN NULL ELSE lower(c_mktsegment) END",
        "address": "concat('No ', c_nationkey)", "website_url": "CASE WHEN c_acctbal >= 0 THEN concat('https://v', c_custkey, '.example.com/') END",
    }),
    "artists": ("part", {
        "id": "concat('a', p_partkey)", "slug": "concat('artist-', p_partkey)",
        "name": "CASE p_size WHEN 1 THEN 'Special Guests TBA' WHEN 2 THEN concat(p_name, ' | ', p_brand) WHEN 3 THEN concat('and ', p_name) WHEN 4 THEN 'DJ' WHEN 5 THEN concat(p_name, ' &amp; Co') WHEN 6 THEN concat('The ', p_name, ' (', p_brand, ')') ELSE concat(p_name, ' ', p_partkey % 20) END",
    }),
    "gigs": ("orders", {
        "id": "concat('g', o_orderkey)", "slug": "concat('gig-', o_orderkey)", "venue_id": "concat('v', 1 + o_custkey % 40)",
        "title": "CASE o_orderpriority WHEN '1-URGENT' THEN concat('Red Ring Tour ', o_custkey % 3) WHEN '2-HIGH' THEN 'The Blue Bolt & Friends' WHEN '3-MEDIUM' THEN 'Yoga Class with Small Gear' WHEN '4-NOT SPECIFIED' THEN 'Hot ??? Widget, Live w/ Cold Nut' ELSE 'Blue Bolt &amp; Friends Live' END",
        "description": "CASE WHEN o_totalprice > 400000 THEN 'featuring a band' END", "status": "CASE o_orderstatus WHEN 'F' THEN 'cancelled' WHEN 'P' THEN 'postponed' ELSE 'active' END",
        "starts_at": "o_orderdate + {hours:o_orderkey % 24}", "ends_at": "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate + {hours:o_orderkey % 24 + 2} END",
        "ticket_url": "concat('https://shop.oztix.com.au/e/', o_orderkey, '/?x=1')", "source_url": "concat('https://own.example.com/', o_orderkey)",
        "tixel_url": "CASE WHEN o_orderkey % 4 = 0 THEN concat('https://links.example.com/', o_orderkey) END", "created_at": "o_orderdate", "updated_at": "o_orderdate + {hours:o_custkey % 100}",
    }),
    "gig_artists": ("lineitem", {"gig_id": "concat('g', l_orderkey)", "artist_id": "concat('a', l_partkey)", "sort_order": "CASE WHEN l_linenumber < 6 THEN l_linenumber END"}),
    "source_gigs": ("lineitem", {
        "id": f"concat('sg', {_LINE})", "gig_id": "concat('g', l_orderkey)", "source_id": "concat('s', l_suppkey % 25)", "external_id": "CASE WHEN l_tax >= 0.02 THEN concat('x', l_partkey) END",
        "checksum": "concat('c', l_partkey)", "identity_key": "CASE WHEN l_tax >= 0.02 THEN concat('x', l_partkey) ELSE concat('c', l_partkey) END",
        "source_url": "CASE WHEN l_discount > 0.08 THEN concat('https://own.example.com/', l_orderkey) ELSE concat('https://src.example.com/', l_suppkey, '/', l_orderkey) END",
        "starts_at_precision": "CASE WHEN l_returnflag = 'A' THEN 'date' ELSE 'exact' END", "artist_extraction_kind": "CASE l_returnflag WHEN 'A' THEN 'parsed_text' WHEN 'N' THEN 'structured' ELSE 'unknown' END",
        "source_image_url": "CASE WHEN l_returnflag <> 'R' THEN concat('https://img.example.com/', l_partkey) END", "mirrored_image_path": "CASE WHEN l_linestatus = 'F' THEN concat('sha256/ab/', l_partkey) END",
        "mirrored_image_width": "CAST(l_quantity AS INT) - 5", "mirrored_image_height": "CAST(l_linenumber AS INT)", "image_mirror_status": "CASE WHEN l_linestatus = 'F' THEN 'ready' ELSE 'pending' END",
        "image_mirrored_at": "CASE WHEN l_linestatus = 'F' THEN l_shipdate END", "last_seen_at": "l_shipdate", "created_at": "l_shipdate",
    }),
}


def _expression(text: str, engine: str) -> str:
    if "{hours:" not in text:
        return text
    before, rest = text.split("{hours:", 1)
    hours, after = rest.split("}", 1)
    return before + _HOURS[engine].format(hours) + after


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Name to DataFrame of the core tables."""
    out = {}
    for name, (source, columns) in MODEL.items():
        rows = spark.read.parquet(f"{sf_dir}/{source}.parquet")
        rows = rows.select(*(F.col(c).cast("timestamp").alias(c) if kind == "timestamp_ntz" else F.col(c) for c, kind in rows.dtypes))
        out[name] = rows.select(*(F.expr(_expression(e, "spark")).alias(c) for c, e in columns.items()))
    return out


def sql(query: str, *more: str) -> str:
    """query behind the core tables as common table expressions, and those of `more` (`name AS (...)`)."""
    parts = [f"{name} AS (SELECT {', '.join(f'{_expression(e, 'duckdb')} AS {c}' for c, e in columns.items())} FROM {source})" for name, (source, columns) in MODEL.items()]
    return f"WITH {', '.join([*parts, *more])} {query}"
