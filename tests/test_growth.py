"""What has to stay small as the tables grow: tasks, pairs and rows between the steps."""

from stagelight import function_queries, page_queries, source_queries

SF = "/root/testdata/sf0.001"


def test_a_small_file_of_long_rows_is_dealt_over_all_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    for rows in (page_queries.part(spark, SF), source_queries.part(spark, SF), function_queries.part(spark, SF)):
        assert rows.rdd.getNumPartitions() >= 4 * cores
        assert rows.count() == spark.read.parquet(f"{SF}/part.parquet").count()


def pairs_met(spark, title_rows):
    """How many pairs of titles share a token."""
    from pyspark.sql import functions as F

    from stagelight.operators.matching import title_tokens

    held = spark.createDataFrame(title_rows, "title string").select("title", F.explode(title_tokens(F.col("title"))).alias("token"))
    return held.join(held.withColumnRenamed("title", "other"), "token").where("title < other").select("title", "other").distinct().count()


def test_titles_with_common_words_do_not_meet(spark):
    assert pairs_met(spark, [(f"antiqued-ring-{i}",) for i in range(100)]) == 0
    assert pairs_met(spark, [("red-ring-night",), ("ring-red-night",), ("red-ring-night-one-two",)]) == 3


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_are_not_multiplied(spark):
    from stagelight import queries

    mutual = plan_of(queries.QUERIES["q16_mutual_best"](spark, SF))
    assert "Join Inner, (nation#" not in mutual and "Window" in mutual  # balances are sorted, no nation is joined with itself
    joins = [x for x in plan_of(queries.QUERIES["q17_fuzzy_duplicates"](spark, SF)).splitlines() if "Join Inner" in x and "p_brand" in x]
    assert joins and all("right_key" in x and "array_intersect" not in x for x in joins)  # scored before the blocks meet


def test_own_gig_is_left_out_among_two_and_a_listing_is_looked_up_once(spark):
    from datetime import datetime

    from stagelight.operators.matching import match_tiers

    at, late = datetime(2024, 3, 10, 4), datetime(2024, 3, 10, 6)
    gigs = spark.createDataFrame([("g1", "v", at, "Red Ring Night"), ("g2", "v", at, "Red Ring Night Late"), ("g3", "w", at, "Blue")], "gig_id string, venue_id string, starts_at timestamp, title string")
    listings = spark.createDataFrame(
        [("l1", "v", at, "Red Ring Night", "g1"), ("l2", "v", late, "Night Red Ring Early", None), ("l3", "v", late, "Ring Red Night", "g1"), ("l4", "w", late, "Blue", None), ("l5", "w", at, None, None)], "listing_id string, venue_id string, starts_at timestamp, title string, own_gig_id string"
    )
    found = match_tiers(listings, gigs)
    assert sorted(map(tuple, found.collect())) == [("l1", "g2", 3), ("l2", "g1", 3), ("l3", "g2", 3), ("l4", "g3", 2), ("l5", None, None)]
    assert "listing_id" not in "".join(x for x in plan_of(found).splitlines() if "Aggregate" in x)


def same_as_sql(spark, folder, name, table, rows):
    """A query's rows over a table of those rows equal those of its SQL."""
    import duckdb

    import __spark_entry__

    rows.write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"create view {table} as from '{folder}/{table}.parquet/*.parquet'")
    out = __spark_entry__.queries()[name](spark, str(folder))
    want = con.execute(f"select {', '.join(f'"{c}"' for c in out.columns)} from ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))


def parts(spark, *keys_and_sizes):
    old = spark.read.parquet(f"{SF}/part.parquet")
    return spark.createDataFrame([(k, "large ring", "Brand#7", "LARGE", s, 900.0) for k, s in keys_and_sizes], old.schema)


def test_keys_of_six_digits(spark, tmp_path):
    same_as_sql(spark, tmp_path, "f05_urls", "part", parts(spark, *((k, s) for k in (5, 100_005, 1_100_005) for s in range(1, 11))))


def test_parts_whose_keys_are_ids_of_the_page(spark, tmp_path):
    same_as_sql(spark, tmp_path, "s18_page_data", "part", parts(spark, (8, 2), (9, 4), (1_000_008, 3), (7, 5), (108, 1)).union(parts(spark, (0, 2))))
    same_as_sql(spark, tmp_path / "odd", "s18_page_data", "part", parts(spark, (8, 3), (9, 5)))


def test_entities_without_an_end(spark, tmp_path):
    rows = spark.createDataFrame([(1, "u", "<title>a &amp</title><p>b &amp; c &am &amp;amp; &copy; d&e;</p>")], "page_id long, url string, html string")
    same_as_sql(spark, tmp_path, "f09_html", "pages", rows)


def test_ties_of_a_keeper_have_one_answer(spark, tmp_path):
    from stagelight import queries

    one = spark.read.parquet(f"{SF}/lineitem.parquet").limit(1).drop("l_suppkey")
    for i, keys in enumerate(((30, 10, 20), (20, 30, 10))):
        rows = one.crossJoin(spark.createDataFrame([(k,) for k in keys], "l_suppkey long").coalesce(1))
        rows.coalesce(1).write.parquet(f"{tmp_path}/{i}/lineitem.parquet")
        assert [r.l_suppkey for r in queries.QUERIES["q22_keeper"](spark, f"{tmp_path}/{i}").collect()] == [10]


def test_rows_without_an_image_are_no_join_key(spark):
    from stagelight.operators.images import clear_references

    rows = spark.range(1000).selectExpr("cast(id as string) id", "if(id = 0, 'p', null) mirrored_image_path", "'ready' image_mirror_status")
    gone = spark.createDataFrame([("p", 1, "expired")], "path string, bytes long, kind string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = clear_references(rows, gone, gone.select("path"))
        assert max(out.rdd.glom().map(len).collect()) < 500
        assert out.where("image_mirror_status = 'missing' and mirrored_image_path is null").count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_fuzzy_pairs_score_distinct_keys(spark):
    from datetime import datetime

    from pyspark.sql import functions as F

    from stagelight.plans.audit import fuzzy_pairs, verdict

    cards = spark.createDataFrame([("a", "v", datetime(2024, 3, 10), "Red Ring Night", "u1"), ("b", "v", datetime(2024, 3, 10), "Red Ring Night", "u2"), ("c", "v", datetime(2024, 3, 10), "Blue", "u3")], "id string, venue_slug string, starts_at timestamp, title string, ticket_url string")
    found = fuzzy_pairs(cards)
    assert [(r.left_id, r.right_id, r.score) for r in found.collect()] == [("a", "b", 1.0)]
    joins = [x for x in plan_of(found).splitlines() if "Join Inner" in x and "left_id" in x]
    assert joins and all("array_intersect" not in x for x in joins)
    counted = spark.createDataFrame([("error", 3), ("warning", 2)], "level string, n long")
    assert verdict(counted).select("result", "errors", "warnings").first() == ("fail", 3, 2)
    assert verdict(counted.where(F.lit(False))).first()["errors"] == 0


def links(spark, n):
    """n gigs and n events of one title, venue and start, and one gig and event that are each other's only best."""
    at = "timestamp'2026-04-10 11:00:00'"
    gigs = spark.range(n + 1).selectExpr("cast(id as string) gig_id", f"if(id = {n}, 'Alone', 'Twice') title", f"{at} starts_at", "array('Twice Over') artist_names", "'Hall' venue_name", "'hall' venue_slug", "cast(null as string) tixel_url")
    return gigs, spark.range(n + 1).selectExpr("concat('u', id) url", "'2026-04-10' date_key", f"if(id = {n}, 'Alone', 'Twice') title", f"{at} starts_at", "'Hall' venue_name")


def test_assigned_links_are_counted_not_listed(spark):
    from stagelight.operators.matching import assign_links

    out = assign_links(*links(spark, 3000))  # nine million links
    assert {(r.outcome, r.gig_id): r["count"] for r in out.groupBy("outcome", "gig_id").count().collect()} == {("ambiguous", None): 3000, ("matched", "3000"): 1}
    assert "gig_n" not in plan_of(out) and "Window" not in plan_of(out)


def test_links_of_a_title_at_other_times_and_venues_do_not_meet(spark):
    from datetime import datetime

    from stagelight.operators.matching import link_scores

    at = lambda h, m=0: datetime(2026, 4, 10, h, m)
    gigs = spark.createDataFrame([("1", "Red", at(1), ["Blue Trio"], "Hall", "hall"), ("2", "Red", at(2), ["Blue Trio"], "Bird", "the-bird")], "gig_id string, title string, starts_at timestamp, artist_names array<string>, venue_name string, venue_slug string")
    events = spark.createDataFrame([("a", "2026-04-10", "Red", at(1, 15), "Hall"), ("b", "2026-04-10", "Red", at(2, 16), "Bird"), ("c", "2026-04-10", "Red", at(1, 46), "Club"), ("d", "2026-04-10", "Blue Trio", at(1, 50), "Bird"), ("e", "2026-04-10", "Red", None, "Bird"), ("f", "2026-04-10", "Red", at(1), None)], "url string, date_key string, title string, starts_at timestamp, venue_name string")
    out = link_scores(gigs, events)
    assert sorted(map(tuple, out.collect())) == [("1", "a", 3), ("1", "f", 2), ("2", "b", 1), ("2", "c", 2), ("2", "d", 2), ("2", "e", 1)]
    joins = [x for x in plan_of(out).splitlines() if "Join Inner" in x and "e_at" in x]
    assert joins and all("slot" in x or "e_venue" in x for x in joins)


def test_discovery_cards_meet_distinct_titles(spark):
    from stagelight.operators.matching import plausible_cards

    gigs, events = links(spark, 20)
    plan = plan_of(plausible_cards(events.drop("starts_at"), gigs))
    assert "gig_id" not in "".join(x for x in plan.splitlines() if "Join" in x) and "slot" not in plan and "artist_names" not in plan
    assert plausible_cards(events.drop("starts_at"), gigs.where("title = 'Alone'")).select("url").collect() == [("u20",)]


def test_whole_cards_are_not_dealt_by_venue(spark):
    from stagelight import gig_queries

    lines = plan_of(gig_queries.QUERIES["g01_cards"](spark, SF)).splitlines()
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    (at,) = (i for i, x in enumerate(lines) if "Join Inner, (venue_id" in x)
    after = lines[at + 1 :]
    below = after[: next((i for i, x in enumerate(after) if depth(x) <= depth(lines[at])), len(after))]
    assert len(below) > 2 and "max_by" not in "".join(below)


def executed(frame):
    return frame._jdf.queryExecution().executedPlan().toString().splitlines()


def test_gigs_and_events_are_not_broadcast_by_the_size_of_their_files(spark):
    from stagelight.operators.matching import assign_links, link_scores

    for found in (link_scores(*links(spark, 30)), assign_links(*links(spark, 30))):  # a few kB, however many rows repeat
        plan = executed(found)
        assert not [x for x in plan if "BroadcastHashJoin" in x and any(k in x for k in ("slot", "e_venue", "gig_id", "url"))]
        assert any("SortMergeJoin" in x for x in plan)


def test_pages_are_joined_without_a_broadcast(spark):
    from stagelight import page_queries, source_queries

    # Two columns of many small rows are a few MB of file, and fill the driver as a broadcast.
    for queries, name in ((source_queries, "s08_result_rows"), (source_queries, "s09_discovery"), (page_queries, "s14_event_pages"), (page_queries, "s15_club_pages")):
        plan = executed(queries.QUERIES[name](spark, SF))
        assert any("SortMergeJoin" in x for x in plan) and not any("Broadcast" in x for x in plan), name


def test_plain_tags_are_read_once_and_mean_the_same(spark):
    from stagelight.sources import nodes as N

    page, known = "<div class='x'><p>a<p class='m'>b &amp; c</div><DIV CLASS=x>\n<a href='/1'>l</a></div><div class='x'><p>d</p></div>", {}
    selectors = {"p": N.compile_selector("div.x > p"), "m": N.compile_selector(".m")}
    read = [N._Reader(page, selectors, known=known) for _ in range(2)]
    got = [[(x.labels, x.node, x.until, x.parent, r.text(x), page[slice(*x.html)]) for x in r.marked] for r in read]
    assert got[0] == got[1] == [(["p"], 2, 3, 1, "a", "a"), (["p", "m"], 3, 4, 1, "b & c", "b &amp; c"), (["p"], 7, 8, 6, "d", "d")]
    assert sorted(known) == ["<a href='/1'>", "<div class='x'>", "<p class='m'>", "<p>"]


def test_listings_do_not_travel_by_title_and_are_looked_up_once(spark):
    from stagelight import gig_queries

    plan = executed(gig_queries.QUERIES["g20_match_tiers"](spark, SF))
    assert not any("hashpartitioning(title" in x for x in plan)
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    joins = [x for x in plan if "SortMergeJoin" in x and "LeftOuter" in x]
    assert "starts_at" in min(joins, key=depth) and "canonical" in min(joins, key=depth)  # the last join asks for all tiers


def test_a_text_is_worked_out_once_for_all_words(spark):
    from pyspark.sql import functions as F

    from stagelight.sources.gates import contains_any

    rows = spark.createDataFrame([("A  Play",), ("x",), (None,)], "t string").select(contains_any(F.lower("t"), ["no", "play"]).alias("hit"))
    assert [r.hit for r in rows.collect()] == [True, False, None]
    assert "contains(lower" not in plan_of(rows).lower()
