"""Resolving one source's listings into the stored state: match, merge, lineage, pruning, artist lists.

Later listings see what earlier ones wrote, so resolution is an ordered fold; but a listing can only touch gigs of its
own venue and local day, of the gig it is attached to, and those with the slug it would create. Components of these
blocks are independent: each is folded by itself, in listing order, and they are folded in parallel.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagelight.functions.artists import kind_rank, normalise_names, preferred_name
from stagelight.functions.dates import day_key, literal
from stagelight.functions.text import STOP_WORDS, canonical_title, gig_slug, slugify

Tables = Mapping[str, DataFrame]

GIG = "id string, slug string, venue_id string, title string, description string, status string, starts_at long, ends_at long, ticket_url string, source_url string, tixel_url string, created_at long, updated_at long"
LINEAGE = (
    "id string, gig_id string, source_id string, external_id string, checksum string, source_url string, starts_at_precision string, artist_names array<string>, "
    "artist_extraction_kind string, raw_payload string, source_image_url string, mirrored_image_path string, mirrored_image_width int, mirrored_image_height int, "
    "image_mirror_status string, image_mirrored_at long, last_seen_at long, created_at long"
)
RESULT = "kind string, key string, payload string"


def stable_id(*parts: Column) -> Column:
    """Ids are digests of natural keys, so that reruns agree."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 32)


def labels(edges: DataFrame, steps: int = 50) -> DataFrame:
    """(node, root) by smallest labels with pointer jumps; blocks are small, so a few steps do."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    cur = both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")).checkpoint()
    for _ in range(steps):
        seen = both.join(cur.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        new = cur.join(seen, "node").select("node", F.least("root", "near").alias("root"))
        jump = new.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = new.join(jump, "root", "left").select("node", F.least("root", "up").alias("root")).checkpoint()
        if new.join(cur.withColumnRenamed("root", "was"), "node").where("root != was").isEmpty():
            return new
        cur = new
    raise RuntimeError("blocks did not settle")


def _compatible(a: str, b: str) -> bool:
    x, y = set(filter(None, a.split("-"))), set(filter(None, b.split("-")))
    if a == b or (x == y and len(x) >= 2):
        return True
    p, q = x - set(STOP_WORDS), y - set(STOP_WORDS)
    return len(p & q) == min(len(p), len(q)) >= 3 and abs(len(p) - len(q)) <= 2


def _pick(old, new, replace: bool):
    """A blank is filled; else the incoming value counts only for those who may replace."""
    if not old or not new:
        return new or old or None
    return new if replace else old


class _Block:
    """The stored rows of one component while its listings are folded."""

    def __init__(self, gigs: list[dict], rows: list[dict], priorities: dict[str, int], source: str, now: int):
        self.gigs, self.rows = {g["id"]: g for g in gigs}, {r["id"]: r for r in rows}
        self.priorities, self.source, self.now = priorities, source, now
        self.gone: list[tuple[str, str]] = []

    def attached(self, gig: str, source: str | None = None) -> list[dict]:
        return [r for r in self.rows.values() if r["gig_id"] == gig and (source is None or r["source_id"] == source)]

    def identity(self, x: dict) -> dict | None:
        """By external id if the listing has one, else by the checksum of any of the source's rows."""
        name = "external_id" if x.get("external_id") else "checksum"
        same = [r for r in self.rows.values() if r["source_id"] == self.source and r.get(name) == x[name]]
        return min(same, key=lambda r: r["id"], default=None)

    def match(self, x: dict, without: str | None) -> dict | None:
        near = [g for g in sorted(self.gigs.values(), key=lambda g: g["id"]) if g["venue_id"] == x["venue_id"] and g["day"] == x["day"] and g["id"] != without]
        for g in near:
            if g["starts_at"] == x["starts_at"] and g["title_slug"] == x["title_slug"]:
                return g
        same = [g for g in near if g["canonical"] == x["canonical"]]
        if same:
            return same[0] if len(same) == 1 else None
        alike = [g for g in near if _compatible(g["canonical"], x["canonical"])]
        return alike[0] if len(alike) == 1 else None

    def save_fields(self, g: dict, x: dict) -> dict:
        """The gig's fields after the listing, by the rules of ownership and precision."""
        sources = sorted(self.attached(g["id"]), key=lambda r: r["id"])
        owner = next((r for r in sources if r["source_url"] == g["source_url"]), None) or max(sources, key=lambda r: self.priorities.get(r["source_id"], 0), default=None)
        mine = self.priorities.get(self.source, 0)
        replace = owner is None or owner["source_id"] == self.source or mine > self.priorities.get(owner["source_id"], 0)
        owner_exact = (owner or {}).get("starts_at_precision", "exact") == "exact"
        exact = x["starts_at_precision"] == "exact"
        any_exact = any(r["starts_at_precision"] == "exact" for r in sources)
        upgrade = exact and not owner_exact and g["starts_at"] != x["starts_at"]
        take = upgrade or (replace and not (not exact and (owner_exact or any_exact)))
        new = {f: _pick(g.get(f), x.get(f), replace) for f in ("description", "ends_at", "ticket_url", "source_url")}
        title = _pick(g["title"], x["title"], replace)
        keys = x if title == x["title"] else g
        start = x if take else g
        return new | {"title": title, "title_slug": keys["title_slug"], "canonical": keys["canonical"], "starts_at": start["starts_at"], "day": start["day"], "status": x["status"] if replace else g["status"], "venue_id": x["venue_id"]}

    def drop(self, kind: str, key: str) -> None:
        (self.gigs if kind == "gig" else self.rows).pop(key)
        self.gone.append((kind, key))

    def fold(self, x: dict) -> dict:
        old = self.identity(x)
        snapshot = ("external_id", "checksum", "source_url", "starts_at_precision", "artist_names", "artist_extraction_kind", "source_image_url")
        if old and all(old.get(f) == x.get(f) for f in snapshot) and len(self.attached(old["gig_id"], self.source)) == 1 and old["gig_id"] in self.gigs:
            g = self.gigs[old["gig_id"]]
            if all(g.get(f) == v for f, v in self.save_fields(g, x).items()):
                old["last_seen_at"] = self.now
                return {"outcome": "updated", "changed": False, "gig_id": g["id"], "source_gig_id": old["id"]}
        matched = self.match(x, old["gig_id"] if old else None)
        if old and matched and self.attached(old["gig_id"]) == [old]:
            # the old gig has no other attachment: both go
            self.drop("lineage", old["id"])
            self.drop("gig", old["gig_id"])
        g = matched or (self.gigs.get(old["gig_id"]) if old else None)
        if g is None:
            if any(other["slug"] == x["gig_slug"] for other in self.gigs.values()):
                raise ValueError(f"slug {x['gig_slug']} is taken")
            g = {f: x.get(f) for f in ("title", "title_slug", "canonical", "description", "status", "starts_at", "day", "ends_at", "ticket_url", "source_url", "venue_id")}
            g |= {"id": x["new_gig_id"], "slug": x["gig_slug"], "tixel_url": None, "created_at": self.now, "updated_at": self.now}
            self.gigs[g["id"]], outcome = g, "inserted"
        else:
            new, outcome = self.save_fields(g, x), "updated"
            if any(g.get(f) != v for f, v in new.items()):
                g.update(new, updated_at=self.now)
        own = self.attached(g["id"], self.source)
        keeper = self.identity(x) or min(own, key=lambda r: (not (r["image_mirror_status"] == "ready" and r.get("mirrored_image_path")), -r["last_seen_at"], -r["created_at"], r["id"]), default=None)
        if keeper:
            for r in own:
                if r["id"] != keeper["id"]:
                    self.drop("lineage", r["id"])
        row = keeper or {"id": x["new_source_gig_id"], "source_id": self.source, "created_at": self.now}
        ready = bool(x.get("source_image_url")) and row.get("source_image_url") == x.get("source_image_url") and row.get("image_mirror_status") == "ready" and all(row.get(f) for f in ("mirrored_image_path", "mirrored_image_width", "mirrored_image_height"))
        if not ready:
            row |= {"mirrored_image_path": None, "mirrored_image_width": None, "mirrored_image_height": None, "image_mirrored_at": None}
        row |= {f: x.get(f) for f in (*snapshot, "raw_payload")}
        row |= {"gig_id": g["id"], "image_mirror_status": "ready" if ready else "pending" if x.get("source_image_url") else "missing", "last_seen_at": self.now}
        self.rows[row["id"]] = row
        return {"outcome": outcome, "changed": True, "gig_id": g["id"], "source_gig_id": row["id"]}


def _fold(source: str, priorities: dict[str, int], now: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        of = lambda kind: [json.loads(p) for p in pdf.loc[pdf.kind == kind].sort_values(["ordinal", "key"]).payload]
        block, out = _Block(of("gig"), of("lineage"), priorities, source, now), []
        for x in of("listing"):
            try:
                result = block.fold(x)
            except ValueError as error:
                result = {"outcome": "failed", "changed": False, "error": str(error)}
            out.append(("outcome", x["listing_id"], json.dumps(result)))
        out += [("gig", k, json.dumps(g)) for k, g in block.gigs.items()] + [("lineage", k, json.dumps(r)) for k, r in block.rows.items()]
        return pd.DataFrame(out, columns=["kind", "key", "payload"])

    return run


def _payload(kind: str, key: str, ordinal: Column, columns: list[str]) -> list[Column]:
    return [F.lit(kind).alias("kind"), F.col(key).alias("key"), ordinal.cast("long").alias("ordinal"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("payload")]


def _micros(df: DataFrame) -> DataFrame:
    return df.select(*(F.unix_micros(c).alias(c) if kind == "timestamp" else F.col(c) for c, kind in df.dtypes))


def _stored(rows: DataFrame, schema: str, like: DataFrame) -> DataFrame:
    parsed = rows.select(F.from_json("payload", schema).alias("p")).select("p.*")
    return parsed.select(*(F.timestamp_micros(c).alias(c) if kind == "timestamp" else F.col(c).cast(kind).alias(c) for c, kind in like.select(*parsed.columns).dtypes))


def prepare(listings: DataFrame) -> DataFrame:
    """Keys of normalised listings (schema.NORMALISED with `ordinal`)."""
    venue_id = stable_id(F.lit("venue"), F.col("venue.slug"))
    own = F.coalesce("external_id", "checksum")
    return listings.select(
        stable_id(F.col("source_slug"), F.col("ordinal"), own).alias("listing_id"), "ordinal", "external_id", "checksum", "source_url", "starts_at_precision", normalise_names(F.col("artists")).alias("artist_names"),
        "artist_extraction_kind", "raw_payload", F.col("image_url").alias("source_image_url"), "title", "description", "status", "starts_at", "ends_at", "ticket_url", "venue", venue_id.alias("venue_id"),
        day_key(F.col("starts_at")).alias("day"), slugify(F.col("title")).alias("title_slug"), canonical_title(F.col("title")).alias("canonical"), gig_slug(F.col("venue.slug"), F.col("starts_at"), F.col("title")).alias("gig_slug"),
        stable_id(F.lit("gig"), gig_slug(F.col("venue.slug"), F.col("starts_at"), F.col("title"))).alias("new_gig_id"), stable_id(F.lit("lineage"), F.col("source_slug"), own).alias("new_source_gig_id"),
    )


def merge_venues(t: Tables, listings: DataFrame, now: datetime) -> DataFrame:
    """venues with those of the listings, the last of each slug; a missing website keeps the stored one."""
    from stagelight.operators.merging import upsert

    new = listings.groupBy(F.col("venue.slug").alias("slug")).agg(F.max_by("venue", "ordinal").alias("v")).select("slug", stable_id(F.lit("venue"), F.col("slug")).alias("id"), F.col("v.name").alias("name"), F.col("v.suburb").alias("suburb"), F.col("v.address").alias("address"), F.col("v.website_url").alias("website_url"))
    rules = {"website_url": F.coalesce("new.website_url", "old.website_url"), "id": F.coalesce("old.id", "new.id")}
    return upsert(t["venues"], new, ["slug"], rules, literal(now))


def resolve_source(t: Tables, source_id: str, listings: DataFrame, now: datetime) -> tuple[dict[str, DataFrame], DataFrame]:
    """(new tables, outcomes) after one source's listings, in the order of `ordinal`. Sources run one after another.

    outcomes: listing_id, outcome (inserted, updated or failed), changed, gig_id, source_gig_id, error. A slug that
    another gig has is a failed listing. Rows outside the touched components pass through unchanged.
    """
    venues = merge_venues(t, listings, now).checkpoint()
    x = prepare(listings).join(venues.select(F.col("slug").alias("_slug"), F.col("id").alias("_venue")), F.col("venue.slug") == F.col("_slug"), "left").withColumn("venue_id", F.coalesce("_venue", "venue_id")).drop("_slug", "_venue", "venue").checkpoint()
    block = F.concat_ws("|", F.lit("b"), "venue_id", "day")
    gigs = t["gigs"].withColumn("day", day_key(F.col("starts_at"))).withColumn("title_slug", slugify(F.col("title"))).withColumn("canonical", canonical_title(F.col("title"))).withColumn("block", block)
    mine = t["source_gigs"].where(F.col("source_id") == source_id)
    x = x.withColumn("block", block)
    on_id = x.where("external_id is not null").select("external_id", "block").join(mine.select("external_id", "gig_id"), "external_id").select("block", "gig_id")
    on_sum = x.where("external_id is null").select("checksum", "block").join(mine.select("checksum", "gig_id"), "checksum").select("block", "gig_id")
    to_attached = on_id.unionByName(on_sum).join(gigs.select(F.col("id").alias("gig_id"), F.col("block").alias("b")), "gig_id").select(F.col("block").alias("a"), "b")
    slug_node = lambda c: F.concat(F.lit("s|"), c)
    to_slug = x.select(F.col("block").alias("a"), slug_node(F.col("gig_slug")).alias("b"))
    from_slug = gigs.join(x.select(F.col("gig_slug").alias("slug")), "slug", "left_semi").select(F.col("block").alias("a"), slug_node(F.col("slug")).alias("b"))
    root = labels(to_attached.unionByName(to_slug).unionByName(from_slug)).select(F.col("node").alias("block"), "root").checkpoint()
    x = x.join(root, "block")
    touched = gigs.join(root, "block").checkpoint()
    lineage = t["source_gigs"].join(touched.select(F.col("id").alias("gig_id"), "root"), "gig_id").checkpoint()
    columns = {"listing": [c for c in x.columns if c not in ("block", "root", "ordinal")], "gig": [c for c in gigs.columns if c != "block"], "lineage": [c for c in t["source_gigs"].columns if c != "identity_key"]}
    rows = _micros(x).select("root", *_payload("listing", "listing_id", F.col("ordinal"), columns["listing"]))
    rows = rows.unionByName(_micros(touched).select("root", *_payload("gig", "id", F.lit(0), columns["gig"]))).unionByName(_micros(lineage).select("root", *_payload("lineage", "id", F.lit(0), columns["lineage"])))
    priorities = {r.id: r.priority or 0 for r in t["sources"].select("id", "priority").collect()}  # the source registry: a few rows
    micros = int(pd.Timestamp(now).tz_convert("UTC").value // 1000) if now.tzinfo else int(pd.Timestamp(now).value // 1000)
    out = rows.groupBy("root").applyInPandas(_fold(source_id, priorities, micros), RESULT).checkpoint()
    new_gigs = _stored(out.where("kind = 'gig'"), GIG, t["gigs"])
    new_rows = _stored(out.where("kind = 'lineage'"), LINEAGE, t["source_gigs"]).withColumn("identity_key", F.coalesce("external_id", "checksum"))
    outcomes = out.where("kind = 'outcome'").select(F.col("key").alias("listing_id"), F.from_json("payload", "outcome string, changed boolean, gig_id string, source_gig_id string, error string").alias("p")).select("listing_id", "p.*")
    tables = dict(t) | {
        "venues": venues,
        "gigs": t["gigs"].join(touched.select("id"), "id", "left_anti").unionByName(new_gigs.select(*t["gigs"].columns)).checkpoint(),
        "source_gigs": t["source_gigs"].join(lineage.select("id"), "id", "left_anti").unionByName(new_rows.select(*t["source_gigs"].columns)).checkpoint(),
    }
    return tables, outcomes


def prune(t: Tables, before: Tables, source_id: str, listings: DataFrame, outcomes: DataFrame, now: datetime) -> dict[str, DataFrame]:
    """Without the source's rows that were active and upcoming before the run and that the run did not list; gigs
    without any row go too. Nothing is pruned after a run with a failure or without a listing."""
    n, failed = outcomes.agg(F.count("*"), F.count_if(F.col("outcome") == "failed")).first()
    if failed or not n:
        return dict(t)
    live = before["gigs"].where((F.col("status") == "active") & (F.col("starts_at") >= literal(now))).select(F.col("id").alias("gig_id"))
    kept = listings.select(F.coalesce("external_id", "checksum").alias("identity_key"))
    written = outcomes.select(F.col("source_gig_id").alias("id")).where("id is not null")
    stale = before["source_gigs"].where(F.col("source_id") == source_id).join(live, "gig_id", "left_semi").join(kept, "identity_key", "left_anti").select("id", "gig_id").join(written, "id", "left_anti")
    rows = t["source_gigs"].join(stale.select("id"), "id", "left_anti")
    orphans = stale.select("gig_id").distinct().join(rows.select("gig_id"), "gig_id", "left_anti")
    gigs = t["gigs"].join(orphans.select(F.col("gig_id").alias("id")), "id", "left_anti")
    links = t["gig_artists"].join(gigs.select(F.col("id").alias("gig_id")), "gig_id", "left_semi")
    return dict(t) | {"source_gigs": rows, "gigs": gigs, "gig_artists": links}


def canonical_artists(t: Tables) -> DataFrame:
    """(gig_id, artist_names): of the rows with known artists, by kind, priority, number of names, then newest."""
    s = t["sources"].select(F.col("id").alias("source_id"), "priority")
    rows = t["source_gigs"].join(s, "source_id").withColumn("names", normalise_names(F.col("artist_names"))).where("artist_extraction_kind != 'unknown' AND size(names) > 0")
    rank = F.struct(kind_rank(F.col("artist_extraction_kind")), "priority", F.size("names"), "last_seen_at", "id")
    return rows.groupBy("gig_id").agg(F.max_by("names", rank).alias("artist_names"))


def upsert_artists(artists: DataFrame, items: DataFrame) -> DataFrame:
    """artists with the names of items (slug, name, gig_id, sort_order): preferred_name folded over the stored name and
    the items in order. Only capitals can yield to a name before them, so the fold needs no more than the last item
    and the last one not in capitals."""
    from stagelight.operators.merging import upsert

    name, at = F.col("name"), F.struct("gig_id", "sort_order")
    capitals = (name == F.upper(name)) & (name != F.lower(name))
    new = items.where("slug != ''").groupBy("slug").agg(F.max_by("name", at).alias("last"), F.max_by(F.when(~capitals, name), F.when(~capitals, at)).alias("plain"))
    new = new.select("slug", stable_id(F.lit("artist"), F.col("slug")).alias("id"), "last", "plain")
    plain, last = F.col("new.plain"), F.col("new.last")
    folded = F.when(plain.isNull(), preferred_name(F.col("old.name"), last)).otherwise(preferred_name(plain, last))
    return upsert(artists, new, ["slug"], {"id": F.coalesce("old.id", "new.id"), "name": folded})


def sync_artists(t: Tables) -> tuple[dict[str, DataFrame], DataFrame]:
    """(new tables, plan): artists and gig_artists as canonical_artists asks; plan has the gigs whose list changes."""
    want = canonical_artists(t)
    named = t["gig_artists"].join(t["artists"].select(F.col("id").alias("artist_id"), "slug"), "artist_id")
    have = named.groupBy("gig_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sort_order", "slug"))), lambda x: x["slug"]).alias("have"))
    items = want.select("gig_id", F.posexplode("artist_names").alias("sort_order", "name")).withColumn("slug", slugify(F.col("name")))
    items = items.withColumn("first", F.row_number().over(Window.partitionBy("gig_id", "slug").orderBy("sort_order"))).where("first = 1").drop("first")
    slugs = items.groupBy("gig_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sort_order", "slug"))), lambda x: x["slug"]).alias("want"))
    gigs = t["gigs"].select(F.col("id").alias("gig_id"))
    none = F.array().cast("array<string>")
    plan = gigs.join(slugs, "gig_id", "left").join(have, "gig_id", "left").select("gig_id", F.coalesce("want", none).alias("want"), F.coalesce("have", none).alias("have")).where("want != have").checkpoint()
    todo = items.join(plan.select("gig_id"), "gig_id", "left_semi")
    artists = upsert_artists(t["artists"], todo).checkpoint()
    links = todo.join(artists.select(F.col("id").alias("artist_id"), "slug"), "slug").select("gig_id", "artist_id", F.col("sort_order").cast("int").alias("sort_order"))
    kept = t["gig_artists"].join(plan.select("gig_id"), "gig_id", "left_anti")
    return dict(t) | {"artists": artists, "gig_artists": kept.unionByName(links.select(*t["gig_artists"].columns))}, plan


def run_status(outcomes: DataFrame, failed_to_parse: int = 0) -> DataFrame:
    """One row: discovered, inserted, updated, failed, status (success, partial or failed)."""
    n = outcomes.agg(F.count("*").alias("discovered"), F.count_if(F.col("outcome") == "inserted").alias("inserted"), F.count_if(F.col("outcome") == "updated").alias("updated"), (F.count_if(F.col("outcome") == "failed") + failed_to_parse).alias("failed"))
    return n.withColumn("status", F.when(F.col("failed") == 0, "success").when(F.col("inserted") + F.col("updated") > 0, "partial").otherwise("failed"))


def run_source(t: Tables, source_id: str, listings: DataFrame, now: datetime) -> tuple[dict[str, DataFrame], DataFrame]:
    """Resolve, prune, sync artist lists: (tables, outcomes)."""
    new, outcomes = resolve_source(t, source_id, listings, now)
    new = prune(new, t, source_id, listings, outcomes, now)
    return sync_artists(new)[0], outcomes
