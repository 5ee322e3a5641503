"""Source inventory, ingest planning, run summaries and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewater.operators.joins import with_row

C = F.col


def source_inventory(archives: DataFrame, expected_count: int, expected_bytes: int) -> DataFrame:
    """One-row inventory: files, units, duplicates, bad names, and what is still to come."""
    ok = C("valid_name") & C("huc").isNotNull()
    units = archives.where(ok).groupBy("huc").agg(F.count("*").alias("_n")).agg(
        F.count("*").alias("units"), F.count_if(C("_n") > 1).alias("duplicate_units"))
    files = archives.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
                         F.count_if(~C("valid_name")).alias("invalid_names"))
    zero = F.lit(0).cast("bigint")
    return with_row(files, units).select(
        "files", "units", "bytes", "duplicate_units", "invalid_names",
        F.greatest(zero, F.lit(expected_count) - C("units")).alias("remaining_units"), (C("units") / F.lit(expected_count)).alias("unit_fraction"),
        F.greatest(zero, F.lit(expected_bytes) - C("bytes")).alias("remaining_bytes"), (C("bytes") / F.lit(expected_bytes)).alias("byte_fraction"))


def duplicate_archives(archives: DataFrame) -> DataFrame:
    """Every file of a unit that has more than one, as rows (a unit may have any number of files)."""
    ok = archives.where(C("valid_name") & C("huc").isNotNull())
    many = ok.groupBy("huc").agg(F.count("*").alias("copies")).where("copies > 1")
    return ok.join(many, "huc").select("huc", "path", "copies")


def ingest_plan(archives: DataFrame, done: DataFrame, prefix: str | None = None, start_after: str | None = None,
                limit: int | None = None, force: bool = False, requested: list[str] | None = None) -> DataFrame:
    """Units still to process, in request order or by code. `archives` has one row per unit (huc, path, bytes)."""
    if prefix is not None and not prefix.isdigit():
        raise ValueError("prefix must contain only digits")
    df = archives
    if requested is not None:
        order = list(dict.fromkeys(requested))  # the caller's own list, first mention counts
        df = df.where(C("huc").isin(order)).withColumn("_o", F.array_position(F.array(*[F.lit(h) for h in order]), C("huc")))
    else:
        df = df.withColumn("_o", F.lit(0).cast("bigint"))
    if prefix is not None:
        df = df.where(C("huc").startswith(prefix))
    if start_after is not None:
        df = df.where(C("huc") > start_after)
    if not force:
        df = df.join(done.select("huc"), "huc", "left_anti")
    df = df.orderBy("_o", "huc")
    if limit is not None:
        df = df.limit(limit)
    return df.select("huc", "path", "bytes", F.lit("planned").alias("status"))


def missing_requested(requested: DataFrame, archives: DataFrame, prefix: str | None = None, start_after: str | None = None) -> DataFrame:
    """Requested units without an archive, under the same filters as the plan."""
    df = requested.select("huc").distinct()
    if prefix is not None:
        df = df.where(C("huc").startswith(prefix))
    if start_after is not None:
        df = df.where(C("huc") > start_after)
    return df.join(archives.select("huc"), "huc", "left_anti")


def ingest_states(requested: DataFrame, archives: DataFrame, manifests: DataFrame, dry_run: bool = False) -> DataFrame:
    """ready / missing / missing_manifest per requested unit."""
    a = archives.select("huc", F.lit(True).alias("_a"))
    m = manifests.select("huc", F.lit(True).alias("_m"))
    j = requested.select("huc").distinct().join(a, "huc", "left").join(m, "huc", "left")
    has_a, has_m = C("_a").isNotNull(), C("_m").isNotNull()
    ready = has_m | F.lit(dry_run)
    return j.select("huc", F.when(~has_a & ~has_m, "missing").when(ready, "ready").otherwise("missing_manifest").alias("state"))


def latest_progress(events: DataFrame, key: str = "huc", ts: str = "ts") -> DataFrame:
    """Latest progress event per unit; later lines win equal times."""
    return events.groupBy(key).agg(F.max_by("event", F.struct(ts, "line")).alias("event"), F.max(ts).alias("ts"), F.count("*").alias("events"))


def run_status_counts(results: DataFrame, keys: list[str]) -> DataFrame:
    n = lambda s: F.count_if(C("status") == s)
    return results.groupBy(*keys).agg(
        n("written").alias("written"), n("existing").alias("existing"), n("empty-skipped").alias("empty_skipped"),
        F.coalesce(F.sum(F.when(C("status") == "written", C("bytes"))), F.lit(0)).alias("bytes"), F.max("ms").alias("max_ms"))


# ---- manifests --------------------------------------------------------------------------------

REGION_DDL = "struct<id:string,bbox:array<double>,crs:string,url:string>"
MANIFEST_DDL = ("struct<schema_version:int,dataset_version:string,"
                f"layers:map<string,struct<encoding:string,nodata:int,regions:array<{REGION_DDL}>>>>")
# Known encodings.
ENCODINGS = ("elevation-meter-range", "uint16-decimeters")


def build_manifest(regions: DataFrame, version: str, keys: list[str]) -> DataFrame:
    """Regions (layer, encoding, pos, id, west, south, east, north, crs, url) -> one JSON manifest per `keys`.

    A manifest is one document; choose `keys` so that a document lists a bounded number of source rasters.
    """
    item = F.struct("pos", F.struct("id", F.array("west", "south", "east", "north").alias("bbox"), "crs", "url").alias("r"))
    layers = regions.groupBy(*keys, "layer").agg(
        F.first("encoding").alias("encoding"), F.transform(F.array_sort(F.collect_list(item)), lambda i: i["r"]).alias("regions"))
    entry = F.struct("layer", F.struct("encoding", F.lit(65535).alias("nodata"), "regions").alias("v"))
    doc = F.struct(F.lit(1).alias("schema_version"), F.lit(version).alias("dataset_version"),
                   F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("layers"))
    return layers.groupBy(*keys).agg(F.to_json(doc).alias("manifest"))


def _region_ok(r: Column) -> Column:
    b = lambda i: F.get(r["bbox"], F.lit(i))
    filled = lambda c: F.coalesce(F.length(c), F.lit(0)) > 0
    box = (b(0) >= -180) & (b(0) < b(2)) & (b(2) <= 180) & (b(1) >= -90) & (b(1) < b(3)) & (b(3) <= 90)
    return filled(r["id"]) & filled(r["crs"]) & filled(r["url"]) & (F.size(r["bbox"]) == 4) & F.coalesce(box, F.lit(False))


def scan_manifest(docs: DataFrame, text: str) -> DataFrame:
    """JSON manifests -> ordered regions. A document that breaks any rule is ignored as a whole."""
    m = C("_m")
    layer_ok = lambda k, l: l["encoding"].isin(*ENCODINGS) & (F.coalesce(l["nodata"], F.lit(65535)) == 65535) & \
        F.coalesce(F.forall(l["regions"], _region_ok), F.lit(True))
    every = F.forall(F.map_entries(m["layers"]), lambda e: layer_ok(e["key"], e["value"]))
    ok = (F.coalesce(F.length(m["dataset_version"]), F.lit(0)) > 0) & (F.size(m["layers"]) > 0) & F.coalesce(every, F.lit(False))
    keep = [c for c in docs.columns if c != text]
    return docs.withColumn("_m", F.from_json(text, MANIFEST_DDL)).where(ok) \
        .select(*keep, m["dataset_version"].alias("dataset_version"), F.explode(m["layers"]).alias("layer", "_l")) \
        .select(*keep, "dataset_version", "layer", C("_l.encoding").alias("encoding"), F.posexplode("_l.regions").alias("priority", "_r")) \
        .select(*keep, "dataset_version", "layer", "encoding", "priority", C("_r.id").alias("id"),
                *[F.get(C("_r.bbox"), F.lit(i)).alias(n) for i, n in enumerate(("west", "south", "east", "north"))],
                C("_r.crs").alias("crs"), C("_r.url").alias("url"))


def tile_catalog(tiles: DataFrame) -> DataFrame:
    """Available zooms with their tile counts, and the overall zoom range on every row."""
    z = tiles.groupBy("z").agg(F.count("*").alias("tiles"))
    span = z.agg(F.min("z").alias("min_zoom"), F.max("z").alias("max_zoom"))
    return with_row(z, span)
