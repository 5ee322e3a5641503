"""Typed views over the driver tables.

The driver tables hold no rasters, so every raster, archive, request or region view used by the
registered queries is derived from them here, lazily, with built-in expressions only.
Each view has a twin SQL text (`VIEW_SQL`) so that an independent engine can rebuild it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEW_SQL: dict[str, str] = {
    "fx_points": """
        SELECT event_id, user_id, ts, event_type, value / 1e2 AS water_level_m,
               -125e0 + ((event_id * 7919) % 58500) / 1e3 AS lon,
               24e0 + ((event_id * 104729) % 25500) / 1e3 AS lat
        FROM events""",
    "fx_requests": """
        SELECT event_id, user_id, ts, event_type, water_level_m, lon, lat,
               cast(8 + event_id % 7 AS integer) AS z,
               cast(trunc((lon + 180e0) / 360e0 * pow(2e0, 8 + event_id % 7)) AS integer) AS x,
               cast(trunc((1e0 - ln(tan(radians(lat)) + 1e0 / cos(radians(lat))) / pi()) / 2e0
                          * pow(2e0, 8 + event_id % 7)) AS integer) AS y
        FROM fx_points""",
    "fx_tile_cells": """
        SELECT vec_id, 9 AS z, cast(80 + vec_id % 80 AS integer) AS x,
               cast(176 + floor(vec_id / 80) AS integer) AS y,
               cast(floor(k / 8) AS integer) AS row, cast(k % 8 AS integer) AS col,
               CASE WHEN (k + vec_id) % 13 = 0 THEN NULL
                    ELSE cast(floor(cast(e AS double) * 2e3) AS integer) END AS v
        FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS k, unnest(embedding) AS e FROM embeddings)""",
    "fx_regions": """
        SELECT n_nationkey AS priority, n_name AS id,
               -125e0 + (n_nationkey % 5) * 11.7e0 AS west, 24e0 + floor(n_nationkey / 5) * 5.1e0 AS south,
               -112.3e0 + (n_nationkey % 5) * 11.7e0 AS east, 30.1e0 + floor(n_nationkey / 5) * 5.1e0 AS north
        FROM nation""",
    "fx_grid": """
        SELECT cast(floor(o_orderkey / 150) AS integer) AS row, cast(o_orderkey % 150 AS integer) AS col,
               CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE cast(floor(o_totalprice / 1e2) AS integer) END AS v,
               CASE WHEN o_orderkey % 31 = 0 THEN NULL
                    ELSE cast(floor(o_totalprice / 1e2) AS integer) + cast(o_custkey % 21 AS integer) - 10 END AS cand,
               (o_orderstatus = 'F') AS ref_mask, (o_orderpriority = '1-URGENT') AS stream_mask
        FROM orders""",
    "fx_archives": """
        SELECT lpad(cast(10000 + c_custkey % 97 AS varchar), 6, '0') AS huc, c_name AS path,
               cast(floor(abs(c_acctbal) * 100) AS bigint) AS bytes, (c_custkey % 10 <> 0) AS valid_name,
               c_custkey AS pos
        FROM customer""",
    "fx_degree_tiles": """
        SELECT DISTINCT cast(25 + c_custkey % 20 AS integer) AS lat, 
               cast(-80 - ((c_custkey % 20) * 5 + cast(floor(c_custkey / 20) AS bigint) % 23) % 31 AS integer) AS lon
        FROM customer""",
    "fx_entries": """
        SELECT page_id, url,
               CASE page_id % 6 WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/javascript' WHEN 2 THEN 'image/png'
                    WHEN 3 THEN 'application/json' WHEN 4 THEN 'application/x-protobuf'
                    ELSE 'application/octet-stream' END AS mime,
               cast(CASE WHEN page_id % 4 = 0 THEN -1 ELSE length(html) END AS bigint) AS body_size,
               cast(100 + page_id % 50 AS integer) AS headers_size, cast(length(html) AS bigint) AS content_size,
               (page_id * 37 % 4000) / 1e1 AS time_ms, cast(5 + page_id % 7 AS integer) AS z,
               CASE WHEN page_id % 3 = 0 THEN 'vector' ELSE 'elevation' END AS kind
        FROM pages""",
}

#: views that read other views
_NEEDS = {"fx_requests": ["fx_points"]}


def oracle(views: str, body: str) -> str:
    """SQL text for `body` with the named views (space separated) in front as CTEs."""
    names: list[str] = []
    for name in views.split():
        for need in _NEEDS.get(name, []) + [name]:
            if need not in names:
                names.append(need)
    ctes = [f"{n} AS ({VIEW_SQL[n]})" for n in names]
    text = body.strip()
    head = "WITH "
    upper = text.upper()
    if upper.startswith("WITH RECURSIVE "):
        head, text = "WITH RECURSIVE ", text[len("WITH RECURSIVE "):]
        joiner = ",\n"
    elif upper.startswith("WITH "):
        text = text[len("WITH "):]
        joiner = ",\n"
    else:
        joiner = "\n"
    if not ctes:
        return body
    return head + ",\n".join(ctes) + joiner + text


class Tables:
    """The driver tables of one scale folder, plus the derived raster, tile, request and archive views."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def points(self) -> DataFrame:
        e = F.col("event_id")
        return self.read("events").select(
            "event_id", "user_id", "ts", "event_type",
            (F.col("value") / 100.0).alias("water_level_m"),
            (F.lit(-125.0) + ((e * 7919) % 58500) / 1000.0).alias("lon"),
            (F.lit(24.0) + ((e * 104729) % 25500) / 1000.0).alias("lat"),
        )

    def requests(self) -> DataFrame:
        """Tile requests: every point asks for its own tile at a zoom of 8..14."""
        from tilewater.functions import addressing as A

        z = (F.lit(8) + F.col("event_id") % 7).cast("int")
        return self.points().withColumn("z", z).select(
            "*",
            A.tile_x(F.col("lon"), F.col("z")).alias("x"),
            A.tile_y(F.col("lat"), F.col("z")).alias("y"),
        )

    def tile_cells(self) -> DataFrame:
        """8x8 tiles at z9, one row per cell; NODATA is NULL."""
        k, e, v = F.col("k"), F.col("e"), F.col("vec_id")
        return self.read("embeddings").select("vec_id", F.posexplode("embedding").alias("k", "e")).select(
            "vec_id",
            F.lit(9).alias("z"),
            (F.lit(80) + v % 80).cast("int").alias("x"),
            (F.lit(176) + F.floor(v / 80)).cast("int").alias("y"),
            F.floor(k / 8).cast("int").alias("row"),
            (k % 8).cast("int").alias("col"),
            F.when((k + v) % 13 == 0, None).otherwise(F.floor(e.cast("double") * 2000.0).cast("int")).alias("v"),
        )

    def tile_rows(self) -> DataFrame:
        """The same tiles as one row each: vec_id, z, x, y, data (8 * 8 little-endian int16)."""
        from tilewater.sources.tiles import pack_i16

        k = F.col("vec_id")
        values = F.transform("embedding", lambda e, i: F.when((i + k) % 13 != 0, F.floor(e.cast("double") * 2000.0).cast("int")))
        return self.read("embeddings").select(
            "vec_id", F.lit(9).alias("z"), (F.lit(80) + k % 80).cast("int").alias("x"), (F.lit(176) + F.floor(k / 80)).cast("int").alias("y"),
            pack_i16(values).alias("data"))

    def regions(self) -> DataFrame:
        k = F.col("n_nationkey")
        gx, gy = (k % 5) * 11.7, F.floor(k / 5) * 5.1
        return self.read("nation").select(
            k.alias("priority"), F.col("n_name").alias("id"),
            (F.lit(-125.0) + gx).alias("west"), (F.lit(24.0) + gy).alias("south"),
            (F.lit(-112.3) + gx).alias("east"), (F.lit(30.1) + gy).alias("north"),
        )

    def grid(self) -> DataFrame:
        """A 150-column raster pair with two masks, one row per cell; NODATA is NULL."""
        k = F.col("o_orderkey")
        v = F.floor(F.col("o_totalprice") / 100.0).cast("int")
        return self.read("orders").select(
            F.floor(k / 150).cast("int").alias("row"), (k % 150).cast("int").alias("col"),
            F.when(k % 29 == 0, None).otherwise(v).alias("v"),
            F.when(k % 31 == 0, None).otherwise(v + (F.col("o_custkey") % 21).cast("int") - 10).alias("cand"),
            (F.col("o_orderstatus") == "F").alias("ref_mask"),
            (F.col("o_orderpriority") == "1-URGENT").alias("stream_mask"),
        )

    def archives(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.read("customer").select(
            F.lpad((F.lit(10000) + k % 97).cast("string"), 6, "0").alias("huc"),
            F.col("c_name").alias("path"),
            F.floor(F.abs("c_acctbal") * 100).cast("bigint").alias("bytes"),
            (k % 10 != 0).alias("valid_name"), k.alias("pos"),
        )

    def degree_tiles(self) -> DataFrame:
        k = F.col("c_custkey")
        # 23 of 31 columns in each row of degrees, so that there are holes
        return self.read("customer").select(
            (F.lit(25) + k % 20).cast("int").alias("lat"),
            (F.lit(-80) - ((k % 20) * 5 + F.floor(k / 20) % 23) % 31).cast("int").alias("lon"),
        ).distinct()

    def entries(self) -> DataFrame:
        """Network-log entries, one per page."""
        k = F.col("page_id")
        mime = F.when(k % 6 == 0, "text/html").when(k % 6 == 1, "application/javascript") \
            .when(k % 6 == 2, "image/png").when(k % 6 == 3, "application/json") \
            .when(k % 6 == 4, "application/x-protobuf").otherwise("application/octet-stream")
        return self.read("pages").select(
            "page_id", "url", mime.alias("mime"),
            F.when(k % 4 == 0, -1).otherwise(F.length("html")).cast("bigint").alias("body_size"),
            (F.lit(100) + k % 50).cast("int").alias("headers_size"),
            F.length("html").cast("bigint").alias("content_size"),
            ((k * 37 % 4000) / 10.0).alias("time_ms"),
            (F.lit(5) + k % 7).cast("int").alias("z"),
            F.when(k % 3 == 0, "vector").otherwise("elevation").alias("kind"),
        )
