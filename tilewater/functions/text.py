"""Strings, URLs, identifiers and payload parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tenths(v: Column) -> Column:
    """Ten times the value as a whole double, rounded as C printf rounds one decimal (binary value, half to even).

    The error of the product 10v is recovered exactly as (8v - p) + 2v and settles apparent ties.
    """
    p = v * 10.0
    err = (v * 8.0 - p) + v * 2.0
    tie = (p - F.floor(p) == 0.5) & (err != 0)
    return F.when(tie, F.floor(p) + (err > 0).cast("double")).otherwise(F.rint(p))


def fixed1(v: Column) -> Column:
    """One-decimal text of a double exactly as C printf gives it.

    `format_string` alone rounds the shortest decimal form half up: 0.25 -> 0.3 and 1.45 -> 1.5 where printf has 0.2 and 1.4.
    """
    return F.format_string("%.1f", tenths(v) / 10.0)


# ---- sizes ------------------------------------------------------------------------------------

def format_bytes_dec(n: Column) -> Column:
    """Decimal units with one digit; plain bytes have none."""
    v = n.cast("double")
    step = lambda k: fixed1(v / float(1000 ** k))
    return F.when(v < 1e3, F.concat(v.cast("bigint").cast("string"), F.lit(" B"))) \
        .when(v < 1e6, F.concat(step(1), F.lit(" KB"))).when(v < 1e9, F.concat(step(2), F.lit(" MB"))) \
        .when(v < 1e12, F.concat(step(3), F.lit(" GB"))).otherwise(F.concat(step(4), F.lit(" TB")))


def format_bytes_bin(n: Column) -> Column:
    """Binary units, whole numbers, floor at every step."""
    out = None
    for k, unit in enumerate(("B", "K", "M", "G", "T")):
        text = F.concat(F.shiftright(n.cast("bigint"), 10 * k).cast("string"), F.lit(unit))
        cond = n < 1 << (10 * (k + 1))
        out = F.when(cond, text) if out is None else out.when(cond, text)
    return out.otherwise(F.concat(F.shiftright(n.cast("bigint"), 50).cast("string"), F.lit("P")))


# ---- identifiers ------------------------------------------------------------------------------

def huc_valid(code: Column) -> Column:
    """Trimmed six-digit unit code, else NULL."""
    c = F.trim(code)
    return F.when(c.rlike(r"^\d{6}$"), c)


def huc_from_name(path: Column) -> Column:
    """Unit code of an archive file name (`.../010700.zip`), else NULL."""
    m = F.regexp_extract(path, r"(?i)(?:^|/)(\d{6})\.zip$", 1)
    return F.when(m != "", m)


def slugify(name: Column) -> Column:
    s = F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(s == "", "region").otherwise(s)


def number_tag(v: Column) -> Column:
    """`5.5` -> `5p5`, `-2` -> `m2`; whole numbers have no fraction."""
    shown = F.regexp_replace(v.cast("string"), r"\.0$", "")
    return F.translate(shown, ".-", "pm")


def pair_tag(a: Column, b: Column, buffer_km: Column) -> Column:
    first, second = F.least(a, b), F.greatest(a, b)
    return F.concat(F.lit("pair-"), first, F.lit("-"), second, F.lit("-buffer"), number_tag(buffer_km), F.lit("km"))


def coverage_label(count: Column, only_id: Column) -> Column:
    """Title-cased id for a single region, else `n regions`. Every run of letters is capitalised (`v0p21` -> `V0P21`)."""
    runs = F.regexp_extract_all(F.lower(F.replace(only_id, F.lit("-"), F.lit(" "))), F.lit("[a-z]+|[^a-z]+"), F.lit(0))
    return F.when(count == 1, F.array_join(F.transform(runs, F.initcap), "")) \
        .otherwise(F.concat(count.cast("string"), F.lit(" regions")))


# ---- URLs and network-log entries ---------------------------------------------------------------

def url_host(url: Column) -> Column:
    """Lower-cased host, `invalid` when the text is not an absolute URL."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(F.coalesce(host, F.lit("")) == "", "invalid").otherwise(F.lower(host))


def mime_group(mime: Column) -> Column:
    """First matching rule wins, in this order."""
    has = lambda s: mime.contains(s)
    head = F.element_at(F.split(mime, ";"), 1)
    return F.when(F.coalesce(mime, F.lit("")) == "", "other").when(has("javascript"), "js") \
        .when(mime.startswith("text/"), "text").when(mime.startswith("image/"), "image").when(has("json"), "json") \
        .when(has("protobuf") | has("pbf"), "pbf").when(has("octet-stream"), "binary").when(has("wasm"), "wasm") \
        .otherwise(F.when(head == "", "other").otherwise(head))


def entry_size(body: Column, headers: Column, content: Column) -> Column:
    """Body bytes, else headers plus content, else content; negative means unknown."""
    known = lambda c: F.when(c >= 0, c).otherwise(0)
    b, h, c = known(body), known(headers), F.coalesce(content, F.lit(0))
    return F.when(b != 0, b).otherwise(h + c)


# Tile paths.
ELEVATION_PATH = r"/elevation-data/(\d+)/(\d+)/(\d+)\.u16"
VECTOR_PATH = r"/vector/usa/(\d+)/(\d+)/(\d+)\.pbf"


def tile_url_parse(url: Column) -> Column:
    """struct<kind,z,x,y>, NULL kind when the URL is not a tile."""
    elev, vect = url.rlike(ELEVATION_PATH), url.rlike(VECTOR_PATH)
    part = lambda i: F.when(elev, F.regexp_extract(url, ELEVATION_PATH, i).try_cast("int")) \
        .when(vect, F.regexp_extract(url, VECTOR_PATH, i).try_cast("int"))
    return F.struct(F.when(elev, "elevation").when(vect, "vector").alias("kind"),
                    part(1).alias("z"), part(2).alias("x"), part(3).alias("y"))


# View-state defaults and limits.
VIEW_DEFAULTS = {"lat": 33.5186, "lng": -86.8104, "zoom": 11.3, "water": 10.0}
VIEW_LIMITS = {"lat": (-85.051129, 85.051129), "lng": (-180.0, 180.0), "zoom": (0.0, 14.0), "water": (0.1, 10000.0)}
VIEW_DIGITS = {"lat": 5, "lng": 5, "zoom": 2, "water": 1}
VIEW_KEYS = ("lat", "lng", "zoom", "view", "water")


def _param(url: Column, key: str) -> Column:
    m = F.regexp_extract(url, rf"[?&]{key}=([^&#]*)", 1)
    return F.when(url.rlike(rf"[?&]{key}(=|&|#|$)"), m)


def view_state_parse(url: Column) -> Column:
    """struct<lat,lng,zoom,water,explicit>: numeric prefix of each parameter, clamped and rounded, defaults elsewhere."""
    fields = []
    for key in ("lat", "lng", "zoom", "water"):
        lo, hi = VIEW_LIMITS[key]
        f = float(10 ** VIEW_DIGITS[key])
        num = F.regexp_extract(_param(url, key), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")
        good = num.isNotNull() & (num > 0) if key == "water" else num.isNotNull()
        val = F.floor(F.greatest(F.lit(lo), F.least(F.lit(hi), num)) * f + 0.5) / f
        fields.append(F.when(good, val).otherwise(VIEW_DEFAULTS[key]).alias(key))
    explicit = None
    for key in VIEW_KEYS:
        here = _param(url, key).isNotNull()
        explicit = here if explicit is None else explicit | here
    return F.struct(*fields, explicit.alias("explicit"))


def _fixed(v: Column, digits: int) -> Column:
    """Text of a value already rounded to `digits` decimals."""
    return F.format_string(f"%.{digits}f", v)


def view_state_url(base: Column, state: Column) -> Column:
    return F.concat(base, F.lit("?lat="), _fixed(state["lat"], 5), F.lit("&lng="), _fixed(state["lng"], 5),
                    F.lit("&zoom="), _fixed(state["zoom"], 2), F.lit("&view=hand&water="), _fixed(state["water"], 1))


# ---- geocoder payloads --------------------------------------------------------------------------

PLACE_SCHEMA = T.StructType([
    T.StructField("display_name", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("lat", T.StringType()), T.StructField("lon", T.StringType()),
    T.StructField("boundingbox", T.ArrayType(T.StringType())),
    T.StructField("address", T.MapType(T.StringType(), T.StringType())),
    T.StructField("category", T.StringType()), T.StructField("type", T.StringType()),
])
# Address keys in order of preference.
PLACE_NAME_KEYS = ("city", "town", "village", "hamlet", "municipality", "county", "state", "postcode")


def squash_spaces(v: Column) -> Column:
    return F.trim(F.regexp_replace(v, r"\s+", " "))


def _filled(v: Column) -> Column:
    t = F.trim(v)
    return F.when(t != "", t)


def place_parse(df: DataFrame, payload: str) -> DataFrame:
    """JSON geocoder results -> name, label, latitude, longitude, bounds; rows without label or coordinates are dropped."""
    p = F.col("_p")
    names = [_filled(F.try_element_at(p["address"], F.lit(k))) for k in PLACE_NAME_KEYS]
    names += [_filled(p["name"]), _filled(F.element_at(F.split(p["display_name"], ","), 1)), F.lit("Unknown location")]
    corner = lambda i: F.get(p["boundingbox"], F.lit(i)).try_cast("double")
    whole = (F.size(p["boundingbox"]) == 4)
    for i in range(4):
        whole = whole & corner(i).isNotNull()
    bound = lambda i: F.when(whole, corner(i))
    keep = [c for c in df.columns if c != payload]
    return df.withColumn("_p", F.from_json(payload, PLACE_SCHEMA)).select(
        *keep, F.coalesce(*names).alias("name"), _filled(p["display_name"]).alias("label"),
        p["lat"].try_cast("double").alias("latitude"), p["lon"].try_cast("double").alias("longitude"),
        bound(0).alias("south"), bound(1).alias("north"), bound(2).alias("west"), bound(3).alias("east"),
    ).where("label IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL")


def search_target(max_zoom: Column, view_zoom: Column) -> list[Column]:
    """Camera for a search result with columns latitude, longitude, south, north, west, east."""
    C = F.col
    boxed = C("south").isNotNull()
    return [
        F.when(boxed, "bounds").otherwise("point").alias("target"),
        F.when(boxed, (C("south") + C("north")) / 2.0).otherwise(C("latitude")).alias("center_lat"),
        F.when(boxed, (C("west") + C("east")) / 2.0).otherwise(C("longitude")).alias("center_lng"),
        F.least(max_zoom, F.when(boxed, F.least(max_zoom, view_zoom)).otherwise(10.5)).alias("zoom"),
    ]


# Address headers in order of trust.
CLIENT_HEADERS = ("cf-connecting-ip", "x-forwarded-for", "x-real-ip", "x-client-ip")


def client_ip(headers: Column, direct: Column) -> Column:
    """First forwarded address that is set and not `unknown`, else the socket address, else `unknown`."""
    found = []
    for h in CLIENT_HEADERS:
        ip = F.trim(F.element_at(F.split(F.try_element_at(headers, F.lit(h)), ","), 1))
        found.append(F.when((ip != "") & (ip != "unknown"), ip))
    return F.coalesce(*found, direct, F.lit("unknown"))


# Layers and properties kept at low zoom.
LOW_ZOOM_MAX = 8
LOW_ZOOM_LAYERS = {"water": ["class"], "waterway": ["class"], "transportation": []}


def _json_length(props: Column) -> Column:
    """Length of a flat text map written as JSON: quotes, colons and commas add six per entry."""
    texts = F.length(F.concat_ws("", F.map_keys(props), F.map_values(props)))
    return F.when(F.size(props) == 0, 2).otherwise(texts + F.size(props) * 6 + 1)


def _allowed(props: Column, layer: Column) -> Column:
    """The entries of `props` that the allow-list of the layer names."""
    empty = F.create_map().cast("map<string,string>")
    maps = []
    for key in sorted({k for keys in LOW_ZOOM_LAYERS.values() for k in keys}):
        layers = [name for name, keys in LOW_ZOOM_LAYERS.items() if key in keys]
        has = layer.isin(*layers) & F.map_contains_key(props, key)
        maps.append(F.when(has, F.create_map(F.lit(key), F.try_element_at(props, F.lit(key)))).otherwise(empty))
    return maps[0] if len(maps) == 1 else F.map_concat(*maps)


def feature_prune(features: DataFrame) -> DataFrame:
    """Low-zoom features keep three layers and an allow-list of properties; other zooms pass unchanged.

    Needs z, layer, geometry, props (map) and `tile` columns z, x, y. A tile whose pruned features would not be smaller
    (or would be none) keeps all of its features, so the decision is one aggregate per tile.
    """
    C = F.col
    tile = ["z", "x", "y"]
    low = C("z") <= LOW_ZOOM_MAX
    kept = C("layer").isin(*LOW_ZOOM_LAYERS) & C("geometry").isNotNull()
    cost = lambda p: _json_length(p) + F.length(F.coalesce("geometry", F.lit("")))
    sized = features.withColumn("_kept", kept).withColumn("_props", _allowed(C("props"), C("layer")))
    use = sized.groupBy(*tile).agg(
        F.sum(F.when(C("_kept"), cost(C("_props")))).alias("_small"), F.sum(cost(C("props"))).alias("_full"))
    j = sized.join(use, tile).withColumn("_use", low & C("_small").isNotNull() & (C("_small") < C("_full")))
    return j.where(~C("_use") | C("_kept")).withColumn("props", F.when(C("_use"), C("_props")).otherwise(C("props"))) \
        .withColumn("pruned", C("_use")).drop("_kept", "_props", "_small", "_full", "_use")


# ---- generalisation ---------------------------------------------------------------------------

def generalization_offset(epsg: Column, simplify_m: Column) -> Column:
    """struct<offset,units,digits>: simplification tolerance in the units of the target system."""
    geographic = epsg.between(4000, 4999)
    return F.struct(
        F.when(geographic, simplify_m / 111320.0).otherwise(simplify_m).alias("offset"),
        F.when(geographic, "degrees").otherwise("crs_units").alias("units"),
        F.when(geographic, 6).otherwise(2).alias("digits"))


def srid_matches(found: Column, target: Column) -> Column:
    """An empty or missing list of declared systems is accepted; otherwise the target must be one of them."""
    return F.coalesce(F.size(found) <= 0, F.lit(True)) | F.array_contains(found, target)
