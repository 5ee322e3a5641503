"""Raster validation: confusion metrics, baselines, pairwise differences, attribution, seams.

Every metric set is one scan that reduces to a single row or to a histogram of integer codes (at most 65,536 rows);
the ratios are computed on that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewater.functions import values as V
from tilewater.operators.joins import neighbor_any, with_row
from tilewater.operators.ordered import Ordered
from tilewater.operators.raster_stats import threshold_counts

C = F.col


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL when b is zero."""
    return F.when(b != 0, a / b)


def _per_threshold(counts: DataFrame, feet, fields: dict[str, str]) -> DataFrame:
    """Turn the one-row threshold counters into one row per threshold; `fields` maps output -> column pattern."""
    rows = [F.struct(F.lit(float(ft)).alias("threshold_ft"), *[C(p.format(i=i)).alias(n) for n, p in fields.items()])
            for i, ft in enumerate(feet)]
    return counts.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def confusion_counts(cells: DataFrame, hand: str, reference: Column, feet) -> DataFrame:
    """threshold_ft, valid, ref, hand, tp per threshold, from one scan."""
    counts = threshold_counts(cells, hand, feet, {"ref": reference})
    return _per_threshold(counts, feet, {"valid": "valid", "ref": "ref", "hand": "low_{i}", "tp": "low_{i}_ref"})


def confusion_metrics(counts: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Confusion cells, IoU, precision, recall, coverages; NULL on zero denominators. The columns `keep` pass through."""
    tp, fp = C("tp"), C("hand") - C("tp")
    fn, valid = C("ref") - C("tp"), C("valid")
    return counts.select(
        *(keep or []), "threshold_ft", "valid", "ref", "hand", "tp", fp.alias("fp"), fn.alias("fn"), (valid - tp - fp - fn).alias("tn"),
        ratio(tp, tp + fp + fn).alias("iou"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(C("hand") * 100.0, valid).alias("hand_pct"), ratio(C("ref") * 100.0, valid).alias("ref_pct"),
        ratio(tp * 100.0, C("ref")).alias("overlap_pct_of_ref"), ratio(tp * 100.0, C("hand")).alias("overlap_pct_of_hand"))


def random_baseline(metrics: DataFrame) -> DataFrame:
    """What a random mask of the same coverage would score, and the lifts over it."""
    exp_tp = ratio(C("hand") * C("ref"), C("valid"))
    m = metrics.withColumn("random_tp", exp_tp)
    union = C("hand") + C("ref") - C("random_tp")
    m = m.withColumn("random_iou", F.when((C("random_tp") > 0) & (union > 0), C("random_tp") / union)) \
         .withColumn("random_precision", F.when((C("hand") > 0) & (C("valid") > 0), C("ref") / C("valid")))
    lift = lambda a, b: F.when(C(b) > 0, C(a) / C(b))
    return m.withColumn("precision_lift", lift("precision", "random_precision")).withColumn("iou_lift", lift("iou", "random_iou"))


def same_coverage_baseline(cells: DataFrame, hand: str, baseline: str, reference: Column, feet) -> DataFrame:
    """Mask of the lowest baseline values with the coverage of each threshold mask (ties at the cutoff included).

    Baseline values are counted first; the cutoff is the value at which the running count reaches the wanted number of
    cells, and cells and hits at or under it are sums over the same value counts, so no global sort of cells happens.
    """
    counts = confusion_counts(cells, hand, reference, feet)
    valid = C(hand).isNotNull()
    by_value = cells.where(valid & C(baseline).isNotNull()).groupBy(C(baseline).alias("bv")).agg(
        F.count("*").alias("n"), F.count_if(reference).alias("hits"))
    ranked = Ordered(by_value, [], ["bv"]).running_total("n", "cum_n").running_total("hits", "cum_hits").result()
    total = by_value.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("candidates"))
    targets = with_row(counts, total).withColumn("rank", F.least("hand", "candidates"))
    wanted = targets.agg(F.collect_list(F.struct("threshold_ft", "rank")).alias("w"))  # one entry per threshold
    reached = with_row(ranked, wanted).select(F.explode("w").alias("t"), "bv", "cum_n", "cum_hits") \
        .where((C("t.rank") > 0) & (C("cum_n") >= C("t.rank"))) \
        .groupBy(C("t.threshold_ft").alias("threshold_ft")).agg(
            F.min("bv").alias("cutoff"), F.min_by("cum_n", "bv").alias("cells"), F.min_by("cum_hits", "bv").alias("base_tp"))
    j = targets.join(reached, "threshold_ft", "left")
    fn = C("ref") - C("base_tp")
    base = j.select(
        "threshold_ft", "hand", "tp", "ref", "valid", "cutoff", "cells", "base_tp",
        ratio(C("base_tp"), C("cells")).alias("base_precision"), ratio(C("base_tp"), C("base_tp") + fn).alias("base_recall"),
        ratio(C("base_tp"), C("cells") + fn).alias("base_iou"), ratio(C("cells") * 100.0, C("valid")).alias("base_pct"))
    precision, iou = ratio(C("tp"), C("hand")), ratio(C("tp"), C("hand") + C("ref") - C("tp"))
    return base.withColumn("precision_lift", F.when(C("base_precision") > 0, precision / C("base_precision"))) \
               .withColumn("iou_lift", F.when(C("base_iou") > 0, iou / C("base_iou"))).drop("tp", "ref", "valid")


def mask_jaccard(cells: DataFrame, a: str, b: str, feet) -> DataFrame:
    """|A and B| / |A or B| of two threshold masks, NULL when both are empty."""
    rows = []
    aggs = []
    for i, ft in enumerate(feet):
        limit = float(ft) * V.FEET_TO_M * 10.0
        la, lb = F.coalesce(C(a) <= limit, F.lit(False)), F.coalesce(C(b) <= limit, F.lit(False))
        aggs += [F.count_if(la & lb).alias(f"_i{i}"), F.count_if(la | lb).alias(f"_u{i}")]
        rows.append(F.struct(F.lit(float(ft)).alias("threshold_ft"), C(f"_i{i}").alias("both"), C(f"_u{i}").alias("either"),
                             ratio(C(f"_i{i}"), C(f"_u{i}")).alias("jaccard")))
    return cells.agg(*aggs).select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def _linear_from_histogram(hist: DataFrame, keys: list[str], quantiles: dict[str, float], extra: list[Column]) -> DataFrame:
    """Linear-interpolation quantiles of integer `d` weighted by `n`, plus `extra` aggregates over all histogram rows.

    Rows with NULL `d` take part in `extra` only. The histogram is bounded by the code range per key.
    """
    part = keys or [F.lit(0)]
    w = Window.partitionBy(*part).orderBy(F.col("d").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*part)
    counted = F.when(C("d").isNotNull(), C("n")).otherwise(0)
    r = hist.withColumn("_cum", F.sum(counted).over(w)).withColumn("_tot", F.sum(counted).over(whole))
    aggs = []
    for name, q in quantiles.items():
        pos = (C("_tot") - 1) * F.lit(q)
        lo = F.floor(pos)
        at = lambda rank: F.min(F.when(C("d").isNotNull() & (C("_cum") > rank), C("d")))
        aggs += [at(lo).alias(f"_lo_{name}"), at(F.least(lo + 1, C("_tot") - 1)).alias(f"_hi_{name}"), F.max(pos - lo).alias(f"_w_{name}")]
    g = r.groupBy(*keys).agg(*aggs, *extra)
    for name in quantiles:
        g = g.withColumn(name, C(f"_lo_{name}") + (C(f"_hi_{name}") - C(f"_lo_{name}")) * C(f"_w_{name}")) \
             .drop(f"_lo_{name}", f"_hi_{name}", f"_w_{name}")
    return g


def raster_diff_stats(pairs: DataFrame, a: str, b: str, feet, quantiles=(50, 90, 95, 99)) -> DataFrame:
    """Counts, difference statistics in metres and per-threshold overlap of two code rasters, from one scan."""
    va, vb = C(a).isNotNull(), C(b).isNotNull()
    low = lambda c, ft: F.coalesce(C(c) <= int(round(ft * V.FEET_TO_M * 10.0)), F.lit(False))
    counters = [F.count("*").alias("n"), F.count_if(va).alias("va"), F.count_if(vb).alias("vb")]
    for i, ft in enumerate(feet):
        la, lb = low(a, ft), low(b, ft)
        counters += [F.count_if(la).alias(f"la{i}"), F.count_if(lb).alias(f"lb{i}"), F.count_if(la & lb).alias(f"li{i}"),
                     F.count_if(la | lb).alias(f"lu{i}")]
    hist = pairs.groupBy(F.abs(C(a) - C(b)).alias("d")).agg(*counters)
    total = lambda c, cond=None: F.coalesce(F.sum(C(c) if cond is None else F.when(cond, C(c))), F.lit(0))
    extra = [total("n").alias("cells"), total("va").alias("valid_a"), total("vb").alias("valid_b"),
             total("n", C("d").isNotNull()).alias("valid_pairs"), total("n", C("d") > 10).alias("gt_1m"),
             (F.sum(C("d") * C("n")) / F.sum(F.when(C("d").isNotNull(), C("n"))) / 10.0).alias("mean_m"),
             (F.max("d") / 10.0).alias("max_m"),
             (F.sum(F.when(C("d") <= 10, C("n")).otherwise(F.when(C("d").isNotNull(), 0))) * 100.0
              / F.sum(F.when(C("d").isNotNull(), C("n")))).alias("within_1m_pct")]
    for i, ft in enumerate(feet):
        extra += [total(f"la{i}").alias(f"low_a_{ft}ft"), total(f"lb{i}").alias(f"low_b_{ft}ft"),
                  ratio(total(f"li{i}"), total(f"lu{i}")).alias(f"jaccard_{ft}ft")]
    g = _linear_from_histogram(hist, [], {f"p{q}_m": q / 100.0 for q in quantiles}, extra)
    return g.withColumns({f"p{q}_m": C(f"p{q}_m") / 10.0 for q in quantiles})


def diff_attribution(pairs: DataFrame, a: str, b: str, boundary: Column, height: int, band_rows: int, edge: int,
                     drain_dm: int = 1, limit_dm: int = 10) -> DataFrame:
    """Why cells differ: next to NODATA, to drainage, to a band edge, to the boundary; overlapping and first-match counts."""
    valid = C(a).isNotNull() & C(b).isNotNull()
    drain = F.coalesce(C(a) <= drain_dm, F.lit(False)) | F.coalesce(C(b) <= drain_dm, F.lit(False))
    near = neighbor_any(pairs, {"near_nodata": ~valid, "near_drain": drain})
    # distance to the nearest inner band border; borders are band_rows, 2*band_rows, ... below height
    last = (height - 1) // band_rows * band_rows
    border = lambda n: F.greatest(F.lit(band_rows), F.least(n, F.lit(last)))
    at = F.floor(C("row") / band_rows) * band_rows
    below, above = F.abs(C("row") - border(at)), F.abs(C("row") - border(at + band_rows))
    at_band = F.coalesce(F.least(below, above) <= edge, F.lit(False)) if last > 0 and edge > 0 else F.lit(False)
    over = near.where(valid & (F.abs(C(a) - C(b)) > limit_dm)).withColumn("at_band", at_band).withColumn("at_edge", boundary)
    tests = ("near_nodata", "near_drain", "at_band", "at_edge")
    first = F.when(C("near_nodata"), "near_nodata").when(C("near_drain"), "near_drain").when(C("at_band"), "at_band").when(C("at_edge"), "at_edge")
    o = over.withColumn("_first", first)
    c = o.agg(F.count("*").alias("gt_1m"), *[F.count_if(t).alias(t) for t in tests],
              F.count_if(~C("at_edge")).alias("interior"), F.count_if(C("_first").isNotNull()).alias("explained"),
              F.count_if(C("_first").isNull()).alias("unexplained"),
              *[F.count_if(C("_first") == t).alias(f"first_{t}") for t in tests])
    names = [n for n in c.columns if n != "gt_1m"]
    return c.withColumns({f"{n}_pct": ratio(C(n) * 100.0, C("gt_1m")) for n in names})


def seam_metrics(samples: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Agreement of two rasters along sampled boundary points, per key."""
    low = int(round(3.0 * V.FEET_TO_M * 10.0))
    either = F.coalesce(C(a) <= low, F.lit(False)) | F.coalesce(C(b) <= low, F.lit(False))
    hist = samples.groupBy(*keys, F.abs(C(a) - C(b)).alias("d")).agg(
        F.count("*").alias("n"), F.count(a).alias("va"), F.count(b).alias("vb"), F.count_if(either).alias("low"))
    pairs = F.sum(F.when(C("d").isNotNull(), C("n")))
    within = lambda dm: F.sum(F.when(C("d") <= dm, C("n")).otherwise(F.when(C("d").isNotNull(), 0))) * 100.0 / pairs
    extra = [F.sum("n").alias("samples"), F.sum("va").alias("valid_a"), F.sum("vb").alias("valid_b"),
             F.coalesce(pairs, F.lit(0)).alias("valid_pairs"), F.sum("low").alias("either_low"),
             (F.sum("low") * 100.0 / F.sum("n")).alias("either_low_pct"), (F.sum(C("d") * C("n")) / pairs / 10.0).alias("mean_m"),
             (F.max("d") / 10.0).alias("max_m"), within(3).alias("within_0p3m_pct"), within(10).alias("within_1m_pct")]
    g = _linear_from_histogram(hist, keys, {"p50_m": 0.5, "p90_m": 0.9, "p95_m": 0.95}, extra)
    return g.withColumns({c: C(c) / 10.0 for c in ("p50_m", "p90_m", "p95_m")})


def tile_vs_static(pairs: DataFrame, zoom: str, tile: list[str], a: str, b: str, max_p95_ft: float, max_mismatch: float) -> DataFrame:
    """Rendered against stored tiles per zoom and over all (zoom NULL), with the pass flag."""
    va, vb = C(a).isNotNull(), C(b).isNotNull()
    hist = pairs.groupBy(zoom, F.abs(C(a) - C(b)).alias("d")).agg(
        F.count("*").alias("n"), F.count_if(va != vb).alias("xor"))
    every = hist.groupBy(F.lit(None).cast("int").alias(zoom), "d").agg(F.sum("n").alias("n"), F.sum("xor").alias("xor"))
    both = hist.unionByName(every)
    extra = [F.sum("n").alias("pixels"), F.coalesce(F.sum(F.when(C("d").isNotNull(), C("n"))), F.lit(0)).alias("valid_both"),
             (F.sum("xor") / F.sum("n")).alias("mismatch_rate"), (F.max("d") * V.DM_TO_FEET).alias("max_ft")]
    g = _linear_from_histogram(both, [zoom], {"p50_ft": 0.5, "p95_ft": 0.95, "p99_ft": 0.99}, extra)
    g = g.withColumns({c: C(c) * V.DM_TO_FEET for c in ("p50_ft", "p95_ft", "p99_ft")})
    return g.withColumn("passed", (F.coalesce("p95_ft", F.lit(0.0)) <= max_p95_ft) & (C("mismatch_rate") <= max_mismatch))


def gate_checks(metrics: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One boolean per check (NULL counts as failed) and `all_pass`."""
    named = {n: F.coalesce(c, F.lit(False)) for n, c in checks.items()}
    out = metrics.withColumns(named)
    every = F.lit(True)
    for n in named:
        every = every & C(n)
    return out.withColumn("all_pass", every)
