"""Many basins and many variants of their drainage in one job.

Basins are laid one below the other in block rows and variants side by side in block columns, with an empty block between, so the
block operators of `drainage` see one large sparse raster in which no water crosses from one basin or variant to another. Nothing loops over
basins or variants on the driver, and small basins share stages with large ones.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewater.functions import values as V
from tilewater.operators import drainage as D
from tilewater.operators.ordered import Ordered
from tilewater.operators.validation import confusion_metrics, ratio
from tilewater.session import cut, written

C = F.col
_ROWS = 1 << 31  # rows and columns of the layout are 32-bit numbers


def shelve(cells: DataFrame, basin: str, block: int) -> DataFrame:
    """Place of each basin: basin, start and high (block rows, the empty one included), wide (block columns, likewise), row0, col0 (its first block)."""
    first = lambda c: F.floor(F.min(c) / block)
    last = lambda c: F.floor(F.max(c) / block)
    extent = cells.groupBy(basin).agg((last("row") - first("row") + 2).alias("high"), (last("col") - first("col") + 2).alias("wide"),
                                      first("row").alias("row0"), first("col").alias("col0"))
    return cut(Ordered(extent, [], [basin]).running_total("high", "start").result().withColumn("start", C("start") - C("high")))


def _low(heights: np.ndarray, limit: float) -> np.ndarray:
    """Cells whose height, encoded as a tile would hold it, is at or under the limit (decimetres)."""
    return _codes(heights) <= limit


def _codes(heights: np.ndarray) -> np.ndarray:
    """`values.encode_hand` for an array; NaN where there is no height."""
    single = heights.astype(np.float32)
    return np.where(np.isfinite(single) & (single >= 0), np.minimum(np.rint(single * np.float32(10.0)), V.CODE_MAX), np.nan)


def hand_sensitivity(cells: DataFrame, variants: list[tuple[float, float]], feet, reference: str, cell_area: float = 1.0,
                     block: int = 256, fill_step: float | None = None, basin: str | None = None) -> DataFrame:
    """Coverage, confusion metrics and overlap with the first variant for each (burn, area threshold), per `basin` where one is named.

    `cells`: row, col, v, stream_mask, the boolean column `reference`, and the basin; (row, col) is unique within a basin. Rows and columns of basins
    may overlap. A burn is filled, routed and accumulated once however many thresholds use it. Counts are made inside blocks, so no cell leaves them.
    A NULL basin is a basin; one without any valid cell has no rows.
    """
    key = basin or "_basin"
    valid = (cells if basin else cells.withColumn(key, F.lit(0))).where("v IS NOT NULL")
    shelf = shelve(valid.select(key, "row", "col"), key, block)
    size = shelf.agg(F.coalesce(F.max(C("start") + C("high")), F.lit(1)).alias("rows"), F.coalesce(F.max("wide"), F.lit(1)).alias("wide")).first()  # one row
    wide = int(size["wide"])
    if max(size["rows"], wide * len(variants)) * block >= _ROWS:
        raise ValueError("basins do not fit one layout; give them in several calls")
    variants = [(float(b), float(a)) for b, a in variants]
    burns = list(dict.fromkeys(b for b, _ in variants))
    limits = [(float(ft), float(ft) * V.FEET_TO_M * 10.0) for ft in dict.fromkeys(feet)]

    place = shelf.select(C(key).alias("_k"), "start", "row0", "col0")
    laid = valid.join(place, valid[key].eqNullSafe(place["_k"])).select(
        (C("row") + (C("start") - C("row0")) * block).cast("int").alias("row"), (C("col") - C("col0") * block).cast("int").alias("col"), "v", "stream_mask", reference)
    packed = written(D.to_blocks(laid, block, {"v": "real", "stream_mask": "flag", reference: "flag"}))

    def side_by_side(blocks: DataFrame, shifts: Column) -> DataFrame:
        layers = [n for n, t in blocks.dtypes if t == "binary"]
        return blocks.withColumn("_shift", F.explode(shifts)).select("br", (C("bc") + C("_shift") * wide).cast("int").alias("bc"), *layers)

    def burned(b: dict) -> dict[str, bytes]:
        v = np.frombuffer(b["v"], dtype="<f8")
        return {"z": np.where(np.frombuffer(b["stream_mask"], dtype="|b1"), v - burns[b["bc"] // wide], v).tobytes()}

    b = written(D._add(side_by_side(packed, F.sequence(F.lit(0), F.lit(len(burns) - 1))), burned, ["z"]))
    if fill_step is not None:
        b = written(D.fill_blocks(b, block, "z", fill_step))
    b = written(D.area_blocks(written(D.d8_blocks(b, block, "z").drop("z")), block, cell_area))

    def drained(b: dict) -> dict[str, bytes]:
        big = np.nan_to_num(np.frombuffer(b["area"], dtype="<f8")) >= variants[b["bc"] // wide][1]
        return {"drain": (np.frombuffer(b["stream_mask"], dtype="|b1") | big).tobytes()}

    # from the column of its burn each block goes to the columns of the variants that use it
    users = [[i - j for i, (burn, _) in enumerate(variants) if burn == burns[j]] for j in range(len(burns))]
    shifts = F.get(F.array(*[F.array(*[F.lit(s) for s in u]) for u in users]), F.floor(C("bc") / wide).cast("int"))
    b = written(D.hand_blocks(written(D._add(side_by_side(b, shifts), drained, ["drain"])), block))

    def tally(b: dict) -> pd.DataFrame:
        here = np.isfinite(np.frombuffer(b["v"], dtype="<f8"))
        hand, base = np.frombuffer(b["hand"], dtype="<f8"), np.frombuffer(b["base_hand"], dtype="<f8")
        known, ref = np.isfinite(_codes(hand)), np.frombuffer(b[reference], dtype="|b1")
        rows = []
        for ft, limit in limits:
            low, was = _low(hand, limit), _low(base, limit)
            rows.append((b["br"], b["bc"], ft, known.sum(), (known & ref).sum(), low.sum(), (low & ref).sum(), (low & was).sum(), (low | was).sum(),
                         (here & np.frombuffer(b["drain"], dtype="|b1")).sum()))
        return pd.DataFrame(rows, columns=["br", "bc", "threshold_ft", *sums])

    sums = ["valid", "ref", "hand", "tp", "both", "either", "drain_cells"]
    base = b.where(C("bc") < wide).select("br", C("bc").alias("_base"), C("hand").alias("base_hand"))
    paired = b.select("br", "bc", "v", reference, "drain", "hand", (C("bc") % wide).alias("_base")).join(base.hint("merge"), ["br", "_base"])
    counts = D.each_block(paired.drop("_base"), tally, "br int, bc int, threshold_ft double, " + ", ".join(f"{n} long" for n in sums))
    owner = shelf.select(key, F.explode(F.sequence("start", C("start") + C("high") - 1)).alias("br"))
    total = counts.join(owner, "br").groupBy(key, F.floor(C("bc") / wide).cast("int").alias("_variant"), "threshold_ft").agg(*[F.sum(n).alias(n) for n in sums]) \
        .withColumn("jaccard", ratio(C("both"), C("either")))
    out = confusion_metrics(total, keep=[key, "_variant", "jaccard", "drain_cells"])
    named = lambda at: F.get(F.array(*[F.lit(v[at]) for v in variants]), C("_variant"))
    return out.withColumn("burn_m", named(0)).withColumn("min_area", named(1)).drop("_variant", *([] if basin else [key]))
