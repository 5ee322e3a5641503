"""Drainage: depression filling, D8 directions, upstream area, height above nearest drainage.

A raster is cut into square blocks and each block travels as one row with its layers as bytes, so a step moves compact
arrays instead of one row per cell. Inside a block the flow is followed with NumPy. Between blocks only border cells
matter: each exit cell points to the exit its water takes next, and that small graph is contracted by pointer doubling
with joins, log2(longest chain) rounds. Drainage therefore crosses any number of blocks without an overlap
guess, and no join over all cells is ever repeated. Every round is written to the checkpoint folder, so lost executors repeat one round.
Joins of blocks and border cells are merged: their tables pack so well that Spark would take them for small and send them through the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewater.operators.neighborhood import NEIGHBORS
from tilewater.session import written

C = F.col

STEPS = {code: (dr, dc) for dr, dc, _, code in NEIGHBORS.values()}
DISTANCE = {code: dist for _, _, dist, code in NEIGHBORS.values()}
NO_FLOW = 0
MAX_ROUNDS = 64  # chains of up to 2^64 exits
GATHERED = 1 << 18  # cells a task holds before it sends them on as pieces of blocks


def flow_direction_d8(cells: DataFrame, value: str = "v", block: int = 256) -> DataFrame:
    """Steepest downhill neighbour of each valid cell (row, col, value, dir) as a direction code; the lowest code wins ties, 0 where
    nothing is lower. Absent rows and NULL values are the same: no neighbour. Other columns are not kept."""
    valid = cells.where(C(value).isNotNull()).select("row", "col", C(value).alias("v"))
    b = written(d8_blocks(written(to_blocks(valid, block, {"v": "real"})), block, "v"))  # so that a task runs one Python at a time
    return to_cells(b, block, {"v": "real", "dir": "code"}, where="v").withColumnRenamed("v", value)


# ---- block layout -----------------------------------------------------------------------------

#: layer kind -> (numpy type, value of an absent cell, Spark type)
KINDS = {"real": ("<f8", np.nan, "double"), "code": ("<i2", -1, "int"), "flag": ("|b1", False, "boolean")}


def to_blocks(cells: DataFrame, size: int, layers: dict[str, str]) -> DataFrame:
    """Cells -> one row per block (br, bc) with each layer (name -> kind) as bytes, row by row.

    Tasks gather up to `GATHERED` cells into pieces of blocks before the shuffle, so what moves is bytes and not one row a cell.
    """
    blank = {"code": F.lit(-1), "flag": F.lit(False)}
    cols = [C(n).cast(KINDS[k][2]) if k == "real" else F.coalesce(C(n).cast(KINDS[k][2]), blank[k]) for n, k in layers.items()]

    def flushed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        row, col = (t.column(c).to_numpy().astype(np.int64) for c in ("row", "col"))
        br, bc = row // size, col // size
        order = np.lexsort((bc, br))
        br, bc = br[order], bc[order]
        at = np.flatnonzero(np.concatenate([[True], (br[1:] != br[:-1]) | (bc[1:] != bc[:-1])]))
        slot = (row[order] - br * size) * size + col[order] - bc * size
        data = {"slots": slot.astype("<i4"), **{n: t.column(n).to_numpy()[order].astype(KINDS[k][0]) for n, k in layers.items()}}
        ends = np.append(at[1:], len(br))
        cut_up = [pa.array([v[i:j].tobytes() for i, j in zip(at, ends)], pa.binary()) for v in data.values()]
        return pa.RecordBatch.from_arrays([pa.array(br[at].astype(np.int32)), pa.array(bc[at].astype(np.int32)), *cut_up], names=["br", "bc", *data])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= GATHERED:
                yield flushed(held)
                held, n = [], 0
        if n:
            yield flushed(held)

    def pack(t: pa.Table) -> pa.Table:
        slots = np.frombuffer(b"".join(t.column("slots").to_pylist()), dtype="<i4")
        out = {"br": t.column("br").slice(0, 1), "bc": t.column("bc").slice(0, 1)}
        for n, k in layers.items():
            a = np.full(size * size, KINDS[k][1], dtype=KINDS[k][0])
            a[slots] = np.frombuffer(b"".join(t.column(n).to_pylist()), dtype=KINDS[k][0])
            out[n] = pa.array([a.tobytes()], pa.binary())
        return pa.table(out)

    shape = "br int, bc int, " + ", ".join(f"{n} binary" for n in layers)
    pieces = cells.select("row", "col", *[c.alias(n) for c, n in zip(cols, layers)]).mapInArrow(gather, "br int, bc int, slots binary, " + ", ".join(f"{n} binary" for n in layers))
    return pieces.groupBy("br", "bc").applyInArrow(pack, shape)


_ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _block(batch: pa.RecordBatch, i: int) -> dict:
    """Row `i` of a batch of blocks: layers as bytes, a list of structs as one array a field, None for NULL."""
    b = {}
    for n, column in zip(batch.schema.names, batch.columns):
        v = column[i]
        if not v.is_valid:
            b[n] = None
        elif pa.types.is_list(column.type):
            fields = {f.name: a.to_numpy(zero_copy_only=False) for f, a in zip(column.type.value_type, v.values.flatten())}
            b[n] = {k: a.astype(np.int64) if a.dtype.kind == "i" else a for k, a in fields.items()}  # cell numbers are multiplied
        else:
            b[n] = v.as_py()
    return b


def each_block(blocks: DataFrame, fn: Callable[[dict], pd.DataFrame], schema: str) -> DataFrame:
    """Apply `fn` to one block row (see `_block`) at a time, without a shuffle. Spark bounds an Arrow batch by bytes; of its blocks one at a time is taken out."""
    kinds = {n: _ARROW[t] for n, t in (c.split() for c in schema.split(","))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = fn(_block(batch, i))
                yield pa.RecordBatch.from_arrays([pa.Array.from_pandas(found[n], type=t) for n, t in kinds.items()], names=[*kinds])

    return blocks.mapInArrow(run, schema)


def to_cells(blocks: DataFrame, size: int, layers: dict[str, str], where: str) -> DataFrame:
    """Block layers -> cells; only cells whose `where` layer (kind real) is present."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                data = {n: np.frombuffer(b[n], dtype=KINDS[k][0]) for n, k in layers.items()}
                at = np.flatnonzero(np.isfinite(data[where]))
                cols = [pa.array((x + o * size).astype(np.int32)) for x, o in zip(np.divmod(at, size), (b["br"], b["bc"]))]
                kinds = {"real": lambda v: pa.array(v, mask=np.isnan(v)), "code": lambda v: pa.array(v.astype(np.int32)), "flag": pa.array}
                yield pa.RecordBatch.from_arrays(cols + [kinds[k](data[n][at]) for n, k in layers.items()], names=["row", "col", *layers])

    return blocks.select("br", "bc", *layers).mapInArrow(run, "row int, col int, " + ", ".join(f"{n} {KINDS[k][2]}" for n, k in layers.items()))


def _add(blocks: DataFrame, fn: Callable[[dict], dict[str, bytes]], new: list[str]) -> DataFrame:
    """Blocks with the layers `new` computed by `fn`, replacing layers of the same name; list columns are used up."""
    kept = [n for n, t in blocks.dtypes if t == "binary" and n not in new]

    def run(b: dict) -> pd.DataFrame:
        return pd.DataFrame({"br": [b["br"]], "bc": [b["bc"]], **{n: [b[n]] for n in kept}, **{n: [v] for n, v in fn(b).items()}})

    return each_block(blocks, run, "br int, bc int, " + ", ".join(f"{n} binary" for n in [*kept, *new]))


def _by_block(rows: DataFrame, size: int, value: str, name: str) -> DataFrame:
    """Values of border cells (row, col, value) as one list per block; a block has at most 4 * size border cells."""
    slot = F.pmod(C("row"), F.lit(size)) * size + F.pmod(C("col"), F.lit(size))
    return rows.groupBy(F.floor(C("row") / size).cast("int").alias("br"), F.floor(C("col") / size).cast("int").alias("bc")) \
        .agg(F.collect_list(F.struct(slot.cast("int").alias("slot"), C(value).alias("value"))).alias(name))


def _with_ring(blocks: DataFrame, size: int, layer: str) -> DataFrame:
    """Add `ring`: (row, col, value) of the finite cells that touch the block from outside."""
    edge = np.zeros((size, size), dtype=bool)
    edge[[0, -1], :] = edge[:, [0, -1]] = True
    edge = np.flatnonzero(edge)

    def border(b: dict) -> pd.DataFrame:
        v = np.frombuffer(b[layer], dtype="<f8")
        at = edge[np.isfinite(v[edge])]
        return pd.DataFrame({"row": at // size + b["br"] * size, "col": at % size + b["bc"] * size, "value": v[at]})

    cells = each_block(blocks.select("br", "bc", layer), border, "row int, col int, value double")
    d = F.sequence(F.lit(-1), F.lit(1))
    near = lambda c: F.array_distinct(F.transform(d, lambda s: F.floor((C(c) + s) / size).cast("int")))
    outside = cells.withColumn("br", F.explode(near("row"))).withColumn("bc", F.explode(near("col"))) \
        .where((C("br") != F.floor(C("row") / size)) | (C("bc") != F.floor(C("col") / size)))
    ring = outside.groupBy("br", "bc").agg(F.collect_list(F.struct("row", "col", "value")).alias("ring"))
    return blocks.join(ring.hint("merge"), ["br", "bc"], "left")


def _padded(b: dict, layer: str, size: int, fill: float) -> np.ndarray:
    """Block layer with a frame of one cell, ring values filled in."""
    out = np.full((size + 2, size + 2), fill)
    out[1:-1, 1:-1] = np.frombuffer(b[layer], dtype="<f8").reshape(size, size)
    if b["ring"] is not None:
        out[b["ring"]["row"] - b["br"] * size + 1, b["ring"]["col"] - b["bc"] * size + 1] = b["ring"]["value"]
    return out


# ---- inside a block ---------------------------------------------------------------------------

class _Flow:
    """Flow graph of one block: local index of the next cell, -1 where the path leaves the block or ends."""

    def __init__(self, b: dict, size: int) -> None:
        code = np.frombuffer(b["dir"], dtype="<i2").astype(np.int64)
        self.here = code >= 0
        table = np.zeros((129, 2), dtype=np.int64)
        for k, step in STEPS.items():
            table[k] = step
        flow = np.where(code > 0, code, 0)
        r, c = np.divmod(np.arange(size * size), size)
        tr, tc = r + table[flow, 0], c + table[flow, 1]
        inside = (flow > 0) & (tr >= 0) & (tr < size) & (tc >= 0) & (tc < size)
        self.next = np.where(inside, tr * size + tc, -1)
        self.leaves = (flow > 0) & ~inside
        self.border = self.here & ((r == 0) | (r == size - 1) | (c == 0) | (c == size - 1))
        self.row, self.col = r + b["br"] * size, c + b["bc"] * size
        self.to_row, self.to_col = tr + b["br"] * size, tc + b["bc"] * size

    def accumulate(self, weight: np.ndarray) -> np.ndarray:
        """Weight of each cell plus everything upstream inside the block, peeled from the ridges down."""
        total = np.where(self.here, weight, 0.0)
        waiting = np.bincount(self.next[self.next >= 0], minlength=len(total))
        front = np.flatnonzero((waiting == 0) & self.here)
        while front.size:
            src = front[self.next[front] >= 0]
            dst = self.next[src]
            np.add.at(total, dst, total[src])
            np.subtract.at(waiting, dst, 1)
            dst = np.unique(dst)
            front = dst[waiting[dst] == 0]
        return total

    def ends(self, stop: np.ndarray) -> np.ndarray:
        """Local index of the last cell of each path inside the block, or of the first `stop` cell."""
        p = np.where((self.next >= 0) & ~stop, self.next, np.arange(len(stop)))
        while True:
            q = p[p]
            if np.array_equal(p, q):
                return p
            p = q

    def border_rows(self, end: np.ndarray, onward: np.ndarray, name: str, value: np.ndarray) -> pd.DataFrame:
        """Border cells with where their water leaves next (`nrow`, `ncol`, -1 when it does not leave)."""
        k = self.border
        return pd.DataFrame({
            "row": self.row[k], "col": self.col[k], "leaves": self.leaves[k], "to_row": self.to_row[k], "to_col": self.to_col[k],
            "nrow": np.where(onward, self.row[end], -1)[k], "ncol": np.where(onward, self.col[end], -1)[k], name: value[k]})


_BORDER = "row int, col int, leaves boolean, to_row int, to_col int, nrow int, ncol int, "


# ---- between blocks ---------------------------------------------------------------------------

def _exit_links(border: DataFrame, own: list[str], taken: list[str]) -> DataFrame:
    """Exit cells with the next exit of their water: what the entry cell in the next block points to.

    `own` columns come from the exit cell, `taken` columns from the entry cell.
    """
    real = lambda c: F.when(C(c) >= 0, C(c)).alias(c)
    entry = border.select(C("row").alias("to_row"), C("col").alias("to_col"), real("nrow"), real("ncol"), *taken)
    return written(border.where("leaves").select("row", "col", "to_row", "to_col", *own).join(entry.hint("merge"), ["to_row", "to_col"], "left"))


def _contract(exits: DataFrame, carry: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Pointer doubling until no exit points on; `carry(exits, hop)` moves the payload one doubled step."""
    for _ in range(MAX_ROUNDS):
        if exits.where("nrow IS NOT NULL").isEmpty():
            return exits
        names = [c for c in exits.columns if c not in ("row", "col", "to_row", "to_col")]
        hop = exits.select(C("row").alias("nrow"), C("col").alias("ncol"), *[C(c).alias(f"hop_{c}") for c in names])
        exits = written(carry(exits, hop))
    raise RuntimeError("flow directions form a cycle between blocks")


def d8_blocks(blocks: DataFrame, size: int, layer: str) -> DataFrame:
    """Add the layer `dir`; same rule as `flow_direction_d8`."""
    def run(b: dict) -> dict[str, bytes]:
        z = _padded(b, layer, size, np.nan)
        me = z[1:-1, 1:-1]
        best, code = np.zeros(me.shape), np.where(np.isfinite(me), NO_FLOW, -1)
        for k in sorted(STEPS):
            dr, dc = STEPS[k]
            drop = (me - z[1 + dr:size + 1 + dr, 1 + dc:size + 1 + dc]) / DISTANCE[k]
            better = drop > best
            best, code = np.where(better, drop, best), np.where(better, k, code)
        return {"dir": code.astype("<i2").tobytes()}

    return _add(_with_ring(blocks, size, layer), run, ["dir"])


def area_blocks(blocks: DataFrame, size: int, cell_area: float, threshold: float | None = None) -> DataFrame:
    """Add the layer `area`: accumulated area, own cell included. With `threshold` also `drain`: cells of the layer stream_mask or with that much area."""
    def leaving(b: dict) -> pd.DataFrame:
        g = _Flow(b, size)
        end = g.ends(np.zeros(size * size, dtype=bool))
        return g.border_rows(end, g.leaves[end], "area", g.accumulate(np.full(size * size, cell_area)))

    border = written(each_block(blocks.select("br", "bc", "dir"), leaving, _BORDER + "area double"))

    def carry(e: DataFrame, hop: DataFrame) -> DataFrame:
        add = e.where("nrow IS NOT NULL").groupBy(C("nrow").alias("row"), C("ncol").alias("col")).agg(F.sum("area").alias("_in"))
        return e.join(add.hint("merge"), ["row", "col"], "left").join(hop.select("nrow", "ncol", "hop_nrow", "hop_ncol").hint("merge"), ["nrow", "ncol"], "left").select(
            "row", "col", "to_row", "to_col", C("hop_nrow").alias("nrow"), C("hop_ncol").alias("ncol"), (C("area") + F.coalesce("_in", F.lit(0.0))).alias("area"))

    exits = _contract(_exit_links(border, ["area"], []), carry)
    inflow = exits.groupBy(C("to_row").alias("row"), C("to_col").alias("col")).agg(F.sum("area").alias("area"))

    def totals(b: dict) -> dict[str, bytes]:
        w = np.full(size * size, cell_area)
        if b["inflow"] is not None:
            np.add.at(w, b["inflow"]["slot"], b["inflow"]["value"])
        g = _Flow(b, size)
        area = np.where(g.here, g.accumulate(w), np.nan).astype("<f8")
        if threshold is None:
            return {"area": area.tobytes()}
        return {"area": area.tobytes(), "drain": (np.frombuffer(b["stream_mask"], dtype="|b1") | (np.nan_to_num(area) >= threshold)).tobytes()}

    return _add(blocks.join(_by_block(inflow, size, "area", "inflow").hint("merge"), ["br", "bc"], "left"), totals, ["area"] if threshold is None else ["area", "drain"])


def hand_blocks(blocks: DataFrame, size: int) -> DataFrame:
    """Add the layer `hand` from the layers v, dir, drain: height above the first drainage cell downstream, NaN without
    one or below it."""
    def local(b: dict):
        g = _Flow(b, size)
        drain, v = np.frombuffer(b["drain"], dtype="|b1"), np.frombuffer(b["v"], dtype="<f8")
        end = g.ends(drain)
        return g, v, end, np.where(drain[end], v[end], np.nan), g.leaves[end] & ~drain[end]

    def leaving(b: dict) -> pd.DataFrame:
        g, _, end, found, onward = local(b)
        rows = g.border_rows(end, onward, "drain_v", found)
        # an exit that is itself drainage keeps its water
        rows["leaves"] &= ~np.frombuffer(b["drain"], dtype="|b1")[g.border]
        return rows

    border = written(each_block(blocks.select("br", "bc", "v", "dir", "drain"), leaving, _BORDER + "drain_v double")
                 .withColumn("drain_v", F.when(~F.isnan("drain_v"), C("drain_v"))))

    def carry(e: DataFrame, hop: DataFrame) -> DataFrame:
        return e.join(hop.hint("merge"), ["nrow", "ncol"], "left").select(
            "row", "col", C("hop_nrow").alias("nrow"), C("hop_ncol").alias("ncol"), F.coalesce("drain_v", "hop_drain_v").alias("drain_v"))

    exits = _contract(_exit_links(border, [], ["drain_v"]).drop("to_row", "to_col"), carry)

    def heights(b: dict) -> dict[str, bytes]:
        g, v, end, found, onward = local(b)
        far = np.full(size * size, np.nan)
        if b["far"] is not None:
            far[b["far"]["slot"]] = b["far"]["value"]
        h = v - np.where(onward, far[end], found)
        return {"hand": np.where(g.here & (h >= 0), h, np.nan).astype("<f8").tobytes()}

    known = exits.where("drain_v IS NOT NULL")
    return _add(blocks.join(_by_block(known, size, "drain_v", "far").hint("merge"), ["br", "bc"], "left"), heights, ["hand"])


#: the label of every way out in the graph of basins; other labels are numbers of border cells
OUT = -1
_WIDE = 1 << 32
#: labels inside a block besides slots of border cells
_OPEN, _NONE = -1, -2
REGION = 16  # blocks on a side of what one task contracts


def fill_blocks(blocks: DataFrame, size: int, layer: str, step: float = 0.0) -> DataFrame:
    """Replace `layer` by its depression-free form (see `fill_depressions`)."""
    return _fill_by_passes(blocks, size, layer) if step == 0 else _fill_sloped(blocks, size, layer, step)


def _firsts(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)


def _lowest_pairs(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges in both directions, sorted by their ends, the lowest of each pair of ends."""
    key = np.concatenate([u * n + v, v * n + u])
    order = np.argsort(key, kind="stable")
    key, both = key[order], np.concatenate([w, w])[order]
    at = _firsts(key)
    u, v = np.divmod(key[at], n)
    return u, v, np.minimum.reduceat(both, at) if len(at) else both


def _hops(p: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pointers followed to their ends, with the highest weight on the way; of two that point at each other the smaller becomes an end."""
    me = np.arange(len(p))
    head = (p[p] == me) & (me < p)
    p[head], c[head] = me[head], -np.inf
    while True:
        q = p[p]
        if np.array_equal(p, q):
            return p, c
        c, p = np.maximum(c, c[p]), q


def _contracted(u: np.ndarray, v: np.ndarray, w: np.ndarray, stay: np.ndarray):
    """Every node of an undirected graph (u, v, w) that may not `stay` goes along its lowest edge, together with all that came to it, until each
    has met a node that stays.

    Returns that node, the highest weight on the way, and the lowest edges left between nodes that stay. Ties go to the smaller end,
    so only pairs can point at each other; each round at least halves the nodes that move.
    """
    n = len(stay)
    root, level = np.arange(n), np.full(n, -np.inf)
    while True:
        u, v, w = _lowest_pairs(u, v, w, n)
        at = _firsts(u)
        if len(at):
            sizes = np.diff(np.concatenate([at, [len(u)]]))
            low = np.flatnonzero(w == np.repeat(np.minimum.reduceat(w, at), sizes))
            pick = low[_firsts(u[low])]
            pick = pick[~stay[u[pick]]]
        if not len(at) or not len(pick):
            once = u < v
            return root, level, u[once], v[once], w[once]
        p, c = np.arange(n), np.full(n, -np.inf)
        p[u[pick]], c[u[pick]] = v[pick], w[pick]
        p, c = _hops(p, c)
        level, root = np.maximum(level, c[root]), p[root]
        u, v = p[u], p[v]
        apart = u < v
        u, v, w = u[apart], v[apart], w[apart]


def _flooded(b: dict, layer: str, size: int) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """What water from the border and the open cells of a block does to it, in NumPy passes over the whole block.

    Returns levels, labels (slot of the border cell that water of a cell reaches first, _OPEN for a way out, _NONE without ground), the
    lowest passes between labels (label, label, level), the padded ground and which cells are open (next to NODATA or to the outside of the
    grid). Each cell first points to the neighbour behind its lowest step; the basins that this makes are contracted as a graph.
    """
    z = _padded(b, layer, size, np.nan)
    here = np.isfinite(z)
    shut = np.ones((size, size), dtype=bool)
    for dr, dc in STEPS.values():
        shut &= here[1 + dr:size + 1 + dr, 1 + dc:size + 1 + dc]
    ground = z[1:-1, 1:-1]
    is_open = here[1:-1, 1:-1] & ~shut
    edge = np.zeros((size, size), dtype=bool)
    edge[[0, -1], :] = edge[:, [0, -1]] = True
    stay = (edge | is_open | ~here[1:-1, 1:-1]).ravel()
    inner = np.full((size + 2, size + 2), np.inf)
    inner[1:-1, 1:-1] = np.where(here[1:-1, 1:-1], ground, np.inf)
    own, slot = inner[1:-1, 1:-1], np.arange(size * size).reshape(size, size)
    best, to = np.full((size, size), np.inf), slot.copy()
    for dr, dc in sorted(STEPS.values()):
        cost = np.maximum(own, inner[1 + dr:size + 1 + dr, 1 + dc:size + 1 + dc])
        lower = cost < best
        best, to = np.where(lower, cost, best), np.where(lower, slot + dr * size + dc, to)
    p, c = to.ravel(), best.ravel()
    p[stay], c[stay] = np.flatnonzero(stay), -np.inf
    basin, level = _hops(p, c)
    ends = []
    for dr, dc in ((0, 1), (1, 0), (1, 1), (1, -1)):
        a = (slice(0, size - dr), slice(max(0, -dc), size - max(0, dc)))
        e = (slice(dr, size), slice(max(0, dc), size - max(0, -dc)))
        x, y, high = basin[slot[a].ravel()], basin[slot[e].ravel()], np.maximum(own[a], own[e]).ravel()
        some = (x != y) & np.isfinite(high)
        ends.append((x[some], y[some], high[some]))
    names, number = np.unique(basin, return_inverse=True)
    u, v, w = (np.concatenate(part) for part in zip(*ends))
    place = np.zeros(size * size, dtype=np.int64)
    place[names] = np.arange(len(names))
    root, further, u, v, w = _contracted(place[u], place[v], w, stay[names])
    end = names[root][number.ravel()]
    level = np.maximum(np.maximum(level, further[number.ravel()]), ground.ravel())
    label = np.where(edge.ravel()[end], end, np.where(is_open.ravel()[end], _OPEN, _NONE))
    label, level = np.where(here[1:-1, 1:-1].ravel(), label, _NONE), np.where(label == _NONE, np.nan, level)
    a, e = label[names[u]], label[names[v]]
    some = a != e
    return level.reshape(size, size), label.reshape(size, size), (a[some], e[some], w[some]), z, is_open


def _spanning(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of a lowest spanning forest: they keep the lowest way between any two nodes."""
    if not len(u):
        return u, v, w
    names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    n, a, e = len(names), *np.split(ends.astype(np.int64), 2)
    order = np.lexsort((np.maximum(a, e), np.minimum(a, e), w))
    a, e, kept, rank = a[order], e[order], np.zeros(len(order), dtype=bool), np.arange(len(order))
    while len(rank):
        pick = np.full(n, len(order))
        np.minimum.at(pick, a, rank)
        np.minimum.at(pick, e, rank)
        who = np.flatnonzero(pick < len(order))
        at = np.searchsorted(rank, pick[who])
        kept[pick[who]] = True
        p = np.arange(n)
        p[who] = a[at] + e[at] - who
        p, _ = _hops(p, np.zeros(n))
        a, e = p[a], p[e]
        apart = a != e
        a, e, rank = a[apart], e[apart], rank[apart]
    chosen = order[kept]
    return u[chosen], v[chosen], w[chosen]


def _fill_by_passes(blocks: DataFrame, size: int, layer: str) -> DataFrame:
    """Depression filling without rounds over the raster: floods once, solves the graph of basins, raises once.

    Each block is flooded from its border; border cells are the basins of the graph, joined by the lowest passes inside blocks (a spanning
    forest of them) and by steps between neighbouring blocks. What a basin must rise to is its lowest way to OUT, found by contraction
    (`_lowest_way_out`). Levels and labels of the flood travel with the block, so it is not done again.
    """
    kept = [n for n, t in blocks.dtypes if t == "binary"]

    def flood(b: dict) -> dict[str, bytes]:
        level, label, (u, v, w), z, is_open = _flooded(b, layer, size)
        row, col = int(b["br"]) * size, int(b["bc"]) * size
        name = lambda at: np.where(at >= 0, (at // size + row) * _WIDE + at % size + col, OUT)
        own = np.flatnonzero((is_open & (label != _OPEN)).ravel())  # open cells of the border
        u, v, w = _spanning(*(np.concatenate(x) for x in ((u, np.full(len(own), _OPEN)), (v, label.ravel()[own]), (w, z[1:-1, 1:-1].ravel()[own]))))
        parts = [(name(u), name(v), w)]
        rows, cols, high = b["ring"].values() if b["ring"] is not None else (np.zeros(0, np.int64),) * 3
        for dr, dc in STEPS.values() if len(rows) else ():
            i, j = rows - row + dr, cols - col + dc
            # the block with the smaller cell tells of a step between two blocks
            some = (i >= 0) & (i < size) & (j >= 0) & (j < size) & ((i + row) * _WIDE + j + col < rows.astype(np.int64) * _WIDE + cols)
            i, j, r, c, h = i[some], j[some], rows[some].astype(np.int64), cols[some], high[some]
            other = z[i + 1, j + 1]
            there = np.isfinite(other)
            parts.append((r[there] * _WIDE + c[there], name(label[i, j][there]), np.maximum(other, h)[there]))
        u, v, w = (np.concatenate(x) for x in zip(*parts))
        edges = np.concatenate([u.astype("<i8").view("<f8"), v.astype("<i8").view("<f8"), w.astype("<f8")])
        return {"_level": level.astype("<f8").tobytes(), "_label": label.astype("<i4").tobytes(), "_edges": edges.tobytes()}

    def graph(b: dict) -> pd.DataFrame:
        u, v, w = np.frombuffer(b["_edges"], dtype="<f8").reshape(3, -1)
        return pd.DataFrame({"a": u.view("<i8"), "b": v.view("<i8"), "w": w})

    flooded = written(_add(_with_ring(blocks, size, layer), flood, ["_level", "_label", "_edges"]))
    edges = each_block(flooded.select("br", "bc", "_edges"), graph, "a long, b long, w double")
    rise = _lowest_way_out_by_regions(edges, REGION * size).select(F.floor(C("node") / _WIDE).cast("int").alias("row"), F.pmod(C("node"), F.lit(_WIDE)).cast("int").alias("col"), "level")

    def raised(b: dict) -> dict[str, bytes]:
        level, label = np.frombuffer(b["_level"], dtype="<f8"), np.frombuffer(b["_label"], dtype="<i4")
        least = np.full(size * size + 2, np.inf)
        if b["rise"] is not None:
            least[b["rise"]["slot"]] = b["rise"]["value"]
        least[_OPEN] = -np.inf
        out = np.maximum(level, least[label])
        return {layer: np.where(np.isfinite(out), out, np.nan).astype("<f8").tobytes()}

    named = flooded.drop("_edges").join(_by_block(rise, size, "level", "rise").hint("merge"), ["br", "bc"], "left")
    return _add(named, raised, [layer]).select("br", "bc", *kept)


def _lowest_way_out_by_regions(edges: DataFrame, span: int) -> DataFrame:
    """As `_lowest_way_out`; border cells inside a region of `span` x `span` cells are contracted first, one task a region, so that only cells
    with a neighbour in another region are left for the rounds. A region holds at most `REGION` ** 2 spanning forests and the steps between its blocks."""
    place = lambda n: F.struct(F.floor(C(n) / _WIDE / span).cast("int").alias("i"), F.floor(F.pmod(C(n), F.lit(_WIDE)) / span).cast("int").alias("j"))
    named = edges.where("a <> b").withColumn("_a", F.when(C("a") != OUT, place("a"))).withColumn("_b", F.when(C("b") != OUT, place("b")))
    named = written(named.withColumns({"_a": F.coalesce("_a", "_b"), "_b": F.coalesce("_b", "_a")}))
    inner, outer = named.where("_a = _b"), named.where("_a <> _b")
    mark = lambda n: outer.select(C(f"_{n}").alias("region"), C(n).alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("double").alias("w")).distinct()
    rows = inner.select(C("_a").alias("region"), "a", "b", "w").unionByName(mark("a")).unionByName(mark("b"))

    def contract(t: pa.Table) -> pa.Table:
        a, b, w = (t.column(c).to_numpy() for c in ("a", "b", "w"))
        edge = ~np.isnan(w)
        names, ends = np.unique(np.concatenate([a, b[edge].astype(np.int64)]), return_inverse=True)
        stay = names == OUT
        stay[ends[:len(a)][~edge]] = True
        root, level, u, v, w = _contracted(ends[:len(a)][edge].astype(np.int64), ends[len(a):].astype(np.int64), w[edge], stay)
        u, v, w = _spanning(u, v, w)
        met = stay[root] & (names != OUT)
        none = lambda n, kind: pa.nulls(n, kind)
        return pa.table({
            "a": pa.concat_arrays([pa.array(names[u]), none(met.sum(), pa.int64())]), "b": pa.concat_arrays([pa.array(names[v]), none(met.sum(), pa.int64())]),
            "w": pa.concat_arrays([pa.array(w), pa.array(level[met])]), "node": pa.concat_arrays([none(len(u), pa.int64()), pa.array(names[met])]),
            "root": pa.concat_arrays([none(len(u), pa.int64()), pa.array(names[root][met])])})

    found = written(rows.groupBy("region").applyInArrow(contract, "a long, b long, w double, node long, root long"))
    far = _lowest_way_out(found.where("node IS NULL").select("a", "b", "w").unionByName(outer.select("a", "b", "w")))
    near = found.where("node IS NOT NULL").select("node", "root", C("w").alias("way"))
    done = near.where(C("root") == OUT).select("node", C("way").alias("level"))
    on = near.where(C("root") != OUT).join(far.select(C("node").alias("root"), "level"), "root")
    return done.unionByName(on.select("node", F.greatest("way", "level").alias("level")))


def _lowest_way_out(edges: DataFrame) -> DataFrame:
    """node, level: for each node of an undirected graph (a, b, w) the least possible highest weight on a way to OUT.

    Each round every node points along its lowest edge (ties by the ends, so only pairs can point at each other; the smaller end becomes
    the root), pointers are doubled up to their roots with the highest weight on the way, and roots become the nodes of the next
    round. A node's level is the highest weight to its root or the root's level, whichever is more; each round at least halves the nodes.
    """
    both = edges.where("a <> b").select(C("a").alias("u"), C("b").alias("v"), "w")
    both = both.unionByName(both.select(C("v").alias("u"), C("u").alias("v"), "w"))
    live = written(both.groupBy("u", "v").agg(F.min("w").alias("w")))
    low = F.lit(float("-inf"))
    members = written(live.where(C("u") != OUT).select("u").distinct().select(C("u").alias("node"), C("u").alias("root"), low.alias("level")))
    while not live.where(C("u") != OUT).isEmpty():
        order = F.struct("w", F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y"))
        best = written(live.where(C("u") != OUT).groupBy("u").agg(F.min_by(F.struct("v", "w"), order).alias("e")).select("u", C("e.v").alias("p"), C("e.w").alias("c")))
        back = best.select(C("u").alias("p"), C("p").alias("pp"))
        head = (C("pp") == C("u")) & (C("u") < C("p"))
        at = written(best.join(back, "p", "left").select("u", F.when(head, C("u")).otherwise(C("p")).alias("p"), F.when(head, low).otherwise(C("c")).alias("c")))
        while True:
            on = at.select(C("u").alias("p"), C("p").alias("q"), C("c").alias("d"))
            step = written(at.join(on, "p", "left").select("u", F.coalesce("q", "p").alias("q"), F.greatest("c", F.coalesce("d", low)).alias("c"), "p"))
            moved = not step.where("q <> p").isEmpty()
            at = step.select("u", C("q").alias("p"), "c")
            if not moved:
                break
        to = lambda side: at.select(C("u").alias(side), C("p").alias(f"r{side}"), C("c").alias(f"c{side}"))
        live = live.join(to("u"), "u", "left").join(to("v"), "v", "left").select(
            F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"), F.greatest("w", F.coalesce("cu", low), F.coalesce("cv", low)).alias("w"))
        live = written(live.where("u <> v").groupBy("u", "v").agg(F.min("w").alias("w")))
        members = written(members.join(at.select(C("u").alias("root"), "p", "c"), "root", "left").select(
            "node", F.coalesce("p", "root").alias("root"), F.greatest("level", F.coalesce("c", low)).alias("level")))
    return members.where(C("root") == OUT).select("node", "level")


def _fill_sloped(blocks: DataFrame, size: int, layer: str, step: float) -> DataFrame:
    """As `fill_blocks`, with a slope of `step` a cell on what is filled: floods every block from the ring around it until no level moves."""
    def start(b: dict) -> dict[str, bytes]:
        z = _padded(b, layer, size, np.nan)
        here = np.isfinite(z)
        shut = np.ones((size, size), dtype=bool)
        for dr, dc in STEPS.values():
            shut &= here[1 + dr:size + 1 + dr, 1 + dc:size + 1 + dc]
        me = z[1:-1, 1:-1]
        return {"_w": np.where(np.isfinite(me), np.where(shut, np.inf, me), np.nan).astype("<f8").tobytes(), "_moved": b"\x02"}

    def flood(b: dict) -> dict[str, bytes]:
        """Lower each water level to the best path through this block, from its open cells and the ring around it."""
        ground = np.frombuffer(b[layer], dtype="<f8").reshape(size, size)
        before = np.frombuffer(b["_w"], dtype="<f8").reshape(size, size)
        level = _padded(b, "_w", size, np.nan)
        source = np.isfinite(level)
        if b["_moved"] != b"\x02":
            source[1:-1, 1:-1] = False  # after the first flood only the ring can bring lower water
        rows, cols = np.nonzero(source)
        heap = [(level[r, c], r, c) for r, c in zip(rows.tolist(), cols.tolist())]
        heapq.heapify(heap)
        while heap:
            w, r, c = heapq.heappop(heap)
            if w > level[r, c]:
                continue
            for dr, dc in STEPS.values():
                a, e = r + dr, c + dc
                if 1 <= a <= size and 1 <= e <= size:
                    new = max(ground[a - 1, e - 1], w + step)
                    if new < level[a, e]:
                        level[a, e] = new
                        heapq.heappush(heap, (new, a, e))
        after = level[1:-1, 1:-1]
        return {"_w": after.astype("<f8").tobytes(), "_moved": b"\x01" if (after < before).any() else b"\x00"}

    kept = [n for n in blocks.columns]
    state = written(_add(_with_ring(blocks, size, layer), start, ["_w", "_moved"]))
    while True:  # levels only fall and are bounded by the ground, so this ends
        state = written(_add(_with_ring(state, size, "_w"), flood, ["_w", "_moved"]))
        if state.where(C("_moved") == F.lit(b"\x01")).isEmpty():
            break
    # levels that stayed infinite belong to cells without any way out
    settled = _add(state, lambda b: {layer: np.where(np.isfinite(w := np.frombuffer(b["_w"], dtype="<f8")), w, np.nan).tobytes()}, [layer])
    return settled.select("br", "bc", *[n for n in kept if n not in ("br", "bc")])


# ---- the same on cells ------------------------------------------------------------------------

def upstream_area_of_heights(cells: DataFrame, value: str = "v", cell_area: float = 1.0, block: int = 256) -> DataFrame:
    """As `upstream_area` of `flow_direction_d8`, without taking the blocks apart in between. `cells`: row, col, value."""
    valid = cells.where(C(value).isNotNull()).select("row", "col", C(value).alias("v"))
    b = written(d8_blocks(written(to_blocks(valid, block, {"v": "real"})), block, "v").drop("v"))
    return to_cells(written(area_blocks(b, block, cell_area)), block, {"area": "real"}, where="area")


def upstream_area(cells: DataFrame, cell_area: float = 1.0, block: int = 256) -> DataFrame:
    """Accumulated area per cell (own cell included). `cells`: row, col, dir."""
    b = written(to_blocks(cells.where("dir IS NOT NULL"), block, {"dir": "code"}))
    return to_cells(written(area_blocks(b, block, cell_area)), block, {"area": "real"}, where="area")


def hand(cells: DataFrame, block: int = 256) -> DataFrame:
    """Height above the first drainage cell downstream. `cells`: row, col, v, dir, drain. NULL without drainage or below it."""
    valid = cells.where("v IS NOT NULL AND dir IS NOT NULL")
    b = written(to_blocks(valid, block, {"v": "real", "dir": "code", "drain": "flag"}))
    return to_cells(written(hand_blocks(b, block)), block, {"v": "real", "hand": "real"}, where="v").select("row", "col", "hand")


def drain_mask(stream: str, area: str, threshold: float, value: str) -> Column:
    """Drainage cells: mapped streams or enough upstream area, on valid terrain."""
    return (F.coalesce(C(stream), F.lit(False)) | (F.coalesce(C(area), F.lit(0.0)) >= threshold)) & C(value).isNotNull()


def fill_depressions(cells: DataFrame, block: int = 256, step: float = 0.0) -> DataFrame:
    """Raise every cell (row, col, v) to the lowest level at which water can leave; `step` > 0 leaves a gentle slope on flats.

    Water leaves at the edge of the grid and next to NODATA. Without a slope every block is flooded once and the graph of border cells is
    solved in a logarithmic number of rounds; a slope needs rounds over the raster until no level moves. Both are exact.
    """
    valid = cells.where("v IS NOT NULL").select("row", "col", "v", C("v").alias("filled"))
    b = written(to_blocks(valid, block, {"v": "real", "filled": "real"}))
    return to_cells(written(fill_blocks(b, block, "filled", step)), block, {"v": "real", "filled": "real"}, where="v")


# ---- one derivation (many and their sensitivity: `basins`) ---------------------------------------------------------

def drained_blocks(cells: DataFrame, burn: float, threshold: float, cell_area: float, block: int, fill_step: float | None = None,
                   keep: list[str] | None = None) -> DataFrame:
    """Burn, optionally fill, route, accumulate, mask, all in block layout.

    `cells`: row, col, v, stream_mask and the boolean columns `keep`. Layers: v, dir, area, drain, keep...
    """
    keep = list(keep or [])
    routed = F.when(C("stream_mask"), C("v") - burn).otherwise(C("v"))
    valid = cells.where("v IS NOT NULL").select("row", "col", "v", "stream_mask", routed.alias("z"), *keep)
    b = written(to_blocks(valid, block, {"v": "real", "z": "real", "stream_mask": "flag", **{k: "flag" for k in keep}}))
    if fill_step is not None:
        b = written(fill_blocks(b, block, "z", fill_step))
    b = written(d8_blocks(b, block, "z").drop("z"))
    return area_blocks(b, block, cell_area, threshold)


def drainage_blocks(cells: DataFrame, burn: float, threshold: float, cell_area: float, block: int, fill_step: float | None,
                    keep: list[str] | None = None) -> DataFrame:
    """As `drained_blocks`, and measured: the layer `hand` is added."""
    return hand_blocks(written(drained_blocks(cells, burn, threshold, cell_area, block, fill_step, keep)), block)


def hand_variant(cells: DataFrame, burn: float, threshold: float, cell_area: float, block: int, fill_step: float | None) -> DataFrame:
    """One derivation as cells (row, col, v, dir, area, drain, hand); valid terrain only."""
    b = drainage_blocks(cells, burn, threshold, cell_area, block, fill_step)
    return to_cells(written(b), block, {"v": "real", "dir": "code", "area": "real", "drain": "flag", "hand": "real"}, where="v")
