"""Distributed helpers against brute force on small fixtures, with hot keys and many partitions."""

import functools
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tilewater.operators import basins as B
from tilewater.operators import drainage as D
from tilewater.operators import generators as GN
from tilewater.operators import geometry as GE
from tilewater.operators import grids as GR
from tilewater.operators import joins as J
from tilewater.operators import resample as RS
from tilewater.operators import windows as W
from tilewater.operators.ordered import Ordered
from tilewater.operators.quantiles import quantiles


def _hot(n=3000, seed=1):
    """Rows of which a third share one key."""
    rnd = random.Random(seed)
    return [(0 if rnd.random() < 0.34 else rnd.randrange(1, 20), i, rnd.randrange(-50, 50)) for i in rnd.sample(range(10 * n), n)]


def test_ordered_matches_brute_force(spark):
    rows = _hot()
    d = spark.createDataFrame(rows, "k int, o int, v int")
    got = {(r.k, r.o): (r.s, r.p.v if r.p else None, r.n.v if r.n else None)
           for r in Ordered(d, ["k"], ["o"], parts=7).running_total("v", "s").previous(["v"], "p").following(["v"], "n").result().collect()}
    for k in {r[0] for r in rows}:
        mine = sorted((o, v) for kk, o, v in rows if kk == k)
        run = 0
        for i, (o, v) in enumerate(mine):
            run += v
            assert got[(k, o)] == (run, mine[i - 1][1] if i else None, mine[i + 1][1] if i + 1 < len(mine) else None)


def test_ordered_spreads_a_hot_key(spark):
    d = spark.createDataFrame(_hot(), "k int, o int, v int")
    o = Ordered(d, ["k"], ["o"], parts=12)
    assert o.df.where("k = 0").select("_range_part").distinct().count() >= 3


@pytest.mark.parametrize("bounded", [True, False])
@pytest.mark.parametrize("method", ["linear", "nearest", "floor", "index", "exclusive"])
def test_quantile_rules(spark, method, bounded):
    rows = [(k, float(v)) for k, _, v in _hot(700, seed=5)]
    got = {r.k: (r.a, r.b) for r in quantiles(spark.createDataFrame(rows, "k int, v double"), "v", {"a": 0.5, "b": 0.95}, ["k"], method, bounded).collect()}
    for k in {r[0] for r in rows}:
        s = sorted(v for kk, v in rows if kk == k)
        n = len(s)
        for q, mine in zip((0.5, 0.95), got[k]):
            if method == "linear":
                want = float(np.percentile(s, q * 100))
            elif method == "nearest":
                want = s[max(0, min(n - 1, int(np.ceil(q * n)) - 1))]
            elif method == "floor":
                want = s[min(n - 1, int(q * (n - 1)))]
            elif method == "index":
                want = s[min(n - 1, int(n * q))]
            else:
                want = statistics.quantiles(s, n=20)[18 if q == 0.95 else 9]
            assert mine == pytest.approx(want)


def test_rate_window_across_blocks(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([0, 0, 1]), rnd.randrange(0, 40_000_000)) for _ in range(2500)] + [(0, 5_000_000), (0, 6_000_000), (0, 6_000_000)]
    got = {(r.k, r.us): r.in_window for r in W.rate_window(spark.createDataFrame(rows, "k int, us long"), "k", "us", F.lit(3), 1_000_000, blocks=2).collect()}
    times = {k: sorted({us for kk, us in rows if kk == k}) for k in (0, 1)}
    assert len(got) == sum(len(v) for v in times.values())
    for (k, us), n in got.items():
        assert n == sum(1 for t in times[k] if us - 1_000_000 < t <= us)


def test_far_pairs_exact(spark):
    from math import asin, cos, radians, sin, sqrt

    rnd = random.Random(4)
    pts = [(i, rnd.uniform(-125, -66), rnd.uniform(24, 49)) for i in range(120)] + [(200 + i, -80.0, 25.0) for i in range(40)]

    def km(a, b):
        h = sin(radians(b[2] - a[2]) / 2) ** 2 + cos(radians(a[2])) * cos(radians(b[2])) * sin(radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6371.0088 * asin(min(1, sqrt(h)))

    want = sorted((-round(km(a, b), 6), a[0], b[0]) for a in pts for b in pts if a[0] != b[0])[:60]
    got = J.far_pairs(spark.createDataFrame(pts, "id int, lon double, lat double"), 60).collect()
    assert [r.km for r in got] == pytest.approx([-w[0] for w in want], abs=2e-6)


def test_far_pairs_of_dense_towns(spark):
    """Two towns of 100,000 places within five kilometres each: 10^10 pairs, answered from those near the far corners."""
    rnd = np.random.default_rng(6)
    a, b = rnd.uniform(0, 0.05, (100_000, 2)) + [-100.0, 30.0], rnd.uniform(0, 0.05, (100_000, 2)) + [-80.0, 41.0]

    def km(p, q):
        p, q = np.radians(p)[:, None, :], np.radians(q)[None, :, :]
        h = np.sin((q - p)[..., 1] / 2) ** 2 + np.cos(p[..., 1]) * np.cos(q[..., 1]) * np.sin((q - p)[..., 0] / 2) ** 2
        return 2 * 6371.0088 * np.arcsin(np.sqrt(h))

    corners = lambda t: np.array([[x, y] for x in (t[:, 0].min(), t[:, 0].max()) for y in (t[:, 1].min(), t[:, 1].max())])
    reach_a, reach_b = km(a, corners(b)).max(1), km(b, corners(a)).max(1)
    far_a, far_b = a[np.argsort(-reach_a)[:2000]], b[np.argsort(-reach_b)[:2000]]
    want = np.sort(km(far_a, far_b).ravel())[::-1][:20]
    # who is not among the 2,000 cannot reach the answer
    assert max(np.sort(reach_a)[-2001], np.sort(reach_b)[-2001]) + 0.01 < want[-1]
    pts = spark.createDataFrame(pd.DataFrame(np.concatenate([a, b]), columns=["lon", "lat"]).reset_index(names="id"))
    got = J.far_pairs(pts, 40).collect()
    assert [r.km for r in got[::2]] == pytest.approx(list(want), abs=2e-6)
    assert [(r.from_id, r.to_id) for r in got[::2]] == [(r.to_id, r.from_id) for r in got[1::2]]


def _terrain(h, w, seed):
    rnd = np.random.default_rng(seed)
    v = rnd.integers(0, 60, (h, w)).astype(float)
    v[rnd.random((h, w)) < 0.03] = np.nan
    return v


def _frame(spark, v, **extra):
    rows = [(r, c, None if np.isnan(v[r, c]) else float(v[r, c])) + tuple(bool(a[r, c]) for a in extra.values()) for r in range(v.shape[0]) for c in range(v.shape[1])]
    return spark.createDataFrame(rows, "row int, col int, v double" + "".join(f", {n} boolean" for n in extra))


def _fill_brute(v):
    h, w = v.shape
    level = np.where(np.isnan(v), np.nan, np.inf)
    at = lambda a, r, c: a[r, c] if 0 <= r < h and 0 <= c < w else np.nan
    around = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc]
    for r in range(h):
        for c in range(w):
            if not np.isnan(v[r, c]) and any(np.isnan(at(v, r + dr, c + dc)) for dr, dc in around):
                level[r, c] = v[r, c]
    moved = True
    while moved:
        moved = False
        for r in range(h):
            for c in range(w):
                if np.isnan(v[r, c]):
                    continue
                low = min((at(level, r + dr, c + dc) for dr, dc in around if not np.isnan(at(level, r + dr, c + dc))), default=np.inf)
                new = max(v[r, c], min(level[r, c], low))
                if new < level[r, c]:
                    level[r, c] = new
                    moved = True
    return level


@pytest.mark.parametrize("block", [5, 8, 64])
def test_fill_depressions(spark, block):
    v = _terrain(30, 26, 7)
    got = D.fill_depressions(_frame(spark, v), block).collect()
    want = _fill_brute(v)
    assert len(got) == int(np.isfinite(v).sum())
    assert all(r.filled == want[r.row, r.col] for r in got)


def test_directions_where_rows_are_absent(spark):
    """The lowest neighbour is north-west; the cell north of the centre has no row."""
    rows = [(r, c, 5.0) for r in range(3) for c in range(3) if (r, c) not in ((0, 1), (0, 0))] + [(0, 0, 1.0)]
    got = {(r.row, r.col): r.dir for r in D.flow_direction_d8(spark.createDataFrame(rows, "row int, col int, v double")).collect()}
    assert got[1, 1] == 32 and len(got) == 8


@pytest.mark.parametrize("block", [5, 64])
def test_drainage_does_not_depend_on_blocks(spark, block):
    v = _terrain(24, 31, 9)
    v += np.linspace(0, 200, 24)[:, None]  # long paths down one side
    stream = np.zeros(v.shape, dtype=bool)
    stream[2:4, 5:20] = True
    got = D.hand_variant(_frame(spark, v, stream_mask=stream), 3.0, 25.0, 1.0, block, fill_step=None).collect()
    dirs = {(r.row, r.col): r.dir for r in got if r.v is not None}
    area = {k: 0 for k in dirs}
    nxt = {k: (k[0] + D.STEPS[d][0], k[1] + D.STEPS[d][1]) if d else None for k, d in dirs.items()}
    for k in dirs:
        at = k
        while at is not None:
            area[at] += 1
            at = nxt[at]
    for r in got:
        if r.v is None:
            continue
        assert r.area == area[(r.row, r.col)]
        at = (r.row, r.col)
        drains = lambda k: stream[k] or area[k] >= 25
        while at is not None and not drains(at):
            at = nxt[at]
        want = None if at is None or v[r.row, r.col] - v[at] < 0 else v[r.row, r.col] - v[at]
        assert r.hand == want


def test_filled_terrain_drains_everywhere(spark):
    v = _terrain(20, 20, 3)
    f = D.fill_depressions(_frame(spark, v), 8, step=0.001)
    dense = _frame(spark, v).select("row", "col").join(f.select("row", "col", F.col("filled").alias("v")), ["row", "col"], "left")
    inner = D.flow_direction_d8(dense).where("v IS NOT NULL AND dir = 0").collect()
    at = lambda r, c: v[r, c] if 0 <= r < 20 and 0 <= c < 20 else np.nan
    for r in inner:  # only open cells may be without a way down
        assert any(np.isnan(at(r.row + a, r.col + b)) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b)


def test_polygon_cells_with_hole(spark):
    p = lambda *xy: [{"x": float(x), "y": float(y)} for x, y in xy]
    rings = [("a", 0, p((1, 1), (1, 9), (9, 9), (9, 1), (1, 1))), ("a", 1, p((4, 4), (6, 4), (6, 6), (4, 6), (4, 4)))]
    d = spark.createDataFrame(rings, "id string, pos int, pts array<struct<x:double,y:double>>")
    cells = {(r.row, r.col) for r in GE.polygon_cells(d, "id").collect()}
    assert cells == {(r, c) for r in range(1, 9) for c in range(1, 9)} - {(4, 4), (4, 5), (5, 4), (5, 5)}


def test_no_lines_meet_keeps_all(spark):
    p = lambda *xy: [{"x": float(x), "y": float(y)} for x, y in xy]
    poly = spark.createDataFrame([("a", p((1, 1), (1, 2), (2, 2), (2, 1), (1, 1)))], "id string, pts array<struct<x:double,y:double>>")
    far = spark.createDataFrame([(1, p((50, 50), (60, 60))), (2, p((70, 70), (71, 70)))], "line int, pts array<struct<x:double,y:double>>")
    assert GE.lines_meeting(far, "line", poly, "id").count() == 2
    near = far.union(spark.createDataFrame([(3, p((1.5, 1.5), (1.6, 1.6)))], far.schema))
    assert [r.line for r in GE.lines_meeting(near, "line", poly, "id").collect()] == [3]


def test_stratified_sample(spark):
    f = spark.range(300).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), (F.col("id") * 137 % 40000).alias("bytes"))
    a, b = ({r.path for r in W.stratified_sample(f, 30, seed=s).collect()} for s in (1, 1))
    assert len(a) == 30 and a == b
    few = f.limit(10)
    assert W.stratified_sample(few, 30).count() == 10


def _levels_by_heap(z, ring):
    """Lowest way of each cell from the border of a block or an open cell, by a heap; and of each label to each other, over all pairs."""
    import heapq

    n = z.shape[0]
    pad = np.full((n + 2, n + 2), np.nan)
    pad[1:-1, 1:-1] = z
    for p in ring or []:
        pad[p["row"] + 1, p["col"] + 1] = p["value"]
    around = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    level = np.full((n, n), np.nan)
    heap = [(z[i, j], i, j) for i in range(n) for j in range(n) if np.isfinite(z[i, j]) and (
        i in (0, n - 1) or j in (0, n - 1) or any(np.isnan(pad[i + 1 + a, j + 1 + b]) for a, b in around))]
    heapq.heapify(heap)
    while heap:
        w, i, j = heapq.heappop(heap)
        if not np.isnan(level[i, j]):
            continue
        level[i, j] = w
        for a, b in around:
            r, c = i + a, j + b
            if 0 <= r < n and 0 <= c < n and np.isfinite(z[r, c]) and np.isnan(level[r, c]):
                heapq.heappush(heap, (max(w, z[r, c]), r, c))
    return level


def _ways(edges):
    """Lowest way between any two ends of edges."""
    names = sorted({x for e in edges for x in e[:2]})
    at = {x: i for i, x in enumerate(names)}
    m = np.full((len(names),) * 2, np.inf)
    for a, b, w in edges:
        m[at[a], at[b]] = m[at[b], at[a]] = min(m[at[a], at[b]], w)
    for k in range(len(names)):
        m = np.minimum(m, np.maximum(m[:, k:k + 1], m[k:k + 1, :]))
    np.fill_diagonal(m, 0)
    return names, m.tolist()


@pytest.mark.parametrize("seed", range(24))
def test_flood_of_a_block(seed):
    import pandas as pd

    r = np.random.default_rng(seed)
    n = int(r.integers(3, 20))
    z = r.integers(0, 6 if seed % 2 else 300, (n, n)).astype(float)
    if seed % 3:
        z[r.random((n, n)) < 0.12] = np.nan
    outside = [(i, j) for i in range(-1, n + 1) for j in range(-1, n + 1) if i in (-1, n) or j in (-1, n)]
    ring = [{"row": i, "col": j, "value": float(r.integers(0, 6))} for i, j in outside if r.random() < 0.9] if seed % 4 else None
    level, label, (u, v, w), _, is_open = D._flooded(pd.Series({"br": 0, "bc": 0, "v": z.tobytes(), "ring": ring}), "v", n)
    assert np.array_equal(level, _levels_by_heap(z, ring), equal_nan=True)
    flat = label.ravel()
    assert ((flat == D._NONE) == np.isnan(z).ravel()).all()
    border = np.zeros((n, n), dtype=bool)
    border[[0, -1], :] = border[:, [0, -1]] = True
    mine = np.flatnonzero(border.ravel() & np.isfinite(z).ravel())
    assert (flat[mine] == mine).all() and (flat[is_open.ravel() & ~border.ravel()] == D._OPEN).all()
    # what passes keep between labels is what steps between all cells keep
    steps = [(int(flat[i * n + j]), int(flat[a * n + b]), max(z[i, j], z[a, b])) for i in range(n) for j in range(n) for a, b in
             ((i, j + 1), (i + 1, j), (i + 1, j + 1), (i + 1, j - 1)) if a < n and 0 <= b < n and np.isfinite(z[i, j]) and np.isfinite(z[a, b])]
    steps = [(a, b, w) for a, b, w in steps if a != b]
    kept = list(zip(u.tolist(), v.tolist(), w.tolist()))
    assert _ways(kept) == _ways(steps)
    spanning = list(zip(*(x.tolist() for x in D._spanning(u, v, w))))
    assert _ways(spanning) == _ways(steps) and len(spanning) < max(1, len(_ways(steps)[0]))


@pytest.mark.parametrize("region", [1, 2, 16])
def test_regions_are_contracted_alike(spark, monkeypatch, region):
    monkeypatch.setattr(D, "REGION", region)
    v = np.random.default_rng(3).integers(0, 30, (40, 33)).astype(float)
    v[7:9, 5:20] = np.nan
    want = _fill_brute(v)
    got = D.fill_depressions(_frame(spark, v), 5).collect()
    assert all(r.filled == want[r.row, r.col] for r in got) and len(got) == int(np.isfinite(v).sum())


def test_crowded_regions_on_finer_cells(spark):
    """Small regions in one square, some large ones, many with one common corner; answers by comparing all with all."""
    rnd = np.random.default_rng(5)
    w, s = rnd.uniform(0, 3.9, 6000), rnd.uniform(0, 3.9, 6000)
    small = np.stack([w, s, w + rnd.uniform(0.001, 0.05, 6000), s + rnd.uniform(0.001, 0.05, 6000)], 1)
    corner = np.tile([1.0, 1.0, 1.2, 1.3], (400, 1))
    large = np.array([[-20.0, -20.0, 20.0, 20.0], [0.0, 0.0, 4.0, 4.0], [-9.0, -3.0, 2.5, 1.5], [3.0, 3.0, 2.0, 5.0]])
    b = np.concatenate([small, corner, large])
    regions = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(b)], "id int, west double, south double, east double, north double")
    p = np.concatenate([rnd.uniform(-1, 5, (700, 2)), [[1.0, 1.0], [4.0, 0.0], [0.0, 0.0]]])
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "k int, lon double, lat double")
    x, y = p[:, :1], p[:, 1:]
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero((b[:, 0] <= x) & (x < b[:, 2]) & (b[:, 1] <= y) & (y < b[:, 3])))}
    got = [(r.k, r.id) for r in J.point_regions(points, regions, bound=50, depth=4).select("k", "id").collect()]
    flat = {(r.k, r.id) for r in J.point_regions(points, regions, depth=0).select("k", "id").collect()}
    assert len(got) == len(set(got)) and set(got) == flat == want
    assert len(J.region_grid(regions, 4.0, 50, 4)) > 2
    tiles = spark.createDataFrame([(z, x, y) for z in (0, 5, 9, 10) for x, y in ([(0, 0)] if z == 0 else [((1 << z) // 2 + k % 3, (1 << z) // 2 - 1 - k // 3) for k in range(9)])], "z int, x int, y int")
    pairs = lambda **k: sorted(map(tuple, J.tile_regions(tiles, regions, **k).select("z", "x", "y", "id").collect()))
    fine = pairs(bound=50, depth=4)
    assert fine == pairs(depth=0) and len(fine) > 6400


def test_samples_of_long_lines(spark):
    """Against one walk per line; a repeated vertex, a line without length, one of a single point, and one of 30,000 vertices."""
    rnd = random.Random(3)
    lines = {1: [(0.0, 0.0), (3.0, 4.0), (3.0, 4.0), (3.0, 10.0)], 2: [(1.0, 1.0), (1.0, 1.0)], 3: [(5.0, 5.0)], 4: [(0.0, 0.0), (0.1, 0.0)], 5: []}
    lines[6] = [(i * 0.01, rnd.random()) for i in range(30_000)]
    df = spark.createDataFrame(list(lines.items()), "line int, pts array<struct<x:double,y:double>>")
    got = {(r.line, r.k): (r.x, r.y) for r in GN.line_sample_points(df, "line", "pts", 1.3).collect()}
    seen = 0
    for key, pts in lines.items():
        p = np.array(pts).reshape(-1, 2)
        run = np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(p, axis=0).T))]) if len(p) > 1 else np.zeros(1)
        if run[-1] == 0:
            continue
        n = max(2, int(run[-1] // 1.3) + 1)
        d = np.linspace(0, run[-1], n)
        seen += n
        for k in range(n):
            assert got[key, k] == pytest.approx((np.interp(d[k], run, p[:, 0]), np.interp(d[k], run, p[:, 1])), abs=1e-6)
    assert len(got) == seen


def test_polygons_of_many_rings(spark):
    """All rings count (hole, island, far part), short ones do not, and no cell is told twice."""
    sq = lambda a, b: [(a, a), (a, b), (b, b), (b, a), (a, a)]
    rows = [(1, sq(0.0, 10.0)), (1, sq(2.0, 8.0)), (1, sq(4.0, 6.0)), (1, [(20.0, 20.0), (20.0, 24.0), (24.0, 20.0)]), (2, sq(5.0, 12.0))]
    d = spark.createDataFrame(rows, "id int, pts array<struct<x:double,y:double>>")
    inside = {(1, r, c) for r in range(10) for c in range(10) if not (2 <= r < 8 and 2 <= c < 8) or (4 <= r < 6 and 4 <= c < 6)}
    inside |= {(2, r, c) for r in range(5, 12) for c in range(5, 12)}
    got = [tuple(r) for r in GE.polygon_cells(d, "id").select("id", "row", "col").collect()]
    assert len(got) == len(inside) and set(got) == inside
    touched = [tuple(r) for r in GE.polygon_cells(d, "id", all_touched=True).select("id", "row", "col").collect()]
    assert len(touched) == len(set(touched)) and set(touched) >= inside
    both = [tuple(r) for r in GE.covered_cells(d, "id").select("row", "col").collect()]
    assert len(both) == len(set(both)) and set(both) == {(r, c) for _, r, c in inside}


@pytest.mark.parametrize("fill", [None, 0.0])
def test_basins_together_as_one_by_one(spark, fill):
    """Basins of several sizes at overlapping and negative places, one without a name; each as if it were alone."""
    parts, alone = [], {}
    variants, feet = [(3.0, 6.0), (3.0, 20.0), (1.0, 6.0)], (10, 60, 150)
    for name, (h, w, row, col) in {"a": (9, 11, 0, 0), "b": (17, 6, 4, -7), None: (3, 4, -30, 2)}.items():
        v = _terrain(h, w, h)
        f = _frame(spark, v, stream_mask=v > 50, ref=v < 20).withColumn("row", F.col("row") + row).withColumn("col", F.col("col") + col)
        parts.append(f.withColumn("basin", F.lit(name).cast("string")))
        alone[name] = B.hand_sensitivity(f, variants, feet, "ref", 1.0, 64, fill)
    columns = alone["a"].columns
    got = B.hand_sensitivity(functools.reduce(lambda x, y: x.unionByName(y), parts), variants, feet, "ref", 1.0, 4, fill, basin="basin")
    rows = {(r.basin, *[r[c] for c in columns]) for r in got.collect()}
    assert rows == {(n, *r) for n, d in alone.items() for r in d.select(*columns).collect()} and len(rows) == 27


def test_no_basins(spark):
    none = spark.createDataFrame([], "basin string, row int, col int, v double, stream_mask boolean, ref boolean")
    assert B.hand_sensitivity(none, [(1.0, 2.0)], (10,), "ref", basin="basin").count() == 0


def test_grids_that_differ_are_not_paired(spark):
    shape = "raster int, height int, width int, a double, b double, c double, d double, e double, f double, crs string"
    row = lambda i, h=2, c=0.0, a=1.0, crs="x": (i, h, 2, a, 0.0, c, 0.0, -1.0, 0.0, crs)
    left = spark.createDataFrame([row(1), row(2), row(3), row(4), row(5), row(8, crs=None)], shape)
    right = spark.createDataFrame([row(1, c=1e-9), row(2, h=3, c=0.1), row(3, crs=None), row(4, a=1.0001), row(6), row(8, crs=None)], shape)
    cells = spark.createDataFrame([(i, 0, 0, i) for i in (1, 2, 3, 4, 5, 7)], "raster int, row int, col int, v int")
    got = {(r.raster, r.row, r.a, r.b, r.grid_error) for r in GR.checked_pair(cells, cells.where("raster < 4"), left, right, "raster").collect()}
    assert got == {(1, 0, 1, 1, None), (2, None, None, None, "shape,transform"), (3, None, None, None, "crs"), (4, None, None, None, "transform"),
                   (5, None, None, None, "not in right"), (6, None, None, None, "not in left"), (7, None, None, None, "no grid")}


def test_positions_on_a_turned_grid(spark):
    grid = (2.0, 0.5, 10.0, -0.3, -3.0, 7.0)
    cells = spark.range(12).select(F.floor(F.col("id") / 4).cast("int").alias("row"), (F.col("id") % 4).cast("int").alias("col"), F.col("id").cast("double").alias("v"))
    back = GR.resample_onto(cells.select("row", "col", F.col("v").alias("own")), grid, cells, grid)
    assert all(r.v == r.own for r in back.collect())
    blend = GR.resample_onto(cells.select("row", "col", F.col("v").alias("own")), grid, cells, grid, bilinear=True).collect()
    assert len(blend) == 12 and all(r.v == pytest.approx(r.own) for r in blend)
    with pytest.raises(ValueError):
        GR.position((1.0, 2.0, 0.0, 2.0, 4.0, 0.0), F.lit(0), F.lit(0))


@pytest.mark.parametrize("block", [4, 256])
def test_neighbours_do_not_depend_on_blocks(spark, block):
    """Slopes and flags of cells with holes and gaps, against plain loops."""
    v = _terrain(11, 13, 5)
    rows = {(r, c): None if np.isnan(v[r, c]) else float(v[r, c]) for r in range(11) for c in range(13) if (r * 7 + c) % 10}
    cells = spark.createDataFrame([(r, c, x) for (r, c), x in rows.items()], "row int, col int, v double")
    got = {(r.row, r.col): r for r in RS.surface_gradient(cells, 2.8, block).collect()}
    assert set(got) == set(rows)
    for (r, c), own in rows.items():
        left, right, up, down = (rows.get(p, own) for p in ((r, c - 1), (r, c + 1), (r - 1, c), (r + 1, c)))
        dx, dy = (None if None in p else p[0] - p[1] for p in ((left, right), (up, down)))
        gx, gy = dx or 0.0, dy or 0.0
        run = (gx * gx + gy * gy) ** 0.5
        assert (got[r, c].fx, got[r, c].fy) == pytest.approx((0.72, 0.36) if run < 0.0001 else (gx / run, gy / run))
        if dx is None or dy is None:
            assert got[r, c].ny is None and got[r, c].nx is None
        else:
            length = (dx * dx + dy * dy + 2.8 ** 2) ** 0.5
            assert (got[r, c].nx, got[r, c].ny, got[r, c].nz) == pytest.approx((dx / length, 2.8 / length, dy / length))
    flags = J.neighbor_any(cells, {"high": F.col("v") > 50, "void": F.col("v").isNull()}, block).collect()
    around = lambda r, c: [rows[r + i, c + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (r + i, c + j) in rows]
    assert len(flags) == len(rows)
    for f in flags:
        near = around(f.row, f.col)
        assert f.high == any(x is not None and x > 50 for x in near) and f.void == (None in near)
