"""Vector codes against plain Python, and what bounds may and may not do."""

import hashlib

import numpy as np
import pytest

from tests.llm.fixtures import VECTORS
from tests.llm.fixtures import vectors as made
from tilewater.llm import vectors


def brute(rows, parts=4, entries=256, rounds=4):
    """code and error by row number, and the codebooks, in whole numbers of Python."""
    kept = [(i, v, [int(np.floor(np.float64(np.float32(x)) * 1024)) for x in e], lab) for v, e, lab in rows
            if e is not None and all(x is not None and np.isfinite(x) for x in e) for i in [v]]
    width = len(kept[0][2]) // parts
    first = {}
    for i, _, x, _ in kept:
        if i is not None:
            first[i] = min(first.get(i, x), x)
    ids = sorted(first)[:entries]
    books = [[first[i][p * width : (p + 1) * width] for i in ids] for p in range(parts)]
    near = lambda x, book: min(((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(book)))
    for r in range(rounds + 1):
        codes = [[near(x[p * width : (p + 1) * width], books[p]) for p in range(parts)] for _, _, x, _ in kept]
        if r == rounds:
            break
        for p in range(parts):
            for j in range(len(ids)):
                mine = [x[p * width : (p + 1) * width] for (_, _, x, _), c in zip(kept, codes, strict=True) if c[p][1] == j]
                if mine:
                    books[p][j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return [(i, "".join(f"{j:02x}" for _, j in c), sum(d for d, _ in c), lab) for (i, _, _, lab), c in zip(kept, codes, strict=True)], sha


def check(spark, rows):
    out = vectors.digest(spark.createDataFrame(rows, VECTORS).repartition(7)).collect()
    expected, sha = brute(rows)
    total = {}
    for _, _, e, lab in expected:
        total[lab] = total.get(lab, 0) + e
    order = lambda r: tuple((x is None, x or 0) for x in r[:2])
    assert sorted([(r.vec_id, r.code, r.error, r.label_error) for r in out], key=order) == sorted([(i, c, e, total[lab]) for i, c, e, lab in expected], key=order)
    assert {r.codebooks_sha256 for r in out} <= {sha}


def test_against_plain_python(spark):
    check(spark, made(n=420, width=8))


def test_few_rows_ties_null_ids(spark):
    v = [0.5, -0.5, 0.001, 0.0] * 2
    check(spark, [(3, v, None), (1, v, None), (None, [0.4] * 8, 2), (2, [-x for x in v], 2), (2, v, 2)])


def test_components_too_large_for_exact_doubles(spark):
    rows = [(i, [float(i % 5) * 3e5 + 0.1, 1e6, -2e6, float(i)], i % 3) for i in range(40)]
    check(spark, rows)


def test_other_dimensions_and_no_ids(spark):
    rows = [(1, [1.0] * 8, 0), (2, [2.0] * 8, 0), (3, [1.0] * 5, 0), (4, [], 1)]
    out = {r.vec_id: r for r in vectors.digest(spark.createDataFrame(rows, VECTORS)).collect()}
    assert out[1].code == "00000000" and out[2].code == "01010101"
    assert out[3].code is None and out[3].error is None and out[3].label_error == 0 and out[4].label_error is None
    nobody = vectors.digest(spark.createDataFrame([(None, [1.0] * 8, 0)], VECTORS)).collect()
    assert len(nobody) == 1 and nobody[0].code is None


def test_clashing_names_and_uneven_parts(spark):
    from pyspark.sql import functions as F

    rows = [(i, [0.1 * i, 0.2, -0.3 * i, 0.4, 0.5 * i], i % 2) for i in range(10)]
    df = spark.createDataFrame(rows, VECTORS).select("*", *[F.lit("x").alias(c) for c in ("vector", "code", "error", "part", "low", "stamp", "rows")])
    out, books = vectors.train(df)
    assert books.first == [0, 2, 3, 4, 5] and out.columns == ["vec_id", "label", "code", "error"] and {r.error for r in out.collect()} == {0}


@pytest.mark.parametrize("seed", range(6))
def test_bounds_never_change_a_result_and_save_scans(seed):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 300, (60, 6))
    x = np.floor(centres[r.integers(0, 60, 3000)] + r.normal(0, 20, (3000, 6)))
    books = [x[:200].astype(np.int64)]
    groups = vectors.clustered(books[0], 16)
    low, stamp = np.zeros((len(x), len(groups)), np.float16), np.zeros((len(x), len(groups)), np.uint8)
    code, rescanned = None, []
    for t in range(5):
        code = vectors.nearest(x, books, groups, code, low, stamp)
        d = ((x[:, None, :] - books[-1][None]) ** 2).sum(axis=2)
        assert (code == d.argmin(axis=1)).all()
        for g, members in enumerate(groups):  # each bound lies under the true distance in the round of its stamp
            then = np.stack([((x[:, None, :] - b[members][None]) ** 2).sum(axis=2).min(axis=1) for b in books])
            assert (low[:, g].astype(float) <= np.sqrt(then[stamp[:, g], np.arange(len(x))])).all()
        rescanned.append((stamp == t).mean())
        nxt = books[-1].copy()
        for j in range(len(nxt)):
            if (code == j).any():
                nxt[j] = np.floor(x[code == j].sum(axis=0) / (code == j).sum())
        books.append(nxt)
    assert rescanned[0] == 1 and max(rescanned[1:]) < 0.5


def test_net_displacement_is_tighter_than_added_drifts():
    there, back = np.array([[0.0, 0.0]]), np.array([[30.0, 40.0]])
    books = [there.astype(np.int64), back.astype(np.int64), there.astype(np.int64)]
    x = np.array([[3.0, 4.0]])
    low, stamp = np.array([[5.0, 90.0]], np.float16), np.zeros((1, 2), np.uint8)
    far = [np.vstack([b, [[200, 0]]]) for b in books]
    code = vectors.nearest(x, far, [np.array([0]), np.array([1])], np.array([0]), low, stamp)
    assert code[0] == 0 and stamp[0, 1] == 0  # the second group was not scanned again
