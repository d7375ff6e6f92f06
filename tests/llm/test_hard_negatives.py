"""Hard negatives against all pairs; the curve and the bounds by themselves."""

import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geodemand.llm import hard_negatives as H
from geodemand.llm.hard_negatives import Mining, hilbert, mine_hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, Label string, tile long, block long, id long, x binary, score double"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], lab, "clash", 1, 2, 3, b"", 0.5)
                                  for i, v, lab in rows], SCHEMA)


def brute(rows, how=Mining(), scale=256.0):  # noqa: B008
    good = [(i, [math.floor(scale * c) for c in v], lab) for i, v, lab in rows
            if v is not None and lab is not None and all(c is not None and math.isfinite(c) and abs(c * scale) < 2**56 for c in v)]
    order = lambda s, i: (-s, i is None, i or 0)
    out = []
    for a, (anchor, x, label) in enumerate(good):
        if anchor is None or anchor % how.every:
            continue
        met = [(sum(p * q for p, q in zip(x, y, strict=True)), i, lab == label) for b, (i, y, lab) in enumerate(good) if b != a and len(y) == len(x)]
        first = sorted(((s, i) for s, i, same in met if same), key=lambda m: order(*m))[:how.positives]
        rest = sorted(((s, i) for s, i, same in met if not same), key=lambda m: order(*m))
        for ps, p in first:
            fit = [(s, i) for s, i in rest if how.low * ps <= how.unit * s <= how.high * ps][:how.negatives]
            out += [(anchor, p, k + 1, i, ps, s) for k, (s, i) in enumerate(fit)]
    return out


def check(spark, rows, how=Mining(), **options):  # noqa: B008
    got = [tuple(r) for r in mine_hard_negatives(table(spark, rows), how, **options).collect()]
    want = brute(rows, how, options.get("scale", 256.0))
    fits = lambda s: s if -(2**63) <= s < 2**63 else None
    want = [(*r[:4], fits(r[4]), fits(r[5])) for r in want]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    return want


def cloud(n, dim, seed, labels=4, centres=6):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    x = middle[rng.integers(0, centres, n)] + 0.3 * rng.normal(size=(n, dim))
    return [(i, v.tolist(), int(lab)) for i, (v, lab) in enumerate(zip(x, rng.integers(0, labels, n), strict=True))]


def test_against_all_pairs(spark):
    assert check(spark, cloud(260, 6, 1), Mining(every=10), block_rows=16, tile_rows=8)
    assert check(spark, cloud(300, 20, 2, labels=2), Mining(every=25))
    assert check(spark, cloud(120, 1, 3), Mining(every=5), block_rows=7, tile_rows=3)


def test_many_chunks_and_groups(spark, monkeypatch):
    monkeypatch.setattr(H, "_CHUNK", 3)
    monkeypatch.setattr(H, "_GROUP", 2)
    assert check(spark, cloud(240, 5, 4), Mining(every=6, positives=3, negatives=4), block_rows=10, tile_rows=4)


def test_a_label_or_vector_with_a_third_of_the_rows_and_ties(spark):
    rows = cloud(150, 4, 5, labels=3)
    same = [(1000 + i, [1.0, 0.5, -0.25, 0.0], i % 2) for i in range(80)]
    coarse = [(2000 + i, [float(i % 3), 1.0, 0.0, 0.0], i % 4) for i in range(60)]  # many equal scores
    assert check(spark, rows + same + coarse + same[:3] + [rows[0]] * 2, Mining(every=20), block_rows=16, tile_rows=5)


def test_awkward_rows(spark):
    rows = cloud(80, 3, 6)
    rows += [(None, [1.0, 1.0, 1.0], 0), (None, [1.0, 1.0, 1.0], 1), (300, None, 1), (400, [1.0, None, 2.0], 1), (500, [math.nan, 1.0, 2.0], 1),
             (600, [math.inf, 1.0, 2.0], 1), (700, [1e300, 1.0, 2.0], 1), (800, [1.0, 2.0, 3.0], None), (900, [1.0, 2.0], 1), (901, [1.5, 2.0], 1),
             (902, [1.0, 1.0], 2), (1000, [], 1), (1001, [], 1), (1002, [], 2), (1100, [0.0, 0.0, 0.0], 1), (-100, [0.3, -0.2, 0.9], 2)]
    assert check(spark, rows, Mining(every=10), block_rows=8, tile_rows=4)


def test_scores_beyond_doubles_and_longs(spark):
    rng = np.random.default_rng(7)
    for size in (2.0**22, 2.0**28, 2.0**40):
        x = np.floor(rng.normal(size=(60, 3)) * size) + rng.integers(0, 2, (60, 3))
        assert check(spark, [(i, v.tolist(), i % 3) for i, v in enumerate(x)], Mining(every=7), block_rows=8, tile_rows=4)


def test_small_and_empty_tables(spark):
    assert mine_hard_negatives(table(spark, [])).collect() == []
    assert check(spark, [(0, [1.0, 1.0], 0)]) == []
    assert check(spark, [(1, [1.0, 1.0], 0), (2, [1.0, 1.0], 1)]) == []  # no anchors
    assert check(spark, [(0, [1.0, 1.0], 0), (1, [1.0, 1.0], 0), (2, [0.5, 0.5], 1)])


@pytest.mark.parametrize(("axes", "bits"), [(1, 4), (2, 3), (3, 3), (5, 2)])
def test_curve_visits_neighbours(axes, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), axis=-1).reshape(-1, axes)
    place = hilbert(cells, bits)
    assert sorted(place.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(place)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 6), st.integers(0, 10**6))
def test_bounds_hold_all_scores(dim, seed):
    rng = np.random.default_rng(seed)
    x, y = rng.integers(-50, 50, (4, dim)), rng.integers(-50, 50, (9, dim))
    tile = H._ForPositives({"tile": 0, "dim": dim, "label": "a", "x": H._whole(x), "homes": [0] * 4, "slots": [0] * 4, "seeds": [None] * 4})
    least, most = tile.bounds(y.min(axis=0)[None], y.max(axis=0)[None])
    scores = x @ y.T
    assert (least[:, 0] <= scores.min(axis=1)).all() and (scores.max(axis=1) <= most[:, 0]).all()


def test_far_blocks_are_not_chosen():
    """Tight clusters of one label: an anchor's tile chooses its own block and no other."""
    rng = np.random.default_rng(8)
    centres = np.eye(8, dtype=np.int64) * 1000
    blocks = [c + rng.integers(-5, 6, (32, 8)) for c in centres]
    zones = pa.Table.from_pylist([{"block": i, "dim": 8, "label": "a", "lo": H._whole(b.min(axis=0)[None]), "hi": H._whole(b.max(axis=0)[None])}
                                  for i, b in enumerate(blocks)])
    for i, b in enumerate(blocks):
        seed = int(np.sort(b[1:] @ b[0])[-5])
        tile = {"tile": 0, "group": 3, "dim": 8, "label": "a", "x": H._whole(b[:1]), "homes": [i], "slots": [0], "seeds": [seed]}
        chosen = H._choose(H._ForPositives)(pa.Table.from_pylist([tile]), zones)
        assert chosen.to_pylist() == [{"group": 3, "block": i}]
        ask = tile | {"label": "b", "windows": [{"slot": 0, "at": 0, "score": int(b[1] @ b[0] / 0.6)}]}
        assert H._choose(H._for_negatives(Mining()))(pa.Table.from_pylist([ask]), zones)["block"].to_pylist() == [i]
