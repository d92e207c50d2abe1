"""Operator 12 against an eigendecomposition of the exact covariance."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, components=4):
    good = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in good), default=0)
    good = [(i, (*v, *[0] * (width - len(v)))) for i, v in good]
    fit = np.array(sorted({v for _, v in good}), float).reshape(-1, width)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    centred = fit - np.array(sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, v in good:
        for k in range(min(components, width)):
            white = float((np.array(v) - np.array(sums) / n) @ vectors[:, k]) / math.sqrt(values[k]) if values[k] > 1e-9 else None
            out.setdefault((i, k + 1), []).append((n, sum((n * a - s) ** 2 for a, s in zip(v, sums)), white, values[k] / values.sum() if values.sum() > 0 else None))
    return out


def held(df, want):
    rows = df.collect()
    assert len(rows) == sum(map(len, want.values()))
    signs = {}
    for r in rows:
        options = want[r.vec_id, r.component]
        n, deviation, white, explained = next(o for o in options if o[1] == r.deviation)
        assert r.n == n
        assert (r.whitened is None) == (white is None)
        if white is not None:
            assert r.explained == pytest.approx(explained, rel=1e-9)
            assert r.identity_error <= 1e-9
            if abs(white) > 1e-6:
                sign = signs.setdefault(r.component, 1 if r.whitened * white > 0 else -1)
                assert r.whitened == pytest.approx(sign * white, rel=1e-6, abs=1e-7)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], label) for i, v, label in rows], SCHEMA)


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    held(queries.op12_whiten(spark, sf), brute(rows))


def test_awkward_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(6).tolist(), i % 3) for i in range(60)]
    rows += [(None, rng.standard_normal(6).tolist(), None), rows[3], rows[3], (200, rows[5][1], 1), (201, [0.5, -0.25], 0), (202, [], 0)]
    rows += [(300, None, 1), (301, [1.0, None, 0, 0, 0, 0], 1), (302, [float("nan")] * 6, 1), (303, [float("inf"), 0.0, 0, 0, 0, 0], 1), (304, [-0.001, 0.0, -0.0, 0, 0, 0], 1)]
    rows += [(305, [1e30, 0.0, 0, 0, 0, 0], 1)]
    clash = frame(spark, rows).select("*", *[F.lit("clash").alias(c) for c in ("x", "n", "component", "cell", "value", "whitened")])
    held(whitening.whitened(clash), brute(rows[:-1]))


def test_nothing_varies(spark):
    got = whitening.whitened(frame(spark, [(1, [0.5, 1.0], 0), (2, [0.5, 1.0], 1)])).collect()
    assert len(got) == 4 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 and r.n == 1 for r in got)


def test_fewer_directions_than_components(spark):
    got = whitening.whitened(frame(spark, [(i, [i / 4, 2.0, i / 2], 0) for i in range(9)])).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in got) and {r.component for r in got} == {1, 2, 3}
    assert max(r.explained for r in got) == pytest.approx(1)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [], 1)]])
def test_no_rows(spark, rows):
    assert whitening.whitened(frame(spark, rows)).collect() == []


def test_a_spectrum_with_gaps_stops_at_the_block(spark):
    """Twenty dimensions of which three carry the variance: the residuals hold, so the block never grows."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 3)) @ np.diag([90.0, 30.0, 9.0]) @ np.linalg.qr(rng.standard_normal((20, 3)))[0].T + rng.standard_normal((400, 20)) * 1e-3
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    kept, width = whitening.rows_of(frame(spark, rows))
    fit = kept.select("x").distinct()
    near = whitening.fitted(fit, width, 3, oversampling=4, power=12)
    assert not near.full
    whole = whitening.fitted(fit, width, 3, oversampling=99)
    assert whole.full
    assert near.values == pytest.approx(whole.values, rel=1e-12)
    assert np.abs(np.abs((near.directions * whole.directions).sum(axis=0)) - 1).max() < 1e-12
    flat = whitening.fitted(kept.select("x").distinct(), width, 3, oversampling=2, power=0)
    assert flat.full and flat.values == pytest.approx(whole.values, rel=1e-12)


def test_deviations_beyond_longs():
    x = np.array([[3, -4], [2**40, 5]])
    assert whitening.deviations(x[:1], 10, [7, 9]).to_pylist() == [(30 - 7) ** 2 + (-40 - 9) ** 2]
    assert whitening.deviations(x, 10, [7, 9]).to_pylist() == [(30 - 7) ** 2 + (-40 - 9) ** 2, None]
