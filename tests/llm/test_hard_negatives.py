"""Operator 11 against all pairs, and its SQL."""

import math

import numpy as np
import pytest
from compare import assert_same, duck
from pyspark.sql import functions as F

from weftgraph.llm import hard_negatives as hn
from weftgraph.llm import queries

SCHEMA = "vec_id long, embedding array<float>, label int"
NAMES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(rows, every=100):
    good = set()
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v):
            good.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(c))) for c in v)))
    out = []
    for a in good:
        if a[0] % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in good if b != a))
        for s, p, _ in [x for x in scored if x[2] == a[1]][:5]:
            fits = [x for x in scored if x[2] != a[1] and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(a[0], p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fits)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], label) for i, v, label in rows], SCHEMA)


def mined(df, every=100):
    got = hn.mine(hn.with_wrong_labels(df), F.col("vec_id") % every == 0)
    assert tuple(got.columns) == NAMES
    return sorted(map(tuple, got.collect()))


def clusters(n=600, seed=0, d=8):
    """Clusters with labels that mostly follow them, a third of all rows one vector, vectors of many lengths."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, d))
    rows = []
    for i in range(n):
        k = int(rng.integers(6))
        v = centres[k] + 0.3 * rng.standard_normal(d)
        v = v / np.linalg.norm(v) * (1 if i % 4 else rng.uniform(0.2, 3))
        rows.append((i, v.tolist(), k if rng.random() < 0.8 else int(rng.integers(10))))
    same = rows[1][1]
    return [(i, same if i % 3 == 1 else v, label) for i, v, label in rows]


def test_whole_table(spark, sf):
    assert assert_same(queries.op11_hard_negatives(spark, sf), duck(sf), hn.ORACLE)


@pytest.mark.parametrize("small", [False, True])
def test_clusters(spark, monkeypatch, small):
    """small: many cells, blocks and groups, so that bounds and pieces matter."""
    if small:
        for name, value in (("BLOCK_ROWS", 7), ("GROUP_ROWS", 5), ("PIECE_BLOCKS", 2), ("_SEARCHES", 8)):
            monkeypatch.setattr(hn, name, value)
    rows = clusters()
    assert mined(frame(spark, rows), 10) == brute(rows, 10)


def test_awkward_rows(spark):
    rows = clusters(250, 4)
    rows += [rows[0], rows[100], (100, rows[7][1], 3), (100, rows[7][1], 3), (105, rows[105][1], 5)]
    rows += [(None, rows[5][1], 1), (900, None, 1), (901, rows[2][1], None), (902, [1.0, None] + [0.0] * 6, 1), (903, [float("nan")] * 8, 1), (904, [float("-inf")] + [0.0] * 7, 2)]
    rows += [(1000, [0.0] * 8, 4), (1001, [0.0] * 8, 4), (1002, [0.0] * 8, 5), (1100, [-1.0] * 8, 6), (1101, [1.0] * 8, 6), (1200, [0.5], 2), (1300, [], 2), (-100, [0.3] * 8, 2), (2000, [40000.0] * 8, 1), (2001, [-3.0] * 8, 1)]
    clash = frame(spark, rows).select("*", *[F.lit("clash").alias(c) for c in ("x", "cell", "block", "norm", "rank", "anchors", "search")])
    assert mined(clash) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(7, [1.0], 1)], [(100, [1.0], 1)], [(100, None, 1)], [(100, [1.0], 1), (100, [1.0], 1)]])
def test_few_rows(spark, rows):
    assert mined(frame(spark, rows)) == []


def test_scores_beyond_doubles(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(4) * 2e6).tolist(), i % 2) for i in range(60)]
    assert max(sum(math.floor(256 * float(np.float32(c))) ** 2 for c in v) for _, v, _ in rows) > 1 << 53
    assert mined(frame(spark, rows), 10) == brute(rows, 10)


def test_bounds_spare_blocks(spark, monkeypatch):
    """Clusters far apart: most blocks are sent to no group, and the result is the same."""
    monkeypatch.setattr(hn, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(900):
        k = i % 9
        centre = np.zeros(9)
        centre[k] = 1
        v = centre + 0.02 * rng.standard_normal(9)
        rows.append((i, (v / np.linalg.norm(v)).tolist(), int(rng.integers(3))))
    sent = []
    plain = hn.joined
    monkeypatch.setattr(hn, "joined", lambda asks, blocks, pairs, *rest: sent.append((pairs.count(), blocks.count(), asks.count())) or plain(asks, blocks, pairs, *rest))
    assert mined(frame(spark, rows), 10) == brute(rows, 10)
    assert len(sent) == 4 and sum(p for p, *_ in sent[:2]) < 0.5 * sent[0][1] * sent[0][2]


def test_shares_of_scores(spark):
    scores = [0, 1, -1, 7, 10, 333, (1 << 61) + 9, -(1 << 61)]
    got = spark.createDataFrame([(s,) for s in scores], "s long").select(hn._share(F.col("s"), 30, True), hn._share(F.col("s"), 90, False)).collect()
    assert [tuple(r) for r in got] == [(-(-30 * s // 100), 90 * s // 100) for s in scores]
