"""Operator 3 against water filling by hand and the systematic sample's own laws."""

import math
import re
from collections import defaultdict

import pytest
from fixtures import SCHEMA, clashing, documents, frame
from pyspark.sql import functions as F

from weftgraph.llm import mixing


def fill(sizes):
    """Targets by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, target, openly = 1.5 * sum(sizes.values()), {}, set(names)
    while openly:
        level = left / sum(weight[s] for s in openly)
        over = [s for s in openly if weight[s] * level >= 2 * sizes[s]]
        if not over:
            return target | {s: weight[s] * level for s in openly}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            openly.remove(s)
    return target


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_and_copies(spark):
    rows = documents(n=400)
    out = mixing.mix_counts(clashing(spark, rows)).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    want, source = fill(sizes), {r[0]: r[3] for r in rows}
    assert len(out) == len(rows)
    taken = defaultdict(int)
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(size(r[1]) for r in rows) + 0.02 * want[s]
    assert sorted(out, key=repr) == sorted(mixing.mix_counts(frame(spark, rows).repartition(7)).collect(), key=repr)


@pytest.mark.parametrize("block_rows,repeats", [(512, 1), (7, 1), (7, 5)])
def test_copies_by_hand(spark, monkeypatch, block_rows, repeats):
    """Every row's taken words: prefix sums, one offset a source, an emission for each whole number crossed."""
    monkeypatch.setattr(mixing, "BLOCK_ROWS", block_rows)
    rows = documents(n=150) + documents(n=12) * (repeats - 1)
    df = frame(spark, rows)
    hashed = df.select("doc_id", "text", "source", F.struct(F.col("doc_id").alias("row_id"), F.xxhash64("doc_id", "text").alias("text_key")).alias("row"))
    hashed = hashed.select("*", F.xxhash64("row", F.lit(0)).alias("h0"), F.xxhash64("row", F.lit(1)).alias("h1"), F.xxhash64("source", F.lit(0), F.lit("offset")).alias("ho")).collect()
    out = mixing.mix_counts(df).collect()
    target = {(r.doc_id, r.size): (r.target, r.source_size) for r in out}
    want = []
    for source in {r.source for r in hashed}:
        own = [r for r in hashed if r.source == source]
        blocks = -(-len(own) // block_rows)
        low = lambda r: (r.row.row_id is not None, r.row.row_id or 0, r.row.text_key)
        own.sort(key=lambda r: (r.h0 % blocks, size(r.text), r.h1, low(r)))
        goal, total = target[own[0].doc_id, size(own[0].text)]
        rate, offset, place = goal / total if total else 0.0, own[0].ho % (1 << 30) / (1 << 30), 0
        while place < len(own):
            equal = sum(r.row == own[place].row for r in own)
            copies = math.floor(offset + rate * (place + equal)) - math.floor(offset + rate * place)
            for k in range(equal):
                want.append((own[place].doc_id, (copies // equal + (k < copies % equal)) * size(own[place].text)))
            place += equal
    assert sorted(((r.doc_id, r.taken) for r in out), key=repr) == sorted(want, key=repr)


def test_mix_emits_what_was_counted(spark):
    rows = [r for r in documents(n=300) if r[0] is not None]
    counted = defaultdict(int)
    for r in mixing.mix_counts(frame(spark, rows)).collect():
        counted[r.doc_id] += r.taken
    emitted = defaultdict(int)
    mixed = mixing.mix(clashing(spark, rows))
    assert mixed.columns == clashing(spark, rows).columns
    for r in mixed.collect():
        emitted[r.doc_id] += size(r.text)
    assert {k: v for k, v in counted.items() if v} == {k: v for k, v in emitted.items() if v}


def test_many_blocks_follow_the_target(spark):
    rows = [(i, "w " * (1 + i * i % 97), None, "big" if i % 3 else f"s{i % 5}", None) for i in range(6000)]
    out = mixing.mix_counts(frame(spark, rows)).collect()
    taken, target, source = defaultdict(int), {}, {r[0]: r[3] for r in rows}
    for r in out:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] / target[s] - 1) < 0.02 for s in target)


def test_empty_and_wordless(spark):
    assert mixing.mix_counts(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in mixing.mix_counts(frame(spark, [(1, None, None, None, None), (2, " ", None, "a", 1)])).orderBy("doc_id").collect()] == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
