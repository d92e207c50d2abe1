"""Operator 2 against all pairs."""

import random
import re

import numpy as np
import pytest
from fixtures import SCHEMA, clashing, documents, frame
from pyspark.sql import functions as F

from weftgraph.llm import near_dedup as nd
from weftgraph.llm.components import components


def shingles(text, k):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def brute(rows, like):
    sets = [(r[0], shingles(r[1], like.shingle)) for r in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, s in sets:
        for b, t in sets:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= like.percent * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets), key=repr)


def family(seed=1):
    """Chains and stars of near copies around the threshold, beside the awkward cases."""
    rnd = random.Random(seed)
    rows = documents(n=40)
    doc_id = 1000
    for base in range(6):
        words = [f"b{base}w{rnd.randrange(150)}" for _ in range(rnd.choice([30, 90, 220]))]
        for _ in range(14):
            doc_id -= 3
            copy = list(words)
            for _ in range(rnd.randrange(6)):
                copy[rnd.randrange(len(copy))] = f"e{rnd.randrange(10**6)}"
            if rnd.random() < 0.3:
                words = copy
            rows.append((doc_id, (" " if rnd.random() < 0.5 else "\n").join(copy).upper() if rnd.random() < 0.2 else " ".join(copy), "en", "s", 1))
    return rows


@pytest.mark.parametrize("like,block", [(nd.CONTRACT, 96), (nd.Likeness(), 96), (nd.CONTRACT, 4)])
def test_near_duplicates(spark, monkeypatch, like, block):
    monkeypatch.setattr(nd, "BLOCK_SETS", block)
    rows = family()
    got = sorted(map(tuple, nd.near_duplicates(clashing(spark, rows), like).collect()), key=repr)
    assert got == brute(rows, like)
    assert sum(not r[3] for r in got) > 30


def test_keep_one(spark):
    rows = family(2)
    kept = {(r[0]) for r in brute(rows, nd.Likeness()) if r[3]}
    df = clashing(spark, rows)
    out = nd.keep_one(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id is not None, r.doc_id) for r in out.collect()) == sorted((r[0] is not None, r[0]) for r in rows if r[0] in kept)


def test_tables_and_misses():
    like = nd.Likeness(3, 85)
    assert like.side == 13
    assert 2 * (1 - 0.85**like.rows) ** like.side <= like.miss


def test_minhash_agrees_with_jaccard(spark):
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rnd.sample(base, 300)), None, None, None) for i in range(40)]
    like = nd.Likeness(1, 50, rows=1, miss=1e-30)
    sig = nd.signatures(frame(spark, rows).select("doc_id", "text"), like).orderBy("doc_id").collect()
    err = []
    for i in range(40):
        for j in range(i):
            a, b = (shingles(rows[x][1], 1) for x in (i, j))
            v = [np.frombuffer(sig[x].v, np.uint16) for x in (i, j)]
            same = np.mean([x == y for x, y in zip([*sig[i].u, *v[0]], [*sig[j].u, *v[1]])])
            err.append(same - len(a & b) / len(a | b))
    assert abs(np.mean(err)) < 0.02


def test_links_in_chunks(monkeypatch):
    monkeypatch.setattr(nd, "_CHUNK", 16)
    rnd = np.random.default_rng(0)
    sets = [np.unique(rnd.integers(0, 60, 40)).astype(np.uint64) for _ in range(30)]
    ranges = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    every = np.ones(30, bool)
    a, b = nd.links(np.concatenate(sets), ranges, every, every, 40)
    want = {(i, j) for i in range(30) for j in range(30) if i != j and 100 * len(np.intersect1d(sets[i], sets[j])) >= 40 * len(np.union1d(sets[i], sets[j]))}
    assert set(zip(a.tolist(), b.tolist())) == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 70)] + [(200, i) for i in range(201, 260)] + [(300, 300)]
    random.Random(0).shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(71)} | {i: 200 for i in range(200, 260)}
    assert components(spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))).count() == 0


def test_empty(spark):
    assert nd.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_large_group(spark, monkeypatch):
    """2,000 different copies of one text, lightly and heavily edited: several blocks, several rounds, frequent table halves."""
    monkeypatch.setattr(nd, "HOT_ROWS", 300)
    rnd = random.Random(4)
    base = [f"b{i}" for i in range(40)]
    rows = []
    for i in range(2000):
        words = list(base)
        for _ in range(rnd.choice([0, 1, 1, 1, 2, 3, 5])):
            words[rnd.randrange(40)] = f"e{rnd.randrange(60)}"
        rows.append((5000 - i, " ".join(words), None, None, None))
    got = sorted(map(tuple, nd.near_duplicates(frame(spark, rows), nd.CONTRACT).collect()))
    sets = {r[0]: shingles(r[1], 3) for r in rows}
    ids = {s: min(i for i in sets if sets[i] == s) for s in set(sets.values())}
    code = {g: k for k, g in enumerate(sorted({g for s in ids for g in s}))}
    held = np.zeros((len(ids), len(code)), np.float32)
    order = sorted(ids, key=ids.get)
    for k, s in enumerate(order):
        held[k, [code[g] for g in s]] = 1
    both = held @ held.T
    size = held.sum(1)
    linked = 100 * both >= 85 * (size[:, None] + size[None, :] - both)
    label = np.array([ids[s] for s in order])
    while (new := np.where(linked, label[None, :], 1 << 60).min(1)).tolist() != label.tolist():
        label = new
    want = dict(zip(order, label.tolist()))
    assert got == sorted((i, len(s), want[s], want[s] == i) for i, s in sets.items())
    assert 2 < len(set(label.tolist())) < 1500


def boilerplate(name, n, shared_words, own_words):
    """n texts with the same first words and words of their own: one cluster of candidates in which nothing is linked."""
    return [[f"{name}s{j}" for j in range(shared_words)] + [f"{name}o{i}w{j}" for j in range(own_words)] for i in range(n)]


@pytest.mark.parametrize("kind", ["apart", "one block", "both"])
def test_large_clusters_that_fall_apart(spark, kind):
    """Clusters above one block of the real size: taken apart wholly, down to one block, and beside one that stays large."""
    texts = boilerplate("a", 130, 75, 20)
    if kind != "apart":
        # Copies of one of them with a word of their own at the end stay together.
        texts += [[*texts[0], f"x{i}"] for i in range(40)]
    if kind == "both":
        base = [f"b{i}" for i in range(90)]
        texts += [[*base, f"y{i}"] for i in range(150)] + boilerplate("c", 120, 75, 20)
    rows = [(3 * i, " ".join(w), None, None, None) for i, w in enumerate(texts)]
    assert len(rows) > nd.BLOCK_SETS
    got = sorted(map(tuple, nd.near_duplicates(frame(spark, rows)).collect()), key=repr)
    assert got == brute(rows, nd.Likeness())
    gone = {r[0] for r in got if not r[3]}
    assert len(gone) == {"apart": 0, "one block": 40, "both": 40 + 149}[kind]
    assert sorted(r.doc_id for r in nd.keep_one(frame(spark, rows)).collect()) == sorted(r[0] for r in rows if r[0] not in gone)


def test_sets_of_long_rows(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join(f"W{rng.randrange(50)}" for _ in range(n)) for n in (0, 1, 2, 3, 40, 900)] + ["x" * 500, " " * 300, "é" * 200 + " b c"]
    import pyarrow as pa

    from weftgraph.llm import shared

    data, offs = shared.buffers(pa.array(texts, pa.large_string()))
    want = nd.shingle_sets(data, offs, 3)
    monkeypatch.setattr(nd, "_LONG", 64)
    monkeypatch.setattr(nd, "_PIECE", 64)
    got = nd.shingle_sets(data, offs, 3)
    assert all(np.array_equal(a, b) for a, b in zip(want, got))


def test_text_above_a_mebibyte(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**7)}" for _ in range(180_000)]
    rows = [(1, " ".join(words), None, None, None), (2, " ".join(words[:-9]), None, None, None), (3, " ".join(words[:90_000]), None, None, None)]
    assert len(rows[0][1]) > 1 << 20
    assert [(r.doc_id, r.component_id) for r in nd.near_duplicates(frame(spark, rows)).orderBy("doc_id").collect()] == [(1, 1), (2, 1), (3, 3)]


def test_repeated_ids_with_texts_of_their_own(spark):
    rows = [(7, " ".join(f"t{i}w{j}" for j in range(30)), None, None, None) for i in range(30)] * 2
    got = nd.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == 60 and {(r.component_id, r.kept) for r in got} == {(7, True)}


def test_sorted_groups():
    import pyarrow as pa

    from weftgraph.llm import shared

    keys = [1, 1, 2, 3, 3, 3, 3, 3, 3, 4, 5, 5]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 2])], names=["k"]) for i in range(0, 12, 2)]
    assert [(t.column(0).to_pylist(), cut) for t, cut in shared.sorted_groups(iter(batches))] == [([1, 1], False), ([2], False), ([3] * 6, False), ([4], False), ([5, 5], False)]
    got = [(t.column(0).to_pylist(), cut) for t, cut in shared.sorted_groups(iter(batches), 3)]
    assert [x for t, _ in got for x in t] == keys
    assert all(cut == (3 in t) for t, cut in got) and max(len(t) for t, _ in got) <= 4
