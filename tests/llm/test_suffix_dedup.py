"""Operator 9 against a dictionary of all 100-byte strings."""

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from fixtures import SCHEMA, clashing, documents, frame
from pyspark.sql import functions as F

from weftgraph.llm import suffix_dedup as s

L = s.LENGTH


def brute(rows, spark):
    """Rows by (id, text hash); the same id and text is one document."""
    tie = {r.t: r.h for r in spark.createDataFrame([(r[1] or "",) for r in rows], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    unique = len({r[0] for r in rows}) == len(rows)
    docs = sorted({(r[0] is not None, r[0] or 0, 0 if unique else tie[r[1] or ""], r[1] or "") for r in rows})
    seen, out = {}, {}
    for doc in docs:
        raw = doc[3].encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - L + 1):
            if seen.setdefault(raw[i : i + L], (doc, i)) != (doc, i):
                gone[i : i + L] = True
        runs = sum(1 for i in range(len(raw)) if gone[i] and (i == 0 or not gone[i - 1]))
        left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out[doc[0], doc[1], doc[3]] = (len(raw), int(gone.sum()), runs, hashlib.sha256(left).hexdigest())
    return sorted(((r[0], *out[r[0] is not None, r[0] or 0, r[1] or ""]) for r in rows), key=repr)


def passages(seed=0, n=60, repeats=True):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(2, 7)))
    shared = [" ".join(word() for _ in range(k)) for k in (14, 18, 25, 40, 60)] + ["x" * 150, "ab" * 90, "longline-" + "z" * 95]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randint(0, 6)):
            p = rnd.choice(shared)
            a = rnd.randrange(len(p))
            parts.append(rnd.choice([p, p[a:], p[:a], " ".join(word() for _ in range(rnd.randint(1, 30)))]))
        rows.append((i, rnd.choice(["", " ", "\n"]).join(parts), "en", "s", 1))
    rows += [(n + 1, rows[5][1], "en", "s", 1), (n + 2, rows[5][1] + "!", "en", "s", 1), (n + 3, "q" * 99, "en", "s", 1), (n + 4, "q" * 99, "en", "s", 1), (n + 5, "q" * 100, "en", "s", 1), (n + 6, "q" * 101, "en", "s", 1)]
    return rows + (documents(n=20) + [rows[3], (None, rows[4][1], "en", "s", 1)] if repeats else [])


@pytest.mark.parametrize("most,repeats", [(20_000, True), (20_000, False), (3, True), (3, False)])
def test_dedup(spark, monkeypatch, most, repeats):
    monkeypatch.setattr(s, "GROUP_ROWS", most)
    monkeypatch.setattr(s, "SORT_ROWS", most)
    for seed in (0, 1):
        rows = passages(seed, repeats=repeats)
        got = sorted(map(tuple, s.dedup(clashing(spark, rows).repartition(5)).collect()), key=repr)
        assert got == brute(rows, spark)


@pytest.mark.parametrize("key_bits,context_bits,most", [(-1, 1, 20_000), (7, -1, 20_000), (3, 0, 20_000), (3, 0, 40)])
def test_colliding_hashes_remove_nothing_else(spark, monkeypatch, key_bits, context_bits, most):
    """Anchors and contexts that share hashes: what is removed is told from bytes."""
    monkeypatch.setattr(s, "KEY_BITS", key_bits)
    monkeypatch.setattr(s, "CONTEXT_BITS", context_bits)
    monkeypatch.setattr(s, "GROUP_ROWS", most)
    monkeypatch.setattr(s, "SORT_ROWS", most)
    rows = passages(5, n=25, repeats=False)
    got = sorted(map(tuple, s.dedup(frame(spark, rows).repartition(3)).collect()), key=repr)
    assert got == brute(rows, spark)


def test_claims_that_continue_each_other(spark):
    rows = [(1, 0, 9, 0, 50, 0, 120), (1, 0, 9, 0, 50, 30, 160), (1, 0, 9, 0, 50, 161, 300), (1, 0, 9, 0, 51, 0, 120), (1, 0, 8, 0, 50, 120, 240), (2, 0, 9, 0, 50, 100, 240)]
    names = ["doc", "tie", "src", "src_tie", "shift", "start", "stop"]
    got = sorted(map(tuple, s._joined_claims(spark.createDataFrame(rows * 1, names)).collect()))
    assert got == sorted([(1, 0, 9, 0, 50, 0, 160), *rows[2:]])


def test_long_texts_in_segments(spark):
    rnd = random.Random(4)
    block = "".join(rnd.choice("abcdefgh ") for _ in range(300_000))
    rows = [(1, block + "-" + block[:250_000] + "+" + block[100_000:], None, None, None), (2, "?" + block[5:299_000], None, None, None)]
    got = s.dedup(frame(spark, rows)).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans) for r in got] == [(750_002, 450_000, 2), (298_996, 298_995, 1)]


def test_every_window_has_an_anchor_of_its_own():
    rnd = np.random.default_rng(0)
    data = np.concatenate((rnd.integers(97, 100, 3000), np.full(500, 97), np.tile([97, 98, 99], 200))).astype(np.uint8)
    offs = np.array([0, 50, 149, 250, 2000, len(data)])
    a = s.anchors(data, offs)
    held = sorted(w for x, y in zip(a["first"], a["last"]) for w in range(x, y + 1))
    assert held == [w for i in range(5) for w in range(offs[i], offs[i + 1] - L + 1)]
    assert ((a["at"] >= a["last"]) & (a["at"] + s.GRAM <= a["first"] + L)).all()
    key = {}
    for x, y, at, k in zip(a["first"], a["last"], a["at"], a["key"]):
        for w in range(x, y + 1):
            assert key.setdefault(data[w : w + L].tobytes(), (at - w, k)) == (at - w, k)


def test_mergesort_is_the_suffix_order():
    rnd = random.Random(7)
    items = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 40))) for _ in range(300)] + [b"a" * k for k in range(1, 30)]
    group = np.sort(np.array([rnd.randrange(9) for _ in items]))
    data = np.frombuffer(b"".join(items), np.uint8)
    offs = np.concatenate(([0], np.cumsum([len(i) for i in items])))
    order = s.Suffixes(data, offs[:-1], offs[1:], 0x9E3779B97F4A7C15).order(group).tolist()
    assert order == sorted(range(len(items)), key=lambda i: (group[i], items[i], i))


def test_without_repeats_keeps_columns(spark):
    rows = passages(3)
    df = clashing(spark, rows)
    out = s.without_repeats(df)
    assert out.columns == df.columns and out.count() == len(rows)
    want = {(r[0], r[4]) for r in brute(rows, spark)}
    for r in out.collect():
        assert r.n_chars == (None if r.text is None else len(r.text))
        assert r.text is None or "�" not in r.text
    ascii_only = {i for i, t, *_ in rows if t and t.isascii()}
    got = {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in out.collect() if r.doc_id in ascii_only}
    assert got <= want and len(got) >= len(ascii_only)


def test_empty(spark):
    assert s.dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    assert s.dedup(frame(spark, [(1, None, None, None, None)])).first()[1:4] == (0, 0, 0)


def test_workers_hold_little(monkeypatch):
    """Anchors of a large batch are found in bounded pieces; what stays in a worker is as long as a piece."""
    monkeypatch.setattr(s.shared, "_POWERS", {})
    rnd = np.random.default_rng(1)
    batch = pa.RecordBatch.from_arrays([pa.array([rnd.integers(97, 123, 2000, np.uint8).tobytes().decode() for _ in range(2000)])], names=["text"])
    tracemalloc.start()
    for _ in s._anchors_of(batch, 0):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20 and sum(x.nbytes for x in s.shared._POWERS.values()) < 8 << 20, peak
