"""Operator 13: exact counts and base scores by brute force, the filter and its scores against exact ones."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from fixtures import SCHEMA, clashing, documents, frame

from weftgraph.llm import language_model as lm
from weftgraph.llm import queries, shared

END = object()


def words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", text) + [END]


def is_held_out(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 == 1


def brute(rows, order=2):
    """Rows with the score of the model that keeps quantised counts without a filter."""
    learned = [words(r[1]) for r in rows if not is_held_out(r[0])]
    count = Counter(w for d in learned for w in d)
    runs = [Counter() for _ in range(order)]
    for d in learned:
        s = [None, *d]
        for k in range(order):
            runs[k].update(tuple(s[i - k : i + 1]) for i in range(k, len(s)))
    n, v = sum(count.values()), len(count)
    whole = n + 0.5 * (v + 1)
    level = lambda k, run: lm.MEANS[lm.quantised(np.array([runs[k][run]]))[0]]
    out = []
    for doc_id, text, *_ in rows:
        d = words(text)
        s, score = [None, *d], 0.0
        for i in range(1, len(s)):
            p = min(1.0, (level(0, (s[i],)) + 0.5) / whole)
            for k in range(1, order):
                if i >= k:
                    h = level(k - 1, tuple(s[i - k : i]))
                    p = (min(level(k, tuple(s[i - k : i + 1])), h) + lm.PRIOR * p) / (h + lm.PRIOR)
            score += math.log10(p)
        base = sum(math.log10((count[w] + 0.5) / whole) for w in d)
        out.append((doc_id, is_held_out(doc_id), len(d), sum(count[w] > 0 for w in d), n, base, score))
    return out


def key(r):
    return [(x is not None, x) for x in r[:4]] + [round(r[5], 6)]


def held(df, want, tolerance):
    got = sorted((tuple(r) for r in df.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=key)
    want = sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9)
    # The filter errs to higher levels only, and rarely.
    away = [abs(g[6] - w[6]) / w[2] for g, w in zip(got, want)]
    assert max(away) <= tolerance


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = queries.op13_lm_score(spark, sf).cache()
    held(df, brute(rows), 0.3)
    out = [r for r in df.collect() if r.held_out and r.n_tokens > 50]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    df.unpersist()


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("small", [False, True])
def test_awkward_rows(spark, monkeypatch, order, small):
    """small: short pieces, several parts and shards, rare words by the join; the same result."""
    if small:
        for name, value in (("PIECE_BYTES", 200), ("COUNT_BYTES", 300), ("PART_BYTES", 700), ("SHARD_BYTES", 2000), ("FREQUENT", 40), ("SHORT", 4)):
            monkeypatch.setattr(lm, name, value)
    rows = documents() + [(900000 + i, None if i % 3 else "", None, None, None) for i in range(5)]
    rows += [(7, "A common line that repeats " * 40, "en", "s", 1)] * 30
    held(lm.scores(clashing(spark, rows), order), brute(rows, order), 0.4)


def test_shards_change_nothing(spark, monkeypatch):
    rows = documents(3)
    monkeypatch.setattr(lm, "PART_BYTES", 2000)
    once = sorted((tuple(r) for r in lm.scores(frame(spark, rows)).collect()), key=key)
    monkeypatch.setattr(lm, "SHARD_BYTES", 900)
    monkeypatch.setattr(lm, "PIECE_BYTES", 333)
    more = sorted((tuple(r) for r in lm.scores(frame(spark, rows)).collect()), key=key)
    parts, n = lm.trained(frame(spark, rows).selectExpr("false AS held_out", "coalesce(text, '') AS text"), 2)
    assert n > 5 and lm.shards_of(parts, n) > 3
    assert [g[:5] for g in once] == [g[:5] for g in more]
    assert [x for g in more for x in g[5:]] == pytest.approx([x for g in once for x in g[5:]], rel=1e-9)


@pytest.mark.parametrize("rows", [[], [(3, "only held out", "en", "s", 1)], [(None, None, None, None, None)]])
def test_nothing_to_learn_from(spark, rows):
    got = lm.scores(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    if rows and is_held_out(rows[0][0]):
        assert [(r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(0, 0, 0.0, 0.0)]


def test_levels_are_never_too_low_and_rarely_too_high():
    rng = np.random.default_rng(0)
    runs = np.unique(rng.integers(0, 1 << 63, 40_000).astype(np.uint64))
    counts = rng.geometric(0.4, len(runs)) ** 3
    own = lm.filled(runs, counts)
    assert len(own) * 64 <= lm.BITS * lm.quantised(counts).sum() + 64
    one = lm.Shard(1, 1, 0, np.zeros(1, np.int64), np.array([len(own)], np.uint64), own.tobytes())
    level = lm.quantised(counts)
    got = one.levels(runs)
    assert (got >= level).all() and (got > level).mean() < 0.04
    assert (one.levels(rng.integers(0, 1 << 63, 40_000).astype(np.uint64)) > 0).mean() < 0.04


def test_levels_stand_for_counts():
    counts = np.arange(1, 3000)
    means = lm.MEANS[lm.quantised(counts)]
    assert (means[: lm.EXACT - 1] == counts[: lm.EXACT - 1]).all()
    assert (np.abs(means / counts - 1) < lm.STEP - 1).all()
    assert lm.quantised(np.array([0]))[0] == 0 and len(lm.LEVELS) < 256


def test_pieces_of_a_long_text(monkeypatch):
    texts = ["short", "", " ".join(f"w{i}" for i in range(100)), "x" * 300, "tail of it"]
    data, offs = shared.buffers(pa.array(texts, pa.large_string()))
    got, carry = [[] for _ in texts], []
    for lo, part, at, goes_on, continues in lm.pieces(data, offs, 50):
        s = lm.symbols(part, at, goes_on, continues, 2, carry)
        for r, w in zip(s.rows[s.own], s.word[s.own]):
            got[lo + r].append(s.unique[int(w)].as_py().decode())
    assert got == [[*t.split(), ""] for t in texts]


def test_a_text_above_a_piece(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 5000, n)), None, None, None) for i, n in ((0, 900_000), (2, 40), (5, 3))]
    assert len(rows[0][1]) > lm.COUNT_BYTES > lm.PIECE_BYTES
    held(lm.scores(frame(spark, rows)), brute(rows), 0.1)
