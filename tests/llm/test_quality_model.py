"""Operator 7: the identity, fitting, held-out accuracy and awkward rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from fixtures import SCHEMA, clashing, documents, frame
from pyspark.sql import functions as F

from weftgraph.llm import quality_model as m
from weftgraph.llm import shared


def test_sum_of_squares_is_all_pairs():
    rng = np.random.default_rng(0)
    model = m.Model(0.3, rng.normal(size=50), rng.normal(size=(50, 4)), None, None, None, 0)
    slots = np.concatenate([rng.choice(50, k, replace=False) for k in (1, 7, 20)])
    values, ranges = rng.normal(size=28), np.array([0, 1, 8, 28])
    want = []
    for a, b in zip(ranges[:-1], ranges[1:]):
        s, x = slots[a:b], values[a:b]
        pairs = sum(model.factors[s[i]] @ model.factors[s[j]] * x[i] * x[j] for i in range(b - a) for j in range(i))
        want.append(0.3 + model.weights[s] @ x + pairs)
    assert np.allclose(m._machine(model, slots, values, ranges), want)


def test_held_out_accuracy_on_labels_it_never_saw(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    # Labels of held-out rows are turned round for fitting: they must not matter.
    spoilt = labels.withColumn("quality", F.when(m.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    out = m.classify(docs, spoilt).join(labels, "doc_id").where("held_out").collect()
    assert len(out) > 500 and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in out)
    assert np.mean([r.predicted == r.quality for r in out]) > 0.97
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in out)


def test_awkward_rows(spark):
    rows = documents()
    labels = spark.createDataFrame([(r[0], i % 2, 0) for i, r in enumerate(rows)] + [(None, 1, 0), (3, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int")
    a = sorted(map(tuple, m.classify(clashing(spark, rows), labels).collect()), key=repr)
    b = sorted(map(tuple, m.classify(frame(spark, rows).repartition(3), labels).collect()), key=repr)
    assert a == b and len(a) == len(rows)
    none = labels.where("false")
    assert {r.score for r in m.classify(frame(spark, rows), none).collect()} == {0.5}
    assert m.classify(spark.createDataFrame([], SCHEMA), labels).count() == 0


def test_fit_uses_interactions():
    rng = np.random.default_rng(1)
    n = 2000
    stats = rng.normal(size=(n, m.STATS))
    labels = ((stats[:, 0] > 0) ^ (stats[:, 1] > 0)).astype(float)
    words = (np.zeros(n, np.int64), np.ones(n), np.arange(n + 1))
    model = m.fit(stats, words, labels, m.Fit(epochs=40))
    raw = m._machine(model, *m._inputs(model, stats, words))
    assert np.mean((raw > 0) == labels) > 0.9


def by_hand(text, word_bits):
    """The statistics and word slots of one text, in plain Python."""
    raw = text.encode()
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    n, size = max(len(words), 1), max(len(raw), 1)
    mask = (1 << 64) - 1

    def hashed(w):
        base = 0x9E3779B97F4A7C15 | 1
        h = sum((b + 1) * pow(base, i, 1 << 64) for i, b in enumerate(w)) + len(w) * 0xD6E8FEB86659FD93 & mask
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & mask
        h = (h ^ h >> 27) * 0x94D049BB133111EB & mask
        return h ^ h >> 31

    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    count = lambda chars: sum(b in chars.encode() for b in raw)
    stats = [
        math.log1p(len(words)),
        sum(len(w.decode()) for w in words) / n,
        count("#*$%&|<>") / n,
        (len(lines) - len(set(lines))) / (1 + raw.count(b"\n")),
        len(repeated) / n,
        sum(65 <= b <= 90 for b in raw) / size,
        sum(48 <= b <= 57 for b in raw) / size,
        sum(b in b" \t\n\x0b\x0c\r" for b in raw) / size,
        raw.count(b"\n") / n,
        count(".,;:!?\"'()-") / n,
        raw.count(b"!") / n,
        raw.count(b"|") / n,
        len(set(words)) / n,
        min(len(zstandard.ZstdCompressor(level=1, write_content_size=False).compress(raw)) / size, 2),
        sum(a == b for a, b in zip(words, words[1:])) / n,
        len(raw) / max(len(text), 1),
        math.log1p(len(text)),
    ]
    slots = Counter(hashed(w) >> 64 - word_bits for w in words)
    norm = math.sqrt(sum(k * k for k in slots.values()))
    return stats, {s: k / norm for s, k in slots.items()}


def test_features_by_hand():
    texts = [r[1] or "" for r in documents()] + ["a a b|b! \n\n a a b|b!\nÜber-GROẞ 12,5 (x)\n" * 3]
    data, offs = shared.buffers(pa.array(texts, pa.large_string()))
    stats, (slots, values, spans) = m.features(data, offs, 10)
    for i, text in enumerate(texts):
        want, words = by_hand(text, 10)
        assert np.allclose(stats[i], want), (i, stats[i] - want)
        got = dict(zip(slots[spans[i] : spans[i + 1]].tolist(), values[spans[i] : spans[i + 1]].tolist()))
        assert got.keys() == words.keys() and all(abs(got[k] - words[k]) < 1e-9 for k in got)


def test_ids_that_repeat_are_one_row_of_the_fit(spark):
    rows = [(1, f"good clean prose number {i} with some words", None, None, None) for i in range(300)] + [(2 * i, "buy | now ! $$$ " * 9, None, None, None) for i in range(1, 60)]
    labels = spark.createDataFrame([(i, int(i == 1), 0) for i in range(130)], "doc_id long, quality int, toxic int")
    out = m.classify(frame(spark, rows), labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
