"""Operator 1 against plain Python."""

import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash
from fixtures import SCHEMA, clashing, documents, frame

from weftgraph.llm import fingerprints as f


def term_hash(words):
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), seed=h)
    return h


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    terms = Counter(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else {}
    votes = [0] * 64
    for t, n in terms.items():
        h = term_hash(t)
        for b in range(64):
            votes[b] += n if h >> b & 1 else -n
    return sum(1 << b for b in range(64) if votes[b] > 0)


def brute(rows):
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    prints, out = [simhash(t) for _, t in order], []
    for i, (doc_id, text) in enumerate(order):
        j = (i + 1) % len(order)
        cut = len(text) // 4
        changed = text[: len(text) - cut] + order[j][1][:cut]
        like = lambda a, b: 1 - (a ^ b).bit_count() / 64
        e = simhash(changed)
        near = sum((prints[i] ^ p).bit_count() <= 3 for k, p in enumerate(prints) if re.search(r"[^\x20\x09-\x0D]", order[k][1])) - 1
        asked = doc_id is not None and doc_id % 100 == 0
        out.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), f"{prints[i]:016x}", f"{e:016x}", like(prints[i], e), like(prints[i], prints[j]), max(near, 0) if asked else None))
    return out


@pytest.mark.parametrize("per_range", [1024, 7])
def test_fingerprints(spark, monkeypatch, per_range):
    monkeypatch.setattr(f, "RANGE_ROWS", per_range)
    for rows in (documents(), [r for r in documents() if r[0] is not None], documents()[:1]):
        out = sorted(map(tuple, f.fingerprints(clashing(spark, rows)).collect()), key=repr)
        assert out == sorted(brute(rows), key=repr)


def test_edits_stay_near_and_strangers_far(spark, sf):
    out = f.fingerprints(spark.read.parquet(f"{sf}/documents.parquet")).where("n_chars > 600").collect()
    edited = sorted(r.near_edited for r in out)
    strangers = sorted(r.near_next for r in out)
    assert edited[len(edited) // 4] > strangers[3 * len(strangers) // 4] + 0.1


def test_block_tables_find_every_neighbour(spark):
    rnd = random.Random(5)
    fps = [rnd.getrandbits(64) for _ in range(30)]
    fps += [x ^ sum(1 << b for b in rnd.sample(range(64), k)) for x in fps for k in (0, 1, 2, 3, 4, 5)]
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for radius, blocks in ((3, 6), (3, 4), (1, 3)):
        got = {tuple(r) for r in f.within(df, df, radius, blocks).collect()}
        mask = (1 << 64) - 1
        assert got == {(a, b, d) for a in set(signed) for b in set(signed) if (d := ((a ^ b) & mask).bit_count()) <= radius}


def test_wide_search_finds_every_neighbour(spark):
    rnd = random.Random(6)
    fps = [rnd.getrandbits(64) for _ in range(20)] + [0, (1 << 64) - 1, 1 << 63]
    fps += [x ^ sum(1 << b for b in rnd.sample(range(64), k)) for x in fps for k in (0, 1, 4, 8, 11, 12, 13, 13, 13, 14, 15)]
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    queries, df = (spark.createDataFrame([(x,) for x in rows], "fp long") for rows in (signed[:60], signed))
    mask = (1 << 64) - 1
    for radius, blocks in ((f.NEAR_RADIUS, f.NEAR_BLOCKS), (5, 3)):
        got = [tuple(r) for r in f.within_wide(queries, df, radius, blocks).collect()]
        want = {(a, b, d) for a in set(signed[:60]) for b in set(signed) if (d := ((a ^ b) & mask).bit_count()) <= radius}
        assert set(got) == want and len(got) == len(want)


def test_edited_copies_at_the_required_similarity_are_found(spark):
    """Of copies that share at least four fifths of their terms, nine in ten are near, each under its own doc_id."""
    rnd = random.Random(8)
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows, planted = [], {}
    for i in range(40):
        a = [f"w{rnd.randrange(5000)}" for _ in range(rnd.choice([100, 200, 500]))]
        b = list(a)
        while True:
            c = list(b)
            c[rnd.randrange(len(c))] = "edited"
            if len(shingles(a) & shingles(c)) < 0.8 * len(shingles(a) | shingles(c)):
                break
            b = c
        planted[100 * i] = 100 * i + 1
        rows += [(100 * i, " ".join(a), None, None, None), (100 * i + 1, " ".join(b), None, None, None)]
    out = f.fingerprints(frame(spark, rows), radius=f.NEAR_RADIUS, neighbours=True).collect()
    prints = {r.doc_id: int(r.fingerprint, 16) for r in out}
    for r in out:
        if r.doc_id % 100:
            assert r.near is None and r.n_near is None
            continue
        want = sorted(((prints[r.doc_id] ^ p).bit_count(), i) for i, p in prints.items() if (prints[r.doc_id] ^ p).bit_count() <= 13)
        assert sorted((x.distance, x.first_id) for x in r.near) == want and r.n_near == len(want) - 1
        assert all(int(x.fingerprint, 16) == prints[x.first_id] and x.docs == 1 for x in r.near)
    found = sum(planted[r.doc_id] in {x.first_id for x in r.near} for r in out if r.doc_id in planted)
    assert found >= 36


def test_the_query_returns_neighbours(spark, sf):
    from weftgraph.llm import queries

    out = queries.op1_simhash(spark, sf).collect()
    asked = [r for r in out if r.doc_id % 100 == 0]
    for r in asked:
        near = [o for o in out if (int(o.fingerprint, 16) ^ int(r.fingerprint, 16)).bit_count() <= 13]
        assert r.n_near == len(near) - 1 == sum(x.docs for x in r.near) - 1
        assert {x.fingerprint for x in r.near} == {o.fingerprint for o in near}


def test_empty(spark):
    assert f.fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
    assert f.fingerprints(frame(spark, [(1, None, None, None, None)])).first().fingerprint == "0" * 16
