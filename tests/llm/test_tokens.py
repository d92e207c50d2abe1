"""Operators 5 and 10 against the library itself."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from fixtures import SCHEMA, clashing, documents, frame, got
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftgraph.llm import bpe, shared, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
CODEC = bpe.codec(PATH)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    return sorted(((r[0], len(x := ids(r[1])), sha(",".join(map(str, x))), sha(LIBRARY.decode(x, skip_special_tokens=False))) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


TEXTS = st.text(st.one_of(st.sampled_from(list("ab's d  \n\t \u0085!?'12éß日\U0001d6fc")), st.characters(exclude_categories=["Cs"])), max_size=120)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_split_at_spaces_is_the_library(text):
    assert np.frombuffer(CODEC.encode([text])[0], "<u4").tolist() == ids(text)


def test_parts_seen_before_are_not_asked_again(monkeypatch):
    """Nor are a text's first part, parts of more than 24 letters, and parts that come in other texts."""
    own = bpe.Codec(PATH)
    texts = ["Größe foo\nfoo the\tfoo 's", "foo Größe", "", " \x00 \x00\x00", "donaudampfschifffahrtsgesellschaft 日本 Größe"]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [ids(t) for t in texts]
    asked = []
    plain = own.plain
    monkeypatch.setattr(own, "plain", lambda some: asked.extend(some) or plain(some))
    more = ["Größe 日本\nfoo the\tfoo", texts[4], *texts[:3]]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(more)] == [ids(t) for t in more]
    assert asked == []


@pytest.mark.parametrize("kept", [40, 1 << 20])
@pytest.mark.parametrize("most", [3, 1 << 15])
def test_parts_that_fall_on_one_row_or_are_forgotten(monkeypatch, kept, most):
    monkeypatch.setattr(bpe, "_SLOT_BITS", 2)
    monkeypatch.setattr(bpe, "_KEPT_IDS", kept)
    monkeypatch.setattr(bpe, "_MOST_PARTS", most)
    own, rnd = bpe.Codec(PATH), random.Random(5)
    words = ["", "a", "ab", "'s", "\x00", "\x00\x00", "größer", "x" * 14, "x" * 15, "x" * 16, "日本語日本語日本語", "y" * 60, "a\tb", "<|endoftext|>", "1234567", "12345678", "123456789"]
    for _ in range(40):
        texts = ["".join(rnd.choice([" ", "\n"]) + rnd.choice(words) for _ in range(rnd.randrange(9)))[rnd.randrange(2) :] for _ in range(7)]
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [ids(t) for t in texts]
    assert len(own._ids) <= 4 * kept + 1000


@settings(max_examples=400, deadline=None)
@given(TEXTS, TEXTS)
def test_join_is_the_library(a, b):
    left, right = (np.array(ids(t), "<u4") for t in (a, b))
    assert CODEC.join(left, right).tolist() == ids(a + b)


@pytest.mark.parametrize("unit", ["a", "ab", " ", "the", "é", "日本", "\n ", "'s", "1", "-=", " x", "a  b\n", "ſ'll"])
def test_join_inside_long_runs(unit):
    rnd = random.Random(unit)
    text = unit * 1500
    for _ in range(6):
        cut = rnd.randrange(len(text))
        left, right = (np.array(ids(t), "<u4") for t in (text[:cut], text[cut:]))
        assert CODEC.join(left, right).tolist() == ids(text)


def test_join_random_letters():
    rnd = random.Random(3)
    for _ in range(60):
        text = "".join(rnd.choice("etaoinshrdlu' .\n") for _ in range(800))
        cut = rnd.randrange(1, 799)
        left, right = (np.array(ids(t), "<u4") for t in (text[:cut], text[cut:]))
        assert CODEC.join(left, right).tolist() == ids(text)


def test_encode_rows_and_trees(spark):
    rows = documents() + [(900, "<|endoftext|> in a text " * 9, None, None, None)]
    for leaf in (16_384, 37):
        out = bpe.digests(bpe.encode(clashing(spark, rows), PATH, leaf_chars=leaf), PATH)
        assert got(out) == brute(rows)
        assert got(bpe.encode(clashing(spark, rows), PATH, leaf_chars=leaf, digest=True)) == brute(rows)


@pytest.mark.parametrize("piece", [1 << 20, 7])
def test_leaf_ends_count_code_points(monkeypatch, piece):
    monkeypatch.setattr(shared, "PIECE_BYTES", piece)
    text = "aé日𝛼 " * 40 + "x"
    ends = bpe.leaf_ends(np.frombuffer(text.encode(), np.uint8), 9)
    raw = text.encode()
    assert [raw[a:b].decode() for a, b in zip([0, *ends], ends)] == [text[i : i + 9] for i in range(0, len(text), 9)]
    assert bpe.leaf_ends(np.zeros(0, np.uint8), 9) == []


def test_text_above_a_mebibyte(spark, tmp_path):
    rnd = random.Random(8)
    long = "".join(rnd.choice(["the ", "größe ", "x" * 50, "\n", "日本"]) for _ in range(120_000))
    assert len(long) > 1 << 20
    rows = [(1, long, "en", "s", 1), (2, "short", "en", "s", 1), (1, long, "en", "s", 1)]
    assert got(bpe.encode(frame(spark, rows), PATH, digest=True)) == brute(rows)
    token_files.write_token_files(frame(spark, rows), str(tmp_path / "t"), PATH, 2)
    want = zlib.crc32(np.array([*ids(long), 2], "<u4").tobytes())
    assert [r.ids_crc32 for r in token_files.digests(spark, str(tmp_path / "t")).orderBy("start").collect()][:2] == [want, want]


def test_decode(spark):
    rows = [r for r in documents() if r[0] is not None]
    out = bpe.decode(bpe.encode(frame(spark, rows), PATH), PATH)
    assert got(out) == sorted((r[0], r[1] or "") for r in rows)


def test_token_files(spark, tmp_path):
    rows = documents()
    token_files.write_token_files(clashing(spark, rows), str(tmp_path / "t"), PATH, 2)
    found = token_files.digests(spark, str(tmp_path / "t")).collect()
    start, want = 0, []
    for doc_id, text in sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode())):
        x = [*ids(text), 2]
        want.append((doc_id, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    assert sorted(map(tuple, found), key=lambda r: r[1]) == want


def test_an_id_on_a_third_of_all_rows_is_dealt_out(spark, tmp_path):
    """Rows of one id, and rows without one, go to several tasks by their texts, and are in order all the same."""
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["ein", "größer", "text", "日本", "b"]) for _ in range(12)) for _ in range(600)]
    rows = [((7, None, i)[i % 3], x, "en", "s", 1) for i, x in enumerate(texts)]
    wanted = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "12"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        token_files.write_token_files(frame(spark, rows), str(tmp_path / "t"), PATH, 2)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = [token_files.Reader(p.read_bytes()) for p in (tmp_path / "t").glob("part-*") if p.stat().st_size]
    for doc_id in (7, None):
        held = [sum(d == doc_id for d, _, _ in f.documents()) for f in files]
        assert sum(held) == 200 and max(held) <= 75
    start, want = 0, []
    for doc_id, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode())):
        x = [*ids(text), 2]
        want.append((doc_id, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    assert sorted(map(tuple, token_files.digests(spark, str(tmp_path / "t")).collect()), key=lambda r: r[1]) == want


def test_pick_reads_the_documents_asked_for(spark, tmp_path):
    rows = documents()
    token_files.write_token_files(frame(spark, rows), str(tmp_path / "t"), PATH, 2)
    asked = [(3,), (6,), (6,), (100500,), (77777,), (None,)]
    found = token_files.pick(spark, str(tmp_path / "t"), spark.createDataFrame(asked, "doc_id long")).collect()
    want = sorted((r[0], np.array([*ids(r[1]), 2], "<u4").tobytes()) for r in rows if r[0] in (3, 6, 100500))
    assert sorted((r.doc_id, bytes(r.ids)) for r in found) == want and all(r.n_tokens * 4 == len(r.ids) for r in found)


def test_round_trip(spark):
    rows = documents()
    out = bpe.round_trip(bpe.encode(clashing(spark, rows), PATH, leaf_chars=50), PATH)
    assert sorted(((r.doc_id, bytes(r.ids), r.decoded_sha256) for r in out.collect()), key=repr) == sorted(((r[0], np.array(ids(r[1]), "<u4").tobytes(), sha(r[1] or "")) for r in rows), key=repr)


def test_any_reader_unpacks_a_file_and_ours_only_what_is_asked(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_BYTES", 64)
    file = token_files._File(3)
    parts = {i: np.arange(i, dtype="<u4").tobytes() for i in range(1, 60)}
    for i, x in parts.items():
        file.add(i, x)
    content = file.image(7, 0) + token_files.SEEKABLE_MAGIC.to_bytes(4, "little")
    reader = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True)
    assert reader.read().startswith(b"".join(parts.values()))
    opened = []
    ours = token_files.Reader(content)
    frame_of = ours.frame
    ours.frame = lambda k: opened.append(k) or frame_of(k)
    assert [(d, x) for d, _, x in ours.documents({5, 40})] == [(5, parts[5]), (40, parts[40])]
    assert len(opened) == 2
    broken = bytearray(content)
    broken[int(ours.starts[opened[0]]) + 8] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(token_files.Reader(bytes(broken)).documents())


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert bpe.digests(bpe.encode(none, PATH), PATH).count() == 0
    token_files.write_token_files(none, str(tmp_path / "t"), PATH, 2)
    assert token_files.read_token_files(spark, str(tmp_path / "t")).count() == 0
    assert shared.checkpoint_root(spark)
