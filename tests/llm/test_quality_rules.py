"""Operator 6 against plain Python."""

import base64
import random
import re
from collections import Counter

import numpy as np
import pytest
import zstandard
from fixtures import SCHEMA, clashing, documents, frame, got
from pyspark.sql import functions as F

from weftgraph.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, bands=q.Bands()):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    raw = text.encode()
    z = zstandard.ZstdCompressor(level=3, write_content_size=False)
    ratio = len(z.compress(raw)) / len(raw) if raw else 1
    at = [*range(0, len(raw) - 4096, 2048), len(raw) - 4096] if len(raw) > 4096 else []
    parts = [len(z.compress(raw[i : i + 4096])) / 4096 for i in at]
    spans = [(m.start(), m.end(), m[0]) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    coded = np.zeros(len(raw), bool)
    for x, y, w in spans:
        coded[x:y] = len(w) >= 4 and re.fullmatch(rb"[0-9a-fA-F]+", w) is not None and 0 < sum(48 <= c <= 57 for c in w) < len(w)
    inside = np.zeros(len(raw), bool)
    for x, y, _ in spans:
        inside[x:y] = True
    hexes = [coded[i : i + 4096].sum() / max(inside[i : i + 4096].sum(), 1) for i in at] + [coded.sum() / max(inside.sum(), 1)]
    low, high = next((b[1], b[2]) for b in reversed(bands.bands) if len(raw) >= b[0])
    kept = not failed and low <= ratio <= high and all(bands.chunk_low <= x <= bands.chunk_high for x in parts) and max(hexes) <= bands.hex_high
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), failed, kept)


def cases():
    return documents() + [(700, "a b c d e a b c d e\n" * 3, None, None, None), (701, "same line here\n" * 40 + "other", None, None, None), (702, "\n\nx\n\nx\n", None, None, None), (703, "\x85  z " * 400, None, None, None), (704, "".join(f"{i * 7919 % 10007} word{i} " for i in range(3000)), None, None, None)]


def test_counts_and_verdicts(spark):
    out = q.quality_rules(clashing(spark, cases())).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    want = sorted(((r[0], *brute(r[1])) for r in cases()), key=lambda r: tuple((x is not None, x) for x in r))
    assert got(out) == want
    assert {r[7] for r in want} == {True, False}


def test_keep_good_keeps_rows_whole(spark):
    want = sorted((r for r in cases() if brute(r[1])[-1]), key=repr)
    assert sorted(map(tuple, q.keep_good(frame(spark, cases())).collect()), key=repr) == want


def test_bands_reject_repetition_and_noise():
    import base64
    import random

    rnd = random.Random(1)
    noise = " ".join(base64.b64encode(rnd.randbytes(9)).decode() for _ in range(900))
    loop = " ".join(f"word{i % 4} x{i % 3}" for i in range(2000))
    syllables = ["the", "re", "in", "ed", "tion", "or", "al", "st", "an", "ly", "be", "ma"]
    prose = " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4))) for _ in range(900))
    import numpy as np

    for text, kept in ((noise, False), (loop, False), (prose, True)):
        raw = np.frombuffer(text.encode(), np.uint8)
        assert bool(q.judge(raw, np.array([0, len(raw)]), q.Bands())["kept"][0]) == kept


def kept(*texts):
    raw = [t.encode() if isinstance(t, str) else t for t in texts]
    out = q.judge(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), q.Bands())
    return out["kept"].tolist()


def junk(kind, size, rnd):
    word = {
        "base64": lambda: base64.b64encode(rnd.randbytes(rnd.choice([6, 9, 12]))).decode(),
        "hex": lambda: rnd.randbytes(rnd.randint(3, 8)).hex(),
        "HEX": lambda: rnd.randbytes(rnd.randint(3, 8)).hex().upper(),
        "ascii": lambda: "".join(chr(rnd.randint(33, 126)) for _ in range(rnd.randint(4, 10))),
    }[kind]
    return " ".join(word() for _ in range(size // 4 + 2)).encode()[:size]


@pytest.mark.parametrize("kind", ["base64", "hex", "HEX", "ascii"])
@pytest.mark.parametrize("size", [200, 300, 500, 700, 1000, 1200, 2000, 3000, 5000, 8191, 20000, 50000])
def test_noise_is_rejected_at_every_length(kind, size):
    rnd = random.Random(f"{kind}{size}")
    assert not any(kept(*[junk(kind, size, rnd) for _ in range(40)]))


@pytest.mark.parametrize("lang", ["de", "en", "es", "fr"])
def test_clean_text_of_each_language_stays(spark, lang):
    """Texts of the language that the contract's counts leave are kept, but for those cut short by the lower limits."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.col("lang") == lang).collect() if r.text]
    data, offs = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *[len(t.encode()) for t in texts]])
    got = q.judge(data, offs, q.Bands())
    lost = [i for i in np.flatnonzero(~got["base_failed"] & ~got["kept"]) if got["ratio"][i] > 0.4]
    assert (~got["base_failed"]).sum() > 50 and not lost


@pytest.mark.parametrize("kind", ["base64", "hex", "ascii"])
@pytest.mark.parametrize("size", [8190, 8191, 8192, 8193, 12287, 12288, 12289, 20000])
def test_a_junk_block_is_found_wherever_it_lies(kind, size):
    rnd = random.Random(size)
    syllables = ["the", "re", "in", "ed", "tion", "or", "al", "st", "an", "ly", "be", "ma"]
    prose = " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4))) for _ in range(9000)).encode()
    block = junk(kind, 4094, rnd)
    rest = size - len(block)
    texts = [prose[:cut] + block + prose[cut:rest] for cut in (0, 1000, rest // 2, rest - 1000, rest)]
    assert all(len(t) == size for t in texts) and not any(kept(*texts))
    assert kept(prose[:size]) == [True]


@pytest.mark.parametrize("size", [4095, 4096, 4097, 5000, 8191, 8192, 12287, 12288])
def test_chunks_cover_every_byte(size):
    spans = [(x, x + 4096) for x in q._chunks(7, 7 + size, 4096)]
    assert bool(spans) == (size > 4096)
    if spans:
        assert spans[0][0] == 7 and spans[-1][1] == 7 + size and all(b[0] <= a[1] for a, b in zip(spans, spans[1:]))


def test_numbers_and_short_words_are_not_hex():
    rnd = random.Random(9)
    syllables = ["the", "re", "in", "ed", "tion", "or", "al", "st", "an", "ly", "be", "ma"]
    words = lambda n: ["".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4))) for _ in range(n)]
    text = " ".join(w for x in words(300) for w in (x, str(rnd.randint(1, 9999)), "a1", "decade"))
    assert kept(text, " ".join(words(60)), " ".join(words(700))) == [True] * 3


def test_empty(spark):
    assert q.quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0
