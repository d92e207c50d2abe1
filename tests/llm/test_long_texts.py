"""Texts above a mebibyte beside short ones, for the operators whose own tests have none."""

import hashlib
import random

import public_tokenizers
import pytest
from fixtures import frame
from test_fingerprints import simhash
from test_mixing import size
from test_quality_rules import brute as rules_brute
from tokenizers import Tokenizer

from weftgraph.llm import fingerprints, mixing, quality_model, quality_rules, token_rollup, url_filter


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(12)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rnd.randint(2, 9))) for _ in range(5000)]
    long = " ".join(rnd.choice(words) + rnd.choice(["", "", ".", ",\n"]) for _ in range(200_000))
    assert len(long) > 1 << 20
    return [(1, long, "en", "a", len(long)), (2, "x" * (1 << 20) + " y", "en", "a", 1), (3, "short text of a few words for the rest", "en", "b", 9)]


def test_fingerprints(spark, rows):
    got = {r.doc_id: r for r in fingerprints.fingerprints(frame(spark, rows)).collect()}
    for i, (doc_id, text, *_) in enumerate(rows):
        follow = rows[(i + 1) % len(rows)][1]
        cut = len(text) // 4
        changed = text[: len(text) - cut] + follow[:cut]
        assert got[doc_id].n_chars == len(text) and got[doc_id].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert (got[doc_id].fingerprint, got[doc_id].edited_fingerprint) == (f"{simhash(text):016x}", f"{simhash(changed):016x}")


def test_mix(spark, rows):
    assert {r.doc_id: r.size for r in mixing.mix_counts(frame(spark, rows)).collect()} == {r[0]: size(r[1]) for r in rows}


def test_quality_rules(spark, rows):
    got = {r.doc_id: tuple(r) for r in quality_rules.quality_rules(frame(spark, rows)).collect()}
    assert {i: r[1:8] for i, r in got.items()} == {r[0]: tuple(rules_brute(r[1])) for r in rows}


def test_quality_model(spark, rows):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in quality_model.classify(frame(spark, rows), labels).collect())


def test_token_rollup(spark, rows):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r.counts for r in token_rollup.counted(frame(spark, rows), ("byte_bpe_50k", "words-1", "bytes4-1")).collect()}
    for doc_id, text, *_ in rows:
        assert got[doc_id] == {"byte_bpe_50k": len(library.encode(text, add_special_tokens=False).ids), "words-1": size(text), "bytes4-1": (len(text.encode()) + 3) // 4}


def test_urls(spark):
    path = "/en/" + "p" * (1 << 20)
    urls = [(1, f"https://a.com{path}?q"), (2, "https://" + "h" * (1 << 20) + ".org/es/"), (3, "http://b.com/fr/")]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(urls, "page_id long, url string")).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.com", path, "com/en/", "block")
    assert (got[2].rule, got[2].verdict, got[3].rule, got[3].verdict) == ("org/es/", "block", None, "allow")
