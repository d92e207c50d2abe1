"""The pipeline's stages, each on what the one before returned, against brute force."""

import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from fixtures import SCHEMA, clashing, documents, frame
from test_mixing import size
from test_near_dedup import brute as near_brute
from test_quality_rules import brute as rules_brute
from tokenizers import Tokenizer

from weftgraph.llm import mixing, near_dedup, suffix_dedup

NAMES = ["quality rules", "near duplicates", "suffix array", "mixing", "bpe"]


def test_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, held = docs.columns, [tuple(r) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        rows = [tuple(r) for r in out.collect()]
        if name == "quality rules":
            assert sorted(rows) == sorted(r for r in held if rules_brute(r[1])[-1])
        if name == "near duplicates":
            kept = {r[0] for r in near_brute(held, near_dedup.Likeness()) if r[3]}
            assert sorted(rows) == sorted(r for r in held if r[0] in kept)
        if name == "suffix array":
            seen, want = set(), {}
            for r in sorted(held):
                raw = r[1].encode()
                gone = np.zeros(len(raw), bool)
                for i in range(len(raw) - suffix_dedup.LENGTH + 1):
                    w = raw[i : i + suffix_dedup.LENGTH]
                    gone[i : i + suffix_dedup.LENGTH] |= w in seen
                    seen.add(w)
                want[r[0]] = bytes(np.frombuffer(raw, np.uint8)[~gone]).decode(errors="ignore")
            assert {r[0]: r[1] for r in rows} == want and all(r[4] == len(r[1]) for r in rows)
            assert sum(want[r[0]] != r[1] for r in held) > 0
        if name == "mixing":
            counts = {r.doc_id: r.taken for r in mixing.mix_counts(docs).collect()}
            assert {i: n for i, n in counts.items() if n} == {i: sum(size(r[1]) for r in rows if r[0] == i) for i in {r[0] for r in rows if size(r[1])}}
        if name == "bpe":
            library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            text = {r[0]: r[1] for r in held}
            assert len(rows) == len(held) and out.columns == ["doc_id", "ids", "decoded_sha256"]
            sha = {r[0]: hashlib.sha256(r[1].encode()).hexdigest() for r in held}
            assert all(r[2] == sha[r[0]] for r in rows)
            assert all(np.frombuffer(r[1], "<u4").tolist() == library.encode(text[r[0]], add_special_tokens=False).ids for r in rows)
            break
        assert out.columns == columns
        docs, held = spark.createDataFrame(rows, out.schema), rows


def test_run_is_the_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()))


def test_odd_rows(spark, sf):
    """Nulls, empties, repeated rows and columns with the operators' names pass every stage alone and one after another."""
    rows = documents(n=40)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, clashing(spark, rows), sf)
        if name != "bpe":
            assert out.columns == clashing(spark, rows).columns
        got = [(r.doc_id, r.text) for r in out.select("doc_id", "text").collect()] if name != "bpe" else [(r.doc_id,) for r in out.collect()]
        if name in ("near duplicates", "suffix array"):
            assert (None,) == tuple({g[0] for g in got if g[0] is None}) and sum(g[0] is None for g in got) == sum(r[0] is None for r in rows)
        if name in ("suffix array", "bpe"):
            assert len(got) == len(rows)
    docs = clashing(spark, rows)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert {r.doc_id for r in docs.collect()} <= {r[0] for r in rows}


def test_empty_table(spark, sf):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0
    assert frame(spark, documents()[:1]).columns == [c.split()[0] for c in SCHEMA.split(", ")]
