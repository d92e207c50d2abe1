"""Operator 8 against plain sums."""

import re
from collections import Counter

import public_tokenizers
import pytest
from fixtures import SCHEMA, clashing, documents, frame
from tokenizers import Tokenizer

from weftgraph.llm import token_rollup as t


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def bytes4(text):
    return (len((text or "").encode()) + 3) // 4


def totals(store):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in store.totals().collect()}


def test_corpus_rollup(spark, tmp_path):
    rows = documents()
    labels = [(r[0], i % 3 == 0, i % 5 == 0) for i, r in enumerate(rows[:40])] + [(None, 1, 1), (3, None, None)]
    marks = {}
    for i, q, x in labels:
        marks[i] = (max(marks.get(i, (0, 0))[0], int(q or 0)), max(marks.get(i, (0, 0))[1], int(x or 0)))
    docs, tokens = Counter(), Counter()
    for i, text, lang, source, _ in rows:
        q, x = marks.get(i, (0, 0)) if i is not None else (0, 0)
        if x:
            continue
        key = (source, lang, "bytes4-1" if q else "words-1")
        docs[key] += 1
        tokens[key] += bytes4(text) if q else words(text)
    df = spark.createDataFrame([(i, None if q is None else int(q), None if x is None else int(x)) for i, q, x in labels], "doc_id long, quality int, toxic int")
    out = t.corpus_rollup(clashing(spark, rows), df, str(tmp_path / "r")).collect()
    assert {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in out} == {k: (docs[k], tokens[k]) for k in docs}


def test_batches_count_once_also_when_compacted(spark, tmp_path):
    rows = t.counted(frame(spark, documents()))
    store = t.Rollup(spark, str(tmp_path / "r"))
    assert store.commit("b1", t.inserts(rows, "words-1"))
    one = totals(store)
    assert not store.commit("b1", t.inserts(rows, "words-1")) and totals(store) == one
    assert store.compact() and store.compact()
    assert not store.commit("b1", t.inserts(rows, "words-1")) and totals(store) == one
    assert store.commit("b2", t.deletes(rows, "words-1")) and totals(store) == {}
    store.clean()
    assert totals(store) == {} and store.compact() and totals(store) == {}
    with pytest.raises(ValueError):
        store.commit("../x", rows)


def test_markers_are_folded_and_names_stay_taken(spark, tmp_path, monkeypatch):
    """After compact and clean there are few files, the driver opens no folded marker, and a batch still counts once."""
    rows = t.counted(frame(spark, documents()))
    store = t.Rollup(spark, str(tmp_path / "r"))
    names = [f"_b-{i}" for i in range(6)]
    assert all(store.commit(n, t.inserts(rows, "words-1")) for n in names)
    one = totals(store)
    assert store.compact() and store.commit("later", t.deletes(rows, "words-1"))
    store.clean()
    files = lambda kind: sorted(p.name for p in (tmp_path / "r" / kind).iterdir() if not p.name.startswith("."))
    assert files("commits") == ["batch-later"] and files("sums") == ["1"] and len(files("data")) == 2 and len(files("names")) == 1
    opened, marker = [], t.Rollup._marker
    monkeypatch.setattr(t.Rollup, "_marker", lambda self, name: opened.append(name) or marker(self, name))
    left = totals(store)
    assert opened == ["sums/1"]
    assert left == {k: (n - n // 6, x - x // 6) for k, (n, x) in one.items()}
    again = t.Rollup(spark, str(tmp_path / "r"))
    assert not any(again.commit(n, t.inserts(rows, "words-1")) for n in [*names, "later"])
    assert again.compact()
    again.clean()
    assert totals(again) == left and files("commits") == [] and files("sums") == ["2"]
    assert not any(store.commit(n, t.inserts(rows, "words-1")) for n in [*names, "later"])


def test_two_writers_of_one_batch(spark, tmp_path, monkeypatch):
    rows = t.counted(frame(spark, documents()))
    a, b = (t.Rollup(spark, str(tmp_path / "r")) for _ in range(2))
    written = b._written

    def overtaken(changes):
        assert a.commit("b1", t.inserts(rows, "words-1"))
        return written(changes)

    monkeypatch.setattr(b, "_written", overtaken)
    assert not b.commit("b1", t.inserts(rows, "words-1"))
    assert totals(b) == totals(a) != {}


def test_two_that_compact_at_once(spark, tmp_path, monkeypatch):
    rows = t.counted(frame(spark, documents()))
    a, b = (t.Rollup(spark, str(tmp_path / "r")) for _ in range(2))
    assert a.commit("b1", t.inserts(rows, "words-1"))
    one, written = totals(a), b._written

    def overtaken(changes):
        assert a.compact() and a.commit("b2", t.inserts(rows, "bytes4-1"))
        return written(changes)

    monkeypatch.setattr(b, "_written", overtaken)
    assert not b.compact()
    assert totals(b).items() > one.items() and totals(a) == totals(b)


class Lost(Exception):
    pass


@pytest.mark.parametrize("act", ["commit", "compact"])
@pytest.mark.parametrize("step", ["before", "written", "created"])
def test_a_driver_lost_between_any_two_steps(spark, tmp_path, monkeypatch, act, step):
    """What was there stays, and the same call by the next driver does the whole work once."""
    rows = t.counted(frame(spark, documents()))
    want = totals_of(spark, tmp_path / "w", [t.inserts(rows, "words-1"), t.revisions(rows, "words-1", "bytes4-1")])
    store = t.Rollup(spark, str(tmp_path / "r"))
    assert store.commit("b1", t.inserts(rows, "words-1"))
    before = totals(store)
    if act == "compact":
        assert store.commit("b2", t.revisions(rows, "words-1", "bytes4-1"))
        before = want
    run = (lambda s: s.commit("b2", t.revisions(rows, "words-1", "bytes4-1"))) if act == "commit" else (lambda s: s.compact())
    lost = t.Rollup(spark, str(tmp_path / "r"))

    def dies(*_):
        if step == "created":
            lost._fs.create(lost._path(_[0]), False).close()
        raise Lost

    monkeypatch.setattr(lost, "_written" if step == "before" else "_marked", dies)
    with pytest.raises(Lost):
        run(lost)
    assert totals(store) == before
    assert run(store) and totals(store) == want
    assert not store.commit("b1", t.inserts(rows, "words-1")) and not store.commit("b2", t.inserts(rows, "words-1"))
    assert store.compact()
    assert totals(store) == want


def totals_of(spark, path, batches):
    store = t.Rollup(spark, str(path))
    for i, b in enumerate(batches):
        store.commit(f"b{i}", b)
    return totals(store)


def test_revision_is_a_delete_and_an_insert(spark, tmp_path):
    rows = t.counted(frame(spark, documents()))
    a, b = (t.Rollup(spark, str(tmp_path / n)) for n in "ab")
    a.commit("1", t.inserts(rows, "words-1"))
    a.commit("2", t.revisions(rows, "words-1", "bytes4-1"))
    b.commit("1", t.inserts(rows, "bytes4-1"))
    assert totals(a) == totals(b)


def test_the_tokenizer_itself_counts(spark, tmp_path):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["x = {'a': [1, 2]}; #!/%$" * 9, "日本語のテキスト" * 50, "a" * 3000, "  two  spaces \n\n", "𝛼β ≠ 1"]
    rows = documents() + [(900 + i, x, "en", "s1", len(x)) for i, x in enumerate(odd)]
    bpe = lambda text: len(library.encode(text or "", add_special_tokens=False).ids)
    out = t.counted(clashing(spark, rows), ("byte_bpe_50k", "words-1", "bytes4-1")).collect()
    want = Counter((r[0], r[3], r[2], bpe(r[1]), words(r[1]), bytes4(r[1])) for r in rows)
    assert Counter((r.doc_id, r.source, r.lang, r.counts["byte_bpe_50k"], r.counts["words-1"], r.counts["bytes4-1"]) for r in out) == want
    labels = [(r[0], i % 3 == 0, i % 5 == 0) for i, r in enumerate(rows[:40])]
    marks = {}
    for i, _, x in labels:
        marks[i] = (marks.get(i, False) or x) and i is not None
    docs, tokens = Counter(), Counter()
    for i, text, lang, source, _ in rows:
        if not marks.get(i, False):
            docs[source, lang, "byte_bpe_50k"] += 1
            tokens[source, lang, "byte_bpe_50k"] += bpe(text)
    df = spark.createDataFrame([(i, int(q), int(x)) for i, q, x in labels], "doc_id long, quality int, toxic int")
    got = t.bpe_rollup(clashing(spark, rows), df, str(tmp_path / "r")).collect()
    assert {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in got} == {k: (docs[k], tokens[k]) for k in docs}


def test_empty(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert t.corpus_rollup(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int"), str(tmp_path / "r")).count() == 0
