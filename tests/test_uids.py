"""The dictionary of uids: dense, extended, the same on a retry, left alone by a run that stops."""

import pytest

from weftgraph.operators import uids
from weftgraph.session import shared_path
from weftgraph.sources.versions import Conflict, Versions


def keys(spark, values):
    return spark.createDataFrame([(v,) for v in values], "key string")


def held(spark, path, version=None):
    return {r.key: r.uid for r in uids.dictionary(spark, path, version).collect()}


def test_dense_extended_and_repeated(spark):
    path = shared_path(spark, "uids")
    first = [f"k{i}" for i in range(700)] * 2 + [None]
    one = uids.extend(keys(spark, first).repartition(7), path, bucket_rows=50)
    a = held(spark, path)
    assert sorted(a.values()) == list(range(1, 701)) and set(a) == {k for k in first if k}
    assert uids.extend(keys(spark, first), path) == one and held(spark, path) == a
    two = uids.extend(keys(spark, [f"k{i}" for i in range(350, 1000)]), path, bucket_rows=50)
    b = held(spark, path)
    assert sorted(b.values()) == list(range(1, 1001)) and all(b[k] == a[k] for k in a)
    assert held(spark, path, one) == a and held(spark, path, 0) == {}
    three = uids.compact(spark, path)
    assert (one, two, three) == (1, 2, 3) and held(spark, path) == b and uids.compact(spark, path) == 3
    rows = uids.with_uids(spark.createDataFrame([("k1", 5), ("none", 6), (None, 7)], "key string, x int"), "key", path).collect()
    assert {r.x: r.uid for r in rows} == {5: b["k1"], 6: None, 7: None}


def test_the_same_however_rows_are_split(spark):
    paths = [shared_path(spark, "uids") for _ in range(2)]
    for path, n in zip(paths, (1, 9)):
        uids.extend(keys(spark, [f"x{i}" for i in range(300)]).repartition(n), path, bucket_rows=40)
    assert held(spark, paths[0]) == held(spark, paths[1])


def test_a_run_that_stops_leaves_the_version_before(spark, monkeypatch):
    path = shared_path(spark, "uids")
    uids.extend(keys(spark, ["a", "b"]), path)
    before = held(spark, path)
    with monkeypatch.context() as m:
        m.setattr(Versions, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            uids.extend(keys(spark, ["c"]), path)
    assert held(spark, path) == before
    uids.extend(keys(spark, ["c", "d"]), path)
    assert held(spark, path).keys() == {"a", "b", "c", "d"} and sorted(held(spark, path).values()) == [1, 2, 3, 4]


def test_manifests_that_are_not_whole_and_other_writers(spark):
    path = shared_path(spark, "uids")
    uids.extend(keys(spark, ["a"]), path)
    store = Versions(spark, path)
    out = store._fs.create(store._at("versions/2"), False)
    out.write(bytearray(b'{"tables": {'))
    out.close()
    assert store.latest().number == 1
    assert uids.extend(keys(spark, ["b"]), path) == 3 and held(spark, path) == {"a": 1, "b": 2}
    base = store.read(1)
    with pytest.raises(Conflict):
        store.commit(base, base.tables, base.facts)
    with pytest.raises(KeyError):
        store.at(17)
    store.expire()
    assert store.numbers() == [3] and held(spark, path) == {"a": 1, "b": 2}
