"""Keys, uids that clash, sessions in any order and in order of arrival."""

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import assemble, identity
from weftgraph.schema import endpoint_schema
from weftgraph.streaming import arrival
from weftgraph.streaming.arrival import Sessions, Timeline, attributed


def test_keys_are_unambiguous(spark):
    rows = [("ab", "c", "d"), ("a", "bc", "d"), ("", "abc", "d"), (None, "abc", "d"), ("-", "abc", "d"), ("a", "b\x1fc", "d"), ("a\x1fb", "c", "d")]
    df = spark.createDataFrame(rows, "t string, x string, y string")
    keys = [r[0] for r in df.select(identity.static_key(F.col("t"), F.col("x"), [F.col("y")])).collect()]
    assert len(set(keys)) == len(rows)
    assert df.select(identity.static_key(F.col("t"), F.col("x"), [F.lit(None).cast("string")])).first()[0] is None


def nodes(spark, n=40):
    rows = [("t", i, f"{i}:a", "Asset", {"asset_id": f"h{i % 10}"}, {}) for i in range(n)] + [("t", i, f"{i}:p", "Process", {"asset_id": "h"}, {"process_id": i % 5, "last_seen_timestamp": 1000 * i + 1}) for i in range(n)]
    rows += [("t", 900, "900:p", "Process", {"asset_id": "h"}, {"process_id": 1}), ("t", 901, "901:x", "Unknown", {}, {}), ("t", 902, "902:a", "Asset", {}, {})]
    return spark.createDataFrame(rows, "tenant_id string, event_id long, node_key string, node_type string, strings map<string,string>, numbers map<string,long>")


def test_one_uid_for_each_entity(spark):
    good, bad = identity.identify_nodes(nodes(spark), endpoint_schema())
    assert {(r.node_key, r.reason) for r in bad.collect()} == {("900:p", "no time"), ("901:x", "missing key"), ("902:a", "missing key")}
    found = {}
    for r in good.collect():
        found.setdefault((r.node_type, r.key, r.session_no), set()).add(r.uid)
    assert all(len(u) == 1 and 0 not in u for u in found.values()) and len({next(iter(u)) for u in found.values()}) == len(found) == 15


def test_entities_that_share_a_uid_are_quarantined(spark, monkeypatch):
    monkeypatch.setattr(identity, "uid_of", lambda key: F.pmod(F.xxhash64(key), F.lit(11)) + 1)
    good, bad = identity.identify_nodes(nodes(spark), endpoint_schema())
    by_uid = {}
    for r in good.collect():
        by_uid.setdefault(r.uid, set()).add((r.key, r.session_no))
    assert all(len(x) == 1 for x in by_uid.values())
    assert "uid clash" in {r.reason for r in bad.collect()}
    assert good.count() + bad.count() == nodes(spark).count()


def test_keys_of_many_types_are_one_expression_worked_out_once(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(identity._keyed(nodes(spark), endpoint_schema()).where("reason is null")).count("md5(") == 1
    good, _ = identity.identify_nodes(nodes(spark), endpoint_schema())
    assert "md5(" not in plan(good)


def canonical(rows):
    """Sessions of (t, created) by the rule over all rows in order of (bucket, creation first)."""
    out, number, last = {}, 0, None
    for t, created, i in sorted((t - t % 100, not c, i) for i, (t, c) in enumerate(rows)):
        c = not created
        if last is None or (c and last != (t, True)):
            number += 1
        last = (t, c)
        out[i] = number
    return out


def parted(numbers):
    groups = {}
    for i, n in numbers.items():
        groups.setdefault(n, set()).add(i)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("seed", range(30))
def test_arrival_in_order_of_time_is_canonical(seed):
    rnd = random.Random(seed)
    rows = [(rnd.randrange(0, 3000), rnd.random() < 0.3) for _ in range(25)]
    own, got = Sessions(), {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] - rows[i][0] % 100, not rows[i][1], i)):
        got[i] = own.place(*rows[i])
    assert parted(got) == parted(canonical(rows))


def test_late_rows_move_guessed_sessions():
    s = Sessions()
    assert s.place(5000, False) == 1
    assert s.place(3000, False) == 1  # moved back
    assert s.place(2000, True) == 1  # taken over by the creation
    assert s.place(1500, False) == 2  # before a known start: guessed anew
    assert s.place(1000, True) == 2
    assert s.place(1005, True) == 2  # the same bucket
    assert s.place(9000, True) == 3 and s.place(9500, False) == 3 and s.place(8000, False) == 1


class Map:
    """A state store's map, that counts what is read."""

    def __init__(self):
        self.rows, self.reads = {}, 0

    def containsKey(self, key):
        return key in self.rows

    def getValue(self, key):
        self.reads += 1
        return self.rows[key]

    def updateValue(self, key, value):
        self.rows[key] = value

    def removeKey(self, key):
        del self.rows[key]


class Value:
    def __init__(self):
        self.row = None

    def exists(self):
        return self.row is not None

    def get(self):
        return self.row

    def update(self, row):
        self.row = row


@pytest.mark.parametrize("seed", range(12))
def test_slices_are_the_list(monkeypatch, seed):
    """The rule over slices, saved and read again every few rows, gives what it gives over one list."""
    monkeypatch.setattr(arrival, "SLICE_MS", 700)
    monkeypatch.setattr(arrival, "BLOCK_SLICES", 16)
    rnd = random.Random(seed)
    plain, state = Sessions(), (Map(), Map(), Value())
    own = Timeline(*state)
    for i in range(300):
        if i % 7 == 0:
            own.saved()
            own = Timeline(*state)
        t, created = rnd.randrange(-3000, 40_000), rnd.random() < 0.3
        assert own.place(t, created) == plain.place(t, created)
    own.saved()
    assert sorted(s for rows in state[0].rows.values() for s in rows[0]) == [r[0] for r in plain.rows]


def test_a_row_reads_a_few_slices(monkeypatch):
    state = (Map(), Map(), Value())
    own = Timeline(*state)
    for i in range(5000):
        own.place(i * 10 * arrival.SLICE_MS, True)
    own.saved()
    assert len(state[0].rows) == 5000
    for m in state[:2]:
        m.reads = 0
    own = Timeline(*state)
    assert own.place(777 * 10 * arrival.SLICE_MS + 5 * arrival.SLICE_MS, False) == 778
    assert state[0].reads <= 2 and state[1].reads <= 2


def test_stream_in_order_of_arrival(spark, tmp_path):
    """The state goes on from batch to batch, and a query that starts again does not count a batch twice."""
    rnd = random.Random(1)
    rows = [(rnd.randrange(4), rnd.randrange(0, 5000), rnd.random() < 0.3, i) for i in range(120)]
    folder, out = tmp_path / "in", tmp_path / "out"
    models, want = {}, {}
    for part in range(3):
        own = rows[40 * part : 40 * part + 40]
        spark.createDataFrame(own, "key long, t long, created boolean, arrival long").coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema("key long, t long, created boolean, arrival long").parquet(str(folder))
        attributed(stream).writeStream.outputMode("append").format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
        for key, t, created, i in own:
            want[i] = models.setdefault(key, Sessions()).place(t, created)
    got = {r.arrival: r.session_no for r in spark.read.parquet(str(out)).collect()}
    assert got == want


def test_merged_properties_are_worked_out_once_for_all_types(spark):
    good, _ = identity.identify_nodes(nodes(spark), endpoint_schema())
    edges = spark.createDataFrame([], "tenant_id string, src long, edge string, dst long")
    g = assemble.graph_of(good, edges, endpoint_schema(), "t")
    assert g.nodes["Asset"].count() == 10
    # A type without nodes is not written; its table reads what was merged.
    assert "Generate" not in g.nodes["File"]._jdf.queryExecution().optimizedPlan().toString()
