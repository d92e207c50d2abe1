"""Golden log events, odd payloads, and that a payload's XML is read once."""

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import generators
from weftgraph.plans import catalog_events
from weftgraph.sources import fixture, sysmon

#: The host, ids and times of a published event.
GOLDEN = r"""<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System>
<Provider Name="Microsoft-Windows-Sysmon" Guid="{5770385F-C22A-43E0-BF4C-06F5698FFBD9}" /><EventID>1</EventID><Version>5</Version>
<Level>4</Level><Task>1</Task><Opcode>0</Opcode><Keywords>0x8000000000000000</Keywords><TimeCreated SystemTime="2019-07-24T18:05:14.402156600Z" />
<EventRecordID>550</EventRecordID><Correlation /><Execution ProcessID="3324" ThreadID="3220" /><Channel>Microsoft-Windows-Sysmon/Operational</Channel>
<Computer>DESKTOP-FVSHABR</Computer><Security UserID="S-1-5-18" /></System><EventData>
<Data Name="RuleName">-</Data><Data Name="UtcTime">2019-07-24 18:05:14.399</Data><Data Name="ProcessGuid">{87E8D3BD-9DDA-5D38-0000-0010A3941D00}</Data>
<Data Name="ProcessId">5752</Data><Data Name="Image">C:\Windows\System32\cmd.exe</Data><Data Name="CommandLine">"cmd" /C "echo &lt;a&gt; &amp; b"</Data>
<Data Name="ParentProcessId">6132</Data><Data Name="ParentImage">C:\Windows\System32\svchost.exe</Data><Data Name="ParentCommandLine">.\svchost.exe</Data>
<Data Name="Image">C:\Windows\System32\cmd.exe</Data><Data></Data></EventData></Event>"""


def parsed(spark, *payloads):
    rows = [("t", i, p) for i, p in enumerate(payloads)]
    return sysmon.parse(spark.createDataFrame(rows, "tenant_id string, event_id long, log_event string"))


def test_golden_header_and_data(spark):
    r = parsed(spark, GOLDEN).first()
    s = r.system
    assert (s.provider_name, s.provider_guid, s.event_id, s.version, s.level, s.task, s.opcode) == ("Microsoft-Windows-Sysmon", "5770385f-c22a-43e0-bf4c-06f5698ffbd9", 1, 5, 4, 1, 0)
    assert s.keywords == 0x8000000000000000 == 9223372036854775808
    assert (s.time_created, s.event_record_id, s.activity_id, s.process_id, s.thread_id) == (1563991514402, 550, None, 3324, 3220)
    assert (s.channel, s.computer, s.user_id) == ("Microsoft-Windows-Sysmon/Operational", "DESKTOP-FVSHABR", "S-1-5-18")
    assert r.event_name == r.payload == "ProcessCreation"
    assert r.data["CommandLine"] == '"cmd" /C "echo <a> & b"' and r.data["ProcessId"] == "5752" and len(r.data) == 9


#: The host, ids and times of a published event of another system.
LINUX = r"""<Event><System><Provider Name="Linux-Sysmon" Guid="{ff032593-a8d3-4f13-b0d6-01fc615a0f97}"/><EventID>1</EventID><Version>5</Version><Level>4</Level><Task>1</Task><Opcode>0</Opcode>
<Keywords>0x8000000000000000</Keywords><TimeCreated SystemTime="2022-01-04T19:54:15.665400000Z"/><EventRecordID>77</EventRecordID><Correlation/><Execution ProcessID="49514" ThreadID="49514"/>
<Channel>Linux-Sysmon/Operational</Channel><Computer>tux</Computer><Security UserId="0"/></System><EventData><Data Name="RuleName">-</Data><Data Name="UtcTime">2022-01-04 19:54:15.661</Data>
<Data Name="ProcessGuid">{49e2a5f6-a5e7-61d4-119e-dc77a5550000}</Data><Data Name="ProcessId">49570</Data><Data Name="Image">/usr/bin/tr</Data><Data Name="CommandLine">tr [:upper:][:lower:]</Data>
<Data Name="CurrentDirectory">/root</Data><Data Name="User">root</Data><Data Name="LogonGuid">{49e2a5f6-0000-0000-0000-000000000000}</Data><Data Name="LogonId">0</Data><Data Name="TerminalSessionId">3</Data>
<Data Name="IntegrityLevel">no level</Data><Data Name="Hashes">-</Data><Data Name="ParentProcessGuid">{00000000-0000-0000-0000-000000000000}</Data><Data Name="ParentProcessId">49568</Data>
<Data Name="ParentImage">-</Data><Data Name="ParentCommandLine">-</Data><Data Name="ParentUser">-</Data><Data Name="ParentUser">-</Data></EventData></Event>"""


def logs_of(spark, *payloads):
    return spark.createDataFrame([("t", i, p) for i, p in enumerate(payloads)], "tenant_id string, event_id long, log_event string")


def test_header_of_another_system(spark):
    s = parsed(spark, LINUX).first().system
    assert s.asDict() == {
        "provider_name": "Linux-Sysmon", "provider_guid": "ff032593-a8d3-4f13-b0d6-01fc615a0f97", "event_id": 1, "version": 5, "level": 4, "task": 1, "opcode": 0, "keywords": 9223372036854775808, "time_created": 1641326055665,
        "event_record_id": 77, "activity_id": None, "related_activity_id": None, "process_id": 49514, "thread_id": 49514, "channel": "Linux-Sysmon/Operational", "computer": "tux", "user_id": "0",
    }
    fields = sysmon.typed(logs_of(spark, LINUX), 1).first().fields
    assert (fields.UtcTime, fields.ProcessId, fields.LogonId, fields.TerminalSessionId, fields.ParentProcessGuid) == (1641326055661, 49570, 0, 3, "00000000-0000-0000-0000-000000000000")
    assert (fields.ParentUser, fields.Image, fields.Company) == ("-", "/usr/bin/tr", None)


def errors(spark, text):
    r = sysmon.checked(logs_of(spark, text)).first()
    return r.event_kind, None if r.errors is None else [(e.field, e.error, e.value, e.position) for e in r.errors]


def test_errors_tell_the_field_the_value_and_the_place(spark):
    assert errors(spark, LINUX) == (1, [])
    text = LINUX.replace(">49570<", ">4294967296<").replace("<Level>4", "<Level>256").replace('ThreadID="49514"', 'ThreadID="-1"').replace('<Data Name="User">root</Data>', "").replace("{49e2a5f6-0000", "{49e2a5f6_0000")
    kind, found = errors(spark, text)
    assert [(f, e, v) for f, e, v, _ in found] == [("Level", "integer", "256"), ("ThreadID", "integer", "-1"), ("ProcessId", "integer", "4294967296"), ("User", "missing", None), ("LogonGuid", "guid", "{49e2a5f6_0000-0000-0000-000000000000}")]
    assert all(p is None or text[p - 1 :].startswith(v) for _, _, v, p in found)
    assert errors(spark, LINUX.replace("<Keywords>0x8000000000000000", "<Keywords>0x18000000000000000"))[1][0][:3] == ("Keywords", "integer", "0x18000000000000000")
    assert errors(spark, LINUX.replace("<EventRecordID>77", "<EventRecordID>18446744073709551615"))[1] == []
    assert errors(spark, LINUX.replace("<EventRecordID>77", "<EventRecordID>18446744073709551616"))[1][0][:2] == ("EventRecordID", "integer")
    assert errors(spark, "no event") == errors(spark, LINUX.replace("<Computer>tux</Computer>", "")) == (None, None)
    assert errors(spark, mixed(4242)[0])[0] == 4242


@pytest.mark.parametrize("text,value", [("0", 0), ("0xFFFFFFFFFFFFFFFF", 2**64 - 1), ("8000000000000000", 2**63), ("0x7fffffffffffffff", 2**63 - 1), ("0x0000000000000000001", 1), ("0x1FFFFFFFFFFFFFFFF", None), ("", None), ("0x", None), ("-1", None)])
def test_hexadecimals_of_64_bits(spark, text, value):
    from weftgraph.functions import parsing

    assert spark.createDataFrame([(text,)], "t string").select(parsing.hex_int(F.col("t"))).first()[0] == value


def test_golden_subgraph(spark):
    g = generators.process_create(parsed(spark, GOLDEN))
    nodes = {r.node_key.split(":")[1]: (r.node_type, {**r.strings, **r.numbers}) for r in generators.nodes_of(g).collect()}
    host, t = "DESKTOP-FVSHABR", 1563991514399
    assert nodes == {
        "asset": ("Asset", {"asset_id": host, "hostname": host}),
        "parent": ("Process", {"asset_id": host, "process_id": 6132, "process_name": "svchost.exe", "process_command_line": ".\\svchost.exe", "last_seen_timestamp": t}),
        "child": ("Process", {"asset_id": host, "process_id": 5752, "process_name": "cmd.exe", "process_command_line": '"cmd" /C "echo <a> & b"', "created_timestamp": t}),
        "exe": ("File", {"asset_id": host, "file_path": r"C:\Windows\System32\cmd.exe", "last_seen_timestamp": t}),
    }
    assert {(r.src_key.split(":")[1], r.edge, r.dst_key.split(":")[1]) for r in generators.edges_of(g).collect()} == {("parent", "process_asset", "asset"), ("child", "process_asset", "asset"), ("child", "binary_file", "exe"), ("asset", "files_on_asset", "exe"), ("parent", "children", "child")}


def mixed(*ids):
    return [f"<Event><System><EventID>{i}</EventID><Computer>h{i}</Computer></System><EventData><Data Name='a'>{i}</Data></EventData></Event>" for i in ids]


def test_mixed_events_all_parse(spark):
    rows = parsed(spark, *mixed(16, 3, 5, 1, 5, 11, 15, 4242)).orderBy("event_id").collect()
    assert [r.payload for r in rows] == ["Unsupported", "NetworkConnection", "ProcessTerminated", "ProcessCreation", "ProcessTerminated", "FileCreate", "FileCreateStreamHash", "Unsupported"]
    assert [r.event_name for r in rows][0] == "ServiceConfigurationChange" and [r.event_name for r in rows][-1] == "Unknown"
    assert [r.system.computer for r in rows] == ["h16", "h3", "h5", "h1", "h5", "h11", "h15", "h4242"]
    assert [len(r.data) for r in rows] == [0, 1, 1, 1, 1, 1, 1, 0]


def test_first_of_several_events_and_comments(spark):
    one, two = mixed(1, 3)
    for text in (one + two, f"<!-- {two} -->{one}\n{two}", f"\ufeff  \n<!--\n-->\n{one}<!-- x -->{two}", f"<Events>{one}{two}</Events>"):
        assert parsed(spark, text).first().system.event_id == 1


@pytest.mark.parametrize("bad", [None, "", "no xml", "<Event></Event>", mixed(1)[0][:60], mixed(1)[0].replace("<Computer>h1</Computer>", ""), mixed(1)[0].replace(">1</EventID>", ">one</EventID>"), mixed(1)[0].replace("'>1<", "'>\x01<")])
def test_unreadable_payloads_are_rejected(spark, bad):
    p = parsed(spark, bad, mixed(1)[0])
    assert [tuple(r) for r in sysmon.rejected(p).collect()] == [("t", 0, bad)]
    assert p.where("event_id = 0").first().data is None


def test_files_of_events(spark, tmp_path):
    (tmp_path / "a.xml").write_text("\n".join(mixed(1, 3)) + "\n")
    (tmp_path / "b.xml").write_text("<Events>" + "".join(mixed(5)) + "</Events>")
    logs = sysmon.read(spark, str(tmp_path)).select(F.lit("t").alias("tenant_id"), F.lit(0).alias("event_id"), "log_event")
    assert sorted(r[0] for r in sysmon.parse(logs).select("system.event_id").where("event_id is not null").collect()) == [1, 3, 5]


def test_one_pass_over_the_xml(spark, sf):
    from weftgraph.plans import catalog

    for name in ("g_dispatch", "g_process_create_nodes", "x_header"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_xml") == 1, (name, plan.count("from_xml"))
    for name in ("i_identify_edges", "i_identify_nodes", "i_quarantine", "a_suspicious_parent"):
        # Subgraphs are written before; what is left reads tables.
        assert "from_xml" not in catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_nodes_of_one_key_are_one(spark):
    rows = [("t", 1, "k", "Process", {"a": "x"}, {"n": 2}), ("t", 1, "k", "Process", {"a": "b", "c": "d"}, {}), ("t", 1, "l", "File", {}, {})]
    df = spark.createDataFrame(rows, "tenant_id string, event_id long, node_key string, node_type string, strings map<string,string>, numbers map<string,long>")
    got = {r.node_key: (r.strings, r.numbers) for r in generators.merged_nodes(df).collect()}
    assert got == {"k": ({"a": "b", "c": "d"}, {"n": 2}), "l": ({}, {})}


def test_no_edge_to_itself(spark):
    df = spark.createDataFrame([("t", 1, [("a", "e", "a"), ("a", "e", "b")])], "tenant_id string, event_id long, edges array<struct<src_key:string,edge:string,dst_key:string>>")
    assert [(r.src_key, r.dst_key) for r in generators.edges_of(df).collect()] == [("a", "b")]


def test_generators_work_out_the_header_fields_that_they_read(spark, sf):
    logs = fixture.sysmon_logs(fixture.table(spark, sf, "events"), 1)
    plan = generators.process_create(sysmon.parse(logs, header=generators.HEADER))._jdf.queryExecution().optimizedPlan().toString()
    assert "conv(" not in plan


def test_payloads_of_two_events_need_no_join(spark, sf):
    plan = catalog_events.x_first_event(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
