"""Sysmon events: XML text to typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import parsing as P

_SYSTEM = (
    "Provider struct<_Name:string,_Guid:string,_EventSourceName:string>, EventID string, Version string, Level string, Task string, Opcode string, Keywords string, "
    "TimeCreated struct<_SystemTime:string>, EventRecordID string, Correlation struct<_ActivityID:string,_RelatedActivityID:string>, Execution struct<_ProcessID:string,_ThreadID:string>, "
    "Channel string, Computer string, Security struct<_UserID:string>"
)
EVENT = f"System struct<{', '.join(_SYSTEM.split(', ')).replace(' struct<', ':struct<').replace(' string', ':string')}>, EventData struct<Data:array<struct<_Name:string,_VALUE:string>>>, _corrupt_record string"


def with_event(logs: DataFrame, text: str, name: str = "_event") -> DataFrame:
    """logs with the first <Event> of each payload, comments left out and without namespaces; null without one.

    Step by step, as each text is looked at several times; only payloads with comments are searched for them.
    """
    t = F.col(text).cast("string")
    rows = logs.withColumn("_bare", F.when(t.contains("<!--"), F.regexp_replace(t, r"(?s)<!--.*?-->", "")).otherwise(t))
    plain, named = F.locate("<Event>", F.col("_bare")), F.locate("<Event ", F.col("_bare"))
    rows = rows.withColumns({"_plain": plain, "_named": named})
    start = F.when(F.col("_plain") == 0, F.col("_named")).when(F.col("_named") == 0, F.col("_plain")).otherwise(F.least("_plain", "_named"))
    rows = rows.withColumn("_start", start).withColumn("_rest", F.when(F.col("_start") > 0, F.substr("_bare", F.col("_start"))))
    rows = rows.withColumn("_end", F.locate("</Event>", F.col("_rest"))).withColumn("_one", F.when(F.col("_end") > 0, F.substr("_rest", F.lit(1), F.col("_end") + len("</Event>") - 1)))
    bare = F.when(F.col("_one").contains(" xmlns="), F.regexp_replace("_one", r' xmlns="[^"]*"', "")).otherwise(F.col("_one"))
    # Either system's spelling of the one attribute that they spell differently.
    return rows.select(*logs.columns, F.replace(bare, F.lit("<Security UserId="), F.lit("<Security UserID=")).alias(name))


def parse(logs: DataFrame, text: str = "log_event", header: tuple[str, ...] | None = None) -> DataFrame:
    """logs with event_name, payload, system (typed) and data (field name -> text, of supported events).

    header: the fields that system has, all unless given; where several are read, Spark works out all that there are.

    event_name and all else are null where the payload is no readable event: without one, without an id or a computer,
    or with characters that XML forbids. A payload's XML is read once a row; header fields are typed where they are
    asked for.
    """
    rows = P.computed_once(with_event(logs, text), _x=F.from_xml("_event", EVENT, {"mode": "PERMISSIVE"}))
    s = lambda name: F.col(f"_x.System.{name}")
    good = P.integer(s("EventID")).isNotNull() & s("Computer").isNotNull() & F.col("_x._corrupt_record").isNull()
    known = good & P.integer(s("EventID")).isin(*P.SUPPORTED)
    none = F.create_map().cast("map<string,string>")
    rows = P.computed_once(rows, _good=good, data=F.when(good, F.coalesce(F.when(known, P.last_of_each(F.col("_x.EventData.Data"))), none)))
    system = {
        "provider_name": s("Provider._Name"),
        "provider_guid": P.guid(s("Provider._Guid")),
        "event_id": P.integer(s("EventID")),
        "version": P.integer(s("Version")),
        "level": P.integer(s("Level")),
        "task": P.integer(s("Task")),
        "opcode": P.integer(s("Opcode")),
        "keywords": P.hex_int(s("Keywords")),
        "time_created": P.utc_ms(s("TimeCreated._SystemTime")),
        "event_record_id": P.unsigned(s("EventRecordID"), 64),
        "activity_id": s("Correlation._ActivityID"),
        "related_activity_id": s("Correlation._RelatedActivityID"),
        "process_id": P.integer(s("Execution._ProcessID")),
        "thread_id": P.integer(s("Execution._ThreadID")),
        "channel": s("Channel"),
        "computer": s("Computer"),
        "user_id": s("Security._UserID"),
    }
    ok = F.col("_good")
    # Null by field, not as a whole, so that a field alone can be worked out.
    fields = F.struct(*[F.when(ok, c).alias(n) for n, c in system.items() if header is None or n in header])
    return rows.select(*logs.columns, fields.alias("system"), "data", F.when(ok, P.event_name(s("EventID"))).alias("event_name"), F.when(ok, P.payload(s("EventID"))).alias("payload"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """One event per line, or files of <Event> elements: (log_event) for parse."""
    return spark.read.text(path, lineSep="</Event>").select(F.concat(F.col("value"), F.lit("</Event>")).alias("log_event")).where(F.col("log_event").contains("<Event"))


def rejected(parsed: DataFrame) -> DataFrame:
    """Rows of parse that hold no readable event, as they came."""
    return parsed.where("event_name is null").drop("system", "data", "event_name", "payload")


#: Fixed by the log format: header fields with a type, and where they are.
HEADER_FIELDS = (
    ("Guid", "guid", "Provider._Guid", False),
    ("Version", "u8", "Version", True),
    ("Level", "u8", "Level", True),
    ("Task", "u16", "Task", True),
    ("Opcode", "u8", "Opcode", True),
    ("Keywords", "hex", "Keywords", True),
    ("SystemTime", "time", "TimeCreated._SystemTime", True),
    ("EventRecordID", "u64", "EventRecordID", True),
    ("ActivityID", "guid", "Correlation._ActivityID", False),
    ("RelatedActivityID", "guid", "Correlation._RelatedActivityID", False),
    ("ProcessID", "u32", "Execution._ProcessID", True),
    ("ThreadID", "u32", "Execution._ThreadID", True),
)
#: Fixed by the log format: the data fields of each event, with their kinds; those with a ? may be missing.
DATA_FIELDS = {
    1: "RuleName:text? UtcTime:time ProcessGuid:guid ProcessId:u32 Image:text FileVersion:text? Description:text? Product:text? Company:text? OriginalFileName:text? CommandLine:text CurrentDirectory:text User:text LogonGuid:guid LogonId:hex TerminalSessionId:u32 IntegrityLevel:text Hashes:text ParentProcessGuid:guid ParentProcessId:u32 ParentImage:text ParentCommandLine:text ParentUser:text?",
    3: "RuleName:text? UtcTime:time ProcessGuid:guid ProcessId:u32 Image:text User:text? Protocol:text Initiated:bool SourceIsIpv6:bool SourceIp:ip SourceHostname:text? SourcePort:u16 SourcePortName:text? DestinationIsIpv6:bool DestinationIp:ip DestinationHostname:text? DestinationPort:u16 DestinationPortName:text?",
    5: "RuleName:text? UtcTime:time ProcessGuid:guid ProcessId:u32 Image:text User:text?",
    11: "RuleName:text? UtcTime:time ProcessGuid:guid ProcessId:u32 Image:text TargetFilename:text CreationUtcTime:time User:text?",
    15: "RuleName:text? UtcTime:time ProcessGuid:guid ProcessId:u32 Image:text TargetFilename:text CreationUtcTime:time Hash:text Contents:text? User:text?",
}


def fields_of(event_id: int) -> list[tuple[str, str, bool]]:
    """(name, kind, required) of an event's data fields."""
    return [(n, kind.rstrip("?"), not kind.endswith("?")) for n, kind in (f.split(":") for f in DATA_FIELDS[event_id].split())]


def checked(logs: DataFrame, text: str = "log_event") -> DataFrame:
    """logs with event_kind (the event's number, null without one) and errors: what is wrong with each typed or required field, in the format's order.

    A field that is wrong is null in parse; here its row tells why: (field, error, value, position), position being the
    character of the event at which the value is. Events that are no XML, or have no number or computer, have no fields to
    check: event_kind is null, and so are the errors.
    """
    rows = P.computed_once(with_event(logs, text), _x=F.from_xml("_event", EVENT, {"mode": "PERMISSIVE"}))
    number = P.integer(F.col("_x.System.EventID"))
    good = number.isNotNull() & F.col("_x.System.Computer").isNotNull() & F.col("_x._corrupt_record").isNull()
    rows = P.computed_once(rows, _n=F.when(good, number), _d=F.when(good, P.last_of_each(F.col("_x.EventData.Data"))))

    def after(mark: str) -> Column:
        at = F.locate(mark, F.col("_event"))
        return F.when(at > 0, at + len(mark))

    header = []
    for name, kind, path, required in HEADER_FIELDS:
        mark = f'{name}="' if "._" in path else f"<{name}>"
        header.append(P.checked(name, kind, F.col(f"_x.System.{path}"), required, after(mark)))
    by_kind = F.array().cast(f"array<{P.ERROR}>")
    for event_id in DATA_FIELDS:
        own = [P.checked(n, kind, F.col("_d")[n], required, after(f'<Data Name="{n}">')) for n, kind, required in fields_of(event_id)]
        by_kind = F.when(F.col("_n") == event_id, P.errors(own)).otherwise(by_kind)
    found = F.when(F.col("_n").isNotNull(), F.concat(P.errors(header), by_kind))
    return rows.select(*logs.columns, F.col("_n").alias("event_kind"), found.alias("errors"))


def typed(logs: DataFrame, event_id: int, text: str = "log_event") -> DataFrame:
    """logs of one kind of event with a struct `fields`: its data fields by name, of the format's types; null where wrong or missing."""
    rows = parse(logs, text).where(F.col("system.event_id") == event_id)
    values = [P.KINDS[kind][0](F.col("data")[n]).alias(n) for n, kind, _ in fields_of(event_id)]
    return rows.select(*logs.columns, "system", F.struct(*values).alias("fields"))
