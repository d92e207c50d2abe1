"""Scalar parsing of log fields, as built-in expressions: malformed input gives null, never an error."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed by the log format: names of event ids.
EVENT_NAMES = {
    1: "ProcessCreation",
    2: "ProcessChangedFileCreationTime",
    3: "NetworkConnection",
    4: "SysmonServiceStateChange",
    5: "ProcessTerminated",
    6: "DriverLoaded",
    7: "ImageLoaded",
    8: "CreateRemoteThread",
    9: "RawAccessRead",
    10: "ProcessAccess",
    11: "FileCreate",
    12: "RegistryCreateOrDelete",
    13: "RegistryValueSet",
    14: "RegistryKeyValueRename",
    15: "FileCreateStreamHash",
    16: "ServiceConfigurationChange",
    17: "PipeCreated",
    18: "PipeConnected",
    19: "WmiEventFilter",
    20: "WmiEventConsumer",
    21: "WmiEventConsumerToFilter",
    22: "DnsQuery",
    23: "FileDelete",
    24: "ClipboardChange",
    25: "ProcessTampering",
    26: "FileDeleteDetected",
    255: "Error",
}
#: Fixed by the log format: events whose data is read; of others only the header is.
SUPPORTED = (1, 3, 5, 11, 15)
_SECONDS_BELOW = 10**12


def event_name(event_id: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in EVENT_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, event_id.cast("int")), F.lit("Unknown"))


def payload(event_id: Column) -> Column:
    """The name of an event whose data is read, else Unsupported."""
    return F.when(event_id.cast("int").isin(*SUPPORTED), event_name(event_id)).otherwise("Unsupported")


def last_of_each(entries: Column) -> Column:
    """A map of an array of (name, value); a name that comes twice counts once, the last; entries without a name go."""
    named = F.filter(entries, lambda d: d["_Name"].isNotNull())
    names = F.transform(named, lambda d: d["_Name"])
    turned = F.reverse(names)
    last = F.filter(named, lambda d, i: F.array_position(turned, d["_Name"]) == F.size(names) - i)
    return F.map_from_entries(F.when(F.size(F.array_distinct(names)) == F.size(names), named).otherwise(last))


def hex_int(c: Column) -> Column:
    """"0" or base 16 with or without 0x, of 64 bits without a sign: a decimal, as no long holds them all."""
    digits = F.regexp_extract(c, "^(?:0[xX])?0*([0-9a-fA-F]{1,16})$", 1)
    return F.when(digits != "", F.conv(digits, 16, 10).try_cast("decimal(20,0)"))


def unsigned(c: Column, bits: int) -> Column:
    """Digits, below 2**bits; a decimal where a long does not hold them all."""
    value = F.when(c.rlike(r"^\+?\d{1,30}$"), c.try_cast("decimal(38,0)"))
    return F.when(value < F.lit(str(1 << bits)).cast("decimal(38,0)"), value).cast("decimal(20,0)" if bits > 63 else "bigint")


def guid(c: Column) -> Column:
    bare = F.lower(F.regexp_replace(c, r"^\{|\}$", ""))
    return F.when(bare.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), bare)


def integer(c: Column) -> Column:
    return F.trim(c).try_cast("bigint")


def boolean(c: Column) -> Column:
    return F.when(F.lower(c) == "true", True).when(F.lower(c) == "false", False)


def ip(c: Column) -> Column:
    four = r"^((25[0-5]|2[0-4]\d|1?\d?\d)(\.|$)){4}$"
    return F.when(c.rlike(four) | (c.rlike("^[0-9a-fA-F:.]+$") & c.contains(":")), c)


def utc_ms(c: Column) -> Column:
    """Epoch milliseconds of a UTC time text, with or without T and Z; negative times are null."""
    plain = F.regexp_replace(F.regexp_replace(c, "T", " "), "Z$", "")
    ms = F.unix_millis(F.try_to_timestamp(F.concat(F.regexp_extract(plain, r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)", 1), F.rpad(F.regexp_extract(plain, r"(\.\d{1,3})\d*$", 1), 4, ".000"), F.lit("Z")), F.lit("yyyy-MM-dd HH:mm:ss.SSSX")))
    return F.when(ms >= 0, in_ms(ms))


def in_ms(t: Column) -> Column:
    """Times that can only be seconds, as milliseconds."""
    return F.when(t < _SECONDS_BELOW, t * 1000).otherwise(t)


def time_text(c: Column) -> Column:
    """utc_ms of texts that hold nothing else."""
    return F.when(c.rlike(r"^\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d(\.\d+)?Z?$"), utc_ms(c))


#: Kinds of fields: how each is read, and what is said of a text that is none.
KINDS: dict[str, tuple[Callable[[Column], Column], str]] = {
    "u8": (lambda c: unsigned(c, 8), "integer"),
    "u16": (lambda c: unsigned(c, 16), "integer"),
    "u32": (lambda c: unsigned(c, 32), "integer"),
    "u64": (lambda c: unsigned(c, 64), "integer"),
    "hex": (hex_int, "integer"),
    "guid": (guid, "guid"),
    "bool": (boolean, "boolean"),
    "ip": (ip, "address"),
    "time": (time_text, "time"),
    "text": (lambda c: c, "text"),
}
ERROR = "struct<field:string,error:string,value:string,position:int>"


def checked(field: str, kind: str, text: Column, required: bool, position: Column) -> Column:
    """(value, error) of a field's text: the error says which field, what it should have been, what it was and where.

    A required field without a text is an error without a value and a place. position: where the text is, from 1 on.
    """
    read, name = KINDS[kind]
    value = read(text)
    wrong = F.struct(F.lit(field).alias("field"), F.lit(name).alias("error"), text.alias("value"), position.cast("int").alias("position")).cast(ERROR)
    missing = F.struct(F.lit(field).alias("field"), F.lit("missing").alias("error"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("int").alias("position")).cast(ERROR)
    error = F.when(text.isNotNull() & value.isNull(), wrong)
    return F.struct(value.alias("value"), (F.when(text.isNull(), missing).otherwise(error) if required else error).alias("error"))


def errors(fields: list[Column]) -> Column:
    """The errors of checked fields, in their order."""
    return F.array_compact(F.array(*[f["error"] for f in fields]))


def strip_zone(path: Column) -> Column:
    return F.regexp_replace(path, ":Zone\\.Identifier$", "")


def image_name(path: Column) -> Column:
    """The last segment of a path, without "- "."""
    return F.replace(F.element_at(F.split(path, r"\\"), -1), F.lit("- "), F.lit(""))


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are worked out once a row, however often later expressions read them.

    A generator of one row stands between, through which the optimizer does not copy expressions.
    """
    one = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select("*", F.explode(one).alias("_once")).select(*df.columns, *[F.col(f"_once.{n}").alias(n) for n in columns])
