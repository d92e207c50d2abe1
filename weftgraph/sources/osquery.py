"""osquery result lines: JSON text to typed columns, by the pack that a line's name ends in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import parsing as P

LINE = "name string, hostIdentifier string, calendarTime string, unixTime bigint, action string, columns map<string,string>"
PACKS = ("process-files", "processes", "files")


def parse(logs: DataFrame, text: str = "log_event", prefix: str = "pack_") -> DataFrame:
    """logs with pack, host, unix_ms, action and columns (text to text); null pack where the line is of none."""
    rows = P.computed_once(logs, _j=F.from_json(F.col(text).cast("string"), LINE, {"mode": "PERMISSIVE"}))
    pack = F.regexp_extract("_j.name", f"^{prefix}.*?({'|'.join(PACKS)})$", 1)
    good = (pack != "") & F.col("_j.hostIdentifier").isNotNull()
    return rows.select(*logs.columns, F.when(good, pack).alias("pack"), F.col("_j.hostIdentifier").alias("host"), P.in_ms(F.col("_j.unixTime")).alias("unix_ms"), F.col("_j.action").alias("action"), F.col("_j.columns").alias("columns"))
