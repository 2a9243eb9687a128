"""Table functions for SQL over the engine's tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf


class EventStream:
    """``event_stream(TABLE (lines) PARTITION BY window ORDER BY …)``: a window's lines as they come, each with its place from 1 on. Nothing is gathered: a row in, a row out."""

    def __init__(self):
        self.place = 0

    def eval(self, row: Row) -> Iterator[tuple]:
        self.place += 1
        yield row["window"], row["visitor_id"], row["label"], row["timestamp"], row["shot"], row["line"], self.place


STREAM = "window string, visitor_id string, label string, timestamp long, shot int, line string, place int"
#: SQL functions over columns, by name: arguments, result, and body.
FUNCTIONS = {
    "utc_day": ("ms BIGINT", "STRING", "date_format(timestamp_millis(ms), 'yyyy-MM-dd')"),
    "opened_ms": ("slice STRING", "BIGINT", "try_cast(split_part(slice, '-', 1) AS BIGINT)"),
    "route": ("url STRING", "STRING", "regexp_replace(url, '^([^?#]*)[?][^#]*', '$1')"),
}


def register(spark: SparkSession) -> None:
    """Makes the table function and the SQL functions known to the session."""
    spark.udtf.register("event_stream", udtf(EventStream, returnType=STREAM))
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
