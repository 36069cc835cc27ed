"""Registered queries that run as streams over stored tables until these are read, then give what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import folder
from ..fixture import Catalog
from ..functions import columns as C
from ..operators import matching as M
from ..operators import quality as Q
from ..streaming import inquiries as S
from .catalog import GAP, SETTLED, flagged, numbers_, register


def _folder(c: Catalog) -> str:
    return folder(c.spark)


def _events(c: Catalog) -> DataFrame:
    path = f"{c.dir}/event[s].parquet"  # a pattern: the source takes a plain path for a folder
    raw = F.regexp_extract("props", r"(\d+)", 1)
    return c.spark.readStream.schema(c.read("events").schema).parquet(path).select(
        F.col("event_id").alias("inquiry_id"), "user_id", F.col("ts").cast("timestamp").alias("ts"), raw.alias("raw"), C.query_key(raw).alias("query_key"), (F.col("event_type") != "view").alias("is_text"),
        F.when(F.col("value") > 50, F.col("event_id") % 1000).alias("matched_part"),
    )


def _run(stream: DataFrame, c: Catalog, mode: str = "append") -> DataFrame:
    home = _folder(c)
    stream.writeStream.format("parquet").outputMode(mode).option("path", f"{home}/out").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start().awaitTermination()
    return c.spark.read.schema(stream.schema).parquet(f"{home}/out")


def _closed(stream: DataFrame, c: Catalog, days: int) -> DataFrame:
    """The finite stream with one more row, days after its last: it moves the watermark over all that is still open."""
    home = _folder(c)
    last = c.inquiries.agg(F.max("ts").cast("timestamp").alias("ts"))
    values = {"inquiry_id": F.lit(-1), "user_id": F.lit(-1), "ts": F.col("ts") + F.make_dt_interval(F.lit(days)), "raw": F.lit(""), "query_key": F.lit(""), "is_text": F.lit(True), "matched_part": F.lit(None)}
    last.select(*(values[f.name].cast(f.dataType).alias(f.name) for f in stream.schema)).write.parquet(f"{home}/closing")
    return stream.unionByName(c.spark.readStream.schema(stream.schema).parquet(f"{home}/closing"))


@register("m1_stream_settled", f"SELECT inquiry_id, user_id, query_key FROM ({SETTLED}) WHERE NOT superseded", "inquiries")
def settled(c: Catalog) -> DataFrame:
    return _run(S.stream_settled(_closed(_events(c), c, 2), GAP), c).filter("inquiry_id >= 0")


@register("m4_stream_unmatched", "SELECT day, query_key, count(*) AS n FROM (SELECT ts::DATE - unnest(range(30))::INTEGER AS day, query_key FROM inquiries WHERE is_text AND matched_part IS NULL) GROUP BY 1, 2", "inquiries")
def unmatched(c: Catalog) -> DataFrame:
    """Windows of 30 days, named by their first day."""
    return _run(S.stream_unmatched(_closed(_events(c), c, 62)), c).select(F.col("start").cast("date").alias("day"), "query_key", "n")


@register("m3_stream_match")
def match(c: Catalog) -> DataFrame:
    home = _folder(c)
    asked = _events(c).filter("is_text").select(F.col("inquiry_id").alias("query_id"), F.concat(F.lit("20"), F.lpad("raw", 5, "0")).alias("raw"))
    matcher = lambda batch: M.match_queries(M.queries_of(batch), c.parts, numbers_(c), c.fitments, Q.completeness(flagged(c))).select("query_id", "part_id", "level", "milli", "rank")
    S.stream_match(asked, matcher, f"{home}/out", f"{home}/state").awaitTermination()
    return c.spark.read.schema("query_id long, part_id long, level int, milli int, rank int").parquet(f"{home}/out").select("query_id", "part_id", "level", "milli", "rank")
