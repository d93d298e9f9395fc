"""The store of saved patterns: an append-only log, its current view, search and listing."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.sources.kbjson import LOG_SCHEMA


def current(log: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The row with the greatest ``order`` of each ``key``; superseded and deleted rows are left out.

    Only key and order are aggregated; the rows are then met by their unique
    order. A column ``op`` with the value ``delete`` marks a tombstone.
    """
    last = log.groupBy(key).agg(F.max(order).alias(order)).select(order)
    rows = log.join(last, order, "left_semi")
    return rows.where("coalesce(op, 'upsert') != 'delete'").drop("op") if "op" in log.columns else rows


def new_pattern_id(seq: Column) -> Column:
    """An id of the present time and the row's place in the log, to base 36 and nine characters at least.

    The time is the same for all rows of a query, and nine random characters
    would meet in a large one; the place is unique.
    """
    place = F.lower(F.conv(seq.cast("string"), 10, 36))
    return F.concat(F.lit("pattern-"), F.unix_millis(F.current_timestamp()).cast("string"), F.lit("-"), F.when(F.length(place) < 9, F.lpad(place, 9, "0")).otherwise(place))


def iso_now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def append_patterns(patterns: DataFrame, path: str) -> None:
    """Add rows to the log, each with an id, the present time and a place after all before it.

    The log has one writer at a time: two at once would read the same greatest
    place. Only that column is read for it, of which Parquet keeps statistics.
    """
    spark = patterns.sparkSession
    start = (spark.read.schema(LOG_SCHEMA).parquet(path).agg(F.max("seq")).first()[0] or 0) + 1
    rows = patterns.withColumns({"seq": F.lit(start) + F.monotonically_increasing_id(), "saved_at": iso_now(), "op": F.lit("upsert")})
    rows = rows.withColumn("id", new_pattern_id(F.col("seq")))
    rows.select(*[f.split(" ")[0] for f in LOG_SCHEMA.split(", ")]).write.mode("append").parquet(path)


def delete_patterns(ids: DataFrame, path: str) -> None:
    """Append a tombstone for each ``id``; an unknown id only adds its tombstone. One writer at a time."""
    spark = ids.sparkSession
    start = (spark.read.schema(LOG_SCHEMA).parquet(path).agg(F.max("seq")).first()[0] or 0) + 1
    empty = {n: F.lit(None).cast(t) for n, t in (f.split(" ", 1) for f in LOG_SCHEMA.split(", "))}
    rows = ids.select("id").distinct().withColumns({**{k: v for k, v in empty.items() if k != "id"}, "seq": F.lit(start) + F.monotonically_increasing_id(), "saved_at": iso_now(), "op": F.lit("delete")})
    rows.select(*[f.split(" ")[0] for f in LOG_SCHEMA.split(", ")]).write.mode("append").parquet(path)


def without(log: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is not in ``ids``."""
    return log.join(ids.select("id").distinct(), "id", "left_anti")


def matches(query: Column | str) -> Column:
    """Whether a pattern has the whole query, in any case, in its name, description, type or a tag.

    An empty query is in every pattern, except one whose four fields are all null.
    """
    q = F.lower(F.lit(query) if isinstance(query, str) else query)
    fields = [F.lower(F.col(c)).contains(q) for c in ("name", "description", "type")]
    tags = F.exists("tags", lambda t: F.coalesce(F.lower(t).contains(q), F.lit(False)))
    found = F.coalesce(tags, F.lit(False))
    for f in fields:
        found = found | F.coalesce(f, F.lit(False))
    return found


def search(patterns: DataFrame, query: str) -> DataFrame:
    """The patterns that match one query, in no order."""
    return patterns.where(matches(query))


def listing(patterns: DataFrame) -> DataFrame:
    """label, description and detail of each pattern, as a picker shows them."""
    return patterns.select("seq", F.col("name").alias("label"), F.concat_ws(" • ", "language", "type").alias("description"), F.col("description").alias("detail"))


def stats(patterns: DataFrame, path: str = "", feature_count: int = 0) -> DataFrame:
    """One row: how many patterns there are and where they are kept."""
    return patterns.agg(F.count(F.lit(1)).alias("pattern_count")).select(F.lit(feature_count).cast("bigint").alias("feature_count"), "pattern_count", F.lit(path).alias("path"))
