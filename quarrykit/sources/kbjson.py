"""The knowledge base as one JSON document: reading, bootstrap, export."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PATTERN_FIELDS = "id string, name string, language string, type string, code string, description string, query string, savedAt string, tags array<string>"
INDEX_SCHEMA = f"version string, createdAt string, lastUpdated string, featureCount bigint, patterns array<struct<{', '.join(f.replace(' ', ': ', 1) for f in PATTERN_FIELDS.split(', '))}>>"
LOG_SCHEMA = "seq bigint, id string, name string, language string, type string, code string, description string, query string, saved_at string, tags array<string>, op string"


def read_index(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The fields of the documents, with an empty list where ``patterns`` is missing or null.

    A file is one document, or with ``lines`` one on each line, so that many
    knowledge bases are read by many tasks.
    """
    index = spark.read.schema(INDEX_SCHEMA).option("multiLine", str(not lines).lower()).json(path)
    return index.withColumn("patterns", F.coalesce("patterns", F.array().cast(index.schema["patterns"].dataType)))


def patterns_of(index: DataFrame) -> DataFrame:
    """One row per pattern in document order, as the log has them."""
    rows = index.select(F.posexplode("patterns").alias("seq", "p"))
    return rows.select(F.col("seq").cast("bigint").alias("seq"), *[F.col(f"p.{n}").alias("saved_at" if n == "savedAt" else n) for n in (f.split(" ")[0] for f in PATTERN_FIELDS.split(", "))])


def pattern_json() -> Column:
    """One pattern of the log as a JSON object with the document's field names."""
    names = [f.split(" ")[0] for f in PATTERN_FIELDS.split(", ")]
    return F.to_json(F.struct(*[F.col("saved_at" if n == "savedAt" else n).alias(n) for n in names]))


def index_documents(log: DataFrame, base: Column, version: str = "1.0.0") -> DataFrame:
    """One index document for each knowledge base, as a line of JSON in ``value``.

    ``base`` tells which one a row of the log's current view belongs to. A
    document holds its patterns in the order of ``seq``; as it is one text, the
    caller keeps a base to what one text can hold.
    """
    names = [f.split(" ")[0] for f in PATTERN_FIELDS.split(", ")]
    one = F.struct("seq", F.struct(*[F.col("saved_at" if n == "savedAt" else n).alias(n) for n in names]).alias("p"))
    held = log.groupBy(base.alias("base")).agg(F.array_sort(F.collect_list(one)).alias("rows"), F.max("saved_at").alias("last"))
    patterns = F.transform("rows", lambda x: x["p"]).alias("patterns")
    return held.select(F.to_json(F.struct(F.lit(version).alias("version"), F.col("last").alias("lastUpdated"), F.lit(0).cast("bigint").alias("featureCount"), patterns)).alias("value"))


def bootstrap(spark: SparkSession, path: str) -> None:
    """Write an empty typed log where there is none; an existing one is left as it is."""
    spark.createDataFrame([], LOG_SCHEMA).write.mode("ignore").parquet(path)
