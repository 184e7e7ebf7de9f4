"""Writing tables and reading them back."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from foldspan.operators.plan_steps import plan_json

_VECTOR = "struct<size: int, indices: array<int>, values: array<float>>"


#: Folders that a partitioned table has at most.
BUCKETS = 64
MANIFEST = "table string, path string, rows long, nulls map<string, long>, low string, high string, config string"


def write_tables(tables: dict[str, DataFrame], path: str, partition: str | None = "project_id", csv: bool = False, mode: str = "overwrite", config: dict | None = None) -> DataFrame:
    """Writes each table as Parquet below path, and as CSV if asked. Where a table has the column partition, its rows are
    dealt by that column into at most BUCKETS folders bucket=n, so that a task writes one file for a bucket and the
    folders do not grow in number with the keys. Returns the manifest (table, path, rows, nulls by column, least and
    greatest partition value, config): what each write has itself observed; no table is read again."""
    rows, spark = [], next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        at = f"{path.rstrip('/')}/{name}"
        keyed = partition is not None and partition in df.columns
        nulls = F.create_map(*(x for c in df.columns for x in (F.lit(c), F.count(F.when(F.col(f"`{c}`").isNull(), 1)))))
        key = F.col(partition).cast("string") if keyed else F.lit(None).cast("string")
        ranged = F.col(partition) if keyed else key
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), nulls.alias("nulls"), F.min(ranged).cast("string").alias("low"), F.max(ranged).cast("string").alias("high"))
        if keyed:
            bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
            watched.withColumn("bucket", bucket).repartition("bucket").write.mode(mode).partitionBy("bucket").parquet(at)
        else:
            watched.write.mode(mode).parquet(at)
        if csv:
            df.write.mode(mode).option("header", True).csv(f"{at}_csv")
        got = seen.get
        rows.append((name, at, got["rows"], dict(got["nulls"]), got["low"], got["high"], json.dumps(config or {}, sort_keys=True)))
    return spark.createDataFrame(rows, MANIFEST)


def write_vectors(df: DataFrame, path: str, sparse: bool = True, column: str = "features", mode: str = "overwrite") -> None:
    """Feature vectors as Parquet: sparse structs, or dense arrays."""
    if not sparse and df.schema[column].dataType.typeName() == "struct":
        at = F.map_from_arrays(f"{column}.indices", f"{column}.values")
        df = df.withColumn(column, F.transform(F.sequence(F.lit(0), F.col(f"{column}.size") - 1), lambda i: F.coalesce(F.element_at(at, i), F.lit(0.0).cast("float"))))
    df.write.mode(mode).parquet(path)


def write_plans(steps: DataFrame, path: str, key: str = "plan_id", mode: str = "overwrite") -> None:
    """One JSON array of steps a line, by plan."""
    plan_json(steps, key).select("plan").write.mode(mode).text(path)


def append_messages(messages: DataFrame, path: str, batch: str) -> None:
    """Adds a batch of messages to the append-only table at path, once however often it is tried.

    An attempt writes its rows into a folder of its own and then commits it, one row (batch, attempt); readers take the
    first commit of each batch. So an attempt that fails leaves nothing to see, and a retry, or the same batch from two
    writers at a time, adds nothing. Nothing written before is rewritten.
    """
    attempt = uuid.uuid4().hex
    messages.write.parquet(f"{path.rstrip('/')}/rows/attempt={attempt}")
    spark = messages.sparkSession
    commit = spark.range(1).select(F.lit(batch).alias("batch"), F.lit(attempt).alias("attempt"), F.current_timestamp().alias("at"))
    commit.coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/commits")


def read_messages(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The messages of committed batches. Of the attempts' folders only those that count are scanned."""
    commits = spark.read.schema("batch string, attempt string, at timestamp").parquet(f"{path.rstrip('/')}/commits")
    counted = commits.groupBy("batch").agg(F.min(F.struct("at", "attempt")).alias("c")).select(F.col("c.attempt").alias("attempt"))
    rows = (spark.read.schema(f"{schema}, attempt string") if schema else spark.read).parquet(f"{path.rstrip('/')}/rows")
    return rows.join(F.broadcast(counted) if commits.count() <= 100_000 else counted, "attempt", "left_semi").drop("attempt")


def message_sink(path: str, name: str):
    """For foreachBatch: each batch of the stream of this name is added once, also where the stream starts again."""
    return lambda batch, number: append_messages(batch, path, f"{name}-{number}")


def with_updates(threads: DataFrame, messages: DataFrame) -> DataFrame:
    """threads with updated_at as the last of its own and its messages' times."""
    last = messages.groupBy("thread_id").agg(F.max("ts").alias("__ts"))
    return threads.join(last, "thread_id", "left").withColumn("updated_at", F.greatest("updated_at", "__ts")).drop("__ts")


def reuse(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A stage's earlier output, None if there is none. A schema keeps the type of the partition column."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException:
        return None


def content(df: DataFrame) -> str:
    """A fingerprint of a table's rows, whatever their order: their number and the sum of their hashes, and the columns."""
    one = F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns))), {"ignoreNullFields": "false"})).cast("decimal(38, 0)")
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(one).alias("s")).first()
    return f"{row['n']}:{row['s']}:{','.join(f'{n} {t}' for n, t in sorted(df.dtypes))}"


def stage(spark: SparkSession, path: str, inputs: dict[str, DataFrame], config: dict, build: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """(output, reused): the output at path if it was built from these inputs with this configuration, else built anew.

    The fingerprint of inputs and configuration is stored beside the output after it has been written whole, so that
    neither a stale output nor a broken one is taken. Each build has a folder of its own; readers of an earlier one are
    not disturbed.
    """
    said = json.dumps({"config": config, "inputs": {n: content(df) for n, df in sorted(inputs.items())}}, sort_keys=True)
    mark = hashlib.sha256(said.encode()).hexdigest()
    root = path.rstrip("/")
    marks = reuse(spark, f"{root}/marks", "mark string, folder string")
    found = None if marks is None else marks.filter(F.col("mark") == mark).select("folder").first()
    if found:
        return spark.read.parquet(found["folder"]), True
    folder = f"{root}/output-{uuid.uuid4().hex}"
    build().write.parquet(folder)
    spark.range(1).select(F.lit(mark).alias("mark"), F.lit(folder).alias("folder")).coalesce(1).write.mode("append").parquet(f"{root}/marks")
    return spark.read.parquet(folder), False
