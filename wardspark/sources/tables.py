"""Tables as batch and streaming DataFrames."""

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..session import stage_folder


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_json(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines as a table: (rows that fit `schema`, (line) of those that do not).

    The schema is given, so no pass over the files guesses it, and a line that is no object
    or has a value of another type is set apart whole.  Missing fields and JSON nulls are
    null; fields that the schema does not name are left out, and so are blank lines.
    """
    bad = "_not_as_schema"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.withColumn("row", F.from_json("value", f"{schema}, {bad} string", options))
    is_bad = F.col(f"row.{bad}").isNotNull() | F.col("row").isNull()
    return parsed.filter(~is_bad).select("row.*").drop(bad), parsed.filter(is_bad).select(F.col("value").alias("line"))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input of few splits; larger inputs are left as they lie.

    What is moved is at most one split per core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _is_folder(spark: SparkSession, path: str) -> bool:
    """Asked of the file system that holds the table, whatever it is."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def once_written(spark: SparkSession, path: str, load) -> DataFrame:
    """The table at `path`; where none has been written whole, that of `load()` is first."""
    context = spark.sparkContext
    mark = context._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not mark.getFileSystem(context._jsc.hadoopConfiguration()).exists(mark):
        load().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def stream_table(
    spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None
) -> DataFrame:
    """Parquet files of a table as a stream; the schema is read from the files there.

    The table is the one file or the folder of part files of exactly that name.
    """
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(read_table(spark, folder, name).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if _is_folder(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Run an appending stream over the files there now and read what it wrote.

    Output and checkpoint lie in the shared folder.
    """
    spark = stream.sparkSession
    base = stage_folder(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def _fill_up(spark: SparkSession, folder: str, empty: str, schema, files: int) -> None:
    """Add part files without rows to a folder until it has `files` of them."""
    context = spark.sparkContext
    hadoop, conf = context._jvm.org.apache.hadoop.fs, context._jsc.hadoopConfiguration()
    system = hadoop.Path(folder).getFileSystem(conf)

    def parts(path: str) -> list:
        found = [f.getPath() for f in system.listStatus(hadoop.Path(path))]
        return [p for p in found if p.getName().startswith("part-")]

    missing = files - len(parts(folder))
    if missing > 0:
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(empty)
        (source,) = parts(empty)
    for i in range(missing):
        target = hadoop.Path(folder, f"part-empty-{i:05d}.parquet")
        hadoop.FileUtil.copy(system, source, system, target, False, conf)


def route_late(
    stream: DataFrame, base: str, delay: str, ts: str = "ts", files_per_trigger: int | None = None
) -> DataStreamWriter:
    """Writer that parts a stream, as it comes, into rows in time and late rows under `base`.

    A row is late if it lies more than `delay` before the newest time of the batches before
    its own, which is when an operator with that watermark would drop it; rows without a
    time are in time.  The newest time goes from batch to batch as one row.  Each batch
    writes its rows and its row under its own number, so a batch that runs again gives the
    same files, and a query that starts again with the same `base` goes on where it was.

    With `files_per_trigger` the rows in time of a batch are written as exactly so many part
    files, filled up with empty ones, and a trigger that reads as many has one batch.
    """

    def split(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        known = None
        if number:
            before = session.read.schema("newest timestamp").parquet(f"{base}/newest/batch={number - 1}")
            known = before.select((F.col("newest") - F.expr(f"INTERVAL {delay}")).alias("t")).first().t
        late = F.coalesce(F.col(ts) < F.lit(known), F.lit(False)) if known else F.lit(False)
        batch = batch.persist(StorageLevel.DISK_ONLY)
        try:
            batch.filter(late).write.mode("overwrite").parquet(f"{base}/late/batch={number}")
            in_time, folder = batch.filter(~late), f"{base}/kept/batch={number:09d}"
            if files_per_trigger:
                in_time = in_time.coalesce(files_per_trigger)
            in_time.write.mode("overwrite").option("maxRecordsPerFile", 0).parquet(folder)
            if files_per_trigger:
                _fill_up(session, folder, f"{base}/empty", batch.schema, files_per_trigger)
            times = batch.select(F.col(ts).cast("timestamp").alias("newest"))
            if number:
                times = times.unionByName(before)
            times.agg(F.max("newest").alias("newest")).coalesce(1).write.mode("overwrite").parquet(
                f"{base}/newest/batch={number}"
            )
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(split).option("checkpointLocation", f"{base}/checkpoint")


def routed(spark: SparkSession, base: str, schema) -> tuple[DataFrame, DataFrame]:
    """What `route_late` has written so far: (rows in time, late rows)."""
    reader = spark.read.schema(schema).option("recursiveFileLookup", "true")
    return reader.parquet(f"{base}/kept"), reader.parquet(f"{base}/late")


def split_late(
    stream: DataFrame, name: str, delay: str, ts: str = "ts", close: bool = True,
    files_per_trigger: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Route a stream over the files there now; (rows in time as a stream, late rows).

    The rows in time come in the same batches again, `files_per_trigger` files each: else a
    batch in several triggers would move the watermark past its own rows.  Without
    `files_per_trigger` one trigger reads all.

    `close` adds one row of nulls far in the future to the rows in time: an input that
    ends has its last windows closed and its last rows decided.  Operators see it as a
    row without a key; `closing_row` tells it.
    """
    spark = stream.sparkSession
    base = stage_folder(spark, name)
    router = route_late(stream, base, delay, ts, files_per_trigger)
    router.trigger(availableNow=True).start().awaitTermination()
    schema = stream.schema
    if close:
        nulls = spark.range(1).select(*[
            (F.lit(CLOSING_TIME) if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ])
        nulls.coalesce(1).write.mode("overwrite").parquet(f"{base}/kept/batch=closing")
    kept = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if files_per_trigger:
        kept = kept.option("maxFilesPerTrigger", files_per_trigger)
    return kept.parquet(f"{base}/kept"), routed(spark, base, schema)[1]


CLOSING_TIME = "2200-01-01 00:00:00"  # still a time that pandas can hold


def closing_row(ts: str = "ts") -> Column:
    return F.col(ts) >= F.lit(CLOSING_TIME).cast("timestamp")
