"""Incremental validation, resumable scoring and routing on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from catalumen.functions.jsontext import is_json_object
from catalumen.operators import selective


def file_stream(spark: SparkSession, folder: str, schema, pattern: str | None = None,
                form: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(form)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def lock_identity(spark: SparkSession, folder: str, identity: dict[str, str]) -> None:
    """Store what the sink was started for; refuse to go on with anything else."""
    path = f"{folder.rstrip('/')}/_identity"
    schema = "name string, value string"
    try:
        stored = {row["name"]: row["value"] for row in spark.read.schema(schema).parquet(path).collect()}
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        spark.createDataFrame(sorted(identity.items()), schema).coalesce(1).write.parquet(path)
        return
    if stored != identity:
        changed = sorted(k for k in {*stored, *identity} if stored.get(k) != identity.get(k))
        raise RuntimeError(f"sink was started with other settings: {changed}")


def run_to_end(query: StreamingQuery) -> None:
    query.awaitTermination()


def ingest(stream: DataFrame, key: str, raw: str, sink: str) -> StreamingQuery:
    """Append each record once, with its JSON verdict, and count every micro-batch.

    Duplicate keys are dropped by keyed state before the sink. Both outputs are
    written under the batch number and replaced when a batch runs again, so a
    restart neither loses nor repeats rows.
    """
    checked = stream.withColumn("malformed", ~F.coalesce(is_json_object(F.col(raw)), F.lit(False)))
    unique = checked.dropDuplicates([key])

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        rows.write.mode("overwrite").parquet(f"{sink}/records/batch={batch_id}")
        rows.agg(F.count(F.lit(1)).alias("records"), F.count_if("malformed").alias("malformed")).write.mode(
            "overwrite").parquet(f"{sink}/counters/batch={batch_id}")
        rows.unpersist()

    return unique.writeStream.foreachBatch(write).option(
        "checkpointLocation", f"{sink}/_checkpoint").trigger(availableNow=True).start()


def score_resumable(stream: DataFrame, score: Callable[[DataFrame], DataFrame], sink: str,
                    identity: dict[str, str]) -> StreamingQuery:
    """Score new files with a frozen model; a rerun continues after the last batch.

    The sink is locked to ``identity`` (model and population fingerprints): a
    run with another model is refused instead of mixing its results in.
    """
    lock_identity(stream.sparkSession, sink, identity)
    return score(stream).writeStream.format("parquet").option("path", f"{sink}/scores").option(
        "checkpointLocation", f"{sink}/_checkpoint").outputMode("append").trigger(availableNow=True).start()


def route(stream: DataFrame, confidence: str, threshold: float, sink: str) -> StreamingQuery:
    """Stateless routing: accepted and review records go to separate folders."""
    routed = stream.withColumn("route", selective.route(F.col(confidence), threshold))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("route").parquet(f"{sink}/routed/batch={batch_id}")

    return routed.writeStream.foreachBatch(write).option(
        "checkpointLocation", f"{sink}/_checkpoint").trigger(availableNow=True).start()


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def running_totals(stream: DataFrame, key: str, group: str, raw: str, value: str, sink: str) -> StreamingQuery:
    """Totals of each group over all batches so far, written under the batch number for each batch that changed them.

    Records whose ``key`` came before are dropped first. Both states outlive the
    query: one that is started again on the same sink goes on where the last one stopped.
    A value that is null or not a number adds nothing.
    """
    checked = stream.select(
        key, F.col(group).alias("group"), F.coalesce(F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")), F.lit(0.0)).alias("value"),
        (~F.coalesce(is_json_object(F.col(raw)), F.lit(False))).alias("malformed"))
    totals = checked.dropDuplicates([key]).groupBy("group").agg(
        F.count(F.lit(1)).alias("records"), F.count_if("malformed").alias("malformed"), F.sum("value").alias("total"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/totals/batch={batch_id}")

    spark = stream.sparkSession
    before = spark.conf.get(STATE_STORE)
    # Both states grow with the stream: this store keeps them outside the heap. A query keeps the settings it was started with.
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        return totals.writeStream.foreachBatch(write).outputMode("update").option(
            "checkpointLocation", f"{sink}/_checkpoint").trigger(availableNow=True).start()
    finally:
        spark.conf.set(STATE_STORE, before)


def latest_totals(spark: SparkSession, sink: str) -> DataFrame:
    """The totals as the last batch that changed them left them, with the number of such batches."""
    rows = spark.read.parquet(f"{sink}/totals")
    return rows.groupBy("group").agg(
        F.max_by(F.struct("records", "malformed", "total"), "batch").alias("last"), F.count(F.lit(1)).alias("batches")).select("group", "last.*", "batches")
