"""Incremental jobs over the event and embedding files; results are read back from the sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalumen.operators import profile, prototypes, scoring
from catalumen.plans.base import query, r6, table
from catalumen.plans.reliability import SQL_BASE, labelled_vectors, model_of
from catalumen.session import scratch_path
from catalumen.streaming import incremental


def table_stream(spark, sf_dir, name):
    """A table as a stream, whether it is one file or a folder of part files; a stream takes a single file only by a pattern."""
    return incremental.file_stream(spark, f"{sf_dir.rstrip('/')}/{{{name}}}.parquet", table(spark, sf_dir, name).schema)


def event_stream(spark, sf_dir):
    return table_stream(spark, sf_dir, "events")


@query("stream_ingest", """
SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS distinct_ids, count(*) FILTER (event_id % 50 = 0) AS malformed,
       round(sum(value), 2) AS total_value FROM events GROUP BY event_type""")
def stream_ingest(spark, sf_dir):
    """Each event arrives twice and some with broken JSON; each is kept once."""
    stream = event_stream(spark, sf_dir).withColumn(
        "props", F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("{broken "), "props")).otherwise(F.col("props")))
    sink = scratch_path(spark, "stream-ingest")
    doubled = stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    incremental.run_to_end(incremental.ingest(doubled, "event_id", "props", sink))
    return spark.read.parquet(f"{sink}/records").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("distinct_ids"),
        F.count_if("malformed").alias("malformed"), F.round(F.sum("value"), 2).alias("total_value"))


@query("stream_counters", """
SELECT count(*) AS records, 0::BIGINT AS malformed FROM events""")
def stream_counters(spark, sf_dir):
    """Running counters of the micro-batches, summed."""
    sink = scratch_path(spark, "stream-counters")
    incremental.run_to_end(incremental.ingest(event_stream(spark, sf_dir), "event_id", "props", sink))
    return spark.read.parquet(f"{sink}/counters").agg(
        F.sum("records").alias("records"), F.sum("malformed").alias("malformed"))


def scored_stream(spark, sf_dir):
    """Embeddings as a stream, scored with prototypes fitted beforehand."""
    base = labelled_vectors(spark, sf_dir)
    model = model_of(base)
    return table_stream(spark, sf_dir, "embeddings"), model


@query("stream_route", f"""WITH {SQL_BASE}
SELECT CASE WHEN conf >= 0.90 THEN 'accept' ELSE 'review' END AS route, count(*) AS n,
       count(*) FILTER (correct) AS correct FROM scored GROUP BY 1""")
def stream_route(spark, sf_dir):
    stream, model = scored_stream(spark, sf_dir)
    rows = prototypes.score_narrow(stream, model, "embedding", "label").select("vec_id", "conf", "correct")
    sink = scratch_path(spark, "stream-route")
    incremental.run_to_end(incremental.route(rows, "conf", 0.90, sink))
    return spark.read.parquet(f"{sink}/routed").groupBy("route").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("correct"))


@query("stream_score", f"""WITH {SQL_BASE} SELECT vec_id, pred, round(conf, 6) AS conf FROM scored""")
def stream_score(spark, sf_dir):
    """Resumable scoring: a second run of the same sink finds nothing left to do."""
    stream, model = scored_stream(spark, sf_dir)
    population = profile.population_fingerprints(table(spark, sf_dir, "embeddings"), {"ids": ["vec_id"]}).first()
    settings = {"population": population["fingerprint"], "classes": ",".join(map(str, model.classes))}
    sink = scratch_path(spark, "stream-score")

    def score(frame):
        return prototypes.score_narrow(frame, model, "embedding", "label").select("vec_id", "pred", "conf")

    for _ in range(2):
        incremental.run_to_end(incremental.score_resumable(stream, score, sink, settings))
    return spark.read.parquet(f"{sink}/scores").select("vec_id", "pred", r6("conf"))


@query("batch_score", """
SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS score FROM embeddings""")
def batch_score(spark, sf_dir):
    """A user-supplied model, loaded once per task and fed Arrow batches."""

    def make_model():
        import numpy as np

        def model(batch):
            norms = [float(np.sqrt(np.square(v.astype("float64")).sum())) for v in batch["embedding"]]
            return batch[["vec_id"]].assign(score=norms)

        return model

    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return scoring.batch_score(rows, make_model, "vec_id long, score double").select("vec_id", r6("score"))


EVENT_FILES = 4


@query("stream_restart", """
SELECT user_id, count(*) AS records, count(*) FILTER (event_id % 50 = 0) AS malformed, round(sum(value), 2) AS total,
  count(DISTINCT event_id % 4) AS batches FROM events GROUP BY user_id""")
def stream_restart(spark, sf_dir):
    """Totals over files of one batch each: two files, a stop, two more files and one that repeats earlier events."""
    events = table(spark, sf_dir, "events", "event_id", "user_id", "value", "props").withColumn(
        "props", F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("{broken "), "props")).otherwise(F.col("props")))
    source, sink = scratch_path(spark, "stream-files"), scratch_path(spark, "stream-totals")

    def arrive(rows):
        rows.coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = incremental.file_stream(spark, source, events.schema, files_per_batch=1)
        incremental.run_to_end(incremental.running_totals(stream, "event_id", "user_id", "props", "value", sink))

    for files in ((0, 1), (2, 3)):
        for i in files:
            arrive(events.filter(F.col("event_id") % EVENT_FILES == i))
        run()
    arrive(events.filter(F.col("event_id") % 3 == 0))
    run()
    return incremental.latest_totals(spark, sink).select(
        F.col("group").alias("user_id"), "records", "malformed", F.round("total", 2).alias("total"), "batches")
