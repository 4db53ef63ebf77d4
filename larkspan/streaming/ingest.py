"""Uploads as a stream: a landing folder to an idempotent table, and a gate for changed readings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larkspan.operators.readings import first_per_key, new_rows
from larkspan.schemas import migrate
from larkspan.sources import batches


def append_new(spark: SparkSession, rows: DataFrame, table_path: str) -> dict:
    """Accepted rows whose key is not stored, appended with ids that go on from the largest; counts as for an upload.

    Ids follow the order of (document, position) within ranges, without a sort in one task.
    """
    try:
        stored = spark.read.parquet(table_path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        stored = None
    rows = rows.withColumn("at", F.struct("batch", "pos")).persist()
    received = rows.count()
    fresh = first_per_key(rows, "sample_id", "at")
    if stored is not None:
        fresh = new_rows(fresh, stored)
    top = stored.agg(F.max("id")).first()[0] if stored is not None else None
    ordered = fresh.repartitionByRange("batch", "pos").sortWithinPartitions("batch", "pos").withColumn("part", F.spark_partition_id()).persist()
    sizes = {r[0]: r[1] for r in ordered.groupBy("part").count().collect()}  # a row for each partition
    start, base = {}, (top or 0) + 1
    for p in sorted(sizes):
        start[p] = base
        base += sizes[p]
    inserted = sum(sizes.values())
    if inserted:
        first = F.create_map(*(F.lit(v) for kv in start.items() for v in kv))
        within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        out = ordered.withColumn("id", F.element_at(first, F.col("part")).cast("long") + within).withColumn("received_at", F.current_timestamp())
        migrate(out).write.mode("append").parquet(table_path)
    ordered.unpersist()
    rows.unpersist()
    return {"received": received, "inserted": inserted, "skipped": received - inserted}


def start(spark: SparkSession, landing: str, table_path: str, checkpoint: str, rejects: str | None = None, on_counts: Callable[[dict], None] | None = None, every: str | None = None) -> StreamingQuery:
    """Each new document of ``landing`` is validated and stored once, however late or often it comes: keys are compared with
    the whole table, no watermark drops any. Without ``every`` the stream ends when it has caught up."""
    lines = spark.readStream.format("text").option("wholetext", True).load(landing).select(F.col("_metadata.file_path").alias("batch"), F.col("value").alias("body"))

    def store(bodies: DataFrame, epoch: int) -> None:
        samples = batches.parsed(bodies).persist()
        counts = append_new(bodies.sparkSession, batches.accepted(samples), table_path)
        if rejects:
            bad = batches.verdicts(samples).where(F.size("errors") > 0)
            bad.withColumn("epoch", F.lit(epoch)).write.mode("append").json(rejects)
        samples.unpersist()
        if on_counts:
            on_counts(counts)

    writer = lines.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


_GATE = "session_id string, id long, recorded_at timestamp, rsrp double, rsrq double, sinr double"


def _gate(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = list(state.get) if state.exists else None
    for f in frames:
        keep = []
        for row in f.sort_values(["recorded_at", "id"]).itertuples(index=False):
            now = [None if pd.isna(v) else float(v) for v in (row.rsrp, row.rsrq, row.sinr)] + [None if pd.isna(row.modem_reported_at) else row.modem_reported_at.isoformat()]
            same = last is not None and (now[:3] == last[:3] or now[3] is not None and now[3] == last[3])
            if not same:
                keep.append((key[0], row.id, row.recorded_at, *now[:3]))
            last = now
        yield pd.DataFrame(keep, columns=["session_id", "id", "recorded_at", "rsrp", "rsrq", "sinr"])
    state.update(tuple(last))


def changed_readings(stream: DataFrame) -> DataFrame:
    """Readings of a stream that differ from the one before in their session, for input in order of time within each session;
    the batch form is :func:`larkspan.operators.readings.run_starts`."""
    cols = stream.select(F.col("session_id").cast("string").alias("session_id"), "id", F.col("recorded_at").cast("timestamp").alias("recorded_at"), *(F.col(c).cast("double").alias(c) for c in ("rsrp", "rsrq", "sinr")), F.col("modem_reported_at").cast("timestamp").alias("modem_reported_at"))
    return cols.groupBy("session_id").applyInPandasWithState(_gate, _GATE, "rsrp double, rsrq double, sinr double, modem string", "append", GroupStateTimeout.NoTimeout)
