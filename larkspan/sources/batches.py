"""Uploaded batches: nested JSON documents to validated sample rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspan.schemas import NETWORK_TYPES, SAMPLE

BATCH = T.StructType([T.StructField("session_id", T.StringType()), T.StructField("carrier", T.StringType()), T.StructField("samples", T.ArrayType(SAMPLE))])
#: Samples of a batch at most; a longer one is refused before it is looked at.
MAX_BATCH = 5000
_UUID = "^[0-9a-fA-F]{8}-?([0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}$"


def read(spark: SparkSession, path: str) -> DataFrame:
    """``batch`` (file name) and ``body`` of each document of a landing folder; gzip is undone by extension."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("batch"), F.col("value").alias("body"))


def _known(names: list[str]) -> Column:
    return F.array(*(F.lit(n) for n in names))


def parsed(bodies: DataFrame, max_batch: int = MAX_BATCH) -> DataFrame:
    """``batch, pos, sample, ...`` of every sample with ``errors``; a document that is refused as a whole has one row with a
    null position.

    A document is closed: keys that the schema doesn't have are errors. So are wrong types, since a value that doesn't fit
    reads as null where the document has one.
    """
    doc = F.from_json("body", BATCH)
    raw = F.from_json("body", "struct<samples: array<map<string,string>>>")
    keys = F.json_object_keys("body")
    rows = bodies.withColumns({"d": doc, "raw": raw, "keys": keys})
    size = F.size("d.samples")
    top = F.array_compact(
        F.array(
            F.when(F.col("keys").isNull(), "invalid_json"),
            F.when(F.col("keys").isNotNull() & (size > max_batch), "batch_too_large"),
            F.when(F.size(F.array_except("keys", _known(BATCH.names))) > 0, "extra_key"),
            F.when(F.col("keys").isNotNull() & ~F.coalesce(F.col("d.session_id").rlike(_UUID), F.lit(False)), "session_id"),
            F.when(F.col("keys").isNotNull() & ~F.coalesce(F.length("d.carrier") >= 1, F.lit(False)), "carrier"),
            F.when(F.col("keys").isNotNull() & ~F.coalesce(size >= 1, F.lit(False)), "samples"),
        )
    )
    rows = rows.withColumn("top", F.when(F.col("keys").isNull(), F.array(F.lit("invalid_json"))).otherwise(top))
    each = rows.select("batch", "top", F.col("d.session_id").alias("batch_session"), F.col("d.carrier").alias("batch_carrier"), F.posexplode_outer(F.when(size <= max_batch, F.arrays_zip(F.col("d.samples").alias("s"), F.col("raw.samples").alias("r")))).alias("pos", "x"))
    s, r = F.col("x.s"), F.col("x.r")
    given = lambda c: F.element_at(r, F.lit(c)).isNotNull()
    stamp = lambda c: F.try_to_timestamp(s[c])
    bad = [
        F.when(F.size(F.array_except(F.map_keys(r), _known(SAMPLE.names))) > 0, "extra_key"),
        F.when(~F.coalesce(s["sample_id"].rlike(_UUID), F.lit(False)), "sample_id"),
        F.when(stamp("recorded_at").isNull(), "recorded_at"),
        F.when(given("modem_reported_at") & stamp("modem_reported_at").isNull(), "modem_reported_at"),
        F.when(~F.coalesce(s["lat"].between(-90, 90), F.lit(False)), "lat"),
        F.when(~F.coalesce(s["lon"].between(-180, 180), F.lit(False)), "lon"),
        F.when(~F.coalesce(s["network_type"].isin(*NETWORK_TYPES), F.lit(False)), "network_type"),
        *(F.when(given(c) & s[c].isNull(), c) for c in ("rsrp", "rsrq", "sinr")),
        F.when(given("speed_mps") & ~F.coalesce(s["speed_mps"] >= 0, F.lit(False)), "speed_mps"),
        F.when(given("heading_deg") & ~F.coalesce((s["heading_deg"] >= 0) & (s["heading_deg"] < 360), F.lit(False)), "heading_deg"),
        F.when(given("session_id") & ~F.coalesce(s["session_id"].rlike(_UUID), F.lit(False)), "session_id"),
    ]
    errors = F.concat(F.col("top"), F.when(F.col("pos").isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*bad))))
    return each.select("batch", "pos", errors.alias("errors"), s.alias("sample"), "batch_session", "batch_carrier")


def verdicts(samples: DataFrame) -> DataFrame:
    """``batch, received, errors`` of each document; one bad sample refuses it all."""
    return samples.groupBy("batch").agg(F.count("pos").alias("received"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("errors")))).alias("errors"))


def accepted(samples: DataFrame) -> DataFrame:
    """Rows to store, of documents without an error; session and carrier of the sample, or where absent or empty of its document."""
    good = verdicts(samples).where(F.size("errors") == 0).select("batch")
    s = F.col("sample")
    rows = samples.join(good, "batch", "left_semi")
    uuid = lambda c: F.regexp_replace(F.lower(c), "^(.{8})-?(.{4})-?(.{4})-?(.{4})-?(.{12})$", "$1-$2-$3-$4-$5")
    return rows.select(
        "batch", "pos", uuid(s["sample_id"]).alias("sample_id"), uuid(F.coalesce(F.nullif(s["session_id"], F.lit("")), F.col("batch_session"))).alias("session_id"),
        F.try_to_timestamp(s["recorded_at"]).alias("recorded_at"), F.try_to_timestamp(s["modem_reported_at"]).alias("modem_reported_at"), s["lon"].alias("lon"), s["lat"].alias("lat"),
        *(s[c].alias(c) for c in ("rsrp", "rsrq", "sinr", "network_type", "cell_id", "speed_mps", "heading_deg")), F.coalesce(F.nullif(s["carrier"], F.lit("")), F.col("batch_carrier")).alias("carrier"),
    )
