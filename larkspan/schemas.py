"""Explicit schemas: stored measurements by version, uploaded batches, claims, roads, surfaces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NETWORK_TYPES = ("LTE", "5G-NR", "none")
METRICS = ("rsrp", "rsrq", "sinr")


_V1 = [
    ("id", T.LongType(), False), ("sample_id", T.StringType(), False), ("session_id", T.StringType(), False), ("recorded_at", T.TimestampType(), False),
    ("lon", T.DoubleType(), False), ("lat", T.DoubleType(), False), ("rsrp", T.DoubleType(), True), ("rsrq", T.DoubleType(), True), ("sinr", T.DoubleType(), True),
    ("network_type", T.StringType(), False), ("cell_id", T.StringType(), True), ("speed_mps", T.DoubleType(), True), ("heading_deg", T.DoubleType(), True),
    ("carrier", T.StringType(), False), ("received_at", T.TimestampType(), False),
]
#: Columns that later versions add, all nullable.
_ADDED = {2: [("modem_reported_at", T.TimestampType(), True)]}
LATEST = max(_ADDED)


def measurements(version: int = LATEST) -> T.StructType:
    """Stored measurements as of a schema version."""
    fields = [*_V1, *(f for v in range(2, version + 1) for f in _ADDED[v])]
    return T.StructType([T.StructField(*f) for f in fields])


def migrate(df: DataFrame, version: int = LATEST) -> DataFrame:
    """``df`` of any version with the columns of another: missing nullable ones are null, later ones are dropped."""
    have = set(df.columns)
    for f in measurements(version):
        if f.name not in have and not f.nullable:
            raise ValueError(f"{f.name} is missing and has no default")
    return df.select(*(F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in measurements(version)))


SAMPLE = T.StructType(
    [
        T.StructField("sample_id", T.StringType()), T.StructField("recorded_at", T.StringType()), T.StructField("modem_reported_at", T.StringType()), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()),
        T.StructField("rsrp", T.DoubleType()), T.StructField("rsrq", T.DoubleType()), T.StructField("sinr", T.DoubleType()), T.StructField("network_type", T.StringType()), T.StructField("cell_id", T.StringType()),
        T.StructField("speed_mps", T.DoubleType()), T.StructField("heading_deg", T.DoubleType()), T.StructField("session_id", T.StringType()), T.StructField("carrier", T.StringType()),
    ]
)
POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
CLAIMS = T.StructType(
    [T.StructField("hex_ord", T.LongType()), T.StructField("h3_res9_id", T.StringType()), T.StructField("minsignal", T.DoubleType()), T.StructField("environmnt", T.IntegerType()), T.StructField("ring", T.ArrayType(POINT))]
    + [T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")]
)
