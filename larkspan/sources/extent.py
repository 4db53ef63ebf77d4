"""The extent that a stored set of claims was loaded for, beside it as a small JSON file."""

from __future__ import annotations

from pyspark.sql import DataFrame

from larkspan.operators.spatial import inside_bounds
from larkspan.sinks.documents import read_report, write_report

Box = tuple[float, float, float, float]


def load(claims: DataFrame, path: str, box: Box) -> None:
    """Stores claims with the box that they were read for."""
    claims.write.mode("overwrite").parquet(path)
    write_report(f"{path}.extent.json", {"bbox": list(box)})


def reuse(spark, path: str, needed: Box) -> DataFrame:
    """Stored claims, refused unless the box they were read for holds the one that is needed."""
    box = (read_report(f"{path}.extent.json") or {}).get("bbox")
    if not box or not inside_bounds(tuple(box), needed):
        raise ValueError(f"{path} was loaded for {box}, which does not hold {list(needed)}")
    return spark.read.parquet(path)
