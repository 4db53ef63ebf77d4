"""Session helpers."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Rows of an Arrow batch: rows hold whole documents, of which the default of ten thousand makes tens of megabytes.
BATCH_ROWS = 500


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a context, so that Python functions find it there; and keep Arrow batches
    small, unless the session has a size of its own."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if getattr(sc, "_larkspan_shipped", False):
        return
    root = Path(__file__).resolve().parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    path = os.path.join(tempfile.mkdtemp(prefix="larkspan-code-"), "larkspan_code.zip")
    Path(path).write_bytes(buffer.getvalue())
    sc.addPyFile(path)
    sc._larkspan_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
