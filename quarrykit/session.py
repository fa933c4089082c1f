"""Sessions, and shipping this package to Python workers."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Rows of an Arrow batch: rows here are whole texts, and a worker holds a few batches.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Makes this package importable in every Python worker of the session, once per application, and keeps Arrow batches small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    folder = tempfile.mkdtemp(prefix="quarrykit-")
    at = os.path.join(folder, "quarrykit.zip")
    Path(at).write_bytes(body.getvalue())
    context.addPyFile(at)
    _shipped.add(context.applicationId)


def session(name: str = "quarrykit", **conf: str) -> SparkSession:
    """A session with the settings the engine expects: adaptive plans, UTC, Arrow."""
    base = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    builder = SparkSession.builder.appName(name)
    for k, v in (base | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
