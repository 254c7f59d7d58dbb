"""Session settings that the operators expect."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()

SETTINGS = {
    "spark.sql.ansi.enabled": "true",  # overflow and bad casts raise
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.decimalOperations.allowPrecisionLoss": "false",
}


def session(app: str = "quarryframe", master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Gives the package to the executors' Python workers, once an application, wherever it is installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted([*root.glob("quarryframe/**/*.py"), *root.glob("corpus_pipeline.py")]):
            z.write(path, path.relative_to(root))
    target = os.path.join(tempfile.mkdtemp(prefix="quarryframe-code-"), "quarryframe.zip")
    Path(target).write_bytes(content.getvalue())
    context.addPyFile(target)  # served by the driver, so no shared folder is needed
    _shipped.add(context.applicationId)
