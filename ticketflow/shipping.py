"""Makes the package importable for Python workers where the session was not started with it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

HOME = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Adds the package to the application, once, unless workers find it on their own path."""
    context = spark.sparkContext
    paths = [Path(p).resolve() for p in (*os.environ.get("PYTHONPATH", "").split(os.pathsep), ".") if p]
    if HOME in paths or getattr(ship, "to", None) == context.applicationId:
        return
    archive = Path(tempfile.mkdtemp(prefix="ticketflow-")) / "ticketflow.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((HOME / "ticketflow").rglob("*.py")):
            z.write(p, p.relative_to(HOME))
    context.addPyFile(str(archive))
    ship.to = context.applicationId
