"""Making this package importable by the Python workers of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def workers_have_it(spark: SparkSession) -> bool:
    """Whether the workers' own path leads here already: only a local session's workers have the driver's."""
    paths = [Path(p or ".").resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    return spark.sparkContext.master.split("[")[0] == "local" and (ROOT in paths or Path.cwd() == ROOT)


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once per Spark context and only where they lack it."""
    sc = spark.sparkContext
    if getattr(sc, "_skyloom", None):
        return
    if not workers_have_it(spark):
        path = Path(tempfile.mkdtemp(prefix="skyloom-")) / "skyloom.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in [*sorted((ROOT / "skyloom").rglob("*.py")), *ROOT.glob("corpus_pipeline.py")]:
                z.write(f, f.relative_to(ROOT))
        sc.addPyFile(str(path))
    sc._skyloom = True
