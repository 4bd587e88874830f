"""This package on the path of a session's Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """The session, its workers able to import this package wherever the driver was started; done once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_storyscale_shipped", None) is None:
        root = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="storyscale-")) / "storyscale.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(target))
        sc._storyscale_shipped = str(target)
    return spark
