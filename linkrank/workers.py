"""The package on the Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Makes the package importable in Python workers, wherever they run. Once a session."""
    import linkrank

    context = spark.sparkContext
    if getattr(context, "_linkrank_shipped", None) is None:
        root = Path(next(iter(linkrank.__path__)))
        path = Path(tempfile.mkdtemp(prefix="linkrank-")) / "linkrank.zip"
        with zipfile.ZipFile(path, "w") as out:
            for f in sorted(root.rglob("*.py")):
                out.write(f, f.relative_to(root.parent))
        context.addPyFile(str(path))
        context._linkrank_shipped = path
    return spark
