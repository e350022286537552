"""Session defaults for local use and tests; a cluster brings its own session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A local session with UTC, AQE and few shuffle partitions."""
    n = cpus or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 2))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName("spanwood")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's code to the session's Python workers, once for each Spark application.

    Clusters on which the package is installed don't need it.
    """
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        folder = Path(tempfile.mkdtemp(prefix="spanwood-code-"))
        root = Path(__file__).resolve().parent
        with zipfile.ZipFile(folder / "spanwood.zip", "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, Path("spanwood") / p.relative_to(root))
        context.addPyFile(str(folder / "spanwood.zip"))
        _SHIPPED.add(context.applicationId)
    return spark


_SHIPPED: set[str] = set()
