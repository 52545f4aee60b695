"""Sessions for this library."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application, for jobs that weren't submitted with it."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).parent
        with tempfile.TemporaryDirectory(prefix="ship-") as d:
            for f in package.rglob("*.py"):
                to = Path(d, "lib", package.name, f.relative_to(package))
                to.parent.mkdir(parents=True, exist_ok=True)
                shutil.copy(f, to)
            kept = tempfile.mkdtemp(prefix="shipped-")
            spark.sparkContext.addPyFile(shutil.make_archive(f"{kept}/{package.name}", "zip", f"{d}/lib"))
        _shipped.add(app)


def local_session(cores: int = 8, memory: str = "8g", name: str = "tracewright") -> SparkSession:
    """A session on this machine with the settings that the tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
