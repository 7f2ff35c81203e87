"""The package's own code on the workers, wherever the driver was started."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package, and what lies beside it as a module of its own, to all workers; once an application."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    _sent.add(context.applicationId)
    folder = tempfile.mkdtemp(prefix="siftstone-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    home = Path(__file__).parent
    with zipfile.ZipFile(f"{folder}/siftstone_code.zip", "w") as z:
        for file in sorted(home.rglob("*.py")):
            z.write(file, file.relative_to(home.parent))
    context.addPyFile(f"{folder}/siftstone_code.zip")
