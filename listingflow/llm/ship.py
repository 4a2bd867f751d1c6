"""Give the executors this package, as ``--py-files`` does."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows of an Arrow batch, unless the application has its own setting: a task holds a few
#: batches of whole texts at a time, outside of the heap and in its worker.
BATCH, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000

_PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application. Spark serves the archive from the driver to each executor."""
    if not spark.sparkContext.getConf().contains(BATCH):
        spark.conf.set(BATCH, ROWS)
    app = spark.sparkContext.applicationId
    if app not in _shipped and _PACKAGE.is_dir():
        archive = Path(tempfile.mkdtemp()) / _PACKAGE.name
        spark.sparkContext.addPyFile(shutil.make_archive(str(archive), "zip", _PACKAGE.parent, _PACKAGE.name))
    _shipped.add(app)
