"""Makes this package importable in the Python workers of any cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Bytes of a batch of rows on its way to or from a Python worker, unless the session sets another number. Ten
#: thousand rows, Spark's own bound, could be any number of bytes where texts are long.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once for each application, and bounds the session's batches to Python."""
    sc = spark.sparkContext
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    if sc.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    at = os.path.join(tempfile.mkdtemp(prefix="corvane-ship-"), "corvane_package.zip")
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, str(Path(top.name) / f.relative_to(top)))
    sc.addPyFile(at)
    _SHIPPED.add(sc.applicationId)
