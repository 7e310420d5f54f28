"""Session factory and the shipping of this package to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: weakref.WeakSet = weakref.WeakSet()
BATCH_BYTES = str(16 << 20)  # of an Arrow batch: rows may be long texts, so a number of rows bounds nothing


def session(app: str = "corpusmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the engine expects: UTC, AQE and Arrow.

    ``conf`` keys use ``__`` for dots, as in ``spark__sql__shuffle__partitions="8"``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's source to the executors, once for each context.

    Executors fetch it from the driver over RPC, so Python workers can import the functions
    of UDFs even where the package isn't installed on the nodes. Their Arrow batches are bounded by bytes.
    """
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if sc not in _SHIPPED:
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="corpusmill-")
        atexit.register(shutil.rmtree, folder, True)
        target = os.path.join(folder, "corpusmill_src.zip")
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(target)
        _SHIPPED.add(sc)
    return spark
