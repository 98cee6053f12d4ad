"""Ships this package to the executors, for clusters where it isn't installed; keeps tables that several queries read."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_kept: dict[tuple[str, str], str] = {}


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip to the application, once."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="foliospark-"), "foliospark.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, f"foliospark/{file.relative_to(package)}")
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that spark.checkpoint.dir names; where it is unset, one of our own on a single machine and none on a cluster."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return None
    app = spark.sparkContext.applicationId
    return _kept.setdefault((app, ""), "file://" + tempfile.mkdtemp(prefix="foliospark-"))


def kept(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table make() gives, written once per application to the shared folder and read by all that ask for the name; made anew where there is no such folder."""
    folder, key = shared_folder(spark), (spark.sparkContext.applicationId, name)
    if folder is None:
        return make()
    if key not in _kept:
        path = f"{folder}/documents-{uuid.uuid4().hex}"
        make().write.parquet(path)
        _kept[key] = path
    return spark.read.parquet(_kept[key])
