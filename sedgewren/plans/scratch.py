"""A folder for what registered queries publish."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession

_LOCAL: dict[str, str] = {}


def scratch_folder(spark: SparkSession) -> str:
    """Below spark.checkpoint.dir, which the driver and all executors share. Only a local session may leave it unset, and
    gets a temporary folder that goes when the process ends."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return f"{found.rstrip('/')}/sedgewren/{sc.applicationId}"
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="sedgewren-")
        atexit.register(shutil.rmtree, _LOCAL[sc.applicationId], ignore_errors=True)
    return "file://" + _LOCAL[sc.applicationId]
