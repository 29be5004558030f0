"""The folder that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Where each session's own folder is when the cluster names none (local mode only).
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; in local mode without that setting, a temporary one.

    On a cluster without the setting this raises, since no other folder is known to be shared.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="linescope-")
    return _own[app]


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new name in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
