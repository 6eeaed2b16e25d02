"""The shared folder, where work that has to be written in between goes."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import SparkSession


@functools.lru_cache(1)
def _own() -> str:
    return f"file://{tempfile.mkdtemp(prefix='lexiloom-')}"


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and all executors see. Where that is unset, a session on this machine alone (tests) gets a local folder; on a cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own()
    return f"{base.rstrip('/')}/lexiloom-{uuid.uuid4().hex}"
