"""Models that a process loads once, and folders whose newest complete version is the one in use."""

from __future__ import annotations

import threading
import uuid
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEPT = 4  # models that a process holds
_loaded: OrderedDict = OrderedDict()
_lock = threading.Lock()
POINTER = "published"


def loaded(load: Callable, path: str, version: str = ""):
    """What `load(path)` gives, loaded once per process for each path and version.

    For use inside a scorer: every Python worker loads the model with its first batch and keeps it for
    the batches and tasks that follow. Of more than KEPT models the one not asked for longest is dropped.
    """
    with _lock:
        key = (path, version)
        if key not in _loaded:
            _loaded[key] = load(path)
            while len(_loaded) > KEPT:
                _loaded.popitem(last=False)
        _loaded.move_to_end(key)
        return _loaded[key]


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """Write a new version below `path` and make it the published one; returns its name.

    `write` gets a folder of its own. Only when it has returned is a row with the name added to the pointer table, so a
    version that is half written, or whose writer failed, is never seen, and readers of the version before are
    not disturbed. Of versions published at the same time the greatest (time, name) counts.
    """
    name = uuid.uuid4().hex
    write(f"{path}/versions/{name}")
    row = spark.range(1).select(F.current_timestamp().alias("at"), F.lit(name).alias("version"))
    row.coalesce(1).write.mode("append").parquet(f"{path}/{POINTER}")
    return name


def published(spark: SparkSession, path: str) -> tuple[str, str]:
    """(folder, name) of the published version."""
    rows: DataFrame = spark.read.schema("at timestamp, version string").parquet(f"{path}/{POINTER}")
    name = rows.agg(F.max(F.struct("at", "version"))["version"]).first()[0]
    if name is None:
        raise FileNotFoundError(f"nothing is published in {path}")
    return f"{path}/versions/{name}", name
