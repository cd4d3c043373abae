"""Row-level frames written once per session and shared by the queries that need them.

The evaluation family reads one parsed frame; writing it as a Parquet table in the session's
checkpoint folder cuts the long parse lineage, survives lost executors and keeps column pruning.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pactlane.session import ensure_checkpoint_dir

_WRITTEN: dict[tuple[str, str, str], str] = {}


def written(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        ensure_checkpoint_dir(spark)
        path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
        build().write.parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])
