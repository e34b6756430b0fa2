"""Vocabulary files of public tokenizers, read on the driver and shared with the executors.

A vocabulary file has a few MB at most (MOST_BYTES is checked), whatever the size of the corpus,
so one broadcast of its bytes is bounded.
"""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark import Broadcast
from pyspark.sql import SparkSession

MOST_BYTES = 64 << 20


def shared(spark: SparkSession, path: str) -> Broadcast:
    data = Path(path).read_bytes()
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} is no vocabulary: it has {len(data)} bytes")
    return spark.sparkContext.broadcast(data)


def default(name: str) -> str:
    return public_tokenizers.path(name)
