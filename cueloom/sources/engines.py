"""Recognisers by name. An engine gives raw words; running a model is not this package's business, so engines read what one wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import files

Engine = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return files.read_raw_words(spark, path)


def _table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("job_id", "seg", "pos", "w", "start_ms", "end_ms", "conf")


ENGINES: dict[str, Engine] = {"documents": _documents, "table": _table}


def get(name: str) -> Engine:
    if name not in ENGINES:
        raise KeyError(f"no engine {name!r}; there are {', '.join(sorted(ENGINES))}")
    return ENGINES[name]
