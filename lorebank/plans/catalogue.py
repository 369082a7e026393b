"""All registered queries: name → (Spark query, SQL twin or None)."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import lorebank
from lorebank.plans import library_queries, retrieval_queries, stream_queries
from lorebank.session import make_safe

CATALOGUE = {**retrieval_queries.QUERIES, **library_queries.QUERIES, **stream_queries.QUERIES}

_SHIPPED: set[str] = set()


def prepare(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Make the package importable by the session's Python workers and read times as UTC."""

    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        if app not in _SHIPPED:
            spark.sparkContext.addPyFile(_zipped())
            _SHIPPED.add(app)
        return run(make_safe(spark), sf_dir)

    call.__doc__ = run.__doc__
    return call


def _zipped() -> str:
    """The package as a zip for executors that do not share the driver's file system."""
    import shutil
    import tempfile

    root = os.path.dirname(os.path.dirname(os.path.abspath(lorebank.__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="spark-lorebank-", dir="/tmp"), "lorebank")
    return shutil.make_archive(target, "zip", root_dir=root, base_dir="lorebank")
