"""Operators of a large-scale training-data pipeline (no other part of the library imports them).

Tasks import this package by name. Python workers on this machine (local runs, tests) get its folder by
``PYTHONPATH``, whether Spark starts before or after the import; on a cluster pass it with ``--py-files``.
"""

import os

from pyspark.sql import SparkSession


def _worker_path() -> None:
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark = SparkSession.getActiveSession()
    for env in (os.environ, *([] if spark is None else [spark.sparkContext.environment])):
        parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
        if root not in parts:
            env["PYTHONPATH"] = os.pathsep.join([root, *parts])


_worker_path()
