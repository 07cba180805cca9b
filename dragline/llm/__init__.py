"""Operators for training-data corpora.  Nothing else in the library imports this subpackage."""

import os
import pathlib

from pyspark import SparkContext


def _show_workers_the_package() -> None:
    """Let Python workers started from another folder import this package, as a checkout is not installed."""
    root = str(pathlib.Path(__file__).resolve().parents[2])
    places = [os.environ]
    if SparkContext._active_spark_context is not None:
        places.append(SparkContext._active_spark_context.environment)
    for place in places:
        paths = [p for p in place.get("PYTHONPATH", "").split(os.pathsep) if p]
        if root not in paths:
            place["PYTHONPATH"] = os.pathsep.join([*paths, root])


_show_workers_the_package()
