"""Fitted models kept in the shared folder, so that a model is fitted once for its input and not in every query."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame

from pressmill.session import files_of, keep, shared_dir

Model = TypeVar("Model")


def fitted(name: str, make: Callable[[], Model], *inputs: DataFrame, **parameters: object) -> Model:
    """What ``make`` returns, or what it returned before for the same input files, their size, and parameters.

    Inputs that are no files have no lasting name, and their models are not kept. A kept model is a written table of one
    row; one that is only partly written is made again.
    """
    spark = inputs[0].sparkSession
    files = [sorted(i.inputFiles()) for i in inputs]
    if not all(files):
        return make()
    size = [int(i._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) for i in inputs]
    key = hashlib.sha256(repr((name, files, size, [i.columns for i in inputs], sorted(parameters.items()))).encode()).hexdigest()[:32]
    path = f"{shared_dir(spark)}/pressmill-models/{name}-{key}"
    if files_of(spark, path, done=True):
        return pickle.loads(spark.read.parquet(path).first()["model"])
    model = make()
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        keep(spark, path)
    spark.createDataFrame([(bytearray(pickle.dumps(model)),)], "model binary").coalesce(1).write.mode("overwrite").parquet(path)
    return model
