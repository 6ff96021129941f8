"""Python functions as column functions that get and give whole Arrow batches."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from ..shipping import ship


def arrow_udf(returns: str) -> Callable:
    """A function of one row's plain values (structs are dicts) as a function of columns: Python is called once a batch.
    Usable before there is a session: the type is read when the function is called."""

    def wrap(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def call(*columns) -> Column:
            ship(SparkSession.getActiveSession())
            n, kind = len(columns), to_arrow_type(DataType.fromDDL(returns))

            def run(*arrays: pa.Array) -> pa.Array:
                return pa.array([f(*row) for row in zip(*(a.to_pylist() for a in arrays[:n]), strict=True)], kind)

            # What is used twice is not merged into one expression with its use: nested lambda functions within the
            # arguments of a Python function can't be evaluated. Equal arguments are sent once.
            return F.arrow_udf(run, returns)(*columns, *columns)

        return call

    return wrap
