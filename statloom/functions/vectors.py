"""Arrow-batched helpers for small result tables, created when first used."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F


def vector_udf(returns: str):
    """Like ``pandas_udf`` with a type string, but needs no session at import time."""
    def wrap(fn):
        @functools.wraps(fn)
        def call(*cols):
            return F.pandas_udf(fn, returns)(*cols)
        return call
    return wrap
