"""Column expressions over fixed column names, built once per process.

Building an expression costs a call into the JVM per operator, seconds for the
largest ones here, while a finished Column can be used in any number of queries.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from typing import ParamSpec, TypeVar

from pyspark import SparkContext

P = ParamSpec("P")
T = TypeVar("T")


def shared(build: Callable[P, T]) -> Callable[P, T]:
    """Remember the results of ``build`` for as long as the JVM lives."""
    results: dict = {}

    @functools.wraps(build)
    def get(*args: P.args, **kwargs: P.kwargs) -> T:
        gateway = getattr(SparkContext, "_gateway", None)
        key = (args, tuple(sorted(kwargs.items())))
        if results.get("gateway") is not gateway:
            results.clear()
            results["gateway"] = gateway
        if key not in results:
            results[key] = build(*args, **kwargs)
        return results[key]

    return get
