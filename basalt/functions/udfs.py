"""How a vectorised function is applied: as it is, or under a registered name while SQL text is being written."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Registers a vectorised function and returns its name in SQL; unset outside the writing of SQL text.
REGISTER: ContextVar[Callable | None] = ContextVar("basalt_register", default=None)


def bound(udf) -> Callable[..., Column]:
    """The function on Columns: inline, or as a call by name where SQL text is written."""

    def call(*cols: Column) -> Column:
        register = REGISTER.get()
        return F.call_function(register(udf), *cols) if register else udf(*cols)

    return call
