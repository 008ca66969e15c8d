"""Small expression builders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once however often ``body`` names it.

    The optimizer may copy a computed column into each place that reads it; a variable of a lambda
    function is bound once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
