"""Errors as data: planners report a code per row instead of stopping a job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Error code, exit class, HTTP status.
CODES = {
    "invalid-request": (2, 400),
    "unauthorized": (7, 401),
    "signature-invalid": (7, 403),
    "signature-expired": (7, 403),
    "source-changed": (4, 410),
    "not-found": (3, 404),
    "unsupported-format": (5, 415),
    "unsupported-source": (5, 501),
    "payload-too-large": (2, 413),
    "source-unreadable": (4, 500),
    "output-unwritable": (4, 500),
    "overloaded": (8, 503),
    "canceled": (6, 500),
    "catalog-unavailable": (4, 503),
    "internal": (1, 500),
}


def error(code: str, message: str | Column) -> Column:
    if code not in CODES:
        raise ValueError(code)
    return F.struct(F.lit(code).alias("code"), (message if isinstance(message, Column) else F.lit(message)).alias("message"))


def _looked_up(code: Column, at: int, missing: int) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for c, v in CODES.items() for x in (c, v[at])])[code], F.lit(missing))


def exit_class_of(code: Column) -> Column:
    """0 without an error, 1 for a code that is not known."""
    return F.when(F.coalesce(code, F.lit("")) == "", 0).otherwise(_looked_up(code, 0, 1))


def status_of(code: Column) -> Column:
    return _looked_up(code, 1, 500)
