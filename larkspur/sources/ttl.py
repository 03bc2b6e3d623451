"""Expiry: documents whose time at a path has passed are invisible, and are removed by a purge."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.compile import negated, resolve


def _passed(df: DataFrame, path: str, now: dt.datetime) -> Column:
    """Whether the time at path is before now; only times count."""
    found = resolve(path, df.schema)
    if found is None or not isinstance(found[1], (T.TimestampType, T.TimestampNTZType)):
        return F.lit(False)
    at = now.astimezone(dt.timezone.utc) if now.tzinfo else now.replace(tzinfo=dt.timezone.utc)
    bound = F.lit(at.replace(tzinfo=None)).cast("timestamp_ntz") if isinstance(found[1], T.TimestampNTZType) else F.lit(at)
    return found[0] < bound


def visible(df: DataFrame, path: str, now: dt.datetime) -> DataFrame:
    """The documents that live at now."""
    return df.where(negated(_passed(df, path, now)))


def expired(df: DataFrame, path: str, now: dt.datetime) -> DataFrame:
    """The documents that don't."""
    return df.where(_passed(df, path, now))
