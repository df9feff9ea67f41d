"""Comma-separated lists as they appear in client settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(c: Column) -> Column:
    """Entries of a list; an empty entry after the last comma does not exist."""
    parts = F.split(c, ",", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def nonempty_tokens(c: Column) -> Column:
    return F.filter(F.split(c, ","), lambda x: x != "")


def token_or_last(c: Column, i: Column) -> Column:
    """Entry ``i``; past the end the last entry stays in force.

    A list that is empty or closes with a comma is followed by empty entries.
    """
    parts = tokens(c)
    past = F.when((c == "") | c.endswith(","), F.lit("")).otherwise(F.element_at(parts, -1))
    return F.when(i < F.size(parts), F.get(parts, i)).otherwise(past)


def endpoint_list(c: Column, port: str) -> Column:
    """Hosts with the default port where none is given; never empty."""
    hosts = F.filter(
        F.transform(F.split(c, ","), lambda h: F.trim(h, F.lit(" \t"))), lambda h: h != ""
    )
    full = F.transform(
        hosts, lambda h: F.when(h.contains(":"), h).otherwise(F.concat(h, F.lit(f":{port}")))
    )
    return F.coalesce(
        F.nullif(F.array_join(full, ","), F.lit("")), F.lit(f"localhost:{port}")
    )
