"""Small helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as the word rules of this subpackage see it.
SPACES = r"\x20\x09-\x0D"

#: A-Z to a-z on bytes; every other byte stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def free_name(columns: Iterable[str], base: str) -> str:
    """``base``, with underscores added until no column has that name in any case."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def as_bytes(texts: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a text column, without decoding."""
    return texts.cast(pa.binary()).to_pylist()


def in_slices(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows at most, so that what is made of them stays small."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


_held: dict[str, tuple[object, object]] = {}


def per_worker(owner: str, key: object, make: Callable[[], object]) -> object:
    """An operator's object that a worker keeps between tasks.

    Workers serve all operators in turn, so another operator's object is given up for it.
    """
    if owner not in _held or _held[owner][0] != key:
        give_up()
        _held[owner] = key, make()
    return _held[owner][1]


def give_up() -> None:
    """Return the memory that earlier operators kept in this worker."""
    _held.clear()
    gc.collect()
    give_back()


def give_back() -> None:
    """Return to the system what this worker has freed; idle workers count like busy ones."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not a glibc


def col(df: DataFrame, name: str) -> Column:
    """Column by its exact name, dots and all."""
    return df["`" + name.replace("`", "``") + "`"]


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))
