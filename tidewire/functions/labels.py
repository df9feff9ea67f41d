"""Names and codes: container sources, payload kinds, log levels, series."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.schemas import KIND_FLAT, KIND_NAMES

# Log levels; any other name counts as INFO.
LOG_LEVELS = ["DEBUG", "INFO", "STUDY", "CONFIG", "ERROR"]


def file_stem(path: Column) -> Column:
    """File name without its last extension.

    Taken by length, as readers ask for it with every line.
    """
    name = F.element_at(F.split(path, "/"), -1)
    extension = F.substring_index(name, ".", -1)
    size = F.length(name) - F.length(extension) - 1
    return F.when((size > 0) & (extension != ""), F.left(name, size)).otherwise(name)


def source_label(stem: Column) -> Column:
    """``Broker`` for broker containers, else the text after the last dash."""
    return F.when(stem.contains("broker"), F.lit("Broker")).otherwise(
        F.element_at(F.split(stem, "-"), -1)
    )


def is_reported_source(source: Column) -> Column:
    """Producers and the broker; consumers are left out of resource curves."""
    return (source == "Broker") | source.startswith("P")


def kind_code(name: Column) -> Column:
    """Payload kind of a name; unknown, empty and null names mean FLAT."""
    code = F.lit(KIND_FLAT)
    for value, label in KIND_NAMES.items():
        if value != KIND_FLAT:
            code = F.when(name == label, F.lit(value)).otherwise(code)
    return code.cast("tinyint")


def kind_name(code: Column) -> Column:
    label = F.lit("UNKNOWN")
    for value, text in KIND_NAMES.items():
        label = F.when(code == value, F.lit(text)).otherwise(label)
    return label


def level_name(name: Column) -> Column:
    return F.when(name.isin(LOG_LEVELS), name).otherwise(F.lit("INFO"))


def level_of_line(line: Column) -> Column:
    """Level tag at the head of a raw log line."""
    return level_name(F.regexp_extract(line, r"^\[([A-Za-z]*)\]", 1))


def series_label(tech: Column, run: Column) -> Column:
    return F.concat(tech, F.lit(" ("), run, F.lit(")"))
