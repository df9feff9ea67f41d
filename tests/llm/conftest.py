from __future__ import annotations

import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
sys.path.insert(0, os.path.dirname(os.path.dirname(HERE)))

#: Columns with names that the operators use themselves.
CLASHES = (
    "size source_size target copies leaks hits0 quality lines node shard start sketch kept kept_id "
    "copy row anchors language score copy_number mix_source"
).split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(
    f"{c} string" for c in CLASHES
)


@pytest.fixture(scope="session")
def table(spark):
    """Rows of (doc_id, text, lang, source) as a documents table with clashing extra columns."""

    def make(rows):
        full = [(d, t, lang, s, None, *CLASHES) for d, t, lang, s in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    prose = "One two three, four five six seven eight nine ten eleven twelve thirteen fourteen."
    long = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))
    return [
        (1, prose, "en", "a"),
        (2, prose, "en", "a"),
        (2, prose, "en", "a"),
        (3, prose.upper(), None, None),
        (4, None, "en", "b"),
        (5, "", None, "b"),
        (6, " \t\n ", "fr", None),
        (7, "12345 --- 678", "fr", "c"),
        (8, long, "de", "c"),
        (9, long, "de", None),
        (None, prose, "en", "a"),
        (None, None, None, None),
        (10, "x", "es", "a"),
        (11, "é ñ ü\u3000ß Straße naïve", "de", "a"),
        (12, "no\x00zero \u2028 line\r\nnext", "en", "b"),
    ]
