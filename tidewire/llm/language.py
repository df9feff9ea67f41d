"""Language identification by compression.

Every language has a raw-content zstandard dictionary made of labelled text. A text is folded to
lower-case words, compressed piece by piece with each dictionary, and belongs to the language whose
dictionary makes it smallest. A narrow margin between the two smallest is a rejection. zstandard
stores a piece as it is if compression saves only a few bytes, which makes a short piece equally long
under every dictionary; a text below ``SHORT`` bytes is therefore compressed ``COPIES`` times over,
and the end of a longer one is never cut off as a piece that short.

The dictionaries come from a bounded sample: at most ``texts_per_language`` texts of a language,
one per hash bucket of doc_id (chosen on narrow rows, with constant state per bucket), the first
``bytes_per_text`` bytes of each, ``dictionary_bytes`` per language. Beyond ``max_languages`` labels
texts and dictionaries become fewer and shorter in proportion, so every label is learned and what
is sent to the executors keeps its bound. Scoring is one map over whole texts, without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import col, give_back, per_worker

UNKNOWN = "und"
PIECE = 1024
SHORT = 64
COPIES = 8
LEVEL = 6
#: Share of the second smallest size by which the smallest must be below it.
NARROW = 0.02

_NOT_LETTERS = re.compile(r"[\W\d_]+")
RESULT = "lang string, score double, margin double"


@dataclass(frozen=True)
class Model:
    """Languages in order of their name, with the dictionary of each."""

    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]


def folded(text: str) -> bytes:
    """Lower-case words between single spaces; empty if there is no letter."""
    words = _NOT_LETTERS.sub(" ", text.lower()).strip()
    if not any(map(str.isalpha, words)):
        return b""
    return f" {words} ".encode()


def train(
    labelled: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    texts_per_language: int = 256,
    bytes_per_text: int = 4000,
    dictionary_bytes: int = 400_000,
    max_languages: int = 500,
) -> Model:
    """Dictionaries from a bounded sample of rows with a label and a text.

    Rows with a null label or text teach nothing. Without any labelled row the model is empty.
    """
    rows = labelled.select(
        col(labelled, doc_id).alias("id"),
        col(labelled, lang).cast("string").alias("lang"),
        col(labelled, text).cast("string").alias("text"),
    ).where("lang IS NOT NULL AND text IS NOT NULL")
    rank = F.xxhash64("id")
    picks = (
        rows.select("lang", "id", rank.alias("rank"))
        .groupBy("lang", F.pmod("rank", F.lit(texts_per_language)).alias("bucket"))
        .agg(F.min(F.struct("rank", "id")).alias("pick"))
        .select(F.col("lang").alias("of"), F.col("pick.id").alias("picked"), F.col("pick.rank").alias("rank"))
    )
    names = picks.select("of").distinct().count()
    share = max(1.0, names / max_languages)
    each = max(1, int(texts_per_language / share))
    dictionary_bytes = max(1, int(dictionary_bytes / share))
    if each < texts_per_language:
        # A language has at most texts_per_language picks, so a window holds no more.
        place = F.row_number().over(Window.partitionBy("of").orderBy("rank", "picked"))
        picks = picks.withColumn("place", place).where(F.col("place") <= each).drop("place")
    # At most texts_per_language * max_languages ids, or one per label, so broadcasting them is safe.
    chosen = rows.join(
        F.broadcast(picks),
        F.col("lang").eqNullSafe(F.col("of")) & F.col("id").eqNullSafe(F.col("picked")),
    )
    per_text = chosen.groupBy("lang", "rank").agg(
        F.min(F.substring("text", 1, bytes_per_text)).alias("text")
    )
    held: dict[str, list[tuple[int, str]]] = {}
    for r in per_text.collect():
        held.setdefault(r["lang"], []).append((r["rank"], r["text"]))
    languages, dictionaries = [], []
    for name in sorted(held):
        body = b"".join(folded(t)[:bytes_per_text] for _, t in sorted(held[name]))
        if body:
            languages.append(name)
            dictionaries.append(body[:dictionary_bytes])
    return Model(tuple(languages), tuple(dictionaries))


def pieces_of(body: bytes) -> list[bytes]:
    """Pieces of ``PIECE`` bytes; an end below ``SHORT`` stays with the piece before it."""
    last = max(len(body) - SHORT, 0) // PIECE * PIECE
    if len(body) < SHORT:
        return [body * COPIES]
    return [*(body[a : a + PIECE] for a in range(0, last, PIECE)), body[last:]]


class Scorer:
    """Compressors of a model, one per language."""

    def __init__(self, model: Model):
        self.languages = model.languages
        self.compressors = []
        for body in model.dictionaries:
            params = zstandard.ZstdCompressionParameters.from_level(
                LEVEL,
                source_size=PIECE,
                dict_size=len(body),
                min_match=3,
                write_content_size=0,
                write_checksum=0,
                write_dict_id=0,
            )
            d = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.compressors.append(zstandard.ZstdCompressor(compression_params=params, dict_data=d))

    def sizes(self, body: bytes) -> list[int]:
        pieces = pieces_of(body)
        return [sum(len(c.compress(p)) for p in pieces) for c in self.compressors]

    def score(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin); ties go to the first name."""
        body = folded(text) if text else b""
        if not body or not self.languages:
            return UNKNOWN, 0.0, 0.0
        sizes = self.sizes(body)
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        best = sizes[order[0]]
        score = 1 / sum(math.exp(min(0.0, (best - s) / 4)) for s in sizes)
        margin = 1.0 if len(sizes) == 1 else (sizes[order[1]] - best) / sizes[order[1]]
        return self.languages[order[0]], score, margin


def scorer(model: Model) -> Scorer:
    """Built once per worker and model."""
    return per_worker("language", model, lambda: Scorer(model))


def identify(df: DataFrame, text: str, model: Model) -> Column:
    """A struct column ``lang, score, margin`` for the texts of ``df``.

    Null texts and texts without a letter get ``und`` with score and margin 0. Every row is scored
    on its whole text alone, so repeated rows get equal results.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        s = scorer(sent.value)
        for texts in batches:
            rows = [s.score(t) for t in texts.to_pylist()]
            names, scores, margins = zip(*rows) if rows else ((), (), ())
            yield pa.StructArray.from_arrays(
                [
                    pa.array(names, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array(margins, pa.float64()),
                ],
                names=["lang", "score", "margin"],
            )
        give_back()

    return of(col(df, text).cast("string"))


def rejected(result: Column, narrow: float = NARROW) -> Column:
    """Whether the language is unknown or the margin narrow."""
    return (result["lang"] == UNKNOWN) | (result["margin"] < narrow)
