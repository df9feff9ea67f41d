"""License scans by diagonal voting, with DataFrame functions only.

Every run of two words of every text is joined by its hash to the places it has in the templates.
A hit votes for a diagonal: its place in the text less its place in the template, which is where
the template would begin. The votes of a diagonal are aggregated, neighbouring diagonals (words put
in or left out) are merged, and a span is verified by the share of the template's words that its
votes cover; every vote has compared the words themselves, so hashes decide nothing.

Two kinds of template: a *phrase* must stand word by word (one diagonal with all votes), a *notice*
may be altered (``share`` of its words within ``slack`` words of drift).

Scale: the text is read once and cut into words once; the templates' runs are an argument of the
caller, some hundred rows that Spark broadcasts by its own size rule. Votes are combined before the
shuffle, and only votes and one narrow row per document are shuffled, never text. A diagonal has at
most as many distinct votes as its template has words, and a merge looks at ``slack + 1`` diagonals, so
no group grows with the text. The words of one text are an array inside one row (some 60 bytes of
memory a word).
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm.common import col, text_or_empty

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words in a run.
RUN = 2
#: Words that may be put in or left out inside a notice.
SLACK = 3
#: Share of a notice's words that a span must cover.
SHARE = 0.8


class Template(NamedTuple):
    label: str
    words: str
    exact: bool = False


#: Phrases and their labels.
PHRASES = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
)

#: Well-known sentences of public licenses, as texts name or carry them.
NOTICES = (
    Template("apache", "licensed under the apache license version 2 0"),
    Template("apache", "you may not use this file except in compliance with the license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0"),
    Template("cc0", "the author has waived all copyright and related or neighboring rights to this work"),
    Template("gpl", "free software you can redistribute it and or modify it under the terms of the gnu"),
    Template("gpl-3", "licensed under the gnu general public license version 3"),
    Template("mit", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("mpl", "subject to the terms of the mozilla public license v 2 0"),
    Template("unlicense", "free and unencumbered software released into the public domain"),
)

TEMPLATES = PHRASES + NOTICES


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; Spark's faster ``lower`` where a text has no other letters to change."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))


def _runs(words: Column, run: int) -> Column:
    """All runs of ``run`` consecutive words, as structs."""
    n = F.greatest(F.size(words) - (run - 1), F.lit(0))
    parts = [F.slice(words, k + 1, n).alias(f"w{k}") for k in range(run)]
    return F.arrays_zip(*parts)


def _run_words(run: int, at: str) -> list[Column]:
    return [F.col(at)[f"w{k}"] for k in range(run)]


def _template_runs(spark: SparkSession, templates: tuple[Template, ...], run: int) -> DataFrame:
    """``hash, run, hits``: every distinct run and where templates have it."""
    rows = [{"t": i, **t._asdict()} for i, t in enumerate(templates)]
    named = spark.sql(
        "SELECT inline(from_json(:rows, 'array<struct<t int, label string, words string, exact boolean>>'))",
        args={"rows": json.dumps(rows)},
    )
    cut = named.select("t", "label", "exact", words_of(F.col("words")).alias("words"))
    placed = cut.select("t", "label", "exact", F.size("words").alias("n"), F.posexplode(_runs(F.col("words"), run)))
    hit = F.struct("t", "label", "exact", "n", F.col("pos").alias("at"))
    return placed.groupBy(F.col("col").alias("run")).agg(F.collect_list(hit).alias("hits")).select(
        F.xxhash64(*_run_words(run, "run")).alias("hash"), "run", "hits"
    )


def _diagonals(
    docs: DataFrame, doc_id: str, text: str, templates: tuple[Template, ...], run: int
) -> DataFrame:
    """``doc_id, key, n_words, t, label, exact, n, diagonal, votes, n_rows``.

    ``n_rows`` sums to the number of equal rows over a document's diagonals; documents without a
    vote have one row without a template.
    """
    short = [t.words for t in templates if len(t.words.split()) < run]
    if short:
        raise ValueError(f"templates shorter than {run} words: {short}")
    body = text_or_empty(col(docs, text))
    cut = docs.select(
        col(docs, doc_id).alias("doc_id"), F.xxhash64(body).alias("key"), words_of(body).alias("words")
    )
    placed = cut.select(
        "doc_id",
        "key",
        F.size("words").cast("long").alias("n_words"),
        F.posexplode_outer(_runs(F.col("words"), run)).alias("pos", "found"),
    ).withColumn("found_hash", F.xxhash64(*_run_words(run, "found")))
    known = _template_runs(docs.sparkSession, templates, run)
    same = F.col("found_hash") == F.col("hash")
    for a, b in zip(_run_words(run, "found"), _run_words(run, "run")):
        same = same & (a == b)
    opens = F.coalesce(F.col("pos"), F.lit(0)) == 0
    voted = placed.join(known, same, "left").where(opens | F.col("hits").isNotNull())
    voted = voted.select(
        "doc_id", "key", "n_words", "pos", F.posexplode_outer("hits").alias("which", "hit")
    )
    first = opens & (F.coalesce(F.col("which"), F.lit(0)) == 0)
    return voted.groupBy(
        "doc_id",
        "key",
        "n_words",
        *[F.col("hit")[f].alias(f) for f in ("t", "label", "exact", "n")],
        (F.col("pos") - F.col("hit.at")).alias("diagonal"),
    ).agg(F.collect_set("hit.at").alias("votes"), F.sum(first.cast("long")).alias("n_rows"))


def _covered(votes: Column, run: int) -> Column:
    """Words of the template that the votes cover."""
    further = F.sequence(F.lit(0), F.lit(run - 1))
    return F.array_distinct(F.flatten(F.transform(votes, lambda v: F.transform(further, lambda k: v + k))))


def _scored(
    docs: DataFrame,
    doc_id: str,
    text: str,
    templates: tuple[Template, ...],
    run: int,
    slack: int,
    share: float,
) -> DataFrame:
    """The diagonals, each with its coverage after merging and whether that verifies a span."""
    rows = _diagonals(docs, doc_id, text, templates, run)
    near = (
        Window.partitionBy("doc_id", "key", "t")
        .orderBy("diagonal")
        .rangeBetween(0, slack)
    )
    merged = F.flatten(F.collect_list("votes").over(near))
    votes = F.when(F.col("exact"), F.col("votes")).otherwise(F.array_distinct(merged))
    last = F.max(F.col("diagonal") + F.array_max("votes") + run).over(near)
    end = F.when(F.col("exact"), F.col("diagonal") + F.col("n")).otherwise(last)
    out = rows.withColumn("merged", votes).withColumn("end", end)
    coverage = F.size(_covered(F.col("merged"), run)) / F.col("n")
    out = out.withColumn("coverage", coverage)
    enough = F.when(F.col("exact"), F.size("votes") == F.col("n") - (run - 1)).otherwise(
        F.col("coverage") >= share
    )
    start = F.when(F.col("exact"), F.col("diagonal")).otherwise(
        F.col("diagonal") + F.array_min("votes")
    )
    return out.select(
        "doc_id", "key", "n_words", "t", "label", "exact", "n_rows", "coverage",
        start.cast("long").alias("start"), F.col("end").cast("long").alias("end"),
        F.coalesce(enough, F.lit(False)).alias("verified"),
    )


def find_spans(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    templates: tuple[Template, ...] = TEMPLATES,
    run: int = RUN,
    slack: int = SLACK,
    share: float = SHARE,
) -> DataFrame:
    """``doc_id, key, template, label, exact, start, end, coverage``: verified spans, in words.

    ``key`` is a hash of the text, as rows may share a doc_id; equal rows give their spans once.
    Overlapping spans of one notice are one span with the best coverage; places of a phrase stay
    apart. Null and empty texts have none. Other columns are not looked at.
    """
    found = _scored(docs, doc_id, text, templates, run, slack, share).where("verified")
    order = Window.partitionBy("doc_id", "key", "t").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.col("exact") | before.isNull() | (F.col("start") >= before)
    island = F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    named = found.withColumn("opens", opens.cast("int")).withColumn("island", island)
    return named.groupBy("doc_id", "key", F.col("t").alias("template"), "label", "exact", "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.max("coverage").alias("coverage")
    ).drop("island")


def scan(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    templates: tuple[Template, ...] = TEMPLATES,
    run: int = RUN,
    slack: int = SLACK,
    share: float = SHARE,
) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every row.

    Base columns speak of phrases, ``labels`` of phrases and notices, both distinct, sorted and
    comma-joined; ``score`` is the best coverage of a verified span. Without one, the places are
    null, the labels empty and the score 0. Null texts count as empty; repeated rows each give a row,
    a null doc_id is kept, rows that share a doc_id stay apart by their text, other columns are not
    looked at, and an empty table gives no rows. A template shorter than a run is refused.
    """
    rows = _scored(docs, doc_id, text, templates, run, slack, share)
    base = F.col("verified") & F.col("exact")

    def labels(which: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_set(F.when(which, F.col("label")))), ",")

    summed = rows.groupBy("doc_id", "key").agg(
        F.max("n_words").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("verified")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("verified"), F.col("coverage"))), F.lit(0.0)).alias("score"),
        F.sum("n_rows").alias("n_rows"),
    )
    one_each = summed.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
    return one_each.drop("key", "n_rows", "row")
