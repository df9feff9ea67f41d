"""Value ranges of a scenario, expanded inside the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _second_phase(r: Column) -> Column:
    """A midpoint and second step count only when both are given and not zero."""
    return F.coalesce((r["midpoint"] != 0) & (r["step2"] != 0), F.lit(False))


def _before_first(r: Column) -> Column:
    return F.when(r["step_operator"] == "+", r["lower"] - r["step"]).otherwise(
        r["lower"] / F.nullif(r["step"], F.lit(0.0))
    )


def _grows(operator: Column, step: Column, at: Column) -> Column:
    return F.when(operator == "+", step > 0).otherwise((step > 1) & (at > 0))


def range_ends(r: Column) -> Column:
    """Whether stepping through the range comes to an end.

    A range that never grows past its upper bound has no finite expansion.
    """
    first = _before_first(r)
    second = _second_phase(r)
    uses_first = ~second | (first < r["midpoint"])
    phase1 = ~uses_first | _grows(r["step_operator"], r["step"], first)
    phase2 = ~second | (r["midpoint"] > r["upper"]) | _grows(
        r["step_operator2"], r["step2"], F.greatest(first, r["midpoint"])
    )
    return F.coalesce((first > r["upper"]) | (phase1 & phase2), F.lit(False))


def _steps(operator: Column, step: Column, start: Column, end: Column) -> Column:
    """At least the number of steps from start until end is passed."""
    linear = F.ceil((end - start) / step)
    growth = F.ceil(F.ln(end / start) / F.ln(step))
    n = F.when(operator == "+", linear).otherwise(growth)
    return F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)) + 2


def expand_range(r: Column) -> Column:
    """All values of a range struct as ``array<double>``.

    Values are stepped one by one, so fractions round as repeated additions
    do. Whole-number ``+`` ranges, where that cannot matter, are computed by
    position.
    """
    plus = r["step_operator"] == "+"
    second = _second_phase(r)
    first = _before_first(r)
    whole = (
        plus
        & ~second
        & (r["lower"] == F.floor(r["lower"]))
        & (r["step"] == F.floor(r["step"]))
    )
    count = F.floor((r["upper"] - r["lower"]) / r["step"]).cast("bigint") + 1
    by_position = F.when(
        r["lower"] <= r["upper"],
        F.transform(
            F.sequence(F.lit(0).cast("bigint"), count - 1),
            lambda i: r["lower"] + i.cast("double") * r["step"],
        ),
    ).otherwise(F.array().cast("array<double>"))

    def following(cur: Column) -> Column:
        one = F.when(plus, cur + r["step"]).otherwise(cur * r["step"])
        two = F.when(r["step_operator2"] == "+", cur + r["step2"]).otherwise(cur * r["step2"])
        return F.when(second & (cur >= r["midpoint"]), two).otherwise(one)

    def walk(state: Column, _: Column) -> Column:
        nxt = following(state["cur"])
        ended = state["ended"] | (state["cur"] > r["upper"]) | (nxt > r["upper"])
        return F.struct(
            F.when(ended, state["cur"]).otherwise(nxt).alias("cur"),
            ended.alias("ended"),
            F.when(ended, state["out"]).otherwise(F.array_append(state["out"], nxt)).alias("out"),
        )

    bound = _steps(r["step_operator"], r["step"], first, r["upper"]) + F.when(
        second,
        _steps(r["step_operator2"], r["step2"], F.greatest(first, r["midpoint"]), r["upper"]),
    ).otherwise(F.lit(0))
    start = F.struct(
        first.alias("cur"), F.lit(False).alias("ended"), F.array().cast("array<double>").alias("out")
    )
    stepped = F.aggregate(
        F.sequence(F.lit(1).cast("bigint"), bound.cast("bigint")), start, walk, lambda s: s["out"]
    )
    values = F.when(whole, by_position).otherwise(stepped)
    return F.when(range_ends(r), values).otherwise(
        F.raise_error(F.concat(F.lit("range never ends: "), F.to_json(r))).cast("array<double>")
    )


def is_whole_range(r: Column) -> Column:
    """Whether the range is stepped in whole numbers, which decides its text form."""
    numbers = [r[c] for c in ("lower", "step", "step2")]
    whole = r["step_operator"] == "+"
    for n in numbers:
        whole = whole & F.coalesce(n == F.floor(n), F.lit(True))
    return whole


def double_text(value: Column) -> Column:
    """The shortest text of a double, with an exponent only below 1e-4 and from 1e16 on."""
    java = value.cast("string")
    plain = F.regexp_replace(java.cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
    digits = F.regexp_replace(F.regexp_extract(java, r"^(.*)E", 1), r"\.0$", "")
    power = F.regexp_extract(java, r"E(-?\d+)$", 1).cast("int")
    sign = F.when(power < 0, "e-").otherwise("e+")
    size = F.abs(power).cast("string")
    padded = F.when(F.length(size) < 2, F.lpad(size, 2, "0")).otherwise(size)
    small = (F.abs(value) < 1e-4) | (F.abs(value) >= 1e16)
    return (
        F.when(~java.contains("E"), java)
        .when(small, F.concat(digits, sign, padded))
        .otherwise(plain)
    )


def number_text(r: Column, value: Column) -> Column:
    return F.when(is_whole_range(r), value.cast("bigint").cast("string")).otherwise(
        double_text(value)
    )
