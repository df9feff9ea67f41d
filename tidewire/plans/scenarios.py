"""Scenario grids, experiment lists, client assignments and subscriptions.

Every product here is spread from its own definition row, so definitions are
independent and no two tables are crossed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.lists import nonempty_tokens, token_or_last, tokens
from tidewire.functions.ranges import expand_range, number_text
from tidewire.schemas import (
    COMMON_DIMENSIONS,
    EXCLUSIVE_COUNT,
    EXCLUSIVE_TIME,
    NETWORK_DIMENSIONS,
    STRATEGY_DIMENSIONS,
)


def _texts(limits: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.replace(number_text(F.col(limits), v), F.lit("."), F.lit("_")))


def _whole_texts(values: Column) -> Column:
    return F.transform(values, lambda v: v.cast("bigint").cast("string"))


#: Combinations that one row of the spread grid stands for.
GRID_BLOCK = 4096


def scenario_grid(configs: DataFrame, exclusive: str, keys: Sequence[str] = ("config",)) -> DataFrame:
    """All combinations of the dimensions of each definition, with their names.

    ``exclusive`` picks the goal: test duration or number of messages. Combinations are numbered; a
    number's digits, in a system whose places have as many digits as the dimensions have values, are
    the places of its values. Blocks of numbers are dealt to all tasks, so that a definition of very
    many combinations is the work of many. A dimension without values leaves none.
    """
    dims = [(d, F.col(f"common.{d}")) for d in COMMON_DIMENSIONS]
    dims += [(d, F.col(f"network.{d}")) for d in NETWORK_DIMENSIONS]
    dims.append((exclusive, F.col(f"exclusive.{exclusive}")))
    names = [d for d, _ in dims] + STRATEGY_DIMENSIONS
    spelled = [*COMMON_DIMENSIONS[:3], "messageSizeBytes", exclusive]
    # The outer form keeps Spark from expanding the ranges a second time in a size filter.
    values = configs.select(
        *keys,
        F.explode_outer(F.array(F.transform(F.array(*[r for _, r in dims]), expand_range))).alias("_values"),
        *[F.col(s).alias(f"_{s}") for s in STRATEGY_DIMENSIONS],
        *[F.col(f"common.{d}").alias(f"_{d}_range") for d in COMMON_DIMENSIONS[:3]],
    )
    lists = {d: F.col("_values")[i] for i, (d, _) in enumerate(dims)}
    lists |= {s: F.filter(f"_{s}", lambda v: v.isNotNull()) for s in STRATEGY_DIMENSIONS}
    # Texts belong to the few values of a range, not to its many combinations.
    texts = {d: _texts(f"_{d}_range", lists[d]) for d in COMMON_DIMENSIONS[:3]}
    texts |= {d: _whole_texts(lists[d]) for d in spelled[3:]}
    sizes = {n: F.greatest(F.coalesce(F.size(lists[n]), F.lit(0)), F.lit(0)).cast("bigint") for n in names}
    sized = values.select(
        *keys,
        *[lists[n].alias(f"_{n}") for n in names],
        *[texts[d].alias(f"_{d}_text") for d in spelled],
        *[sizes[n].alias(f"_{n}_size") for n in names],
    )
    # What a place is worth: the combinations of the dimensions after it.
    worth = "1L"
    for n in reversed(names):
        sized = sized.withColumn(f"_{n}_place", F.expr(worth))
        worth = f"_{n}_place * _{n}_size"
    sized = sized.withColumn("_n", F.expr(worth))
    last_block = F.expr(f"(_n - 1) div {GRID_BLOCK}")
    blocks = sized.filter("_n > 0").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), last_block)))
    tasks = int(configs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = F.col("_block") * GRID_BLOCK
    grid = blocks.repartition(tasks, *keys, "_block").withColumn(
        "_at", F.explode(F.sequence(first, F.least(first + GRID_BLOCK, F.col("_n")) - 1))
    )
    digits = grid.withColumns(
        {f"_{n}_digit": F.expr(f"cast(_at div _{n}_place % _{n}_size AS int)") for n in names}
    )
    unit = "s" if exclusive == EXCLUSIVE_TIME else "m"
    p, c, t, size, goal = (F.get(f"_{d}_text", F.col(f"_{d}_digit")) for d in spelled)
    name = F.concat(
        p, F.lit("p"), c, F.lit("c"), t, F.lit("t"), size, F.lit("b-"), goal, F.lit(unit)
    )
    other = EXCLUSIVE_COUNT if exclusive == EXCLUSIVE_TIME else EXCLUSIVE_TIME
    return digits.select(
        *keys,
        name.alias("name"),
        *[F.get(f"_{n}", F.col(f"_{n}_digit")).alias(n) for n in names],
        F.lit(None).cast("double").alias(other),
    )


def scenarios_of(configs: DataFrame, keys: Sequence[str] = ("config",)) -> DataFrame:
    """The scenarios of each definition, message counts and durations, as the client settings take them."""
    both = scenario_grid(configs, EXCLUSIVE_COUNT, keys).unionByName(scenario_grid(configs, EXCLUSIVE_TIME, keys))
    settings = {
        "n_producers": "numProducersPerTopic",
        "n_consumers": "numConsumers",
        "n_topics": "numTopics",
        "pub_rate": "producerWaitInMicroSeconds",
        "message_size": "messageSizeBytes",
        "n_messages": EXCLUSIVE_COUNT,
        "duration": EXCLUSIVE_TIME,
        "backlog_size": "backlogSizeMessages",
    }
    return both.select(
        *keys,
        "name",
        *[F.col(d).cast("bigint").alias(n) for n, d in settings.items()],
        F.col("consumerAssignmentStrategy").alias("consumer_strategy"),
    )


def experiment_list(batches: DataFrame, keys: Sequence[str], modes: str = "modes") -> DataFrame:
    """Batch, technology and goal in run order: message counts before durations."""
    goals = F.filter(
        F.array(
            F.when(F.col(modes).contains("m"), F.lit(EXCLUSIVE_COUNT)),
            F.when(F.col(modes).contains("d"), F.lit(EXCLUSIVE_TIME)),
        ),
        lambda x: x.isNotNull(),
    )
    return (
        batches.select(
            *keys,
            "technologies",
            goals.alias("goals"),
            F.posexplode("scenario_batch").alias("batch_position", "file"),
        )
        .select(
            *keys,
            "batch_position",
            F.split("file", r"\.json").getItem(0).alias("scenario"),
            F.posexplode("technologies").alias("tech_position", "tech"),
            "goals",
        )
        .select(*keys, "batch_position", "scenario", "tech_position", "tech", F.explode("goals").alias("goal"))
    )


def _topic_names(n: str = "n_topics"):
    return F.when(
        F.col(n) > 0,
        F.transform(F.sequence(F.lit(0), F.col(n).cast("int") - 1), lambda i: i.cast("string")),
    ).otherwise(F.array().cast("array<string>"))


def _numbered(df: DataFrame, count: str) -> DataFrame:
    return df.filter(F.col(count) > 0).withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.col(count).cast("int") - 1))
    )


def publisher_configs(scenarios: DataFrame, key: str = "scenario_id") -> DataFrame:
    """One row per producer; each is assigned every topic."""
    return _numbered(scenarios, "n_producers").select(
        key,
        F.concat(F.lit("P"), F.col("i")).alias("pub_id"),
        _topic_names().alias("topics"),
        "pub_rate",
        "message_size",
        "n_messages",
        "duration",
        "n_consumers",
    )


def consumer_configs(scenarios: DataFrame, key: str = "scenario_id") -> DataFrame:
    """One row per consumer: a topic in turn, all topics, or none."""
    strategy = F.col("consumer_strategy")
    turn = F.array(F.pmod(F.col("i"), F.col("n_topics")).cast("string"))
    assigned = (
        F.when(strategy == "round-robin", turn)
        .when(strategy == "shared", _topic_names())
        .otherwise(F.array().cast("array<string>"))
    )
    return _numbered(scenarios, "n_consumers").select(
        key,
        F.concat(F.lit("C"), F.col("i")).alias("con_id"),
        assigned.alias("topics"),
        "backlog_size",
    )


def config_documents(configs: DataFrame, key: str, client: str) -> DataFrame:
    """Client settings as JSON, nulls kept, one document per client."""
    fields = [c for c in configs.columns if c != key]
    return configs.select(
        key,
        F.col(client).alias("client_id"),
        F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("document"),
    )


def validate_scenarios(scenarios: DataFrame) -> DataFrame:
    """``has_one_goal``: either a message count or a duration, never both or none."""
    goal = F.col("n_messages").isNull() != F.col("duration").isNull()
    return scenarios.withColumn("has_one_goal", goal)


def subscription_pairs(publishers: DataFrame, consumers: DataFrame, key: str = "scenario_id") -> DataFrame:
    """Every (topic, publisher) a consumer follows, with the place of both.

    The join runs on scenario and topic; a topic repeated in a consumer's
    filter still gives each publisher once.
    """
    offered = publishers.select(
        key, F.col("pub_id").alias("publisher"), F.posexplode("topics").alias("topic_position", "topic")
    ).dropDuplicates([key, "publisher", "topic"])
    wanted = consumers.select(key, "con_id", F.explode(F.array_distinct("topics")).alias("topic"))
    return wanted.join(offered, [key, "topic"]).select(
        key, "con_id", "topic", "topic_position", "publisher"
    )


def publisher_subscriptions(clients: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct (publisher, topic) of the positional lists in a client's settings."""
    return (
        clients.select(
            *keys, "endpoints", F.posexplode(tokens(F.col("topics"))).alias("i", "topic")
        )
        .select(*keys, "topic", token_or_last(F.col("endpoints"), F.col("i")).alias("publisher"))
        .filter((F.col("topic") != "") & (F.col("publisher") != ""))
        .distinct()
    )


def topic_subscriptions(clients: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct topics of a client's settings; the list is made unique in its row."""
    return clients.select(
        *keys, F.explode(F.array_distinct(nonempty_tokens(F.col("topics")))).alias("topic")
    )
