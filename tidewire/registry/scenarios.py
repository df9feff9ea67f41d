"""Scenario, assignment and subscription queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.lists import endpoint_list
from tidewire.functions.ranges import expand_range
from tidewire.plans import scenarios as sc
from tidewire.registry import register
from tidewire.registry.tables import table
from tidewire.schemas import EXCLUSIVE_COUNT, EXCLUSIVE_TIME
from tidewire.sources.scenarios import parse_batch, parse_scenario


def _range(lower, upper, step, op="+", midpoint=None, step2=None, op2=None) -> Column:
    num = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("double")
    return F.struct(
        num(lower).alias("lower"),
        num(upper).alias("upper"),
        num(step).alias("step"),
        F.lit(op).alias("step_operator"),
        num(midpoint).alias("midpoint"),
        num(step2).alias("step2"),
        F.lit(op2).cast("string").alias("step_operator2"),
    )


@register(
    "scenario_ranges",
    """WITH RECURSIVE spec AS (
         SELECT p_partkey AS spec_id, CAST(CASE k WHEN 0 THEN p_partkey % 5 + 1 WHEN 1 THEN 16
                  WHEN 3 THEN p_size / 10.0::DOUBLE WHEN 5 THEN 10 ELSE 1 END AS DOUBLE) AS lower,
                CAST(CASE k WHEN 0 THEN p_partkey % 5 + 1 + p_size WHEN 1 THEN 4096 * (1 + p_partkey % 4)
                  WHEN 2 THEN 20 WHEN 3 THEN p_size / 10.0::DOUBLE + 2 WHEN 4 THEN 1000 ELSE 5 END AS DOUBLE) AS upper,
                CAST(CASE k WHEN 0 THEN 1 + p_size % 3 WHEN 1 THEN 2 + p_size % 3 * 7
                  WHEN 3 THEN 0.1::DOUBLE * (1 + p_size % 3) ELSE 1 END AS DOUBLE) AS step,
                CASE k WHEN 1 THEN '*' ELSE '+' END AS op,
                CAST(CASE k WHEN 2 THEN 4 + p_size % 5 WHEN 4 THEN 5 END AS DOUBLE) AS mid,
                CAST(CASE k WHEN 2 THEN 8 WHEN 4 THEN 2 END AS DOUBLE) AS step2,
                CASE k WHEN 2 THEN '+' WHEN 4 THEN '*' END AS op2
         FROM (SELECT *, p_partkey % 6 AS k FROM part)),
       walk AS (
         SELECT *, 0::BIGINT AS i, CASE op WHEN '+' THEN lower - step ELSE lower / step END AS cur FROM spec
         UNION ALL
         SELECT * EXCLUDE (nxt) REPLACE (i + 1 AS i, nxt AS cur) FROM (
           SELECT *, CASE WHEN mid IS NOT NULL AND cur >= mid
                       THEN CASE op2 WHEN '+' THEN cur + step2 ELSE cur * step2 END
                       ELSE CASE op WHEN '+' THEN cur + step ELSE cur * step END END AS nxt
           FROM walk WHERE cur <= upper) WHERE nxt <= upper)
       SELECT spec_id, i - 1 AS position, cur AS value FROM walk WHERE i > 0""",
)
def scenario_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    kind = key % 6
    tenth = size / F.lit(10.0)
    spec = (
        F.when(kind == 0, _range(key % 5 + 1, key % 5 + 1 + size, 1 + size % 3))
        .when(kind == 1, _range(16, 4096 * (1 + key % 4), 2 + size % 3 * 7, "*"))
        .when(kind == 2, _range(1, 20, 1, "+", 4 + size % 5, 8, "+"))
        .when(kind == 3, _range(tenth, tenth + 2, F.lit(0.1) * (1 + size % 3)))
        .when(kind == 4, _range(1, 1000, 1, "+", 5, 2, "*"))
        .otherwise(_range(10, 5, 1))
    )
    return (
        table(spark, sf_dir, "part")
        .select(key.alias("spec_id"), spec.alias("r"))
        .select("spec_id", F.posexplode_outer(expand_range(F.col("r"))).alias("position", "value"))
        .filter(F.col("position").isNotNull())
        .withColumn("position", F.col("position").cast("bigint"))
    )


def scenario_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scenario definition as JSON for every supplier."""
    key = F.col("s_suppkey")
    one = _range(1, 1, 1)
    zero = _range(0, 0, 250000)
    common = {
        "numProducersPerTopic": _range(1, 1 + key % 3, 1),
        "numConsumers": _range(1, 4, 2, "+", 2, 1, "+"),
        "numTopics": _range(1, 4 + key % 5, 2, "*"),
        "parallelSubscriptionsPerTopic": one,
        "messageSizeBytes": _range(16 + key, 300 + key * 16, 16, "*"),
        "producerWaitInMicroSeconds": zero,
        "backlogSizeMessages": _range(0, 10, 10),
    }
    network = {
        "bandwidthMbps": _range(1000, 1000, 10, "*"),
        "latencyMs": _range(0, 50 * (key % 2), 50),
        "packetLossPerc": _range(0, 0.5, 0.5),
        "jitterMs": zero,
    }
    exclusive = {
        EXCLUSIVE_TIME: _range(30, 30 + key % 7, 5),
        EXCLUSIVE_COUNT: _range(100, 100, 1),
    }
    pack = lambda d: F.struct(*[v.alias(k) for k, v in d.items()])
    document = F.struct(
        F.array(F.lit("round-robin")).alias("producerAssignmentStrategy"),
        F.when(key % 2 == 0, F.array(F.lit("shared"), F.lit("round-robin")))
        .otherwise(F.array(F.lit("shared")))
        .alias("consumerAssignmentStrategy"),
        pack(common).alias("common"),
        pack(network).alias("network"),
        pack(exclusive).alias("exclusive"),
    )
    return table(spark, sf_dir, "supplier").select(
        key.alias("config_id"), F.to_json(document).alias("document")
    )


@register(
    "scenario_grid",
    """WITH RECURSIVE base AS (SELECT s_suppkey AS k FROM supplier),
       topics AS (
         SELECT k, 1.0::DOUBLE AS t FROM base
         UNION ALL SELECT k, t * 2 FROM topics WHERE t * 2 <= 4 + k % 5),
       sizes AS (
         SELECT k, (16 + k)::DOUBLE AS b FROM base
         UNION ALL SELECT k, b * 16 FROM sizes WHERE b * 16 <= 300 + k * 16),
       grid AS (
         SELECT k, p, c, t, b, bl, lat, loss, s, d
         FROM (SELECT k, unnest(range(1, 2 + k % 3)) AS p FROM base)
         JOIN (SELECT k, unnest([1, 3, 4]) AS c FROM base) USING (k)
         JOIN topics USING (k) JOIN sizes USING (k)
         JOIN (SELECT k, unnest([0, 10]) AS bl FROM base) USING (k)
         JOIN (SELECT k, unnest(range(0, 50 * (k % 2) + 1, 50)) AS lat FROM base) USING (k)
         JOIN (SELECT k, unnest([0, 0.5]) AS loss FROM base) USING (k)
         JOIN (SELECT k, unnest(CASE WHEN k % 2 = 0 THEN ['shared', 'round-robin'] ELSE ['shared'] END) AS s FROM base) USING (k)
         JOIN (SELECT k, unnest(range(30, 31 + k % 7, 5)) AS d FROM base) USING (k))
       SELECT k AS config_id,
              p || 'p' || c || 'c' || t::BIGINT || '_0t' || b::BIGINT || 'b-' || d || 's' AS name,
              p::DOUBLE AS "numProducersPerTopic", c::DOUBLE AS "numConsumers", t AS "numTopics",
              1::DOUBLE AS "parallelSubscriptionsPerTopic", b AS "messageSizeBytes",
              0::DOUBLE AS "producerWaitInMicroSeconds", bl::DOUBLE AS "backlogSizeMessages",
              1000::DOUBLE AS "bandwidthMbps", lat::DOUBLE AS "latencyMs", loss::DOUBLE AS "packetLossPerc",
              0::DOUBLE AS "jitterMs", 'round-robin' AS "producerAssignmentStrategy",
              s AS "consumerAssignmentStrategy", d::DOUBLE AS "testDurationS"
       FROM grid""",
)
def scenario_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    configs = scenario_documents(spark, sf_dir).select(
        "config_id", parse_scenario(F.col("document")).alias("s")
    ).select("config_id", "s.*")
    return sc.scenario_grid(configs, EXCLUSIVE_TIME, ["config_id"]).drop(EXCLUSIVE_COUNT)


@register(
    "experiment_list",
    """WITH b AS (
         SELECT s_suppkey AS batch_id, ['s' || (s_suppkey % 7) || '.json', 'demo.json.v2.json'] AS files,
                CASE WHEN s_suppkey % 3 = 0 THEN ['kafka_p2p', 'nats_p2p', 'zeromq_p2p']
                  ELSE ['nats_p2p', 'kafka_p2p'] END AS techs,
                ['md', 'm', 'd', ''][1 + s_suppkey % 4] AS modes
         FROM supplier),
       f AS (SELECT *, unnest(range(len(files))) AS i FROM b),
       t AS (SELECT *, unnest(range(len(techs))) AS j FROM f)
       SELECT batch_id, i::BIGINT AS batch_position, split_part(files[i + 1], '.json', 1) AS scenario,
              j::BIGINT AS tech_position, techs[j + 1] AS tech, goal
       FROM t JOIN (VALUES ('m', 'numberOfMessages'), ('d', 'testDurationS')) g(m, goal)
         ON contains(modes, m)""",
)
def experiment_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    document = F.struct(
        F.array(
            F.concat(F.lit("s"), key % 7, F.lit(".json")), F.lit("demo.json.v2.json")
        ).alias("scenario_batch"),
        F.when(key % 3 == 0, F.array(*[F.lit(t) for t in ("kafka_p2p", "nats_p2p", "zeromq_p2p")]))
        .otherwise(F.array(F.lit("nats_p2p"), F.lit("kafka_p2p")))
        .alias("technologies"),
    )
    modes = F.element_at(F.array(*[F.lit(m) for m in ("md", "m", "d", "")]), (key % 4 + 1).cast("int"))
    batches = (
        table(spark, sf_dir, "supplier")
        .select(key.alias("batch_id"), modes.alias("modes"), F.to_json(document).alias("document"))
        .select("batch_id", "modes", parse_batch(F.col("document")).alias("b"))
        .select("batch_id", "modes", "b.*")
    )
    out = sc.experiment_list(batches, ["batch_id"])
    return out.withColumn("batch_position", F.col("batch_position").cast("bigint")).withColumn(
        "tech_position", F.col("tech_position").cast("bigint")
    )


def scenario_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small scenario for every customer; some have both goals or none."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("scenario_id"),
        (key % 3 + 1).alias("n_producers"),
        (key % 4 + 1).alias("n_consumers"),
        (F.col("c_nationkey") % 5 + 1).cast("bigint").alias("n_topics"),
        F.element_at(
            F.array(F.lit("round-robin"), F.lit("shared"), F.lit("random")),
            (F.floor(key / 4) % 3 + 1).cast("int"),
        ).alias("consumer_strategy"),
        (key % 1000).alias("pub_rate"),
        (key * 16 + 64).alias("message_size"),
        F.when(key % 10 != 0, F.when(key % 2 == 0, key + 1)).otherwise(
            F.when(key % 20 == 0, key)
        ).alias("n_messages"),
        F.when(key % 10 != 0, F.when(key % 2 != 0, key % 60)).otherwise(
            F.when(key % 20 == 0, F.lit(30).cast("bigint"))
        ).alias("duration"),
        (key % 7 * 10).alias("backlog_size"),
    )


_SCENARIOS = """
sc AS (
  SELECT c_custkey AS scenario_id, c_custkey % 3 + 1 AS n_producers, c_custkey % 4 + 1 AS n_consumers,
         CAST(c_nationkey % 5 + 1 AS BIGINT) AS n_topics,
         ['round-robin', 'shared', 'random'][1 + (c_custkey // 4) % 3] AS consumer_strategy,
         c_custkey % 1000 AS pub_rate, c_custkey * 16 + 64 AS message_size,
         CASE WHEN c_custkey % 20 = 0 THEN c_custkey WHEN c_custkey % 10 = 0 THEN NULL
              WHEN c_custkey % 2 = 0 THEN c_custkey + 1 END AS n_messages,
         CASE WHEN c_custkey % 20 = 0 THEN 30 WHEN c_custkey % 10 = 0 THEN NULL
              WHEN c_custkey % 2 <> 0 THEN c_custkey % 60 END AS duration,
         c_custkey % 7 * 10 AS backlog_size
  FROM customer),
pubs AS (
  SELECT *, 'P' || i AS pub_id, list_transform(range(n_topics), lambda x: x::VARCHAR) AS topics
  FROM (SELECT *, unnest(range(n_producers)) AS i FROM sc)),
cons AS (
  SELECT *, 'C' || i AS con_id,
         CASE consumer_strategy WHEN 'round-robin' THEN [(i % n_topics)::VARCHAR]
           WHEN 'shared' THEN list_transform(range(n_topics), lambda x: x::VARCHAR)
           ELSE []::VARCHAR[] END AS topics
  FROM (SELECT *, unnest(range(n_consumers)) AS i FROM sc))"""


@register(
    "client_configs",
    f"""WITH {_SCENARIOS}
        SELECT scenario_id, 'publisher' AS role, pub_id AS client_id,
               array_to_string(topics, ',') AS topics, pub_rate, message_size, n_messages, duration,
               n_consumers, NULL::BIGINT AS backlog_size FROM pubs
        UNION ALL
        SELECT scenario_id, 'consumer', con_id, array_to_string(topics, ','), NULL, NULL, NULL, NULL,
               NULL, backlog_size FROM cons""",
)
def client_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scenario_rows(spark, sf_dir)
    publishers = sc.publisher_configs(rows)
    consumers = sc.consumer_configs(rows)
    # Through the JSON documents the clients receive, and back.
    p = sc.config_documents(publishers, "scenario_id", "pub_id").select(
        "scenario_id",
        F.lit("publisher").alias("role"),
        F.from_json("document", publishers.drop("scenario_id").schema).alias("d"),
    )
    c = sc.config_documents(consumers, "scenario_id", "con_id").select(
        "scenario_id",
        F.lit("consumer").alias("role"),
        F.from_json("document", consumers.drop("scenario_id").schema).alias("d"),
    )
    numbers = ["pub_rate", "message_size", "n_messages", "duration", "n_consumers"]
    none = F.lit(None).cast("bigint")
    return p.select(
        "scenario_id",
        "role",
        F.col("d.pub_id").alias("client_id"),
        F.array_join("d.topics", ",").alias("topics"),
        *[F.col(f"d.{n}").alias(n) for n in numbers],
        none.alias("backlog_size"),
    ).unionByName(
        c.select(
            "scenario_id",
            "role",
            F.col("d.con_id").alias("client_id"),
            F.array_join("d.topics", ",").alias("topics"),
            *[none.alias(n) for n in numbers],
            F.col("d.backlog_size").alias("backlog_size"),
        )
    )


@register(
    "scenario_validation",
    f"""WITH {_SCENARIOS}
        SELECT scenario_id, n_messages, duration,
               (n_messages IS NULL) <> (duration IS NULL) AS has_one_goal FROM sc""",
)
def scenario_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.validate_scenarios(scenario_rows(spark, sf_dir)).select(
        "scenario_id", "n_messages", "duration", "has_one_goal"
    )


@register(
    "subscription_pairs",
    f"""WITH {_SCENARIOS}
        SELECT c.scenario_id, con_id, c.t AS topic, CAST(c.t AS BIGINT) AS topic_position, pub_id AS publisher
        FROM (SELECT scenario_id, con_id, unnest(topics) AS t FROM cons) c
        JOIN (SELECT scenario_id, pub_id, unnest(topics) AS t FROM pubs) p
          ON c.scenario_id = p.scenario_id AND c.t = p.t""",
)
def subscription_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scenario_rows(spark, sf_dir)
    pairs = sc.subscription_pairs(sc.publisher_configs(rows), sc.consumer_configs(rows))
    return pairs.withColumn("topic_position", F.col("topic_position").cast("bigint"))


def client_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic and endpoint lists with repeats, gaps and short endpoint lists."""
    key = F.col("c_custkey")
    nation = F.col("c_nationkey")
    topics = F.concat(
        F.col("c_mktsegment"),
        F.lit(","),
        key % 3,
        F.when(key % 4 == 0, F.lit(",,0")).otherwise(F.lit(",0")),
        F.when(key % 5 == 0, F.lit(",")).otherwise(F.lit("")),
    )
    endpoints = (
        F.when(key % 6 == 0, F.concat(F.lit("P"), nation))
        .when(key % 6 == 1, F.concat(F.lit("P"), nation, F.lit(",")))
        .when(key % 6 == 2, F.lit(""))
        .when(key % 6 == 3, F.concat(F.lit(" h"), nation, F.lit(" ,,h2:9093,h3")))
        .otherwise(F.concat(F.lit("P0,P"), nation % 3, F.lit(",P0,P0,P0")))
    )
    return table(spark, sf_dir, "customer").select(
        key.alias("client"), topics.alias("topics"), endpoints.alias("endpoints")
    )


_SETTINGS = """
cs AS (
  SELECT c_custkey AS client,
         CASE WHEN c_custkey % 4 = 0 THEN [c_mktsegment, (c_custkey % 3)::VARCHAR, '', '0']
              ELSE [c_mktsegment, (c_custkey % 3)::VARCHAR, '0'] END AS topics,
         CASE c_custkey % 6 WHEN 0 THEN list_transform(range(9), lambda x: 'P' || c_nationkey)
           WHEN 1 THEN ['P' || c_nationkey, '', '', '', ''] WHEN 2 THEN ['', '', '', '', '']
           WHEN 3 THEN [' h' || c_nationkey || ' ', '', 'h2:9093', 'h3', 'h3']
           ELSE ['P0', 'P' || (c_nationkey % 3), 'P0', 'P0', 'P0'] END AS pubs,
         CASE c_custkey % 6 WHEN 0 THEN 'P' || c_nationkey || ':9092'
           WHEN 1 THEN 'P' || c_nationkey || ':9092' WHEN 2 THEN 'localhost:9092'
           WHEN 3 THEN 'h' || c_nationkey || ':9092,h2:9093,h3:9092'
           ELSE 'P0:9092,P' || (c_nationkey % 3) || ':9092,P0:9092,P0:9092,P0:9092' END AS endpoints
  FROM customer)"""


@register(
    "publisher_subscriptions",
    f"""WITH {_SETTINGS}
        SELECT DISTINCT client, topic, publisher FROM (
          SELECT client, topics[i + 1] AS topic, pubs[i + 1] AS publisher
          FROM (SELECT *, unnest(range(len(topics))) AS i FROM cs))
        WHERE topic <> '' AND publisher <> ''""",
)
def publisher_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.publisher_subscriptions(client_settings(spark, sf_dir), ["client"])


@register(
    "topic_subscriptions",
    f"""WITH {_SETTINGS}
        SELECT DISTINCT client, topic FROM (SELECT client, unnest(topics) AS topic FROM cs)
        WHERE topic <> ''""",
)
def topic_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.topic_subscriptions(client_settings(spark, sf_dir), ["client"])


@register("endpoint_list", f"WITH {_SETTINGS} SELECT client, endpoints FROM cs")
def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return client_settings(spark, sf_dir).select(
        "client", endpoint_list(F.col("endpoints"), "9092").alias("endpoints")
    )
