"""Payload, batching and completion queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import payload as pay
from tidewire.functions.labels import kind_code, kind_name
from tidewire.operators.codecs import (
    decode_lists,
    decode_payloads,
    encode_lists,
    encode_payloads,
)
from tidewire.operators.microbatch import assign_batches, summarise_batches
from tidewire.plans import messages as msgs
from tidewire.plans import scenarios as sc
from tidewire.registry import register
from tidewire.registry import sql_views as sql
from tidewire.registry.scenarios import _SCENARIOS, scenario_rows
from tidewire.registry.tables import messages, table, termination_rows
from tidewire.schemas import RUN

# The transports, in name order.
TRANSPORTS = [
    "arrowflight_bin_p2p",
    "arrowflight_p2p",
    "grpc_p2p",
    "kafka_p2p",
    "nats_jetstream_p2p",
    "nats_p2p",
    "rabbitmq_p2p",
    "zeromq_p2p",
]


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload for every document; even ones carry an embedding and labels."""
    nested = F.col("doc_id") % 2 == 0
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vector")
    )
    return (
        table(spark, sf_dir, "documents")
        .join(vectors, "doc_id", "left")
        .select(
            "doc_id",
            F.concat(F.lit("P0-"), "doc_id").alias("message_id"),
            F.when(nested, F.lit(2)).otherwise(F.lit(1)).cast("tinyint").alias("kind"),
            F.col("text").cast("binary").alias("bytes"),
            F.when(nested, F.coalesce("vector", F.array().cast("array<double>"))).alias("doubles"),
            F.when(nested, F.array("lang", "source")).alias("strings"),
        )
    )


_PAYLOADS = """
pl AS (
  SELECT doc_id, 'P0-' || doc_id AS message_id, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS kind,
         text, lang, source, strlen(text) AS nb,
         CASE WHEN doc_id % 2 = 0 THEN coalesce(len(embedding), 0) END AS nd,
         CASE WHEN doc_id % 2 = 0 THEN strlen(lang) + strlen(source) END AS ns,
         CASE WHEN doc_id % 2 = 0 THEN embedding END AS embedding
  FROM documents LEFT JOIN embeddings ON doc_id = vec_id),
sized AS (
  SELECT *, nb + coalesce(nd * 8 + ns, 0) AS logical,
         11 + strlen(message_id) + nb + coalesce(24 + nd * 8 + 4 + ns, 0) AS wire
  FROM pl)"""


def _with_sizes(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "logical_size", pay.logical_size(F.col("bytes"), F.col("doubles"), F.col("strings"))
    ).withColumn(
        "wire_size",
        pay.wire_size(
            F.col("message_id"), F.col("kind"), F.col("bytes"), F.col("doubles"), F.col("strings")
        ),
    )


@register(
    "payload_sizes",
    sql.with_views(
        _PAYLOADS,
        """SELECT doc_id, message_id, logical AS logical_size, wire AS wire_size,
                  wire + strlen('P12-' || (doc_id + 99)) - strlen(message_id) AS restamped_size
           FROM sized""",
    ),
)
def payload_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    new_id = F.concat(F.lit("P12-"), F.col("doc_id") + 99)
    return _with_sizes(payloads(spark, sf_dir)).select(
        "doc_id",
        "message_id",
        "logical_size",
        "wire_size",
        pay.restamped_size(F.col("wire_size"), F.col("message_id"), new_id).alias("restamped_size"),
    )


@register(
    "transport_row_size",
    sql.with_views(
        _PAYLOADS,
        f"""SELECT doc_id, tech, CASE
              WHEN tech LIKE 'arrowflight%' THEN strlen(message_id) + 1 + logical
              WHEN tech = 'grpc_p2p' THEN strlen(source) + strlen(message_id) + 1 + logical
              WHEN tech = 'zeromq_p2p' THEN wire + 1 + strlen(source)
              ELSE wire END AS row_size
            FROM (SELECT *, {TRANSPORTS}[1 + (doc_id // 2) % 8] AS tech FROM sized)""",
    ),
)
def transport_row_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    tech = F.element_at(
        F.array(*[F.lit(t) for t in TRANSPORTS]), (F.floor(F.col("doc_id") / 2) % 8 + 1).cast("int")
    )
    topics = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("topic"))
    sized = _with_sizes(payloads(spark, sf_dir)).join(topics, "doc_id").withColumn("tech", tech)
    size = pay.transport_row_size(
        F.col("tech"), F.col("topic"), F.col("message_id"), F.col("logical_size"), F.col("wire_size")
    )
    return sized.select("doc_id", "tech", size.alias("row_size"))


_CONTENT = """round(coalesce(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 0), 6)"""


def _content(df: DataFrame, *extra: str) -> DataFrame:
    total = F.aggregate("doubles", F.lit(0.0), lambda a, x: a + x)
    return df.select(
        "doc_id",
        *extra,
        F.coalesce(F.array_size("doubles"), F.lit(0)).cast("bigint").alias("n_doubles"),
        F.round(F.coalesce(total, F.lit(0.0)), 6).alias("sum_doubles"),
        F.array_join("strings", "|").alias("strings"),
        "error",
    )


@register(
    "payload_roundtrip",
    sql.with_views(
        _PAYLOADS,
        f"""SELECT doc_id, message_id, kind::BIGINT AS kind, md5(text) AS md5, wire AS wire_size,
                   coalesce(nd, 0) AS n_doubles, {_CONTENT} AS sum_doubles,
                   CASE WHEN kind = 2 THEN lang || '|' || source END AS strings,
                   NULL::VARCHAR AS error
            FROM sized""",
    ),
)
def payload_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    wired = encode_payloads(payloads(spark, sf_dir)).select("doc_id", "wire")
    back = decode_payloads(wired).withColumn("kind", F.col("kind").cast("bigint"))
    sized = back.withColumn("md5", F.md5("bytes")).withColumn(
        "wire_size", F.octet_length("wire").cast("bigint")
    )
    return _content(sized, "message_id", "kind", "md5", "wire_size")


@register(
    "binlist_roundtrip",
    sql.with_views(
        _PAYLOADS,
        f"""SELECT doc_id, nd * 8 AS double_bytes, ns + 4 AS string_bytes,
                   coalesce(nd, 0) AS n_doubles, {_CONTENT} AS sum_doubles,
                   CASE WHEN kind = 2 THEN lang || '|' || source END AS strings,
                   NULL::VARCHAR AS error
            FROM sized""",
    ),
)
def binlist_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = encode_lists(payloads(spark, sf_dir)).select("doc_id", "doubles_bin", "strings_bin")
    back = (
        decode_lists(packed)
        .withColumn("double_bytes", F.octet_length("doubles_bin").cast("bigint"))
        .withColumn("string_bytes", F.octet_length("strings_bin").cast("bigint"))
    )
    return _content(back, "double_bytes", "string_bytes")


@register(
    "payload_id_only",
    sql.with_views(
        _PAYLOADS,
        """SELECT doc_id, message_id AS wire_id, source AS topic, message_id AS envelope_id,
                  CASE doc_id % 3 WHEN 0 THEN 'key-' || doc_id ELSE message_id END AS message_key
           FROM sized""",
    ),
)
def payload_id_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("topic"))
    wired = encode_payloads(payloads(spark, sf_dir)).select("doc_id", "wire").join(topics, "doc_id")
    key = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("key-"), "doc_id")).when(
        F.col("doc_id") % 3 == 1, F.lit("")
    )
    message = pay.envelope(F.col("topic"), F.col("wire"))
    return (
        wired.filter(F.octet_length("wire") > 0)
        .withColumn("message", message)
        .select(
            "doc_id",
            pay.id_from_wire(F.col("wire")).alias("wire_id"),
            pay.topic_from_envelope(F.col("message")).alias("topic"),
            pay.id_from_envelope(F.col("message")).alias("envelope_id"),
            pay.message_key(key, F.col("wire")).alias("message_key"),
        )
    )


@register(
    "payload_kind_map",
    """SELECT event_id, name, code::BIGINT AS code,
              CASE code WHEN 0 THEN 'TERMINATION' WHEN 1 THEN 'FLAT' ELSE 'COMPLEX' END AS back
       FROM (SELECT *, CASE name WHEN 'TERMINATION' THEN 0 WHEN 'COMPLEX' THEN 2 ELSE 1 END AS code
             FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'FLAT' WHEN 'click' THEN 'COMPLEX'
                            WHEN 'error' THEN 'TERMINATION' WHEN 'signup' THEN '' ELSE event_type END AS name
                   FROM events))""",
)
def payload_kind_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    name = (
        F.when(kind == "view", "FLAT")
        .when(kind == "click", "COMPLEX")
        .when(kind == "error", "TERMINATION")
        .when(kind == "signup", "")
        .otherwise(kind)
    )
    named = table(spark, sf_dir, "events").select("event_id", name.alias("name"))
    code = kind_code(F.col("name"))
    return named.select(
        "event_id", "name", code.cast("bigint").alias("code"), kind_name(code).alias("back")
    )


@register(
    "payload_generate",
    """WITH RECURSIVE texts(n, pos, total) AS (
         SELECT 0, 0, 5 UNION ALL
         SELECT n + 1, total, total + 4 + strlen(total::VARCHAR) FROM texts WHERE total < 2000),
       m AS (
         SELECT event_id, event_id % 1000 AS seq, 16 + event_id % 700 AS size,
                CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 1 END AS kind,
                'P' || (user_id % 3) AS p
         FROM events),
       g AS (
         SELECT *, CASE WHEN kind = 2 THEN CAST(floor(size * 0.6::DOUBLE) AS BIGINT) // 8 END AS nd,
                CASE WHEN kind = 2 THEN CAST(floor(size * 0.2::DOUBLE) AS BIGINT) END AS sb
         FROM m),
       h AS (
         SELECT *, CASE kind WHEN 0 THEN 1 WHEN 1 THEN size ELSE size - nd * 8 - sb END AS nb FROM g),
       strs AS (
         SELECT sb, string_agg(left('str_' || pos, LEAST(strlen('str_' || pos), sb - pos)), '|' ORDER BY pos) AS strings
         FROM (SELECT DISTINCT sb FROM g WHERE sb IS NOT NULL) JOIN texts ON pos < sb GROUP BY sb)
       SELECT event_id, CASE kind WHEN 0 THEN p || ':__END__' ELSE p || '-' || seq END AS message_id,
              kind::BIGINT AS kind, nb::BIGINT AS n_bytes,
              md5(CASE kind WHEN 0 THEN 'FF'
                WHEN 1 THEN array_to_string(list_transform(range(nb), lambda i: printf('%02X', (i * seq) % 251)), '')
                ELSE array_to_string(list_transform(range(nb), lambda i: printf('%02X', (i + seq) % 199)), '') END) AS md5_hex,
              coalesce(nd, 0)::BIGINT AS n_doubles,
              CASE WHEN kind = 2 THEN round((nd - 1) * 1.111::DOUBLE, 6) END AS last_double,
              strings,
              (CASE kind WHEN 0 THEN 1 ELSE size END)::BIGINT AS logical_size
       FROM h LEFT JOIN strs USING (sb)""",
)
def payload_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    eid = F.col("event_id")
    kind = F.when(eid % 5 == 0, 0).when(eid % 5 < 3, 2).otherwise(1)
    made = table(spark, sf_dir, "events").select(
        "event_id",
        pay.generated_payload(
            F.concat(F.lit("P"), F.col("user_id") % 3), eid % 1000, eid % 700 + 16, kind
        ).alias("m"),
    )
    m = F.col("m")
    return made.select(
        "event_id",
        m["message_id"].alias("message_id"),
        m["kind"].cast("bigint").alias("kind"),
        F.octet_length(m["bytes"]).cast("bigint").alias("n_bytes"),
        F.md5(F.hex(m["bytes"])).alias("md5_hex"),
        F.coalesce(F.array_size(m["doubles"]), F.lit(0)).cast("bigint").alias("n_doubles"),
        F.round(F.element_at(m["doubles"], -1), 6).alias("last_double"),
        F.array_join(m["strings"], "|").alias("strings"),
        pay.logical_size(m["bytes"], m["doubles"], m["strings"]).alias("logical_size"),
    )


@register(
    "workload_table",
    f"""WITH {_SCENARIOS},
        w AS (SELECT scenario_id, pub_id, topics, unnest(range(1, scenario_id % 40 + 2)) AS seq FROM pubs)
        SELECT scenario_id, pub_id, seq, pub_id || '-' || seq AS message_id,
               ((seq % 2147483648 * 1103515245 + 12345) >> 16) % 5 AS sample, unnest(topics) AS topic FROM w""",
)
def workload_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    publishers = sc.publisher_configs(scenario_rows(spark, sf_dir)).withColumn(
        "n_messages", F.col("scenario_id") % 40 + 1
    )
    return msgs.workload(publishers, samples=5, chunk=16)


_BATCH_KEYS = [*RUN, "p", "topic"]
_BATCH_LIMIT = 1024 * 1024

_BATCHES = (
    sql.MSG
    + f""",
seqs AS (
  SELECT *, row_number() OVER (PARTITION BY scenario, tech, run, p, topic ORDER BY t0, event_id) AS n
  FROM msg),
fold AS (
  SELECT scenario, tech, run, p, topic, event_id, t0, sz, n, 0::BIGINT AS batch_id,
         CASE WHEN sz >= {_BATCH_LIMIT} OR err THEN 0 ELSE sz END AS held,
         (sz >= {_BATCH_LIMIT} OR err)::BIGINT AS closed
  FROM seqs WHERE n = 1
  UNION ALL
  SELECT s.scenario, s.tech, s.run, s.p, s.topic, s.event_id, s.t0, s.sz, s.n, f.batch_id + f.closed,
         CASE WHEN f.held + s.sz >= {_BATCH_LIMIT} OR s.err THEN 0 ELSE f.held + s.sz END,
         (f.held + s.sz >= {_BATCH_LIMIT} OR s.err)::BIGINT
  FROM fold f JOIN seqs s ON s.scenario = f.scenario AND s.tech = f.tech AND s.run = f.run
    AND s.p = f.p AND s.topic = f.topic AND s.n = f.n + 1)"""
)


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir).select(*_BATCH_KEYS, "event_id", "t0", "sz", "err")
    # Failed sends stand in for closing messages, which force a batch out.
    return assign_batches(
        rows,
        _BATCH_KEYS,
        ["t0", "event_id"],
        "sz",
        _BATCH_LIMIT,
        forced=F.col("err"),
        rows_per_slice=5_000,
        slices_per_block=4,
        slice_us=60_000_000,
    )


@register(
    "microbatch_assign",
    "WITH RECURSIVE "
    + _BATCHES.strip()
    + " SELECT scenario, tech, run, p, topic, event_id, sz, batch_id FROM fold",
)
def microbatch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir).select(*_BATCH_KEYS, "event_id", "sz", "batch_id")


@register(
    "microbatch_summary",
    "WITH RECURSIVE "
    + _BATCHES.strip()
    + """ SELECT scenario, tech, run, p, topic, batch_id, count(*) AS n_rows,
                 sum(sz)::BIGINT AS n_bytes, min(t0) AS first_us, max(t0) AS published_us
          FROM fold GROUP BY ALL""",
)
def microbatch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarise_batches(_assigned(spark, sf_dir), _BATCH_KEYS, "t0", "sz")


def publisher_batches(select: str) -> str:
    """SQL over the batches of every publisher, all its topics together, at the limit of small payloads."""
    limit = pay.batch_limit(0)
    return f"""WITH RECURSIVE {sql.MSG.strip()},
seqs AS (
  SELECT *, row_number() OVER (PARTITION BY scenario, tech, run, p ORDER BY t0, event_id) AS n FROM msg),
fold AS (
  SELECT scenario, tech, run, p, event_id, t0, sz, n, 0::BIGINT AS batch_id,
         CASE WHEN sz >= {limit} OR err THEN 0 ELSE sz END AS held, (sz >= {limit} OR err)::BIGINT AS closed
  FROM seqs WHERE n = 1
  UNION ALL
  SELECT s.scenario, s.tech, s.run, s.p, s.event_id, s.t0, s.sz, s.n, f.batch_id + f.closed,
         CASE WHEN f.held + s.sz >= {limit} OR s.err THEN 0 ELSE f.held + s.sz END,
         (f.held + s.sz >= {limit} OR s.err)::BIGINT
  FROM fold f JOIN seqs s ON s.scenario = f.scenario AND s.tech = f.tech AND s.run = f.run
    AND s.p = f.p AND s.n = f.n + 1)
{select}"""


@register(
    "microbatch_assign_publisher",
    publisher_batches("SELECT scenario, tech, run, p, event_id, sz, batch_id FROM fold"),
)
def microbatch_assign_publisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of a publisher over all its topics, at the limit of its payload size."""
    keys = [*RUN, "p"]
    rows = messages(spark, sf_dir).select(*keys, "event_id", "t0", "sz", "err")
    assigned = assign_batches(
        rows, keys, ["t0", "event_id"], "sz", pay.batch_limit(0), forced=F.col("err"), slice_us=60_000_000
    )
    return assigned.select(*keys, "event_id", "sz", "batch_id")


@register(
    "stream_completion",
    sql.with_views(
        sql.MSG
        + """,
streams AS (SELECT DISTINCT scenario, tech, run, p, topic FROM msg),
last AS (SELECT scenario, tech, run, max(t0) AS t FROM msg GROUP BY ALL),
term AS (
  SELECT s.*, c AS container, t + 1000000 + length(topic) * 1000 + 3000 AS us
  FROM streams s JOIN last USING (scenario, tech, run), (VALUES ('C0'), ('C1')) v(c)
  WHERE c = 'C0' OR topic IN ('view', 'click')),
need AS (
  SELECT scenario, tech, run, container,
         CASE WHEN tech = 'alpha' THEN count(DISTINCT topic) ELSE count(*) END AS n
  FROM term GROUP BY scenario, tech, run, container),
nth AS (
  SELECT *, row_number() OVER (PARTITION BY scenario, tech, run, container ORDER BY us) AS i FROM term)""",
        """SELECT scenario, tech, run, tech || '-' || container AS container_name, n AS n_subscribed,
                  count(*) AS n_seen, min(CASE WHEN i >= n THEN us END) AS completed_us
           FROM nth JOIN need USING (scenario, tech, run, container)
           GROUP BY scenario, tech, run, container, n""",
    ),
)
def completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = termination_rows(spark, sf_dir)
    return msgs.stream_completion(msgs.closing_events(rows), followed_streams(rows))


def followed_streams(rows: DataFrame) -> DataFrame:
    """Topics and streams of both consumers; the second follows two topics only."""
    streams = rows.select(*RUN, "p", "topic").distinct()
    consumer = F.explode(F.array(F.lit("C0"), F.lit("C1")))
    followed = (
        streams.groupBy(*RUN, "topic")
        .agg(F.count(F.lit(1)).alias("publishers"))
        .withColumn("c", consumer)
        .filter((F.col("c") == "C0") | F.col("topic").isin("view", "click"))
    )
    return followed.select(
        *RUN,
        F.concat_ws("-", "tech", "c").alias("container_name"),
        "topic",
        F.when(F.col("tech") == "alpha", F.lit(1)).otherwise(F.col("publishers")).alias("streams"),
    )
