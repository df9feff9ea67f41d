"""The same views as SQL, written independently for the counterpart engine."""

from __future__ import annotations

MSG = """
msg0 AS (
  SELECT event_id, 'demo' AS scenario,
         CASE WHEN user_id % 2 = 0 THEN 'alpha' ELSE 'beta' END AS tech,
         CASE WHEN (user_id // 2) % 2 = 0 THEN 'r0' ELSE 'r1' END AS run,
         'P' || (user_id % 3) AS p,
         'P' || (user_id % 3) || '-' || event_id AS message_id,
         event_type AS topic,
         CAST(round(value * 1000) AS BIGINT) AS l,
         1704067200000000 + (epoch_us(ts) - 1704067200000000) // 3600 AS t0
  FROM events),
msg AS (
  SELECT *, l + length(message_id) + 11 AS sz,
         t0 + (event_id * 7919 % 23) * 1000 + event_id % 997 AS t1,
         event_id % 211 = 0 AS err
  FROM msg0)"""

MSG_EVENTS = MSG + """,
cons AS (SELECT unnest([0, 1]) AS c),
rec AS (
  SELECT msg.*, c, t1 + ((event_id * 104729 + c * 31) % 400 - 5) * 1000 AS t2
  FROM msg, cons WHERE NOT err),
msg_events AS (
  SELECT event_id, scenario, tech, run, message_id, topic, 'Serializing' AS event_type,
         tech || '-' || p AS container_name, t0 AS us,
         CAST(NULL AS BIGINT) AS logical_size, CAST(NULL AS BIGINT) AS serialized_size
  FROM msg
  UNION ALL
  SELECT event_id, scenario, tech, run, message_id, topic,
         CASE WHEN err THEN 'DeliveryError' ELSE 'Publication' END,
         tech || '-' || p, t1, CASE WHEN tech = 'alpha' THEN -1 ELSE l END, sz
  FROM msg
  UNION ALL
  SELECT event_id, scenario, tech, run, message_id, topic, 'Reception', tech || '-C' || c, t2,
         CASE WHEN tech = 'beta' THEN l END, CASE WHEN tech = 'beta' THEN sz END
  FROM rec
  UNION ALL
  SELECT event_id, scenario, tech, run, message_id, topic, 'Deserialized', tech || '-C' || c,
         t2 + (event_id % 11) * 1000, l, sz
  FROM rec WHERE tech = 'alpha' AND event_id % 97 <> 0)"""

EVENTS = MSG_EVENTS + """,
ev AS (
  SELECT * FROM msg_events
  WHERE event_type IN ('Serializing', 'Publication', 'Reception', 'Deserialized')
    AND message_id IS NOT NULL)"""

FILLED = EVENTS + """,
pubs AS (
  SELECT scenario, tech, run, message_id, topic, min(serialized_size) AS ps FROM ev
  WHERE event_type = 'Publication' AND serialized_size IS NOT NULL GROUP BY ALL),
decs AS (
  SELECT scenario, tech, run, message_id, topic, min(serialized_size) AS ds FROM ev
  WHERE event_type = 'Deserialized' AND serialized_size IS NOT NULL GROUP BY ALL),
filled AS (
  SELECT ev.* EXCLUDE (serialized_size),
         CASE event_type
           WHEN 'Serializing' THEN coalesce(serialized_size, ps)
           WHEN 'Reception' THEN coalesce(serialized_size, ds)
           ELSE coalesce(serialized_size, ps, ds) END AS serialized_size
  FROM ev LEFT JOIN pubs USING (scenario, tech, run, message_id, topic)
          LEFT JOIN decs USING (scenario, tech, run, message_id, topic))"""


def curve(window_s: int) -> str:
    return FILLED + f""",
origin AS (
  SELECT scenario, tech, run, min(us) // 1000 AS start_ms FROM filled GROUP BY ALL),
curve AS (
  SELECT scenario, tech, run, event_type,
         CAST(floor((w * 1000 - start_ms) / 1000.0) AS BIGINT) AS time_s,
         CAST(sum(serialized_size) AS DOUBLE) / {window_s} / 1000000 AS throughput_mb_s
  FROM (SELECT f.*, unnest(range(us // 1000000 - {window_s - 1}, us // 1000000 + 1)) AS w
        FROM filled f
        WHERE serialized_size IS NOT NULL
          AND event_type IN ('Publication', 'Reception', 'Deserialized'))
  JOIN origin USING (scenario, tech, run)
  GROUP BY scenario, tech, run, event_type, w, start_ms
  HAVING floor((w * 1000 - start_ms) / 1000.0) >= 0)"""


def trimmed_curve(window_s: int = 10, start_s: int = 5, end_s: int = 5) -> str:
    return curve(window_s) + f""",
trimmed AS (
  SELECT c.* FROM curve c JOIN (
    SELECT scenario, tech, run, event_type, max(time_s) - {max(0, end_s, window_s)} AS last_s
    FROM curve GROUP BY ALL) USING (scenario, tech, run, event_type)
  WHERE time_s >= {start_s} AND time_s <= last_s)"""


SAMPLES = EVENTS + """,
bounds AS (
  SELECT scenario, tech, run, min(us) // 1000 AS start_ms, max(us) // 1000 AS end_ms,
         bool_or(event_type = 'Deserialized') AS has_deserialized, count(*) AS n_events
  FROM ev GROUP BY ALL),
pairs AS (
  SELECT a.scenario, a.tech, a.run, 'serializing_to_publication' AS segment, a.us AS t0, b.us AS t1
  FROM ev a JOIN ev b USING (scenario, tech, run, message_id, topic, container_name)
  WHERE a.event_type = 'Serializing' AND b.event_type = 'Publication'
  UNION ALL
  SELECT a.scenario, a.tech, a.run, 'publication_to_reception', a.us, b.us
  FROM ev a JOIN ev b USING (scenario, tech, run, message_id, topic)
  WHERE a.event_type = 'Publication' AND b.event_type = 'Reception'
  UNION ALL
  SELECT a.scenario, a.tech, a.run, 'reception_to_deserialized', a.us, b.us
  FROM ev a JOIN ev b USING (scenario, tech, run, message_id, topic, container_name)
  WHERE a.event_type = 'Reception' AND b.event_type = 'Deserialized'
  UNION ALL
  SELECT a.scenario, a.tech, a.run, 'end_to_end', a.us, b.us
  FROM ev a JOIN ev b USING (scenario, tech, run, message_id, topic)
            JOIN bounds d USING (scenario, tech, run)
  WHERE a.event_type = 'Serializing'
    AND b.event_type = CASE WHEN d.has_deserialized THEN 'Deserialized' ELSE 'Reception' END),
samples AS (
  SELECT scenario, tech, run, segment,
         CAST(floor((t0 // 1000 - start_ms) / 1000.0) AS BIGINT) AS time_s,
         greatest(t1 // 1000 - t0 // 1000, 0) AS latency_ms
  FROM pairs JOIN bounds USING (scenario, tech, run))"""


def ranked(source: str) -> str:
    """Sort-and-index percentiles, the plain definition."""
    return f"""
sorted AS (
  SELECT scenario, tech, run, segment, list(latency_ms ORDER BY latency_ms) AS v
  FROM {source} GROUP BY ALL),
stats AS (
  SELECT scenario, tech, run, segment,
         CAST(v[1 + CAST(round((len(v) - 1) * CAST(0.50 AS DOUBLE)) AS BIGINT)] AS DOUBLE) AS p50_ms,
         CAST(v[1 + CAST(round((len(v) - 1) * CAST(0.90 AS DOUBLE)) AS BIGINT)] AS DOUBLE) AS p90_ms,
         CAST(v[1 + CAST(round((len(v) - 1) * CAST(0.99 AS DOUBLE)) AS BIGINT)] AS DOUBLE) AS p99_ms,
         CAST(v[len(v)] AS DOUBLE) AS max_ms
  FROM sorted)"""


LATENCY_STATS = SAMPLES + "," + ranked("samples") + """,
expected AS (
  SELECT scenario, tech, run, unnest(
    CASE WHEN has_deserialized
      THEN ['serializing_to_publication', 'publication_to_reception',
            'reception_to_deserialized', 'end_to_end']
      ELSE ['serializing_to_publication', 'publication_to_reception', 'end_to_end'] END) AS segment
  FROM bounds),
latency_stats AS (
  SELECT * FROM expected LEFT JOIN stats USING (scenario, tech, run, segment))"""

LATENCY_TRIMMED = SAMPLES + """,
kept AS (
  SELECT s.* FROM samples s JOIN (
    SELECT scenario, tech, run, max(time_s) - 5 AS last_s FROM samples GROUP BY ALL)
    USING (scenario, tech, run)
  WHERE time_s >= 5 AND time_s <= last_s),""" + ranked("kept")

RESOURCES = """
res AS (
  SELECT 'demo' AS scenario,
         CASE WHEN user_id % 2 = 0 THEN 'alpha' ELSE 'beta' END AS tech,
         CASE WHEN (user_id // 2) % 2 = 0 THEN 'r0' ELSE 'r1' END AS run,
         event_id,
         ['P0', 'P1', 'Broker', 'C0', 'P2'][1 + (user_id // 4) % 5] AS source,
         1704067200000000 + (epoch_us(ts) - 1704067200000000) // 3600 AS us,
         CAST(event_id * 1000000 AS DOUBLE) AS cpu_usage_ns,
         value AS cpu_usage_perc,
         CAST(CAST(round(value * 100) AS BIGINT) * 10485 AS DOUBLE) AS memory_usage,
         CAST(event_id % 100 * 1048576 AS DOUBLE) AS page_cache,
         CAST(event_id * 1500 AS DOUBLE) AS network_rx,
         CAST(CAST(round(value * 100) AS BIGINT) * 1000 AS DOUBLE) AS network_tx,
         CAST(CASE WHEN event_id % 13 = 0 THEN 0 ELSE event_id * 4096 END AS DOUBLE) AS disk_read,
         CAST(event_id * 2048 AS DOUBLE) AS disk_write
  FROM events)"""

RATES = RESOURCES + """,
steps AS (
  SELECT *, row_number() OVER w AS row_index,
         CAST(us // 1000 - lag(us // 1000) OVER w AS DOUBLE) / 1000 AS dt,
         disk_read - lag(disk_read) OVER w + (disk_write - lag(disk_write) OVER w) AS dd,
         network_rx - lag(network_rx) OVER w AS dr,
         network_tx - lag(network_tx) OVER w AS dx
  FROM res WHERE source = 'Broker' OR source LIKE 'P%'
  WINDOW w AS (PARTITION BY scenario, tech, run, source ORDER BY us, event_id)),
rates AS (
  SELECT *,
         CASE WHEN dt > 0 THEN greatest(dd / dt / 1000000, 0) ELSE 0 END AS disk_throughput_mb_s,
         CASE WHEN dt > 0 THEN greatest(dr / dt / 1000000, 0) ELSE 0 END AS network_rx_mb_s,
         CASE WHEN dt > 0 THEN greatest(dx / dt / 1000000, 0) ELSE 0 END AS network_tx_mb_s
  FROM steps)"""

USAGE = RATES + """,
shortest AS (
  SELECT scenario, tech, run, min(n) AS n FROM (
    SELECT scenario, tech, run, source, count(*) AS n FROM rates
    WHERE source LIKE 'P%' GROUP BY ALL) GROUP BY ALL),
summed AS (
  SELECT r.scenario, r.tech, r.run, row_index,
         CAST(floor(avg(us // 1000)) AS BIGINT) AS at_ms,
         sum(cpu_usage_perc) AS cpu_usage_perc,
         sum(memory_usage) / 1024 / 1024 AS memory_mb,
         sum(page_cache) / 1024 / 1024 AS page_cache_mb,
         sum(disk_throughput_mb_s) AS disk_throughput_mb_s,
         sum(network_rx_mb_s) AS network_rx_mb_s,
         sum(network_tx_mb_s) AS network_tx_mb_s
  FROM rates r JOIN shortest s USING (scenario, tech, run)
  WHERE row_index <= s.n GROUP BY r.scenario, r.tech, r.run, row_index),
usage AS (
  SELECT *, CAST(floor((at_ms - min(at_ms) OVER (PARTITION BY scenario, tech, run)) / 1000.0)
                 AS BIGINT) AS time_s
  FROM summed)"""


def with_views(views: str, select: str) -> str:
    return f"WITH {views.strip()}\n{select.strip()}"
