"""Schemas, column names and fixed values shared by all jobs."""

from __future__ import annotations

from pyspark.sql import types as T

# Run keys. ``logs_root`` is carried too wherever the source has one.
RUN = ["scenario", "tech", "run"]
MESSAGE = [*RUN, "message_id", "topic"]

SERIALIZING = "Serializing"
PUBLICATION = "Publication"
RECEPTION = "Reception"
DESERIALIZED = "Deserialized"
# The lifecycle stages kept by the loader.
EVENT_TYPES = [SERIALIZING, PUBLICATION, RECEPTION, DESERIALIZED]
# The stages shown as throughput curves.
THROUGHPUT_TYPES = [PUBLICATION, RECEPTION, DESERIALIZED]

# Latency segment names.
SER_TO_PUB = "serializing_to_publication"
PUB_TO_REC = "publication_to_reception"
REC_TO_DES = "reception_to_deserialized"
END_TO_END = "end_to_end"

EVENT_COLUMNS = {
    "container_name": "string",
    "timestamp": "timestamp",
    "event_type": "string",
    "message_id": "string",
    "logical_size": "bigint",
    "topic": "string",
    "serialized_size": "bigint",
}

# Numeric columns of a resource sample, in file order.
RESOURCE_COUNTERS = [
    "cpu_usage_ns",
    "cpu_usage_perc",
    "memory_usage",
    "page_cache",
    "network_rx",
    "network_tx",
    "disk_read",
    "disk_write",
]

# Published resource metrics.
RESOURCE_METRICS = [
    "cpu_usage_perc",
    "memory_mb",
    "page_cache_mb",
    "disk_throughput_mb_s",
    "network_rx_mb_s",
    "network_tx_mb_s",
]

STATS_SCHEMA = T.StructType(
    [
        T.StructField(
            "cpu_stats",
            T.StructType(
                [
                    T.StructField(
                        "cpu_usage",
                        T.StructType([T.StructField("total_usage", T.LongType())]),
                    ),
                    T.StructField("system_cpu_usage", T.LongType()),
                ]
            ),
        ),
        T.StructField(
            "memory_stats",
            T.StructType(
                [
                    T.StructField("usage", T.LongType()),
                    T.StructField(
                        "stats",
                        T.StructType(
                            [
                                T.StructField("file", T.LongType()),
                                T.StructField("active_file", T.LongType()),
                                T.StructField("inactive_file", T.LongType()),
                            ]
                        ),
                    ),
                ]
            ),
        ),
        T.StructField(
            "networks",
            T.MapType(
                T.StringType(),
                T.StructType(
                    [
                        T.StructField("rx_bytes", T.LongType()),
                        T.StructField("tx_bytes", T.LongType()),
                    ]
                ),
            ),
        ),
        T.StructField(
            "blkio_stats",
            T.StructType(
                [
                    T.StructField(
                        "io_service_bytes_recursive",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField("op", T.StringType()),
                                    T.StructField("value", T.LongType()),
                                ]
                            )
                        ),
                    )
                ]
            ),
        ),
    ]
)

RANGE_SCHEMA = T.StructType(
    [
        T.StructField("lower", T.DoubleType()),
        T.StructField("upper", T.DoubleType()),
        T.StructField("step", T.DoubleType()),
        T.StructField("step_operator", T.StringType()),
        T.StructField("midpoint", T.DoubleType()),
        T.StructField("step2", T.DoubleType()),
        T.StructField("step_operator2", T.StringType()),
    ]
)

# The dimensions of a scenario grid, in product order.
COMMON_DIMENSIONS = [
    "numProducersPerTopic",
    "numConsumers",
    "numTopics",
    "parallelSubscriptionsPerTopic",
    "messageSizeBytes",
    "producerWaitInMicroSeconds",
    "backlogSizeMessages",
]
NETWORK_DIMENSIONS = ["bandwidthMbps", "latencyMs", "packetLossPerc", "jitterMs"]
STRATEGY_DIMENSIONS = ["producerAssignmentStrategy", "consumerAssignmentStrategy"]
EXCLUSIVE_TIME = "testDurationS"
EXCLUSIVE_COUNT = "numberOfMessages"


def _ranges(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, RANGE_SCHEMA) for n in names])


SCENARIO_SCHEMA = T.StructType(
    [T.StructField(n, T.ArrayType(T.StringType())) for n in STRATEGY_DIMENSIONS]
    + [
        T.StructField("common", _ranges(COMMON_DIMENSIONS)),
        T.StructField("network", _ranges(NETWORK_DIMENSIONS)),
        T.StructField("exclusive", _ranges([EXCLUSIVE_TIME, EXCLUSIVE_COUNT])),
    ]
)

BATCH_SCHEMA = T.StructType(
    [
        T.StructField("scenario_batch", T.ArrayType(T.StringType())),
        T.StructField("technologies", T.ArrayType(T.StringType())),
    ]
)

# Payload kinds and their wire codes.
KIND_TERMINATION, KIND_FLAT, KIND_COMPLEX = 0, 1, 2
KIND_NAMES = {0: "TERMINATION", 1: "FLAT", 2: "COMPLEX"}
TERMINATION_SUFFIX = ":__END__"

PAYLOAD_SCHEMA = T.StructType(
    [
        T.StructField("message_id", T.StringType()),
        T.StructField("kind", T.ByteType()),
        T.StructField("bytes", T.BinaryType()),
        T.StructField("doubles", T.ArrayType(T.DoubleType())),
        T.StructField("strings", T.ArrayType(T.StringType())),
    ]
)
