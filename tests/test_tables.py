"""How the given tables are dealt to tasks, and what a log line costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions.labels import file_stem
from tidewire.registry import streams, tables
from tidewire.schemas import RUN
from tidewire.sources.logs import parse_study_lines
from tidewire.sources.stats import flatten_stats, read_stats_files, stats_samples


def test_tasks_have_bounded_rows_whatever_the_file_looks_like(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "ROWS_PER_TASK", 1000)
    spark.range(0, 40_000, 1, 1).write.parquet(f"{tmp_path}/t.parquet")
    rows = tables.table(spark, str(tmp_path), "t")
    sizes = rows.groupBy(F.spark_partition_id()).count().collect()
    assert rows.count() == 40_000 and rows.distinct().count() == 40_000
    assert len(sizes) == 40 and max(r["count"] for r in sizes) < 1300


def test_few_row_groups_do_not_leave_cores_without_rows(spark, tmp_path):
    spark.range(0, 100_000, 1, 1).write.parquet(f"{tmp_path}/t.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        rows = tables.table(spark, str(tmp_path), "t")
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(sizes) >= spark.sparkContext.defaultParallelism and max(sizes) < 20_000


def test_a_line_is_cut_once_and_filtered_after(spark, capsys):
    lines = spark.createDataFrame([("c", "[STUDY] t,Publication,m, b ,1,x")], "container_name string, line string")
    parse_study_lines(lines).explain("formatted")
    plan = capsys.readouterr().out
    filters = [p for p in plan.split("\n\n") if "Filter" in p.split("\n")[0]]
    assert filters and not any("split(" in p for p in filters)


def test_the_parts_of_a_line_are_trimmed_and_read_once(spark, capsys):
    lines = spark.createDataFrame([("c", "[STUDY] t,Publication,m, b ,1,x")], "container_name string, line string")
    parse_study_lines(lines).explain("formatted")
    plan = capsys.readouterr().out
    # The pattern of whole sizes, for two sizes, in the one step that makes them.
    assert plan.count(r"RLIKE") == 4 and "lambda" not in plan


def test_file_names_without_their_extension(spark):
    plain = F.regexp_replace(F.element_at(F.split("p", "/"), -1), r"(?s)(?<=.)\.[^.]+$", "")
    names = ["/a.b/c.log", "c.tar.gz", ".log", "..log", "c.", "c..", "c", "/", "", ".", "é.é", "a\n.b\n", "a.\n", "c. ", None]
    rows = spark.createDataFrame([(n,) for n in names], "p string")
    got = rows.select("p", file_stem(F.col("p")).alias("got"), plain.alias("want")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_a_large_step_of_a_stream_is_many_files_and_one_micro_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "_ROWS_PER_FILE", 1000)
    rows = spark.range(0, 20_000, 1, 6).withColumn("step", F.pmod("id", F.lit(4)))
    stream = streams._arriving(spark, rows, "step")
    seen = []

    def store(batch, number):
        files = batch.select(F.input_file_name()).distinct().count()
        seen.append((files, {r["step"]: r["count"] for r in batch.groupBy("step").count().collect()}))

    query = stream.writeStream.foreachBatch(store).option("checkpointLocation", f"{tmp_path}/c")
    query.trigger(availableNow=True).start().awaitTermination()
    assert seen == [(5, {k: 5000}) for k in range(4)]


def test_a_statistics_document_is_parsed_once(spark, tmp_path, capsys):
    folder = tmp_path / "logs" / "demo" / "alpha" / "r0"
    folder.mkdir(parents=True)
    (folder / "a.jsonl").write_text("{}\n")
    docs = read_stats_files(spark, str(tmp_path))
    flatten_stats(docs.filter("timestamp > ''"), [*RUN, "container", "timestamp"]).explain("formatted")
    plan = capsys.readouterr().out
    # One parser for the lines and one for the documents in them.
    assert plan.count("from_json(") == 2
    stats_samples(docs).explain("formatted")
    assert "from_json(" not in capsys.readouterr().out
