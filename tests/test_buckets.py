import uuid

import pytest
from pyspark.sql import functions as F

from docgrain.operators import reviews as R
from docgrain.sources import tables as S


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Runs and reviews in the bucketed layout; joins are not broadcast here."""
    root, unique = tmp_path_factory.mktemp("buckets"), uuid.uuid4().hex
    log = spark.range(4000).select(
        F.col("id").alias("field_review_id"), (F.col("id") % 300).alias("extraction_run_id"), F.concat(F.lit("f"), F.col("id") % 3).alias("field_path"),
        F.col("id").cast("string").alias("edited_value"), F.timestamp_seconds("id").alias("created_at"),
    )
    runs = spark.range(500).select(F.col("id").alias("extraction_run_id"), F.lit("{}").alias("extracted"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    a = S.write_history(log, "field_review", f"log_{unique}", f"{root}/log", 8)
    b = S.write_bucketed(runs, f"runs_{unique}", f"{root}/runs", "extraction_run_id", [], 16)
    yield a, b, runs
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for name in ("log", "runs"):
        spark.sql(f"DROP TABLE {name}_{unique}")


def exchanges(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return plan.count("Exchange hashpartitioning")


def test_each_bucket_is_one_sorted_file(spark, stored):
    log = stored[0]
    assert log.count() == 4000 and log.select(F.input_file_name()).distinct().count() == 8
    rows = spark.read.parquet(log.inputFiles()[0]).select("extraction_run_id", "field_path").collect()
    assert rows == sorted(rows)


def test_lookups_and_aggregates_on_the_key_do_not_shuffle(stored):
    log = stored[0]
    assert exchanges(log.groupBy("extraction_run_id").count()) == 0
    assert exchanges(R.latest_reviews(log)) == 0
    assert log.filter("extraction_run_id = 7").count() == 14


def test_the_history_side_of_joins_does_not_shuffle(spark, stored):
    log, runs, plain = stored
    counts = log.groupBy("extraction_run_id").count()
    assert exchanges(runs.join(counts, "extraction_run_id")) <= 1  # of runs, if their buckets are more
    assert exchanges(plain.join(counts, "extraction_run_id")) == 1  # the new rows
    new = spark.createDataFrame([(3, "f1"), (900, "f2")], "extraction_run_id long, field_path string")
    assert exchanges(new.join(log, ["extraction_run_id"], "left_semi")) == 1
    view = R.extracted_view(plain, log)
    assert view.count() == 500 and view.filter("view <> extracted").count() == 300


def test_bucket_counts_are_powers_of_two():
    assert [S.bucket_count(n) for n in (0, 1 << 30, 10 << 40)] == [8, 8, 32768]
