"""Sinks, weights, streaming, session and the driver contract."""

import csv
import json
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from checks import fixtures
from checks.compare import _sorted_rows
from contentgrade.functions.scores import Weights
from contentgrade.operators.aggregates import summary
from contentgrade.plans.evaluate import evaluate_pages
from contentgrade.session import scratch_path
from contentgrade.sinks import reports
from contentgrade.sinks.weights import write_weights
from contentgrade.sources.fetches import read_fetches, spread, stream_fetches
from contentgrade.sources.weights import load_weights, read_weights
from contentgrade.streaming import evaluate as streaming

HTML = '<title>A "q", b</title><body>Solvency II 3 ivass, scr, caffè</body>'
AS_OF = "2024-01-01"


@pytest.fixture
def results(spark):
    rows = [("https://h.example/a", HTML, 1704067200.5, None), ("https://h.example/b", "<body></body>", 1704067200.0, None)]
    fetches = spark.createDataFrame(rows, "url string, html string, fetched_at double, error string")
    return evaluate_pages(fetches, AS_OF)


def parts(path, pattern="part-*"):
    return sorted(Path(path).glob(pattern))


def test_csv_report(results, tmp_path):
    reports.write_csv_report(results, str(tmp_path / "r"))
    rows = [row for part in parts(tmp_path / "r") for row in csv.DictReader(part.open(encoding="utf-8"))]
    rows.sort(key=lambda r: r["url"])
    assert list(rows[0]) == [
        "url", "title", "score", "classification", "accuracy", "transparency", "completeness", "freshness", "clarity",
        "word_count", "numeric_tokens", "has_formula", "has_table", "has_list", "citation_matches", "actuarial_terms",
    ]
    assert rows[0]["title"] == 'A "q", b' and rows[0]["actuarial_terms"] == "ivass:1; scr:1; solvency:1; solvency ii:1"
    assert rows[0]["has_table"] == "false" and rows[1]["actuarial_terms"] == ""


def test_json_report(results, tmp_path):
    reports.write_json_report(results, str(tmp_path / "r"))
    rows = [json.loads(line) for part in parts(tmp_path / "r") for line in part.open(encoding="utf-8")]
    row = next(r for r in rows if r["page"]["url"].endswith("a"))
    assert set(row) == {"page", "metrics", "score"} and set(row["page"]) == {"url", "title", "metadata", "fetched_at"}
    assert row["page"]["fetched_at"] == "2024-01-01T00:00:00.500000+00:00" and row["page"]["metadata"]["author"] is None
    assert row["metrics"]["example_values"] == [3.0] and row["score"]["classification"] == "Buono"


def test_time_text_is_utc_in_any_session(spark):
    moment = F.timestamp_micros(F.lit(1704067200250000))
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            found = spark.range(1).select(reports.iso_text(moment)).first()[0]
            assert found == "2024-01-01T00:00:00.250000+00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_summary_file(results, tmp_path):
    reports.write_summary(results, str(tmp_path / "s"))
    (line,) = [line for part in parts(tmp_path / "s") for line in part.open()]
    assert json.loads(line) == summary(results).first().asDict()


def test_weights_files(spark, tmp_path):
    path = tmp_path / "w.json"
    path.write_text('{\n "accuracy": 2, "clarity": "0.5", "unknown": [1]\n}')
    assert load_weights(spark, str(path)) == Weights(accuracy=2.0, clarity=0.5)
    write_weights(Weights(2, 1, 1, 0.5, 0.5), str(tmp_path / "out"), spark, normalize=True)
    assert load_weights(spark, str(tmp_path / "out")) == Weights(0.4, 0.2, 0.2, 0.1, 0.1)
    table = read_weights(spark, str(tmp_path / "out"))
    write_weights(table, str(tmp_path / "again"))
    assert read_weights(spark, str(tmp_path / "again"), lines=True).collect() == table.collect()


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    source = str(tmp_path / "fetches")
    fixtures.fetches(spark, sf_dir).withColumn("depth", F.lit(0)).drop("page_id").write.parquet(source)
    batch = evaluate_pages(read_fetches(spark, source), AS_OF)
    stream = streaming.evaluate_stream(stream_fetches(spark, source, 2), AS_OF)
    columns = ["url", "title", "text", "score"]
    streaming.write_results(stream.select(*columns), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    key = lambda row: str(row)
    assert sorted(spark.read.parquet(str(tmp_path / "out")).select(*columns).collect(), key=key) == sorted(
        batch.select(*columns).collect(), key=key
    )
    totals = streaming.summary_stream(stream)
    streaming.write_summary(totals, str(tmp_path / "sum"), str(tmp_path / "c2")).awaitTermination()
    assert streaming.read_summary(spark, str(tmp_path / "sum")).collect() == summary(batch).collect()
    with pytest.raises(ValueError):
        streaming.evaluate_stream(batch, AS_OF)


def test_evaluation_is_one_stage(spark, sf_dir):
    fetches = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        "url", "html", F.lit(0.0).alias("fetched_at"), F.lit(None).cast("string").alias("error")
    )
    plan = evaluate_pages(fetches, AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "ReadSchema: struct<url:string,html:string>" in plan


def test_spread_and_scratch(spark):
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(100, numPartitions=50)
    assert spread(wide) is wide
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_contract(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())


CHEAP = [
    "usable_fetches", "robots_rules", "robots_allowed", "final_attempts", "cached_fetch", "meta_datetime", "html_text",
    "main_content", "extract_links", "term_counts", "score_freshness", "round_scores", "evaluate_pages_defaults",
    "score_hybrid", "summary", "match_labels", "split_exact", "page_budget", "tfidf_transform",
]


@pytest.mark.parametrize("name", CHEAP)
def test_query_matches_duckdb(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    mine = contract.queries()[name](spark, sf_dir)
    other = con.execute(contract.oracle_sql()[name]).fetchall()
    assert _sorted_rows(mine.columns, mine.collect()) == _sorted_rows([d[0] for d in con.description], other)
