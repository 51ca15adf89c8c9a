"""Results on tables that are read in several tasks, files that are read in part, and what plans shuffle and store."""

import os
import time

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from caseloom.operators import evidence, search
from caseloom.plans import records
from caseloom.sources import files, views

SF = "/root/testdata/sf0.001"


def same(spark, folder, name, tables):
    """A query's rows and those of its SQL in one thread are the same; how many they are."""
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute("SET threads = 1")
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{'/*.parquet' if os.path.isdir(f'{folder}/{t}.parquet') else ''}'")
    cur = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    rows = lambda found: sorted(tuple(str(v) for v in r) for r in found)
    got, want = rows(entry.queries()[name](spark, str(folder)).select(*columns).collect()), rows(cur.fetchall())
    assert got == want
    return len(got)


def test_votes_of_tied_lines(spark, tmp_path):
    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    for name, rows in (("a", "l_partkey % 9 = 0"), ("b", "l_partkey % 9 > 0")):  # Spark reads larger files first
        duckdb.sql(f"COPY (SELECT * REPLACE (l_linenumber % 3 AS l_linenumber) FROM '{SF}/lineitem.parquet' WHERE {rows} ORDER BY hash(l_partkey, l_extendedprice)) TO '{folder}/{name}.parquet'")
    assert same(spark, tmp_path, "pt7_votes", ["lineitem"]) > 1000


def test_files_cut_within_a_character(spark, tmp_path):
    rows = [(0, "de", "ß" * 40_000 + "."), (100, "de", "yyyy" + " é. " * 40_000), (200, "fr", "é"), (300, "fr", "")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert same(spark, tmp_path, "src1_originals", ["documents"]) == 4
    cut = ("x" + "ß" * 9).encode()[:-1]
    assert files.text_kind(cut, True) == "text" and files.text_kind(cut[:-1]) == "text" and files.text_kind(b"\xff\xfea\0b", True) == "text" and files.text_kind(b"caf\xe9s") == "text"


def test_files_of_oddly_named_sources(spark, tmp_path):
    rows = [(0, "a/b=c %", "x"), (None, "src1", "y"), (-5, "", "z"), (-205, "x:y", None), (7, None, "é"), (2**60 + 199, "n", "w")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert same(spark, tmp_path, "src1_originals", ["documents"]) == same(spark, tmp_path, "src2_decoded", ["documents"]) == 6


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(found.apply(i).getName().startswith("shuffle_") for i in range(found.size()))


def test_shuffles_end_with_the_table_they_led_to(spark):
    before = shuffle_files(spark)
    kept = views.stored(spark.range(100_000).repartition(8, "id").groupBy((F.col("id") % 100).alias("k")).count(), "kept")
    until = time.time() + 20
    while shuffle_files(spark) > before and time.time() < until:
        time.sleep(0.2)
    assert shuffle_files(spark) <= before and kept.count() == 100 and spark.conf.get(views.CLEANUP) == "false"
    views.discard(kept)
    assert not [w for w in views._written if "/kept-" in w]


def test_spans_move_once(spark):
    found = spark.createDataFrame([("1", "date", "Date", "1/2/2020", 0.9, 1.0, 1, 0, 0, 8, "v", "b")], "case_id string, kind string, label string, quote string, weight double, confidence double, document_order long, sequence int, start int, end int, version_id string, block_id string")
    made = evidence.atoms(found.withColumn("normalized", F.col("quote")))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and made.first().evidence_id.startswith("ev_")
    atoms = records.stored_atoms(spark, SF, "case_id", "rank", records.FIRST)
    assert atoms.columns == ["case_id", "rank", "spans"] and atoms.filter("size(spans) <> 1").isEmpty()


def test_scores_are_summed_where_terms_are(spark):
    blocks = spark.createDataFrame([("c", d, s, f"alpha beta w{d} w{s} gamma") for d in range(20) for s in range(3)] + [("c", 50, 0, "xalphabet betax")], "case_id string, document_id long, sequence long, text string")
    queries = spark.createDataFrame([(1, "c", "alpha beta w3"), (2, "c", "gamma w7"), (3, "c", "alphabet beta")], "query_id long, case_id string, query string")
    found = search.bm25(blocks, queries)
    lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    sums = [i for i, x in enumerate(lines) if "Aggregate(keys=[query_id" in x and "functions=[sum(" in x]
    assert sums and all("Exchange" not in lines[i + 1] for i in sums)
    got = found.collect()
    assert {(r.query_id, r.document_id) for r in got if r["rank"] == 1} == {(1, 3), (2, 7), (3, 50)}
    assert [r.score for r in got if r.document_id == 50 and r.query_id == 3] == [2.0]
