"""Registered queries over blocks and tables of uploads, artifacts, users, payments, job requests and audit metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions.text import stable_id
from caseloom.operators.blocks import split_blocks
from caseloom.plans.governance import redacted
from caseloom.sources.views import spread, table

IMMUTABLE = ["click", "view"]
SENSITIVE = "(?i)(?:text|content|body|query|prompt|transcript|quote|raw_input|document)"


def blk2_blocks(spark, sf_dir):
    """Each document's blocks: number, id and length."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    b = d.select("doc_id", F.posexplode(split_blocks(F.col("text"))).alias("sequence", "text"))
    return b.select("doc_id", F.col("sequence").cast("long").alias("sequence"), stable_id("blk_", F.col("doc_id").cast("string"), F.lit("1"), F.col("sequence").cast("string"), "text", size=20).alias("block_id"), F.length("text").cast("long").alias("characters"))


def table_blocks(cells: DataFrame, key: str) -> DataFrame:
    """key, text, n_rows, n_columns: the cells (row, column, value) of each table as lines, spaces collapsed, without
    tables that are empty throughout."""
    tidy = cells.withColumn("value", F.trim(F.regexp_replace(F.coalesce("value", F.lit("")), r"\s+", " ")))
    rows = tidy.groupBy(key, "row").agg(F.array_sort(F.collect_list(F.struct("column", "value"))).alias("c"))
    lines = rows.select(key, "row", F.array_join(F.transform("c", lambda x: x["value"]), " | ").alias("line"), F.size("c").alias("n"), F.exists("c", lambda x: x["value"] != "").alias("full"))
    whole = lines.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("text"), F.count("*").alias("n_rows"), F.max("n").cast("long").alias("n_columns"), F.max("full").alias("full"))
    return whole.filter("full").drop("full")


def blk4_tables(spark, sf_dir):
    """The lines of each order as a table of three columns."""
    l = table(spark, sf_dir, "lineitem")
    row = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"))
    values = F.array(F.col("l_partkey").cast("string"), F.concat(F.lit(" "), "l_returnflag", F.lit("  "), "l_linestatus"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey").cast("string")))
    cells = l.select("l_orderkey", row.alias("row"), values.alias("v")).select("l_orderkey", "row", F.posexplode("v").alias("column", "value"))
    return table_blocks(cells, "l_orderkey")


def src13_selected(spark, sf_dir):
    """Versions asked for by number, and whether they belong to the case that asks."""
    r = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("src"), (F.col("item_id") % 5).cast("string")).alias("case_id"), (F.col("item_id") * 3).alias("doc_id"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("case_id"), F.lit(True).alias("own"))
    return r.join(d, ["doc_id", "case_id"], "left").select("item_id", "case_id", "doc_id", F.coalesce("own", F.lit(False)).cast("string").alias("found"))


def _artifacts(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("case_id"), F.col("event_type").alias("category"), (F.col("event_id") % 10).alias("artifact_id"), "event_id", "ts")


def src15_artifacts(spark, sf_dir):
    """What an append of artifacts leaves: the first of an id in immutable categories, the last in the others."""
    at = F.struct("ts", "event_id")
    return _artifacts(spark, sf_dir).groupBy("case_id", "category", "artifact_id").agg(F.when(F.col("category").isin(*IMMUTABLE), F.min_by("event_id", at)).otherwise(F.max_by("event_id", at)).alias("event_id"))


def src16_latest(spark, sf_dir):
    """The three newest artifacts of each case and category, ties by id."""
    w = Window.partitionBy("case_id", "category").orderBy(F.desc("ts"), F.desc("artifact_id"), F.desc("event_id"))
    return _artifacts(spark, sf_dir).withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 3").select("case_id", "category", "rank", "artifact_id", "event_id")


def src19_owned(spark, sf_dir):
    """Lines of the orders that customers of every fifth nation own."""
    own = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").filter("c_nationkey % 5 = 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(own, "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("n"))


def an6_users(spark, sf_dir):
    """Known users and arriving ones: new values win where they are given, and analyses add up."""
    k = F.col("c_custkey")
    known = table(spark, sf_dir, "customer").filter(k % 2 == 0).select(k.alias("id"), F.when(k % 3 > 0, F.concat(F.lit("c"), k.cast("string"), F.lit("@x.org"))).alias("old_email"), F.col("c_name").alias("old_name"), (k % 4).alias("before"))
    n = F.col("o_custkey")
    new = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("added")).select(n.alias("id"), F.when(n % 7 == 0, F.concat(F.lit("o"), n.cast("string"), F.lit("@x.org"))).alias("email"), F.when(n % 5 > 0, F.concat(F.lit("New "), n.cast("string"))).alias("name"), "added")
    return known.join(new, "id", "full").select("id", F.coalesce("email", "old_email").alias("email"), F.coalesce("name", "old_name").alias("name"), (F.coalesce("before", F.lit(0)) + F.coalesce("added", F.lit(0))).cast("long").alias("cases_analyzed"))


def an7_expiry(spark, sf_dir):
    """Orders as payments: every other one buys 30 days, the rest one report without an end."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.date_add(F.to_date("o_orderdate"), 30).cast("string")).alias("expires"))


def jb2_enqueued(spark, sf_dir):
    """Each request's job: the first request with the same key, user and kind."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("job_id", F.first("event_id").over(w))
    return e.select("event_id", "job_id", (F.col("event_id") == F.col("job_id")).cast("string").alias("created"))


def sanitised(entries: Column) -> Column:
    """array<struct<key,kind,value,items>> of the first 40 entries: keys cut to 80, sensitive ones blanked, strings redacted
    and cut to 500, lists (items) to 20 entries redacted and cut to 120."""
    def safe(x: Column) -> Column:
        key = F.substring(x["key"], 1, 80)
        blank = key.rlike(SENSITIVE)
        value = F.when(blank, "[REDACTED]").when(x["kind"] == "string", F.substring(redacted(x["value"]), 1, 500)).otherwise(x["value"])
        items = F.when(~blank, F.transform(F.slice(x["items"], 1, 20), lambda i: F.substring(redacted(i), 1, 120)))
        return F.struct(key.alias("key"), x["kind"].alias("kind"), value.alias("value"), items.alias("items"))

    return F.transform(F.slice(entries, 1, 40), safe)


def gv2_metadata(spark, sf_dir):
    """Audit metadata of each event: a sensitive key, a number of twelve digits, and a string with a mail address."""
    entry = lambda k, kind, v: F.struct(F.lit(k).alias("key"), F.lit(kind).alias("kind"), v.alias("value"), F.lit(None).cast("array<string>").alias("items"))
    n = F.col("event_id").cast("string")
    count = F.concat(F.lit("1234567890"), F.lpad((F.col("event_id") % 100).cast("string"), 2, "0"))
    note = F.concat(F.lit("mail u"), n, F.lit("@example.com "), F.repeat(F.lit("x"), 600))
    entries = F.array(entry("Search_Query", "string", n), entry("count", "number", count), entry("note", "string", note))
    e = table(spark, sf_dir, "events").select("event_id", sanitised(entries).alias("m"))
    return e.select("event_id", F.array_join(F.transform("m", lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";").alias("metadata"))


QUERIES = {f.__name__: f for f in (blk2_blocks, blk4_tables, src13_selected, src15_artifacts, src16_latest, src19_owned, an6_users, an7_expiry, jb2_enqueued, gv2_metadata)}
_ARTIFACTS = "WITH a AS (SELECT user_id AS case_id, event_type AS category, event_id % 10 AS artifact_id, event_id, ts FROM events) "
SQL = {
    "blk2_blocks": r"""
WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '(\.)\s*\n|\n\s*\n', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS b FROM documents),
u AS (SELECT doc_id, CAST(generate_subscripts(b, 1) - 1 AS BIGINT) AS sequence, unnest(b) AS text FROM p)
SELECT doc_id, sequence, 'blk_' || substr(sha256(doc_id || ':1:' || sequence || ':' || text), 1, 20) AS block_id, length(text) AS characters FROM u""",
    "blk4_tables": "SELECT l_orderkey, string_agg(l_partkey || ' | ' || l_returnflag || ' ' || l_linestatus || ' | ' || CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_suppkey AS VARCHAR) ELSE '' END, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS text, count(*) AS n_rows, 3 AS n_columns FROM lineitem GROUP BY l_orderkey",
    "src13_selected": "SELECT item_id, 'src' || (item_id % 5) AS case_id, item_id * 3 AS doc_id, CASE WHEN EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = item_id * 3 AND d.source = 'src' || (item_id % 5)) THEN 'true' ELSE 'false' END AS found FROM benchmark",
    "src15_artifacts": _ARTIFACTS + "SELECT case_id, category, artifact_id, CASE WHEN category IN ('click', 'view') THEN first(event_id ORDER BY ts, event_id) ELSE last(event_id ORDER BY ts, event_id) END AS event_id FROM a GROUP BY case_id, category, artifact_id",
    "src16_latest": _ARTIFACTS + "SELECT case_id, category, rank, artifact_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY case_id, category ORDER BY ts DESC, artifact_id DESC, event_id DESC) AS rank FROM a) WHERE rank <= 3",
    "src19_owned": "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 5 = 0) GROUP BY l_orderkey",
    "an6_users": """
WITH k AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN 'c' || c_custkey || '@x.org' END AS email, c_name AS name, c_custkey % 4 AS n FROM customer WHERE c_custkey % 2 = 0),
a AS (SELECT o_custkey AS id, CASE WHEN o_custkey % 7 = 0 THEN 'o' || o_custkey || '@x.org' END AS email, CASE WHEN o_custkey % 5 > 0 THEN 'New ' || o_custkey END AS name, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT id, coalesce(a.email, k.email) AS email, coalesce(a.name, k.name) AS name, CAST(coalesce(k.n, 0) + coalesce(a.n, 0) AS BIGINT) AS cases_analyzed FROM k FULL JOIN a USING (id)""",
    "an7_expiry": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') END AS expires FROM orders",
    "jb2_enqueued": "SELECT event_id, job_id, CASE WHEN event_id = job_id THEN 'true' ELSE 'false' END AS created FROM (SELECT event_id, first_value(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS job_id FROM events)",
    "gv2_metadata": "SELECT event_id, 'Search_Query=[REDACTED];count=1234567890' || lpad(CAST(event_id % 100 AS VARCHAR), 2, '0') || ';note=' || substr('mail [REDACTED-EMAIL] ' || repeat('x', 600), 1, 500) AS metadata FROM events",
}
