"""Registered queries over budgets and audit trails."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from caseloom.operators import quota
from caseloom.sources.views import table

MAX_BYTES, MAX_FILES = 150_000, 5


def _uploads(spark, sf_dir):
    """Each order line as an upload of its supplier's month: it is reserved, and 500 orders later a part that this
    supplier had before is given back (as a returned line is, after its commit), others are committed."""
    l = table(spark, sf_dir, "lineitem").select(F.lit("t1").alias("tenant_id"), F.col("l_suppkey").cast("string").alias("user_id"), F.date_format("l_shipdate", "yyyy-MM").alias("period"), "l_orderkey", F.col("l_linenumber").cast("long").alias("line"), "l_partkey", "l_returnflag", F.round("l_extendedprice").cast("long").alias("size"))
    l = l.withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey", "line").orderBy("user_id", "l_partkey", "size", "period")))
    before = F.row_number().over(Window.partitionBy("user_id", "l_partkey").orderBy("l_orderkey", "line", "n")) > 1
    place = F.col("l_orderkey") * 10_000 + F.col("line") * 1_000 + F.col("n") * 10
    step = lambda kind, late: F.struct((place + late).alias("seq"), F.lit(kind).alias("kind"))
    steps = F.when(F.col("duplicate"), F.array(step("reserve", 0), step("release", 5_000_001))).when(F.col("l_returnflag") == "R", F.array(step("reserve", 0), step("commit", 5_000_001), step("release", 5_000_002))).otherwise(F.array(step("reserve", 0), step("commit", 5_000_001)))
    flat = l.withColumn("duplicate", before).withColumn("s", F.explode(steps))
    return flat.select("tenant_id", "user_id", "period", "s.seq", "s.kind", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("line").cast("string"), F.col("n").cast("string")).alias("reservation_id"), "size")


def gv4_ledger(spark, sf_dir):
    return quota.ledger(_uploads(spark, sf_dir), MAX_BYTES, MAX_FILES)


def gv4_usage(spark, sf_dir):
    """What each user's month ends with, and how its uploads went."""
    l = quota.ledger(_uploads(spark, sf_dir), MAX_BYTES, MAX_FILES)
    last = F.max_by(F.struct("bytes_used", "file_count"), F.struct("seq", "reservation_id", "kind"))
    n = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return l.groupBy(*quota.KEYS).agg(last.alias("u"), n("reserved"), n("rejected"), n("committed"), n("released"), n("ignored")).select(*quota.KEYS, "u.bytes_used", "u.file_count", "reserved", "rejected", "committed", "released", "ignored")


def gv5_trail(spark, sf_dir):
    """The audit trail of a case: all uploads' outcomes of a customer's orders, oldest first, with the last 20 kept."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("case_id"))
    l = quota.ledger(_uploads(spark, sf_dir), MAX_BYTES, MAX_FILES).withColumn("o_orderkey", F.substring_index("reservation_id", "-", 1).cast("long"))
    newest = Window.partitionBy("case_id").orderBy(F.desc("seq"), F.desc("reservation_id"))
    kept = l.join(o, "o_orderkey").withColumn("rank", F.row_number().over(newest).cast("long")).filter("rank <= 20")
    return kept.select("case_id", "rank", "seq", F.col("user_id").alias("actor"), F.concat(F.lit("upload_"), "kind").alias("event_type"), F.when(F.col("outcome").isin("rejected", "ignored"), "denied").otherwise("allowed").alias("outcome"), "reservation_id")


QUERIES = {f.__name__: f for f in (gv4_ledger, gv4_usage, gv5_trail)}

_LEDGER = f"""
WITH RECURSIVE l AS (
  SELECT *, l_orderkey * 10000 + l_linenumber * 1000 + n * 10 AS place, l_orderkey || '-' || l_linenumber || '-' || n AS reservation_id, row_number() OVER (PARTITION BY user_id, l_partkey ORDER BY l_orderkey, l_linenumber, n) > 1 AS duplicate
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY user_id, l_partkey, size, period) AS n
        FROM (SELECT 't1' AS tenant_id, CAST(l_suppkey AS VARCHAR) AS user_id, strftime(l_shipdate, '%Y-%m') AS period, CAST(round(l_extendedprice) AS BIGINT) AS size, l_orderkey, l_linenumber, l_partkey, l_returnflag FROM lineitem))),
e AS (
  SELECT tenant_id, user_id, period, CAST(place AS BIGINT) AS seq, 'reserve' AS kind, reservation_id, size FROM l
  UNION ALL SELECT tenant_id, user_id, period, CAST(place + 5000001 AS BIGINT), CASE WHEN duplicate THEN 'release' ELSE 'commit' END, reservation_id, size FROM l
  UNION ALL SELECT tenant_id, user_id, period, CAST(place + 5000002 AS BIGINT), 'release', reservation_id, size FROM l WHERE NOT duplicate AND l_returnflag = 'R'),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id, period ORDER BY seq, reservation_id, kind) AS i FROM e),
r AS (
  SELECT n.*, CASE WHEN size <= {MAX_BYTES} THEN 'reserved' ELSE 'rejected' END AS outcome, CASE WHEN size <= {MAX_BYTES} THEN size ELSE 0 END AS bytes_used, CASE WHEN size <= {MAX_BYTES} THEN 1 ELSE 0 END AS file_count,
         CASE WHEN size <= {MAX_BYTES} THEN [reservation_id] ELSE [] END AS open FROM n WHERE i = 1
  UNION ALL
  SELECT tenant_id, user_id, period, seq, kind, reservation_id, size, i, outcome, used + CASE outcome WHEN 'reserved' THEN size WHEN 'released' THEN -size ELSE 0 END, files + CASE outcome WHEN 'reserved' THEN 1 WHEN 'released' THEN -1 ELSE 0 END,
         CASE WHEN outcome = 'reserved' THEN list_append(held, reservation_id) WHEN outcome IN ('committed', 'released') THEN list_filter(held, lambda o: o <> reservation_id) ELSE held END
  FROM (SELECT n.*, r.bytes_used AS used, r.file_count AS files, r.open AS held,
               CASE WHEN n.kind = 'reserve' THEN CASE WHEN r.bytes_used + n.size <= {MAX_BYTES} AND r.file_count + 1 <= {MAX_FILES} THEN 'reserved' ELSE 'rejected' END
                    WHEN NOT list_contains(r.open, n.reservation_id) THEN 'ignored' WHEN n.kind = 'commit' THEN 'committed' ELSE 'released' END AS outcome
        FROM r JOIN n ON n.user_id = r.user_id AND n.period = r.period AND n.i = r.i + 1))
"""
SQL = {
    "gv4_ledger": _LEDGER + "SELECT tenant_id, user_id, period, seq, kind, reservation_id, size, outcome, bytes_used, file_count FROM r",
    "gv4_usage": _LEDGER + "SELECT tenant_id, user_id, period, arg_max(bytes_used, i) AS bytes_used, arg_max(file_count, i) AS file_count, " + ", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS {o}" for o in ("reserved", "rejected", "committed", "released", "ignored")) + " FROM r GROUP BY tenant_id, user_id, period",
    "gv5_trail": _LEDGER + """SELECT case_id, rank, seq, actor, event_type, outcome, reservation_id FROM (
  SELECT o_custkey AS case_id, row_number() OVER (PARTITION BY o_custkey ORDER BY seq DESC, reservation_id DESC) AS rank, seq, user_id AS actor, 'upload_' || kind AS event_type, CASE WHEN outcome IN ('rejected', 'ignored') THEN 'denied' ELSE 'allowed' END AS outcome, reservation_id
  FROM r JOIN orders ON o_orderkey = CAST(string_split(reservation_id, '-')[1] AS BIGINT)) WHERE rank <= 20""",
}
