"""Case records, requests and the like, derived from the given tables; each view has a DataFrame and an SQL form."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.text import stable_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files are fewer than they, since a small file is one task; else df, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df marked for a broadcast if a count finds it within the given rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def require_one_case(df: DataFrame, key: str = "case_id") -> DataFrame:
    """df, for callers that may only be given one case: an error if its rows are of several."""
    if len(df.select(key).distinct().head(2)) > 1:
        raise ValueError("the rows must belong to one case")
    return df


_written: list[str] = []
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's spark.checkpoint.dir.

    Where it is unset (tests in local mode) a folder of this machine is set for the session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="caseloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet into the shared folder and read back, which cuts its lineage, for plans that use it in
    many places or must survive lost executors. The files of the shuffles that led to it go when it is written, not
    when the driver's garbage is collected."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    own = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, own) if own else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, name: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no plan will read any more."""
    for t in tables:
        folders = {f.rsplit("/", 2)[1] for f in t.inputFiles()}
        for path in [w for w in _written if w.rsplit("/", 1)[1] in folders]:
            _written.remove(path)
            _delete(t.sparkSession, path)


def remove_stored(spark: SparkSession) -> int:
    """Delete the tables that this process has stored, once no DataFrame made from them is needed; how many they were."""
    n = 0
    while _written:
        n += _delete(spark, _written.pop())
    return n


def record_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three text blocks for each order, as a case record of its customer."""
    orders, customers, nations, regions = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    places = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("o_orderkey")
    amount = F.col("o_totalprice").cast("decimal(12,2)").cast("string")
    day = lambda f: F.date_format("o_orderdate", f)
    texts = F.array(
        F.concat(F.lit("Petitioner: "), "c_mktsegment", F.lit(" "), "r_name", F.lit("\nRespondent: State of "), "n_name"),
        F.concat(F.lit("FIR No. "), (key % 900 + 10).cast("string"), F.lit(" of "), day("yyyy"), F.lit(" was presented on "), day("dd/MM/yyyy"), F.lit(". The complaint refers to Section "), (key % 400 + 100).cast("string"), F.lit(" of the Code. The disputed amount is Rs. "), amount, F.lit(" and the number is 9"), F.lpad((key % 1000000000).cast("string"), 9, "0"), F.lit(".")),
        F.concat(F.lit("The matter was mentioned before the Supreme Court of India and the District Magistrate on 7 March "), day("yyyy"), F.lit(", with Annexure A.")),
    )
    # a small scan gives few tasks, and the rules over the text are what takes time; the texts are made after the shuffle
    dealt = rows.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "c_mktsegment", "r_name", "n_name").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    flat = dealt.select(
        F.lit("t1").alias("tenant_id"), F.col("o_custkey").cast("string").alias("case_id"), key.cast("string").alias("version_id"),
        key.alias("document_order"), F.concat(F.lit("record "), key.cast("string")).alias("document_name"),
        F.when(key % 10 == 0, "ocr_required").when(key % 10 == 1, "partial").otherwise("ready").alias("status"),
        F.when(key % 3 == 0, 0.6).when(key % 3 == 1, 0.8).otherwise(1.0).alias("confidence"), F.posexplode(texts).alias("sequence", "text"),
    )
    return flat.withColumn("block_id", stable_id("blk_", "version_id", F.lit("1"), F.col("sequence").cast("string"), "text", size=20))


RECORD_BLOCKS = """
base AS (
  SELECT CAST(o_custkey AS VARCHAR) AS case_id, CAST(o_orderkey AS VARCHAR) AS version_id, o_orderkey AS document_order,
         'record ' || CAST(o_orderkey AS VARCHAR) AS document_name,
         CASE WHEN o_orderkey % 10 = 0 THEN 'ocr_required' WHEN o_orderkey % 10 = 1 THEN 'partial' ELSE 'ready' END AS status,
         CASE WHEN o_orderkey % 3 = 0 THEN 0.6::DOUBLE WHEN o_orderkey % 3 = 1 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS confidence,
         unnest([0, 1, 2]) AS sequence,
         unnest([
           'Petitioner: ' || c_mktsegment || ' ' || r_name || chr(10) || 'Respondent: State of ' || n_name,
           'FIR No. ' || CAST(o_orderkey % 900 + 10 AS VARCHAR) || ' of ' || strftime(o_orderdate, '%Y') || ' was presented on '
             || strftime(o_orderdate, '%d/%m/%Y') || '. The complaint refers to Section ' || CAST(o_orderkey % 400 + 100 AS VARCHAR)
             || ' of the Code. The disputed amount is Rs. ' || CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) || ' and the number is 9'
             || lpad(CAST(o_orderkey % 1000000000 AS VARCHAR), 9, '0') || '.',
           'The matter was mentioned before the Supreme Court of India and the District Magistrate on 7 March '
             || strftime(o_orderdate, '%Y') || ', with Annexure A.']) AS text
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
blocks AS (SELECT *, 'blk_' || substr(sha256(version_id || ':1:' || CAST(sequence AS VARCHAR) || ':' || text), 1, 20) AS block_id FROM base)
"""


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines as blocks of the case that its source stands for."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    lines = docs.select(F.col("source").alias("case_id"), F.col("doc_id").alias("document_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("sequence", "text"))
    return lines.withColumn("sequence", F.col("sequence").cast("long"))


DOCUMENT_LINES = """
lines AS (
  SELECT source AS case_id, doc_id AS document_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS sequence, unnest(l) AS text
  FROM (SELECT source, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
"""
