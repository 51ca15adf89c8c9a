"""How well files were read, against what is known of them: four rates, and the gates that they miss."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions.text import folded

#: The least rates of a strict run.
GATES = {"parse_success_rate": 0.90, "expected_fragment_recall": 0.80, "structured_table_recall": 0.90, "page_diagnostic_coverage": 0.95}


def cell_counts(documents: DataFrame, tables: str) -> DataFrame:
    """id, cell, n: how often a document's tables (array of rows of cells) hold each cell; empty cells don't count."""
    cells = documents.select("id", F.explode(F.flatten(tables)).alias("cell")).filter("cell is not null and cell <> ''")
    return cells.groupBy("id", "cell").agg(F.count("*").alias("n"))


def table_recall(documents: DataFrame, found: str = "table", expected: str = "expected_table") -> DataFrame:
    """id, expected_cells, found_cells: expected and parsed cells matched as multisets, so a cell that is expected twice
    must be there twice, wherever it stands. Documents without an expected cell have no row."""
    want = cell_counts(documents.filter(F.col(expected).isNotNull()), expected)
    got = cell_counts(documents.filter(F.col(found).isNotNull()), found).withColumnRenamed("n", "got")
    met = want.join(got, ["id", "cell"], "left")
    return met.groupBy("id").agg(F.sum("n").alias("expected_cells"), F.sum(F.least("n", F.coalesce("got", F.lit(0)))).alias("found_cells"))


def evaluated(documents: DataFrame, group: str, complete: float = 1.0) -> DataFrame:
    """Rates of each group of documents: id, status, text, fragments, table and expected_table (rows of cells, null where
    there is none), pages (array of method and confidence).

    A document is read if its status is ready or partial; a fragment is recalled if the folded text holds it; a table is
    found if at least the share `complete` of its expected cells is; a page is diagnosed if it has a method and a
    confidence from 0 to 1. Groups without fragments, tables or pages have the rate 0 there, which is below its gate.
    """
    cells = table_recall(documents).select("id", (F.col("found_cells") >= complete * F.col("expected_cells")).alias("whole"))
    low = folded(F.coalesce("text", F.lit("")))
    each = documents.join(cells, "id", "left").select(
        group, "status", F.size(F.coalesce("fragments", F.array().cast("array<string>"))).alias("wanted"), F.size(F.filter(F.coalesce("fragments", F.array().cast("array<string>")), lambda f: F.contains(low, folded(f)))).alias("hits"),
        F.col("expected_table").isNotNull().cast("int").alias("tables"), (F.col("expected_table").isNotNull() & F.coalesce("whole", F.lit(False))).cast("int").alias("whole"),
        F.size(F.coalesce("pages", F.array().cast("array<struct<method:string,confidence:double>>"))).alias("n_pages"), F.size(F.filter(F.coalesce("pages", F.array().cast("array<struct<method:string,confidence:double>>")), lambda p: (p["method"] != "none") & p["confidence"].between(0.0, 1.0))).alias("good_pages"),
    )
    rate = lambda a, b: F.round(F.sum(a) / F.greatest(F.sum(b), F.lit(1)), 4)
    m = each.groupBy(group).agg(
        F.count("*").alias("documents"), F.count_if(F.col("status").isin("ready", "partial")).alias("successful_documents"), F.round(F.count_if(F.col("status").isin("ready", "partial")) / F.count("*"), 4).alias("parse_success_rate"),
        rate("hits", "wanted").alias("expected_fragment_recall"), rate("whole", "tables").alias("structured_table_recall"), rate("good_pages", "n_pages").alias("page_diagnostic_coverage"),
    )
    return m.withColumn("failures", F.concat_ws(",", *[F.when(F.col(name) < least, name) for name, least in GATES.items()]))
