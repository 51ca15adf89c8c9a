"""Pages of parsed documents: normalised blocks, text quality, numbering, status, counters and limits."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.functions.text import stable_id

#: The cut-offs of page confidence by kind of source, and the limits with their error codes.
LOW_PDF, LOW_IMAGE = 0.60, 0.65
LIMITS = {"pages": 500, "images_per_page": 200, "embedded_pixels": 500_000_000, "text_chars": 2_000_000, "page_pixels": 40_000_000, "ocr_pixels": 500_000_000}
#: The weights and bounds of the quality score.
WEIGHTS = {"length": 0.30, "printable": 0.25, "alpha": 0.20, "words": 0.15, "lines": 0.10}
NOISE_MOST, NOISE_BAD, NOISE_RUN = 0.55, 2.5, 0.08


@F.pandas_udf(T.StringType())
def _compatible(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalised(text: Column) -> Column:
    """NFKC, no NUL, LF line ends, single spaces, trimmed lines, at most one blank line in a row; null becomes empty.
    Only texts with characters beyond ASCII leave generated code."""
    text = F.coalesce(text, F.lit(""))
    text = F.when(text.rlike(r"[^\x00-\x7F]"), _compatible(text)).otherwise(text)
    text = F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("\0"), F.lit("")), "\r\n?", "\n"), r"[\t\f\x0B ]+", " ")
    text = F.regexp_replace(text, r"(?md)^[[\s\p{Z}\x1C-\x1F\x85]&&[^\n]]+|[[\s\p{Z}\x1C-\x1F\x85]&&[^\n]]+$", "")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"\A\n+|\n+\z", "")


def quality(text: Column) -> Column:
    """score, characters, words, printable_ratio, alphanumeric_ratio, replacement_ratio of a normalised text."""
    space = r"\s\p{Z}\x1C-\x1F\x85"
    n = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    c = n(f"[^{space}]")
    hidden = n(rf"[\p{{C}}&&[^{space}]]")
    bad = n(rf"[\x{{FFFD}}\p{{Cc}}&&[^{space}]]")
    printable, alpha, replaced = (c - hidden) / c, n(r"[\p{L}\p{N}]") / c, bad / c
    lines = F.greatest(n(rf"[^\n]*[^{space}][^\n]*"), F.lit(1.0))
    one = F.lit(1.0)
    noise = F.least(F.lit(NOISE_MOST), replaced * NOISE_BAD + n(rf"[^\p{{L}}\p{{N}}_{space}]{{5,}}") * NOISE_RUN)
    score = (
        WEIGHTS["length"] * F.least(c / 80, one) + WEIGHTS["printable"] * printable + WEIGHTS["alpha"] * F.least(alpha / 0.45, one)
        + WEIGHTS["words"] * F.least(n(r"[\p{L}\p{N}_]+") / 12, one) + WEIGHTS["lines"] * F.least(lines / 5, one) - noise
    )
    full = c > 0
    four = lambda x: F.floor(x * 10_000 + 0.5) / 10_000
    safe = lambda x: F.when(full, four(x)).otherwise(0.0)
    return F.struct(
        F.when(full, F.greatest(F.lit(0.0), F.least(one, four(score)))).otherwise(0.0).alias("score"), c.cast("long").alias("characters"),
        n(r"[\p{L}\p{N}_]+").cast("long").alias("words"), safe(printable).alias("printable_ratio"), safe(alpha).alias("alphanumeric_ratio"), safe(replaced).alias("replacement_ratio"),
    )


def renumbered(blocks: DataFrame) -> DataFrame:
    """version_id, page_number, sequence (anew from 0), block_id, characters, issue: blocks (version_id, page_number,
    sequence, text) with normalised texts; issue is empty or duplicate where a block breaks the rules, else null."""
    b = blocks.withColumn("text", normalised(F.col("text")))
    b = b.withColumn("at", F.row_number().over(Window.partitionBy("version_id", "page_number").orderBy("sequence")) - 1)
    b = b.withColumn("block_id", stable_id("blk_", F.col("version_id").cast("string"), F.col("page_number").cast("string"), F.col("at").cast("string"), "text", size=20))
    twice = F.count("*").over(Window.partitionBy("version_id", "page_number", "block_id")) > 1
    issue = F.when(F.col("text") == "", "empty").when(twice, "duplicate")
    return b.select("version_id", "page_number", F.col("at").cast("long").alias("sequence"), "block_id", F.length("text").cast("long").alias("characters"), issue.alias("issue"))


def page_report(pages: DataFrame, low: float = LOW_PDF) -> DataFrame:
    """One row a version of its pages (version_id, page_number, method, confidence, block_count, failed, warnings):
    counters by method, pages without blocks, pages of low confidence, all warnings in page order, and the status."""
    empty, weak = F.col("block_count") == 0, (F.col("block_count") > 0) & (F.col("confidence") < low)
    listed = lambda when: F.array_join(F.array_sort(F.collect_list(F.when(when, F.col("page_number")))).cast("array<string>"), ",")
    told = F.transform(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "warnings"))), lambda p: F.transform(p["warnings"], lambda w: F.concat(F.lit("Page "), p["page_number"].cast("string"), F.lit(": "), w)))), lambda w: w)
    out = pages.groupBy("version_id").agg(
        F.count("*").alias("page_count"), *[F.count_if(F.col("method") == m).alias(f"{m}_pages") for m in ("digital", "ocr", "mixed")], F.count_if("failed").alias("failed_pages"),
        listed(empty).alias("missing_pages"), listed(weak).alias("low_confidence_pages"), F.count_if(empty).alias("_missing"), F.count_if(weak).alias("_low"), F.array_join(told, "|").alias("warnings"),
    )
    status = F.when(F.col("_missing") == F.col("page_count"), "ocr_required").when((F.col("_missing") > 0) | (F.col("_low") > 0) | (F.col("failed_pages") > 0), "partial").otherwise("ready")
    return out.withColumn("status", status).drop("_missing", "_low")


def limits(pages: DataFrame, most: dict[str, int] | None = None) -> DataFrame:
    """version_id, page_number, error_code of the first limit that a version breaks, in page order. pages: version_id,
    page_number, images, embedded_pixels, text_chars, page_pixels, needs_ocr. Pixels are summed over the pages before."""
    most = LIMITS | (most or {})
    before = Window.partitionBy("version_id").orderBy("page_number")
    p = pages.withColumns({
        "all_embedded": F.sum("embedded_pixels").over(before), "all_ocr": F.sum(F.when(F.col("needs_ocr"), F.col("page_pixels")).otherwise(0)).over(before),
        "n_pages": F.count("*").over(Window.partitionBy("version_id")), "first": F.min("page_number").over(Window.partitionBy("version_id")),
    })
    code = (
        F.when((F.col("n_pages") > most["pages"]) & (F.col("page_number") == F.col("first")), "pdf_page_limit").when(F.col("images") > most["images_per_page"], "pdf_image_count_limit")
        .when(F.col("all_embedded") > most["embedded_pixels"], "pdf_decompression_limit").when(F.col("text_chars") > most["text_chars"], "pdf_text_expansion_limit")
        .when(F.col("needs_ocr") & (F.col("page_pixels") > most["page_pixels"]), "pdf_page_pixel_limit").when(F.col("needs_ocr") & (F.col("all_ocr") > most["ocr_pixels"]), "pdf_total_pixel_limit")
    )
    bad = p.withColumn("code", code).filter("code is not null")
    return bad.groupBy("version_id").agg(F.min(F.struct("page_number", "code")).alias("x")).select("version_id", "x.page_number", F.col("x.code").alias("error_code"))
