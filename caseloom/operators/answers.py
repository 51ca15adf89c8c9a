"""Grounded answers: document mentions in questions, useful hits, fallback blocks, and citation checks of generated text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions.text import folded

QUOTED, BARE = r'@"([^"]+)"', r'(^|\s)@([^\s"@]+)'
WORD, LOW_INFORMATION = r"[\p{L}\p{N}_]+", "A low-information source block was retrieved."
#: How lines start or read that need no citation.
OPENINGS = ("inference:", "insufficient evidence", "caveat:")
HEADINGS = r"(?i)^(answer|summary|source cards?|questions to ask.*|next actions?|regarding .+|what this means)$"


def cleaned(text: Column, limit: int) -> Column:
    """White space collapsed, marks at both ends off, cut with three dots; a fixed text if nothing is left."""
    flat = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "), r"^[ .,-]+|[ .,-]+$", "")
    cut = F.when(F.length(flat) > limit, F.concat(F.rtrim(F.substring(flat, 1, limit - 3)), F.lit("..."))).otherwise(flat)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit(LOW_INFORMATION))


def name_key(name: Column) -> Column:
    """A file name without its suffix, with letters and digits only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"\.[a-z0-9]+$", ""), "[^a-z0-9]+", " "))


def scopes(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """query_id, question without mentions, targets (upload ids in mention order), unmatched mentions.

    A mention means the document of its case with that very name (regardless of case), else the first whose plain name
    equals, holds or is held by the mention's. documents: case_id, upload_id, original_name.
    """
    rest = F.regexp_replace("query", r'@"[^"]+"', " ")
    told = questions.select("query_id", "case_id", F.posexplode(F.concat(F.regexp_extract_all("query", F.lit(QUOTED), F.lit(1)), F.regexp_extract_all(rest, F.lit(BARE), F.lit(2)))).alias("i", "mention"))
    d = documents.select("case_id", "upload_id", F.lower("original_name").alias("name"), name_key(F.col("original_name")).alias("key"))
    low, key = F.lower("mention"), name_key(F.col("mention"))
    fits = (key != "") & ((F.col("name") == low) | F.contains("key", key) | F.contains(key, F.col("key")))
    met = told.join(d, "case_id").filter(fits).groupBy("query_id", "i").agg(F.min(F.struct(F.when(F.col("name") == low, 0).otherwise(1).alias("q"), "upload_id"))["upload_id"].alias("upload_id"))
    all_ = told.join(met, ["query_id", "i"], "left").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("i", "mention", "upload_id"))).alias("m"))
    clean = F.trim(F.regexp_replace(F.regexp_replace(rest, BARE, " "), r"\s+", " "))
    ids = F.array_distinct(F.transform(F.filter("m", lambda x: x["upload_id"].isNotNull()), lambda x: x["upload_id"].cast("string")))
    lost = F.transform(F.filter("m", lambda x: x["upload_id"].isNull()), lambda x: x["mention"])
    out = questions.select("query_id", "case_id", F.coalesce(F.nullif(clean, F.lit("")), F.trim("query")).alias("question")).join(all_, "query_id", "left")
    return out.select("query_id", "case_id", "question", F.coalesce(F.array_join(ids, ","), F.lit("")).alias("targets"), F.coalesce(F.array_join(lost, "|"), F.lit("")).alias("unmatched"))


def broad(questions: DataFrame, hits: DataFrame, blocks: DataFrame, n: int = 3) -> DataFrame:
    """For questions without a hit, the first blocks of their case with eight words or more."""
    missed = questions.join(hits.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "case_id")
    r = F.row_number().over(Window.partitionBy("case_id").orderBy("document_id", "sequence"))
    first = blocks.filter(F.regexp_count(cleaned(F.col("text"), 900), F.lit(WORD)) >= 8).select("case_id", "document_id", "sequence").withColumn("rank", r.cast("long")).filter(F.col("rank") <= n)
    return missed.join(first, "case_id")


def summaries(hits: DataFrame, n: int = 3) -> DataFrame:
    """query_id, summary: the first hits with 30 letters or digits and six words (any hits if none has), as a cited text."""
    seen = cleaned(F.col("text"), 480)
    marked = hits.withColumn("useful", (F.regexp_count(seen, F.lit("[A-Za-z0-9]")) >= 30) & (F.regexp_count(seen, F.lit(WORD)) >= 6))
    listed = marked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "useful", "text"))).alias("h"))
    good = F.filter("h", lambda x: x["useful"])
    top = F.slice(F.when(F.size(good) > 0, good).otherwise(F.col("h")), 1, n)
    return listed.select("query_id", F.array_join(F.transform(top, lambda x, i: F.concat(cleaned(x["text"], 175), F.lit(" ["), (i + 1).cast("string"), F.lit("]"))), "; ").alias("summary"))


def needs_citation(line: Column) -> Column:
    """Whether a line states something: it has letters and is no heading, label, inference or caveat."""
    trim = F.regexp_replace(line, r"^\s+|\s+$", "")
    plain = F.regexp_replace(F.regexp_replace(trim, r"^[#>*\-\d.\s]+", ""), r"^[ *_]+|[ *_]+$", "")
    label = plain.endswith(":") & (F.length(plain) <= 110)
    opening = F.lit(False)
    for o in OPENINGS:
        opening = opening | folded(plain).startswith(o)
    return trim.rlike("[A-Za-z0-9]") & (plain != "") & ~opening & ~label & ~plain.rlike(HEADINGS)


def repaired(answer: Column, sources: Column) -> Column:
    """The answer with the first three sources cited on each line that states something and cites none."""
    marks = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.least(sources, F.lit(3)), F.lit(1))), lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("]"))), "")

    def line(x: Column) -> Column:
        x = F.regexp_replace(x, r"\s+$", "")
        return F.when(needs_citation(x) & ~x.rlike(r"\[\d+\]"), F.concat(x, F.lit(" "), marks)).otherwise(x)

    done = F.array_join(F.transform(F.split(F.replace(answer, F.lit("\r\n"), F.lit("\n")), "\n"), line), "\n")
    return F.regexp_replace(F.when(sources > 0, done).otherwise(answer), r"^\s+|\s+$", "")


def checked(answers: DataFrame) -> DataFrame:
    """answers (answer, sources) with repaired, cited (numbers in order) and the reason to reject, null if none."""
    out = answers.withColumn("repaired", repaired(F.col("answer"), F.col("sources")))
    cited = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("repaired", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("decimal(38,0)"))))
    out = out.withColumn("numbers", cited)
    wrong = F.exists("numbers", lambda x: x.isNull() | (x < 1) | (x > F.col("sources")))
    bare = F.exists(F.split("repaired", r"(?<=[.!?])\s+|\n+"), lambda x: needs_citation(x) & ~x.rlike(r"\[\d+\]"))
    reason = F.when((F.col("repaired") == "") | (F.size("numbers") == 0) | wrong, "no valid source citations").when(bare, "factual lines without citations")
    return out.withColumn("rejected", reason).withColumn("cited", F.array_join(F.transform("numbers", lambda x: x.cast("string")), ",")).drop("numbers")
