"""Registered queries over uploads, blocks, requests, jobs, cases and evaluation runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions.text import stable_id
from caseloom.sources.views import small, spread, stored, table

# -- uploads and versions --------------------------------------------------------------------------------------------


def uploads(spark, sf_dir) -> DataFrame:
    """Each document as an upload of its source; names repeat, so that later texts are new versions."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("case_id"), F.col("doc_id").alias("upload_id"), F.concat("lang", F.lit(" File#"), (F.col("doc_id") % 7).cast("string"), F.lit(".TXT")).alias("original_name"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))


def safe_name(name):
    """The base name with unusual characters as underscores, 180 characters at most."""
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"[^A-Za-z0-9._ -]", "_"), 1, 180), F.lit("")), F.lit("upload.bin"))


def versions(up: DataFrame) -> DataFrame:
    """Duplicates point to the first upload with the same bytes; others number the versions of their document."""
    same = Window.partitionBy("case_id", "sha256").orderBy("upload_id")
    marked = up.withColumns({"n": F.row_number().over(same), "first_upload": F.first("upload_id").over(same)})
    document = stable_id("doc_", "case_id", F.lower("original_name"))
    number = F.row_number().over(Window.partitionBy("case_id", F.lower("original_name"), F.col("n") > 1).orderBy("upload_id"))
    return marked.select("case_id", "upload_id", safe_name(F.col("original_name")).alias("file_name"), document.alias("document_id"), "sha256", "size", (F.col("n") > 1).cast("string").alias("duplicate"), "first_upload", F.when(F.col("n") == 1, number).cast("long").alias("version"))


def src9_versions(spark, sf_dir):
    return versions(uploads(spark, sf_dir))


def src12_latest(spark, sf_dir):
    v = versions(uploads(spark, sf_dir)).filter("version is not null")
    return v.groupBy("case_id", "document_id").agg(F.max_by("upload_id", "version").alias("upload_id"), F.max("version").alias("version"))


def src11_incremental(spark, sf_dir):
    """Uploads whose bytes their case doesn't have yet, against the manifest of labelled documents; repeats in the batch count once."""
    up = uploads(spark, sf_dir)
    held = up.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("upload_id")), "upload_id", "left_semi").select("case_id", "sha256").distinct()
    return up.join(held, ["case_id", "sha256"], "left_anti").groupBy("case_id", "sha256").agg(F.min("upload_id").alias("upload_id"))


def blk8_headings(spark, sf_dir):
    """Lines of at most 14 words of whose letters 65 % or more are capitals."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text"))
    letters, capitals = (F.regexp_count("text", F.lit(p)) for p in (r"\p{L}", r"\p{Lu}"))
    return d.filter((F.regexp_count("text", F.lit(r"[^\s]+")) <= 14) & (letters > 0) & (capitals / letters >= 0.65)).select("doc_id", F.col("line").cast("long").alias("line"), "text")


def blk15_fingerprints(spark, sf_dir):
    """Texts that more than one document of a source has, by fingerprint."""
    d = table(spark, sf_dir, "documents").select("source", F.sha2(F.concat_ws("|", "lang", "text"), 256).alias("fingerprint"), "doc_id")
    return d.groupBy("source", "fingerprint").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


def blk16_titles(spark, sf_dir):
    """Page titles without tags and with single spaces."""
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_replace(F.regexp_replace(title, "<[^>]+>", ""), r"\s+", " ")).alias("title"))


def rs1_allowed_urls(spark, sf_dir):
    """Pages of allowed hosts, over https, whose path is a language and a number."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", r"^https://([^/?#@]+)/", 1).alias("host"), F.regexp_extract("url", r"^https://[^/?#@]+(/[a-z]{2}/[0-9]+/?)$", 1).alias("path"))
    return p.select("page_id", ((F.col("path") != "") & F.col("host").rlike(r"(^|\.)example\.(com|org)$")).cast("string").alias("allowed"))


# -- requests, audit and jobs ----------------------------------------------------------------------------------------


#: What is taken out, in this order, and what stands there instead.
REDACTED = [
    (r"(?i)bearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [REDACTED]"),
    (r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", "[REDACTED-PAN]"),
    (r"\b\d{4}[ -]?\d{4}[ -]?\d{4}\b", "[REDACTED-ID]"),
    (r"(?<!\d)(?:\+91[ -]?)?[6-9]\d{9}(?!\d)", "[REDACTED-PHONE]"),
    (r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "[REDACTED-EMAIL]"),
]


def redacted(text):
    """Tokens, tax ids, national ids, phones and e-mails taken out, in this order."""
    for pattern, instead in REDACTED:
        text = F.regexp_replace(text, pattern, instead)
    return text


def gv1_redacted(spark, sf_dir):
    """Audit lines with tokens, tax ids, national ids, phones and e-mails taken out, in this order."""
    e = table(spark, sf_dir, "events")
    digits = F.lpad((F.col("event_id") % 1000000000).cast("string"), 9, "0")
    n = F.col("event_id")
    line = F.concat(
        F.when(n % 3 == 0, "bearer  abc.").when(n % 3 == 1, "Bearer abc.").otherwise("Basic abc."), n.cast("string"), F.when(n % 4 == 0, " pan ABCDE12345").otherwise(" pan ABCDE1234F"), F.when(n % 5 == 0, " id 1234-5678-9012").when(n % 5 == 1, " id 1234 5678 901").otherwise(" id 123456789012"),
        F.when(n % 7 == 0, " tel 5").otherwise(" tel +91 9"), digits, F.when(n % 2 == 0, " mail user").otherwise(" mail @user"), F.col("user_id").cast("string"), F.lit("@Example.com did "), "event_type",
    )
    return e.select("event_id", redacted(line).alias("line"))


def rate_windows(events: DataFrame, limit: int, seconds: int) -> DataFrame:
    """Each request's count in its fixed window (denied ones count as well), whether it is allowed, what is left."""
    start = F.floor(F.unix_timestamp("ts") / seconds) * seconds
    n = F.row_number().over(Window.partitionBy("user_id", "event_type", "start").orderBy("ts", "event_id"))
    w = events.withColumn("start", start).withColumn("n", n.cast("long"))
    return w.select("event_id", "user_id", F.col("event_type").alias("bucket"), F.col("start").alias("window_start"), "n", (F.col("n") <= limit).cast("string").alias("allowed"), F.greatest(F.lit(limit) - F.col("n"), F.lit(0)).cast("long").alias("remaining"), (F.col("start") + seconds - F.unix_timestamp("ts")).cast("long").alias("retry_after"))


def gv3_rate_windows(spark, sf_dir):
    return rate_windows(table(spark, sf_dir, "events"), 2, 86_400)


def gv5_audit(spark, sf_dir):
    """The latest 5 events of each actor, newest first."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 5").select("user_id", "rank", "event_id", "event_type")


def gv4_quota(spark, sf_dir):
    """Greedy monthly quota in arrival order: an upload that doesn't fit is rejected and uses nothing. A task keeps one
    batch and the running total of the user and month at hand; sizes that are null are rejected."""
    import pyarrow as pa

    keys = ["user_id", "month", "l_orderkey", "l_linenumber", "bytes"]
    l = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("long").alias("user_id"), F.date_format("l_shipdate", "yyyy-MM").alias("month"), F.col("l_orderkey").cast("long").alias("l_orderkey"), F.col("l_linenumber").cast("long").alias("l_linenumber"), F.round("l_extendedprice").cast("long").alias("bytes"))
    limit = 150_000

    def run(batches):
        now, used = None, 0
        for b in batches:
            ok = []
            for user, month, size in zip(*(b.column(i).to_pylist() for i in (0, 1, 4))):
                if (user, month) != now:
                    now, used = (user, month), 0
                ok.append(size is not None and used + size <= limit)
                used += size if ok[-1] else 0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ok, pa.bool_())], names=[*keys, "accepted"])

    dealt = l.repartition("user_id", "month").sortWithinPartitions(*[F.asc_nulls_last(c) for c in keys])
    return dealt.mapInArrow(run, "user_id long, month string, l_orderkey long, l_linenumber long, bytes long, accepted boolean")


TERMINAL = ["purchase", "error"]


def job_events(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    s = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("job_id"), s.cast("long").alias("sequence"), "event_type", "ts", "event_id")


def jb3_sequences(spark, sf_dir):
    return job_events(spark, sf_dir).select("job_id", "sequence", "event_id", "event_type")


def jb4_state(spark, sf_dir):
    j = job_events(spark, sf_dir).groupBy("job_id").agg(F.max_by("event_type", "sequence").alias("status"), F.count_if(F.col("event_type") == "click").alias("attempts"), F.max("sequence").alias("last_sequence"))
    return j.withColumn("terminal", F.col("status").isin(*TERMINAL).cast("string"))


def jb5_after(spark, sf_dir):
    """Up to 3 events of each job after sequence 10."""
    w = Window.partitionBy("job_id").orderBy("sequence")
    return job_events(spark, sf_dir).filter("sequence > 10").withColumn("r", F.row_number().over(w)).filter("r <= 3").select("job_id", "sequence", "event_type")


def jb1_keys(spark, sf_dir):
    """A key for each order's set of lines that doesn't depend on their order."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber"))).alias("p"))
    return l.select("l_orderkey", F.sha2(F.concat(F.lit("{\"lines\":["), F.array_join("p", ","), F.lit("]}")), 256).alias("key"))


def jb6_retries(spark, sf_dir):
    """Delay and next state after each job's failed attempts."""
    j = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("job_id")).agg(F.count_if(F.col("event_type") == "error").alias("attempts"))
    delay = F.least(F.lit(15) * F.pow(F.lit(2), F.greatest(F.col("attempts") - 1, F.lit(0))), F.lit(300)).cast("long")
    return j.select("job_id", "attempts", delay.alias("delay"), F.when(F.col("attempts") < 12, "queued").otherwise("failed").alias("next_state"))


def jb7_leases(spark, sf_dir):
    """What becomes of jobs whose last sign of life is older than 90 seconds, as of the last event of all."""
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("now"))
    j = e.groupBy(F.col("user_id").alias("job_id")).agg(F.max("ts").alias("seen"), F.count_if(F.col("event_type") == "error").alias("attempts"), F.max(F.when(F.col("event_type") == "signup", 1).otherwise(0)).alias("cancel"))
    old = F.unix_timestamp("now") - F.unix_timestamp("seen") > 90
    return j.join(F.broadcast(now)).select("job_id", F.when(~old, "running").when(F.col("cancel") == 1, "cancelled").when(F.col("attempts") >= 12, "failed").otherwise("requeued").alias("outcome"))


# -- cases -----------------------------------------------------------------------------------------------------------


def cases(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.element_at(F.array(*[F.lit(x) for x in ("intake", "classified", "drafting", "ready", "filed", "resolved", "escalated")]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), "o_orderpriority", status.alias("status"), F.concat(F.lit("Case "), "o_orderpriority", F.lit(" "), "o_orderstatus").alias("title"), F.col("o_orderdate").alias("created_at"))


def an1_case_list(spark, sf_dir):
    """The first page of 20 for a search in titles, newest first, with the number of hits and pages."""
    hit = cases(spark, sf_dir).filter(F.lower("title").contains("urgent") & (F.col("status") == "ready"))
    total = hit.agg(F.count("*").alias("total"))
    page = hit.orderBy(F.desc("created_at"), "id").limit(20)
    return page.join(F.broadcast(total)).select("id", "title", F.date_format("created_at", "yyyy-MM-dd").alias("created"), "total", F.ceil(F.col("total") / 20).alias("pages"))


def an2_recent(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    return cases(spark, sf_dir).withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 10").select("user_id", "rank", "id", "status")


def an3_buckets(spark, sf_dir):
    s = F.col("status")
    return cases(spark, sf_dir).groupBy("user_id").agg(F.count_if(s == "ready").alias("ready"), F.count_if(s.isin("filed", "resolved")).alias("filed"), F.count_if(~s.isin("ready", "filed", "resolved")).alias("in_progress"), F.count("*").alias("total"))


def an4_week(spark, sf_dir):
    """Cases on each of the seven days up to the last one, days without any included."""
    c = cases(spark, sf_dir).select(F.to_date("created_at").alias("day"))
    last = c.agg(F.max("day").alias("last"))
    days = last.select(F.explode(F.sequence(F.date_sub("last", 6), F.col("last"))).alias("day"))
    counted = c.groupBy("day").agg(F.count("*").alias("n"))
    return days.join(counted, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


def an8_followups(spark, sf_dir):
    """Filed cases are looked at after 7 days; those due as of the last day and still unknown are escalated."""
    c = cases(spark, sf_dir).filter("status = 'filed'").select("id", F.date_add(F.to_date("created_at"), 7).alias("due"), F.when(F.col("id") % 3 == 0, "unknown").otherwise("listed").alias("court_status"))
    last = table(spark, sf_dir, "orders").agg(F.to_date(F.max("o_orderdate")).alias("today"))
    return c.join(F.broadcast(last)).filter("due <= today").select("id", F.col("due").cast("string").alias("due"), F.when(F.col("court_status") == "unknown", "escalated").otherwise("checked").alias("outcome"))


def rv3_workspace(spark, sf_dir):
    """For each customer: orders, open orders, lines and value, each table grouped before the joins."""
    o = table(spark, sf_dir, "orders")
    by = o.groupBy("o_custkey").agg(F.count("*").alias("documents"), F.count_if(F.col("o_orderstatus") == "O").alias("open_documents"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines")).join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.sum("lines").cast("long").alias("lines"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id")).join(by, F.col("case_id") == F.col("o_custkey"), "left").drop("o_custkey").join(lines, F.col("case_id") == F.col("o_custkey"), "left").select("case_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "open_documents", "lines")])


def qa1_fragments(spark, sf_dir):
    """Which benchmark passages the documents of the matching source hold, regardless of case."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.lower(F.substring("text", 1, 80)).alias("fragment"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("source"))
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.lower("text").alias("low"))
    found = d.join(b, "source").filter(F.contains("low", "fragment")).groupBy("item_id").agg(F.count("*").alias("n"))
    return b.join(found, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n_documents"), F.col("n").isNotNull().cast("string").alias("recalled"))


def passages(benchmark: DataFrame, documents: DataFrame, run: int = 8) -> DataFrame:
    """Each whole passage, and all its runs of that many words (fewer if it is shorter), in all documents, regardless of
    case, marks and white space: documents that hold it whole, those that hold only some run, runs and runs found.

    Hashed runs that both sides have lead to pairs of a passage and a document, whose texts are then compared. Passages
    without words are found nowhere. benchmark: item_id, text; documents: doc_id (null or repeated ones count as rows), text.
    """
    words = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    held = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))

    def runs(w, n, made):
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: made(F.slice(w, i, n)))).otherwise(F.array())

    b = benchmark.select("item_id", words(F.col("text")).alias("w")).withColumn("n", F.least(F.size("w"), F.lit(run)))
    b = stored(b.filter("n > 0").distinct().select("item_id", "n", held(F.col("w")).alias("passage"), F.array_distinct(runs(F.col("w"), F.col("n"), held)).alias("runs")), "passages")
    keys = b.select("item_id", "n", F.explode("runs").alias("r")).select("item_id", F.xxhash64("n", "r").alias("key")).distinct()
    d = spread(documents.select("doc_id", "text"))
    sizes = [r["n"] for r in b.select("n").distinct().collect()]
    w = d.select("doc_id", words(F.col("text")).alias("w"))
    every = F.concat(F.array().cast("array<bigint>"), *[runs(F.col("w"), F.lit(n), lambda x, n=n: F.xxhash64(F.lit(n), held(x))).cast("array<bigint>") for n in sizes])
    met = w.select("doc_id", F.explode(every).alias("key")).join(small(keys), "key").select("item_id", "doc_id").distinct().withColumnRenamed("doc_id", "_doc")
    texts = met.join(d, F.col("_doc").eqNullSafe(F.col("doc_id"))).select("item_id", held(words(F.col("text"))).alias("low"))
    seen = texts.join(small(b), "item_id").withColumn("whole", F.contains("low", "passage"))
    seen = stored(seen.select("item_id", "whole", F.when(F.col("whole"), F.col("runs")).otherwise(F.filter("runs", lambda r: F.contains(F.col("low"), r))).alias("got")).filter("size(got) > 0"), "passages-met")
    counted = seen.groupBy("item_id").agg(F.count_if("whole").alias("n_documents"), F.count_if(~F.col("whole")).alias("n_partial"))
    found = seen.select("item_id", F.explode("got").alias("r")).distinct().groupBy("item_id").agg(F.count("*").alias("n_runs_found"))
    total = b.select("item_id", F.explode("runs").alias("r")).distinct().groupBy("item_id").agg(F.count("*").alias("n_runs"))
    out = benchmark.select("item_id").distinct().join(total, "item_id", "left").join(counted, "item_id", "left").join(found, "item_id", "left")
    return out.select("item_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_documents", "n_partial", "n_runs", "n_runs_found")], (F.coalesce("n_documents", F.lit(0)) > 0).cast("string").alias("recalled"))


def qa1_passages(spark, sf_dir):
    """qa1 over whole passages and the documents of all sources; qa1_fragments keeps to what its SQL says."""
    return passages(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def qa2_metrics(spark, sf_dir):
    """Success, quality and label rates of labelled documents by language, with the gates they miss."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    m = d.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.count_if(F.col("quality") == 1) / F.count("*"), 6).alias("success_rate"), F.round(F.count_if(F.col("toxic") == 0) / F.count("*"), 6).alias("clean_rate"))
    return m.withColumn("failures", F.array_join(F.filter(F.array(F.when(F.col("success_rate") < 0.9, "success"), F.when(F.col("clean_rate") < 0.95, "clean")), lambda x: x.isNotNull()), ","))


def qa5_latency(spark, sf_dir):
    """Least, mean, percentiles (the element at floor((n - 1) * f)) and most of the values of each kind of event."""
    e = table(spark, sf_dir, "events").filter("value is not null")
    # ranges of values over all tasks; ranks count on over one row a range and kind
    counts = e.groupBy("event_type", "value").agg(F.count("*").alias("k"))
    parts = stored(counts.repartitionByRange("event_type", "value").withColumn("part", F.spark_partition_id()), "values")
    of_kind = Window.partitionBy("event_type")
    before = of_kind.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("event_type", "part").agg(F.sum("k").alias("sum")).select("event_type", "part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("before"), F.sum("sum").over(of_kind).alias("n"))
    r = parts.join(small(sums), ["event_type", "part"]).withColumn("last", F.col("before") + F.sum("k").over(Window.partitionBy("event_type", "part").orderBy("value")))
    at = lambda f: F.max(F.when((F.floor((F.col("n") - 1) * f) + 1).between(F.col("last") - F.col("k") + 1, F.col("last")), F.col("value")))
    return r.groupBy("event_type").agg(F.min("value").alias("least"), F.round(F.sum(F.col("value") * F.col("k")) / F.max("n"), 6).alias("mean"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("value").alias("most"))


QUERIES = {f.__name__: f for f in (src9_versions, src12_latest, src11_incremental, blk8_headings, blk15_fingerprints, blk16_titles, rs1_allowed_urls, gv1_redacted, gv3_rate_windows, gv4_quota, gv5_audit, jb1_keys, jb3_sequences, jb4_state, jb5_after, jb6_retries, jb7_leases, an1_case_list, an2_recent, an3_buckets, an4_week, an8_followups, rv3_workspace, qa1_fragments, qa1_passages, qa2_metrics, qa5_latency)}

_UP = """WITH up AS (SELECT source AS case_id, doc_id AS upload_id, lang || ' File#' || CAST(doc_id % 7 AS VARCHAR) || '.TXT' AS original_name, sha256(coalesce(text, '')) AS sha256, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size FROM documents),
m AS (SELECT *, row_number() OVER w AS n, first_value(upload_id) OVER w AS first_upload FROM up WINDOW w AS (PARTITION BY case_id, sha256 ORDER BY upload_id)),
v AS (SELECT case_id, upload_id, regexp_replace(original_name, '[^A-Za-z0-9._ -]', '_', 'g') AS file_name, 'doc_' || substr(sha256(case_id || ':' || lower(original_name)), 1, 24) AS document_id, sha256, size,
  CASE WHEN n > 1 THEN 'true' ELSE 'false' END AS duplicate, first_upload, CASE WHEN n = 1 THEN row_number() OVER (PARTITION BY case_id, lower(original_name), n > 1 ORDER BY upload_id) END AS version FROM m)
"""
_JOB = "WITH j AS (SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sequence, event_type, ts, event_id FROM events) "
_CASES = """WITH cases AS (SELECT o_orderkey AS id, o_custkey AS user_id, ['intake','classified','drafting','ready','filed','resolved','escalated'][o_orderkey % 7 + 1] AS status, 'Case ' || o_orderpriority || ' ' || o_orderstatus AS title, o_orderdate AS created_at FROM orders) """
SQL = {
    "src9_versions": _UP + "SELECT * FROM v",
    "src12_latest": _UP + "SELECT case_id, document_id, arg_max(upload_id, version) AS upload_id, max(version) AS version FROM v WHERE version IS NOT NULL GROUP BY ALL",
    "src11_incremental": _UP + "SELECT case_id, sha256, min(upload_id) AS upload_id FROM up WHERE (case_id, sha256) NOT IN (SELECT (case_id, sha256) FROM up WHERE upload_id IN (SELECT doc_id FROM labels)) GROUP BY ALL",
    "blk8_headings": r"""SELECT doc_id, line, text FROM (SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS line, unnest(l) AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
WHERE len(regexp_extract_all(text, '[^\s]+')) <= 14 AND len(regexp_extract_all(text, '\p{L}')) > 0 AND len(regexp_extract_all(text, '\p{Lu}'))::DOUBLE / len(regexp_extract_all(text, '\p{L}')) >= 0.65""",
    "blk15_fingerprints": "SELECT source, sha256(concat_ws('|', lang, text)) AS fingerprint, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY ALL HAVING count(*) > 1",
    "blk16_titles": r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS title FROM pages""",
    "rs1_allowed_urls": r"""SELECT page_id, CASE WHEN regexp_matches(url, '^https://([^/?#@]+\.)?example\.(com|org)/[a-z]{2}/[0-9]+/?$') THEN 'true' ELSE 'false' END AS allowed FROM pages""",
    "gv1_redacted": r"""
WITH l AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'bearer  abc.' WHEN 1 THEN 'Bearer abc.' ELSE 'Basic abc.' END || event_id || CASE WHEN event_id % 4 = 0 THEN ' pan ABCDE12345' ELSE ' pan ABCDE1234F' END || CASE event_id % 5 WHEN 0 THEN ' id 1234-5678-9012' WHEN 1 THEN ' id 1234 5678 901' ELSE ' id 123456789012' END
  || CASE WHEN event_id % 7 = 0 THEN ' tel 5' ELSE ' tel +91 9' END || lpad(CAST(event_id % 1000000000 AS VARCHAR), 9, '0') || CASE WHEN event_id % 2 = 0 THEN ' mail user' ELSE ' mail @user' END || user_id || '@Example.com did ' || event_type AS t FROM events),
r AS (SELECT event_id, regexp_replace(regexp_replace(regexp_replace(t, '(?i)bearer\s+[A-Za-z0-9._~+/=-]+', 'Bearer [REDACTED]', 'g'), '\b[A-Z]{5}[0-9]{4}[A-Z]\b', '[REDACTED-PAN]', 'g'), '\b\d{4}[ -]?\d{4}[ -]?\d{4}\b', '[REDACTED-ID]', 'g') AS t FROM l)
SELECT event_id, regexp_replace(regexp_replace(t, '(^|[^0-9])(\+91[ -]?)?[6-9]\d{9}($|[^0-9])', '\1[REDACTED-PHONE]\3', 'g'), '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b', '[REDACTED-EMAIL]', 'g') AS line FROM r""",
    "gv4_quota": """
WITH RECURSIVE l AS (SELECT l_suppkey AS user_id, strftime(l_shipdate, '%Y-%m') AS month, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(round(l_extendedprice) AS BIGINT) AS bytes FROM lineitem),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id, month ORDER BY l_orderkey, l_linenumber, bytes) AS i FROM l),
r AS (SELECT *, bytes <= 150000 AS accepted, CASE WHEN bytes <= 150000 THEN bytes ELSE 0 END AS used FROM n WHERE i = 1
  UNION ALL SELECT n.*, r.used + n.bytes <= 150000, CASE WHEN r.used + n.bytes <= 150000 THEN r.used + n.bytes ELSE r.used END FROM r JOIN n ON n.user_id = r.user_id AND n.month = r.month AND n.i = r.i + 1)
SELECT user_id, month, l_orderkey, l_linenumber, bytes, accepted FROM r""",
    "gv3_rate_windows": """SELECT event_id, user_id, bucket, window_start, n, CASE WHEN n <= 2 THEN 'true' ELSE 'false' END AS allowed, greatest(2 - n, 0) AS remaining, window_start + 86400 - s AS retry_after
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, bucket, window_start ORDER BY ts, event_id) AS n FROM (SELECT event_id, user_id, event_type AS bucket, ts, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(floor(epoch(ts)) / 86400) * 86400 AS BIGINT) AS window_start FROM events))""",
    "gv5_audit": "SELECT user_id, rank, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 5",
    "jb1_keys": """SELECT l_orderkey, sha256('{"lines":[' || string_agg(p, ',' ORDER BY p) || ']}') AS key FROM (SELECT l_orderkey, CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS p FROM lineitem) GROUP BY l_orderkey""",
    "jb3_sequences": _JOB + "SELECT job_id, sequence, event_id, event_type FROM j",
    "jb4_state": _JOB + "SELECT job_id, arg_max(event_type, sequence) AS status, count(*) FILTER (WHERE event_type = 'click') AS attempts, max(sequence) AS last_sequence, CASE WHEN arg_max(event_type, sequence) IN ('purchase', 'error') THEN 'true' ELSE 'false' END AS terminal FROM j GROUP BY job_id",
    "jb5_after": _JOB + "SELECT job_id, sequence, event_type FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY sequence) AS r FROM j WHERE sequence > 10) WHERE r <= 3",
    "jb6_retries": "SELECT job_id, attempts, CAST(least(15 * pow(2, greatest(attempts - 1, 0)), 300) AS BIGINT) AS delay, CASE WHEN attempts < 12 THEN 'queued' ELSE 'failed' END AS next_state FROM (SELECT user_id AS job_id, count(*) FILTER (WHERE event_type = 'error') AS attempts FROM events GROUP BY user_id)",
    "jb7_leases": """SELECT job_id, CASE WHEN now - seen <= 90 THEN 'running' WHEN cancel THEN 'cancelled' WHEN attempts >= 12 THEN 'failed' ELSE 'requeued' END AS outcome FROM (
  SELECT user_id AS job_id, floor(epoch(max(ts))) AS seen, count(*) FILTER (WHERE event_type = 'error') AS attempts, bool_or(event_type = 'signup') AS cancel FROM events GROUP BY user_id), (SELECT floor(epoch(max(ts))) AS now FROM events)""",
    "an1_case_list": _CASES + ", hit AS (SELECT * FROM cases WHERE lower(title) LIKE '%urgent%' AND status = 'ready') SELECT id, title, strftime(created_at, '%Y-%m-%d') AS created, total, CAST(ceil(total / 20.0) AS BIGINT) AS pages FROM (SELECT * FROM hit ORDER BY created_at DESC, id LIMIT 20), (SELECT count(*) AS total FROM hit)",
    "an2_recent": _CASES + "SELECT user_id, rank, id, status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rank FROM cases) WHERE rank <= 10",
    "an3_buckets": _CASES + "SELECT user_id, count(*) FILTER (WHERE status = 'ready') AS ready, count(*) FILTER (WHERE status IN ('filed','resolved')) AS filed, count(*) FILTER (WHERE status NOT IN ('ready','filed','resolved')) AS in_progress, count(*) AS total FROM cases GROUP BY user_id",
    "an4_week": "WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day FROM orders), w AS (SELECT CAST(unnest(generate_series(max(day) - INTERVAL 6 DAY, max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d) SELECT CAST(w.day AS VARCHAR) AS day, count(d.day) AS n FROM w LEFT JOIN d ON d.day = w.day GROUP BY w.day",
    "an8_followups": _CASES + "SELECT id, CAST(due AS VARCHAR) AS due, CASE WHEN id % 3 = 0 THEN 'escalated' ELSE 'checked' END AS outcome FROM (SELECT id, CAST(created_at AS DATE) + 7 AS due FROM cases WHERE status = 'filed'), (SELECT CAST(max(o_orderdate) AS DATE) AS today FROM orders) WHERE due <= today",
    "rv3_workspace": "SELECT c_custkey AS case_id, coalesce(documents, 0) AS documents, coalesce(open_documents, 0) AS open_documents, coalesce(lines, 0) AS lines FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS documents, count(*) FILTER (WHERE o_orderstatus = 'O') AS open_documents FROM orders GROUP BY o_custkey) o ON c_custkey = o.o_custkey LEFT JOIN (SELECT o_custkey, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey) l ON c_custkey = l.o_custkey",
    "qa1_fragments": "SELECT b.item_id, count(d.doc_id) AS n_documents, CASE WHEN count(d.doc_id) > 0 THEN 'true' ELSE 'false' END AS recalled FROM benchmark b LEFT JOIN documents d ON d.source = 'src' || CAST(b.item_id % 20 AS VARCHAR) AND contains(lower(d.text), lower(substr(b.text, 1, 80))) GROUP BY b.item_id",
    "qa2_metrics": "SELECT *, concat_ws(',', CASE WHEN success_rate < 0.9 THEN 'success' END, CASE WHEN clean_rate < 0.95 THEN 'clean' END) AS failures FROM (SELECT lang, count(*) AS n, round(count(*) FILTER (WHERE quality = 1) / count(*)::DOUBLE, 6) AS success_rate, round(count(*) FILTER (WHERE toxic = 0) / count(*)::DOUBLE, 6) AS clean_rate FROM documents JOIN labels USING (doc_id) GROUP BY lang)",
    "qa5_latency": "SELECT event_type, min(value) AS least, round(avg(value), 6) AS mean, max(CASE WHEN i = floor((n - 1) * 0.5) + 1 THEN value END) AS p50, max(CASE WHEN i = floor((n - 1) * 0.95) + 1 THEN value END) AS p95, max(value) AS most FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) GROUP BY event_type",
}
