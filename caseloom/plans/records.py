"""Registered queries over case records: evidence, relations, chronology, report and integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.functions.text import name_uuid, stable_id
from caseloom.operators import evidence as ev
from caseloom.sources.views import RECORD_BLOCKS, record_blocks, stored


def _atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.atoms(ev.occurrences(record_blocks(spark, sf_dir)))


#: What plans read of the atoms besides their spans; the first span alone; and where spans are, without quotes.
PLAIN = ["case_id", "evidence_id", "kind", "label", "normalized", "value", "confidence", "review_state", "rank"]
FIRST, PLACES = "slice(spans, 1, 1) AS spans", "transform(spans, s -> struct(s.version_id, s.block_id)) AS spans"


def stored_atoms(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The atoms (of them what a plan reads, if given) for plans that read them more than once: the rules over the text run
    one time."""
    return stored(_atoms(spark, sf_dir).selectExpr(*(columns or "*")), "atoms")


def ev1_occurrences(spark, sf_dir):
    return ev.occurrences(record_blocks(spark, sf_dir)).select("case_id", "version_id", "block_id", "kind", "label", "start", "end", "quote", "normalized", "weight")


def ev5_atoms(spark, sf_dir):
    a = _atoms(spark, sf_dir)
    return a.select("case_id", "evidence_id", "kind", "label", "normalized", "value", "confidence", "review_state", F.size("spans").cast("long").alias("n_spans"), F.col("spans")[0]["block_id"].alias("first_block"), F.col("spans")[0]["start"].alias("first_start"), "rank")


def ev9_counts(spark, sf_dir):
    return _atoms(spark, sf_dir).groupBy("case_id", "kind", "review_state").agg(F.count("*").alias("n"))


def rel1_edges(spark, sf_dir):
    return ev.edges(_atoms(spark, sf_dir))


def rel8_counts(spark, sf_dir):
    return ev.edges(_atoms(spark, sf_dir)).groupBy("case_id", "relationship_type").agg(F.count("*").alias("n"))


def rel6_chronology(spark, sf_dir):
    out = ev.chronology(stored_atoms(spark, sf_dir, *PLAIN, PLACES), record_blocks(spark, sf_dir))
    return out.withColumn("evidence_ids", F.array_join("evidence_ids", ","))


SECTIONS = [("person", "parties"), ("organization", "parties"), ("court", "forum"), ("authority", "forum"), ("date", "chronology"), ("legal_provision", "law"), ("case_number", "record"), ("document_reference", "record")]
CLAIMS_PER_CASE = 250


def claims(atoms: DataFrame) -> DataFrame:
    """The first 250 atoms of each case as claims with section, statement, caveat and citation. The sentences are fixed
    values."""
    kind, value = F.col("kind"), F.col("value")
    section = F.lit("facts")
    for k, s in reversed(SECTIONS):
        section = F.when(kind == k, s).otherwise(section)
    statement = (
        F.when(kind == "person", F.concat(F.lit("The record identifies "), value, F.lit(" as "), F.lower("label"), F.lit(".")))
        .when(kind.isin("court", "authority"), F.concat(F.lit("The record refers to "), value, F.lit(".")))
        .when(kind == "date", F.concat(F.lit("The record contains the date "), value, F.lit(".")))
        .when(kind == "legal_provision", F.concat(F.lit("The source expressly refers to "), value, F.lit(".")))
        .when(kind == "case_number", F.concat(F.lit("The record identifies "), value, F.lit(".")))
        .when(kind == "money", F.concat(F.lit("The source records the amount "), value, F.lit(".")))
        .otherwise(F.concat(F.lit("The source contains the "), F.lower("label"), F.lit(" value "), value, F.lit(".")))
    )
    first = F.col("spans")[0]
    return atoms.filter(F.col("rank") <= CLAIMS_PER_CASE).select(
        "case_id", stable_id("claim_", "case_id", "evidence_id").alias("claim_id"), "evidence_id", section.alias("section_id"), F.when(kind == "legal_provision", "law").otherwise("fact").alias("claim_kind"), statement.alias("statement"), "confidence",
        F.when(F.col("review_state") == "needs_review", "Human verification is required.").alias("caveat"), stable_id("cite_", "evidence_id", first["block_id"]).alias("citation_id"), F.concat(F.lit("record "), first["version_id"], F.lit(", page 1")).alias("citation_label"), "rank",
    )


def rpt1_claims(spark, sf_dir):
    return claims(_atoms(spark, sf_dir))


def rpt5_sections(spark, sf_dir):
    c = claims(_atoms(spark, sf_dir)).groupBy("case_id", "section_id").agg(F.min("rank").alias("first"), F.count("*").alias("n_claims"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "claim_id"))), lambda x: x["claim_id"]), ",").alias("claim_ids"))
    return c.select("case_id", "section_id", "n_claims", "claim_ids", F.row_number().over(Window.partitionBy("case_id").orderBy("first")).cast("long").alias("position"))


def caveats(atoms: DataFrame, blocks: DataFrame) -> DataFrame:
    """Caveats for documents that can't be used in full, unsure evidence, conflicts, evidence beyond the cap, and cases
    without any. Titles and details are fixed values."""
    versions = blocks.select("case_id", "version_id", "document_name", "status").distinct()
    status = versions.filter("status <> 'ready'").select("case_id", stable_id("caveat_", "version_id", "status").alias("caveat_id"), F.when(F.col("status").isin("ocr_required", "failed"), "blocking").otherwise("warning").alias("severity"), F.concat(F.lit("Source requires review: "), "document_name").alias("title"), F.concat(F.lit("Parser status is "), "status", F.lit(".")).alias("detail"))
    low = atoms.filter("review_state = 'needs_review'").select("case_id", stable_id("caveat_", "evidence_id", F.lit("low_confidence")).alias("caveat_id"), F.lit("warning").alias("severity"), F.lit("Extraction requires verification").alias("title"), F.concat("label", F.lit(": "), "value", F.lit(" was extracted at "), F.round(F.col("confidence") * 100).cast("int").cast("string"), F.lit("% confidence.")).alias("detail"))
    clash = atoms.filter("kind in ('person', 'case_number')").groupBy("case_id", "kind", F.lower("label").alias("label")).agg(F.countDistinct("normalized").alias("n")).filter("n > 1")
    clash = clash.select("case_id", stable_id("caveat_", "case_id", "kind", "label", F.lit("conflict")).alias("caveat_id"), F.lit("blocking").alias("severity"), F.lit("Conflicting source values").alias("title"), F.concat(F.lit("The sources contain multiple values for "), "label", F.lit(". Human resolution is required.")).alias("detail"))
    many = atoms.groupBy("case_id").agg(F.count("*").alias("n")).filter(F.col("n") > CLAIMS_PER_CASE)
    many = many.select("case_id", stable_id("caveat_", "case_id", F.lit("claim_limit")).alias("caveat_id"), F.lit("info").alias("severity"), F.lit("Additional evidence available").alias("title"), F.concat(F.lit(f"The report summarizes {CLAIMS_PER_CASE} of "), F.col("n").cast("string"), F.lit(" evidence atoms. Search remains available across all sources.")).alias("detail"))
    none = versions.select("case_id").distinct().join(atoms.select("case_id").distinct(), "case_id", "left_anti")
    none = none.select("case_id", stable_id("caveat_", "case_id", F.lit("no_evidence")).alias("caveat_id"), F.lit("blocking").alias("severity"), F.lit("No verified evidence extracted").alias("title"), F.lit("The source documents produced no evidence atoms. Review parser output and OCR before relying on this report.").alias("detail"))
    return status.unionByName(low).unionByName(clash).unionByName(many).unionByName(none)


def rpt6_caveats(spark, sf_dir):
    return caveats(stored_atoms(spark, sf_dir, *PLAIN), record_blocks(spark, sf_dir))


def review_items(c: DataFrame) -> DataFrame:
    c = c.filter("severity in ('warning', 'blocking')")
    return c.select("case_id", name_uuid(F.concat_ws(":", "case_id", F.lit("caveat"), "caveat_id")).alias("review_id"), "severity", "title", "detail")


def rv1_review_items(spark, sf_dir):
    return review_items(caveats(stored_atoms(spark, sf_dir, *PLAIN), record_blocks(spark, sf_dir)))


def span_issues(atoms: DataFrame, blocks: DataFrame) -> DataFrame:
    """The first failing check of every span: its version, block, bounds and quote against the source."""
    s = lambda c: F.col(f"s.{c}").alias(c)
    spans = atoms.select("case_id", "evidence_id", F.explode("spans").alias("s")).select("case_id", "evidence_id", *map(s, ("version_id", "block_id", "start", "end", "quote")))
    versions = blocks.select("case_id", "version_id", F.lit(True).alias("known")).distinct()
    held = blocks.select("case_id", "version_id", "block_id", "text")
    # a span whose block is there needs no look at the versions: only failed ones go on to these
    met = spans.join(held, ["case_id", "version_id", "block_id"], "left")
    code = (
        F.when(F.col("text").isNull(), "source_block")
        .when((F.col("start") < 0) | (F.col("end") > F.length("text")) | (F.col("start") >= F.col("end")), "source_bounds")
        .when(F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")) != F.col("quote"), "source_quote")
    )
    bad = met.withColumn("code", code).filter("code is not null").select("case_id", "version_id", "evidence_id", "block_id", "start", "end", "code")
    code = F.when((F.col("code") == "source_block") & F.col("known").isNull(), "source_version").otherwise(F.col("code"))
    return bad.join(versions, ["case_id", "version_id"], "left").select("case_id", "evidence_id", "block_id", "start", "end", code.alias("code"))


def _damaged(atoms: DataFrame) -> DataFrame:
    """Spans broken on purpose by their block's document number, so that the checks have something to find."""
    def hurt(s):
        d = s["document_order"] % 97
        return F.struct(s["document_order"].alias("document_order"), s["sequence"].alias("sequence"), s["start"].alias("start"), F.when(d == 3, s["end"] + 1000).otherwise(s["end"]).alias("end"), F.when(d == 1, "missing").otherwise(s["version_id"]).alias("version_id"), F.when(d == 2, "missing").otherwise(s["block_id"]).alias("block_id"), F.when(d == 4, "tampered").otherwise(s["quote"]).alias("quote"))
    return atoms.withColumn("spans", F.transform("spans", hurt))


def int2_span_issues(spark, sf_dir):
    return span_issues(_damaged(_atoms(spark, sf_dir)), record_blocks(spark, sf_dir))


def int9_result(spark, sf_dir):
    a = _damaged(stored_atoms(spark, sf_dir, "case_id", "evidence_id", "spans"))
    issues = span_issues(a, record_blocks(spark, sf_dir)).groupBy("case_id").agg(F.count("*").alias("blocking"))
    seen = a.groupBy("case_id").agg(F.count("*").alias("checked_evidence"), F.sum(F.size("spans")).cast("long").alias("checked_spans"))
    out = seen.join(issues, "case_id", "left").withColumn("blocking", F.coalesce("blocking", F.lit(0)).cast("long"))
    return out.withColumn("valid", (F.col("blocking") == 0).cast("string")).withColumn("score", F.greatest(F.lit(0), 100 - 25 * F.col("blocking")).cast("long"))


_HEAD = "WITH " + RECORD_BLOCKS + "," + ev.occurrences_sql()
_ATOMS = _HEAD + "," + ev.ATOMS_SQL
_EDGES = _ATOMS + """,
actors AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, version_id, block_id ORDER BY rank, span) AS i FROM by_block WHERE kind IN ('person','organization','court','authority')) WHERE i <= 8),
pairs AS (
  SELECT s.case_id, s.evidence_id AS source_evidence_id, t.evidence_id AS target_evidence_id, s.value AS sv, t.value AS tv, least(s.confidence, t.confidence) AS confidence,
    CASE WHEN list_sort([lower(s.label), lower(t.label)]) IN (['petitioner','respondent'],['applicant','respondent'],['accused','complainant'],['defendant','plaintiff'],['appellant','respondent']) THEN 'opposes'
         WHEN s.kind = 'court' OR t.kind = 'court' THEN 'appears_before' ELSE 'co_mentioned' END AS relationship_type
  FROM actors s JOIN actors t ON s.case_id = t.case_id AND s.version_id = t.version_id AND s.block_id = t.block_id AND s.i < t.i AND s.evidence_id <> t.evidence_id),
edges AS (
  SELECT DISTINCT case_id, 'rel_' || substr(sha256(case_id || ':' || source_evidence_id || ':' || target_evidence_id || ':' || relationship_type), 1, 24) AS relationship_id,
    source_evidence_id, target_evidence_id, relationship_type, sv || ' is ' || replace(relationship_type, '_', ' ') || ' ' || tv || ' in the source record.' AS description,
    confidence, CASE WHEN confidence >= 0.75 THEN 'verified' ELSE 'needs_review' END AS review_state FROM pairs)
"""
_CLAIMS = _ATOMS + """,
claims AS (
  SELECT case_id, 'claim_' || substr(sha256(case_id || ':' || evidence_id), 1, 24) AS claim_id, evidence_id,
    CASE WHEN kind IN ('person','organization') THEN 'parties' WHEN kind IN ('court','authority') THEN 'forum' WHEN kind = 'date' THEN 'chronology' WHEN kind = 'legal_provision' THEN 'law' WHEN kind IN ('case_number','document_reference') THEN 'record' ELSE 'facts' END AS section_id,
    CASE WHEN kind = 'legal_provision' THEN 'law' ELSE 'fact' END AS claim_kind,
    CASE WHEN kind = 'person' THEN 'The record identifies ' || value || ' as ' || lower(label) || '.' WHEN kind IN ('court','authority') THEN 'The record refers to ' || value || '.'
         WHEN kind = 'date' THEN 'The record contains the date ' || value || '.' WHEN kind = 'legal_provision' THEN 'The source expressly refers to ' || value || '.'
         WHEN kind = 'case_number' THEN 'The record identifies ' || value || '.' WHEN kind = 'money' THEN 'The source records the amount ' || value || '.'
         ELSE 'The source contains the ' || lower(label) || ' value ' || value || '.' END AS statement,
    confidence, CASE WHEN review_state = 'needs_review' THEN 'Human verification is required.' END AS caveat,
    'cite_' || substr(sha256(evidence_id || ':' || spans[1].b), 1, 24) AS citation_id, 'record ' || spans[1].v || ', page 1' AS citation_label, rank
  FROM atoms WHERE rank <= 250)
"""
_CAVEATS = _ATOMS + """,
caveats AS (
  SELECT DISTINCT case_id, 'caveat_' || substr(sha256(version_id || ':' || status), 1, 24) AS caveat_id, CASE WHEN status IN ('ocr_required', 'failed') THEN 'blocking' ELSE 'warning' END AS severity, 'Source requires review: ' || document_name AS title, 'Parser status is ' || status || '.' AS detail FROM blocks WHERE status <> 'ready'
  UNION ALL SELECT case_id, 'caveat_' || substr(sha256(evidence_id || ':low_confidence'), 1, 24), 'warning', 'Extraction requires verification', label || ': ' || value || ' was extracted at ' || CAST(CAST(round(confidence * 100) AS INTEGER) AS VARCHAR) || '% confidence.' FROM atoms WHERE review_state = 'needs_review'
  UNION ALL SELECT case_id, 'caveat_' || substr(sha256(case_id || ':' || kind || ':' || lower(label) || ':conflict'), 1, 24), 'blocking', 'Conflicting source values', 'The sources contain multiple values for ' || lower(label) || '. Human resolution is required.' FROM atoms WHERE kind IN ('person','case_number') GROUP BY case_id, kind, lower(label) HAVING count(DISTINCT normalized) > 1
  UNION ALL SELECT case_id, 'caveat_' || substr(sha256(case_id || ':claim_limit'), 1, 24), 'info', 'Additional evidence available', 'The report summarizes 250 of ' || count(*) || ' evidence atoms. Search remains available across all sources.' FROM atoms GROUP BY case_id HAVING count(*) > 250
  UNION ALL SELECT case_id, 'caveat_' || substr(sha256(case_id || ':no_evidence'), 1, 24), 'blocking', 'No verified evidence extracted', 'The source documents produced no evidence atoms. Review parser output and OCR before relying on this report.' FROM (SELECT DISTINCT case_id FROM blocks WHERE case_id NOT IN (SELECT case_id FROM atoms)))
"""
_ISSUES = _ATOMS + """,
hurt AS (
  SELECT case_id, evidence_id, s.s AS start, CASE WHEN s.o % 97 = 3 THEN s.e + 1000 ELSE s.e END AS "end", CASE WHEN s.o % 97 = 1 THEN 'missing' ELSE s.v END AS version_id,
    CASE WHEN s.o % 97 = 2 THEN 'missing' ELSE s.b END AS block_id, CASE WHEN s.o % 97 = 4 THEN 'tampered' ELSE s.t END AS quote
  FROM (SELECT case_id, evidence_id, unnest(spans) AS s FROM atoms)),
checked AS (
  SELECT h.*, CASE WHEN v.version_id IS NULL THEN 'source_version' WHEN b.text IS NULL THEN 'source_block' WHEN h.start < 0 OR h."end" > length(b.text) OR h.start >= h."end" THEN 'source_bounds' WHEN substr(b.text, h.start + 1, h."end" - h.start) <> h.quote THEN 'source_quote' END AS code
  FROM hurt h LEFT JOIN (SELECT DISTINCT case_id, version_id FROM blocks) v USING (case_id, version_id) LEFT JOIN blocks b ON b.case_id = h.case_id AND b.version_id = h.version_id AND b.block_id = h.block_id)
"""

REVIEW_SQL = """SELECT case_id, substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-' || translate(substr(h,17,1),'0123456789abcdef','89ab89ab89ab89ab') || substr(h,18,3) || '-' || substr(h,21,12) AS review_id, severity, title, detail
FROM (SELECT *, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(case_id || ':caveat:' || caveat_id)) AS h FROM caveats WHERE severity IN ('warning', 'blocking'))"""
QUERIES = {f.__name__: f for f in (ev1_occurrences, ev5_atoms, ev9_counts, rel1_edges, rel8_counts, rel6_chronology, rpt1_claims, rpt5_sections, rpt6_caveats, rv1_review_items, int2_span_issues, int9_result)}
SQL = {
    "ev1_occurrences": _HEAD + 'SELECT case_id, version_id, block_id, kind, label, start, "end", quote, normalized, weight FROM found',
    "ev5_atoms": _ATOMS + "SELECT case_id, evidence_id, kind, label, normalized, value, confidence, review_state, CAST(len(spans) AS BIGINT) AS n_spans, spans[1].b AS first_block, spans[1].s AS first_start, rank FROM atoms",
    "ev9_counts": _ATOMS + "SELECT case_id, kind, review_state, count(*) AS n FROM atoms GROUP BY ALL",
    "rel1_edges": _EDGES + "SELECT * FROM edges",
    "rel8_counts": _EDGES + "SELECT case_id, relationship_type, count(*) AS n FROM edges GROUP BY ALL",
    "rel6_chronology": _ATOMS + """,
near AS (
  SELECT d.case_id, d.evidence_id AS date_id, d.value, d.spans[1].v AS version_id, d.spans[1].b AS block_id, min(n.confidence) AS confidence,
    list(n.evidence_id ORDER BY n.rank, n.span) AS ids
  FROM atoms d JOIN by_block n ON n.case_id = d.case_id AND n.version_id = d.spans[1].v AND n.block_id = d.spans[1].b WHERE d.kind = 'date' GROUP BY ALL),
told AS (
  SELECT n.*, CASE WHEN length(trim(b.text)) > 320 THEN rtrim(substr(trim(b.text), 1, 317)) || '...' ELSE trim(b.text) END AS description,
    CAST(CAST(coalesce(try_strptime(n.value, '%d/%m/%Y'), try_strptime(n.value, '%d-%m-%Y'), try_strptime(n.value, '%d.%m.%Y'), try_strptime(n.value, '%d %B %Y'), try_strptime(n.value, '%d %b %Y')) AS DATE) AS VARCHAR) AS normalized_date
  FROM near n JOIN blocks b USING (case_id, version_id, block_id))
SELECT case_id, 'evt_' || substr(sha256(case_id || ':' || date_id || ':' || description), 1, 24) AS event_id, value AS date_text, normalized_date, description, confidence,
  array_to_string(list_prepend(date_id, list_filter(ids, lambda x: x <> date_id)), ',') AS evidence_ids,
  row_number() OVER (PARTITION BY case_id ORDER BY normalized_date IS NULL, coalesce(normalized_date, value), date_id) AS position FROM told""",
    "rpt1_claims": _CLAIMS + "SELECT * FROM claims",
    "rpt5_sections": _CLAIMS + "SELECT case_id, section_id, count(*) AS n_claims, string_agg(claim_id, ',' ORDER BY rank) AS claim_ids, row_number() OVER (PARTITION BY case_id ORDER BY min(rank)) AS position FROM claims GROUP BY case_id, section_id",
    "rpt6_caveats": _CAVEATS + "SELECT * FROM caveats",
    "int2_span_issues": _ISSUES + 'SELECT case_id, evidence_id, block_id, start, "end", code FROM checked WHERE code IS NOT NULL',
    "int9_result": _ISSUES + """
SELECT case_id, count(DISTINCT evidence_id) AS checked_evidence, count(*) AS checked_spans, count(code) AS blocking,
  CASE WHEN count(code) = 0 THEN 'true' ELSE 'false' END AS valid, greatest(0, 100 - 25 * count(code)) AS score FROM checked GROUP BY case_id""",
    "rv1_review_items": _CAVEATS + ", x AS (" + REVIEW_SQL + ") SELECT * FROM x",
}
