"""Registered queries over research findings, whole reports with their checks, review decisions and briefings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions.text import stable_id
from caseloom.plans import records
from caseloom.sources.views import record_blocks, stored, table

#: Hosts and paths of legal sources, default texts, kinds that lead a research query.
LEGAL_URL = r"^(?i:https://(www\.)?indiankanoon\.org)(:[0-9]*)?/doc/[0-9]+/?([?#].*)?$"
DEFAULT_TITLE, DEFAULT_EXCERPT = "IndianKanoon result", "Open the cited judgment to review the relevant passage."
DEFAULT_QUERY = "Indian legal document rights and procedure"
LEADING = ["legal_provision", "case_number", "court", "authority", "document_reference"]


def results(spark, sf_dir) -> DataFrame:
    """Each page as a search result for a case; some on other hosts, some search addresses, some without title or excerpt."""
    n = F.col("page_id")
    number = n.cast("string")
    url = F.when(n % 5 == 0, F.col("url")).when(n % 5 == 1, F.concat(F.lit("https://indiankanoon.org/search/?q="), number)).when(n % 5 == 2, F.concat(F.lit("https://www.indiankanoon.org/doc/"), number)).otherwise(F.concat(F.lit("https://indiankanoon.org/doc/"), number, F.lit("/")))
    return table(spark, sf_dir, "pages").select(
        n.alias("page_id"), (n % 100 + 1).cast("string").alias("case_id"), url.alias("source_url"), F.when(n % 6 == 5, "").otherwise(F.concat(F.lit("State  v. "), number)).alias("title"),
        F.when(n % 4 == 3, " ").otherwise(F.concat(F.lit("Passage\n"), number)).alias("excerpt"), F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("AIR "), number)).alias("citation"),
    )


def allowed(url: Column) -> Column:
    return F.coalesce(F.trim(url).rlike(LEGAL_URL), F.lit(False))


def findings(found: DataFrame) -> DataFrame:
    """Results at allowed addresses, with single spaces, default texts and ids made before the defaults."""
    tidy = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " "))
    clean = found.filter(allowed(F.col("source_url"))).withColumns({"source_url": F.trim("source_url"), "title": tidy("title"), "excerpt": tidy("excerpt")})
    clean = clean.withColumn("research_id", stable_id("research_", "source_url", "title", "excerpt"))
    return clean.withColumns({"title": F.coalesce(F.nullif("title", F.lit("")), F.lit(DEFAULT_TITLE)), "excerpt": F.coalesce(F.nullif("excerpt", F.lit("")), F.lit(DEFAULT_EXCERPT))})


def rs2_findings(spark, sf_dir):
    return findings(results(spark, sf_dir)).select("case_id", "research_id", "source_url", "title", "excerpt", "citation")


def rs2_excluded(spark, sf_dir):
    """How many results each case kept and lost, and the warning that follows."""
    r = results(spark, sf_dir).groupBy("case_id").agg(F.count_if(allowed(F.col("source_url"))).alias("kept"), F.count_if(~allowed(F.col("source_url"))).alias("excluded"))
    lost = F.when(F.col("excluded") > 0, F.concat(F.col("excluded").cast("string"), F.lit(" research result(s) were excluded because no verifiable source URL was returned.")))
    return r.withColumn("warning", F.concat_ws(" ", lost, F.when(F.col("kept") == 0, "No citable result was returned for the extracted record.")))


def research_query(atoms: DataFrame) -> DataFrame:
    """One query text a case: its first 12 values of the leading kinds, else its first 8 values of any kind."""
    marked = atoms.withColumn("leads", F.col("kind").isin(*LEADING))
    marked = marked.withColumn("r", F.row_number().over(Window.partitionBy("case_id", "leads").orderBy("rank"))).filter("(leads and r <= 12) or rank <= 8")
    listed = lambda when: F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("rank", "value")))), lambda x: x["value"])), " ")
    both = marked.groupBy("case_id").agg(listed(F.col("leads") & (F.col("r") <= 12)).alias("first"), listed(F.col("rank") <= 8).alias("any"))
    return both.select("case_id", F.coalesce(F.nullif(F.substring(F.when(F.col("first") != "", F.col("first")).otherwise(F.col("any")), 1, 500), F.lit("")), F.lit(DEFAULT_QUERY)).alias("query"))


def rs3_query(spark, sf_dir):
    return research_query(records.stored_atoms(spark, sf_dir, *records.PLAIN))


def research_claims(found: DataFrame) -> DataFrame:
    return found.select(
        "case_id", stable_id("claim_", "case_id", "research_id").alias("claim_id"), "research_id", F.concat("title", F.lit(": "), "excerpt").alias("statement"), F.lit(0.75).alias("confidence"),
        F.lit("External authority must be checked in full before reliance.").alias("caveat"), stable_id("cite_", "research_id").alias("citation_id"), F.coalesce(F.nullif("citation", F.lit("")), "title").alias("citation_label"), "source_url",
    )


def rpt3_research_claims(spark, sf_dir):
    return research_claims(findings(results(spark, sf_dir)))


# -- whole reports ---------------------------------------------------------------------------------------------------


def damaged_report(spark, sf_dir, atoms: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(claims, citations, findings) of every case; in each third case some are broken on purpose, by rank or page."""
    hurt = F.col("case_id").cast("long") % 3 == 0
    none = F.array().cast("array<string>")
    own = records.claims(atoms).withColumn("m", F.when(hurt, F.col("rank") % 7).otherwise(0))
    found = findings(results(spark, sf_dir)).withColumn("m", F.when(hurt, F.col("page_id") % 7).otherwise(0))
    law = research_claims(found).join(found.select("case_id", "research_id", "m"), ["case_id", "research_id"])
    claims = own.select("case_id", "claim_id", F.col("claim_kind").alias("kind"), F.when(F.col("m") == 1, none).when(F.col("m") == 2, F.array(F.lit("ev_missing"))).otherwise(F.array("evidence_id")).alias("evidence_ids"), none.alias("research_ids"))
    claims = claims.unionByName(law.select("case_id", "claim_id", F.lit("law").alias("kind"), none.alias("evidence_ids"), F.when(F.col("m") == 2, F.array(F.lit("research_missing"))).otherwise(F.array("research_id")).alias("research_ids")))
    text = F.lit(None).cast("string")
    citations = own.filter("m <> 3").select("case_id", "citation_id", F.when(F.col("m") == 4, "ev_missing").otherwise(F.col("evidence_id")).alias("evidence_id"), text.alias("research_id"), text.alias("source_url"))
    citations = citations.unionByName(law.filter("m <> 1").select("case_id", "citation_id", text.alias("evidence_id"), "research_id", F.when(F.col("m") == 3, "https://elsewhere.example/").otherwise(F.col("source_url")).alias("source_url")))
    return claims, citations, found.select("case_id", "research_id", "source_url")


def report_issues(evidence: DataFrame, claims: DataFrame, citations: DataFrame, found: DataFrame) -> DataFrame:
    """case_id, code, entity_type, entity_id of what a report gets wrong; every reference is held against its own case."""
    known, sources = evidence.select("case_id", "evidence_id"), found.select("case_id", "research_id")
    cited, cited_law = (citations.select("case_id", c).filter(F.col(c).isNotNull()).distinct() for c in ("evidence_id", "research_id"))

    def issues(df: DataFrame, code: str, kind: str, key: str) -> DataFrame:
        return df.select("case_id", F.lit(code).alias("code"), F.lit(kind).alias("entity_type"), F.col(key).alias("entity_id")).distinct()

    uses = claims.select("case_id", "claim_id", F.explode("evidence_ids").alias("evidence_id"))
    uses_law = claims.select("case_id", "claim_id", F.explode("research_ids").alias("research_id"))
    own, law = citations.filter("evidence_id is not null"), citations.filter("evidence_id is null")
    kept = found.select("case_id", "research_id", F.col("source_url").alias("url"))
    on, on_law = ["case_id", "evidence_id"], ["case_id", "research_id"]
    parts = [
        issues(found.filter(~allowed(F.col("source_url"))), "research_source", "research", "research_id"),
        issues(found.join(cited_law, on_law, "left_anti"), "research_citation", "research", "research_id"),
        issues(own.join(known, on, "left_anti"), "citation_evidence", "citation", "citation_id"),
        issues(law.join(kept, on_law, "left").filter(F.col("url").isNull() | ~F.col("url").eqNullSafe(F.col("source_url")) | ~allowed(F.col("source_url"))), "citation_research", "citation", "citation_id"),
        issues(claims.filter((F.size("evidence_ids") == 0) & ((F.col("kind") == "fact") | (F.size("research_ids") == 0))), "unsupported_claim", "claim", "claim_id"),
        issues(uses.join(known, on, "left_anti"), "claim_evidence", "claim", "claim_id"),
        issues(uses_law.join(sources, on_law, "left_anti"), "claim_research", "claim", "claim_id"),
        issues(uses.join(cited, on, "left_anti"), "claim_citation", "claim", "claim_id"),
        issues(uses_law.join(cited_law, on_law, "left_anti"), "claim_research_citation", "claim", "claim_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _report(spark, sf_dir):
    atoms = records.stored_atoms(spark, sf_dir, *records.PLAIN, records.FIRST)
    claims, citations, found = damaged_report(spark, sf_dir, atoms)
    return atoms, stored(claims, "claims"), stored(citations, "citations"), found


def int8_report_issues(spark, sf_dir):
    atoms, claims, citations, found = _report(spark, sf_dir)
    return report_issues(atoms, claims, citations, found)


def mediated(claims: DataFrame, citations: DataFrame, issues: DataFrame, caveats: DataFrame) -> DataFrame:
    """case_id, claims, citations, status: cases with an issue lose bad citations and claims, and claims whose support went;
    they need review, as do cases with a blocking caveat."""
    bad = lambda kind, key: issues.filter(F.col("entity_type") == kind).select("case_id", F.col("entity_id").alias(key)).distinct()
    invalid = issues.select("case_id", F.lit(True).alias("invalid")).distinct()
    held = citations.join(bad("citation", "citation_id"), ["case_id", "citation_id"], "left_anti").join(bad("evidence", "evidence_id"), ["case_id", "evidence_id"], "left_anti")
    refs = claims.join(invalid, "case_id", "left_semi").select("case_id", "claim_id", F.explode(F.concat("evidence_ids", "research_ids")).alias("id"))
    support = held.select("case_id", F.coalesce("evidence_id", "research_id").alias("id")).distinct()
    lost = refs.join(support, ["case_id", "id"], "left_anti").select("case_id", "claim_id").unionByName(bad("claim", "claim_id")).distinct()
    n_claims = claims.join(lost, ["case_id", "claim_id"], "left_anti").groupBy("case_id").agg(F.count("*").alias("claims"))
    n_citations = held.groupBy("case_id").agg(F.count("*").alias("citations"))
    blocked = caveats.filter("severity = 'blocking'").select("case_id", F.lit(True).alias("blocked")).distinct()
    cases = claims.select("case_id").distinct().join(n_claims, "case_id", "left").join(n_citations, "case_id", "left").join(invalid, "case_id", "left").join(blocked, "case_id", "left")
    return cases.select("case_id", F.coalesce("claims", F.lit(0)).alias("claims"), F.coalesce("citations", F.lit(0)).alias("citations"), F.when(F.col("invalid") | F.col("blocked"), "needs_review").otherwise("completed").alias("status"))


def rpt11_mediated(spark, sf_dir):
    atoms, claims, citations, found = _report(spark, sf_dir)
    issues = stored(report_issues(atoms, claims, citations, found), "issues")
    return mediated(claims, citations, issues, records.caveats(atoms, record_blocks(spark, sf_dir)))


def rpt10_versions(spark, sf_dir):
    """The next report of each customer: one more than the urgent orders' reports so far."""
    past = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("latest"))
    out = table(spark, sf_dir, "customer").select("c_custkey").join(past, "c_custkey", "left").select(F.col("c_custkey").cast("string").alias("case_id"), (F.coalesce("latest", F.lit(0)) + 1).alias("version"))
    return out.withColumn("report_id", stable_id("report_", "case_id", F.col("version").cast("string")))


# -- review and briefings --------------------------------------------------------------------------------------------


def review_queue(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Items with their latest decision; the open ones of a case in order, blocking first."""
    latest = decisions.groupBy("review_id").agg(F.max_by("status", "decided_at").alias("decided"))
    out = items.join(latest, "review_id", "left").withColumn("status", F.coalesce("decided", F.lit("open")))
    order = Window.partitionBy("case_id", "status").orderBy(F.when(F.col("severity") == "blocking", 0).otherwise(1), "review_id")
    return out.select("case_id", "review_id", "severity", "status", F.when(F.col("status") == "open", F.row_number().over(order)).cast("long").alias("position"))


def _queue(spark, sf_dir, caveats: DataFrame) -> DataFrame:
    """A fifth of the items has a decision and some a later one, told by the digits of their ids."""
    items = records.review_items(caveats)
    d = F.substring("review_id", 1, 1)
    decision = lambda at, status: F.struct(F.lit(at).alias("decided_at"), F.lit(status).alias("status"))
    both = F.when(d == "0", F.array(decision(1, "resolved"), decision(2, "dismissed"))).otherwise(F.array(decision(1, "resolved")))
    made = items.filter(d.isin("0", "1", "2")).select("review_id", F.inline(both))
    return review_queue(items, made)


def _caveats(spark, sf_dir):
    atoms = records.stored_atoms(spark, sf_dir, *records.PLAIN)
    return atoms, stored(records.caveats(atoms, record_blocks(spark, sf_dir)), "caveats")


def rv2_queue(spark, sf_dir):
    return _queue(spark, sf_dir, _caveats(spark, sf_dir)[1])


def challenges(atoms: DataFrame, caveats: DataFrame) -> DataFrame:
    """What the other side may attack: the first four different titles of a case, caveats before unsure evidence."""
    c = caveats.select("case_id", F.lit(0).alias("part"), F.col("caveat_id").alias("id"), "severity", "title", "detail")
    e = atoms.filter("confidence < 0.75 or review_state = 'needs_review'").select("case_id", F.lit(1).alias("part"), F.concat(F.lit("evidence-"), "evidence_id").alias("id"), F.lit("warning").alias("severity"), F.concat("label", F.lit(" may be challenged")).alias("title"), F.concat(F.lit("The current extraction is "), F.round(F.col("confidence") * 100).cast("int").cast("string"), F.lit("% confident. Verify the original page before relying on it.")).alias("detail"))
    first = c.unionByName(e).groupBy("case_id", "title").agg(F.min(F.struct("part", "id", "severity", "detail")).alias("x")).select("case_id", "title", "x.*")
    r = F.row_number().over(Window.partitionBy("case_id").orderBy("part", "id"))
    return first.withColumn("rank", r.cast("long")).filter("rank <= 4").select("case_id", "rank", "id", "severity", "title", "detail")


def rv4_challenges(spark, sf_dir):
    return challenges(*_caveats(spark, sf_dir))


def rv5_delays(spark, sf_dir):
    """Why each case waits: a job at work, documents not ready, open reviews, no report yet; else a default."""
    versions = record_blocks(spark, sf_dir).select("case_id", "version_id", "status").distinct().groupBy("case_id").agg(F.count_if(F.col("status") != "ready").alias("poor"))
    reviews = _queue(spark, sf_dir, _caveats(spark, sf_dir)[1]).filter("status = 'open'").groupBy("case_id").agg(F.count("*").alias("open"))
    n = F.col("case_id").cast("long")
    found = F.concat_ws(
        " ", F.when(n % 5 == 0, "Document analysis is still running."), F.when(F.col("poor") > 0, F.concat(F.col("poor").cast("string"), F.lit(" document(s) still need parsing, OCR, or human review."))),
        F.when(F.col("open") > 0, F.concat(F.col("open").cast("string"), F.lit(" unresolved record issue(s) may be holding up the next step."))), F.when(n % 2 == 0, "No completed case analysis is available yet."),
    )
    return versions.join(reviews, "case_id", "left").select("case_id", F.coalesce(F.nullif(found, F.lit("")), F.lit("No document-processing blocker is seen. Ask counsel about court scheduling or procedural delay.")).alias("reasons"))


_ALLOWED = f"regexp_matches(trim(source_url), '{LEGAL_URL}')"
_RESULTS = """
results AS (
  SELECT page_id, CAST(page_id % 100 + 1 AS VARCHAR) AS case_id,
    CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'https://indiankanoon.org/search/?q=' || page_id WHEN 2 THEN 'https://www.indiankanoon.org/doc/' || page_id ELSE 'https://indiankanoon.org/doc/' || page_id || '/' END AS source_url,
    CASE WHEN page_id % 6 = 5 THEN '' ELSE 'State v. ' || page_id END AS title, CASE WHEN page_id % 4 = 3 THEN '' ELSE 'Passage ' || page_id END AS excerpt, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'AIR ' || page_id END AS citation FROM pages),
found0 AS (SELECT *, 'research_' || substr(sha256(source_url || ':' || title || ':' || excerpt), 1, 24) AS research_id FROM results WHERE """ + _ALLOWED + """),
finding AS (SELECT page_id, case_id, research_id, source_url, CASE title WHEN '' THEN 'IndianKanoon result' ELSE title END AS title, CASE excerpt WHEN '' THEN 'Open the cited judgment to review the relevant passage.' ELSE excerpt END AS excerpt, citation FROM found0),
law AS (SELECT page_id, case_id, 'claim_' || substr(sha256(case_id || ':' || research_id), 1, 24) AS claim_id, research_id, title || ': ' || excerpt AS statement, 0.75::DOUBLE AS confidence,
  'External authority must be checked in full before reliance.' AS caveat, 'cite_' || substr(sha256(research_id), 1, 24) AS citation_id, coalesce(nullif(citation, ''), title) AS citation_label, source_url FROM finding)
"""
_BOTH = records._CLAIMS + records._CAVEATS[len(records._ATOMS):] + "," + _RESULTS + """,
own AS (SELECT *, CASE WHEN CAST(case_id AS BIGINT) % 3 = 0 THEN rank % 7 ELSE 0 END AS m FROM claims),
law7 AS (SELECT *, CASE WHEN CAST(case_id AS BIGINT) % 3 = 0 THEN page_id % 7 ELSE 0 END AS m FROM law),
claims_t AS (
  SELECT case_id, claim_id, claim_kind AS kind, CASE m WHEN 1 THEN [] WHEN 2 THEN ['ev_missing'] ELSE [evidence_id] END AS evidence_ids, CAST([] AS VARCHAR[]) AS research_ids FROM own
  UNION ALL SELECT case_id, claim_id, 'law', CAST([] AS VARCHAR[]), CASE m WHEN 2 THEN ['research_missing'] ELSE [research_id] END FROM law7),
cites_t AS (
  SELECT case_id, citation_id, CASE WHEN m = 4 THEN 'ev_missing' ELSE evidence_id END AS evidence_id, NULL AS research_id, NULL AS source_url FROM own WHERE m <> 3
  UNION ALL SELECT case_id, citation_id, NULL, research_id, CASE WHEN m = 3 THEN 'https://elsewhere.example/' ELSE source_url END FROM law7 WHERE m <> 1),
uses AS (SELECT case_id, claim_id, unnest(evidence_ids) AS id FROM claims_t), uses_law AS (SELECT case_id, claim_id, unnest(research_ids) AS id FROM claims_t),
issues AS (
  SELECT case_id, 'research_source' AS code, 'research' AS entity_type, research_id AS entity_id FROM law7 WHERE NOT """ + _ALLOWED + """
  UNION SELECT case_id, 'research_citation', 'research', research_id FROM law7 f WHERE NOT EXISTS (SELECT 1 FROM cites_t c WHERE c.case_id = f.case_id AND c.research_id = f.research_id)
  UNION SELECT case_id, 'citation_evidence', 'citation', citation_id FROM cites_t c WHERE evidence_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM atoms a WHERE a.case_id = c.case_id AND a.evidence_id = c.evidence_id)
  UNION SELECT case_id, 'citation_research', 'citation', citation_id FROM cites_t c WHERE evidence_id IS NULL AND (NOT """ + _ALLOWED + """ OR NOT EXISTS (SELECT 1 FROM law7 f WHERE f.case_id = c.case_id AND f.research_id = c.research_id AND f.source_url = c.source_url))
  UNION SELECT case_id, 'unsupported_claim', 'claim', claim_id FROM claims_t WHERE len(evidence_ids) = 0 AND (kind = 'fact' OR len(research_ids) = 0)
  UNION SELECT case_id, 'claim_evidence', 'claim', claim_id FROM uses u WHERE NOT EXISTS (SELECT 1 FROM atoms a WHERE a.case_id = u.case_id AND a.evidence_id = u.id)
  UNION SELECT case_id, 'claim_research', 'claim', claim_id FROM uses_law u WHERE NOT EXISTS (SELECT 1 FROM law7 f WHERE f.case_id = u.case_id AND f.research_id = u.id)
  UNION SELECT case_id, 'claim_citation', 'claim', claim_id FROM uses u WHERE NOT EXISTS (SELECT 1 FROM cites_t c WHERE c.case_id = u.case_id AND c.evidence_id = u.id)
  UNION SELECT case_id, 'claim_research_citation', 'claim', claim_id FROM uses_law u WHERE NOT EXISTS (SELECT 1 FROM cites_t c WHERE c.case_id = u.case_id AND c.research_id = u.id)),
held AS (SELECT * FROM cites_t c WHERE NOT EXISTS (SELECT 1 FROM issues i WHERE i.case_id = c.case_id AND i.entity_type = 'citation' AND i.entity_id = c.citation_id)),
lost AS (
  SELECT case_id, claim_id FROM (SELECT * FROM uses UNION ALL SELECT * FROM uses_law) u WHERE case_id IN (SELECT case_id FROM issues) AND NOT EXISTS (SELECT 1 FROM held h WHERE h.case_id = u.case_id AND coalesce(h.evidence_id, h.research_id) = u.id)
  UNION SELECT case_id, entity_id FROM issues WHERE entity_type = 'claim')
"""
_QUEUE = records._CAVEATS + """
, items AS (""" + records.REVIEW_SQL + """),
queue AS (SELECT case_id, review_id, severity, CASE WHEN review_id[1] = '0' THEN 'dismissed' WHEN review_id[1] IN ('1', '2') THEN 'resolved' ELSE 'open' END AS status FROM items)
"""
QUERIES = {f.__name__: f for f in (rs2_findings, rs2_excluded, rs3_query, rpt3_research_claims, int8_report_issues, rpt11_mediated, rpt10_versions, rv2_queue, rv4_challenges, rv5_delays)}
SQL = {
    "rs2_findings": "WITH " + _RESULTS + "SELECT case_id, research_id, source_url, title, excerpt, citation FROM finding",
    "rs2_excluded": "WITH " + _RESULTS + """SELECT case_id, kept, excluded, concat_ws(' ', CASE WHEN excluded > 0 THEN CAST(excluded AS VARCHAR) || ' research result(s) were excluded because no verifiable source URL was returned.' END,
  CASE WHEN kept = 0 THEN 'No citable result was returned for the extracted record.' END) AS warning FROM (SELECT case_id, count(*) FILTER (WHERE """ + _ALLOWED + """) AS kept, count(*) FILTER (WHERE NOT """ + _ALLOWED + """) AS excluded FROM results GROUP BY case_id)""",
    "rs3_query": records._ATOMS + """,
marked AS (SELECT *, kind IN ('legal_provision','case_number','court','authority','document_reference') AS leads, row_number() OVER (PARTITION BY case_id, kind IN ('legal_provision','case_number','court','authority','document_reference') ORDER BY rank) AS r FROM atoms),
leading_values AS (SELECT case_id, string_agg(value, ' ' ORDER BY pos) AS q FROM (SELECT case_id, value, min(rank) AS pos FROM marked WHERE leads AND r <= 12 GROUP BY ALL) GROUP BY case_id),
any_values AS (SELECT case_id, string_agg(value, ' ' ORDER BY pos) AS q FROM (SELECT case_id, value, min(rank) AS pos FROM marked WHERE rank <= 8 GROUP BY ALL) GROUP BY case_id)
SELECT case_id, substr(coalesce(l.q, a.q), 1, 500) AS query FROM any_values a LEFT JOIN leading_values l USING (case_id)""",
    "rpt3_research_claims": "WITH " + _RESULTS + "SELECT case_id, claim_id, research_id, statement, confidence, caveat, citation_id, citation_label, source_url FROM law",
    "int8_report_issues": _BOTH + "SELECT * FROM issues",
    "rpt11_mediated": _BOTH + """,
k AS (SELECT case_id, count(*) AS claims FROM claims_t c WHERE NOT EXISTS (SELECT 1 FROM lost l WHERE l.case_id = c.case_id AND l.claim_id = c.claim_id) GROUP BY case_id), h AS (SELECT case_id, count(*) AS citations FROM held GROUP BY case_id)
SELECT case_id, coalesce(claims, 0) AS claims, coalesce(citations, 0) AS citations, CASE WHEN case_id IN (SELECT case_id FROM issues) OR case_id IN (SELECT case_id FROM caveats WHERE severity = 'blocking') THEN 'needs_review' ELSE 'completed' END AS status
FROM (SELECT DISTINCT case_id FROM claims_t) LEFT JOIN k USING (case_id) LEFT JOIN h USING (case_id)""",
    "rpt10_versions": "SELECT case_id, version, 'report_' || substr(sha256(case_id || ':' || CAST(version AS VARCHAR)), 1, 24) AS report_id FROM (SELECT CAST(c_custkey AS VARCHAR) AS case_id, 1 + count(o_orderkey) AS version FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY c_custkey)",
    "rv2_queue": _QUEUE + "SELECT *, CASE WHEN status = 'open' THEN row_number() OVER (PARTITION BY case_id, status ORDER BY severity <> 'blocking', review_id) END AS position FROM queue",
    "rv4_challenges": records._CAVEATS + """,
attacks AS (
  SELECT case_id, 0 AS part, caveat_id AS id, severity, title, detail FROM caveats
  UNION ALL SELECT case_id, 1, 'evidence-' || evidence_id, 'warning', label || ' may be challenged', 'The current extraction is ' || CAST(CAST(round(confidence * 100) AS INTEGER) AS VARCHAR) || '% confident. Verify the original page before relying on it.' FROM atoms WHERE confidence < 0.75 OR review_state = 'needs_review'),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, title ORDER BY part, id) AS n FROM attacks) WHERE n = 1)
SELECT case_id, rank, id, severity, title, detail FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY part, id) AS rank FROM firsts) WHERE rank <= 4""",
    "rv5_delays": _QUEUE + """,
v AS (SELECT case_id, count(*) FILTER (WHERE status <> 'ready') AS poor FROM (SELECT DISTINCT case_id, version_id, status FROM blocks) GROUP BY case_id),
o AS (SELECT case_id, count(*) AS n FROM queue WHERE status = 'open' GROUP BY case_id),
r AS (SELECT v.case_id, concat_ws(' ', CASE WHEN CAST(v.case_id AS BIGINT) % 5 = 0 THEN 'Document analysis is still running.' END, CASE WHEN poor > 0 THEN CAST(poor AS VARCHAR) || ' document(s) still need parsing, OCR, or human review.' END,
  CASE WHEN n > 0 THEN CAST(n AS VARCHAR) || ' unresolved record issue(s) may be holding up the next step.' END, CASE WHEN CAST(v.case_id AS BIGINT) % 2 = 0 THEN 'No completed case analysis is available yet.' END) AS t FROM v LEFT JOIN o USING (case_id))
SELECT case_id, coalesce(nullif(t, ''), 'No document-processing blocker is seen. Ask counsel about court scheduling or procedural delay.') AS reasons FROM r""",
}
