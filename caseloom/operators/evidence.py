"""Evidence from text blocks: rules with exact spans, atoms folded by value, relations, and a chronology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions.text import excerpt, normal, spans, stable_id

#: The extraction rules (name, kind, pattern, confidence).
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
RULES = [
    ("numeric_date", "date", r"\b(?:0?[1-9]|[12]\d|3[01])[-/.](?:0?[1-9]|1[0-2])[-/.](?:19|20)\d{2}\b", 0.96),
    ("named_date", "date", rf"(?i)\b(?:0?[1-9]|[12]\d|3[01])\s+(?:{MONTHS})\s+(?:19|20)\d{{2}}\b", 0.94),
    ("case_number", "case_number", r"(?i)\b(?:case|petition|appeal|writ|fir|complaint|suit|application|crl\.?|civil)\s*(?:no\.?|number)?\s*[:#-]?\s*[A-Z0-9./-]{2,}\s+(?:of\s+)?(?:19|20)\d{2}\b", 0.93),
    ("legal_provision", "legal_provision", r"(?i)\b(?:section|article|rule|order)\s+\d+[A-Za-z]?(?:\([0-9A-Za-z]+\))*(?:\s+(?:of|under)\s+the\s+[A-Za-z0-9 .,'()-]{3,80}?(?:Act|Code|Rules|Constitution)(?:,?\s*\d{4})?)?", 0.92),
    ("money", "money", r"(?i)(?:Rs\.?|INR|₹)\s*[0-9][0-9,]*(?:\.\d{1,2})?", 0.95),
    ("email", "contact", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", 0.98),
    ("phone", "contact", r"(?<!\d)(?:\+91[-\s]?)?[6-9]\d{9}(?!\d)", 0.92),
    ("court", "court", r"(?i)\b(?:Supreme Court of India|[A-Z][A-Za-z ]+ High Court|District(?: and Sessions)? Court|Court of (?:the )?[A-Za-z .]+|Judicial Magistrate(?: First Class)?|Tribunal)\b", 0.88),
    ("authority", "authority", r"(?i)\b(?:Police Station|District Magistrate|Sub-Divisional Magistrate|Tehsildar|Collector|Public Information Officer|Government of [A-Za-z ]+|Ministry of [A-Za-z &]+|Department of [A-Za-z &]+)\b", 0.84),
    ("document_reference", "document_reference", r"(?i)\b(?:affidavit|annexure|exhibit|charge[- ]sheet|judgment|order|notice|summons|warrant|fir|complaint|petition|written statement|medical report|forensic report|sale deed|registry)(?:\s+(?:no\.?|number|[A-Z]))?\s*[A-Z0-9./-]*", 0.82),
]
ROLES = "petitioner|applicant|complainant|informant|respondent|accused|appellant|defendant|plaintiff|deponent|witness"
PARTY = rf"(?i)\b({ROLES})(\s*(?:no\.?\s*\d+)?\s*[:.-]\s*)([A-Z][A-Za-z.' -]{{2,80}})(?=\n|,|;|\s+(?:aged|age|son|daughter|wife|resident|address)\b|$)"
HIGH_COURT = "[A-Z][A-Za-z ]+ High Court|"
PARTY_CONFIDENCE, GATE = 0.90, 0.75
OPPOSING = [("petitioner", "respondent"), ("applicant", "respondent"), ("complainant", "accused"), ("plaintiff", "defendant"), ("appellant", "respondent")]
ACTORS = ["person", "organization", "court", "authority"]


def title(name: str) -> str:
    return name.replace("_", " ").title()


def occurrences(blocks: DataFrame) -> DataFrame:
    """One row a match in blocks of usable documents: the blocks' columns, kind, label, start, end, quote, weight."""
    usable = blocks.filter(F.col("status").isin("ready", "partial"))

    def found(kind: str, label: Column | None, weight: float, got: Column) -> Column:
        return F.transform(got, lambda s: F.struct(F.lit(kind).alias("kind"), (label if label is not None else F.initcap(F.regexp_extract(s["before"], rf"(?i)({ROLES})\s*(?:no\.?\s*\d+)?\s*[:.-]\s*$", 1))).alias("label"), s["start"].alias("start"), s["end"].alias("end"), s["quote"].alias("quote"), F.lit(weight).alias("weight")))

    def of_rule(name: str, pattern: str) -> Column:
        # what a rule can't do without is looked for first: in prose without it, these two rules would try each word's rest
        if name == "email":
            return F.when(F.contains("text", F.lit("@")), spans(F.col("text"), pattern)).otherwise(spans(F.lit(""), pattern))
        if name == "court":
            return F.when(F.contains(F.lower("text"), F.lit("high court")), spans(F.col("text"), pattern)).otherwise(spans(F.col("text"), pattern.replace(HIGH_COURT, "")))
        return spans(F.col("text"), pattern)

    parties = found("person", None, PARTY_CONFIDENCE, spans(F.col("text"), PARTY, "$1$2\u0001$3\u0002"))
    all_ = [found(kind, F.lit(title(name)), weight, of_rule(name, pattern)) for name, kind, pattern, weight in RULES]
    return usable.withColumn("m", F.explode(F.concat(parties, *all_))).select(*blocks.columns, "m.*").withColumn("normalized", normal(F.col("quote"))).filter("normalized <> ''")


def atoms(found: DataFrame) -> DataFrame:
    """One row a distinct value of a case: evidence_id, value, confidence, review_state, spans in document order, rank.

    Ranks need a case's values in one place, so what was found is dealt by case before it is grouped: spans move once, and
    those of one block stay together, which compresses them. The normal form follows from the quote after the move."""
    place = F.struct("document_order", "sequence", "start", "end", "version_id", "block_id", "quote")
    moved = found.select("case_id", "kind", "label", "quote", "weight", "confidence", "document_order", "sequence", "start", "end", "version_id", "block_id")
    found = moved.repartition("case_id").withColumn("normalized", normal(F.col("quote")))
    grouped = found.groupBy("case_id", "kind", "label", "normalized").agg(F.array_sort(F.collect_set(place)).alias("spans"), F.min(F.col("weight") * F.col("confidence")).alias("raw"))
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy("kind", "label", "normalized"))
    return grouped.select(
        "case_id", stable_id("ev_", "case_id", "kind", F.lower("label"), "normalized").alias("evidence_id"), "kind", "label", "normalized",
        F.col("spans")[0]["quote"].alias("value"), F.round("raw", 4).alias("confidence"), F.when(F.col("raw") >= GATE, "verified").otherwise("needs_review").alias("review_state"),
        "spans", rank.cast("long").alias("rank"),
    )


def by_block(evidence: DataFrame) -> DataFrame:
    """The evidence of each block in evidence order, once for each span."""
    flat = evidence.select("case_id", "evidence_id", "kind", "label", "value", "confidence", "rank", F.posexplode("spans").alias("span", "s"))
    return flat.select("case_id", "evidence_id", "kind", "label", "value", "confidence", "rank", "span", F.col("s.version_id").alias("version_id"), F.col("s.block_id").alias("block_id"))


def edges(evidence: DataFrame) -> DataFrame:
    """Relations between actors of one block, of which the first eight count."""
    actors = by_block(evidence).filter(F.col("kind").isin(*ACTORS))
    actors = actors.withColumn("i", F.row_number().over(Window.partitionBy("case_id", "version_id", "block_id").orderBy("rank", "span"))).filter("i <= 8")
    listed = actors.groupBy("case_id", "version_id", "block_id").agg(F.array_sort(F.collect_list(F.struct("i", "evidence_id", "kind", "label", "value", "confidence"))).alias("a"))
    paired = listed.select("case_id", F.explode(F.flatten(F.transform("a", lambda x: F.transform(F.filter("a", lambda y: (y["i"] > x["i"]) & (y["evidence_id"] != x["evidence_id"])), lambda y: F.struct(x.alias("s"), y.alias("t")))))).alias("p"))
    s, t = F.lower("p.s.label"), F.lower("p.t.label")
    opposed = F.lit(False)
    for a, b in OPPOSING:
        opposed = opposed | ((s == a) & (t == b)) | ((s == b) & (t == a))
    kind = F.when(opposed, "opposes").when((F.col("p.s.kind") == "court") | (F.col("p.t.kind") == "court"), "appears_before").otherwise("co_mentioned")
    low = F.least("p.s.confidence", "p.t.confidence")
    named = paired.withColumn("relationship_type", kind).select(
        "case_id", stable_id("rel_", "case_id", "p.s.evidence_id", "p.t.evidence_id", "relationship_type").alias("relationship_id"), F.col("p.s.evidence_id").alias("source_evidence_id"), F.col("p.t.evidence_id").alias("target_evidence_id"), "relationship_type",
        F.concat(F.col("p.s.value"), F.lit(" is "), F.replace("relationship_type", F.lit("_"), F.lit(" ")), F.lit(" "), F.col("p.t.value"), F.lit(" in the source record.")).alias("description"),
        low.alias("confidence"), F.when(low >= GATE, "verified").otherwise("needs_review").alias("review_state"),
    )
    return named.dropDuplicates(["relationship_id"])


def calendar_date(text: Column) -> Column:
    """The day a date text names, else null."""
    tidy = F.initcap(F.trim(text))
    return F.coalesce(*[F.try_to_timestamp(tidy, F.lit(f)) for f in ("d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d MMMM yyyy", "d MMM yyyy")]).cast("date")


def chronology(evidence: DataFrame, blocks: DataFrame) -> DataFrame:
    """One event a date, told by the block of its first span; dated events first."""
    dates = evidence.filter("kind = 'date'").select("case_id", F.col("evidence_id").alias("date_id"), "value", F.col("spans")[0]["version_id"].alias("version_id"), F.col("spans")[0]["block_id"].alias("block_id"))
    beside = by_block(evidence).select("case_id", "version_id", "block_id", "evidence_id", "confidence", "rank", "span")
    met = dates.join(beside, ["case_id", "version_id", "block_id"]).groupBy("case_id", "date_id", "value", "version_id", "block_id").agg(F.min("confidence").alias("confidence"), F.array_sort(F.collect_list(F.struct("rank", "span", "evidence_id"))).alias("near"))
    told = met.join(blocks.select("case_id", "version_id", "block_id", F.trim("text").alias("text")), ["case_id", "version_id", "block_id"])
    told = told.withColumn("description", F.when(F.length("text") > 320, F.concat(F.rtrim(F.substring("text", 1, 317)), F.lit("..."))).otherwise(F.col("text"))).withColumn("normalized_date", calendar_date(F.col("value")))
    order = Window.partitionBy("case_id").orderBy(F.col("normalized_date").isNull(), F.coalesce(F.col("normalized_date").cast("string"), "value"), "date_id")
    return told.select("case_id", stable_id("evt_", "case_id", "date_id", "description").alias("event_id"), F.col("value").alias("date_text"), F.col("normalized_date").cast("string").alias("normalized_date"), "description", "confidence", F.array_distinct(F.concat(F.array("date_id"), F.transform("near", lambda x: x["evidence_id"]))).alias("evidence_ids"), F.row_number().over(order).cast("long").alias("position"))


# The same in SQL for the other engine; \\1..\\4 are groups, chr(1) and chr(2) the marks.


def _matches_sql(kind: str, label: str, pattern: str, weight: float, replacement: str) -> str:
    flags = "g"
    return f"""
SELECT case_id, version_id, document_order, document_name, sequence, block_id, confidence, '{kind}' AS kind, {label} AS label, {weight}::DOUBLE AS weight,
       CAST(off AS INTEGER) AS start, CAST(off + strpos(part, chr(2)) - 1 AS INTEGER) AS "end", substr(part, 1, strpos(part, chr(2)) - 1) AS quote
FROM (SELECT *, lag(part) OVER w AS before, coalesce(sum(length(replace(part, chr(2), ''))) OVER (PARTITION BY block_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
      FROM (SELECT *, generate_subscripts(p, 1) AS i, unnest(p) AS part FROM (
        SELECT *, string_split(regexp_replace(text, '{pattern.replace("'", "''")}', {replacement}, '{flags}'), chr(1)) AS p FROM blocks WHERE status IN ('ready', 'partial')))
      WINDOW w AS (PARTITION BY block_id ORDER BY i))
WHERE i > 1"""


def occurrences_sql() -> str:
    whole = r"chr(1) || '\0' || chr(2)"
    parts = [_matches_sql("person", f"upper(substr(regexp_extract(before, '(?i)({ROLES})[^A-Za-z]*$', 1), 1, 1)) || lower(substr(regexp_extract(before, '(?i)({ROLES})[^A-Za-z]*$', 1), 2))", PARTY.split("(?=")[0] + r"(\n|,|;|$)", PARTY_CONFIDENCE, r"'\1\2' || chr(1) || '\3' || chr(2) || '\4'")]
    for name, kind, pattern, weight in RULES:
        if name == "phone":
            parts.append(_matches_sql(kind, f"'{title(name)}'", r"(^|[^0-9])((?:\+91[-\s]?)?[6-9]\d{9})([^0-9]|$)", weight, r"'\1' || chr(1) || '\2' || chr(2) || '\3'"))
        else:
            parts.append(_matches_sql(kind, f"'{title(name)}'", pattern, weight, whole))
    return "found AS (SELECT *, lower(trim(regexp_replace(quote, '\\s+', ' ', 'g'), ' ,.;:-')) AS normalized FROM (" + "\nUNION ALL\n".join(parts) + ") x WHERE trim(quote, ' ,.;:-') <> '')"


ATOMS_SQL = """
atoms0 AS (
  SELECT case_id, kind, label, normalized, min(weight * confidence) AS raw,
         list({'o': document_order, 'q': sequence, 's': start, 'e': "end", 'v': version_id, 'b': block_id, 't': quote} ORDER BY document_order, sequence, start) AS spans
  FROM found GROUP BY ALL),
atoms AS (
  SELECT *, 'ev_' || substr(sha256(case_id || ':' || kind || ':' || lower(label) || ':' || normalized), 1, 24) AS evidence_id, spans[1].t AS value,
         round(raw, 4) AS confidence, CASE WHEN raw >= 0.75 THEN 'verified' ELSE 'needs_review' END AS review_state,
         row_number() OVER (PARTITION BY case_id ORDER BY kind, label, normalized) AS rank
  FROM atoms0),
by_block AS (
  SELECT case_id, evidence_id, kind, label, value, confidence, rank, span, s.v AS version_id, s.b AS block_id
  FROM (SELECT *, generate_subscripts(spans, 1) AS span, unnest(spans) AS s FROM atoms))
"""
