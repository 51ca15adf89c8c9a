"""Registered queries over complaints: triage, petition text, gaps and the debate rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.operators import triage
from caseloom.sources.views import spread, table

SENTENCES = [
    "Police ne nahi ki FIR meri complaint par", "Officer at the station refused to register my complaint", "My crop insurance claim was rejected by the company",
    "Fasal bima claim reject ho gaya kisan ka", "Flood damage to my house and no relief", "Malik ne tankhwah nahi diya, salary unpaid", "I want to file an RTI for information from government record",
    "The product was defective and the company gave no refund", "Encroachment on my land and boundary", "My husband is beating me for dowry", "Factory worker fired without overtime", "Nothing in particular", "पुलिस ने शिकायत दर्ज नहीं किया",
]
TEMPLATE = "To the {authority}\nI, {name}, of {district}, report on {date}: {facts}"
FIELDS = ["authority", "name", "district", "date", "facts"]


def complaints(spark, sf_dir) -> DataFrame:
    """Each order as one of the sentences, with its amount and customer."""
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"))
    sentence = F.element_at(F.array(*[F.lit(s) for s in SENTENCES]), (F.col("o_orderkey") % len(SENTENCES) + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("complaint_id"), sentence.alias("text"), F.when(F.col("o_custkey") % 5 > 0, F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"))).alias("name"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"))


def tr2_classified(spark, sf_dir):
    c = triage.classified(complaints(spark, sf_dir))
    return c.select("complaint_id", triage.translated(F.col("text")).alias("normal"), "case_type", F.col("score").cast("long").alias("score"), "confidence", "authority", "section", "language", "question")


def _petitions(spark, sf_dir) -> DataFrame:
    c = triage.classified(complaints(spark, sf_dir))
    values = F.create_map(F.lit("authority"), F.coalesce("authority", F.lit("")), F.lit("name"), F.coalesce("name", F.lit("")), F.lit("date"), F.col("day"), F.lit("facts"), F.col("text"))
    return c.select("complaint_id", "section", triage.filled(F.lit(TEMPLATE), values, FIELDS).alias("document"))


def pt1_petitions(spark, sf_dir):
    return _petitions(spark, sf_dir).withColumn("document", F.concat("document", F.coalesce(F.concat(F.lit("\nUnder "), "section"), F.lit("")))).drop("section")


def pt3_gaps(spark, sf_dir):
    p = _petitions(spark, sf_dir).select("complaint_id", F.posexplode(triage.gaps(F.col("document"))).alias("position", "field"))
    return p.select("complaint_id", F.col("position").cast("long").alias("position"), "field", F.concat(F.lit("Fill in: "), F.lower("field")).alias("how_to_fix"))


def pt6_debate(spark, sf_dir):
    """The next step of each line of an order, read as a round of its debate."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), (F.col("l_quantity") * 3).alias("elapsed"), (F.col("l_partkey") % 3).alias("n"))
    return l.select("l_orderkey", "l_linenumber", triage.next_step(F.col("l_linenumber"), F.col("elapsed"), F.col("n")).alias("next"))


QUERIES = {f.__name__: f for f in (tr2_classified, pt1_petitions, pt3_gaps, pt6_debate)}


def _sql() -> dict[str, str]:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    normal = "trim(lower(text))"
    for phrase, word in triage.ordered_phrases():
        normal = f"replace({normal}, {q(phrase)}, {q(word)})"
    normal = rf"trim(regexp_replace({normal}, '\s+', ' ', 'g'))"
    scores = []
    for _, en, hi, *_ in triage.TYPES:
        hits = [f"(CASE WHEN {f'contains(normal, {q(w)})' if ' ' in w else rf'regexp_matches(normal, {q(chr(92) + "b" + w + chr(92) + "b")})'} THEN {3 if ' ' in w else 1} ELSE 0 END)" for w in en]
        hits += [f"(CASE WHEN contains(lower(text), {q(w)}) THEN {3 if ' ' in w else 1} ELSE 0 END)" for w in hi]
        scores.append(" + ".join(hits))
    names, authorities, sections = ("[" + ", ".join(q(t[i]) for t in triage.TYPES) + "]" for i in (0, 3, 4))
    head = f"""
WITH c0 AS (SELECT o_orderkey AS complaint_id, [{', '.join(map(q, SENTENCES))}][o_orderkey % {len(SENTENCES)} + 1] AS text, CASE WHEN o_custkey % 5 > 0 THEN 'Customer ' || CAST(o_custkey AS VARCHAR) END AS name, strftime(o_orderdate, '%d/%m/%Y') AS day FROM orders),
c1 AS (SELECT *, {normal} AS normal FROM c0),
c2 AS (SELECT *, [{', '.join(scores)}] AS scores FROM c1),
c3 AS (SELECT *, CAST(list_max(scores) AS BIGINT) AS score, list_position(scores, list_max(scores)) AS place, len(regexp_extract_all(text, '[ऀ-ॿ]')) AS letters FROM c2),
c AS (SELECT complaint_id, text, name, day, normal, score, CASE WHEN score = 0 THEN 'unknown' ELSE {names}[place] END AS case_type, least(1.0::DOUBLE, score / 5.0::DOUBLE) AS confidence,
  CASE WHEN score > 0 THEN {authorities}[place] END AS authority, CASE WHEN score > 0 THEN {sections}[place] END AS section, CASE WHEN letters > 5 THEN 'hi' WHEN letters > 0 THEN 'hinglish' ELSE 'en' END AS language FROM c3),
p AS (SELECT complaint_id, section, 'To the ' || coalesce(authority, '[AUTHORITY — Please Fill]') || chr(10) || 'I, ' || coalesce(name, '[NAME — Please Fill]') || ', of [DISTRICT — Please Fill], report on ' || day || ': ' || text AS document FROM c)
"""
    return {
        "tr2_classified": head + "SELECT complaint_id, normal, case_type, score, confidence, authority, section, language, CASE WHEN confidence < 0.6 THEN 'Please describe what happened, when and where.' END AS question FROM c",
        "pt1_petitions": head + "SELECT complaint_id, document || coalesce(chr(10) || 'Under ' || section, '') AS document FROM p",
        "pt3_gaps": head + "SELECT complaint_id, CAST(generate_subscripts(g, 1) - 1 AS BIGINT) AS position, unnest(g) AS field, 'Fill in: ' || lower(unnest(g)) AS how_to_fix FROM (SELECT complaint_id, regexp_extract_all(document, '\\[([A-Z_]+) — Please Fill\\]', 1) AS g FROM p)",
        "pt6_debate": "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN l_linenumber >= 2 OR l_quantity * 3 > 90 OR l_partkey % 3 = 0 THEN 'filing' ELSE 'advocate' END AS next FROM lineitem",
    }


SQL = _sql()
