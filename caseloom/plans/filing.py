"""Registered queries over complaints on their way to a filing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.operators import filing, triage
from caseloom.plans import complaints as base
from caseloom.sources.views import spread, table

#: What follows the sentence of a complaint, by its number; {} is the order's day.
TAILS = [" on {} at Rampur police station by officer ram singh", " in Nagpur district, wheat lost, bajaj says no", " in village Sonpur, road gone since aaj", " by Sharma Textiles company, Rs. 12,500 due since 5 march 2024", " दिनांक 5 मार्च 2024", ""]


def _complaints(spark, sf_dir) -> DataFrame:
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"))
    n, day = F.col("o_orderkey"), F.date_format("o_orderdate", "dd/MM/yyyy")
    pick = lambda options, by: F.element_at(F.array(*options), (by % len(options) + 1).cast("int"))
    text = F.concat(pick([F.lit(s) for s in base.SENTENCES], n), F.replace(pick([F.lit(t) for t in TAILS], F.floor(n / 13)), F.lit("{}"), day))
    return triage.classified(o.select(n.alias("complaint_id"), text.alias("text"), F.when(F.col("o_custkey") % 5 > 0, F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"))).alias("name"), day.alias("day")))


def tr4_dates(spark, sf_dir):
    return _complaints(spark, sf_dir).select("complaint_id", filing.first_date(F.col("text")).alias("date"))


def tr5_entities(spark, sf_dir):
    e = _complaints(spark, sf_dir).select("complaint_id", "case_type", filing.entities(F.col("text"), F.col("case_type")).alias("e"))
    return e.select("complaint_id", "case_type", F.array_join(F.transform(F.map_entries("e"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), "; ").alias("entities"))


def _drafts(spark, sf_dir) -> DataFrame:
    c = filing.with_context(_complaints(spark, sf_dir).drop("authority", "section"))
    values = F.create_map(F.lit("authority"), F.col("authority"), F.lit("name"), F.coalesce("name", F.lit("")), F.lit("district"), F.when(F.col("complaint_id") % 4 == 0, "Patna").otherwise(""), F.lit("date"), F.col("day"), F.lit("facts"), F.col("text"))
    cited = F.when(F.col("complaint_id") % 2 == 0, F.concat(F.lit("\nUnder "), F.get("sections", F.lit(0)))).otherwise("")
    return c.withColumn("document", F.concat(triage.filled(F.lit(base.TEMPLATE), values, base.FIELDS), cited))


def tr6_context(spark, sf_dir):
    return filing.with_context(_complaints(spark, sf_dir).drop("authority", "section")).select("complaint_id", F.array_join("sections", "; ").alias("sections"), "authority", "portal", F.array_join("documents", "; ").alias("documents"))


def pt4_objections(spark, sf_dir):
    return _drafts(spark, sf_dir).select("complaint_id", F.array_join(filing.objections(F.col("document"), F.col("sections")), " | ").alias("objections"))


def pt4_merged(spark, sf_dir):
    """The clerk's objections and a reviewer's, of which one may say the same."""
    own = filing.objections(F.col("document"), F.col("sections"))
    said = F.array(F.lit("Name the officer"), F.coalesce(F.get(own, F.lit(0)), F.lit("Sign each page")), F.lit("Attach the receipt"), F.lit("Name the officer"), F.lit("State the date"))
    return _drafts(spark, sf_dir).select("complaint_id", F.array_join(filing.merged(own, F.slice(said, 1, (F.col("complaint_id") % 6).cast("int"))), " | ").alias("objections"))


def pt5_filings(spark, sf_dir):
    return filing.filings(_drafts(spark, sf_dir)).select("complaint_id", "title", F.array_join("gap_fields", ",").alias("gap_fields"), "status", "confidence", "instructions")


def pt7_votes(spark, sf_dir):
    """Each line of an order as a round of its debate; scores and open issues follow from its keys. Of several lines with
    the latest number the first in the table's file counts, which is what the SQL's open order gives on one thread."""
    l = table(spark, sf_dir, "lineitem").select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("place"))
    rounds = l.select("l_orderkey", "place", F.col("l_linenumber").cast("long").alias("round"), (F.col("l_quantity") % 11).alias("completeness"), (F.col("l_partkey") % 11).alias("legal"), (F.col("l_suppkey") % 11).alias("procedure"), F.slice(F.array(F.lit("Name the officer"), F.lit("Attach the receipt")), 1, (F.col("l_partkey") % 3).cast("int")).alias("unresolved"))
    return filing.mediator_votes(rounds, "l_orderkey", "place")


QUERIES = {f.__name__: f for f in (tr4_dates, tr5_entities, tr6_context, pt4_objections, pt4_merged, pt5_filings, pt7_votes)}


def _sql() -> dict[str, str]:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    listed = lambda xs: "[" + ", ".join(map(q, xs)) + "]"
    strip = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
    named = lambda x: f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
    date = "coalesce(" + ", ".join([f"nullif(regexp_extract(lower(text), {q(p)}, 0), '')" for p in filing.DATES] + [rf"nullif(regexp_extract(text, '(\d{{1,2}})\s*{m}\s*(\d{{4}})', 0), '')" for m in filing.HINDI_MONTHS]) + ", '')"

    def entity(kind, arg):
        if kind == "date":
            return date
        if kind.startswith("word"):
            return "CASE " + " ".join(f"WHEN contains(lower(text), {q(w)}) THEN {q(w.title() if kind == 'word name' else w)}" for w in arg) + " ELSE '' END"
        got = strip(f"regexp_extract({'text' if kind == 'text' else 'lower(text)'}, {q(arg)}, {0 if kind == 'match' else 1})")
        return named(got) if kind == "name" else got

    made = lambda rules: " || '; ' || ".join(f"{q(f + '=')} || {entity(k, a)}" for f, k, a in rules)
    tr2 = base.SQL["tr2_classified"]
    head = tr2[: tr2.index("SELECT complaint_id, normal, case_type")]
    text = f"{listed(base.SENTENCES)}[o_orderkey % {len(base.SENTENCES)} + 1]"
    tails = f"replace({listed(TAILS)}[(o_orderkey // 13) % {len(TAILS)} + 1], '{{}}', strftime(o_orderdate, '%d/%m/%Y'))"
    head = head.replace(text + " AS text", f"{text} || {tails} AS text", 1).rstrip()
    context = "VALUES " + ", ".join(f"({q(t)}, {listed(s)}, {q(a)}, {q(p)}, {listed(d)})" for t, s, a, p, d in filing.CONTEXT)
    head += f""",
k(t, sections, office, portal, documents) AS ({context}),
d AS (SELECT c.*, k.*, 'To the ' || office || chr(10) || 'I, ' || coalesce(name, '[NAME — Please Fill]') || ', of ' || CASE WHEN complaint_id % 4 = 0 THEN 'Patna' ELSE '[DISTRICT — Please Fill]' END || ', report on ' || day || ': ' || text || CASE WHEN complaint_id % 2 = 0 THEN chr(10) || 'Under ' || sections[1] ELSE '' END AS document FROM c JOIN k ON k.t = c.case_type),
n AS (SELECT *, len(regexp_extract_all(document, '\\[.+? — Please Fill\\]')) AS blanks, list_filter(string_split_regex(trim(regexp_replace(sections[1], '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')), '\\s+'), lambda w: length(w) > 2 AND contains(document, w)) AS cited FROM d),
o AS (SELECT *, list_filter([CASE WHEN blanks > 0 THEN CAST(blanks AS VARCHAR) || ' mandatory field(s) are blank and marked ''Please Fill'' — application cannot be processed until these are completed' END,
  CASE WHEN len(cited) = 0 THEN 'Applicable legal section ''' || sections[1] || ''' does not appear to be cited in the document' END], lambda x: x IS NOT NULL) AS objections FROM n),
g AS (SELECT *, list_concat(list_transform(objections, lambda x: substr(regexp_replace(trim(regexp_replace(lower(x), '[^a-zA-Z0-9\\s]', '', 'g')), '\\s+', '_', 'g'), 1, 50)), regexp_extract_all(document, '\\[([A-Z_]+) — Please Fill\\]', 1)) AS fields FROM o)
""".replace("\\\\", "\\")
    whens = " ".join(f"WHEN {q(t)} THEN {made(r)}" for t, r in filing.ENTITIES.items())
    return {
        "tr4_dates": head + f"SELECT complaint_id, {date} AS date FROM c",
        "tr5_entities": head + f"SELECT complaint_id, case_type, CASE case_type {whens} ELSE {made(filing.OTHER)} END AS entities FROM c",
        "tr6_context": head + "SELECT complaint_id, array_to_string(sections, '; ') AS sections, office AS authority, portal, array_to_string(documents, '; ') AS documents FROM d",
        "pt4_objections": head + "SELECT complaint_id, array_to_string(objections, ' | ') AS objections FROM o",
        "pt4_merged": head + "SELECT complaint_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:4], ' | ') AS objections FROM (SELECT complaint_id, list_concat(objections[1:2], (['Name the officer', coalesce(objections[1], 'Sign each page'), 'Attach the receipt', 'Name the officer', 'State the date'])[1:complaint_id % 6]) AS l FROM o)",
        "pt5_filings": head + f"SELECT complaint_id, sections[1] || ' — ' || {named(chr(39) + chr(39) + ' || replace(case_type, ' + q('_') + ', ' + q(' ') + ')')} || ' Application' AS title, array_to_string(fields, ',') AS gap_fields, CASE WHEN len(fields) > 0 THEN 'annotated' ELSE 'hardened' END AS status, CASE WHEN len(fields) = 0 THEN 0.9::DOUBLE ELSE greatest(0.4::DOUBLE, round(0.9::DOUBLE - 0.1::DOUBLE * len(fields), 6)) END AS confidence, 'File this document at: ' || office || '. Portal / Office: ' || portal || '. Documents to attach: ' || array_to_string(documents, ', ') || '.' AS instructions FROM g",
        "pt7_votes": """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) AS r, (l_quantity % 11 + l_partkey % 11 + l_suppkey % 11) / 3.0::DOUBLE AS overall, ['Name the officer', 'Attach the receipt'][1:l_partkey % 3] AS unresolved FROM lineitem)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS round, round(overall, 6) AS overall, CASE WHEN overall >= 8 OR l_linenumber >= 2 THEN 'true' ELSE 'false' END AS approved,
  CASE WHEN len(unresolved) = 0 THEN 'All blocking issues resolved.' WHEN overall >= 8 OR l_linenumber >= 2 THEN array_to_string(list_transform(unresolved, lambda x, i: CAST(i AS VARCHAR) || '. ' || x), chr(10)) ELSE '' END AS note FROM r WHERE r = 1""",
    }


SQL = _sql()
