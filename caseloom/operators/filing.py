"""From a classified complaint to a filing: dates, entities, legal context, objections, gaps, and the mediator's vote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.operators.triage import gaps

W, WS = r"[\p{L}\p{N}_]", r"[\p{L}\p{N}_\s]"
#: Date patterns in order, month names in Hindi, entity rules by case type (field, pattern or words).
DATES = [r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})\b", r"\b(\d{1,2})\s+(january|february|march|april|may|june|july|august|september|october|november|december)\s+(\d{4})\b", r"\b(aaj|kal|parso)\b"]
HINDI_MONTHS = ["जनवरी", "फरवरी", "मार्च", "अप्रैल", "मई", "जून", "जुलाई", "अगस्त", "सितंबर", "अक्टूबर", "नवंबर", "दिसंबर"]
AMOUNT = r"(?:rs\.?\s*|₹\s*)(\d[\d,]*)"
DISTRICT = rf"({W}{WS}{{1,20}})\s+(?:district|jila|जिला)"
# (field, "date" | "match" | "name" | "text" | "word" | "word name", pattern or words): name is in title case, text reads the original
ENTITIES = {
    "fir_refusal": [("station_name", "name", rf"({W}{WS}{{1,30}})\s+(?:police\s+)?(?:station|thana)"), ("officer_name", "name", r"(?:officer|sho|inspector|constable)\s+([a-z][a-z\s]{1,25})"), ("incident_date", "date", None)],
    "crop_insurance": [("date", "date", None), ("crop_name", "word name", ["wheat", "rice", "paddy", "cotton", "soybean", "maize", "gehu", "dhan", "kapas", "गेहूं", "धान", "कपास", "मक्का"]), ("insurance_company", "word name", ["reliance", "bajaj", "hdfc", "new india", "oriental", "united india", "agriculture insurance"]), ("district", "name", DISTRICT)],
    "flood_relief": [("date", "date", None), ("village_name", "text", rf"(?i)(?:village|gaon|gram|गांव|गाँव)\s+([a-zA-Zऀ-ॿ]{WS}{{1,25}})"), ("damage_type", "word", ["house", "ghar", "crop", "fasal", "livestock", "pashu", "road"]), ("district", "name", DISTRICT)],
    "wage_theft": [("employer_name", "name", rf"([a-zA-Z]{WS}{{1,30}})\s+(?:company|pvt|ltd|enterprises|malik)"), ("amount_owed", "match", AMOUNT), ("last_payment_date", "date", None)],
    "labour_complaint": [("date", "date", None), ("amount_claimed", "match", AMOUNT)],
}
OTHER = [("date", "date", None)]
#: Sections, authority, portal and documents by case type; the last one serves all other types.
CONTEXT = [
    ("fir_refusal", ["CrPC 154", "CrPC 156(3)", "IPC 166A"], "Judicial Magistrate First Class", "https://districts.ecourts.gov.in", ["Written complaint to Police Station", "Witness names and addresses", "Evidence of crime (photos/messages if available)", "Proof of identity (Aadhaar)"]),
    ("crop_insurance", ["PMFBY Guidelines 2016", "IRDAI Circular 2022"], "District Collector / Grievance Portal", "https://pmfby.gov.in", ["Bank passbook / Kisan Credit Card", "Land record (Khasra/Khatauni)", "Insurance policy number", "Crop loss evidence (photos with date)", "Rejection letter from insurance company"]),
    ("flood_relief", ["SDRF Guidelines 2015", "NDMA Guidelines"], "District Collector / DM Office", "https://ndma.gov.in", ["Aadhaar card", "Bank account details", "Proof of damage (photos)", "Revenue record / land document", "Tehsildar certificate of damage"]),
    ("wage_theft", ["Payment of Wages Act 1936", "Labour Code 2020", "IPC 403"], "Labour Commissioner Office", "https://shramsuvidha.gov.in", ["Employment contract / appointment letter", "Salary slips (if available)", "Bank statement showing last payment", "Proof of work (attendance, messages)"]),
    ("rti_request", ["Right to Information Act 2005 Section 6", "Section 7"], "Public Information Officer (PIO)", "https://rtionline.gov.in", ["Aadhaar / identity proof", "Rs 10 application fee (court fee stamp or IPO)"]),
    ("consumer_complaint", ["Consumer Protection Act 2019", "Section 35", "Section 47"], "District Consumer Disputes Redressal Commission", "https://edaakhil.nic.in", ["Purchase receipt / invoice", "Product / service details", "Evidence of defect or deficiency", "Legal notice sent to seller (if any)"]),
    ("land_dispute", ["Transfer of Property Act 1882", "Specific Relief Act 1963", "IPC 441"], "Civil Court / Revenue Court", "https://districts.ecourts.gov.in", ["Land records (Khasra, Khatauni, Jamabandi)", "Sale deed / title documents", "Proof of possession", "Survey map"]),
    ("domestic_violence", ["Protection of Women from Domestic Violence Act 2005", "IPC 498A", "IPC 406"], "Protection Officer / Magistrate", "https://wcd.nic.in", ["Domestic Incident Report (DIR)", "Medical certificates (if injured)", "Witnesses (neighbours, family)", "Evidence of abuse (photos, messages)"]),
    ("labour_complaint", ["Labour Code 2020", "Factories Act 1948", "Minimum Wages Act 1948"], "Labour Commissioner / Industrial Tribunal", "https://shramsuvidha.gov.in", ["Employment ID / appointment letter", "Pay slips", "Evidence of violation (messages, photos)", "Witness statements"]),
    ("unknown", ["Seek general legal advice"], "District Legal Services Authority (DLSA)", "https://nalsa.gov.in", ["Aadhaar / identity proof", "Written description of grievance"]),
]


def first_date(text: Column) -> Column:
    """The first date by pattern order (not by place), then one with a Hindi month; empty if there is none."""
    low = F.lower(text)
    tries = [F.regexp_extract(low, p, 0) for p in DATES] + [F.regexp_extract(text, rf"(\d{{1,2}})\s*{m}\s*(\d{{4}})", 0) for m in HINDI_MONTHS]
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in tries], F.lit(""))


def _entity(text: Column, kind: str, arg) -> Column:
    low = F.lower(text)
    if kind == "date":
        return first_date(text)
    if kind.startswith("word"):
        found = F.coalesce(*[F.when(F.contains(low, F.lit(w)), F.lit(w.title() if kind == "word name" else w)) for w in arg], F.lit(""))
        return found
    got = F.regexp_replace(F.regexp_extract(text if kind == "text" else low, arg, 0 if kind == "match" else 1), r"^\s+|\s+$", "")
    return F.initcap(got) if kind == "name" else got


def entities(text: Column, case_type: Column) -> Column:
    """map of the case type's fields to what the text says, empty where it says nothing."""
    made = lambda rules: F.map_from_arrays(F.array(*[F.lit(f) for f, _, _ in rules]), F.array(*[_entity(text, k, a) for _, k, a in rules]))
    out = None
    for name, rules in ENTITIES.items():
        out = F.when(case_type == name, made(rules)) if out is None else out.when(case_type == name, made(rules))
    return out.otherwise(made(OTHER))


def with_context(df: DataFrame) -> DataFrame:
    """df with sections, authority, portal and documents of its case_type: a table of ten rows, broadcast."""
    rows = df.sparkSession.createDataFrame(CONTEXT, "_type string, sections array<string>, authority string, portal string, documents array<string>")
    names = [c[0] for c in CONTEXT]
    out = df.withColumn("_type", F.when(F.col("case_type").isin(*names), F.col("case_type")).otherwise(names[-1]))
    return out.join(F.broadcast(rows), "_type").drop("_type")


def objections(document: Column, sections: Column) -> Column:
    """What a clerk would object to without reading on: blank fields, and a first section that isn't cited."""
    n = F.regexp_count(document, F.lit(r"\[.+? — Please Fill\]"))
    words = F.filter(F.split(F.trim(F.regexp_replace(F.get(sections, F.lit(0)), r"[^\p{L}\p{N}_\s]", "")), r"\s+"), lambda w: w != "")
    cited = F.exists(words, lambda w: (F.length(w) > 2) & F.contains(document, w))
    #: The texts of the two objections.
    blank = F.when(n > 0, F.concat(n.cast("string"), F.lit(" mandatory field(s) are blank and marked 'Please Fill' — application cannot be processed until these are completed")))
    missing = F.when((F.size(words) > 0) & ~cited, F.concat(F.lit("Applicable legal section '"), F.get(sections, F.lit(0)), F.lit("' does not appear to be cited in the document")))
    return F.filter(F.array(blank, missing), lambda x: x.isNotNull())


def merged(own: Column, others: Column, most: int = 4) -> Column:
    """A clerk's own objections (two at most), then others', each once in this order, and the first four of them."""
    return F.slice(F.array_distinct(F.concat(F.slice(own, 1, 2), F.coalesce(others, F.array().cast("array<string>")))), 1, most)


def slug(text: Column) -> Column:
    return F.substring(F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), r"[^a-zA-Z0-9\s]", "")), r"\s+", "_"), 1, 50)


def filings(df: DataFrame) -> DataFrame:
    """df (document, case_type, sections, authority, portal, documents) with title, gap fields, status, confidence, instructions."""
    fields = F.array_distinct(F.concat(F.transform(objections(F.col("document"), F.col("sections")), slug), gaps(F.col("document"))))
    out = df.withColumn("gap_fields", fields)
    n = F.size("gap_fields")
    label = F.initcap(F.replace("case_type", F.lit("_"), F.lit(" ")))
    return out.withColumns({
        "title": F.concat(F.coalesce(F.concat(F.get("sections", F.lit(0)), F.lit(" — ")), F.lit("")), label, F.lit(" Application")),
        "status": F.when(n > 0, "annotated").otherwise("hardened"), "confidence": F.when(n == 0, 0.9).otherwise(F.greatest(F.lit(0.4), F.round(0.9 - 0.1 * n, 6))),
        "instructions": F.concat(F.lit("File this document at: "), "authority", F.lit(". Portal / Office: "), "portal", F.lit(". Documents to attach: "), F.array_join("documents", ", "), F.lit(".")),
    })


def mediator_votes(rounds: DataFrame, key: str, *ties: str) -> DataFrame:
    """key, round, overall, approved, note: the latest round of each key; of equal ones the first by ties. The mean of three scores passes at 8, any round
    from the second on passes; what is unresolved then stands in a numbered note."""
    last = rounds.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("round"), *ties))).filter("r = 1")
    overall = (F.col("completeness") + F.col("legal") + F.col("procedure")) / 3.0
    out = last.withColumn("overall", F.round(overall, 6)).withColumn("approved", (overall >= 8.0) | (F.col("round") >= 2))
    note = F.array_join(F.transform("unresolved", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    return out.select(key, "round", "overall", F.col("approved").cast("string").alias("approved"), F.when(F.size("unresolved") == 0, "All blocking issues resolved.").when(F.col("approved"), note).otherwise("").alias("note"))
