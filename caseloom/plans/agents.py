"""Registered queries over agents' runs: role answers and traces, routes, provisions, job stages, histories and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions.text import stable_id
from caseloom.operators import answers, triage
from caseloom.plans import complaints, records, search
from caseloom.plans.pages import _PAGES, _pages
from caseloom.plans.registry import sanitised
from caseloom.sources.views import record_blocks, spread, stored, table

ROLES = ["judge", "lawyer", "authority", "analyst"]
#: Role answers; {s} is the summary, {p} the first citation and {a} all of them.
ANSWERS = {
    "judge": """Bench agent final answer:
The safe judicial reading is limited to the source cards retrieved from the uploaded record: {s}.

Issues for clarification:
1. Which facts are admitted and which are disputed should be separated before relying on the record {a}.
2. Any conclusion not tied to a page, annexure, or order-sheet entry should be treated as needing review {p}.
3. Ask the parties to identify the missing document or authority if the retrieved sources do not contain the full dispute narrative {a}.""",
    "lawyer": """Counsel agent final answer:
The record currently supports only these evidence-grounded points: {s}.

Argument plan:
1. Lead with the strongest verified source span, not a general conclusion {p}.
2. Treat missing dates, authorisation, receipts, annexures, signatures, or order sheets as proof gaps until supplied {a}.
3. Prepare a short explanation of why each uploaded document is relevant to the relief being sought {a}.""",
    "authority": """Authority agent final answer:
The record supports administrative review only to the extent shown in these source cards: {s}.
Check jurisdiction, filing completeness, statutory duty, and whether a missing receipt/order reference blocks action {a}.""",
    "asks": """Citizen agent final answer:
Ask your lawyer to explain how the uploaded documents are relevant, because the retrieved record shows: {s}.

Questions to ask your lawyer:
1. What legal purpose does this document serve in my case file {p}?
2. Is the uploaded document enough, or do we still need an annexure, receipt, authorisation, signature, order sheet, or full page copy {a}?
3. Which part of this source card supports my next filing or response {p}?
4. If this document is only company or approval paperwork, what extra fact document connects it to my real legal problem {a}?""",
    "analyst": """Citizen agent final answer:
Based only on the uploaded record, the document shows: {s}.

What this means:
1. Keep this document as a source card, but do not treat it as the full case story unless the missing supporting papers are also uploaded {a}.
2. Ask for the related receipt, order sheet, annexure, authorisation, or filing proof before taking the next legal step {p}.""",
}
NO_SOURCE = "no reliable source block"
#: Caveats in order, next actions, and the agents of a trace.
CAVEATS = ["The answer is restricted to retrieved source cards from the uploaded record.", "Unsupported legal conclusions are intentionally not filled in.", "The question did not directly match a source block, so the agents used broad record inspection.", "Only one usable source card was retrieved, so reviewer confidence is limited."]
ACTIONS = {
    "none": ["Upload the relevant page or missing annexure.", "Ask again after the source record is available.", "Do not rely on unsupported conclusions."],
    "judge": ["Check source cards before reading the conclusion.", "List disputed facts separately from admitted facts.", "Ask parties for missing annexures or order-sheet entries."],
    "lawyer": ["Map every argument to a cited page span.", "Collect missing receipts, signatures, annexures, or authority papers.", "Draft the final answer around verified facts first."],
    "other": ["Ask what each uploaded document proves.", "Ask which document is still missing before filing or replying.", "Keep copies of every cited page and do not treat this as legal advice."],
}
FINAL = {"judge": "Judge final agent", "authority": "Authority final agent", "lawyer": "Lawyer final agent", "analyst": "Citizen final agent"}
#: Authorities and e-mail addresses of routes, fallback provisions, and job stages of analysis states.
ROUTES = [
    ("fir_not_registered", "Judicial Magistrate First Class (JMFC) Office", "magistrate.office@delhicourts.gov.in"), ("domestic_violence", "District Protection Officer / Family Court", "protection.officer@wcd.gov.in"),
    ("land_dispute", "Sub-Divisional Magistrate (SDM) / Tehsildar", "sdm.revenue@delhi.gov.in"), ("consumer_complaint", "District Consumer Disputes Redressal Commission", "district.commission@consumer.gov.in"),
    ("cyber_fraud", "National Cyber Crime Reporting Portal Nodal Officer", "nodal.officer@cybercrime.gov.in"), ("crop_insurance_rejected", "District Agriculture Officer (DAO)", "dao.agriculture@state.gov.in"),
    ("disaster_relief_denied", "District Disaster Management Authority (DDMA)", "ddma.relief@state.gov.in"), ("other", "District Court Registry", "registry@districtcourts.gov.in"),
]
PROVISIONS = [
    ("fir_not_registered", "Section 156(3) CrPC", "Lalita Kumari vs Govt. of U.P."), ("domestic_violence", "Section 12 PWDVA, 2005", "Section 498A IPC"), ("land_dispute", "Section 144 CrPC", "Section 145 CrPC"),
    ("consumer_complaint", "Section 35, Consumer Protection Act, 2019", "Section 38, Consumer Protection Act, 2019"), ("cyber_fraud", "Section 66D, IT Act, 2000", "Section 420 IPC"),
    ("crop_insurance_rejected", "Pradhan Mantri Fasal Bima Yojana (PMFBY) Guidelines", "Consumer Protection Act, 2019"), ("disaster_relief_denied", "State Disaster Response Fund (SDRF) Norms", "Disaster Management Act, 2005"), ("other", "Article 226, Constitution of India", "Section 154 CrPC"),
]
STAGES = {"extracting": "extracting", "retrieving": "researching", "relating": "synthesizing", "synthesizing": "synthesizing", "critiquing": "verifying", "verifying": "verifying"}
STATES = [*STAGES, "completed", "failed"]
#: The gates of an evaluation.
GATES = {"parse_success_rate": 0.90, "expected_fragment_recall": 0.80, "structured_table_recall": 0.90, "page_diagnostic_coverage": 0.95}


#: How a question asks what to ask a lawyer.
ASKS_LAWYER = r"(?i)\b(ask|question|questions)\b.*\blawyer\b|\blawyer\b.*\b(ask|question|questions)\b"


def asks_lawyer(query: Column) -> Column:
    return query.rlike(ASKS_LAWYER)


def role_answer(role: Column, query: Column, summary: Column, sources: Column) -> Column:
    """The answer of a role's agent from its summary and number of sources."""
    marks = F.array_join(F.transform(F.filter(F.sequence(F.lit(0), sources), lambda i: i > 0), lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("]"))), "")
    kind = F.when((role == "analyst") & asks_lawyer(query), "asks").otherwise(role)
    text = F.element_at(F.create_map(*[F.lit(x) for kv in ANSWERS.items() for x in kv]), kind)
    for name, value in (("{a}", marks), ("{p}", F.when(sources > 0, "[1]").otherwise("")), ("{s}", F.when(sources > 0, summary).otherwise(NO_SOURCE))):
        text = F.replace(text, F.lit(name), value)
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def caveats(sources: Column, missed: Column) -> Column:
    """What an answer's reader must know."""
    return F.filter(F.array(F.lit(CAVEATS[0]), F.lit(CAVEATS[1]), F.when(missed, CAVEATS[2]), F.when(sources < 2, CAVEATS[3])), lambda c: c.isNotNull())


def actions(role: Column, sources: Column) -> Column:
    """Three next steps."""
    listed = {k: F.array(*map(F.lit, v)) for k, v in ACTIONS.items()}
    return F.when(sources == 0, listed["none"]).when(role == "judge", listed["judge"]).when(role == "lawyer", listed["lawyer"]).otherwise(listed["other"])


def trace(role: Column, sources: Column, review: Column) -> Column:
    """Five steps: agent, status, summary."""
    step = lambda agent, status, told: F.struct(agent.alias("agent"), status.alias("status"), told.alias("summary"))
    done = lambda bad: F.when(bad, "needs_review").otherwise("complete")
    final = F.element_at(F.create_map(*[F.lit(x) for kv in FINAL.items() for x in kv]), role)
    #: The agents' names and summaries.
    return F.array(
        step(F.lit("Query router"), F.lit("complete"), F.concat(F.lit("Routed the question to the "), role, F.lit(" answer lens."))),
        step(F.lit("Extractor agent"), done(sources == 0), F.concat(F.lit("Selected "), sources.cast("string"), F.lit(" usable source card(s) from the uploaded record."))),
        step(F.lit("Synthesis agent"), done(sources == 0), F.lit("Converted retrieved source spans into a structured answer instead of raw snippets.")),
        step(F.lit("Reviewer agent"), done(review), F.lit("Checked that unsupported facts stay as caveats or next actions.")),
        step(final, done(review), F.lit("Prepared the role-specific final response.")),
    )


def _asked(spark, sf_dir) -> DataFrame:
    """Questions with a role, summary and number of sources; every third one asks for a lawyer's questions."""
    q, hits = search._hits(spark, sf_dir)
    s = answers.summaries(hits)
    said = F.when(F.col("query_id") % 3 == 1, F.concat(F.lit("Which questions for my lawyer: "), "query")).otherwise(F.col("query"))
    role = F.element_at(F.array(*map(F.lit, ROLES)), (F.col("query_id") % 4 + 1).cast("int"))
    out = q.select("query_id", said.alias("query"), role.alias("role")).join(s, "query_id", "left")
    return out.withColumn("sources", F.coalesce(F.regexp_count("summary", F.lit(r" \[\d\](?:;|$)")), F.lit(0)))


def sr11_roles(spark, sf_dir):
    """Each question's answer in its role."""
    a = _asked(spark, sf_dir)
    return a.select("query_id", "role", "sources", role_answer(F.col("role"), F.col("query"), F.col("summary"), F.col("sources")).alias("answer"))


def sr12_traces(spark, sf_dir):
    """Each answer's caveats, next actions and trace."""
    a, n = _asked(spark, sf_dir), F.col("sources")
    steps = F.array_join(F.transform(trace(F.col("role"), n, n < 2), lambda s: F.concat_ws(" / ", s["agent"], s["status"], s["summary"])), "\n")
    return a.select("query_id", F.array_join(caveats(n, n == 0), "\n").alias("caveats"), F.array_join(actions(F.col("role"), n), "\n").alias("actions"), steps.alias("trace"))


def _typed(spark, sf_dir) -> DataFrame:
    """Complaints with a type: those of the routes by number, one that no route knows, and the classified one."""
    known = F.array(*[F.lit(r[0]) for r in ROUTES], F.lit("wage_theft"))
    c = triage.classified(complaints.complaints(spark, sf_dir))
    n = F.col("complaint_id") % (len(ROUTES) + 2)
    return c.select("complaint_id", F.when(n <= len(ROUTES), F.element_at(known, (n + 1).cast("int"))).otherwise(F.col("case_type")).alias("case_type"))


def looked_up(rows: DataFrame, known: list[tuple], names: list[str], key: str = "case_type") -> DataFrame:
    """rows with the values of a fixed table, those of `other` where the key isn't in it."""
    spark = rows.sparkSession
    fixed = F.broadcast(spark.createDataFrame([r for r in known], ", ".join(f"{n} string" for n in [key, *names])))
    other = next(r for r in known if r[0] == "other")
    out = rows.join(fixed, key, "left")
    return out.withColumns({n: F.coalesce(n, F.lit(v)) for n, v in zip(names, other[1:])})


def tr9_routes(spark, sf_dir):
    return looked_up(_typed(spark, sf_dir), ROUTES, ["authority", "email"])


def rs4_provisions(spark, sf_dir):
    return looked_up(_typed(spark, sf_dir), PROVISIONS, ["first_title", "second_title"])


def jb8_stages(spark, sf_dir):
    """The job's stage of each event's analysis state; null for states that move no job."""
    state = F.element_at(F.array(*map(F.lit, STATES)), (F.col("event_id") % len(STATES) + 1).cast("int"))
    e = table(spark, sf_dir, "events").select("event_id", state.alias("state"))
    return e.withColumn("stage", F.try_element_at(F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv]), F.col("state")))


def an5_runs(spark, sf_dir):
    """The agents' runs of each case in time order: position, agent, round, and how many came before by the same agent."""
    l = table(spark, sf_dir, "lineitem")
    agent = F.element_at(F.array(*[F.lit(a) for a in ("intake", "advocate", "bureaucrat", "filing")]), (F.col("l_partkey") % 4 + 1).cast("int"))
    r = l.select(F.col("l_orderkey").alias("case_id"), "l_shipdate", F.col("l_linenumber").cast("long").alias("run"), F.col("l_partkey").alias("p"), agent.alias("agent_name"))
    order = [F.col("l_shipdate"), F.col("run"), F.col("p")]
    return r.select("case_id", F.row_number().over(Window.partitionBy("case_id").orderBy(*order)).cast("long").alias("position"), "agent_name", "run", F.row_number().over(Window.partitionBy("case_id", "agent_name").orderBy(*order)).cast("long").alias("round_number"))


def rpt13_history(spark, sf_dir):
    """Each customer's orders as reports: newest version first, with its id and whether it is the latest."""
    up = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    down = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("case_id"), F.row_number().over(up).cast("long").alias("version"), F.row_number().over(down).cast("long").alias("position"))
    return o.select("case_id", "position", "version", stable_id("report_", "case_id", F.col("version").cast("string")).alias("report_id"), (F.col("position") == 1).cast("string").alias("latest"))


def rpt14_trace(spark, sf_dir):
    """One row an agent's step of each case's run: what went in, and how many of what came out, with their hash."""
    atoms = records.stored_atoms(spark, sf_dir, *records.PLAIN, records.PLACES)
    ids = lambda df, key: df.groupBy("case_id").agg(F.array_sort(F.collect_list(key)).alias("out"))
    steps = [
        ("Extractor", record_blocks(spark, sf_dir).select("case_id", F.col("version_id").alias("i")).distinct(), ids(atoms, "evidence_id")),
        ("Relationship mapper", atoms.select("case_id", F.col("evidence_id").alias("i")), ids(records.ev.edges(atoms), "relationship_id")),
        ("Synthesizer", atoms.select("case_id", F.col("evidence_id").alias("i")), ids(records.claims(atoms), "claim_id")),
    ]
    whole = None
    for n, (agent, fed, made) in enumerate(steps, 1):
        step = fed.groupBy("case_id").agg(F.count("*").alias("inputs")).join(made, "case_id", "left")
        step = step.select("case_id", F.lit(n).cast("long").alias("sequence"), F.lit(agent).alias("agent"), "inputs", F.coalesce(F.size("out"), F.lit(0)).cast("long").alias("outputs"), F.md5(F.array_join(F.coalesce("out", F.array().cast("array<string>")), ",")).alias("output_md5"))
        whole = step if whole is None else whole.unionByName(step)
    return whole.withColumn("outputs", F.greatest("outputs", F.lit(0)))


def gv2_lists(spark, sf_dir):
    """Audit metadata with a list of 25 addresses: 20 are kept, redacted and cut."""
    n = F.col("event_id").cast("string")
    listed = F.transform(F.sequence(F.lit(1), F.lit(25)), lambda i: F.concat(F.repeat(F.lit("y"), (F.col("event_id") % 130).cast("int")), F.lit(" u"), i.cast("string"), F.lit("."), n, F.lit("@example.com")))
    entries = F.array(F.struct(F.lit("peers").alias("key"), F.lit("list").alias("kind"), F.lit(None).cast("string").alias("value"), listed.alias("items")))
    m = table(spark, sf_dir, "events").select("event_id", sanitised(entries)[0]["items"].alias("items"))
    return m.select("event_id", F.size("items").cast("long").alias("n"), F.array_join("items", ";").alias("items"))


def gv5_outcomes(spark, sf_dir):
    """The audit trail by case (the day) and actor, and how often each outcome of a type occurs in a case."""
    outcome = F.when(F.col("event_type") == "error", "denied").otherwise("allowed")
    e = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("case_id"), "event_type", outcome.alias("outcome"), "ts", "event_id")
    g = e.groupBy("case_id", "event_type", "outcome").agg(F.count("*").alias("n"), F.max(F.struct("ts", "event_id")).alias("x"))
    return g.select("case_id", "event_type", "outcome", "n", F.col("x.event_id").alias("newest"))


def _evaluated(spark, sf_dir) -> DataFrame:
    """By language: documents, those parsed, fragments (lines) sought and found, tables, pages and pages with diagnostics."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")))
    n = F.col("doc_id")
    parsed = d.select("lang", n, F.when(n % 12 == 0, "ocr_required").when(n % 5 == 0, "partial").otherwise("ready").alias("status"), F.size(F.split("text", "\n")).alias("fragments"), F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("hits"), (n % 3 == 0).alias("expects"), ((n % 3 == 0) & (n % 33 > 0)).alias("table"))
    pages = _pages(spark, sf_dir).select(F.col("version_id").alias("doc_id"), (F.col("method") != "none").alias("told")).groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if("told").alias("told"))
    return parsed.join(pages, "doc_id").groupBy("lang").agg(
        F.count("*").alias("documents"), F.count_if(F.col("status").isin("ready", "partial")).alias("successful"), F.sum("fragments").alias("fragments"), F.sum("hits").alias("hits"),
        F.count_if("expects").alias("tables"), F.count_if("table").alias("found_tables"), F.sum("pages").alias("pages"), F.sum("told").alias("told"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("ready", "partial", "ocr_required")],
    )


def rates(e: DataFrame) -> DataFrame:
    """The four rates of an evaluation, rounded to four digits, and the gates that they fail."""
    rate = lambda a, b: F.round(F.col(a) / F.greatest(F.lit(1), F.col(b)), 4)
    out = e.withColumns({"parse_success_rate": rate("successful", "documents"), "expected_fragment_recall": rate("hits", "fragments"), "structured_table_recall": rate("found_tables", "tables"), "page_diagnostic_coverage": rate("told", "pages")})
    return out.withColumn("failures", F.concat_ws(",", *[F.when(F.col(g) < least, g) for g, least in GATES.items()]))


def qa3_gates(spark, sf_dir):
    return rates(_evaluated(spark, sf_dir)).select("lang", "documents", "ready", "partial", "ocr_required", *GATES, "failures")


def checked_sums(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """name, status: files against a manifest of hashes (name, sha256): ok, changed, missing or unlisted."""
    met = files.select("name", F.col("sha256").alias("own")).join(manifest.select("name", "sha256"), "name", "full")
    return met.select("name", F.when(F.col("own").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.col("own") == F.col("sha256"), "ok").otherwise("changed").alias("status"))


def qa4_checksums(spark, sf_dir):
    """Documents against the manifest of their source's first copies: some rows were changed, taken out or added."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    name, text = F.concat(F.lit("file-"), n.cast("string")), F.coalesce("text", F.lit(""))
    files = d.filter(n % 10 != 4).select(name.alias("name"), F.sha2(text, 256).alias("sha256"))
    manifest = d.filter(n % 10 != 5).select(name.alias("name"), F.sha2(F.when(n % 10 == 3, F.concat(text, F.lit("x"))).otherwise(text), 256).alias("sha256"))
    return checked_sums(files, manifest)


def tr7_languages(spark, sf_dir):
    """The language of complaints from their letters, where English is declared; else the declared one."""
    c = complaints.complaints(spark, sf_dir).select("complaint_id", "text", F.when(F.col("complaint_id") % 4 == 0, "ta").otherwise("en").alias("declared"))
    n = F.regexp_count("text", F.lit(r"[ऀ-ॿ]"))
    return c.select("complaint_id", "declared", F.when(F.col("declared") != "en", F.col("declared")).when(n > 5, "hi").when(n > 0, "hinglish").otherwise("en").alias("language"))


def tr2_turns(spark, sf_dir):
    """What users say in conversations, judged as complaints."""
    c = spread(table(spark, sf_dir, "conversations").filter("role = 'user'"))
    c = triage.classified(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("complaint_id"), F.coalesce("text", F.lit("")).alias("text")))
    return c.select("complaint_id", F.length(triage.translated(F.col("text"))).cast("long").alias("characters"), "case_type", F.col("score").cast("long").alias("score"), "confidence", "authority", "section", "language")


QUERIES = {f.__name__: f for f in (tr2_turns, sr11_roles, sr12_traces, tr9_routes, rs4_provisions, jb8_stages, an5_runs, rpt13_history, rpt14_trace, gv2_lists, gv5_outcomes, qa3_gates, qa4_checksums, tr7_languages)}


def _sql() -> dict[str, str]:
    q = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    table_of = lambda rows, names: "(VALUES " + ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows) + ") AS k(" + ", ".join(names) + ")"
    other = lambda rows: next(r for r in rows if r[0] == "other")
    asked = "WITH s AS (" + search.SQL["sr11_summaries"] + """),
q AS (SELECT item_id AS query_id, CASE WHEN item_id % 3 = 1 THEN 'Which questions for my lawyer' ELSE text END AS query, ['judge','lawyer','authority','analyst'][item_id % 4 + 1] AS role FROM benchmark),
a AS (SELECT query_id, q.query, role, summary, coalesce(len(regexp_extract_all(summary, ' \\[\\d\\](;|$)')), 0) AS sources FROM q LEFT JOIN s USING (query_id)),
m AS (SELECT *, CASE sources WHEN 0 THEN '' WHEN 1 THEN '[1]' WHEN 2 THEN '[1][2]' ELSE '[1][2][3]' END AS marks, CASE WHEN sources > 0 THEN '[1]' ELSE '' END AS first_mark FROM a)
"""
    made = "replace(replace(replace(CASE WHEN role = 'analyst' AND query = 'Which questions for my lawyer' THEN " + q(ANSWERS["asks"]) + " ELSE CASE role " + " ".join(f"WHEN '{r}' THEN {q(ANSWERS[r])}" for r in ROLES) + " END END, '{a}', marks), '{p}', first_mark), '{s}', CASE WHEN sources > 0 THEN summary ELSE 'no reliable source block' END)"
    step = lambda agent, status, told: f"{agent} || ' / ' || {status} || ' / ' || {told}"
    seen, kept = "CASE WHEN sources = 0 THEN 'needs_review' ELSE 'complete' END", "CASE WHEN sources < 2 THEN 'needs_review' ELSE 'complete' END"
    steps = " || chr(10) || ".join([
        step("'Query router'", "'complete'", "'Routed the question to the ' || role || ' answer lens.'"), step("'Extractor agent'", seen, "'Selected ' || sources || ' usable source card(s) from the uploaded record.'"),
        step("'Synthesis agent'", seen, q("Converted retrieved source spans into a structured answer instead of raw snippets.")), step("'Reviewer agent'", kept, q("Checked that unsupported facts stay as caveats or next actions.")),
        step("CASE role " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FINAL.items()) + " END", kept, q("Prepared the role-specific final response.")),
    ])
    classified = complaints.SQL["tr2_classified"]
    typed = "WITH c0 AS (" + classified + "), c AS (SELECT complaint_id, CASE WHEN complaint_id % 10 <= 8 THEN [" + ", ".join(q(r[0]) for r in ROUTES) + ", 'wage_theft'][complaint_id % 10 + 1] ELSE case_type END AS case_type FROM c0) "
    lookup = lambda rows, names: typed + "SELECT complaint_id, c.case_type, " + ", ".join(f"coalesce(k.{n}, {q(v)}) AS {n}" for n, v in zip(names, other(rows)[1:])) + " FROM c LEFT JOIN " + table_of(rows, ["case_type", *names]) + " USING (case_type)"
    gates = ", ".join(f"CASE WHEN {g} < {v}::DOUBLE THEN '{g}' END" for g, v in GATES.items())
    turns = classified[classified.index("c1 AS"):]
    return {
        "tr2_turns": "WITH c0 AS (SELECT conv_id * 1000 + turn AS complaint_id, coalesce(text, '') AS text, '' AS name, '' AS day FROM conversations WHERE role = 'user'),\n" + turns[:turns.rindex("SELECT complaint_id, normal")] + "SELECT complaint_id, length(normal) AS characters, case_type, score, confidence, authority, section, language FROM c",
        "sr11_roles": asked + f"SELECT query_id, role, CAST(sources AS INTEGER) AS sources, trim({made}) AS answer FROM m",
        "sr12_traces": asked + "SELECT query_id, concat_ws(chr(10), " + q(CAVEATS[0]) + ", " + q(CAVEATS[1]) + ", CASE WHEN sources = 0 THEN " + q(CAVEATS[2]) + " END, CASE WHEN sources < 2 THEN " + q(CAVEATS[3]) + " END) AS caveats, CASE WHEN sources = 0 THEN " + q("\n".join(ACTIONS["none"])) + " WHEN role = 'judge' THEN " + q("\n".join(ACTIONS["judge"])) + " WHEN role = 'lawyer' THEN " + q("\n".join(ACTIONS["lawyer"])) + " ELSE " + q("\n".join(ACTIONS["other"])) + f" END AS actions, {steps} AS trace FROM m",
        "tr9_routes": lookup(ROUTES, ["authority", "email"]),
        "rs4_provisions": lookup(PROVISIONS, ["first_title", "second_title"]),
        "jb8_stages": "SELECT event_id, state, CASE state " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STAGES.items()) + " END AS stage FROM (SELECT event_id, [" + ", ".join(map(q, STATES)) + f"][event_id % {len(STATES)} + 1] AS state FROM events)",
        "an5_runs": "SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY l_shipdate, run, p) AS position, agent_name, run, row_number() OVER (PARTITION BY case_id, agent_name ORDER BY l_shipdate, run, p) AS round_number FROM (SELECT l_orderkey AS case_id, l_shipdate, CAST(l_linenumber AS BIGINT) AS run, l_partkey AS p, ['intake','advocate','bureaucrat','filing'][l_partkey % 4 + 1] AS agent_name FROM lineitem)",
        "rpt13_history": "SELECT case_id, position, version, 'report_' || substr(sha256(case_id || ':' || version), 1, 24) AS report_id, CASE WHEN position = 1 THEN 'true' ELSE 'false' END AS latest FROM (SELECT CAST(o_custkey AS VARCHAR) AS case_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS position FROM orders)",
        "rpt14_trace": records._EDGES + records._CLAIMS[len(records._ATOMS):] + """,
steps AS (
  SELECT case_id, 1 AS sequence, 'Extractor' AS agent, count(DISTINCT version_id) AS inputs, (SELECT list(evidence_id ORDER BY evidence_id) FROM atoms a WHERE a.case_id = b.case_id) AS o FROM blocks b GROUP BY case_id
  UNION ALL SELECT case_id, 2, 'Relationship mapper', count(*), (SELECT list(relationship_id ORDER BY relationship_id) FROM edges e WHERE e.case_id = a.case_id) FROM atoms a GROUP BY case_id
  UNION ALL SELECT case_id, 3, 'Synthesizer', count(*), (SELECT list(claim_id ORDER BY claim_id) FROM claims c WHERE c.case_id = a.case_id) FROM atoms a GROUP BY case_id)
SELECT case_id, sequence, agent, inputs, CAST(coalesce(len(o), 0) AS BIGINT) AS outputs, md5(coalesce(array_to_string(o, ','), '')) AS output_md5 FROM steps""",
        "gv2_lists": r"""SELECT event_id, 20 AS n, string_agg(substr(regexp_replace(repeat('y', CAST(event_id % 130 AS INTEGER)) || ' u' || i || '.' || event_id || '@example.com', '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[REDACTED-EMAIL]'), 1, 120), ';' ORDER BY i) AS items FROM events, range(1, 21) r(i) GROUP BY event_id""",
        "gv5_outcomes": "SELECT strftime(ts, '%Y-%m-%d') AS case_id, event_type, CASE WHEN event_type = 'error' THEN 'denied' ELSE 'allowed' END AS outcome, count(*) AS n, last(event_id ORDER BY ts, event_id) AS newest FROM events GROUP BY ALL",
        "qa3_gates": _PAGES + f""",
pg AS (SELECT version_id AS doc_id, count(*) AS pages, count(*) FILTER (WHERE method <> 'none') AS told FROM p GROUP BY ALL),
d AS (SELECT doc_id, coalesce(lang, '') AS lang, CASE WHEN doc_id % 12 = 0 THEN 'ocr_required' WHEN doc_id % 5 = 0 THEN 'partial' ELSE 'ready' END AS status, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT lang, count(*) AS documents, count(*) FILTER (WHERE status = 'ready') AS ready, count(*) FILTER (WHERE status = 'partial') AS partial, count(*) FILTER (WHERE status = 'ocr_required') AS ocr_required,
  round(count(*) FILTER (WHERE status <> 'ocr_required') / count(*)::DOUBLE, 4) AS parse_success_rate, round(sum(len(list_filter(l, lambda x: trim(x, ' ') <> '')))::DOUBLE / sum(len(l)), 4) AS expected_fragment_recall,
  round(count(*) FILTER (WHERE doc_id % 3 = 0 AND doc_id % 33 > 0)::DOUBLE / greatest(1, count(*) FILTER (WHERE doc_id % 3 = 0)), 4) AS structured_table_recall, round(sum(told)::DOUBLE / sum(pages), 4) AS page_diagnostic_coverage FROM d JOIN pg USING (doc_id) GROUP BY lang)
SELECT *, concat_ws(',', {gates}) AS failures FROM e""",
        "qa4_checksums": """WITH f AS (SELECT 'file-' || doc_id AS name, sha256(coalesce(text, '')) AS own FROM documents WHERE doc_id % 10 <> 4), m AS (SELECT 'file-' || doc_id AS name, sha256(coalesce(text, '') || CASE WHEN doc_id % 10 = 3 THEN 'x' ELSE '' END) AS want FROM documents WHERE doc_id % 10 <> 5)
SELECT name, CASE WHEN own IS NULL THEN 'missing' WHEN want IS NULL THEN 'unlisted' WHEN own = want THEN 'ok' ELSE 'changed' END AS status FROM f FULL JOIN m USING (name)""",
        "tr7_languages": "WITH c0 AS (" + classified + ") SELECT complaint_id, declared, CASE WHEN declared <> 'en' THEN declared ELSE language END AS language FROM (SELECT complaint_id, language, CASE WHEN complaint_id % 4 = 0 THEN 'ta' ELSE 'en' END AS declared FROM c0)",
    }


SQL = _sql()
