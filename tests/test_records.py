"""Examples for the case-record operators, and every registered query against its SQL on small tables."""

import io
import re
import threading
import unicodedata
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from caseloom.functions.text import folded, name_uuid, spans
from caseloom.operators import answers, blocks, evidence, pages, search, triage
from caseloom.operators import filing as filing_ops
from caseloom.plans import complaints, filing, governance, records, registry, reports
from caseloom.plans import search as search_plans
from caseloom.sources import files
from caseloom.sources.parts import Parts
from caseloom.sources.views import require_one_case
from caseloom.streaming import events

SF = "/root/testdata/sf0.001"
LEGAL = "Petitioner: Ramesh Kumar\nRespondent: State of Bihar\n\nFIR No. 123 of 2024 was presented on 12/03/2024.\nThe complaint refers to Section 154 of the Code.\nThe disputed amount is Rs. 10,000.\nThe matter was mentioned before the Supreme Court of India."


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, int) and not isinstance(v, bool):
        return f"{float(v):.9g}"
    return str(v)


SQL = {name: sql for plan in entry.PLANS for name, sql in plan.SQL.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(map(plain, r)) for r in cur.fetchall())
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == want


def test_spans_are_exact(spark):
    texts = [LEGAL, "", "é 12/03/2024 ß 13-04-2020 x", "मामला 5 March 2021."]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for name, _, pattern, _ in evidence.RULES:
        for r in df.select("text", spans(F.col("text"), pattern).alias("s")).collect():
            assert [(x.start, x.end, x.quote) for x in r.s] == [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, r.text)], name


def test_legal_text(spark):
    df = spark.createDataFrame([("c", "v", 1, "petition", 0, "b", "ready", 1.0, LEGAL)], "case_id string, version_id string, document_order long, document_name string, sequence int, block_id string, status string, confidence double, text string")
    a = evidence.atoms(evidence.occurrences(df)).collect()
    assert {"person", "date", "money", "case_number", "legal_provision", "court"} <= {r.kind for r in a}
    assert {(r.label, r.normalized) for r in a if r.kind == "person"} == {("Petitioner", "ramesh kumar"), ("Respondent", "state of bihar")}
    assert all(LEGAL[s.start:s.end] == s.quote for r in a for s in r.spans)
    assert evidence.occurrences(df.withColumn("status", F.lit("ocr_required"))).count() == 0


def test_helpers(spark):
    import uuid

    one = spark.range(1)
    assert one.select(name_uuid(F.lit("c:caveat:x"))).first()[0] == str(uuid.uuid5(uuid.NAMESPACE_URL, "c:caveat:x"))
    assert one.select(folded(F.lit("STRAßE"))).first()[0] == "strasse"
    assert one.select(blocks.split_blocks(F.lit("A\nB.\nC\n\n D \n"))).first()[0] == ["A\nB.", "C", "D"]
    assert str(one.select(evidence.calendar_date(F.lit("3 march 2024"))).first()[0]) == "2024-03-03"
    assert one.select(evidence.calendar_date(F.lit("5 Sept 2024"))).first()[0] is None


def test_bm25_later_block_wins_ties(spark):
    b = spark.createDataFrame([("c", 1, 0, "alpha beta"), ("c", 2, 0, "alpha beta"), ("d", 3, 0, "alpha")], "case_id string, document_id long, sequence long, text string")
    q = spark.createDataFrame([(1, "c", "beta"), (2, "c", "zzz")], "query_id long, case_id string, query string")
    assert [(r.query_id, r.document_id) for r in search.bm25(b, q).orderBy("rank").collect()] == [(1, 2), (1, 1)]


def test_ocr_blocks_and_tables(spark):
    words = spark.createDataFrame([("v", 1, 1, 1, 1, 50, 0, 20, 10, 90.0, "world", 100, 100, 50, 50), ("v", 1, 1, 1, 1, 0, 0, 40, 10, 80.0, "hello", 100, 100, 50, 50), ("v", 1, 1, 1, 1, 90, 0, 5, 5, -1.0, "x", 100, 100, 50, 50)], "version_id string, page_number int, block_num int, par_num int, line_num int, left int, top int, width int, height int, conf double, text string, image_width int, image_height int, page_width int, page_height int")
    b = blocks.ocr_blocks(words)
    r = b.first()
    assert (r.text, r.confidence, r.x0, r.x1) == ("hello world", 0.85, 0.0, 35.0)
    t = spark.createDataFrame([("v", 1, 0.0, 0.0, 35.0, 5.0)], "version_id string, page_number int, x0 double, y0 double, x1 double, y1 double")
    assert blocks.outside_tables(b, t).count() == 0 and blocks.outside_tables(b, t.withColumn("x1", F.lit(10.0))).count() == 1
    rows = [("a", 1, "digital", 0.9, 1, False, []), ("b", 1, "none", 0.0, 0, False, ["x"]), ("b", 2, "none", 0.0, 0, True, ["y", "z"]), ("c", 1, "ocr", 0.9, 1, False, []), ("c", 2, "mixed", 0.9, 1, True, ["w"]), ("d", 1, "ocr", 0.62, 1, False, [])]
    p = spark.createDataFrame(rows, "version_id string, page_number int, method string, confidence double, block_count int, failed boolean, warnings array<string>")
    report = {r.version_id: r for r in pages.page_report(p).collect()}
    assert {k: r.status for k, r in report.items()} == {"a": "ready", "b": "ocr_required", "c": "partial", "d": "ready"}
    assert (report["b"].missing_pages, report["b"].warnings, report["c"].mixed_pages) == ("1,2", "Page 1: x|Page 2: y|Page 2: z", 1)
    assert {r.version_id: r.status for r in pages.page_report(p, pages.LOW_IMAGE).collect()}["d"] == "partial"


def test_text_quality(spark):
    """Normal text is good, noise is not; U+FFFD can be printed, but counts as replaced."""
    texts = ["In the High Court of Judicature at Patna, between the petitioner and the respondent State\nThe petitioner states that the impugned order was passed on 12 March 2024.\nIt is prayed that this court may set it aside.", "@@@@@ #### ????? \ufffd\ufffd\ufffd", "A\0  B\r\n\r\n C", "\u00a0ﬁ\u2003x\n\n\n\ny\x85", None, "a\u200bb\x07"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", pages.normalised(F.col("t")).alias("t")).select("i", "t", pages.quality(F.col("t")).alias("q"))
    got = {r.i: r for r in df.collect()}
    assert got[0].q.score >= 0.75 and got[1].q.score < 0.55 and got[2].t == "A B\n\nC" and got[3].t == "fi x\n\ny" and got[4].q.score == 0

    def brute(t):
        chars = [c for c in t if not c.isspace()]
        n = len(chars)
        if not n:
            return 0.0
        bad = sum(c == "\ufffd" or unicodedata.category(c) == "Cc" for c in chars) / n
        noise = min(0.55, bad * 2.5 + len(re.findall(r"[^\w\s]{5,}", t)) * 0.08)
        parts = 0.30 * min(n / 80, 1) + 0.25 * sum(c.isprintable() for c in chars) / n + 0.20 * min(sum(c.isalnum() for c in chars) / n / 0.45, 1) + 0.15 * min(len(re.findall(r"\w+", t)) / 12, 1)
        return max(0.0, min(1.0, round(parts + 0.10 * min(max(1, len([x for x in t.splitlines() if x.strip()])) / 5, 1) - noise, 4)))

    for r in got.values():
        assert r.q.score == pytest.approx(brute(r.t), abs=1e-4), r


def test_formats_and_uploads(spark):
    def zipped(*names):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in names:
                z.writestr(n, "x")
        return out.getvalue()

    pdf, mail = b"%PDF-1.7", b"From: a@b.c\nSubject: x\n\nhello"
    rows = [
        (pdf, "a.pdf", "application/pdf", "pdf", "pdf", None), (zipped("[Content_Types].xml", "word/document.xml"), "a.docx", "", "docx", "docx", None), (zipped("[Content_Types].xml", "xl/workbook.xml"), "a.xlsx", "", "spreadsheet", "xlsx", None),
        (zipped("readme"), "a.docx", "", "unknown", None, "ZIP upload is not a supported Office document."), (zipped("[Content_Types].xml"), "a.docx", "", "unknown", None, "ZIP upload is not a supported DOCX or XLSX file."),
        (b"PK\x03\x04junk", "a.docx", "", "invalid", None, "Office document container is corrupted."), (b"MZ", "a.exe", "", "unknown", None, "Executable or archive uploads are not allowed."), (b"", "a.txt", "", "text", None, "The uploaded file is empty."),
        (mail, "m.eml", "message/rfc822; x=1", "email", "email", None), (b"a,b\n1,2\n3,4\n", "t.csv", "text/csv", "csv", "csv", None), (b"{\\rtf1 x}", "t.rtf", "", "text", "rtf", None), (b"plain words", "t.md", "", "text", "text", None),
        (b"\x00\x01\x02", "t.bin", "", "unknown", None, "File signature is not a supported document type."), (pdf, "a.txt", "", "pdf", None, "File extension .txt does not match detected pdf content."), (pdf, "a.pdf", "text/plain", "pdf", None, "Declared MIME type does not match the uploaded file signature."),
        (b"\xff\xd8\xff", "noname", "image/png", "image", None, "Declared MIME type does not match the uploaded file signature."), (b"words", "x", "text/plain", "text", "text", None), (None, None, None, "unknown", None, "The uploaded file is empty."),
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, content binary, name string, declared string")
    for r in df.select("i", files.detected_format(F.col("content"), F.col("name"), F.col("declared")).alias("f"), files.validated(F.col("content"), F.coalesce("name", F.lit("")), F.col("declared")).alias("v")).collect():
        assert (r.f, r.v.kind, r.v.reason) == rows[r.i][3:], rows[r.i]


def test_one_case(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "case_id string, n int")
    assert require_one_case(df) is df and require_one_case(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="one case"):
        require_one_case(df.union(spark.createDataFrame([("b", 1)], df.schema)))


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é".encode("cp1252"))
    (tmp_path / "b.csv").write_bytes("﻿x,\" y  z\"\n,\n1\n".encode())
    (tmp_path / "c.eml").write_bytes(b"From: a@b.c\nSubject: Hi\n\nbody\n")
    (tmp_path / "d.bin").write_bytes(b"%PDF-1.7")
    df = files.load_originals(spark, f"file://{tmp_path}").withColumn("kind", files.detected_format(F.col("content"), F.col("path"))).withColumn("text", files.decoded("content"))
    got = {r.path[-5]: r for r in df.withColumn("table", files.table_text(files.csv_rows("text"))).withColumn("mail", files.email_parts("content")).collect()}
    assert {k: r.kind for k, r in got.items()} == {"a": "text", "b": "csv", "c": "email", "d": "pdf"}
    large = {r.path[-5]: r for r in files.load_originals(spark, f"file://{tmp_path}", 9).collect()}
    assert [(k, r.accepted, r.content is None, r.size > 9) for k, r in sorted(large.items())] == [("a", True, False, False), ("b", False, True, True), ("c", False, True, True), ("d", True, False, False)]
    assert got["a"].text == "é" and got["b"].table == "x | y z\n1" and got["c"].mail.header == "From: a@b.c\nTo: \nCc: \nDate: \nSubject: Hi" and got["c"].mail.body.strip() == "body"


def test_triage(spark):
    rows = [("Police ne nahi ki FIR", "fir_refusal"), ("Fasal bima claim reject ho gaya", "crop_insurance"), ("hello", "unknown")]
    got = {r.text: r for r in triage.classified(spark.createDataFrame(rows, "text string, want string")).collect()}
    assert all(got[t].case_type == w for t, w in rows) and got["hello"].confidence == 0.0


def test_report_checks(spark):
    e = spark.createDataFrame([("c", "e1"), ("c", "e2"), ("d", "e3")], "case_id string, evidence_id string")
    found = spark.createDataFrame([("c", "r1", "https://indiankanoon.org/doc/5/"), ("c", "r2", "https://indiankanoon.org/search/?q=5")], "case_id string, research_id string, source_url string")
    claims = spark.createDataFrame([("c", "k1", "fact", ["e1"], []), ("c", "k2", "fact", [], ["r1"]), ("c", "k3", "law", [], ["r1"]), ("c", "k4", "fact", ["e3"], []), ("c", "k5", "law", [], []), ("d", "k6", "fact", ["e3"], [])], "case_id string, claim_id string, kind string, evidence_ids array<string>, research_ids array<string>")
    citations = spark.createDataFrame([("c", "t1", "e1", None, None), ("c", "t2", None, "r1", "https://indiankanoon.org/doc/5/"), ("d", "t3", "e3", None, None)], "case_id string, citation_id string, evidence_id string, research_id string, source_url string")
    issues = reports.report_issues(e, claims, citations, found)
    assert {(r.code, r.entity_id) for r in issues.collect()} == {("research_source", "r2"), ("research_citation", "r2"), ("unsupported_claim", "k2"), ("unsupported_claim", "k5"), ("claim_evidence", "k4"), ("claim_citation", "k4")}
    caveats = spark.createDataFrame([], "case_id string, severity string")
    assert {(r.case_id, r.claims, r.citations, r.status) for r in reports.mediated(claims, citations, issues, caveats).collect()} == {("c", 2, 2, "needs_review"), ("d", 1, 1, "completed")}
    urls = {"https://indiankanoon.org/doc/1/": True, "https://www.indiankanoon.org/doc/12": True, "http://indiankanoon.org/doc/1/": False, "https://u@indiankanoon.org/doc/1/": False, "https://indiankanoon.org.evil.org/doc/1/": False, "https://indiankanoon.org/doc/x/": False}
    assert {r.u: r.ok for r in spark.createDataFrame([(u,) for u in urls], "u string").select("u", reports.allowed(F.col("u")).alias("ok")).collect()} == urls


def test_answers(spark):
    rows = [("The fact is known", 2, "The fact is known [1][2]", None), ("It is so.", 1, "It is so. [1]", "factual lines without citations"), ("Summary:\n- Paid [3]", 2, "Summary:\n- Paid [3]", "no valid source citations"), ("Inference: maybe", 1, "Inference: maybe", "no valid source citations"), ("One. Two [1].", 1, "One. Two [1].", "factual lines without citations"), ("", 0, "", "no valid source citations")]
    got = answers.checked(spark.createDataFrame([r[:2] for r in rows], "answer string, sources int")).collect()
    assert [(r.answer, r.sources, r.repaired, r.rejected) for r in got] == rows
    q = spark.createDataFrame([(1, "c", 'What says @"My Order.PDF" and @fir on it?'), (2, "c", "@zzz"), (3, "c", "plain")], "query_id long, case_id string, query string")
    d = spark.createDataFrame([("c", 7, "FIR copy.txt"), ("c", 8, "my order.pdf"), ("e", 9, "zzz.txt")], "case_id string, upload_id long, original_name string")
    assert {r.query_id: (r.question, r.targets, r.unmatched) for r in answers.scopes(q, d).collect()} == {1: ("What says and on it?", "8,7", ""), 2: ("@zzz", "", "zzz"), 3: ("plain", "", "")}


def test_filing(spark):
    df = spark.createDataFrame([("Thana Rampur police station refused on 12/03/2024 officer ram", "fir_refusal"), ("3 march 2024 aaj", "rti_request"), (None, "unknown")], "text string, case_type string")
    e = [r.e for r in df.select(filing_ops.entities(F.col("text"), F.col("case_type")).alias("e")).collect()]
    assert e[0]["station_name"] == "Thana Rampur Police" and e[0]["officer_name"] == "Ram" and e[0]["incident_date"] == "12/03/2024" and e[1] == {"date": "3 march 2024"} and e[2] == {"date": ""}
    r = filing_ops.filings(filing_ops.with_context(spark.createDataFrame([("[NAME — Please Fill] Under 154", "fir_refusal"), ("CrPC 154", "fir_refusal")], "document string, case_type string"))).collect()
    by = {x.document: x for x in r}
    assert by["CrPC 154"].status == "hardened" and by["CrPC 154"].confidence == 0.9
    assert by["[NAME — Please Fill] Under 154"].gap_fields[-1] == "NAME" and by["[NAME — Please Fill] Under 154"].confidence == 0.7


def test_streams(spark, tmp_path):
    src = f"{tmp_path}/in"
    rows = [(1, i, s, i * 10) for i, s in enumerate(["queued", "running", "running", "done"])] + [(1, 1, "running", 10), (2, 0, "queued", 0), (3, 0, "queued", 1000)]
    df = spark.createDataFrame(rows, "job_id long, sequence long, status string, at long").select("job_id", "sequence", "status", F.timestamp_seconds(F.col("at") + 1_700_000_000).alias("ts"))
    df.coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema(df.schema).parquet(src)

    def run(out, mode, name):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.awaitTermination(120)
        assert q.exception() is None
        return spark.table(name).collect()

    assert {r.job_id: r.status for r in run(events.latest_states(stream()), "update", "states")} == {1: "done", 2: "queued", 3: "queued"}
    assert {r.job_id for r in run(events.stale_jobs(stream()), "append", "stale")} == {1, 2}
    counts = run(events.rate_counts(stream().withColumnsRenamed({"job_id": "user_id", "status": "bucket"}), 60), "append", "rates")
    assert sum(r.n for r in counts) == 6
    up = df.select(F.lit("t").alias("tenant_id"), F.lit("c").alias("case_id"), F.col("job_id").cast("string").alias("sha256"), F.col("sequence").alias("upload_id"))
    manifest = Parts(spark, f"{tmp_path}/manifest")
    for n in (0, 1, 1, 0):
        events.append_new(manifest)(up, n)
    assert manifest.numbers() == [0, 1] and sorted((r.sha256, r.upload_id, r._part) for r in manifest.read("uploads", events.UPLOADS).collect()) == [("1", 0, 0), ("2", 0, 0), ("3", 0, 0)]
    assert threading.active_count() < 100


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_whole_passages_in_all_sources(spark, tmp_path):
    words = [f"w{i}" for i in range(40)]
    whole = "Start " + " ".join(words[:20]) + ", End."
    docs = [(1, "hot", "x (" + whole.upper() + ") y"), (2, "src7", "before " + " ".join(words[6:20]) + " after"), (3, None, whole.replace(" ", "\n", 3)), (3, "src1", "start w0 w1"), (None, "a", whole), (5, "a", None), (6, "b", "x " + " ".join(words[25:36])), (7, "b", "say short one!"), (8, "b", "shorter one")]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    asked = [(0, whole), (1, " ".join(words[25:40])), (2, "Short one"), (3, "nowhere to be found in any of the given texts"), (4, None)]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.item_id: tuple(r)[1:] for r in entry.queries()["qa1_passages"](spark, str(tmp_path)).collect()}
    assert got == {0: (3, 1, 15, 15, "true"), 1: (0, 1, 8, 4, "false"), 2: (1, 0, 1, 1, "true"), 3: (0, 0, 3, 0, "false"), 4: (0, 0, 0, 0, "false")}
    con, plain_words = duckdb.connect(), lambda t: " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "
    texts = [plain_words(t) for t, in con.execute(f"SELECT text FROM '{SF}/documents.parquet'").fetchall()]
    want = {i: sum(plain_words(t) in x for x in texts) for i, t in con.execute(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()}
    assert {r.item_id: r.n_documents for r in entry.queries()["qa1_passages"](spark, SF).collect()} == want and any(want.values())


def test_whole_questions_in_all_sources(spark, tmp_path):
    docs = [(1, "en", "hot", "one two three four tailword five six seven eight"), (2, "en", "src9", "nothing here but other words in a line of ten"), (3, "fr", "src9", "it ends in tailword and has some more words here"), (4, "en", "empty", "alpha beta gamma delta epsilon zeta eta theta")]
    spark.createDataFrame(docs, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "quite some unknown tailword"), (7, "one two three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    run = lambda name: entry.queries()[name](spark, str(tmp_path)).collect()
    want = {("0@hot", 1), ("0@src9", 3), ("7@hot", 1)}
    assert {(r.query_id, r.document_id) for r in run("sr3_bm25_all")} == want
    assert {(r.query_id, r.label) for r in run("sr6_citations_all")} == {(q, f"document {d}, page 1") for q, d in want}
    assert {r.query_id for r in run("sr11_summaries_all")} == {q for q, _ in want}
    missed = {f"{n}@{c}" for n in ("0", "7", "none") for c in ("hot", "src9", "empty")} - {q for q, _ in want}
    assert {r.query_id for r in run("sr9_fallback_all")} == missed
    scopes = run("sr7_scopes_all")
    assert len(scopes) == 6 and all(r.question.endswith("tailword" if r.query_id[0] == "0" else "three") for r in scopes)


def test_quota_across_batches(spark):
    rows = duckdb.sql(f"SELECT l_suppkey, strftime(l_shipdate, '%Y-%m'), l_orderkey, l_linenumber, CAST(round(l_extendedprice) AS BIGINT) FROM '{SF}/lineitem.parquet'").fetchall()
    used, want = {}, []
    for u, m, o, n, size in sorted(rows):
        ok = used.get((u, m), 0) + size <= 150_000
        used[u, m] = used.get((u, m), 0) + size * ok
        want.append((u, m, o, n, size, ok))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = entry.queries()["gv4_quota"](spark, SF)
        assert sorted(map(tuple, df.collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "InPandas" not in df._jdf.queryExecution().toString()  # no frame of a whole group
