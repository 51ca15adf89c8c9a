"""Registered queries over the pages and blocks of documents, nested documents, artifacts and upload checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.operators import pages as ops
from caseloom.operators.blocks import split_blocks
from caseloom.sources.files import email_blocks, validated
from caseloom.sources.views import spread, stored, table

LINES_A_PAGE = 3


def _texts(spark, sf_dir) -> DataFrame:
    """The documents' texts with tabs, other line ends and more blank lines than one, by row."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    n = F.col("doc_id") % 4
    text = F.when(n == 0, F.replace("text", F.lit(" "), F.lit("\t "))).when(n == 1, F.replace("text", F.lit("\n"), F.lit("\r\n"))).when(n == 2, F.concat(F.lit("\n \n"), F.replace("text", F.lit("\n"), F.lit(" \r\n\t\n\n")), F.lit("\0\n"))).otherwise(F.col("text"))
    return d.select("doc_id", text.alias("text"))


def blk1_normalised(spark, sf_dir):
    """Length and hash of each normalised text."""
    d = _texts(spark, sf_dir).select("doc_id", ops.normalised(F.col("text")).alias("t"))
    return d.select("doc_id", F.length("t").cast("long").alias("characters"), F.sha2("t", 256).alias("sha256"))


def blk6_quality(spark, sf_dir):
    """Text quality of each document: the score, its ratios, and whether it needs OCR."""
    d = _texts(spark, sf_dir).select("doc_id", ops.normalised(F.col("text")).alias("t")).select("doc_id", ops.quality(F.col("t")).alias("q")).select("doc_id", "q.*")
    return d.withColumn("needs_ocr", ((F.col("score") < 0.55) | (F.col("characters") < 24)).cast("string"))


def src3_documents(spark, sf_dir):
    """Each text file as one page of blocks; without blocks it is partial."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 0, F.lit(" \n\n ")).otherwise(F.col("text")).alias("text")))
    b = d.select("doc_id", split_blocks(F.coalesce("text", F.lit(""))).alias("b"))
    return b.select("doc_id", F.lit(1).alias("page_number"), F.size("b").cast("long").alias("n_blocks"), F.coalesce(F.length(F.element_at(F.when(F.size("b") > 0, F.col("b")), -1)), F.lit(0)).cast("long").alias("last_characters"), F.when(F.size("b") > 0, "ready").otherwise("partial").alias("status"))


def _blocks(spark, sf_dir) -> DataFrame:
    """Lines as blocks of pages of three; every second line's number is the one before, so that pages must be renumbered."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lines = d.select(F.col("doc_id").alias("version_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "text"))
    return lines.select("version_id", (F.floor(F.col("i") / LINES_A_PAGE) + 1).cast("long").alias("page_number"), F.col("i").alias("sequence"), "text")


def blk11_renumbered(spark, sf_dir):
    return ops.renumbered(_blocks(spark, sf_dir))


def _pages(spark, sf_dir) -> DataFrame:
    """A page for every three lines of a document, with method, confidence and failures by length and number."""
    b = _blocks(spark, sf_dir).groupBy("version_id", "page_number").agg(F.count_if(F.trim("text") != "").alias("full"), F.sum(F.length("text")).cast("long").alias("text_chars"))
    m = (F.col("text_chars") + F.col("page_number")) % 11
    method = F.when(m < 5, "digital").when(m < 7, "ocr").when(m < 9, "mixed").otherwise("none")
    return b.select(
        "version_id", "page_number", "text_chars", method.alias("method"), (F.col("text_chars") % 9 / 10.0 + 0.15).alias("confidence"), F.when(m == 10, 0).otherwise(F.col("full")).alias("block_count"), (m == 9).alias("failed"),
        F.filter(F.array(F.when(m == 9, "Page extraction failed safely: ValueError"), F.when(m < 7, F.lit(None)).otherwise(F.lit("low quality"))), lambda w: w.isNotNull()).alias("warnings"),
        (m % 4 * 60).alias("images"), (F.col("text_chars") * 9000).alias("embedded_pixels"), (F.col("text_chars") * 7000).alias("page_pixels"), m.between(5, 8).alias("needs_ocr"),
    )


def blk13_pages(spark, sf_dir):
    return ops.page_report(_pages(spark, sf_dir))


def blk14_limits(spark, sf_dir):
    return ops.limits(_pages(spark, sf_dir), {"pages": 60, "images_per_page": 150, "embedded_pixels": 30_000_000, "text_chars": 4000, "page_pixels": 20_000_000, "ocr_pixels": 25_000_000})


def blk15_differing(spark, sf_dir):
    """Files of one name in a case whose contents' fingerprints differ: how many, and the smallest."""
    name = F.concat("lang", F.lit("-"), (F.col("doc_id") % 7).cast("string"))
    d = table(spark, sf_dir, "documents").select("source", name.alias("name"), F.sha2(F.concat_ws("|", "lang", "text"), 256).alias("fingerprint"))
    return d.groupBy("source", "name").agg(F.countDistinct("fingerprint").alias("n"), F.min("fingerprint").alias("first_fingerprint")).filter("n > 1")


# -- nested documents ------------------------------------------------------------------------------------------------


def nested(spark, sf_dir) -> DataFrame:
    """Each order as a document version: one page of blocks, of which the second has a table of the order's lines."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("flag")).alias("line"))
    rows = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    cells = F.transform("lines", lambda x: F.array(x["l_partkey"].cast("string"), x["l_suppkey"].cast("string"), x["flag"]))
    block = lambda i, text, t: F.struct(F.lit(i).alias("sequence"), text.alias("text"), t.alias("table"))
    none = F.lit(None).cast("array<array<string>>")
    page = F.struct(F.lit(1).alias("page_number"), F.array(block(0, F.concat(F.lit("Order "), F.col("l_orderkey").cast("string")), none), block(1, F.lit("Lines"), cells)).alias("blocks"))
    return rows.select(F.col("l_orderkey").alias("version_id"), F.array(page).alias("pages"))


def flat_blocks(versions: DataFrame) -> DataFrame:
    """version_id, page_number, sequence, text, table of nested versions."""
    p = versions.select("version_id", F.inline("pages"))
    return p.select("version_id", "page_number", F.inline("blocks"))


def cells(blocks: DataFrame) -> DataFrame:
    """One row a cell of the blocks' tables: row and column from 0."""
    rows = blocks.select("version_id", "page_number", "sequence", F.posexplode("table").alias("row", "values"))
    return rows.select("version_id", "page_number", "sequence", "row", F.posexplode("values").alias("column", "value"))


def src14_nested(spark, sf_dir):
    """What is read back from stored nested versions, flat: blocks and cells of each."""
    kept = stored(nested(spark, sf_dir), "nested")
    b = flat_blocks(kept)
    return b.groupBy("version_id").agg(F.count("*").alias("n_blocks"), F.sum(F.coalesce(F.size("table"), F.lit(0))).cast("long").alias("n_rows"), F.min_by("text", "sequence").alias("first_text"))


def blk5_cells(spark, sf_dir):
    """Cells of the nested versions' tables."""
    return cells(flat_blocks(nested(spark, sf_dir))).select("version_id", "sequence", F.col("row").cast("long").alias("row"), F.col("column").cast("long").alias("column"), "value")


# -- artifacts and uploads -------------------------------------------------------------------------------------------


def ascii_json(value: Column) -> Column:
    """Canonical JSON of a struct whose fields are in order: nulls written, characters beyond ASCII escaped."""
    code = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def safe(c: Column) -> Column:
        n = F.ascii(c).cast("long")
        return F.when(n < 128, c).when(n < 65536, code(n)).otherwise(F.concat(code(F.lit(0xD800) + F.shiftright(n - 65536, 10)), code(F.lit(0xDC00) + (n - 65536) % 1024)))

    text = F.to_json(value, {"ignoreNullFields": "false"})
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.split(text, ""), safe), "")).otherwise(text)


def src17_hashes(spark, sf_dir):
    """Each event as an artifact with the hash of its canonical JSON, keys in order."""
    e = table(spark, sf_dir, "events")
    payload = F.struct(F.concat(F.lit("café "), "event_type").alias("category"), F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 > 0, F.col("user_id")).alias("user"))
    return e.select("event_id", F.sha2(ascii_json(payload), 256).alias("sha256"))


def src7_uploads(spark, sf_dir):
    """Documents as uploads under first bytes, names and declared types that agree or don't: kind, or why it is refused."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    n = F.col("doc_id") % 9
    heads = [b"%PDF-1.7\n", b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"II*\x00", b"MZ", b"\x1f\x8b", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", b"PK\x03\x04"]
    head = F.lit(None)
    for i, h in enumerate(heads):
        head = F.when(n == i, F.lit(h)) if i == 0 else head.when(n == i, F.lit(h))
    content = F.when(n == 8, F.encode(F.concat(F.lit("Line "), F.col("doc_id").cast("string")), "UTF-8")).otherwise(F.concat(head, F.encode("text", "UTF-8")))
    suffix = F.element_at(F.array(*[F.lit(s) for s in ("pdf", "png", "jpg", "tif", "txt", "gz", "xls", "docx", "txt")]), (n + 1).cast("int"))
    name = F.concat(F.lit("File."), F.when(F.col("doc_id") % 5 == 0, "pdf").otherwise(suffix))
    declared = F.when(F.col("doc_id") % 7 == 0, "application/pdf").otherwise("application/octet-stream")
    return d.select("doc_id", validated(F.when(F.col("doc_id") % 50 == 49, F.lit(b"")).otherwise(content), name, declared).alias("v")).select("doc_id", "v.kind", "v.reason")


def src5_emails(spark, sf_dir):
    """Each message of a conversation as an e-mail, as blocks: its headers', then its body's."""
    c = spread(table(spark, sf_dir, "conversations"))
    head = F.concat(F.lit("From: "), F.coalesce("role", F.lit("none")), F.lit("@example.com\nSubject: Talk "), F.col("conv_id").cast("string"), F.lit("\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"))
    version = F.concat_ws("-", "conv_id", "turn", "role")
    b = email_blocks(c.select(version.alias("version_id"), F.encode(F.concat(head, F.coalesce("text", F.lit(""))), "UTF-8").alias("content")))
    return b.select("version_id", "sequence", "kind", "block_id", F.length("text").cast("long").alias("characters"))


QUERIES = {f.__name__: f for f in (src5_emails, blk1_normalised, blk6_quality, src3_documents, blk11_renumbered, blk13_pages, blk14_limits, blk15_differing, src14_nested, blk5_cells, src17_hashes, src7_uploads)}

_TEXTS = r"""WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN replace(t, ' ', chr(9) || ' ') WHEN 1 THEN replace(t, chr(10), chr(13) || chr(10)) WHEN 2 THEN chr(10) || ' ' || chr(10) || replace(t, chr(10), ' ' || chr(13) || chr(10) || chr(9) || chr(10) || chr(10)) || chr(10) ELSE t END AS text FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
a AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\t\f\x0B ]+', ' ', 'g') AS t FROM d),
t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \n]+', ''), '[ \n]+$', '') AS t FROM a)
"""
_BLOCKS = f"""WITH b AS (SELECT doc_id AS version_id, CAST(floor(i / {LINES_A_PAGE}) + 1 AS BIGINT) AS page_number, i, text FROM (SELECT doc_id, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)))
"""
_PAGES = _BLOCKS + """, g AS (SELECT version_id, page_number, count(*) FILTER (WHERE trim(text, ' ') <> '') AS "full", CAST(sum(length(text)) AS BIGINT) AS text_chars FROM b GROUP BY ALL),
p AS (SELECT *, m = 9 AS failed, CASE WHEN m = 10 THEN 0 ELSE "full" END AS block_count, text_chars % 9 / 10.0::DOUBLE + 0.15::DOUBLE AS confidence,
  CASE WHEN m < 5 THEN 'digital' WHEN m < 7 THEN 'ocr' WHEN m < 9 THEN 'mixed' ELSE 'none' END AS method, list_filter([CASE WHEN m = 9 THEN 'Page extraction failed safely: ValueError' END, CASE WHEN m >= 7 THEN 'low quality' END], lambda w: w IS NOT NULL) AS warnings
  FROM (SELECT *, (text_chars + page_number) % 11 AS m FROM g))
"""
SQL = {
    "blk1_normalised": _TEXTS + "SELECT doc_id, length(t) AS characters, sha256(t) AS sha256 FROM t",
    "blk6_quality": _TEXTS + r""",
n AS (SELECT doc_id, len(regexp_extract_all(t, '[^\s\p{Z}]'))::DOUBLE AS c, len(regexp_extract_all(t, '[\p{L}\p{N}_]+'))::DOUBLE AS words, len(regexp_extract_all(t, '[\p{L}\p{N}]'))::DOUBLE AS alnum,
  greatest(len(regexp_extract_all(t, '[^\n]*[^\s\p{Z}][^\n]*')), 1)::DOUBLE AS lines, len(regexp_extract_all(t, '[^\p{L}\p{N}_\s\p{Z}]{5,}'))::DOUBLE AS runs,
  len(regexp_extract_all(t, '[\x00-\x08\x0E-\x1B\x7F-\x84\x{86}-\x{9F}\p{Cf}\p{Co}]'))::DOUBLE AS hidden, len(regexp_extract_all(t, '[\x00-\x08\x0E-\x1B\x7F-\x84\x{86}-\x{9F}\x{FFFD}]'))::DOUBLE AS bad FROM t),
s AS (SELECT doc_id, CASE WHEN c > 0 THEN greatest(0::DOUBLE, least(1::DOUBLE, floor((
  0.30::DOUBLE * least(c / 80, 1::DOUBLE) + 0.25::DOUBLE * ((c - hidden) / c) + 0.20::DOUBLE * least(alnum / c / 0.45::DOUBLE, 1::DOUBLE) + 0.15::DOUBLE * least(words / 12, 1::DOUBLE) + 0.10::DOUBLE * least(lines / 5, 1::DOUBLE)
  - least(0.55::DOUBLE, bad / c * 2.5::DOUBLE + runs * 0.08::DOUBLE)) * 10000 + 0.5::DOUBLE) / 10000)) ELSE 0::DOUBLE END AS score, CAST(c AS BIGINT) AS characters, CAST(words AS BIGINT) AS words,
  CASE WHEN c > 0 THEN floor((c - hidden) / c * 10000 + 0.5::DOUBLE) / 10000 ELSE 0::DOUBLE END AS printable_ratio, CASE WHEN c > 0 THEN floor(alnum / c * 10000 + 0.5::DOUBLE) / 10000 ELSE 0::DOUBLE END AS alphanumeric_ratio, CASE WHEN c > 0 THEN floor(bad / c * 10000 + 0.5::DOUBLE) / 10000 ELSE 0::DOUBLE END AS replacement_ratio FROM n)
SELECT *, CASE WHEN score < 0.55 OR characters < 24 THEN 'true' ELSE 'false' END AS needs_ocr FROM s""",
    "src3_documents": r"""
WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(CASE WHEN doc_id % 10 = 0 THEN ' ' || chr(10) || chr(10) || ' ' ELSE coalesce(text, '') END, '(\.)\s*\n|\n\s*\n', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS b FROM documents)
SELECT doc_id, 1 AS page_number, CAST(len(b) AS BIGINT) AS n_blocks, coalesce(length(b[-1]), 0) AS last_characters, CASE WHEN len(b) > 0 THEN 'ready' ELSE 'partial' END AS status FROM p""",
    "src5_emails": r"""
WITH p AS (SELECT concat_ws('-', conv_id, turn, role) AS version_id, list_prepend('From: ' || coalesce(role, 'none') || '@example.com' || chr(10) || 'To: ' || chr(10) || 'Cc: ' || chr(10) || 'Date: ' || chr(10) || 'Subject: Talk ' || conv_id,
  list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '(\.)\s*\n|\n\s*\n', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')) AS b FROM conversations),
u AS (SELECT version_id, CAST(generate_subscripts(b, 1) - 1 AS BIGINT) AS sequence, unnest(b) AS text FROM p)
SELECT version_id, sequence, CASE WHEN sequence = 0 THEN 'metadata' ELSE 'paragraph' END AS kind, 'blk_' || substr(sha256(version_id || ':1:' || sequence || ':' || text), 1, 20) AS block_id, length(text) AS characters FROM u""",
    "blk11_renumbered": _BLOCKS + r""", c AS (SELECT version_id, page_number, i, regexp_replace(regexp_replace(regexp_replace(text, '[\t\f\x0B ]+', ' ', 'g'), '^ | $', '', 'g'), '\r', '') AS t FROM b),
n AS (SELECT *, row_number() OVER (PARTITION BY version_id, page_number ORDER BY i) - 1 AS sequence FROM c),
k AS (SELECT *, 'blk_' || substr(sha256(version_id || ':' || page_number || ':' || sequence || ':' || t), 1, 20) AS block_id FROM n)
SELECT version_id, page_number, sequence, block_id, length(t) AS characters, CASE WHEN t = '' THEN 'empty' WHEN count(*) OVER (PARTITION BY version_id, page_number, block_id) > 1 THEN 'duplicate' END AS issue FROM k""",
    "blk13_pages": _PAGES + """SELECT version_id, count(*) AS page_count, count(*) FILTER (WHERE method = 'digital') AS digital_pages, count(*) FILTER (WHERE method = 'ocr') AS ocr_pages, count(*) FILTER (WHERE method = 'mixed') AS mixed_pages, count(*) FILTER (WHERE failed) AS failed_pages,
coalesce(string_agg(CASE WHEN block_count = 0 THEN CAST(page_number AS VARCHAR) END, ',' ORDER BY page_number), '') AS missing_pages,
coalesce(string_agg(CASE WHEN block_count > 0 AND confidence < 0.60::DOUBLE THEN CAST(page_number AS VARCHAR) END, ',' ORDER BY page_number), '') AS low_confidence_pages,
array_to_string(flatten(list(list_transform(warnings, lambda w: 'Page ' || page_number || ': ' || w) ORDER BY page_number)), '|') AS warnings,
CASE WHEN count(*) = count(*) FILTER (WHERE block_count = 0) THEN 'ocr_required' WHEN bool_or(block_count = 0 OR failed OR confidence < 0.60::DOUBLE) THEN 'partial' ELSE 'ready' END AS status FROM p GROUP BY version_id""",
    "blk14_limits": _PAGES + """, w AS (SELECT version_id, page_number, text_chars, m % 4 * 60 AS images, text_chars * 7000 AS page_pixels, m BETWEEN 5 AND 8 AS needs_ocr, count(*) OVER (PARTITION BY version_id) AS n_pages,
  sum(text_chars * 9000) OVER (PARTITION BY version_id ORDER BY page_number) AS all_embedded, sum(CASE WHEN m BETWEEN 5 AND 8 THEN text_chars * 7000 ELSE 0 END) OVER (PARTITION BY version_id ORDER BY page_number) AS all_ocr FROM p),
c AS (SELECT version_id, page_number, CASE WHEN n_pages > 60 AND page_number = 1 THEN 'pdf_page_limit' WHEN images > 150 THEN 'pdf_image_count_limit' WHEN all_embedded > 30000000 THEN 'pdf_decompression_limit' WHEN text_chars > 4000 THEN 'pdf_text_expansion_limit'
  WHEN needs_ocr AND page_pixels > 20000000 THEN 'pdf_page_pixel_limit' WHEN needs_ocr AND all_ocr > 25000000 THEN 'pdf_total_pixel_limit' END AS error_code FROM w)
SELECT version_id, min(page_number) AS page_number, arg_min(error_code, page_number) AS error_code FROM c WHERE error_code IS NOT NULL GROUP BY version_id""",
    "blk15_differing": "SELECT source, lang || '-' || (doc_id % 7) AS name, count(DISTINCT sha256(concat_ws('|', lang, text))) AS n, min(sha256(concat_ws('|', lang, text))) AS first_fingerprint FROM documents GROUP BY ALL HAVING count(DISTINCT sha256(concat_ws('|', lang, text))) > 1",
    "src14_nested": "SELECT l_orderkey AS version_id, 2 AS n_blocks, count(*) AS n_rows, 'Order ' || l_orderkey AS first_text FROM lineitem GROUP BY l_orderkey",
    "blk5_cells": """WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) - 1 AS row, [CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), l_returnflag] AS v FROM lineitem)
SELECT l_orderkey AS version_id, 1 AS sequence, row, CAST(generate_subscripts(v, 1) - 1 AS BIGINT) AS "column", unnest(v) AS value FROM r""",
    "src17_hashes": r"""SELECT event_id, sha256('{"category":"caf\u00e9 ' || event_type || '","id":' || event_id || ',"user":' || CASE WHEN event_id % 3 > 0 THEN CAST(user_id AS VARCHAR) ELSE 'null' END || '}') AS sha256 FROM events""",
    "src7_uploads": """WITH u AS (SELECT doc_id, doc_id % 9 AS n, ['pdf','png','jpeg','tiff','x','x','xls','zip','text'][doc_id % 9 + 1] AS kind, CASE WHEN doc_id % 5 = 0 THEN 'pdf' ELSE ['pdf','png','jpg','tif','txt','gz','xls','docx','txt'][doc_id % 9 + 1] END AS suffix FROM documents),
r AS (SELECT *, CASE WHEN doc_id % 50 = 49 THEN 'The uploaded file is empty.' WHEN n IN (4, 5) THEN 'Executable or archive uploads are not allowed.' WHEN n = 7 THEN 'Office document container is corrupted.'
  WHEN NOT (suffix = kind OR (kind, suffix) IN (('jpeg', 'jpg'), ('tiff', 'tif'), ('text', 'txt'))) THEN 'File extension .' || suffix || ' does not match detected ' || kind || ' content.'
  WHEN doc_id % 7 = 0 AND kind <> 'pdf' THEN 'Declared MIME type does not match the uploaded file signature.' END AS reason FROM u)
SELECT doc_id, CASE WHEN reason IS NULL THEN kind END AS kind, reason FROM r""",
}
