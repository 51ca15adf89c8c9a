"""Registered queries over questions, conversations and vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from caseloom.functions.text import excerpt
from caseloom.operators import answers, postings, search
from caseloom.plans.governance import uploads
from caseloom.sources.views import DOCUMENT_LINES, document_lines, shared_folder, small, stored, table


def _questions(spark, sf_dir):
    """The first three words of each benchmark text, asked in the case that its number leads to."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("case_id"), F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("query"))


def _all_questions(spark, sf_dir):
    """Each whole benchmark text, asked in every source that the documents have, and one that no block answers in each."""
    cases = table(spark, sf_dir, "documents").select(F.col("source").alias("case_id")).filter("case_id is not null").distinct()
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("n"), F.col("text").alias("query")).union(spark.createDataFrame([("none", "qqzzx wwxxq")], "n string, query string"))
    return b.crossJoin(cases).select(F.concat_ws("@", "n", "case_id").alias("query_id"), "case_id", "query")


def sr3_bm25_all(spark, sf_dir):
    """sr3 with whole texts in all sources; sr3_bm25 keeps to what its SQL says, as do the others without _all."""
    return search.bm25(document_lines(spark, sf_dir), _all_questions(spark, sf_dir))


def sr3_bm25(spark, sf_dir):
    return search.bm25(document_lines(spark, sf_dir), _questions(spark, sf_dir))


def sr4_phrases(spark, sf_dir):
    """Blocks of all sources that hold a benchmark text without its first and last two characters, which cuts words."""
    q = _all_questions(spark, sf_dir).select("query_id", "case_id", F.expr("substring(query, 3, greatest(length(query) - 4, 0))").alias("query"))
    return search.phrase_blocks(document_lines(spark, sf_dir), q.filter("query_id not like 'none@%'"))


def _index(spark, sf_dir):
    """A stored index of all documents' lines, in which French documents were changed and German ones removed afterwards."""
    index = postings.Index(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    index.put(document_lines(spark, sf_dir))
    langs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("case_id"), "lang")
    lines = document_lines(spark, sf_dir).join(langs.filter("lang = 'fr'").select("document_id"), "document_id", "left_semi")
    index.put(lines.withColumn("text", F.concat(F.lit("amended "), "text")), removed=langs.filter("lang = 'de'"))
    return index


def sr3_stored(spark, sf_dir):
    return _index(spark, sf_dir).search(_questions(spark, sf_dir))


def sr7_scoped(spark, sf_dir):
    """The questions of sr7_scopes, asked in the documents that they mention."""
    told = stored(sr7_scopes(spark, sf_dir), "scopes")
    index = postings.Index(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    index.put(document_lines(spark, sf_dir))
    chosen = told.filter("targets <> ''").select("query_id", F.explode(F.split("targets", ",").cast("array<long>")).alias("document_id"))
    return index.search(told.select("query_id", "case_id", F.col("question").alias("query")), scopes=chosen)


def sr2_index(spark, sf_dir):
    i = search.index(document_lines(spark, sf_dir))
    return i.groupBy("case_id", "term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("tf"))


def sr8_excerpts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", excerpt(F.coalesce("text", F.lit("")), 200).alias("excerpt"))


def sr14_last_question(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return c.groupBy("conv_id").agg(F.max_by("text", "turn").alias("query"))


def sr15_history(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    c = c.withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).filter("r <= 4")
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("history"))


def sr16_message_cap(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("n_user"))
    return c.select("conv_id", "n_user", (F.col("n_user") > 3).cast("string").alias("over_cap"))


def sr17_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return search.cosine(e.filter("vec_id % 100 = 0"), e, same="label")


def _hits(spark, sf_dir):
    """(questions, their best six blocks with text): each third question is one that no block answers."""
    q = _questions(spark, sf_dir).withColumn("query", F.when(F.col("query_id") % 3 == 0, "qqzzx wwxxq").otherwise(F.col("query")))
    best = stored(search.bm25(document_lines(spark, sf_dir), q, k=6), "hits")
    return q, document_lines(spark, sf_dir).join(small(best), ["case_id", "document_id", "sequence"])


def _all_hits(spark, sf_dir):
    """(questions of all sources, their best six blocks with text)"""
    q = _all_questions(spark, sf_dir)
    best = stored(search.bm25(document_lines(spark, sf_dir), q, k=6), "hits")
    return q, document_lines(spark, sf_dir).join(small(best), ["case_id", "document_id", "sequence"])


def sr6_citations_all(spark, sf_dir):
    return _cited(_all_hits(spark, sf_dir)[1])


def sr9_fallback_all(spark, sf_dir):
    q, hits = _all_hits(spark, sf_dir)
    return answers.broad(q, hits, document_lines(spark, sf_dir))


def sr11_summaries_all(spark, sf_dir):
    return answers.summaries(_all_hits(spark, sf_dir)[1])


def sr6_citations(spark, sf_dir):
    return _cited(_hits(spark, sf_dir)[1])


def _cited(hits):
    """Each hit as a citation: the cited stretch, at most 4000 characters from the block's start, its label and score."""
    return hits.select("query_id", "rank", F.lit(0).alias("start"), F.least(F.length("text"), F.lit(4000)).alias("end"), F.md5(F.substring("text", 1, 4000)).alias("quote_md5"), F.concat(F.lit("document "), F.col("document_id").cast("string"), F.lit(", page 1")).alias("label"), "score")


def sr7_scopes(spark, sf_dir):
    """Questions that mention documents by name, quoted or not, and one that no document has."""
    n = F.col("item_id")
    b = table(spark, sf_dir, "benchmark").select(n.alias("query_id"), F.concat(F.lit("src"), (n % 20).cast("string")).alias("case_id"), F.concat(F.lit('Compare @"EN file#'), (n % 9).cast("string"), F.lit('.txt" with @fr_File and @nothing'), (n % 2).cast("string"), F.lit(" on "), F.substring("text", 1, 20)).alias("query"))
    named = uploads(spark, sf_dir).groupBy("case_id", "original_name").agg(F.max("upload_id").alias("upload_id"))
    return answers.scopes(b, named)


def sr7_scopes_all(spark, sf_dir):
    """sr7 with whole texts in all sources."""
    q = _all_questions(spark, sf_dir).filter("query_id not like 'none@%'")
    n = F.substring_index("query_id", "@", 1).cast("long")
    b = q.select("query_id", "case_id", F.concat(F.lit('Compare @"EN file#'), (n % 9).cast("string"), F.lit('.txt" with @fr_File and @nothing'), (n % 2).cast("string"), F.lit(" on "), F.coalesce("query", F.lit(""))).alias("query"))
    named = uploads(spark, sf_dir).groupBy("case_id", "original_name").agg(F.max("upload_id").alias("upload_id"))
    return answers.scopes(b, named)


def sr9_fallback(spark, sf_dir):
    q, hits = _hits(spark, sf_dir)
    return answers.broad(q, hits, document_lines(spark, sf_dir))


def sr11_summaries(spark, sf_dir):
    return answers.summaries(_hits(spark, sf_dir)[1])


def sr13_checked(spark, sf_dir):
    """Assistant texts as generated answers, with a cited line, a wrong number or nothing added."""
    n = F.col("conv_id")
    c = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", (F.col("turn") % 4).cast("int").alias("sources"), F.concat(F.coalesce("text", F.lit("")), F.when(n % 3 == 0, "\n## Summary:\n- The fact is in the record [1].").when(n % 3 == 1, "\nCaveat: see [9].").otherwise("")).alias("answer"))
    return answers.checked(c).select("conv_id", "turn", "repaired", "cited", "rejected")


QUERIES = {f.__name__: f for f in (sr3_bm25_all, sr6_citations_all, sr7_scopes_all, sr9_fallback_all, sr11_summaries_all, sr3_bm25, sr3_stored, sr4_phrases, sr7_scoped, sr2_index, sr6_citations, sr7_scopes, sr8_excerpts, sr9_fallback, sr11_summaries, sr13_checked, sr14_last_question, sr15_history, sr16_message_cap, sr17_cosine)}
_TERMS = r"regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]{2,}')"
_INDEX = "WITH " + DOCUMENT_LINES + f""",
t AS (SELECT *, {_TERMS} AS t FROM lines),
words AS (SELECT case_id, document_id, sequence, n AS len, term, count(*) AS tf FROM (SELECT case_id, document_id, sequence, len(t) AS n, unnest(t) AS term FROM t) GROUP BY ALL)
"""
_HITS0 = r""",
q AS (SELECT item_id AS query_id, 'src' || CAST(item_id % 20 AS VARCHAR) AS case_id, array_to_string(list_slice(string_split(text, ' '), 1, 3), ' ') AS query FROM benchmark),
corpus AS (SELECT case_id, count(*) AS n, sum(len(t)) AS total FROM t GROUP BY case_id),
freq AS (SELECT case_id, term, count(*) AS df FROM words GROUP BY ALL),
asked AS (SELECT query_id, case_id, term, count(*) AS times FROM (SELECT query_id, case_id, unnest(regexp_extract_all(replace(lower(query), 'ß', 'ss'), '[\p{L}\p{N}_]{2,}')) AS term FROM q) GROUP BY ALL),
parts AS (
  SELECT query_id, a.case_id, document_id, sequence, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * times * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / (total::DOUBLE / n))) AS score
  FROM asked a JOIN freq f ON a.case_id = f.case_id AND a.term = f.term JOIN corpus c ON c.case_id = a.case_id JOIN words w ON w.case_id = a.case_id AND w.term = a.term
  UNION ALL SELECT query_id, q.case_id, document_id, sequence, 2.0::DOUBLE FROM q JOIN lines l ON l.case_id = q.case_id AND trim(query) <> '' AND contains(replace(lower(l.text), 'ß', 'ss'), replace(lower(trim(query)), 'ß', 'ss'))),
hits AS (SELECT query_id, case_id, document_id, sequence, round(sum(score), 6) AS score FROM parts GROUP BY ALL)
"""
_HITS = _INDEX + _HITS0.replace("array_to_string(list_slice(string_split(text, ' '), 1, 3), ' ') AS query", "CASE WHEN item_id % 3 = 0 THEN 'qqzzx wwxxq' ELSE array_to_string(list_slice(string_split(text, ' '), 1, 3), ' ') END AS query") + """,
best AS (SELECT b.*, l.text FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, case_id ORDER BY score DESC, document_id DESC, sequence DESC) AS rank FROM hits WHERE score > 0) WHERE rank <= 6) b JOIN lines l USING (case_id, document_id, sequence))
"""


def _cleaned(text: str, limit: int) -> str:
    flat = rf"regexp_replace(regexp_replace({text}, '\s+', ' ', 'g'), '^[ .,-]+|[ .,-]+$', '', 'g')"
    return f"coalesce(nullif(CASE WHEN length({flat}) > {limit} THEN rtrim(substr({flat}, 1, {limit - 3})) || '...' ELSE {flat} END, ''), '{answers.LOW_INFORMATION}')"


def _needs(line: str) -> str:
    trim = rf"regexp_replace({line}, '^\s+|\s+$', '', 'g')"
    plain = rf"regexp_replace(regexp_replace({trim}, '^[#>*\-\d.\s]+', ''), '^[ *_]+|[ *_]+$', '', 'g')"
    return rf"(regexp_matches({trim}, '[A-Za-z0-9]') AND {plain} <> '' AND NOT regexp_matches(lower({plain}), '^(inference:|insufficient evidence|caveat:)') AND NOT ({plain}[-1] = ':' AND length({plain}) <= 110) AND NOT regexp_matches({plain}, '{answers.HEADINGS}'))"


def _scoped() -> str:
    """BM25 with statistics over each question's own documents."""
    return "WITH " + DOCUMENT_LINES + f""",
s AS ({SQL["sr7_scopes"]}),
scope AS (SELECT DISTINCT query_id, case_id, CAST(unnest(string_split(targets, ',')) AS BIGINT) AS document_id FROM s WHERE targets <> ''),
t AS (SELECT query_id, case_id, document_id, sequence, text, {_TERMS} AS t FROM scope JOIN lines USING (case_id, document_id)),
words AS (SELECT query_id, case_id, document_id, sequence, n AS len, term, count(*) AS tf FROM (SELECT query_id, case_id, document_id, sequence, len(t) AS n, unnest(t) AS term FROM t) GROUP BY ALL),
corpus AS (SELECT query_id, count(*) AS n, sum(len(t)) AS total FROM t GROUP BY query_id),
freq AS (SELECT query_id, term, count(*) AS df FROM words GROUP BY ALL),
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_TERMS.replace("text", "question")}) AS term FROM s) GROUP BY ALL),
parts AS (
  SELECT w.query_id, w.case_id, document_id, sequence, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * times * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / (total::DOUBLE / n))) AS score
  FROM asked a JOIN freq f ON a.query_id = f.query_id AND a.term = f.term JOIN corpus c ON c.query_id = a.query_id JOIN words w ON w.query_id = a.query_id AND w.term = a.term
  UNION ALL SELECT t.query_id, t.case_id, document_id, sequence, 2.0::DOUBLE FROM t JOIN s ON s.query_id = t.query_id AND trim(question) <> '' AND contains(replace(lower(text), 'ß', 'ss'), replace(lower(trim(question)), 'ß', 'ss'))),
hits AS (SELECT query_id, case_id, document_id, sequence, round(sum(score), 6) AS score FROM parts GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, case_id ORDER BY score DESC, document_id DESC, sequence DESC) AS rank FROM hits WHERE score > 0) WHERE rank <= 8"""


_NAME_KEY = r"trim(regexp_replace(regexp_replace(lower({0}), '\.[a-z0-9]+$', ''), '[^a-z0-9]+', ' ', 'g'))"
SQL = {
    "sr2_index": _INDEX + "SELECT case_id, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM words GROUP BY ALL",
    "sr3_bm25": _INDEX + _HITS0 + """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, case_id ORDER BY score DESC, document_id DESC, sequence DESC) AS rank FROM hits WHERE score > 0) WHERE rank <= 8""",
    "sr3_stored": "WITH " + DOCUMENT_LINES.replace("FROM documents)", "FROM documents WHERE lang IS DISTINCT FROM 'de')").replace("lines AS (", "given AS (") + """,
lines AS (SELECT case_id, document_id, sequence, CASE WHEN document_id IN (SELECT doc_id FROM documents WHERE lang = 'fr') THEN 'amended ' ELSE '' END || text AS text FROM given)""" + _INDEX.removeprefix("WITH " + DOCUMENT_LINES) + _HITS0 + """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, case_id ORDER BY score DESC, document_id DESC, sequence DESC) AS rank FROM hits WHERE score > 0) WHERE rank <= 8""",
    "sr4_phrases": "WITH " + DOCUMENT_LINES + """,
q AS (SELECT item_id, replace(lower(trim(substr(text, 3, greatest(length(text) - 4, 0)))), 'ß', 'ss') AS phrase FROM benchmark)
SELECT item_id || '@' || case_id AS query_id, case_id, document_id, sequence FROM q JOIN lines ON phrase <> '' AND contains(replace(lower(lines.text), 'ß', 'ss'), phrase)""",
    "sr8_excerpts": r"""SELECT doc_id, CASE WHEN length(c) > 200 THEN rtrim(substr(c, 1, 197)) || '...' ELSE c END AS excerpt FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS c FROM documents)""",
    "sr14_last_question": "SELECT conv_id, arg_max(text, turn) AS query FROM conversations WHERE role = 'user' GROUP BY conv_id",
    "sr15_history": "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 4 GROUP BY conv_id",
    "sr16_message_cap": "SELECT conv_id, n_user, CASE WHEN n_user > 3 THEN 'true' ELSE 'false' END AS over_cap FROM (SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS n_user FROM conversations GROUP BY conv_id)",
    "sr17_cosine": """SELECT query_id, vec_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 5) AS score FROM embeddings q JOIN embeddings c ON q.label = c.label AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)) WHERE rank <= 5""",
    "sr6_citations": _HITS + "SELECT query_id, rank, 0 AS start, least(length(text), 4000) AS \"end\", md5(substr(text, 1, 4000)) AS quote_md5, 'document ' || document_id || ', page 1' AS label, score FROM best",
    "sr7_scopes": r"""
WITH q AS (SELECT item_id AS query_id, 'src' || CAST(item_id % 20 AS VARCHAR) AS case_id, 'Compare @"EN file#' || (item_id % 9) || '.txt" with @fr_File and @nothing' || (item_id % 2) || ' on ' || substr(text, 1, 20) AS query FROM benchmark),
d AS (SELECT source AS case_id, lang || ' File#' || (doc_id % 7) || '.TXT' AS original_name, max(doc_id) AS upload_id FROM documents GROUP BY ALL),
r AS (SELECT *, regexp_replace(query, '@"[^"]+"', ' ', 'g') AS rest FROM q),
told AS (SELECT query_id, case_id, generate_subscripts(m, 1) AS i, unnest(m) AS mention FROM (SELECT *, list_concat(regexp_extract_all(query, '@"([^"]+)"', 1), regexp_extract_all(rest, '(^|\s)@([^\s"@]+)', 2)) AS m FROM r)),
met AS (SELECT query_id, i, mention, arg_min(upload_id, (CASE WHEN lower(original_name) = lower(mention) THEN 0 ELSE 1 END) * 1000000000000 + upload_id) AS upload_id
  FROM told LEFT JOIN d ON d.case_id = told.case_id AND """ + _NAME_KEY.format("mention") + " <> '' AND (lower(original_name) = lower(mention) OR contains(" + _NAME_KEY.format("original_name") + ", " + _NAME_KEY.format("mention") + ") OR contains(" + _NAME_KEY.format("mention") + ", " + _NAME_KEY.format("original_name") + r""")) GROUP BY ALL),
hit AS (SELECT query_id, string_agg(CAST(upload_id AS VARCHAR), ',' ORDER BY pos) AS targets FROM (SELECT query_id, upload_id, min(i) AS pos FROM met WHERE upload_id IS NOT NULL GROUP BY ALL) GROUP BY query_id),
lost AS (SELECT query_id, string_agg(mention, '|' ORDER BY i) AS unmatched FROM met WHERE upload_id IS NULL GROUP BY query_id)
SELECT query_id, case_id, trim(regexp_replace(regexp_replace(rest, '(^|\s)@([^\s"@]+)', ' ', 'g'), '\s+', ' ', 'g')) AS question, coalesce(targets, '') AS targets, coalesce(unmatched, '') AS unmatched FROM r LEFT JOIN hit USING (query_id) LEFT JOIN lost USING (query_id)""",
    "sr9_fallback": _HITS + r""",
firsts AS (SELECT * FROM (SELECT case_id, document_id, sequence, row_number() OVER (PARTITION BY case_id ORDER BY document_id, sequence) AS rank FROM lines WHERE len(regexp_extract_all(""" + _cleaned("text", 900) + r""", '[\p{L}\p{N}_]+')) >= 8) WHERE rank <= 3)
SELECT query_id, f.* FROM q JOIN firsts f USING (case_id) WHERE query_id NOT IN (SELECT query_id FROM best)""",
    "sr11_summaries": _HITS + r""",
marked AS (SELECT query_id, rank, text, len(regexp_extract_all(""" + _cleaned("text", 480) + r""", '[A-Za-z0-9]')) >= 30 AND len(regexp_extract_all(""" + _cleaned("text", 480) + r""", '[\p{L}\p{N}_]+')) >= 6 AS useful FROM best),
chosen AS (SELECT query_id, text, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM (SELECT *, bool_or(useful) OVER (PARTITION BY query_id) AS any_useful FROM marked) WHERE useful OR NOT any_useful)
SELECT query_id, string_agg(""" + _cleaned("text", 175) + """ || ' [' || n || ']', '; ' ORDER BY n) AS summary FROM chosen WHERE n <= 3 GROUP BY query_id""",
    "sr13_checked": r"""
WITH a AS (SELECT conv_id, turn, CAST(turn % 4 AS INTEGER) AS sources, coalesce(text, '') || CASE conv_id % 3 WHEN 0 THEN chr(10) || '## Summary:' || chr(10) || '- The fact is in the record [1].' WHEN 1 THEN chr(10) || 'Caveat: see [9].' ELSE '' END AS answer FROM conversations WHERE role = 'assistant'),
l AS (SELECT conv_id, turn, sources, answer, generate_subscripts(p, 1) AS i, regexp_replace(unnest(p), '\s+$', '') AS line FROM (SELECT *, string_split(replace(answer, chr(13) || chr(10), chr(10)), chr(10)) AS p FROM a)),
r AS (SELECT conv_id, turn, sources, regexp_replace(CASE WHEN sources > 0 THEN string_agg(CASE WHEN """ + _needs("line") + r""" AND NOT regexp_matches(line, '\[\d+\]') THEN line || ' ' || CASE sources WHEN 1 THEN '[1]' WHEN 2 THEN '[1][2]' ELSE '[1][2][3]' END ELSE line END, chr(10) ORDER BY i) ELSE answer END, '^\s+|\s+$', '', 'g') AS repaired FROM l GROUP BY conv_id, turn, sources, answer),
n AS (SELECT *, list_sort(list_distinct(list_transform(regexp_extract_all(repaired, '\[(\d+)\]', 1), lambda x: CAST(x AS HUGEINT)))) AS numbers, string_split_regex(regexp_replace(repaired, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+') AS pieces FROM r),
b AS (SELECT conv_id, turn, bool_or(""" + _needs("piece") + r""" AND NOT regexp_matches(piece, '\[\d+\]')) AS bare FROM (SELECT conv_id, turn, unnest(pieces) AS piece FROM n) GROUP BY ALL)
SELECT conv_id, turn, repaired, array_to_string(numbers, ',') AS cited,
  CASE WHEN repaired = '' OR len(numbers) = 0 OR numbers[1] < 1 OR numbers[-1] > sources THEN 'no valid source citations' WHEN bare THEN 'factual lines without citations' END AS rejected FROM n LEFT JOIN b USING (conv_id, turn)""",
}
SQL["sr7_scoped"] = _scoped()
