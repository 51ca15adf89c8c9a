"""The queries over these operators, with SQL where SQL can say the same."""

from __future__ import annotations

import hashlib
import os
import secrets

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseloom.llm import bpe, chat, counts, jaccard, lempel_ziv, media, merkle, packing, pii, topk, toxicity, urls, whitening
from caseloom.llm.common import saved, shared_folder

#: The query's allow and block rules.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


_OWN_KEY = secrets.token_bytes(32)


def pii_key() -> bytes:
    """The secret of the pseudonyms, from CASELOOM_PII_KEY. Without it, this driver process draws a random key and keeps
    it nowhere: values stay linked within its runs, and nobody can take the pseudonyms back afterwards."""
    own = os.environ.get("CASELOOM_PII_KEY")
    return hashlib.sha256(own.encode()).digest() if own else _OWN_KEY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored films' digests and their timed clip rows, in one array a document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), media.store("text").alias("media"))
    return docs.select("doc_id", "n_bytes", media.digests(F.col("media")).alias("d")).select("doc_id", "n_bytes", "d.*")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    messages = rows.unionByName(extra).withColumn("msg_id", at.cast("long")).withColumn("parent_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1))
    done = chat.format_trees(messages, "conv_id", "msg_id", "parent_id", score=None)
    turns = chat.read_turns(F.col("formatted"))
    loss = chat.read_loss(F.col("formatted"), F.col("loss_spans"))
    lines = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select("conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return labels.select("doc_id", toxicity.severity_grade(F.col("toxic"), F.col("quality")).alias("grade"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, grades(spark, sf_dir)))
    return scored.withColumn("rejected", F.col("p_toxic") >= toxicity.LIMIT)


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_components(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key())


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES)


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over all documents, one delivered twice: inserts under two versions, revised counts of labelled
    documents, deletes of toxic ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", counts.count_of(F.col("text"), counts.WORDS_1).alias("words"), counts.count_of(F.col("text"), counts.PIECES_2).alias("pieces"))
    docs = saved(docs, "counts")  # the texts are counted once
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    version = F.explode(F.array(*[F.struct(F.lit(v).alias("tokenizer"), F.col(c).alias("tokens")) for v, c in (("words-1", "words"), ("pieces-2", "pieces"))]))
    keys = lambda df, kind: df.withColumn("kind", F.lit(kind)).withColumn("event_id", F.concat("kind", F.lit(":"), "tokenizer", F.lit(":"), F.col("doc_id").cast("string")))
    first = keys(docs.select("doc_id", "source", "lang", version.alias("x")).select("doc_id", "source", "lang", "x.*").withColumn("old_tokens", F.lit(0)), "insert")
    known = docs.join(labels, "doc_id")
    revised = keys(known.select("doc_id", "source", "lang", F.lit("words-1").alias("tokenizer"), F.col("pieces").alias("tokens"), F.col("words").alias("old_tokens")), "revise")
    gone = known.filter("toxic = 1").select("doc_id", "source", "lang", F.explode(F.array(F.lit("words-1"), F.lit("pieces-2"))).alias("tokenizer"), F.lit(0).alias("tokens"), F.col("pieces").alias("old_tokens"))
    rollup = counts.Rollup(spark, f"{shared_folder(spark)}/rollup-{os.urandom(8).hex()}")
    rollup.commit(1, first)
    rollup.commit(2, revised)
    rollup.commit(2, revised)
    rollup.compact()
    rollup.commit(3, keys(gone, "delete"))
    return rollup.totals()


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, decoded=True)
    return ids.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_lempel_ziv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lempel_ziv.without_repeats(table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampering adds 1 to n_chars of some documents, as a decimal: the greatest long has a next number, too."""
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    longer = F.col("n_chars").cast("decimal(20,0)") + 1
    proofs = merkle.manifest(table(spark, sf_dir, "documents"), columns, "lang", "doc_id", {"n_chars": longer}, F.crc32(F.col("doc_id").cast("string")) % 7 == 0)
    return merkle.verified(proofs, "doc_id")


QUERIES = {f.__name__: f for f in (op1_media, op2_chat, op3_toxicity, op4_jaccard, op5_pii, op6_urls, op7_topk, op8_packing, op9_counts, op10_bpe, op11_whitening, op12_lempel_ziv, op13_merkle)}

SQL = {
    "op9_counts": r"""
WITH d AS (
  SELECT doc_id, source, lang,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
         len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]')) AS pieces
  FROM documents),
l AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT d.*, l.doc_id IS NOT NULL AS known, coalesce(l.toxic, 0) AS toxic FROM d LEFT JOIN l USING (doc_id))
SELECT source, lang, 'words-1' AS tokenizer,
       CAST(sum(CASE WHEN toxic = 1 THEN 0 ELSE 1 END) AS BIGINT) AS docs,
       CAST(sum(CASE WHEN toxic = 1 THEN 0 WHEN known THEN pieces ELSE words END) AS BIGINT) AS tokens
FROM c GROUP BY source, lang
UNION ALL
SELECT source, lang, 'pieces-2' AS tokenizer,
       CAST(sum(CASE WHEN toxic = 1 THEN 0 ELSE 1 END) AS BIGINT) AS docs,
       CAST(sum(CASE WHEN toxic = 1 THEN 0 ELSE pieces END) AS BIGINT) AS tokens
FROM c GROUP BY source, lang
""",
    "op12_lempel_ziv": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT doc_id, start, array_to_string(words[start + 1 : start + 20], ' ') AS held
  FROM (SELECT doc_id, words, unnest(range(0, greatest(len(words) - 19, 0))) AS start FROM w)),
again AS (SELECT doc_id, start FROM (SELECT doc_id, start, row_number() OVER (PARTITION BY held ORDER BY doc_id, start) AS r FROM windows) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, start + unnest(range(0, 20)) AS at FROM again),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(0, len(words))) AS at FROM w),
kept AS (
  SELECT e.doc_id, count(*) AS n_words, count(g.at) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY e.at) FILTER (WHERE g.at IS NULL), '') AS kept
  FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.at = e.at GROUP BY e.doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""",
    "op13_merkle": r"""
WITH RECURSIVE byte AS (SELECT range AS c FROM range(0, 256)),
crc0 AS (SELECT c, c AS x, 0 AS k FROM byte UNION ALL SELECT c, CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, k + 1 FROM crc0 WHERE k < 8),
crc_table AS (SELECT list(x ORDER BY c) AS t FROM crc0 WHERE k = 8),
crc(doc_id, s, x) AS (
  SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR), CAST(4294967295 AS BIGINT) FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT doc_id, substr(s, 2), xor(x // 256, t[xor(x % 256, ascii(s)) + 1]) FROM crc, crc_table WHERE s <> ''),
odd AS (SELECT doc_id FROM crc WHERE s = '' AND xor(x, 4294967295) % 7 = 0),
f AS (
  SELECT doc_id, lang,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
         coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS b, coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') AS c,
         coalesce(strlen(text) || ':' || text, '-') AS d, doc_id IN (SELECT doc_id FROM odd) AS tampered
  FROM documents),
leaves AS (
  SELECT doc_id, lang, leaf, started, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT doc_id, lang, sha256(a || b || d) AS leaf, sha256(a || CASE WHEN tampered THEN c ELSE b END || d) AS started FROM f)),
nodes(lang, level, idx, digest, n) AS (
  SELECT lang, 0, idx, leaf, n FROM leaves
  UNION ALL
  SELECT lang, level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), CAST(ceil(n / 2.0) AS BIGINT) FROM nodes WHERE n > 1 GROUP BY lang, level, idx // 2, n),
subroots AS (SELECT lang, digest AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
over(level, idx, digest, n) AS (
  SELECT 0, idx, subroot, n FROM subroots
  UNION ALL
  SELECT level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), CAST(ceil(n / 2.0) AS BIGINT) FROM over WHERE n > 1 GROUP BY level, idx // 2, n),
root AS (SELECT digest AS root FROM over WHERE n = 1),
steps AS (
  SELECT l.lang, l.idx, x.level, xor(l.idx // CAST(2 ** x.level AS BIGINT), 1) AS place, x.digest
  FROM leaves l JOIN nodes x ON x.lang IS NOT DISTINCT FROM l.lang AND x.n > 1 AND x.idx = xor(l.idx // CAST(2 ** x.level AS BIGINT), 1)
  UNION ALL
  SELECT l.lang, l.idx, s.height + x.level, x.idx, x.digest
  FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN over x ON x.n > 1 AND x.idx = xor(s.idx // CAST(2 ** x.level AS BIGINT), 1)),
proofs AS (SELECT lang, idx, list({'left': place % 2 = 0, 'digest': digest} ORDER BY level) AS p FROM steps GROUP BY lang, idx),
fold(doc_id, lang, idx, leaf, d, k, p) AS (
  SELECT l.doc_id, l.lang, l.idx, leaf, started, 1, coalesce(p, []) FROM leaves l LEFT JOIN proofs q ON q.lang IS NOT DISTINCT FROM l.lang AND q.idx = l.idx
  UNION ALL SELECT doc_id, lang, idx, leaf, sha256(CASE WHEN p[k]['left'] THEN p[k]['digest'] || d ELSE d || p[k]['digest'] END), k + 1, p FROM fold WHERE k <= len(p))
SELECT f.doc_id, leaf, subroot, root, sha256(list_aggregate(list_transform(p, lambda x: x['digest']), 'string_agg', '')) AS proof_sha256, d AS folded_root, d = root AS verified
FROM fold f JOIN subroots s ON s.lang IS NOT DISTINCT FROM f.lang, root WHERE k = len(p) + 1
""",
    "op2_chat": r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(24 + length(role) + length(replace(text, '\', '\\'))
         + length(regexp_replace(text, '<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<<SYS>>|<</SYS>>|</s>|<s>|\[INST\]|\[/INST\]', chr(1) || '\0', 'g')) - length(text)) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
""",
}
