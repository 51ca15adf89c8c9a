"""Token totals by source, language and tokenizer version, kept up to date by signed deltas.

An event inserts, deletes or revises one document's count under one tokenizer version. Events become signed deltas;
deltas are summed by key within their batch, and the totals are the sums over all committed batches. A batch is
committed once, by a rename that fails if its number is taken, and within a batch an event that is delivered twice
counts once. Keys are summed before any shuffle, so a source with a third of all rows costs one row a task.

Cases: null source, language or version are keys of their own; null counts are 0; an unknown kind of event has no
effect; repeated rows with equal event_id count once in a batch, and of several contents under one id the least counts
(by source, language, version, documents, tokens), whatever order they come in; a row without event_id is an event of its
own; empty batches are committed and change nothing;
totals may be zero and are kept while their key has ever been seen; other columns are ignored.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"

#: The counts that need no vocabulary, by version.
WORDS_1 = r"[^\x20\x09-\x0D]+"
PIECES_2 = r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"


def count_of(text: Column, pattern: str) -> Column:
    """How many tokens a pattern finds in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def signed(events: DataFrame) -> DataFrame:
    """KEYS, docs, tokens: deltas of one batch, summed by key. Events: event_id, kind, KEYS, tokens, old_tokens."""
    new, old = (F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in ("tokens", "old_tokens"))
    flat = events.select(
        "event_id", *KEYS,
        F.when(F.col("kind") == "insert", 1).when(F.col("kind") == "delete", -1).otherwise(0).alias("docs"),
        F.when(F.col("kind") == "insert", new).when(F.col("kind") == "delete", -old).when(F.col("kind") == "revise", new - old).otherwise(0).alias("tokens"),
    )
    least = F.min(F.struct(*KEYS, "docs", "tokens")).alias("e")
    once = flat.filter("event_id is not null").groupBy("event_id").agg(least).select("e.*").unionByName(flat.filter("event_id is null").drop("event_id"))
    return once.groupBy(*KEYS).agg(F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens"))


class Rollup:
    """Totals in a folder: one Parquet part for each committed batch, and sums of compacted ones.

    A part is written beside the others under a name of its own and then renamed to `batch-N`, which fails if that name
    is there: of two writers of one batch, one commits. `compact` writes the sums of all parts so far, with the numbers
    of their batches, as the next `sums-N`; the last one counts, and parts that it names are never read again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(conf)
        self._store = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).toUri(), conf)
        self._plain = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)

    def _numbers(self, kind: str) -> list[int]:
        top = self._path(self.path)
        names = [s.getPath().getName() for s in self._files.listStatus(top)] if self._files.exists(top) else []
        return sorted(int(n.removeprefix(kind + "-")) for n in names if n.startswith(kind + "-"))

    def _put(self, df: DataFrame, name: str) -> bool:
        """Write df, then give it its name; False if the name is taken."""
        new = f"{self.path}/new-{uuid.uuid4().hex}"
        df.write.parquet(new)
        try:
            self._store.rename(self._path(new), self._path(f"{self.path}/{name}"), self._plain)
        except Py4JJavaError as e:
            self._files.delete(self._path(new), True)
            if "FileAlreadyExistsException" in str(e.java_exception):
                return False
            raise
        return True

    def _sums(self) -> tuple[DataFrame | None, set[int]]:
        """The last compacted sums and the batches in them."""
        numbers = self._numbers("sums")
        if not numbers:
            return None, set()
        sums = self.spark.read.parquet(f"{self.path}/sums-{numbers[-1]}")
        return sums.filter("batches is null").select(*KEYS, "docs", "tokens"), set(sums.filter("batches is not null").first()["batches"])

    def batches(self) -> list[int]:
        return sorted(self._sums()[1] | set(self._numbers("batch")))

    def commit(self, batch: int, events: DataFrame) -> bool:
        """Add a batch's deltas; False, and no effect, if that batch is there already. A batch that broke off is done anew."""
        return int(batch) not in self.batches() and self._put(signed(events), f"batch-{int(batch)}")

    def _added(self, sums: DataFrame | None, batches: list[int]) -> DataFrame:
        parts = [f"{self.path}/batch-{b}" for b in batches]
        deltas = self.spark.read.schema(SCHEMA).parquet(*parts) if parts else self.spark.createDataFrame([], SCHEMA)
        deltas = deltas if sums is None else deltas.unionByName(sums)
        return deltas.groupBy(*KEYS).agg(F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens"))

    def totals(self) -> DataFrame:
        """KEYS, docs, tokens over all committed batches."""
        sums, old = self._sums()
        return self._added(sums, [b for b in self._numbers("batch") if b not in old])

    def compact(self) -> bool:
        """Sum all parts so far up in one; False if another writer did so meanwhile. A late commit stays a part."""
        last, (sums, old) = self._numbers("sums"), self._sums()
        new = [b for b in self._numbers("batch") if b not in old]
        if not new:
            return False
        listed = self.spark.createDataFrame([(sorted(old | set(new)),)], "batches array<long>")
        return self._put(self._added(sums, new).unionByName(listed, allowMissingColumns=True).coalesce(1), f"sums-{(last or [0])[-1] + 1}")
