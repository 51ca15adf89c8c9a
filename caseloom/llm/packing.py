"""Mixture-controlled packing: deficit round-robin over one queue of documents for each source.

First every document is encoded where it lies, and its ids are written with its shard: a run of at most SHARD ids, or
one longer document, of the task that wrote them, so that no task ever holds more than that of one shard.
Token totals by shard and source then give each source's target share (or the caller's) and, by prefix sums over
shards, each shard's starting deficits and its first sequence id: the deficits that all shards before it would hand
on. Shards are packed side by side. A window adds share * window to each source's deficit; sources are served in
turn up to their deficit, then the room left goes to the largest deficits, which may turn negative. What is over at
the end of a shard fills windows of descending powers of two, so no sequence is padded.

Cases: a null or empty text is the end id alone; a null source is a queue of its own; repeated rows are packed each;
an empty table gives an empty table; other columns are ignored, whatever their names. Texts are cut over as many
windows as they need. A source with a third of all rows is spread over all shards.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from caseloom.llm.common import saved

WINDOW, END, LEAST, SHARD = 2048, 1, 128, 1 << 21


class FileEncoder:
    """Ids as the tokenizers library gives them for a byte-level BPE file, made by tiktoken, which is several times
    faster: both apply the file's merges in order. A text is cut at the file's added tokens first, as that library does;
    texts that hold one go to the library itself if any of the tokens strips, needs a word's bounds or is normalised."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens") or []
        special = {t["id"] for t in added}
        plain = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
        letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
        ranks = {bytes(letter[c] for c in t): i for t, i in spec["model"]["vocab"].items() if i not in special}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.plain = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.size = max(*spec["model"]["vocab"].values(), *special, 0) + 1
        self.added = {t["content"]: t["id"] for t in added}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        flagged = any(t.get(f) for t in added for f in ("single_word", "lstrip", "rstrip", "normalized"))
        self.library = Tokenizer.from_file(path) if flagged else None

    def encode(self, text: str) -> list[int]:
        if self.cut is None or self.cut.search(text) is None:
            return self.plain(text)
        if self.library is not None:
            return self.library.encode(text, add_special_tokens=False).ids
        ids: list[int] = []
        for i, piece in enumerate(self.cut.split(text)):
            ids += [self.added[piece]] if i % 2 else self.plain(piece)
        return ids


_encoders: dict[str, FileEncoder] = {}


def file_encoder(path: str) -> FileEncoder:
    if path not in _encoders:
        _encoders[path] = FileEncoder(path)
    return _encoders[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = SHARD) -> DataFrame:
    """shard, id_col, source, n, ids: little-endian unsigned 32-bit ids, the end id included."""
    picked = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("source"))
    kind = picked.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_one, shard, held = file_encoder(path).encode, TaskContext.get().partitionId() << 32, 0
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                ids = [np.array([*encode_one(t), END], dtype="<u4") for t in b.column(1).to_pylist()]
                shards = []
                for x in ids:
                    if held and held + len(x) > most:
                        shard, held = shard + 1, 0
                    held += len(x)
                    shards.append(shard)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shards, pa.int64()), b.column(0), b.column(2), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u2").tobytes() if x.max() < 65536 else b"\0" + x.tobytes() for x in ids], pa.binary())],
                    names=["shard", id_col, "source", "n", "ids"],
                )

    return picked.mapInArrow(run, f"shard long, `{id_col}` {kind}, source string, n long, ids binary")


def _before(df: DataFrame, keys: list[str], sums: dict[str, str]) -> DataFrame:
    """df with the sums of columns over all shards before, of the same keys: first within a task, then over one row a
    task, so that no window has a row for every shard."""
    within = Window.partitionBy(*keys, "_task").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = df.groupBy(*keys, "_task").agg(*[F.sum(c).alias(c) for c in sums])
    tasks = tasks.select(*keys, "_task", *[F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"_past{c}") for c in sums])
    near = df.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(to) for c, to in sums.items()])
    return near.join(tasks, [*keys, "_task"]).withColumns({to: F.col(to) + F.col(f"_past{c}") for c, to in sums.items()})


def plan(counts: DataFrame, targets: dict[str, float] | None = None, window: int = WINDOW) -> DataFrame:
    """shard, source, share, deficit, first_sequence from token totals (shard, source, n). One row a shard and source
    that meet; what a shard lacked before counts in the prefix sums. Windows run over these totals, not documents, and
    the one window without a key over a row a task."""
    if targets is None:
        total = counts.agg(F.sum("n")).first()[0] or 1
        sources = counts.groupBy("source").agg((F.sum("n") / total).alias("share"))
    else:
        wanted = F.create_map(*[F.lit(x) for k, v in targets.items() for x in ("" if k is None else f"={k}", float(v))]) if targets else F.create_map().cast("map<string,double>")
        sources = counts.select("source").distinct().withColumn("share", F.coalesce(F.element_at(wanted, F.col("source")), F.lit(0.0)))
    task = F.shiftright("shard", 32).alias("_task")
    shards = counts.groupBy("shard").agg(F.sum("n").alias("_n")).withColumns({"_q": F.floor(F.col("_n") / window) + F.bit_count(F.col("_n") % window), "_task": task})
    shards = _before(shards, [], {"_n": "_before", "_q": "first_sequence"}).select("shard", "_before", "first_sequence")
    carried = _before(counts.withColumn("_task", task), ["source"], {"n": "_own"})
    pairs = carried.join(shards, "shard").join(sources, "source")
    return pairs.select("shard", "source", "share", (F.col("share") * F.col("_before") - F.col("_own")).alias("deficit"), "first_sequence")


def fill(sizes: list[int], owner: list[int], share: list[float], deficit: list[float], window: int = WINDOW, least: int = LEAST) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one shard's documents, by deficit round-robin."""
    queues: list[list[int]] = [[] for _ in share]
    for d, s in enumerate(owner):
        queues[s].append(d)
    left = [sum(sizes[d] for d in q) for q in queues]
    at, done, debt = [0] * len(queues), [0] * len(queues), list(deficit)
    out: list[tuple[int, int, int, int, int]] = []
    rest, sequence, turn = sum(left), 0, 0
    live = [s for s in range(len(queues)) if left[s]]
    while rest:
        room = window if rest >= window else 1 << (rest.bit_length() - 1)
        rest -= room
        for s in range(len(share)):
            debt[s] += share[s] * room
        offset = 0

        def serve(s: int, n: int) -> None:
            nonlocal offset
            debt[s] -= n
            left[s] -= n
            while n:
                d = queues[s][at[s]]
                k = min(n, sizes[d] - done[s])
                out.append((d, done[s], k, sequence, offset))
                offset += k
                n -= k
                done[s] += k
                if done[s] == sizes[d]:
                    at[s], done[s] = at[s] + 1, 0

        full = room
        order = live[turn % len(live):] + live[:turn % len(live)] if live else []
        for s in order:
            n = min(int(debt[s]), full - offset, left[s])
            if n > 0 and (n >= least or n == left[s]):
                serve(s, n)
        while offset < full:
            s = max((x for x in live if left[x]), key=lambda x: debt[x])
            serve(s, min(full - offset, left[s]))
        if any(not left[s] for s in live):
            live = [s for s in live if left[s]]
        sequence, turn = sequence + 1, turn + 1
    return out


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", window: int = WINDOW, targets: dict[str, float] | None = None, most: int = SHARD) -> DataFrame:
    """One row a piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, source."""
    coded = saved(encode(docs, path, id_col, text_col, source_col, most), "packing-ids")
    counts = saved(coded.groupBy("shard", "source").agg(F.sum("n").alias("n")), "packing-counts")
    kind = coded.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
    arrow = pa.schema([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(rows: pa.Table, plans: pa.Table) -> pa.Table:
        order = pc.sort_indices(rows, sort_keys=[(id_col, "ascending"), ("n", "ascending"), ("ids", "ascending")])
        rows = rows.take(order)
        sources = plans.column("source").to_pylist()
        place = {s: i for i, s in enumerate(sources)}
        sizes = rows.column("n").to_pylist()
        pieces = fill(sizes, [place[s] for s in rows.column("source").to_pylist()], plans.column("share").to_pylist(), plans.column("deficit").to_pylist(), window)
        got = np.array(pieces, dtype=np.int64).reshape(-1, 5)
        crc = np.empty(len(got), dtype=np.int64)
        by_doc = np.argsort(got[:, 0], kind="stable")
        last, view = -1, memoryview(b"")
        raw = rows.column("ids")
        for i, (d, start, n) in zip(by_doc.tolist(), got[by_doc, :3].tolist()):
            if d != last:
                b = raw[d].as_buffer()
                ids = np.frombuffer(b, dtype="<u4", offset=1) if len(b) % 2 else np.frombuffer(b, dtype="<u2").astype("<u4")
                last, view = d, memoryview(ids.tobytes())
            crc[i] = zlib.crc32(view[start * 4:(start + n) * 4])
        first = plans.column("first_sequence")[0].as_py() if len(plans) else 0
        take = pa.array(got[:, 0])
        table = pa.table([got[:, 1], got[:, 2], crc, rows.column("n").take(take), got[:, 3] + first, got[:, 4]], schema=arrow)
        return table.add_column(0, id_col, rows.column(id_col).take(take)).append_column("source", rows.column("source").take(take))

    packed = coded.groupBy("shard").cogroup(plan(counts, targets, window).groupBy("shard")).applyInArrow(run, schema)
    return packed.withColumn("source", F.when(F.col("source") != "", F.substr(F.col("source"), F.lit(2))))
