"""Repeated passages by relative Lempel-Ziv parsing: documents as factors that copy earlier text.

A window is WINDOW consecutive words of one document; a window repeats if the same words start earlier, in a document
with a smaller id or further up in the same one. A factor is a run of windows that repeat. Words that factors cover are
removed; windows are judged on the input, not on what is left.

Reference blocks. The anchor of a window is its least GRAM-word hash (the leftmost of equals), which depends on the
window's words alone, so equal windows have equal anchors at equal offsets. A passage is an anchor with the run of all
windows that have it. Passages meet by anchor: what one task receives is its block of the reference, in document order,
which indexes each window at its first place. All other passages of the anchor are parsed against that index, greedily:
a factor goes on as long as the following windows are found too, and ends are checked window by window, as the parse of
a passage may begin or stop within it. Equal windows always meet, so every document is parsed against all blocks that
could hold one of its factors, and no others. Factors of neighbouring passages are joined at their boundaries.

Skew. A task first parses some megabytes of documents against themselves and sends each window of them once, however
often it occurs; what repeats there is a factor already. Anchors that many documents have in different surroundings
(found by counting in all documents: those that a task sees often are summed up, fewer than 100,000 are kept) are sent
window by window instead, dealt by the whole window, so that a block stays small.

Windows are told apart by 64 bits of the anchor, their offset and 48 bits of the window.

Cases: words are runs of other than space and ASCII white space, unchanged; a null or empty text has no words; texts
shorter than a window lose nothing; rows that repeat an id with another text are documents of their own, ordered by a
hash of the text; rows that repeat id and text are one document, and each gets its result; a null id comes after all
others; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import mix
from caseloom.llm.jaccard import _BYTE, _ODD, _WORD, _power

WINDOW, GRAM = 20, 4
#: Bytes of text that a task parses against itself at a time, and rows of an anchor from which on it is dealt by window.
CHUNK, HOT = 16 << 20, 5_000
_MASK = np.uint64((1 << 48) - 1)
_SPACES = bytes(range(9, 14))
_TO_SPACE = bytes.maketrans(_SPACES, b" " * len(_SPACES))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8."""
    return [w for w in (text or "").encode("utf-8", "replace").translate(_TO_SPACE).split(b" ") if w]


def _word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of all texts, and where each text's words begin (one more at the end)."""
    data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    edge = np.flatnonzero(np.diff(_WORD[data], prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    up, down = _power(len(data))
    run = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[:len(data)], out=run[1:])
    words = mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    lengths = np.array([len(r) + 1 for r in raw], dtype=np.int64)
    return words, np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))


def _anchors(words: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of one text only: where it starts, and its anchor's place and hash."""
    n = len(words) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    m = len(words) - GRAM + 1
    grams = words[:m] * _ODD[0]
    for k in range(1, GRAM):
        grams = grams + words[k:m + k] * _ODD[k]
    grams = mix(grams)
    least, wide, full = grams, 1, WINDOW - GRAM + 1  # the minimum over so many grams, doubled as long as it may be
    while 2 * wide <= full:
        least, wide = np.minimum(least[:-wide], least[wide:]), 2 * wide
    least = np.minimum(least[:n], least[full - wide:full - wide + n])
    place = np.full(n, full, dtype=np.int64)
    for k in range(full - 1, -1, -1):
        place[grams[k:k + n] == least] = k
    whole = np.ones(n, dtype=bool)
    for at in firsts[1:-1]:  # windows that run into the next text
        whole[max(0, at - WINDOW + 1):max(0, at)] = False
    start = np.flatnonzero(whole)
    return start, start + place[start], least[start]


def _windows(words: np.ndarray, start: np.ndarray) -> np.ndarray:
    """48 bits of each window's words."""
    up, down = _power(len(words) + 1)
    run = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(mix(words ^ _ODD[9]) * up[:len(words)], out=run[1:])
    return mix((run[start + WINDOW] - run[start]) * down[start]) & _MASK


def _runs(breaks: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs begin and how long they are, given that one begins at 0 and at each of breaks + 1."""
    begin = np.concatenate(([0], breaks + 1)) if n else np.zeros(0, np.int64)
    return begin, np.diff(np.append(begin, n))


class Passages:
    """Passages in document order: anchor, document (a number that rises in this order), start of the first window, its
    offset to the anchor and its windows, one after the other (count of each)."""

    def __init__(self, anchor, doc, start, offset, count, window):
        small = lambda x: x.astype(np.int32)
        self.anchor, self.doc, self.start, self.offset, self.count, self.window = anchor, small(doc), small(start), small(offset), small(count), window

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """The passage of each window, and its place in there."""
        row = np.repeat(np.arange(len(self.count), dtype=np.int32), self.count)
        return row, np.arange(len(row), dtype=np.int32) - np.repeat((np.cumsum(self.count) - self.count).astype(np.int32), self.count)

    def repeated(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each window repeats an earlier one, and the document and start of the first such."""
        row, within = self.places()
        start = self.start[row] + within
        found, from_doc, from_start = np.zeros(len(row), dtype=bool), self.doc[row], start.copy()
        order = np.argsort(self.anchor, kind="stable")
        same = self.anchor[order][1:] == self.anchor[order][:-1]
        several = np.zeros(len(order), dtype=bool)
        several[order[1:][same]] = several[order[:-1][same]] = True
        at = np.flatnonzero(several[row])
        if len(at):
            anchor, offset, window = self.anchor[row[at]], self.offset[row[at]] - within[at], self.window[at]
            with np.errstate(over="ignore"):
                key = mix(anchor + window * _ODD[3] + offset.astype(np.uint64) * _ODD[4])
            by = np.argsort(key, kind="stable")
            differs = np.ones(len(by), dtype=bool)
            a, b = by[1:], by[:-1]
            differs[1:] = (key[a] != key[b]) | (anchor[a] != anchor[b]) | (offset[a] != offset[b]) | (window[a] != window[b])
            first = by[np.flatnonzero(differs)][np.cumsum(differs) - 1]
            d, s = self.doc[row[at]], start[at]
            hit = (d[by] != d[first]) | (s[by] != s[first])
            to = at[by[hit]]
            found[to], from_doc[to], from_start[to] = True, d[first[hit]], s[first[hit]]
        return found, from_doc, from_start


def _pieces(p: Passages, found: np.ndarray, from_doc: np.ndarray, from_start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows of a passage that repeat with one distance to where they were found, and of windows that don't:
    first window, passage, count, whether they repeat."""
    row, within = p.places()
    away = np.where(found, from_start - p.start[row] - within, 0)
    same = (row[1:] == row[:-1]) & (found[1:] == found[:-1]) & (away[1:] == away[:-1]) & (~found[1:] | (from_doc[1:] == from_doc[:-1]))
    begin, count = _runs(np.flatnonzero(~same), len(row))
    return begin, row[begin], within[begin], count, found[begin]


#: Rows between tasks are kept small: at is start * 256 + offset to the anchor, what holds 6 bytes a window. A factor that
#: is known already has at -1 - start, and in what its length and source.
_SENT = pa.schema([("anchor", pa.int64()), ("d", pa.int64()), ("z", pa.int32()), ("tie", pa.int64()), ("at", pa.int64()), ("what", pa.binary())])
_DDL = "anchor long, d long, z int, tie long, at long, what binary"
_FACTOR = np.dtype([("length", "<i8"), ("from_z", "<i8"), ("from_d", "<i8"), ("from_tie", "<i8"), ("from_start", "<i8")])
_FOUND = ["z", "d", "tie", "start", "length", "from_z", "from_d", "from_tie", "from_start"]
_FOUND_DDL = "z int, d long, tie long, start int, length int, from_z int, from_d long, from_tie long, from_start int"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], list[bytes]]]:
    """Documents in order of (z, d, tie), some megabytes at a time."""
    held: list[tuple[int, int, int, bytes]] = []
    size = 0

    def out() -> tuple[list[np.ndarray], list[bytes]]:
        held.sort(key=lambda x: x[:3])
        keys = [np.array([x[i] for x in held], dtype=np.int64) for i in range(3)]
        return keys, [x[3] for x in held]

    for b in batches:
        for z, d, tie, text in zip(*(b.column(i).to_pylist() for i in range(4))):
            raw = (text or "").encode("utf-8", "replace")
            held.append((z, d, tie, raw))
            size += len(raw)
            if size > CHUNK:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def _parts(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """About a megabyte of texts at a time, or one longer text: the first one's number, word hashes, their bounds."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) < 1 << 20):
            size += len(texts[stop]) + 1
            stop += 1
        yield (at, *_word_hashes(texts[at:stop]))
        at = stop


def _passages(texts: list[bytes], hot: np.ndarray) -> Passages:
    """The passages of texts; those of hot anchors are cut into single windows with an anchor of their own."""
    got: list[tuple] = []
    with np.errstate(over="ignore"):
        for first, words, firsts in _parts(texts):
            start, place, anchor = _anchors(words, firsts)
            if not len(start):
                continue
            window = _windows(words, start)
            begin, count = _runs(np.flatnonzero((place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)), len(start))
            offset = (place - start)[begin]
            if len(hot):
                where = np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)
                alone = hot[where] == anchor
                if alone.any():
                    anchor = np.where(alone, mix(anchor + window * _ODD[5] + (place - start).astype(np.uint64) * _ODD[6]), anchor)
                    cut = np.flatnonzero((place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1) | alone[1:] | alone[:-1])
                    begin, count = _runs(cut, len(start))
                    offset = np.where(alone, 0, place - start)[begin]
            text = np.searchsorted(firsts, start[begin], side="right") - 1
            # empty texts share their bound with the next one: the last of equals holds the words
            got.append((anchor[begin], text + first, start[begin] - firsts[text], offset, count, window))
    if not got:
        zero = np.zeros(0, np.int64)
        return Passages(zero.astype(np.uint64), zero, zero, zero, zero, zero.astype(np.uint64))
    return Passages(*(np.concatenate(x) for x in zip(*got)))


def _six(window: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(window.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).reshape(-1)


def _unsix(raw: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    wide[:, :6] = raw.reshape(-1, 6)
    return wide.reshape(-1).view("<u8")


def _binaries(raw: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())])


def _joined(column: pa.ChunkedArray) -> bytes:
    """All values of a binary column, one after the other."""
    out = []
    for c in column.chunks:
        at = np.frombuffer(c.buffers()[1], dtype=np.int32)[c.offset:c.offset + len(c) + 1]
        out.append(c.buffers()[2].to_pybytes()[at[0]:at[-1]] if len(c) else b"")
    return b"".join(out)


def _send(hot: np.ndarray):
    """Each task's passages, less what repeats within a chunk, which is sent as factors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _chunks(batches):
            # rows that repeat id and text count as one document
            new = np.ones(len(texts), dtype=bool)
            new[1:] = (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1]) | (keys[2][1:] != keys[2][:-1])
            if not new.all():
                keys, texts = [k[new] for k in keys], [t for t, n in zip(texts, new.tolist()) if n]
            p = _passages(texts, hot)
            found, from_doc, from_start = p.repeated()
            first, row, within, count, hit = _pieces(p, found, from_doc, from_start)
            source = from_doc[first]
            known = np.zeros(len(first), dtype=_FACTOR)
            for name, x in (("length", count + WINDOW - 1), ("from_z", keys[0][source]), ("from_d", keys[1][source]), ("from_tie", keys[2][source]), ("from_start", from_start[first])):
                known[name] = x
            start, doc = p.start[row] + within, p.doc[row]
            with np.errstate(over="ignore"):
                spread = mix(first.astype(np.uint64) + p.anchor[row])
            columns = [np.where(hit, spread, p.anchor[row]).view(np.int64), keys[1][doc], keys[0][doc].astype(np.int32), keys[2][doc], np.where(hit, -1 - start, start.astype(np.int64) * 256 + p.offset[row] - within)]
            fresh, windows = np.flatnonzero(~hit), _six(p.window[np.repeat(~hit, count)])
            for some, what in ((fresh, _binaries(windows, count[fresh] * 6)), (np.flatnonzero(hit), _binaries(known[hit].view(np.uint8), np.full(int(hit.sum()), _FACTOR.itemsize)))):
                table = pa.Table.from_arrays([*(pa.array(c[some]) for c in columns), what], schema=_SENT)
                yield from table.to_batches(max_chunksize=20_000)

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Factors of passages against their block, which come in order of anchor and document; whole anchors at a time."""
    rest: pa.Table | None = None

    def factors(t: pa.Table) -> Iterator[pa.RecordBatch]:
        old = pc.less(t["at"], 0)
        ready, t = t.filter(old), t.filter(pc.invert(old)).combine_chunks()
        if ready.num_rows:
            known = np.frombuffer(_joined(ready["what"]), dtype=_FACTOR)
            columns = [ready["z"].combine_chunks(), ready["d"].combine_chunks(), ready["tie"].combine_chunks(), pa.array((-1 - ready["at"].to_numpy()).astype(np.int32)), *(pa.array(known[c].astype(t)) for c, t in (("length", np.int32), ("from_z", np.int32), ("from_d", np.int64), ("from_tie", np.int64), ("from_start", np.int32)))]
            yield pa.RecordBatch.from_arrays(columns, names=_FOUND)
        if not t.num_rows:
            return
        z, d, tie, at = (t[c].to_numpy().astype(np.int64) for c in ("z", "d", "tie", "at"))
        start, offset = at >> 8, at & 255
        window = _unsix(np.frombuffer(_joined(t["what"]), dtype=np.uint8))
        sizes = pc.binary_length(t["what"]).to_numpy() // 6
        anchor = t["anchor"].to_numpy().view(np.uint64)
        by = np.lexsort((tie, d, z))  # numbers for documents
        new = np.ones(len(by), dtype=bool)
        new[1:] = (z[by][1:] != z[by][:-1]) | (d[by][1:] != d[by][:-1]) | (tie[by][1:] != tie[by][:-1])
        doc = np.empty(len(by), dtype=np.int64)
        doc[by] = np.cumsum(new) - 1
        some = by[np.flatnonzero(new)]
        p = Passages(anchor, doc, start, offset, sizes.astype(np.int64), window)
        found, from_doc, from_start = p.repeated()
        first, row, within, count, hit = _pieces(p, found, from_doc, from_start)
        first, row, within, count = first[hit], row[hit], within[hit], count[hit]
        source = some[from_doc[first]]
        columns = [z[row].astype(np.int32), d[row], tie[row], (start[row] + within).astype(np.int32), (count + WINDOW - 1).astype(np.int32), z[source].astype(np.int32), d[source], tie[source], from_start[first].astype(np.int32)]
        if len(row):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=_FOUND)

    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        last = t["anchor"][t.num_rows - 1].as_py()
        full = int(np.searchsorted(t["anchor"].to_numpy(), last))  # the last anchor may go on
        if full:
            yield from factors(t.slice(0, full))
        rest = t.slice(full)
    if rest is not None and rest.num_rows:
        yield from factors(rest)


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors that a chunk has in many surroundings, and how often: all that are in a 100,000th of all passages are seen
    in some chunk, as they can't be below that share in each."""
    for _, texts in _chunks(batches):
        with np.errstate(over="ignore"):
            seen = [np.zeros(0, dtype=np.uint64)]
            for _, words, firsts in _parts(texts):
                start, place, anchor = _anchors(words, firsts)
                if len(start):
                    seen.append(anchor[_runs(np.flatnonzero(place[1:] != place[:-1]), len(start))[0]])
        anchor, n = np.unique(np.concatenate(seen), return_counts=True)
        often = n >= max(4, int(n.sum()) // 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(anchor[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["anchor", "n"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """z, d, tie, _text: what documents are ordered and told apart by; tie is 0 where ids are enough."""
    key = F.col(id_col).cast("long")
    unique = docs.groupBy(key.alias("d")).count().filter("count > 1 or d is null").isEmpty()
    tie = F.lit(0).cast("long") if unique else F.xxhash64(F.coalesce(text_col, F.lit("")))
    return docs.select(key.isNull().cast("int").alias("z"), F.coalesce(key, F.lit((1 << 63) - 1)).alias("d"), tie.alias("tie"), F.col(text_col).alias("_text"))


def _factors(keyed: DataFrame, hot_rows: int) -> DataFrame:
    spark = keyed.sparkSession
    counts = keyed.mapInArrow(_frequent, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    often = counts.filter(F.col("n") >= hot_rows).orderBy(F.desc("n")).limit(100_000)
    hot = np.sort(np.array([r.anchor for r in often.select("anchor").collect()], dtype=np.int64).view(np.uint64))
    sent = keyed.mapInArrow(_send(hot), _DDL)
    met = sent.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "anchor").sortWithinPartitions("anchor", "z", "d", "tie", "at")
    return met.mapInArrow(_meet, _FOUND_DDL)


def factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = HOT) -> DataFrame:
    """id_col, start, length (in words), from_id, from_start: factors of documents that copy earlier text, in pieces of
    one passage each; pieces of a document that follow one another at one distance make one factor."""
    f = _factors(_keyed(docs, id_col, text_col), hot_rows)
    return f.select(F.expr("if(z = 1, null, d)").alias(id_col), "start", "length", F.expr("if(from_z = 1, null, from_d)").alias("from_id"), "from_start")


def kept_words(text: str | None, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """How many words the text has, how many of them the spans (start, length) cover, and the others joined by spaces."""
    words = words_of(text)
    out, end = [], 0
    for a, n in sorted(spans):
        out += words[end:max(end, a)]
        end = max(end, a + n)
    out += words[end:]
    return len(words), len(words) - len(out), b" ".join(out)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = HOT, texts: bool = False) -> DataFrame:
    """id_col, n_words, n_removed, kept_sha256 (and kept, where texts are asked for) of each row of docs."""
    keyed = _keyed(docs, id_col, text_col)
    pieces = _factors(keyed, hot_rows).select("z", "d", "tie", F.struct("start", "length").alias("span"))
    spans = pieces.groupBy("z", "d", "tie").agg(F.collect_list("span").alias("spans"))
    joined = keyed.join(spans, ["z", "d", "tie"], "left").select(F.expr("if(z = 1, null, d)").alias(id_col), "_text", "spans.start", "spans.length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [kept_words(t, list(zip(s or (), n or ()))) for t, s, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist())]
            more = [pa.array([g[2].decode("utf-8", "replace") for g in got], pa.string())] if texts else []
            columns = [b.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([hashlib.sha256(g[2]).hexdigest() for g in got], pa.string()), *more]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "n_removed", "kept_sha256", *["kept"] * texts])

    return joined.mapInArrow(run, f"`{id_col}` long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts)
