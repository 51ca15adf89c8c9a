"""Exact set-similarity join of word 5-gram sets, with connected components, for whole corpora.

Sets. Texts become sets of 64-bit shingle hashes, in numpy over whole batches. Documents with equal sets share one
signature; all further work is on signatures.

Order. A count sketch of fixed size tells common shingles from rare ones; a set's elements are ordered rare first. Two
sets with intersection * 100 >= union * 80 have a common element within the first n - ceil(0.8 n) + 1 of both, and for
the first such element at positions i and j, n_x - i and n_y - j are at least the overlap needed: lists skip by
position whatever cannot reach it.

Index. Prefix elements travel in packed blocks, by ranges of hash values; elements that one set alone has fall out
there. Elements that the sketch knows to be common skip this step and are spread by signature.

Answers. In each list the most central set (the one with the largest share of elements that others have as well) is
compared with the others first. Sets then form stars around the sets with the most links. In a star, a set's answers
are derived from its centre's: by the triangle inequality two sets within Jaccard distance 0.1 of the centre are linked,
and for other pairs the overlap follows from their differences from the centre, |c| - |c - x| - |c - y| + |Dx n Dy|,
where D is the symmetric difference with c. Only lists that hold several stars are read again: they travel in blocks by
size and position, a pair of blocks is skipped where no position in it leaves room for the overlap needed, and pairs of
different stars that are left are verified on the whole sets. Links between stars make components.

Skew. Equal texts share one set and are counted by weight. Joins deal the rows of hot keys over parts; hot lists and
stars are cut into blocks of bounded size, which meet block by block.

Cases: a null or empty text, or one of white space, has an empty set and is linked with nothing; a text of one to four
words is one shingle; repeated rows and equal texts share a set and a component; an id that repeats with different
texts has a row for each; a null id keeps its row, and never becomes a component's id (which is null only if all ids of
the component are); ties at exactly 80 % link; an empty table gives an empty table; other columns are ignored. Nothing
is capped, sampled or dropped; only filters by hashed id (which let more pass, never less), the sketch and hot keys
(fewer than 100,000) are sent to all tasks, and their sizes are bounded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm.common import batches_of, hot_keys, mix, salted_join, saved

WORDS = 5
#: Counters of the sketch (2**SKETCH, one byte each when sent), and bits of the filter by id (2**FILTER).
SKETCH, FILTER, PART = 22, 24, 1 << 16
_ODD = mix(np.arange(1, 16, dtype=np.uint64)) | np.uint64(1)
_BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, dtype=bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse modulo 2**64, for i up to n."""
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, 1 << 20)
        for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, b, dtype=np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    at = 0
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    while at < len(raw):  # about 1 MB at a time, or one longer text
        stop, size = at, 0
        while stop < len(raw) and (stop == at or size + len(raw[stop]) < 1 << 20):
            size += len(raw[stop]) + 1
            stop += 1
        out += _sets(raw[at:stop])
        at = stop
    return out


def _sets(raw: list[bytes]) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    lengths = np.array([len(r) + 1 for r in raw], dtype=np.int64)
    inside = _WORD[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    up, down = _power(len(data))
    with np.errstate(over="ignore"):
        run = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[_LOWER[data]] * up[:len(data)], out=run[1:])
        words = mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        firsts = np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))  # of each document's words
        many = len(words)
        if many >= WORDS:
            span = many - WORDS + 1
            grams = words[:span] * _ODD[0]
            for k in range(1, WORDS):
                grams = grams + words[k:span + k] * _ODD[k]
            grams = mix(grams)
        out = []
        for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
            n = b - a
            if n >= WORDS:
                g = np.sort(grams[a:b - WORDS + 1])
                out.append(g[np.concatenate(([True], g[1:] != g[:-1]))])
            elif n:
                out.append(mix((words[a:b] * _ODD[8:8 + n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
    return out


def signature(s: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    with np.errstate(over="ignore"):
        total = mix(s ^ _ODD[13]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(s))
        return int(mix(total).view(np.int64)[0])


def needed(a: Column, b: Column) -> Column:
    """The least intersection of linked sets of sizes a and b."""
    return F.floor((4 * (a + b) + 8) / 9)


def _profiles(docs: DataFrame) -> DataFrame:
    """A row a document (doc, n, sig), and for each task its sketch in parts (part, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, held, size = np.zeros(1 << SKETCH, dtype=np.int32), set(), [], 0
        none = lambda n, kind: pa.nulls(n, kind)
        names = ["doc", "n", "sig", "part", "counts"]
        for b in batches:
            sets = shingle_sets(b.column(1).to_pylist())
            sigs = [signature(s) for s in sets]
            for s, g in zip(sets, sigs):
                if g not in seen:
                    seen.add(g)
                    held.append(s)
                    size += len(s)
            if size > 1 << 20:
                np.add.at(counts, (np.concatenate(held) & np.uint64((1 << SKETCH) - 1)).view(np.int64), 1)
                held, size = [], 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.int64()), none(len(sets), pa.int32()), none(len(sets), pa.binary())], names=names)
        if held:
            np.add.at(counts, (np.concatenate(held) & np.uint64((1 << SKETCH) - 1)).view(np.int64), 1)
        parts = np.minimum(counts, 255).astype(np.uint8).reshape(-1, PART)
        used = np.flatnonzero(parts.any(axis=1)).tolist()
        yield pa.RecordBatch.from_arrays([none(len(used), pa.int64()), none(len(used), pa.int64()), none(len(used), pa.int64()), pa.array(used, pa.int32()), pa.array([zlib.compress(parts[i].tobytes(), 1) for i in used], pa.binary())], names=names)

    return docs.mapInArrow(run, "doc long, n long, sig long, part int, counts binary")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of compressed byte counters by part, of which a partition has all rows."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for part, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x = np.frombuffer(zlib.decompress(c), dtype=np.uint8).astype(np.int64)
            total[part] = total[part] + x if part in total else x
    # half powers of two, in which order only rises from twice the average load on
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.astype("<i4").tobytes(), 1) for x in total.values()], pa.binary())], names=["part", "counts"])


def _classes(profiles: DataFrame) -> tuple[np.ndarray, int]:
    """How common each counter's shingles are (bytes), and from which class on they are common for sure."""
    summed = profiles.filter("part is not null").select("part", "counts").repartition("part").mapInArrow(_summed, "part int, counts binary")
    counts = np.zeros((1 << SKETCH) // PART * PART, dtype=np.int64).reshape(-1, PART)
    for r in summed.collect():  # of fixed size
        counts[r["part"]] = np.frombuffer(zlib.decompress(bytes(r["counts"])), dtype="<i4")
    counts = counts.reshape(-1)
    load = max(1.0, float(counts.mean()))
    level = np.floor(2 * np.log2(np.maximum(counts - load, 1)))
    return level.astype(np.uint8), int(2 * np.log2(8 * load + 64))


def _prefixes(docs: DataFrame, classes, common: int, ranges: int) -> DataFrame:
    """Packed blocks of prefix elements by range; common elements are spread by signature over ranges above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = classes.value, set()
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                keys, sigs, ns, places = [], [], [], []
                for s in shingle_sets(whole.column(1).slice(at, 4000).to_pylist()):
                    n = len(s)
                    if not n or (g := signature(s)) in seen:
                        continue
                    seen.add(g)
                    level = table[(s & np.uint64((1 << SKETCH) - 1)).view(np.int64)]
                    order = np.argsort((level.astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8)), kind="stable")[:n - -(-4 * n // 5) + 1]
                    r = (s[order] >> np.uint64(32)) % np.uint64(ranges)
                    r[level[order] >= common] = ranges + g % ranges
                    keys.append(np.stack([r, s[order]]))
                    sigs.append(g)
                    ns.append(n)
                    places.append(len(order))
                if not keys:
                    continue
                r, s = np.concatenate(keys, axis=1)
                doc = np.repeat(np.arange(len(sigs)), places)
                pos = np.arange(len(doc)) - np.repeat(np.cumsum(places) - places, places)
                by = np.argsort(r, kind="stable")
                cuts = np.flatnonzero(np.diff(r[by])) + 1
                sig, n = np.array(sigs, dtype=np.int64), np.array(ns, dtype=np.int32)
                rows = []
                for part in np.split(by, cuts):
                    own, local = np.unique(doc[part], return_inverse=True)
                    hot = r[part[0]] >= ranges
                    tokens = s[part] if hot else s[part].astype(np.uint32)
                    rows.append((int(r[part[0]]), tokens.tobytes(), local.astype(np.uint16).tobytes(), pos[part].astype(np.uint32).tobytes(), sig[own].tobytes(), n[own].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), *[pa.binary()] * 5])], names=["r", "tokens", "local", "pos", "sig", "n"])

    return docs.mapInArrow(run, "r int, tokens binary, local binary, pos binary, sig binary, n binary")


def _lists(blocks: DataFrame, ranges: int) -> DataFrame:
    """token, sig, n, pos: elements of inverted lists, without elements that a single set has."""

    def out(token: np.ndarray, sig: np.ndarray, n: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(token.astype(np.int64)), pa.array(sig), pa.array(n.astype(np.int32)), pa.array(pos.astype(np.int32))], names=["token", "sig", "n", "pos"])

    def flush(r: int, held: list) -> Iterator[pa.RecordBatch]:
        token, sig, n, pos = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((sig, token))
        token, sig, n, pos = token[order], sig[order], n[order], pos[order]
        new = np.concatenate(([True], (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])))
        token, sig, n, pos = token[new], sig[new], n[new], pos[new]
        same = token[1:] == token[:-1]
        shared = np.concatenate((same, [False])) | np.concatenate(([False], same))
        yield out(token[shared].astype(np.int64) | (r << 32), sig[shared], n[shared], pos[shared])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for b in batches:
            for r, tokens, local, pos, sig, n in zip(*(c.to_pylist() for c in b.columns)):
                if r != now and held:
                    yield from flush(now, held)
                    held = []
                now = r
                at = np.frombuffer(local, dtype=np.uint16)
                rest = np.frombuffer(sig, dtype=np.int64)[at], np.frombuffer(n, dtype=np.int32)[at], np.frombuffer(pos, dtype=np.uint32)
                if r >= ranges:
                    yield out(np.frombuffer(tokens, dtype=np.int64) | np.int64(-(1 << 63)), *rest)
                else:
                    held.append((np.frombuffer(tokens, dtype=np.uint32), *rest))
        if held:
            yield from flush(now, held)

    return blocks.repartition("r").sortWithinPartitions("r").mapInArrow(run, "token long, sig long, n int, pos int")


def _fits(a: str, b: str) -> Column:
    """Whether two elements of a list, as the first common ones, leave room for the overlap needed."""
    least = needed(F.col(f"n_{a}"), F.col(f"n_{b}"))
    return (F.col(f"n_{a}") - F.col(f"pos_{a}") >= least) & (F.col(f"n_{b}") - F.col(f"pos_{b}") >= least)


def _filter_bits(ids: DataFrame) -> np.ndarray:
    """A filter of 2**FILTER bits (or fewer) by hashed id, of which the driver gets 2 MB at most."""
    width = 1 << (FILTER - 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER, dtype=bool)
        for b in batches:
            bits[_slot(b.column(0).to_numpy())] = True
        parts = np.packbits(bits).reshape(-1, PART)
        used = np.flatnonzero(parts.any(axis=1)).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([zlib.compress(parts[i].tobytes(), 1) for i in used], pa.binary())], names=["part", "bits"])

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for part, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(zlib.decompress(c), dtype=np.uint8)
                total[part] = total[part] | x if part in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], names=["part", "bits"])

    bits = np.zeros((width // PART, PART), dtype=np.uint8)
    got = ids.mapInArrow(run, "part int, bits binary").repartition("part").mapInArrow(union, "part int, bits binary")
    for r in got.collect():  # 2 MB at most
        bits[r["part"]] = np.frombuffer(zlib.decompress(bytes(r["bits"])), dtype=np.uint8)
    return np.unpackbits(bits.reshape(-1)).astype(bool)


def _slot(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(ids.astype(np.int64).view(np.uint64) + _ODD[11]) >> np.uint64(64 - FILTER)).view(np.int64)


def _verified(docs: DataFrame, pairs: DataFrame, firsts: DataFrame) -> DataFrame:
    """The linked pairs (a, b) of set hashes, with how many elements only one has (only_a, only_b), and those (d)."""
    ids = saved(pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct().join(firsts.select("sig", "doc"), "sig"), "jaccard-ids")
    bits = docs.sparkSession.sparkContext.broadcast(np.packbits(_filter_bits(ids.filter("doc is not null").select("doc"))))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.unpackbits(bits.value).astype(bool)
        for whole in batches:
            none = whole.column(0).is_null().to_numpy(zero_copy_only=False)
            whole = whole.filter(pa.array(none | have[_slot(whole.column(0).fill_null(0).to_numpy())]))
            for at in range(0, whole.num_rows, 2000):
                got = shingle_sets(whole.column(1).slice(at, 2000).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([signature(s) for s in got], pa.int64()), pa.array([s.tobytes() for s in got], pa.binary())], names=["sig", "s"])

    whole = docs.mapInArrow(sets, "sig long, s binary").join(ids.select("sig"), "sig", "left_semi").dropDuplicates(["sig"])
    whole = saved(whole, "jaccard-sets")
    met = pairs
    for end, other in ("ab", "ba"):
        met = salted_join(met, whole.select(F.col("sig").alias(end), F.col("s").alias(f"s_{end}")), end, other, hot_keys(pairs, end))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for a, z, x, y in zip(*(b.column(c) for c in ("a", "b", "s_a", "s_b"))):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                same = both[1:] == both[:-1]
                common = int(same.sum())
                if 180 * common >= 80 * (len(x) + len(y)):
                    twice = np.concatenate((same, [False])) | np.concatenate(([False], same))
                    rows.append((a.as_py(), z.as_py(), len(x) - common, len(y) - common, both[~twice].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, [*[pa.int64()] * 4, pa.binary()])], names=["a", "b", "only_a", "only_b", "d"])

    return met.select("a", "b", "s_a", "s_b").mapInArrow(compare, "a long, b long, only_a long, only_b long, d binary")


def _stars(links: DataFrame) -> DataFrame:
    """sig, star: linked sets with a star's centre; centres have more links than all sets linked to them, and a set
    without a linked centre is a star alone."""
    both = saved(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")), "star-links")
    degree = saved(both.groupBy("u").agg(F.count("*").alias("k")), "star-degrees")
    hot = hot_keys(both, "v")
    far = lambda rows: salted_join(both, rows.select(F.col("u").alias("v"), F.struct("k", F.col("u").alias("s")).alias("x")), "v", "u", hot).groupBy("u").agg(F.max("x").alias("x"))
    centres = saved(degree.join(far(degree), "u").filter(F.struct("k", F.col("u").alias("s")) > F.col("x")).select("u", "k"), "star-centres")
    joined = degree.select("u").join(far(centres), "u", "left")
    return joined.join(centres.select("u", F.lit(True).alias("c")), "u", "left").select(F.col("u").alias("sig"), F.when(F.col("c"), F.col("u")).otherwise(F.coalesce("x.s", "u")).alias("star"))


#: Members of a block of a star, elements of a block of a list, columns of a matrix of differences, rows of a batch.
MEMBERS, ELEMENTS, COLUMNS, BATCH = 256, 512, 512, 1000


def _side(blocks: DataFrame, keys: list[str]) -> Column:
    return F.struct(*[c for c in blocks.columns if c not in keys and c != "parts"])


def _met(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of blocks x and y (structs) of one key, each once; a key with many blocks is spread over tasks."""
    rest = _side(blocks, keys)
    one = blocks.select(*keys, F.col("part").alias("_p"), rest.alias("x"))
    two = blocks.select(*keys, F.explode(F.sequence(F.lit(0), F.col("part"))).alias("_p"), rest.alias("y"))
    return one.join(two, [*keys, "_p"]).drop("_p")


def _within(links: DataFrame, stars: DataFrame, firsts: DataFrame) -> DataFrame:
    """sig, near (documents linked within its star, as far as known without comparing), then more rows from comparing."""
    edge = links.join(stars.select(F.col("sig").alias("a"), F.col("star").alias("star_a")), "a").join(stars.select(F.col("sig").alias("b"), F.col("star").alias("star_b")), "b")
    edge = edge.filter((F.col("star_a") == F.col("star_b")) & ((F.col("a") == F.col("star_a")) | (F.col("b") == F.col("star_a"))))
    first = F.col("a") == F.col("star_a")  # the centre is a
    members = edge.select(F.col("star_a").alias("star"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("sig"), F.when(first, F.col("only_a")).otherwise(F.col("only_b")).alias("gone"), "d")
    centres = members.select("star").distinct().select("star", F.col("star").alias("sig"), F.lit(0).cast("long").alias("gone"), F.lit(b"").alias("d"))
    members = members.unionByName(centres).join(firsts.select("sig", "n", "w"), "sig")
    size = F.octet_length("d") / 8
    members = saved(members.withColumn("far", 10 * size > F.col("n") + F.col("gone")), "star-members")  # |x u c| = |x| + |c - x|
    counts = members.groupBy("star").agg(F.sum(F.when(~F.col("far"), F.col("w")).otherwise(0)).alias("w_near"), F.count_if("far").alias("far_"), F.count_if(~F.col("far")).alias("near_"), F.max(F.when(F.col("sig") == F.col("star"), F.col("n"))).alias("n_c"))
    known = salted_join(members, saved(counts, "star-counts"), "star", "sig", hot_keys(members, "star"))
    known = known.withColumns({"fars": F.ceil(F.col("far_") / MEMBERS), "nears": F.ceil(F.col("near_") / MEMBERS)})
    near = known.filter("not far").select("sig", (F.col("w_near") - F.col("w")).alias("more"))
    # near sets need no comparing with each other: far blocks meet far blocks, and are copied to each near block
    part = F.pmod(F.xxhash64("sig"), F.when(F.col("far"), F.col("fars")).otherwise(F.col("nears"))).cast("int")
    blocks = known.filter("far_ > 0").withColumn("part", part).groupBy("star", "far", "part").agg(F.first("n_c").alias("n_c"), F.first("nears").cast("int").alias("parts"), F.collect_list(F.struct("sig", "n", "w", "gone", "d")).alias("m"))
    blocks = saved(blocks, "star-blocks")
    far = blocks.filter("far")
    copied = far.select("star", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), _side(far, ["star"]).alias("y"))
    met = blocks.filter("not far").select("star", "part", _side(blocks, ["star"]).alias("x")).join(copied, ["star", "part"]).select("x", "y")
    met = met.unionByName(_met(far, ["star"]).select("x", "y"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (_Lists(b.column(i), "m") for i in (0, 1))
            centre, part = b.column(0).field("n_c").to_numpy(), [b.column(i).field("part").to_numpy() for i in (0, 1)]
            far = b.column(0).field("far").to_pylist()  # the second one always is
            for i in range(b.num_rows):
                one, two = x.row(i, "sig", "n", "w", "gone"), y.row(i, "sig", "n", "w", "gone")
                shared = _common(x.binary(i, "d"), y.binary(i, "d"))
                linked = 180 * (centre[i] - one[3][:, None] - two[3][None, :] + shared) >= 80 * (one[1][:, None] + two[1][None, :])
                if far[i] and part[0][i] == part[1][i]:
                    np.fill_diagonal(linked, False)
                    sig, more = one[0], linked @ one[2]
                else:
                    sig, more = np.concatenate((one[0], two[0])), np.concatenate((linked @ two[2], linked.T @ one[2]))
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(more)], names=["sig", "more"])

    return near.unionByName(met.select("x", "y").mapInArrow(compare, "sig long, more long"))


class _Lists:
    """Rows of a column of blocks (structs), whose field holds a list of structs, as numpy arrays."""

    def __init__(self, blocks: pa.StructArray, field: str):
        lists = blocks.field(field)
        self.cuts, self.values = lists.offsets.to_numpy(), lists.values
        self.held: dict[str, np.ndarray] = {}

    def row(self, i: int, *names: str) -> list[np.ndarray]:
        for n in names:
            if n not in self.held:
                self.held[n] = self.values.field(n).to_numpy(zero_copy_only=False).astype(np.int64)
        return [self.held[n][self.cuts[i]:self.cuts[i + 1]] for n in names]

    def binary(self, i: int, name: str) -> tuple[np.ndarray, np.ndarray]:
        """The 64-bit elements of a list's binaries, one after the other, and how many each has."""
        v = self.values.field(name)
        _, offsets, data = v.buffers()
        cuts = np.frombuffer(offsets, dtype=np.int32)[v.offset + self.cuts[i]:v.offset + self.cuts[i + 1] + 1]
        raw = np.frombuffer(data or b"", dtype=np.uint8)[cuts[0]:cuts[-1]]
        return np.frombuffer(raw.tobytes(), dtype=np.uint64), np.diff(cuts) // 8


def _common(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many elements the sets of one have in common with the sets of two; sets as elements in a row and their sizes."""
    flat = one[0], two[0]
    owner = [np.repeat(np.arange(len(side[1])), side[1]) for side in (one, two)]
    both = np.intersect1d(*flat)
    out = np.zeros((len(one[1]), len(two[1])), dtype=np.int32)
    at = [np.searchsorted(both, f) for f in flat]
    hit = [(a < len(both)) & (both[np.minimum(a, len(both) - 1)] == f) if len(both) else np.zeros(len(f), dtype=bool) for a, f in zip(at, flat)]
    for low in range(0, len(both), COLUMNS):
        sides = []
        for k, rows in enumerate((len(one[1]), len(two[1]))):
            here = hit[k] & (at[k] >= low) & (at[k] < low + COLUMNS)
            m = np.zeros((rows, min(COLUMNS, len(both) - low)), dtype=np.int32)  # integers need no library's buffers
            m[owner[k][here], at[k][here] - low] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _across(lists: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets of different stars that meet in a list and have room for the overlap needed."""
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25))).cast("int")
    band = F.floor(F.log2(F.col("pos") + 1.0)).cast("int")  # positions of one block are alike
    spread = lists.withColumns({"size": size, "band": band}).withColumn("size", F.explode(F.array("size", F.col("size") + 1)))  # linked sets' sizes differ by 1.25 at most
    counts = spread.groupBy("token", "size").agg(F.count("*").alias("k"), F.min("star").alias("low"), F.max("star").alias("high"), F.min("n").alias("n_least")).filter("low <> high").select("token", "size", "n_least", F.ceil(F.col("k") / ELEMENTS).alias("slots"))
    # what has no room for the overlap even with the list's smallest set is skipped before any copy
    placed = spread.join(saved(counts, "list-counts"), ["token", "size"]).filter(F.col("n") - F.col("pos") >= needed(F.col("n"), F.col("n_least"))).withColumn("slot", F.pmod(F.xxhash64("sig"), F.col("slots")))
    # a large star's members are in blocks of their own, which needn't meet each other
    own = F.when(F.col("large"), F.col("star")).otherwise(0)
    packed = placed.groupBy("token", "size", "band", "slot", own.alias("own")).agg(F.max(F.col("n") - F.col("pos")).alias("reach"), F.min("n").alias("least"), F.collect_list(F.struct("sig", "n", "pos", "star")).alias("e"))
    order = F.row_number().over(Window.partitionBy("token", "size").orderBy("own", "band", "slot")) - 1
    met = _met(saved(packed.withColumn("part", order).select("token", "size", "part", "own", "reach", "least", "e"), "list-blocks"), ["token", "size"])
    room = needed(F.col("x.least"), F.col("y.least"))
    met = met.filter((F.col("x.reach") >= room) & (F.col("y.reach") >= room) & ((F.col("x.own") == 0) | (F.col("x.own") != F.col("y.own"))))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, found, size = _Lists(b.column(0), "e"), _Lists(b.column(1), "e"), [], 0
            for at in range(b.num_rows):
                one, two = (side.row(at, "sig", "n", "pos", "star") for side in (x, y))
                need = (4 * (one[1][:, None] + two[1][None, :]) + 8) // 9
                ok = (one[3][:, None] != two[3][None, :]) & ((one[1] - one[2])[:, None] >= need) & ((two[1] - two[2])[None, :] >= need)
                i, j = np.nonzero(ok)
                if len(i):
                    found.append(np.stack((np.minimum(one[0][i], two[0][j]), np.maximum(one[0][i], two[0][j])), axis=1))
                    size += len(i)
                if size > 1 << 18:
                    got = np.unique(np.concatenate(found), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])
                    found, size = [], 0
            if found:
                got = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

    return met.select("x", "y").mapInArrow(pairs, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node that each linked node reaches. Labels pass along links and jump, round by round."""
    both = saved(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct(), "component-links")
    label = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "component-labels")
    hot = hot_keys(both, "v")
    while True:
        near = salted_join(both, label.select(F.col("u").alias("v"), F.col("m").alias("x")), "v", "u", hot).groupBy("u").agg(F.min("x").alias("x"))
        low = label.join(near, "u").select("u", F.col("m").alias("old"), F.least("m", "x").alias("m"))
        up = label.select(F.col("u").alias("m"), F.col("m").alias("x"))
        low = saved(low, "component-lows")  # a large component's rows have one label: they are dealt
        new = saved(salted_join(low, up, "m", "u", hot_keys(low, "m"), "left").select("u", "old", F.least("m", F.coalesce("x", "m")).alias("m")), "component-labels")
        if new.filter("m <> old").isEmpty():
            return new.select(F.col("u").alias("node"), F.col("m").alias("label"))
        label = new.select("u", "m")


def _classes_of(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """What `_joined` gives, computed in small batches."""
    with batches_of(docs.sparkSession, BATCH):
        return _joined(docs, id_col, text_col)


def _joined(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc, n, sig) of each row, and sig, n, doc (the smallest), w (rows), comp (the component's hash), links of each set."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    profiles = saved(_profiles(base), "jaccard-profiles")
    each = profiles.filter("part is null").select("doc", "n", "sig")
    total = each.agg(F.sum("n")).first()[0] or 0
    level, common = _classes(profiles)
    classes = spark.sparkContext.broadcast(level)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 2_500_000 + 1)
    firsts = saved(each.filter("n > 0").groupBy("sig", "n").agg(F.min("doc").alias("doc"), F.count("*").alias("w")), "jaccard-firsts")
    lists = saved(_lists(_prefixes(base, classes, common, ranges), ranges), "jaccard-lists")

    # the most central set of each list first
    share = lists.groupBy("sig", "n").agg(F.count("*").alias("c")).select("sig", "n", (F.col("c") / (F.col("n") - F.ceil(F.col("n") * 0.8) + 1)).alias("c"))
    ranked = lists.join(share, ["sig", "n"])
    heads = ranked.groupBy("token").agg(F.max(F.struct("c", "n", "sig", "pos")).alias("h"), F.count("*").alias("k")).filter("k > 1")
    heads = saved(heads.select("token", "k", F.col("h.sig").alias("sig_b"), F.col("h.n").alias("n_b"), F.col("h.pos").alias("pos_b")), "jaccard-heads")
    many = lists.select("token", *[F.col(c).alias(f"{c}_a") for c in ("sig", "n", "pos")])
    near = salted_join(many, heads.drop("k"), "token", "sig_a", hot_keys(lists, "token")).filter((F.col("sig_a") != F.col("sig_b")) & _fits("a", "b"))
    tried = saved(near.select(F.least("sig_a", "sig_b").alias("a"), F.greatest("sig_a", "sig_b").alias("b")).distinct(), "jaccard-tried")
    links = saved(_verified(base, tried, firsts), "jaccard-links")
    stars = saved(_stars(links), "jaccard-stars")

    # lists that hold several stars are read again
    large = stars.groupBy("star").agg((F.count("*") > ELEMENTS).alias("large"))
    known = lists.join(stars.join(large.filter("large"), "star", "left"), "sig", "left").withColumns({"star": F.coalesce("star", "sig"), "large": F.coalesce("large", F.lit(False))})
    more = saved(_across(known).join(tried, ["a", "b"], "left_anti"), "jaccard-more")
    found = links.select("a", "b")
    if not more.isEmpty():
        found = found.unionByName(_verified(base, more, firsts).select("a", "b"))
    end = lambda x: stars.select(F.col("sig").alias(x), F.col("star").alias(f"star_{x}"))
    found = found.join(end("a"), "a", "left").join(end("b"), "b", "left").withColumns({"star_a": F.coalesce("star_a", "a"), "star_b": F.coalesce("star_b", "b")})
    across = saved(found.filter("star_a <> star_b"), "jaccard-across")
    label = components(across.select(F.col("star_a").alias("a"), F.col("star_b").alias("b"))).withColumnRenamed("node", "star")

    weight = firsts.select("sig", "w")
    to = lambda x, y: across.select(F.col(x).alias("to"), F.col(y).alias("sig"))
    both = to("a", "b").unionByName(to("b", "a"))
    met = salted_join(both, weight, "sig", "to", hot_keys(both, "sig")).select(F.col("to").alias("sig"), F.col("w").alias("more"))
    counts = saved(met.unionByName(_within(links, stars, firsts)).groupBy("sig").agg(F.sum("more").alias("more")), "jaccard-counts")
    sets = firsts.join(stars, "sig", "left").withColumn("star", F.coalesce("star", "sig")).join(counts, "sig", "left")
    sets = salted_join(sets, label, "star", "sig", hot_keys(stars, "star"), "left")
    return each, saved(sets.select("sig", "n", "doc", "w", F.coalesce("label", "star").alias("comp"), (F.coalesce("more", F.lit(0)) + F.col("w") - 1).alias("links")), "jaccard-classes")


def similarity_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id (the smallest id reachable by links), set_id (the smallest id with equal set),
    n_links (other rows that the row is linked with)."""
    each, sets = _classes_of(docs, id_col, text_col)
    comps = saved(sets.groupBy("comp").agg(F.min("doc").alias("component")), "jaccard-components")
    named = salted_join(sets, comps, "comp", "sig", hot_keys(sets, "comp"))
    out = salted_join(each.filter("n > 0"), named.select("sig", F.col("doc").alias("first"), "component", "links"), "sig", "doc", hot_keys(each, "sig"))
    out = out.unionByName(each.filter("n = 0").withColumns({"first": F.col("doc"), "component": F.col("doc"), "links": F.lit(0).cast("long")}))
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("first").alias("set_id"), F.col("links").alias("n_links"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component (with its smallest id; any one of rows that repeat that id and set), and all
    rows with an empty set; all columns as they are."""
    each, sets = _classes_of(docs, id_col, text_col)
    chosen = sets.groupBy("comp").agg(F.min(F.struct(F.isnull("doc").alias("none"), "doc", "sig")).alias("x")).select("x.doc", "x.sig")
    keep = saved(chosen.unionByName(each.filter("n = 0").select("doc", "sig")), "jaccard-kept")
    odd = saved(each.groupBy("doc").count().filter("count > 1 or doc is null").select(F.col("doc").alias("_odd")), "jaccard-odd")
    key = F.col(id_col).cast("long")
    if odd.isEmpty():
        return docs.join(keep.select(F.col("doc").alias("_kept")), key == F.col("_kept"), "left_semi")

    names = [*docs.columns, "_n", "_set"]

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = shingle_sets(b.column(names.index(text_col)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(s) for s in got], pa.int64()), pa.array([signature(s) for s in got], pa.int64())], names=names)

    plain = keep.join(odd, F.col("doc").eqNullSafe(F.col("_odd")), "left_anti")
    once = docs.join(plain.select(F.col("doc").alias("_kept")), key == F.col("_kept"), "left_semi")
    mixed = docs.join(odd, key.eqNullSafe(F.col("_odd")), "left_semi")
    mixed = mixed.mapInArrow(profile, T.StructType([*mixed.schema.fields, T.StructField("_n", T.LongType()), T.StructField("_set", T.LongType())]))
    again = mixed.filter("_n > 0").join(keep.select(F.col("doc").alias("_kept"), F.col("sig").alias("_sig")), key.eqNullSafe(F.col("_kept")) & (F.col("_set") == F.col("_sig")), "left_semi")
    return once.unionByName(again.dropDuplicates(["_set"]).unionByName(mixed.filter("_n = 0")).drop("_n", "_set"))
