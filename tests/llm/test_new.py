"""Whitening, repeated passages and the Merkle manifest against brute force, with the edge cases of their docstrings."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.llm import chat, counts, lempel_ziv, merkle, queries, whitening

SF = "/root/testdata/sf0.001"


def some(rnd, n, kinds=400):
    return " ".join("w" + str(rnd.randint(0, kinds)) for _ in range(n))


# repeated passages


def brute_repeats(rows):
    """(n_words, n_removed, kept_sha256) of each (id, text); rows of equal id and text are one document."""
    seen, split = {}, {}
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    for row in order:
        split[row] = re.findall(r"[^\x20\x09-\x0D]+", row[1] or "")
    out = {}
    for row in order:
        words, gone = split[row], set()
        for a in range(len(words) - 19):
            if seen.setdefault(tuple(words[a:a + 20]), (row, a)) != (row, a):
                gone.update(range(a, a + 20))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out[row] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return [(r[0], *out[r]) for r in rows]


@pytest.fixture(scope="module")
def passages():
    rnd = random.Random(11)
    base, line, hot = some(rnd, 300), some(rnd, 20), some(rnd, 7)
    texts = [None, "", " \t\n", some(rnd, 19), line, line, line + " x", "y " + line, base, base, base.upper(), "a " * 60, " é " * 30 + line, some(rnd, 30_000), "x" * 50_000 + " " + line]
    words = base.split(" ")
    for _ in range(30):
        w = list(words)
        for _ in range(rnd.randint(1, 6)):
            w[rnd.randrange(len(w))] = "new" + str(rnd.randint(0, 9))
        a = rnd.randint(0, 200)
        texts.append(some(rnd, rnd.randint(0, 40)) + " " + " ".join(w[a:a + rnd.randint(10, 120)]) + "\n" + some(rnd, rnd.randint(0, 40)))
    texts += [some(rnd, 25) + " " + hot + " " + some(rnd, 25) for _ in range(60)]  # one phrase in many surroundings
    texts += [some(rnd, 5) + " " + line + "\t" + line + " " + some(rnd, 5) for _ in range(40)]  # a line that many share, twice in each
    rnd.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("hot_rows", [5_000, 4])
def test_repeats_against_brute_force(spark, passages, hot_rows):
    line = next(t for _, t in passages if t and len(t.split()) == 20)
    rows = passages + [passages[-1], passages[-1], (3, "another text of id 3"), (None, "no id " + line), (None, "no id " + line)]
    docs = spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], "doc_id long, text string, start string, n_words int").repartition(5)
    got = lempel_ziv.without_repeats(docs, hot_rows=hot_rows)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_repeats(rows), key=str)


def test_factors_copy_earlier_text(spark, passages):
    docs = spark.createDataFrame(passages, "doc_id long, text string").repartition(3)
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in passages}
    found = lempel_ziv.factors(docs).collect()
    assert len(found) > 100
    for r in found:
        assert (r.from_id, r.from_start) < (r.doc_id, r.start) and r.length >= 20
        assert words[r.doc_id][r.start:r.start + r.length] == words[r.from_id][r.from_start:r.from_start + r.length]


def test_repeats_of_nothing(spark):
    for rows in ([], [(1, None)], [(None, None)]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert [tuple(r) for r in lempel_ziv.without_repeats(docs).collect()] == [(i, 0, 0, hashlib.sha256(b"").hexdigest()) for i, _ in rows]


def test_kept_texts(spark):
    text = " ".join(map(str, range(20)))
    docs = spark.createDataFrame([(1, text), (2, "a\t" + text + "  b")], "doc_id long, text string")
    assert [r.kept for r in lempel_ziv.without_repeats(docs, texts=True).orderBy("doc_id").collect()] == [text, "a b"]


# whitening


def brute_whitening(vectors, k=4):
    x = np.floor(256 * np.array(vectors, dtype=np.float32).astype(np.float64))
    fit = np.unique(x, axis=0)
    v = np.cov(fit.T, bias=True).reshape(x.shape[1], -1)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    n, s = len(fit), fit.sum(axis=0)
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ u / np.sqrt(e), e / np.trace(v)


def test_whitening_against_eigh(spark):
    rnd = np.random.default_rng(3)
    good = (rnd.normal(size=(300, 12)) * np.linspace(0.2, 2, 12)).astype(np.float32)
    good[250:] = good[:50]
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(good)]
    rows += [(900, None, "x"), (901, [None] + [1.0] * 11, "x"), (902, [float("nan")] * 12, "x"), (903, [float("inf")] * 12, "x"), (904, [1.0, 2.0], "x"), (905, [], "x"), (None, good[0].tolist(), "x")]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string").repartition(4)).collect()
    n, deviation, w, explained = brute_whitening(good)
    assert len(got) == 301 * 4 and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10
    for c in range(1, 5):
        own = {r.vec_id: r for r in got if r.component == c and r.vec_id is not None}
        a = np.array([own[i].whitened for i in range(300)])
        sign = np.sign(a @ w[:, c - 1])
        assert np.allclose(a * sign, w[:, c - 1], rtol=0, atol=1e-9)
        assert [own[i].deviation for i in range(300)] == deviation.astype(int).tolist()
        assert abs(own[0].explained / explained[c - 1] - 1) < 1e-10


def test_whitening_of_little(spark):
    def run(vectors):
        return whitening.whitened(spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")).collect()

    assert run([]) == [] and run([None]) == [] and run([[1.0, 2.0]]) == [] and run([[1.0, 2.0]] * 3) == [] and run([[]]) == []
    two = run([[0.0, 0.0, 1.0], [1.0, 0.0, 1.0]])
    assert [(r.component, r.n, r.deviation, round(abs(r.whitened), 9), r.explained) for r in two] == [(1, 2, 65536, 1.0, 1.0)] * 2
    far = run([[1e300, 0.0], [0.0, 1.0], [0.0, 2.0]])
    assert {r.n for r in far} == {3} and all(r.deviation is None for r in far) and len(far) >= 3
    assert len(run([[float(i == j) for j in range(6)] for i in range(6)])) == 24  # all eigenvalues but one are equal


@pytest.mark.parametrize("d", [1, 2, 7, 64])
def test_slicing_finds_leading_eigenvalues(d):
    rnd = np.random.default_rng(d)
    q = np.linalg.qr(rnd.normal(size=(d, d)))[0]
    for spectrum in (np.linspace(1, 2, d), np.ones(d), np.r_[np.full(min(d, 3), 5.0), np.ones(max(0, d - 3))], 10.0 ** -np.arange(d), np.r_[1, 1 - 1e-13, np.full(d, 0.5)][:d]):
        v = (q * spectrum) @ q.T
        v = (v + v.T) / 2
        want = np.linalg.eigvalsh(v)[::-1][:4]
        values, vectors = whitening.leading(v)
        assert len(values) == min(4, d, (want > 1e-12).sum())
        assert np.allclose(values, want[:len(values)], rtol=0, atol=1e-12 * max(spectrum))
        assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-10)
        assert np.abs(v @ vectors.T - vectors.T * values).max(initial=0) < 1e-11 * max(spectrum)
    for shift in (-0.5, 0.3, 1.01, 3):
        m = rnd.normal(size=(d, d))
        m = m + m.T
        assert whitening.above(m, shift) == (np.linalg.eigvalsh(m) > shift).sum()


# Merkle manifest


def brute_merkle(rows):
    """What op13 returns for (doc_id, source, lang, n_chars, text) rows."""
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def tree(level):
        levels = [level]
        while len(level) > 1:
            level = [sha("".join(level[i:i + 2])) for i in range(0, len(level), 2)]
            levels.append(level)
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            if i ^ 1 < len(level):
                out.append((i % 2, level[i ^ 1]))
            i //= 2
        return out

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r, sha("".join(map(field, r)))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    trees = {g: tree([leaf for _, leaf in groups[g]]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for at, g in enumerate(names):
        for i, (r, leaf) in enumerate(groups[g]):
            proof = path(trees[g], i) + path(top, at)
            d = leaf
            if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                d = sha("".join(map(field, (*r[:3], r[3] + 1, r[4]))))
            for right, s in proof:
                d = sha(s + d) if right else sha(d + s)
            out.append((r[0], leaf, trees[g][-1][0], top[-1][0], sha("".join(s for _, s in proof)), d, d == top[-1][0]))
    return out


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("rows", [
    [], [(1, "a", None, None, None)], [(i, "s", "en", i, "t" * i) for i in range(5)],
    [(i if i % 9 else None, None if i % 4 == 0 else "q", [None, "en", "", "é", "zz", "0"][i % 7 % 6], None if i % 5 == 0 else i, None if i % 6 == 0 else f"é{i} " * (i % 50)) for i in range(300)] + [(7, "r", "en", 1, "same")] * 6 + [(8, "r", "lone", 1, "x" * 200_000)],
])
def test_manifest_against_brute_force(spark, rows, tmp_path):
    spark.createDataFrame(rows, DOCS).withColumn("digest", F.lit("clash")).withColumn("n", F.lit("clash")).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_merkle(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_merkle(rows), key=str)


def test_manifest_of_greatest_longs(spark, tmp_path):
    """Where 1 is added to the greatest long, the leaf changes like any other."""
    most = 2**63 - 1
    rows = [(i, "s", "en" if i % 2 else None, [most, most - 1, -most - 1, -1][i % 4], "t") for i in range(120)] + [(i, "s", "en", most, None) for i in (-most - 1, most)]
    tampered = [r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] == most]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_merkle(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_merkle(rows), key=str)
    assert tampered and not any(r.verified for r in got if r.doc_id in tampered)


def test_manifest_of_groups_that_are_no_text(spark):
    """Groups whose bytes are no UTF-8 stand in order of bytes."""
    langs = [b"\xff\xfe", None, b"\xc3", b"\xc3\xa9", b"", b"en"]
    docs = spark.createDataFrame([(i, lang) for i, lang in enumerate(langs)], "doc_id long, lang binary")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    field = lambda b: b"-" if b is None else str(len(b)).encode() + b":" + b
    leaves = {i: sha(field(str(i).encode()) + field(lang)) for i, lang in enumerate(langs)}
    level = [leaves[i] for i in (1, 4, 5, 2, 3, 0)]
    while len(level) > 1:
        level = [sha("".join(level[i:i + 2]).encode()) for i in range(0, len(level), 2)]
    got = merkle.manifest(docs, ["doc_id", "lang"], "lang", "doc_id").collect()
    assert {r.doc_id: r.leaf for r in got} == leaves and {r.root for r in got} == set(level)


def test_manifest_of_small_blocks(spark):
    """Many rounds give the tree that one gives."""
    rows = [(i, "s", "en" if i % 3 else "fr", i, str(i)) for i in range(100)]
    docs = spark.createDataFrame(rows, DOCS)
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    one, many = (sorted(map(tuple, merkle.manifest(docs, columns, "lang", "doc_id", levels=n).collect()), key=str) for n in (10, 2))
    assert one == many


def test_new_queries_on_given_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op12_lempel_ziv(spark, SF).collect())) == sorted(brute_repeats(docs))
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    n, deviation, w, explained = brute_whitening([r.embedding for r in vectors])
    got = {(r.vec_id, r.component): r for r in queries.op11_whitening(spark, SF).collect()}
    assert len(got) == 4 * len(vectors)
    for i, r in enumerate(vectors):
        assert got[r.vec_id, 1].n == n and got[r.vec_id, 1].deviation == int(deviation[i])
        assert np.allclose(np.abs([got[r.vec_id, c].whitened for c in range(1, 5)]), np.abs(w[i]), atol=1e-8)
        assert abs(got[r.vec_id, 3].explained / explained[2] - 1) < 1e-9


# earlier operators: long conversations, events without an id


def test_many_turns_in_one_conversation(spark):
    n = 20_000
    rows = [(1, i, i - 1 if i else None, "user" if i % 2 == 0 else "assistant", f"t{i} </s>") for i in range(n)]
    messages = spark.createDataFrame(rows, "tree_id long, msg_id long, parent_id long, role string, text string")
    done = chat.format_trees(messages, score=None)
    r = done.select("n_turns", "formatted", "loss_spans", chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert r.n_turns == n and r.loss == "".join(f"t{i} </s>" for i in range(1, n, 2))
    assert all(r.formatted[s.start:s.start + s.length] == f"t{2 * k + 1} <\\/s>" for k, s in enumerate(r.loss_spans))


def test_events_without_an_id(spark):
    rows = [("e1", "insert", 1), (None, "insert", 2), (None, "insert", 2), (None, "insert", 3), ("e1", "insert", 1), ("e2", "insert", 9), ("e2", "insert", 4)]
    df = spark.createDataFrame([(i, k, "s", None, "v", t, 0, "clash") for i, k, t in rows], "event_id string, kind string, source string, lang string, tokenizer string, tokens long, old_tokens long, docs string")
    assert [tuple(r) for r in counts.signed(df).collect()] == [("s", None, "v", 5, 12)]
