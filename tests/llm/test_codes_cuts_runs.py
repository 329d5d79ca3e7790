"""Operators 11 to 13 against plain versions, and their edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest

from sparrowgrid.llm import fill_in_middle as M
from sparrowgrid.llm import run_index as R
from sparrowgrid.llm import vector_codes as V
from sparrowgrid.llm.common import join_heavy, table

SF = "/root/testdata/sf0.001"
sha = lambda b: hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def test_heavy_keys_join_like_others(spark):
    rows = spark.createDataFrame([("a", i) for i in range(50)] + [(f"k{i}", i) for i in range(5000)], "k string, i int")
    keyed = rows.groupBy("k").count().withColumnRenamed("count", "n")
    got = join_heavy(rows, keyed, ["k"], "n")
    assert got.count() == 5050 and {r.n for r in got.where("k = 'a'").collect()} == {50}


# -- vectors

def plain_codes(rows, parts=4, entries=256, rounds=4):
    rows = sorted(rows)
    x = np.array([[int(np.floor(1024 * float(c))) for c in v] for _, v in rows])
    cut = np.split(x, parts, axis=1)
    books = [c[:entries].copy() for c in cut]
    near = lambda c, b: ((c[:, None] - b[None]) ** 2).sum(axis=2)
    for _ in range(rounds):
        for p in range(parts):
            at = near(cut[p], books[p]).argmin(axis=1)
            books[p] = np.array([cut[p][at == k].sum(axis=0) // (at == k).sum() if (at == k).any() else b for k, b in enumerate(books[p])])
    d = [near(c, b) for c, b in zip(cut, books)]
    code = ["".join(f"{d[p][i].argmin():02x}" for p in range(parts)) for i in range(len(rows))]
    error = [int(sum(d[p][i].min() for p in range(parts))) for i in range(len(rows))]
    return {i: (c, e) for (i, _), c, e in zip(rows, code, error)}, sha(",".join(str(v) for b in books for v in b.ravel()))


@pytest.mark.parametrize("seed", range(4))
def test_nearest_entry_by_partial_distances(seed):
    rng = np.random.default_rng(seed)
    book = rng.integers(-20, 20, (40, 16)) if seed else rng.integers(0, 2, (40, 16))  # many ties
    x = rng.integers(-20, 20, (300, 16)) if seed else rng.integers(0, 2, (300, 16))
    d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    at, far = V.nearest(x, book)
    assert (at == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()
    for width in (1, 3, 4, 5):
        at, far = V.nearest(x[:, :width], book[:, :width])
        d = ((x[:, None, :width] - book[None, :, :width]) ** 2).sum(axis=2)
        assert (at == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()


def test_codes_against_the_plain_version(spark):
    rows = table(spark, SF, "embeddings").collect()
    want, digest = plain_codes([(r.vec_id, list(r.embedding)) for r in rows])
    got = V.query(spark, SF).collect()
    assert {r.vec_id: (r.code, r.error) for r in got} == want and {r.codebooks_sha256 for r in got} == {digest}
    label = {r.vec_id: r.label for r in rows}
    sums = {}
    for i, (_, e) in want.items():
        sums[label[i]] = sums.get(label[i], 0) + e
    assert all(r.label_error == sums[label[r.vec_id]] for r in got)


def test_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, [0.5, -0.5, 1.0, 0.0], 1, "x"), (5, [0.5, -0.5, 1.0, 0.0], None, "x"), (1, [0.0, 0.25, 0.0, 0.0], None, "x"), (None, [1.0, 1.0, 1.0, 1.0], 1, "x"),
        (7, None, 1, "x"), (8, [1.0, nan, 0.0, 0.0], 1, "x"), (9, [1.0, inf, 0.0, 0.0], 1, "x"), (10, [1.0, None, 0.0, 0.0], 1, "x"), (11, [1.0], 1, "x"), (12, [], 1, "x"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string")
    got = sorted(((r.vec_id, r.code, r.error, r.label_error) for r in V.compress(df).collect()), key=str)
    assert [g[0] for g in got] == [1, 5, 5, None] and all(g[2] == 0 and g[3] == 0 for g in got) and got[1][1] == got[2][1]
    few = V.compress(df, entries=2).collect()
    null = sum(r.error for r in few if r.label is None)
    assert {r.label_error for r in few if r.label is None} == {null}
    assert V.compress(df.limit(0)).count() == 0
    padded = spark.createDataFrame([(i, [float(i), 0.0, 1.0, 2.0, 3.0], 0) for i in range(3)], "vec_id long, embedding array<double>, label int")
    assert [len(r.code) for r in V.compress(padded).collect()] == [8, 8, 8]
    huge = spark.createDataFrame([(0, [1e300, -1e300, 0.0, 1.0], 0), (1, [0.0, 0.0, 0.0, 0.0], 0)], "vec_id long, embedding array<double>, label int")
    assert all(r.error >= 0 for r in V.compress(huge, entries=1).collect())


# -- cuts

def plain_cut(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_boundary_lists():
    rng = random.Random(0)
    for _ in range(200):
        text = "".join(rng.choice(["ab", "Z", " ", "\n", "é", "字", "\U0001f600", "9", "long" * 30]) for _ in range(rng.choice([0, 1, 5, 700, 3000])))
        ends = np.cumsum([len(t) for t in re.findall(r"[A-Za-z]+|[^A-Za-z]", text)]).astype(int)
        assert M.boundaries(text).tolist() == ends.tolist()
        blob = M.encode(M.boundaries(text))
        for i in {0, len(ends) // 2, len(ends) - 1, rng.randrange(len(ends) or 1)} if len(ends) else ():
            assert M.select(blob, i) == ends[i]
    sparse = np.sort(np.random.default_rng(1).choice(1 << 30, 2000, False))
    blob = M.encode(sparse)
    assert [M.select(blob, i) for i in range(2000)] == sparse.tolist() and len(blob) < 2000 * 4


def test_cuts_against_the_plain_version(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    got = {r.doc_id: r for r in M.query(spark, SF).collect()}
    assert got.keys() == {i for i, _ in docs}
    for i, text in docs:
        n, form, p, m, out = plain_cut(i, text)
        r = got[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, p, m, sha(out), sha(text))


def test_cuts_of_odd_texts_and_hot_copies(spark):
    odd = [None, "", "<P> stays", "a<b", "<<S", "x <", "P> y", "<P", "\n\n", "é字\U0001f600 mixed", "word " * 200_000]
    rows = [(None if i % 7 == 6 else i, t) for i, t in enumerate(odd * 4)] + [(1000 + i % 50, "the hot text, copied") for i in range(400)]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, key string, n int")
    got = sorted((str((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars)), sha(r.output)) for r in M.transform(df).collect())
    want = [(i, *plain_cut(i, t)) for i, t in rows]
    assert got == sorted((str(w[:5]), sha(w[5])) for w in want)
    assert {f for _, _, f, *_ in want} == {"plain", "psm", "spm"}
    back = M.transform(df).select(M.rebuilt(M.F.col("output"), M.F.col("form")).alias("t")).collect()
    assert sorted(sha(r.t) for r in back) == sorted(sha(t or "") for _, t in rows)
    assert M.transform(df.limit(0)).count() == 0


# -- runs

def plain_runs(docs, size=100):
    """docs: (key that orders them, bytes); key: (kept, removed, spans), a list in the order given."""
    seen, out = set(), {}
    for at, (_, data) in sorted(enumerate(docs), key=lambda x: (x[1][0], x[0])):
        gone = np.zeros(len(data) + 1, int)
        for i in range(len(data) - size + 1):
            w = data[i : i + size]
            if w in seen:
                gone[i] += 1
                gone[min(i + size, len(data))] -= 1
            seen.add(w)
        flag = np.cumsum(gone[:-1]) > 0
        out[at] = (bytes(b for b, f in zip(data, flag) if not f), int(flag.sum()), int((np.diff(np.concatenate(([0], flag.astype(int)))) == 1).sum()))
    return [out[i] for i in range(len(docs))]


@pytest.mark.parametrize("size", [16, 33, 100])
def test_index_marks_what_starts_earlier(size):
    rng = random.Random(size)
    for _ in range(15):
        letters = rng.choice([b"ab", b"abc", bytes(range(256))])
        base = [bytes(rng.choice(letters) for _ in range(rng.randint(5, 150))) for _ in range(4)]
        texts = [b"".join(rng.choice(base) for _ in range(rng.randint(1, 4))) + bytes(rng.choice(letters) for _ in range(size)) for _ in range(rng.randint(1, 10))]
        index = R.RunIndex(texts, size)
        assert len(index.run) <= index.n
        seen = set()
        for text, got in zip(texts, index.repeated()):
            windows = [text[i : i + size] for i in range(len(text) - size + 1)]
            want = []
            for i, w in enumerate(windows):
                if w in seen:
                    want.append(i)
                seen.add(w)
            assert got.tolist() == want


def test_transform_of_repeats_has_few_runs():
    text = bytes(np.random.default_rng(0).integers(0, 256, 2000, dtype=np.uint8))
    assert len(R.RunIndex([text] * 40, 100).run) < 2 * len(R.RunIndex([text], 100).run)


def documents(rng):
    word = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n)).decode()
    passage, other, period = word(260), word(150), "-=" * 40
    made = [word(rng.randint(0, 300)) + passage * rng.randint(0, 2) + word(rng.randint(0, 90)) + rng.choice([other, period * 6, ""]) + word(30) for _ in range(60)]
    return [*made, made[3], made[4], "=" * 5000, "=" * 3000, "é字" * 300, "é字" * 200, "", "short", word(99), "ab" * 70_000 + passage]


@pytest.mark.parametrize("most, shard", [(2048, 1 << 18), (1, 1 << 18), (6, 2000)])
def test_removed_bytes_against_the_plain_version(spark, most, shard):
    texts = documents(random.Random(7))
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 0, "r") for i, t in rows], "doc_id long, text string, n_bytes int, row string").repartition(5)
    got = {r.doc_id: (bytes(r.kept), r.n_removed, r.n_spans) for r in R.remove_repeats(df, 100, shard, most).collect()}
    want = plain_runs([(i, t.encode()) for i, t in rows])
    assert all(got[i] == want[i] for i in range(len(rows))) and sum(w[1] for w in want) > 100_000


def test_removed_bytes_of_repeated_and_null_rows(spark):
    long, second = "abcdefghij" * 9 + "0123456789ABCDEFGHIJ" * 3, "klmnop" * 30
    rows = [(1, long), (1, long), (1, long), (2, "x" + long), (None, long + "y"), (None, second), (3, None), (4, "tiny"), (4, "tiny"), (5, second)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, bytes(r.kept), r.n_bytes, r.n_removed) for r in R.remove_repeats(df).collect()]
    of = lambda i: sorted(x[1:] for x in got if x[0] == i)
    first = plain_runs([(0, long.encode())])[0]
    assert of(1) == sorted([(b"", 150, 150)] * 2 + [(first[0], 150, first[1])])
    assert of(2) == [(b"x", 151, 150)] and of(3) == [(b"", 0, 0)] and of(4) == [(b"tiny", 4, 0)] * 2
    assert (b"y", 151, 150) in of(None) and (b"", 180, 180) in of(None)
    assert R.remove_repeats(df.limit(0)).count() == 0


def test_contexts_do_not_depend_on_neighbours():
    texts = [t.encode() for t in documents(random.Random(1))]
    data = np.frombuffer(b"".join(texts), np.uint8)
    edges = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    together = {(int(k), int(i - edges[k]), int(w), int(h)) for hs, ks, at, ws, _ in R.contexts(data, edges, 100) for h, k, i, w in zip(hs, ks, at, ws)}
    apart = {(n, int(i), int(w), int(h)) for n, t in enumerate(texts) for hs, _, at, ws, _ in R.contexts(np.frombuffer(t, np.uint8), np.array([0, len(t)]), 100) for h, i, w in zip(hs, at, ws)}
    assert together == apart and sum(w for _, _, w, _ in together) == sum(max(0, len(t) - 99) for t in texts)
