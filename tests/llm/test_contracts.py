"""Each op query against brute force on the small tables, and cases the first tests left out."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparrowgrid.llm import decontamination, embedding_dedup, language_id, mixing, pii, simhash, substring_dedup, toxicity, warc
from sparrowgrid.llm.common import table

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in table(spark, SF, "documents").collect()}


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


CHECKS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m, d: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m, d: all(len(x.lstrip("0")) < 4 and int(x or 0) < 256 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m, d: 12 <= len(d) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, d: 9 <= len(d) <= 15),
}


def base_spans(text):
    found = [
        (m.start(), k, m.end(), kind) for k, (kind, (pattern, good)) in enumerate(CHECKS.items()) for m in re.finditer(pattern, text or "")
        if good(m.group(), re.sub("[^0-9]", "", m.group()))
    ]
    return [(kind, x, y) for x, _, y, kind in sorted(found)]


def test_op1_contract(spark, docs):
    got = {r.doc_id: r for r in pii.query(spark, SF).collect()}
    assert got.keys() == docs.keys()
    for i, r in got.items():
        want = base_spans(docs[i].text)
        text = [f"{k}:{x}:{y}" for k, x, y in want]
        assert r.base_sha256 == sha(",".join(text)) and set(text) <= set(r.spans.split(",") if r.spans else [])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in want) for kind in CHECKS]


def test_pii_added_spans_and_em(spark):
    mild = "nothing to see here, only words that say little. "
    hit = {
        "secret": 'api token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "iban": "iban DE89 3704 0044 0532 0130 00 konto", "ip": "host 2001:db8:0:0:0:ff00:42:8329 login",
        "name": "name Mr. Jonas Weber signed", "email": "mail joe [at] corp [dot] com please", "phone": "call (415) 555-0134 now",
    }
    rows = [(k, i, mild * 2 + t + " " + mild) for i in range(10) for k, t in hit.items()] + [("none", 0, "DE00 1234 5678 9012 3456 78 at 12:34:56 key: short")]
    frame = spark.createDataFrame([(n, k, t, -1) for n, (k, _, t) in enumerate(rows)], "doc_id long, want string, text string, spans int")
    got = {r.doc_id: r.spans for r in pii.find(frame).collect()}
    for n, (k, _, t) in enumerate(rows):
        assert {s.kind for s in got[n]} == ({k} if k != "none" else set()), (t, got[n])
        assert all(not s.base for s in got[n])
    secret = next(s for s in got[0])
    assert rows[0][2][secret.start : secret.end] == "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    # a vote pattern that all labelers favour outranks one that none does
    p = pii.fit([("0,1,1,1,1,2", 50), ("0,-1,-1,-1,-1,2", 50), ("0,0,1,0,1,2", 5)])
    assert p["0,1,1,1,1,2"] > 0.9 > 0.1 > p["0,-1,-1,-1,-1,2"]


def test_pii_is_linear_in_matches(spark):
    n = 100_000
    text = " ".join(f"a{i}@b.co" for i in range(n)) + " call (415) 555-0134"
    start = time.time()
    r = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).selectExpr("spans[0] AS a", f"spans[{n - 1}] AS b", "size(spans) AS n").first()
    at = text.index(f"a{n - 1}@")
    assert r.n in (n, n + 1) and (r.a.start, r.a.end) == (0, 7) and (r.b.start, r.b.end) == (at, at + len(f"a{n - 1}@b.co"))
    assert time.time() - start < 60


def fingerprint(text):
    w = re.findall(WORD, lower(text))
    s = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in s) * 2 > len(s)) if s else 0


def test_op3_contract(spark, docs):
    fps = {i: fingerprint(r.text) for i, r in docs.items()}
    comp = {i: i for i in fps}
    ids = np.array(sorted(fps))
    v = np.array([fps[i] for i in ids], np.uint64)
    near = np.bitwise_count(v[:, None] ^ v[None]) <= 4
    lab = ids.copy()
    while True:
        new = np.where(near, lab[None], np.iinfo(np.int64).max).min(axis=1)
        if (new == lab).all():
            break
        lab = new
    comp = dict(zip(ids.tolist(), lab.tolist()))
    for r in simhash.query(spark, SF).collect():
        assert (r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", comp[r.doc_id])


def test_texts_that_share_an_id_stay_apart(spark):
    text = lambda k: " ".join(f"w{(i * i + k * 7919) % 9973}" for i in range(80))
    rows = [(1, text(1)), (1, text(2)), (2, text(2)), (3, text(3)), (None, text(5)), (4, text(6)), (None, text(6))]
    frame = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, root int, least int")
    kept = sorted(((r.doc_id, r.text) for r in simhash.representatives(frame).collect()), key=str)
    assert kept == sorted([(1, text(1)), (1, text(2)), (3, text(3)), (None, text(5)), (4, text(6))], key=str)
    assert {r.component_id for r in simhash.near_duplicates(frame).where("doc_id = 2").collect()} == {1}


def test_op9_repeated_ids_are_vectors_of_their_own(spark):
    rng = np.random.default_rng(11)
    base = rng.standard_normal((6, 32))
    v = np.vstack([base[i % 6] + rng.standard_normal(32) * 0.02 * (i // 6) for i in range(60)])
    ids = [i % 17 for i in range(60)]
    frame = spark.createDataFrame([(i, [float(z) for z in x], "a", 0, 0) for i, x in zip(ids, v)], "vec_id long, embedding array<double>, label string, node int, many int")
    cos = v @ v.T / np.outer(*[np.linalg.norm(v, axis=1)] * 2)
    near = cos >= 0.98
    np.fill_diagonal(near, False)
    lab = np.arange(60)
    while True:
        new = np.array([min([lab[i], *lab[near[i]]]) for i in range(60)])
        if (new == lab).all():
            break
        lab = new
    name = {c: min(ids[i] for i in range(60) if lab[i] == c) for c in lab}
    want = Counter((ids[i], int(near[i].sum()), name[lab[i]]) for i in range(60))
    for tile in (8, 2048):
        assert Counter((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(frame, tile=tile).collect()) == want
    assert near.sum() > 100


def test_op9_contract(spark):
    rows = {r.vec_id: r for r in table(spark, SF, "embeddings").collect()}
    got = {r.vec_id: r for r in embedding_dedup.query(spark, SF).collect()}
    by = defaultdict(list)
    for i, r in rows.items():
        by[r.label].append((i, np.array(r.embedding, float)))
    for label, some in by.items():
        x = np.stack([v / np.linalg.norm(v) for _, v in some])
        near = (x @ x.T >= 0.98).sum(axis=1) - 1
        for (i, _), n in zip(some, near):
            assert got[i].n_links == n or abs(n - got[i].n_links) == 0
    assert got.keys() == rows.keys()


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 48))
    x[150:] = x[:150] + rng.standard_normal((150, 48)) * 0.2
    u = x / np.linalg.norm(x, axis=1)[:, None]
    cos = u @ u.T
    sure, may = np.zeros((300, 300), bool), np.zeros((300, 300), bool)
    tile = embedding_dedup.quantise(x)
    for i, j, s in embedding_dedup.bounded_pairs(tile, tile, 0.98):
        may[i, j], sure[i[s], j[s]] = True, True
    assert (cos[sure] >= 0.98).all() and (cos[~may] < 0.98).all() and 0 < sure.sum() and sure.sum() < may.sum()


def test_op5_contract(spark, docs):
    labels = {r.doc_id: r.toxic for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    got = {r.doc_id: r for r in toxicity.query(spark, "/root/testdata/sf0.01").collect()}
    held = {i for i in got if zlib.crc32(str(i).encode()) % 5 == 0}
    assert {i for i, r in got.items() if r.held_out} == held
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    known = [(labels[i], got[i].predicted) for i in held if labels.get(i) is not None]
    assert sum(a == b for a, b in known) / len(known) >= 0.95
    assert not any(p for y, p in known if not y)


def test_toxic_clauses(spark):
    model = ({"scum$": 1.0, "idio": 1.0}, np.append(np.ones(len(toxicity.ROLES) + 2), -4.0))
    text = "A fine day. She said you are scum. You are such an idiot! I will kill you."
    frame = spark.createDataFrame([(1, text, "k", 2.0, "z"), (2, None, None, None, None), (3, "", None, None, None), (4, text, "k", 2.0, "z")], "doc_id long, text string, x string, score double, _k0 string")
    got = toxicity.clause_scores(frame, model, "doc_id", "x", "_k0").where("doc_id = 1").orderBy("start").collect()
    assert [(r.start, r.stop, sorted(r.roles)) for r in got] == [(3, 8, ["reported"]), (8, 13, ["strong_target"]), (13, 17, ["target_after", "threat"])]
    assert all(0 <= r.score <= 1 and r.x == "k" for r in got)
    out = {r.doc_id: r for r in toxicity.score(frame, model, "doc_id", "x", "text", "score", "_k0").collect()}
    assert out[1].x == "k" and out[1].text == text and out[1].score == out[4].score > out[2].score == out[3].score
    assert toxicity.score(frame.limit(0), model, "doc_id").count() == 0 and toxicity.score(frame, model).count() == 4
    assert toxicity.clause_scores(frame.limit(0), model).count() == 0
    empty = toxicity.train(frame.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(frame, empty, "doc_id").where("predicted = 1 and doc_id in (2, 3)").count() == 0


def test_op6_contract(spark, docs):
    got = {r.doc_id: r for r in mixing.query(spark, SF).collect()}
    sizes = {i: len(re.findall(WORD, r.text or "")) for i, r in docs.items()}
    assert {i: r.size for i, r in got.items()} == sizes
    by = defaultdict(list)
    for i, r in docs.items():
        by[r.source].append(got[i])
    for s, rows in by.items():
        assert all(r.source_size == sum(x.size for x in rows) and r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in rows)
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 2 * max(r.size for r in rows)
    total = sum(sizes.values())
    assert sum({docs[i].source: r.target for i, r in got.items()}.values()) == pytest.approx(min(1.5, 2) * total)


def test_op7_contract(spark, docs):
    got = {r.doc_id: r for r in language_id.query(spark, SF).collect()}
    assert got.keys() == docs.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 for i, r in got.items())
    for i, r in got.items():
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in docs[i].text or ""))
    held = [(docs[i].lang, r.lang_pred) for i, r in got.items() if r.held_out and docs[i].lang and r.lang_pred != "und"]
    assert held and sum(a == b for a, b in held) / len(held) >= 0.97


def test_language_filters_of_more_than_64_languages(spark):
    rng = random.Random(3)
    alphabets = {f"l{k:03d}": [chr(0x4E00 + 40 * k + j) for j in range(40)] for k in range(130)}
    word = lambda k, n: "".join(rng.choice(alphabets[k]) for _ in range(n))
    text = lambda k: " ".join(word(k, 5) for _ in range(60))
    rows = [(i, text(k) + " " + text(k), k) for i, k in enumerate(alphabets)] + [(900, None, "l001"), (901, "x", None)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model[0]) == 130 and model[1].shape[0] == 3
    probe = [(i, rows[i][1][:200], k, 1.0) for i, k in enumerate(alphabets)]
    got = language_id.identify(spark.createDataFrame(probe * 2, "doc_id long, text string, want string, score double"), model).collect()
    assert len(got) == 260 and all(r.lang_pred == r.want for r in got)


def test_warc_files_feed_the_join(spark, tmp_path):
    quoted = b"hi\r\n\r\nWARC/1.1\r\nWARC-Type: x\r\n\r\nthere"
    rec = [
        {"type": "response", "url": "http://a.com/", "date": "2024-01-01T00:00:00Z", "record_id": "<u:1>", "headers": [("ETag", "x"), ("Via", "a"), ("via", "b")], "payload": quoted},
        {"type": "revisit", "url": "https://www.a.com", "date": "2024-01-02T00:00:00Z", "record_id": "<u:2>", "headers": {"Date": "d"}, "refers_to": "<u:1>"},
        {"type": "response", "url": "http://b.com/", "date": "no date", "record_id": "<u:3>", "payload": b"zz" * 4000},
    ]
    whole = warc.write_warc(rec)
    (tmp_path / "a.warc.gz").write_bytes(whole)
    (tmp_path / "b.warc.gz").write_bytes(whole[:-20])
    (tmp_path / "c.warc").write_bytes(warc.inflate(whole))
    (tmp_path / "d.warc").write_bytes(b"")
    got = warc.read_warc(spark, str(tmp_path)).collect()
    assert Counter(r.record_id for r in got) == {"<u:1>": 3, "<u:2>": 3, "<u:3>": 2}
    first = next(r for r in got if r.record_id == "<u:1>")
    assert bytes(first.payload) == quoted and first.headers == {"ETag": "x", "Via": "a, b"} and first.ts == 1704067200000000
    assert next(r for r in got if r.record_id == "<u:3>").ts is None
    out = {r.record_id: r for r in warc.resolve_revisits(warc.read_warc(spark, str(tmp_path / "a.warc.gz"))).collect()}
    assert (out["<u:2>"].status, out["<u:2>"].ref_id) == ("resolved", "<u:1>")
    assert list(warc.parse_warc(whole[:-20])) == list(warc.parse_warc(whole))[:2]


def test_revisits_with_repeated_rows_and_an_outlier_in_time(spark):
    kind = "record_id long, type string, url string, ts long, etag string, last_modified string, headers map<string,string>, slice int"
    rows = [(k, "response" if k % 2 else "revisit", "http://a.com", 10**15 + k, f"e{k // 40}", None, {}, 0) for k in range(200)] + [(900, "revisit", "http://a.com", 0, "e", None, {}, 0)]
    rows += rows[:3] + [(901, "revisit", None, None, "e", None, None, None)] * 2
    for slices in (1, 7, 1024):
        got = warc.resolve_revisits(spark.createDataFrame(rows, kind), slices).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.type == "revisit":
                late = [(x[3], x[0]) for x in rows if x[1] == "response" and r.ts is not None and x[3] <= r.ts]
                assert r.ref_id == (max(late)[1] if late else None)


def test_op10_contract(spark, docs):
    got = {r.doc_id: r for r in substring_dedup.query(spark, SF).collect()}
    words = {i: re.findall(WORD, r.text or "") for i, r in docs.items()}
    seen = Counter(tuple(w[j : j + 35]) for w in words.values() for j in range(len(w) - 34))
    for i, w in words.items():
        keep = [True] * len(w)
        for j in range(len(w) - 34):
            if seen[tuple(w[j : j + 35])] > 1:
                keep[j : j + 35] = [False] * 35
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), keep.count(False), sha(" ".join(x for x, k in zip(w, keep) if k)))


def test_reordered_and_very_long_items(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    short = [" ".join(word() for _ in range(12)) for _ in range(3)]
    long = " ".join(word() for _ in range(5000)) + ". the end of it"
    bench = spark.createDataFrame([(1, ". ".join(short)), (2, long), (3, None), (3, "")], "item_id long, text string")
    filler = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, filler(80)) for i in range(30)]
    rows += [(100, f"{rows[0][1]} {short[2]}. {short[0]}. {short[1]} {rows[1][1]}"), (101, f"{rows[2][1]} {long} {rows[3][1]}"), (102, None), (103, "")]
    frame = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, start int")
    got = {(r.doc_id, r.item_id): r for r in decontamination.find(frame, bench, rank=8).collect()}
    assert set(got) == {(100, 1), (101, 2)}
    assert got[101, 2].overlap == 1.0 and got[101, 2].stop - got[101, 2].start == 5004 and got[100, 1].overlap < 0.8 and got[100, 1].cosine >= 0.9
    assert {r.doc_id for r in decontamination.clean(frame, bench, rank=8).collect()} == {i for i, _ in rows} - {100, 101}
    assert decontamination.find(frame.limit(0), bench, rank=8).count() == 0 == decontamination.clean(frame.limit(0), bench, rank=8).count()


def test_unmet_targets_are_reported(spark):
    cells = spark.createDataFrame([("a", 3, 5), ("a", 7, 5)], "source string, size long, n long")
    goals = spark.createDataFrame([("a", 50, 60.0, 5.0)], "source string, total long, target double, mean double")
    with pytest.warns(UserWarning):
        mixing.solve_tilts(cells, goals, rounds=1)
    tilt = mixing.solve_tilts(cells, goals).first().tilt
    assert 5 * (3 * min(2, np.exp(tilt * 3 / 5)) + 7 * min(2, np.exp(tilt * 7 / 5))) == pytest.approx(60)


def test_reading_marks_is_exact_for_what_is_there(spark):
    from sparrowgrid.llm.common import marked, marks, slot, slots_of

    keys = spark.range(5000).select(F.col("id").alias("h"))
    bits = marks(keys.select(slot("h")))
    assert marked(bits, slots_of(np.arange(5000))).all()
    assert marked(bits, slots_of(np.arange(5000, 100_000))).mean() < 0.001
    assert not marks(keys.limit(0).select(slot("h"))).any()


def test_near_copies_against_brute_force(spark):
    """Groups of edited copies, some of which are like only by way of others; short, blank, null and equal texts."""
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(3000)]
    rows, n = [], 0

    def edited(words, share):
        return [rng.choice(vocab) if rng.random() < share else w for w in words]

    for g in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice((8, 60, 200, 400)))]
        for _ in range(rng.randint(1, 14)):
            rows.append((n := n + 1, " ".join(edited(base, rng.choice((0, 0.005, 0.01, 0.02, 0.03, 0.06))))))
    drift = [rng.choice(vocab) for _ in range(120)]
    for _ in range(25):  # a chain whose ends differ
        drift = edited(drift, 0.012)
        rows.append((n := n + 1, " ".join(drift)))
    rows += [(n := n + 1, " ".join(rng.choice(vocab) for _ in range(150))) for _ in range(60)]
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "a b c d"), (None, rows[0][1]), (None, "only null here and nowhere else at all"), (rows[5][0], "another text under that same id"), rows[3], rows[3]]
    frame = spark.createDataFrame([(i, t, -1, -1) for i, t in rows], "doc_id long, text string, node int, id int")
    different = sorted({t for _, t in rows}, key=str)
    sets = [set(simhash.shingle_hashes(t and t.encode(), 5).tolist()) for t in different]
    fps = [simhash.fingerprint(t and t.encode(), 5) for t in different]
    lab = list(range(len(different)))
    find = lambda x: x if lab[x] == x else find(lab[x])
    for i in range(len(different)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (fps[i] ^ fps[j]).bit_count() <= 4 or sets[i] and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                lab[find(i)] = find(j)
    groups = defaultdict(list)
    for i, t in rows:
        groups[find(different.index(t))].append((i is None, i or 0, t))
    for tile in (2048, 3):
        got = [(r.doc_id, r.text, r.node) for r in simhash.distinct_documents(frame, tile=tile).collect()]
        assert len(got) == len(groups) < len(different) - 40 and all(x == -1 for *_, x in got)
        kept = Counter(find(different.index(t)) for _, t, _ in got)
        assert set(kept.values()) == {1}
        for i, t, _ in got:
            assert (i is None, i or 0) == min(x[:2] for x in groups[find(different.index(t))])
    assert simhash.distinct_documents(frame.limit(0)).count() == 0


def test_models_are_fitted_on_all_rows(spark, monkeypatch):
    """The latent space and the toxicity model against plain versions over every text, whatever their number."""
    import inspect

    from sparrowgrid.llm import decontamination as D

    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words[10 * (i % 6) : 10 * (i % 6) + 10], int(rng.integers(1, 200)))) for i in range(90)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, ""])], "doc_id long, text string")
    bench = spark.createDataFrame([(0, texts[0][:80])], "item_id long, text string")
    got = D._space(docs.selectExpr("doc_id", "cast(text as binary) AS text"), bench, 6)
    df = np.zeros(D.BUCKETS)
    for t in texts:
        df[np.unique(D.buckets_of(D.words_of(t)))] += 1
    idf = np.log((len(texts) + 2 + 1) / (df + 1)) + 0.01
    np.testing.assert_allclose(got.idf, idf)
    rows = []
    for t in [*texts, texts[0][:80]]:
        x = D.buckets_of(D.words_of(t))
        for at in range(0, len(x), D.PASSAGE):
            v = np.bincount(x[at : at + D.PASSAGE], minlength=D.BUCKETS) * idf
            rows.append(v / np.linalg.norm(v))
    used = np.flatnonzero(df)
    basis = np.linalg.svd(np.array(rows)[:, used], full_matrices=False)[2][:6].T
    mine = (got.latent / idf[:, None])[used]
    np.testing.assert_allclose(np.linalg.svd(basis.T @ mine)[1], 1, atol=1e-3)  # the same six dimensions
    assert not {"sample", "rows"} & (set(inspect.signature(D.find).parameters) | set(inspect.signature(toxicity.train).parameters))


def test_weights_are_those_of_newton_over_all_rows(spark):
    rng = np.random.default_rng(8)
    x = rng.random((500, 3))
    y = (rng.random(500) < 1 / (1 + np.exp(-(4 * x[:, 0] - 2)))).astype(int)
    got = toxicity.fit_weights(spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(y, x)], "toxic int, x array<double>").repartition(3), 3)
    z = np.hstack([x, np.ones((500, 1))])
    p = 1 / (1 + np.exp(-z @ got))
    np.testing.assert_allclose(z.T @ (p - y) / 500 + 1e-3 * got, 0, atol=1e-9)


def test_toxicity_shuffles_labelled_texts_alone(spark):
    """Texts without a label stay where they are read, and few labels are not broadcast."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(3000)] + [(7, "again"), (None, "none"), (8, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (8, 0), (8, 1), (9, None), (None, 1), (5000, 1)], "doc_id int, toxic long")
    found = toxicity.labelled(docs, labels)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("text 7", 1), ("again", 1), ("text 8", 0), ("text 8", 1), (None, 0), (None, 1)], key=str)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    join = next(n for n in _nodes(found._jdf.queryExecution().executedPlan()) if n.nodeName() == "SortMergeJoin")
    sent = [n.metrics().get("shuffleRecordsWritten").get().value() for n in _nodes(join) if n.nodeName() == "Exchange"]
    assert sum(sent) <= 20, sent  # four texts, four labels, and what the marks let through


def _nodes(plan):
    if plan.nodeName() == "AdaptiveSparkPlan":
        return _nodes(plan.executedPlan())
    if plan.nodeName().endswith("QueryStage"):
        return _nodes(plan.plan())
    below = plan.children()
    return [plan, *[x for i in range(below.size()) for x in _nodes(below.apply(i))]]


def test_words_and_numbers_of_many_texts_at_once(monkeypatch):
    """Against words_of, crc32 and a dictionary: long words, marks, bytes beyond ASCII, equal hashes, empty texts."""
    import zlib

    import pyarrow as pa

    from sparrowgrid.llm import decontamination as D

    monkeypatch.setattr(D, "CHUNK", 2000)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcXYZé語9-'") for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 17, 24, 25, 70])))
    some = [word() for _ in range(300)]
    some += ["plumless", "buckeroo", "a" * 24, "a" * 25, "x" * 5000]  # the first two share their CRC-32
    texts = [rng.choice([" ", ", ", "\n\t", "..."]).join(rng.choice(some) for _ in range(rng.randrange(60))).encode() for _ in range(120)]
    texts += [None, b"", b" . ", b"end", None]
    assert zlib.crc32(b"plumless") == zlib.crc32(b"buckeroo")
    known = sorted({w for s in [*some[::2], "plumless", "buckeroo"] for w in D.words_of(s)})
    lookup, at = D.Vocabulary(known), 0
    for first, words in D.chunks(pa.array(texts, pa.binary())):
        assert first == at
        for t, h, n in zip(texts[at:], words.per_text(words.hashes), words.per_text(lookup.numbers(words)), strict=False):
            plain = D.words_of(t)
            assert h.tolist() == [zlib.crc32(w) for w in plain]
            assert n.tolist() == [known.index(w) if w in known else -1 for w in plain]
            at += 1
    assert at == len(texts)
    only = D.Words([b"buckeroo plumless"])
    assert D.Vocabulary([b"plumless"]).numbers(only).tolist() == [-1, 0]


def test_latent_space_by_entries_whatever_their_order(spark):
    """A product keeps a place for each word of a passage, not for each pair of passage and bucket, and the space
    does not depend on the order of the rows."""
    from sparrowgrid.llm import decontamination as D

    rng = np.random.default_rng(11)
    texts = [rng.integers(0, D.BUCKETS, int(n)).astype(np.uint16) for n in rng.integers(0, 400, 200)]
    idf = rng.random(D.BUCKETS) + 0.1
    rows = []
    for x in texts:
        for at in range(0, len(x), D.PASSAGE):
            v = np.bincount(x[at : at + D.PASSAGE], minlength=D.BUCKETS) * idf
            rows.append(v / np.linalg.norm(v))
    a, made, x = np.array(rows), list(D.passages((t.tobytes() for t in texts), idf)), rng.standard_normal((D.BUCKETS, 5)).astype(np.float32)
    assert sum(len(w) for *_, w in made) == (a > 0).sum() <= sum(map(len, texts))
    out = np.zeros(x.shape)
    for passage, bucket, w in made:
        placed = np.zeros((passage[-1] + 1, 5), np.float32)
        D.add_sums(placed, passage, bucket, w, x)
        order = np.argsort(bucket, kind="stable")
        D.add_sums(out, bucket[order], passage[order], w[order], placed)
    np.testing.assert_allclose(out, a.T @ (a @ x), atol=1e-5)
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(rng.choice(words, int(rng.integers(1, 200))))) for i in range(150)]
    bench = spark.createDataFrame([(0, docs[0][1])], "item_id long, text string")
    spaces = [D._space(spark.createDataFrame(d, "doc_id long, text string").selectExpr("cast(text as binary) AS text").repartition(n, "text"), bench, 12) for d, n in ((docs, 2), (docs[::-1], 5))]
    places = [s.place(D.buckets_of(D.words_of(docs[7][1]))) @ s.place(D.buckets_of(D.words_of(docs[9][1]))) for s in spaces]
    np.testing.assert_allclose(*places, atol=1e-7)
