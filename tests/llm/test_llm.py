import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparrowgrid.llm import (
    common, decontamination, embedding_dedup, language_id, line_dedup, mixing, pii, simhash, substring_dedup, toxicity, warc,
)

WORD = r"[^\x20\x09-\x0D]+"
CLASH = ["n", "h", "row", "parts", "size", "d", "score", "spans", "fp", "rate", "component_id", "held"]


def frame(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(-1) for c in CLASH})


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared, rows = [line(12) for _ in range(3)], []
    passage = line(60)
    for i in range(120):
        parts = [line(rng.randint(1, 60)) for _ in range(rng.randint(1, 5))]
        if i % 3 == 0:
            parts.insert(0, "  " + shared[i % 2].upper() + "\t")
        if i % 10 == 0:
            parts.append(line(5) + " " + passage + " " + line(5))
        rows.append((i, "\n".join(parts), "en", f"s{i % 4}"))
    base = rows[7][1]
    rows += [(200 + i, base, "en", "s9") for i in range(40)]
    rows += [(300 + i, base + f" tail{i}", "en", "s9") for i in range(20)]
    rows += [(400, None, None, None), (401, "", "en", "s1"), (402, " \n\t", None, ""), (403, "x " * 30000, "en", "s1"), (None, base, "en", "s1"), (None, None, None, None), (7, base, "en", "s3")]
    return rows


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def test_lines(spark, corpus):
    rows = [r for r in corpus if r[0] is not None and r != corpus[-1]]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    docs = {}
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                docs.setdefault(key(x), set()).add(i)
    for i, t, *_ in rows:
        kept = [x for x in (t or "").split("\n") if len(docs.get(key(x), ())) < 5 or i == max(docs[key(x)])]
        assert got[i].text == "\n".join(kept) and got[i].n_dropped == len((t or "").split("\n")) - len(kept)
    assert line_dedup.dedup_lines(frame(spark, corpus)).count() == len(corpus)


def test_simhash(spark, corpus):
    got = simhash.near_duplicates(frame(spark, corpus)).collect()
    assert len(got) == len(corpus)

    def brute(t):
        w = re.findall(WORD, key(t or "") if False else "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        if not w:
            return 0
        s = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
        return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in s) * 2 > len(s))

    fps = {i: brute(t) for i, t, *_ in corpus if i is not None}
    comp = {i: i for i in fps}
    for _ in range(8):
        for a in sorted(fps):
            comp[a] = min(comp[b] for b in fps if (fps[a] ^ fps[b]).bit_count() <= 4)
    for r in got:
        if r.doc_id is not None:
            assert r.fp & (1 << 64) - 1 == fps[r.doc_id] and r.component_id == comp[r.doc_id]


def test_hot_buckets_are_tiled_without_loss(spark):
    rng = random.Random(1)
    base = rng.getrandbits(63)
    fps = sorted({base ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for _ in range(300)})
    reps = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, rep long")
    comp = common.connected_components(simhash.hamming_links(reps, tile=16))
    assert {r.component for r in comp.collect()} == {0} and comp.count() == len(fps)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in common.connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_substrings(spark, corpus):
    for most in (1000, 1):
        got = substring_dedup.remove_repeats(frame(spark, corpus), 35, most).collect()
        assert len(got) == len(corpus)
        seen = Counter()
        for _, t, *_ in corpus:
            w = re.findall(WORD, t or "")
            seen.update(tuple(w[j : j + 35]) for j in range(len(w) - 34))
        want = Counter()
        for i, t, *_ in corpus:
            w = re.findall(WORD, t or "")
            keep = [True] * len(w)
            for j in range(len(w) - 34):
                if seen[tuple(w[j : j + 35])] > 1:
                    keep[j : j + 35] = [False] * 35
            want[i, " ".join(x for x, k in zip(w, keep) if k), len(w)] += 1
        assert Counter((r.doc_id, r.text, r.n_words) for r in got) == want


def test_mixing(spark, corpus):
    got = mixing.mix(frame(spark, corpus), cell=8).collect()
    again = mixing.mix(frame(spark, corpus), cell=8).collect()
    assert len(got) == len(corpus) and sorted(map(str, got)) == sorted(map(str, again))
    sizes = Counter()
    for _, t, _, s in corpus:
        sizes[s] += len(re.findall(WORD, t or ""))
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, target = 1.5 * sum(sizes.values()), set(order), {}
    while True:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s] + 1e-9}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    target |= share
    for s in order:
        mine = [r for r in got if r.source == s]
        assert abs(mine[0].target - target[s]) < 1e-6 * max(1, target[s])
        assert all(0 <= r.copies <= 2 for r in mine)
        longest = max(r.size for r in mine)
        assert abs(sum(r.copies * r.size for r in mine) - target[s]) <= 2 * longest


def test_pii(spark):
    texts = [None, "", "x a@b.c_d@e.f 1.2.3.4.5.6.7.8 é+1 (437) 555-0689 4111 1111 1111 1111", "a@b..c@d.e 300.1.1.1 01.002.3.255", "+1234567890123456 " + "1" * 30000, "call +1 (437) 555-0689, pay 4111 1111 1111 1111 or 4111-1111-1111-1112", "a@" + "b." * 9000 + "c", "mail me: joe [at] corp [dot] com"]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.base] for r in pii.find(frame(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()}
    checks = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m, d: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m, d: all(len(x.lstrip("0")) < 4 and int(x) < 256 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m, d: 12 <= len(d) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, d: 9 <= len(d) <= 15),
    }
    for i, t in enumerate(texts):
        want = [
            (m.start(), k, m.end(), kind) for k, (kind, (pattern, good)) in enumerate(checks.items()) for m in re.finditer(pattern, t or "")
            if good(m.group(), re.sub("[^0-9]", "", m.group()))
        ]
        assert got[i] == [(kind, x, y) for x, _, y, kind in sorted(want)], t and t[:60]


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_toxicity_grammar():
    s = toxicity.Scorer({"scum$": 1.0, "idio": 1.0})
    role = lambda t: dict(zip(toxicity.ROLES, s.features(t)))
    assert role("you are scum.")["insult_target"] > 0 and role("that is not an idiot")["negated"] > 0
    assert role("she said scum")["reported"] > 0 and role("she said so. scum!")["insult"] > 0
    assert s.features(None).sum() == s.features("").sum() == 0


def test_toxicity_learns(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("ab cd ef gh".split()) + str(rng.randrange(50)) for _ in range(30)) + (" lowliferen" if i % 5 == 0 else ""), None, None) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    docs = frame(spark, rows + [(900, None, None, None)])
    out = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, labels), "doc_id").collect()}
    assert all(out[i].predicted == int(i % 5 == 0) for i in range(300)) and out[900].predicted == 0 and 0 <= out[900].score <= 1


def test_language(spark):
    rows = [(i, "der die das und nicht ein haus", "de", None) for i in range(9)] + [(20 + i, "the house and a tree that was", "en", None) for i in range(9)]
    model = language_id.train(frame(spark, rows))
    got = language_id.identify(frame(spark, [(1, "das haus und die", None, None), (2, "THE tree", None, None), (3, None, None, None), (4, "12 !?", None, None)]), model)
    assert {r.doc_id: r.lang_pred for r in got.select("doc_id", "lang_pred").collect()} == {1: "de", 2: "en", 3: "und", 4: "und"}
    empty = language_id.train(frame(spark, []).select("lang", "text"))
    assert language_id.identify(frame(spark, rows), empty).where("lang_pred <> 'und'").count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((30, 16))
    vecs = np.vstack([base[rng.integers(0, 30)] + rng.standard_normal(16) * rng.choice([0, 0.05, 0.12, 0.4]) for _ in range(200)]).astype(np.float32)
    label = rng.integers(0, 2, 200)
    rows = [(i, [float(x) for x in v], int(k)) for i, (v, k) in enumerate(zip(vecs, label))]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [float(x) for x in vecs[0]], None), (904, [None] * 16, 1), (905, [], 0)]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int"), tile=16).collect()}
    x = vecs.astype(float)
    near = (x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)) >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    comp = np.arange(200)
    for _ in range(30):
        comp = np.array([min([comp[i], *comp[near[i]]]) for i in range(200)])
    assert near.sum() > 50 and len(got) == 206
    for i in range(200):
        assert (got[i].n_links, got[i].component_id) == (near[i].sum(), comp[i])
    assert all(got[i].n_links == 0 and got[i].kept for i, *_ in odd)


def test_decontamination(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(20 + i)) + ". " + " ".join(word() for _ in range(6)) + ".") for i in range(20)]
    docs = [(i, " ".join(word() for _ in range(200)), None, None) for i in range(100)]
    for i in range(20):
        w = items[i][1].split()
        if i % 2:
            w[3], w[7] = word(), word()  # a paraphrase of two words
        docs.append((500 + i, docs[i][1] + " | " + " ".join(w) + "%%% " + docs[i + 20][1], None, None))
    docs += [(700, None, None, None), (701, "", None, None)]
    bench = spark.createDataFrame(items + [(90, None), (91, "")], "item_id long, text string")
    got = decontamination.find(frame(spark, docs), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(500 + i, i) for i in range(20)}
    assert decontamination.find(frame(spark, docs), bench.limit(0)).count() == 0


def test_decontamination_recall_against_brute_force(spark):
    """Copies with 10 to 40 % of their words changed, the rarest first for every other one."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    common_words = [word() for _ in range(30)]
    sentence = lambda n: " ".join(rng.choice(common_words) if rng.random() < 0.7 else word() for _ in range(n))
    items = [(i, sentence(25 + i) + ". " + sentence(6) + ".") for i in range(24)]
    docs, bench = [(i, sentence(150), None, None) for i in range(200)], spark.createDataFrame(items, "item_id long, text string")
    for i, text in items:
        w = [x.strip(".") for x in text.split()]
        rare = sorted((w[j] in common_words, rng.random(), j) for j in range(len(w) - 6))
        for share in (10, 15, 19, 25, 30, 35, 39, 40):
            copy, n = text.split(), len(w) * share // 100
            for j in [j for *_, j in rare[:n]] if (i + share) % 2 else rng.sample(range(len(w) - 6), n):
                copy[j] = word() + "." * copy[j].endswith(".")
            docs.append((1000 + 100 * i + share, docs[i][1] + " " + " ".join(copy) + " " + docs[i + 24][1], None, None))
    split = lambda text: [w for w in re.sub(r"[.,|%]", " ", text.lower()).split()]

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            left = 0
            for j, y in enumerate(b):
                row[j + 1], left = (left + 1 if x == y else max(row[j + 1], row[j])), row[j + 1]
        return row[-1]

    # whole texts, no windows: what any passage of the item's length holds, and of twice that length and some
    must, may = set(), set()
    for d, text, *_ in docs[200:]:
        words = split(text)
        for k, item in items[(d - 1000) // 100 : (d - 1000) // 100 + 1]:
            want, answer = split(item), split(item)[-6:]
            spans = [words[s : s + len(want)] for s in range(len(words) - len(want) + 1)]
            holds = lambda w: any(w[i : i + 6] == answer for i in range(len(w)))
            if any(longest(w, want) >= (0.6 if holds(w) else 0.8) * len(want) - 1e-9 for w in spans):
                must.add((d, k))
            if longest(words, want) >= 0.5 * len(want) - 1e-9:
                may.add((d, k))
    assert len(must) > 150
    plain = {(r.doc_id, r.item_id) for r in decontamination.find(frame(spark, docs), bench, rank=0).collect()}
    got = {(r.doc_id, r.item_id) for r in decontamination.find(frame(spark, docs), bench).collect()}
    assert must <= plain <= got <= may
    kept = {r.doc_id for r in decontamination.clean(frame(spark, docs), bench).collect()}
    assert kept == {d[0] for d in docs} - {d for d, _ in got}


def topics(rng, n_topics=12, synonyms=14):
    """Words of each topic in pairs of synonyms, and sentences that take either of a pair."""
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(7))
    pairs = [[(word(), word()) for _ in range(synonyms)] for _ in range(n_topics)]
    return pairs, word, lambda t, n: [rng.choice(rng.choice(pairs[t])) for _ in range(n)]


def test_latent_space_finds_what_counts_cannot(spark):
    """Paraphrases that keep half of the words and take synonyms, which the corpus uses alike, for the rest."""
    rng = random.Random(5)
    pairs, word, sentence = topics(rng)
    items = [(t, " ".join(pairs[t][i % 14][0] for i in rng.sample(range(14), 14)) + ". " + " ".join(word() for _ in range(3)) + ".") for t in range(12)]
    docs = [(i, " ".join(sentence(i % 12, 60)), None, None) for i in range(360)]
    swap = {a: b for p in pairs for a, b in p}
    planted = []
    for t, text in items:
        w = text.replace(".", "").split()
        w[-3:] = [word() for _ in range(3)]  # the answer is gone
        for i in sorted(rng.sample(range(14), 4)):
            w[i] = swap[w[i]]
        planted.append((1000 + t, " ".join([*(word() for _ in range(40)), *w[:14], *(word() for _ in range(40))]), None, None))
    clean = [(2000 + i, " ".join(word() for _ in range(120)), None, None) for i in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = frame(spark, docs + planted + clean)
    hits = lambda rank: {r.doc_id for r in decontamination.find(df, bench, rank=rank).collect()} & {p[0] for p in planted + clean}
    without, found = hits(0), hits(24)
    assert not without and len(found) >= 10 and max(found) < 2000


@pytest.mark.parametrize("share", [50, 100])
def test_items_stretched_by_insertions_are_found(spark, share):
    rng = random.Random(share)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(20 + i)) + ".") for i in range(20)]
    docs = [(i, " ".join(word() for _ in range(200)), None, None) for i in range(50)]
    for i, text in items:
        w = text.rstrip(".").split()
        for _ in range(len(w) * share // 100):
            w.insert(rng.randrange(1, len(w)), word())
        docs.append((500 + i, docs[i][1] + " " + " ".join(w) + " " + docs[i + 1][1], None, None))
    got = decontamination.find(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(500 + i, i) for i in range(20)}


def test_slices_of_a_benchmark_decide_alike(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(24)) + ".") for i in range(9)]
    docs = [(i, " ".join(word() for _ in range(100)) + " " + " ".join(x if rng.random() < 0.75 else word() for x in items[i % 9][1].rstrip(".").split()), None, None) for i in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    hits = lambda: sorted((r.doc_id, r.item_id, r.start, r.stop, round(r.cosine, 6)) for r in decontamination.find(frame(spark, docs), bench).collect())
    one = hits()
    monkeypatch.setattr(decontamination, "ITEMS", 2)
    assert hits() == one and one


def test_warc(spark):
    rec = [
        (1, "response", "http://www.A.com/x/#top", 1, "e1", None, {"ETag": "e1", "Server": "s"}), (2, "revisit", "https://a.com/x", 5, "e1", None, {"Date": "d5", "Server": "no"}),
        (3, "response", "https://a.com/x", 6, "e2", None, {"ETag": "e2"}), (4, "revisit", "http://a.com/x/", 6, "e1", None, {}), (5, "revisit", "http://b.com", 9, None, None, None),
        (6, "revisit", None, 3, "e1", None, None), (7, "revisit", "http://a.com/x", None, "e1", None, None), (8, "revisit", "http://a.com/x?utm_source=q", 9, None, "m", {}),
    ]
    kind = "record_id long, type string, url string, ts long, etag string, last_modified string, headers map<string,string>"
    for slices in (1, 3, 1024):
        got = {r.record_id: r for r in warc.resolve_revisits(spark.createDataFrame(rec, kind), slices).collect()}
        assert {i: r.status for i, r in got.items()} == {1: "full", 2: "resolved", 3: "full", 4: "mismatch", 5: "orphan", 6: "orphan", 7: "orphan", 8: "unverified"}
        assert got[2].ref_id == 1 and got[4].ref_id == 3 and got[2].merged_headers == {"ETag": "e1", "Server": "s", "date": "d5"} or got[2].merged_headers["Date"] == "d5"
    assert warc.resolve_revisits(spark.createDataFrame([], kind)).count() == 0


def test_warc_files_round_trip(spark, tmp_path):
    rows = [{"type": "response", "url": "http://a.com/", "date": "2024-01-01T00:00:00Z", "headers": {"ETag": "x"}, "payload": b"hi\r\n\r\nthere"}]
    (tmp_path / "a.warc.gz").write_bytes(warc.write_warc(rows))
    got = warc.read_warc(spark, str(tmp_path)).first()
    assert bytes(got.payload) == rows[0]["payload"] and got.etag == "x" and got.url == "http://a.com/"


def test_empty_tables(spark):
    none = frame(spark, [])
    for f in (line_dedup.dedup_lines, simhash.near_duplicates, mixing.mix, pii.find, substring_dedup.remove_repeats):
        assert f(none).count() == 0, f
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_stages_judge_each_row_by_its_own_text(spark):
    """Null and repeated doc_ids, rows alike in everything, and a clean text beside a copy of its id."""
    import corpus_pipeline as cp

    text = lambda k: " ".join(f"w{(i * i + k * 7919) % 9973}" for i in range(80))
    rows = [(1, text(1)), (2, text(1)), (2, text(2)), (3, text(3)), (3, text(3)), (None, text(1)), (None, text(4)), (None, text(4)), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(map(str, ((r.doc_id, r.text) for r in cp.drop_near_copies(spark, docs, "").collect())))
    assert got == sorted(map(str, [(1, text(1)), (2, text(2)), (3, text(3)), (None, text(4)), (5, None)]))
    bench = spark.createDataFrame([(1, text(4)), (2, text(2))], "item_id long, text string")
    left = [(r.doc_id, r.text) for r in decontamination.clean(docs, bench).collect()]
    assert sorted(map(str, left)) == sorted(map(str, [r for r in rows if r[1] not in (text(4), text(2))]))
    mixed = cp.mix_sources(spark, docs, "").collect()
    total = mixing.mix(docs).agg(F.sum(F.col("copies") * F.col("size"))).first()[0]
    assert len(mixed) <= len(rows) and all(r.copies in (1, 2) for r in mixed) and sum(r.copies * r.size for r in mixed) == total


def test_embeddings_of_extreme_length(spark):
    rows = [(1, [1e-200, 2e-200], 1), (2, [1e200, 2e200], 1), (3, [-1e200, 2e200], 1)]
    got = {r.vec_id: r.component_id for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_pipeline_on_the_small_tables(spark):
    import corpus_pipeline as cp

    out = cp.run(spark, "/root/testdata/sf0.001")
    rows = out.collect()
    docs = {r.doc_id: r.text for r in common.table(spark, "/root/testdata/sf0.001", "documents").collect()}
    bench = [b" " + b" ".join(decontamination.words_of(r.text)) + b" " for r in common.table(spark, "/root/testdata/sf0.001", "benchmark").collect()]
    assert rows and len({r.doc_id for r in rows}) == len(rows) and {r.doc_id for r in rows} <= set(docs)
    assert all(r.copies in (1, 2) for r in rows)
    for r in rows:
        text = b" " + b" ".join(decontamination.words_of(r.text)) + b" "
        assert not any(b in text for b in bench)
    assert hashlib.sha256("".join(sorted(map(str, rows))).encode()).hexdigest() == hashlib.sha256("".join(sorted(map(str, cp.run(spark, "/root/testdata/sf0.001").collect()))).encode()).hexdigest()
