"""The pipeline, each stage against a plain version on what its predecessor kept."""

import re
from collections import Counter, defaultdict

import xxhash

import corpus_pipeline as cp
from sparrowgrid.llm import toxicity
from sparrowgrid.llm.common import cut, table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANKS = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain_lines(rows):
    holders = defaultdict(set)
    key = lambda line: lower(line.strip(BLANKS))
    for i, text in rows.items():
        for line in text.split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(i)
    drop = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    return {i: "\n".join(x for x in text.split("\n") if drop.get(key(x), i) == i) for i, text in rows.items()}


def plain_near(rows):
    sets, prints = {}, {}
    for i, text in rows.items():
        w = WORD.findall(lower(text))
        grams = [" ".join(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [" ".join(w)] if w else []
        sets[i] = set(grams)
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    up = {i: i for i in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(rows)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if rows[i] == rows[j] or (prints[i] ^ prints[j]).bit_count() <= 4 or both and both >= 0.8 * len(sets[i] | sets[j]) - 1e-12:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i for i in ids if root(i) == i}


MARKS = re.compile(r"""[.,:;!?"()\[\]{}<>*%$#&|=_~/\\\x00-\x20]+""")


def longest(a, at, m):
    """Common subsequence by bits; ``at``: places of each word of the item."""
    v = full = (1 << m) - 1
    for x in a:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


def plain_leaks(rows, items):
    """(documents that surely hold an item, documents that may)."""
    must, may = set(), set()
    for item in items:
        want = [w for w in MARKS.split(lower(item)) if w]
        at = defaultdict(int)
        for k, w in enumerate(want):
            at[w] |= 1 << k
        m = len(want)
        for i, text in rows.items():
            words = [w for w in MARKS.split(lower(text)) if w]
            if m and longest(words, at, m) >= 0.4 * m - 1e-9:
                may.add(i)
                if i not in must and any(longest(words[s : s + m], at, m) >= 0.8 * m - 1e-9 for s in range(max(1, len(words) - m + 1))):
                    must.add(i)
    return must, may


def test_stages_and_run_against_plain_versions(spark):
    docs = table(spark, SF, "documents")
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    flagged = {r.doc_id for r in toxicity.query(spark, SF).collect() if r.predicted}
    held = texts(docs)

    now = cut(cp.drop_toxic(spark, docs, SF))
    assert texts(now) == {i: t for i, t in held.items() if i not in flagged} and now.columns == docs.columns
    held = texts(now)

    now = cut(cp.drop_lines(spark, now, SF))
    want = plain_lines(held)
    assert texts(now) == want and all(r.n_chars == len(r.text) for r in now.collect())
    held = texts(now)

    now = cut(cp.drop_near_copies(spark, now, SF))
    assert set(texts(now)) == plain_near(held) and len(texts(now)) < len(held)
    held = texts(now)

    now = cut(cp.decontaminate(spark, now, SF))
    must, may = plain_leaks(held, [r.text for r in table(spark, SF, "benchmark").collect()])
    gone = set(held) - set(texts(now))
    assert must <= gone <= may and must
    held = texts(now)

    rows = now.collect()
    mixed = cp.mix_sources(spark, now, SF).collect()
    size = {i: len(WORD.findall(t)) for i, t in held.items()}
    source = {r.doc_id: r.source for r in rows}
    own = Counter()
    for i, s in source.items():
        own[s] += size[i]
    names = sorted(own, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(own.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * own[s]]
        for s in over or list(open_):
            target[s] = 2 * own[s] if over else share[s]
            open_.discard(s)
            left -= target[s]
    taken = Counter()
    for r in mixed:
        assert 1 <= r.copies <= 2 and r.text == held[r.doc_id] and r.size == size[r.doc_id]
        taken[r.source] += r.copies * r.size
    assert all(abs(taken[s] - target[s]) <= max(size[i] for i in size if source[i] == s) for s in names)

    whole = cp.run(spark, SF).collect()
    order = lambda rs: sorted((r.doc_id, r.text, r.source, r.copies) for r in rs)
    assert order(whole) == order(mixed)


def test_pipeline_of_empty_tables(spark, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        table(spark, SF, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
