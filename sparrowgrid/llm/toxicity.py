"""Operator 5: toxicity by a weighted finite-state grammar over clauses.

Letter-to-letter transducers over token classes are composed into one machine: insults (one word
or several, after a degree word), threats (an act, or an intention and an act within reach),
negation, reported speech, target. What it writes is not the word but its role in the clause: a
plain, strong, targeted, negated or reported insult or threat. Clauses collect weighted roles; a
clause has a score of its own, and a document's score comes from its matched clauses. The weights
of insults and of roles are learned from labelled rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MARK_BITS, Stored, marked, marks, table

PREFIXES = (4, 5, 6)
SCOPE = 4
#: Share of the toxic rows that an entry of the lexicon stands in at least.
RARE = 0.006
ROLES = (
    "insult", "insult_target", "strong", "strong_target", "act", "act_target", "threat", "threat_target", "negated", "reported", "target_after",
)

# Closed word classes of the grammar, in four languages.
TARGETS = "you your yours u he she him her his they them their du dich dir dein deine ihr euch sie tu toi ton ta tes vous votre vos tú tus usted ustedes ellos".split()
NEGATIONS = "not no never none nobody isn't aren't don't nicht kein keine nie niemals pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says told claimed wrote quoted quote reported allegedly sagte sagt schrieb laut dit disait écrit selon dijo dice escribió según".split()
THREATS = "kill murder stab shoot burn hang destroy hurt beat töten umbringen erschießen tuer égorger matar asesinar".split()
INTENTS = "will would gonna going shall must should i'll we'll werde werden wird vais va allons voy vas vamos".split()
DEGREES = "so such very really total totally complete completely absolute utter fucking damn piece so'n ganz völlig tellement vraiment tan muy".split()
_EDGE = " \t\n.,;:!?\"'()[]{}<>*%$#&|=_-~/\\«»“”„¡¿"
_ENDS = ".;:!?"
_CLOSERS = "\"')]}»”*"

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, BOUNDARY, INTENT, DEGREE = range(9)


class Fst:
    """Deterministic letter transducer: step(state, letter) -> (state, letter), total."""

    def __init__(self, start, step, letters):
        self.start, self.letters = start, letters
        self.arcs, todo = {}, [start]
        while todo:
            s = todo.pop()
            for a in letters:
                if (s, a) not in self.arcs:
                    self.arcs[s, a] = step(s, a)
                    todo.append(self.arcs[s, a][0])

    def then(self, other: Fst) -> Fst:
        """Composition: ``other`` reads what this one writes."""

        def step(s, a):
            mine, out = self.arcs[s[0], a]
            theirs, out = other.arcs[s[1], out]
            return (mine, theirs), out

        return Fst((self.start, other.start), step, self.letters)

    def table(self) -> tuple[list[list[int]], list[list]]:
        """Numbered states, the start first: next state and output by letter."""
        states = list(dict.fromkeys([self.start, *(s for s, _ in self.arcs)]))
        number = {s: i for i, s in enumerate(states)}
        return (
            [[number[self.arcs[s, a][0]] for a in self.letters] for s in states],
            [[self.arcs[s, a][1] for a in self.letters] for s in states],
        )


def grammar(scope: int = SCOPE) -> Fst:
    """insult . threat . negation . reported speech . target; outputs are letters or names in ROLES."""

    def insult(state, a):
        """An insult within reach of a degree word, or right after another insult, is strong."""
        degree, chain = state
        if a == DEGREE:
            return (scope - 1, 0), OTHER
        if a == INSULT:
            return (0, 1), "strong" if degree or chain else "insult"
        return ((0, 0) if a == BOUNDARY else (max(0, degree - 1), 0)), a

    def threat(left, a):
        """An act of violence within reach of an intention is a threat."""
        if a == INTENT:
            return scope, OTHER
        out = ("threat" if left else "act") if a == THREAT else a
        return (0 if a == BOUNDARY else max(0, left - 1)), out

    hits = ("insult", "strong", "act", "threat")

    def negate(left, a):
        if a == NEGATION:
            return scope, OTHER
        return (0 if a == BOUNDARY else max(0, left - 1)), "negated" if left and a in hits else a

    def report(inside, a):
        if a == REPORT:
            return 1, OTHER
        return (0 if a == BOUNDARY else inside), "reported" if inside and a in hits else a

    def target(state, a):
        aim, hit = state
        rest = (max(0, aim - 1), max(0, hit - 1))
        if a == TARGET:
            return (scope, 0), ("target_after" if hit else OTHER)
        if a in hits:
            return (rest[0], scope), (f"{a}_target" if aim else a)
        return ((0, 0) if a == BOUNDARY else rest), a

    first = [OTHER, TARGET, NEGATION, REPORT, BOUNDARY, INTENT, THREAT, "insult", "strong"]
    second = [OTHER, TARGET, NEGATION, REPORT, BOUNDARY, *hits]
    machine = Fst((0, 0), insult, range(9)).then(Fst(0, threat, first))
    machine = machine.then(Fst(0, negate, second)).then(Fst(0, report, [*second, "negated"]))
    return machine.then(Fst((0, 0), target, [OTHER, TARGET, BOUNDARY, *hits, "negated", "reported"]))


def stem(word: str) -> str:
    return word.strip(_EDGE).lower()


class Tokens(dict):
    """Raw token -> class | boundary << 4 | index of its weight << 5, worked out once per token."""

    def __init__(self, lexicon: dict[str, float]):
        classes = ((INTENT, INTENTS), (DEGREE, DEGREES), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS))
        self.closed = {w: c for c, ws in classes for w in ws}
        self.terms = {t: i for i, t in enumerate(sorted(lexicon))}

    def __missing__(self, raw: str) -> int:
        if len(self) > 1 << 18:
            self.clear()
        w = stem(raw)
        code = self.closed.get(w, OTHER)
        if w and code == OTHER:
            term = self.terms.get(w + "$")
            for k in PREFIXES:
                term = term if term is not None or len(w) < k else self.terms.get(w[:k])
            if term is not None:
                code = INSULT | term << 5
        code |= (raw.rstrip(_CLOSERS)[-1:] in _ENDS and raw.rstrip(_CLOSERS) != "") << 4
        self[raw] = code
        return code


class Scorer:
    """Matched clauses of a text, and the document's features made of them."""

    def __init__(self, lexicon: dict[str, float]):
        self.tokens = Tokens(lexicon)
        self.weights = [lexicon[t] for t in sorted(lexicon)] or [0.0]
        self.next, self.out = grammar().table()
        self.role = {r: i for i, r in enumerate(ROLES)}

    def clauses(self, text: str | None) -> tuple[int, list[tuple[int, int, np.ndarray]]]:
        """(words, [(first word, last word + 1, weight of each role)]) for clauses that match."""
        words = (text or "").split()
        codes = np.fromiter(map(self.tokens.__getitem__, words), np.int64, len(words))
        kind = codes & 15
        out: list[tuple[int, int, np.ndarray]] = []
        if not ((kind == INSULT) | (kind == THREAT)).any():
            return len(words), out
        state, last, start, sums = 0, -1, 0, None
        for at in np.flatnonzero(codes).tolist():
            for _ in range(min(at - last - 1, SCOPE + 1)):  # then nothing is within reach any more
                state = self.next[state][OTHER]
            code = int(codes[at])
            letter = code & 15
            role = self.role.get(self.out[state][letter])
            state = self.next[state][letter]
            if role is not None:
                sums = np.zeros(len(ROLES)) if sums is None else sums
                sums[role] += self.weights[code >> 5] if letter == INSULT else 1.0
            if code & 16:
                state = self.next[state][BOUNDARY]
                if sums is not None:
                    out.append((start, at + 1, sums))
                start, sums = at + 1, None
            last = at
        if sums is not None:
            out.append((start, len(words), sums))
        return len(words), out

    def features(self, text: str | None) -> np.ndarray:
        """Roles summed over the matched clauses, the worst clause, and the density, all as log(1 + x)."""
        words, found = self.clauses(text)
        sums = sum((x for _, _, x in found), np.zeros(len(ROLES)))
        worst = max((x.sum() for _, _, x in found), default=0.0)
        return np.log1p([*sums, worst, 100 * sums.sum() / max(1, words)])


def terms_of(text: str | None) -> set[str]:
    """Whole words ('word$') and word beginnings that could be lexicon entries."""
    words = {w for w in map(stem, (text or "").split()) if len(w) >= 3}
    return {w + "$" for w in words} | {w[:k] for w in words for k in PREFIXES if len(w) >= k}


def _count_terms(docs: DataFrame, wanted: set[str] | None, least: float = 3) -> Counter:
    """Rows that hold each term. Terms in ``least`` of n rows or more: n / least times the terms of a row at most."""
    held = docs.sparkSession.sparkContext.broadcast(wanted)  # terms of RARE of the toxic rows or more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(terms_of(t) if held.value is None else terms_of(t) & held.value)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

    found = docs.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= max(3, least))
    return Counter({r.term: r.n for r in found.toLocalIterator()})


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Words and beginnings that toxic rows hold far more often than chance over all terms allows.

    Entries are log-odds, scaled to at most 1. A beginning is left out where a shorter one that
    is kept covers it, a whole word where a beginning does.
    """
    n1, n0 = rows.where("toxic = 1").count(), rows.where("toxic = 0").count()
    if not n1 or not n0:
        return {}
    bad = _count_terms(rows.where("toxic = 1"), None, RARE * n1)
    good = _count_terms(rows.where("toxic = 0"), set(bad))
    found = {}
    for t, k in bad.items():
        p, q = (k + 0.5) / (n1 + 1), (good[t] + 0.5) / (n0 + 1)
        # log-likelihood ratio of the term being independent of the label, against the number of terms
        m, rate = k + good[t], n1 / (n1 + n0)
        gain = k * math.log(max(k, 1e-9) / m / rate) + (good[t] * math.log(good[t] / m / (1 - rate)) if good[t] else 0)
        if p > 9 * q and gain > math.log(len(bad) + 1) + 3 and k >= RARE * n1:
            found[t] = math.log(p / q)
    top = max(found.values(), default=1.0)
    kept: dict[str, float] = {}
    for t in sorted(found, key=lambda t: (t.endswith("$"), len(t), t)):
        if not any(t[:k] in kept for k in PREFIXES if k < len(t)):
            kept[t] = found[t] / top
    return kept


def fit_weights(rows: DataFrame, size: int, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression on (toxic, x of ``size`` numbers) by Newton steps; the bias comes last.
    Gradient and Hessian are sums over all rows, a vector a task."""
    beta = np.zeros(size + 1)
    for _ in range(30):
        held = beta.copy()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + len(held) + len(held) ** 2)
            for b in batches:
                if b.num_rows:
                    x = np.hstack([b.column(1).flatten().to_numpy().reshape(b.num_rows, -1), np.ones((b.num_rows, 1))])
                    p = 1 / (1 + np.exp(-np.clip(x @ held, -30, 30)))
                    grad, hess = x.T @ (p - b.column(0).to_numpy()), (x * (p * (1 - p))[:, None]).T @ x
                    total += [b.num_rows, *grad, *hess.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

        parts = rows.mapInArrow(run, "v array<double>").select(F.posexplode("v")).groupBy("pos").agg(F.sum("col").alias("v"))
        total = np.array([r.v for r in sorted(parts.collect())])
        if not len(total) or not total[0]:
            break
        k = len(beta)
        step = np.linalg.solve(total[1 + k :].reshape(k, k) / total[0] + ridge / 10 * np.eye(k), total[1 : 1 + k] / total[0] + ridge / 10 * beta)
        beta = beta - step
        if np.abs(step).max() < 1e-12:
            break
    return beta


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) for each pair of a document and a label of it; null labels or ids are no labels.

    A mark set of the labelled ids keeps other texts from being shuffled. Labels are never broadcast,
    however few: what is shuffled are the labelled texts, at any size.
    """
    labels = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").alias("d"), F.col("toxic").cast("int").alias("toxic"))
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(MARK_BITS))  # noqa: E731  types of ids may differ
    held = docs.sparkSession.sparkContext.broadcast(marks(labels.select(place("d").alias("slot"))))  # MARK_BITS
    rows = docs.where("doc_id is not null").select("doc_id", "text", place("doc_id").alias("slot"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(marked(held.value, b.column(2).to_numpy()))).select([0, 1])

    rows = rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:2]))
    return rows.join(labels.hint("merge"), F.col("doc_id") == F.col("d")).select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], np.ndarray]:
    """(lexicon, weights) from (doc_id, toxic) labels and (doc_id, text) documents, all of them.

    Null labels or ids are no labels. Without both classes the model scores 0 everywhere it finds nothing.
    """
    rows = Stored(labelled(docs, labels))
    if rows.rows.isEmpty():
        return {}, np.append(np.ones(len(ROLES) + 2), -4.0)
    lexicon = learn_lexicon(rows.rows)
    scored = Stored(_features(rows.rows.select("text", "toxic"), lexicon, "toxic int"))
    beta = fit_weights(scored.rows, len(ROLES) + 2)
    rows.drop()
    scored.drop()
    return lexicon, beta


def _features(docs: DataFrame, lexicon: dict[str, float], keep: str) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for b in batches:
            x = [scorer.features(t.as_py()).tolist() for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(x, pa.list_(pa.float64()))], [*b.schema.names[1:], "x"])

    return docs.mapInArrow(run, f"{keep}, x array<double>")


def _kept(docs: DataFrame, keep: tuple[str, ...], *given: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Text and kept columns under names of our own, and what these stand for."""
    names = [(f"_k{i}", c) for i, c in enumerate(keep) if c not in given]
    return docs.select(F.col("text").alias("_scored"), *[F.col(c).alias(k) for k, c in names]), names


def _schema(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])


def score(docs: DataFrame, model: tuple[dict[str, float], np.ndarray], *keep: str) -> DataFrame:
    """``keep`` columns of ``docs`` with score and predicted (1 from 0.5 on), a row for each row.

    One pass over the text, no shuffle; what is broadcast is the lexicon, bounded by
    RARE. A null or empty text scores like a text without any match. Kept columns
    may have any name; one named score or predicted gives way to the result. Rows that repeat
    are scored each. Empty table: empty result.
    """
    lexicon, beta = model
    rows, names = _kept(docs, keep, "score", "predicted")
    rows = rows if names else rows.withColumn("_none", F.lit(0))
    x = _features(rows, lexicon, _schema(rows))
    z = F.lit(float(beta[-1]))
    for i, b in enumerate(beta[:-1]):
        z = z + F.col("x")[i] * float(b)
    p = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
    return x.select(*[F.col(k).alias(c) for k, c in names], p.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clause_scores(docs: DataFrame, model: tuple[dict[str, float], np.ndarray], *keep: str) -> DataFrame:
    """``keep`` columns with start, stop (words), roles and score, a row for each matched clause.

    roles maps what the machine wrote to its weight; the score is that of a text which is this
    clause alone. Null, empty and clean texts have no rows.
    """
    rows, names = _kept(docs, keep, "start", "stop", "roles", "score")
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by RARE
    kinds = _schema(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, beta = held.value
        scorer = Scorer(lexicon)
        for b in batches:
            for i, t in enumerate(b.column(0)):
                words, found = scorer.clauses(t.as_py())
                if found:
                    x = np.array([np.log1p([*s, s.sum(), 100 * s.sum() / (stop - start)]) for start, stop, s in found])
                    p = 1 / (1 + np.exp(-np.clip(x @ beta[:-1] + beta[-1], -30, 30)))
                    roles = [[(r, float(v)) for r, v in zip(ROLES, s) if v] for *_, s in found]
                    at = pa.array(np.full(len(found), i))
                    made = [pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32()), pa.array(roles, pa.map_(pa.string(), pa.float64())), pa.array(p)]
                    yield pa.RecordBatch.from_arrays([*[c.take(at) for c in b.columns[1:]], *made], [*b.schema.names[1:], "start", "stop", "roles", "score"])

    out = rows.mapInArrow(run, f"{kinds}{', ' if kinds else ''}start int, stop int, roles map<string,double>, score double")
    return out.select(*[F.col(k).alias(c) for k, c in names], "start", "stop", "roles", "score")


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def model_of(spark: SparkSession, sf_dir: str, docs: DataFrame) -> tuple[dict[str, float], np.ndarray]:
    """The model fitted on the labels outside the held-out fold; see ``train`` for nulls and empty tables."""
    labels = table(spark, sf_dir, "labels")
    return train(docs, labels.where(~held_out(F.col("doc_id"))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = model_of(spark, sf_dir, docs)
    return score(docs.withColumn("held_out", held_out(F.col("doc_id"))), model, "doc_id", "held_out")
