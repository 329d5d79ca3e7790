"""Operator 1: personal data by weak supervision. DataFrame functions only.

Labelers (regex validity, gazetteer, context, boundary) vote on candidate spans. Their
reliabilities come from expectation-maximisation over vote patterns, and a logistic span
classifier is fitted to the posteriors. Both see counts of cells (kind x votes x length
class), whose number is fixed by construction and not by the data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

KINDS = ("email", "ip", "card", "phone", "iban", "secret", "name")
#: Kinds with a base pattern; the others are found by the method alone.
BASE = KINDS[:4]

# Starts of words: a match begins where its run of characters begins, or where the last match
# ended (\G). Possessive groups keep the engine iterative, whatever the length of a run.
_LOCAL = r"[A-Za-z0-9._%+-]"
_EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Candidates beyond the base patterns: spelled-out addresses, IPv6, national numbers, account
#: numbers, assigned secrets, names after a title.
_SPELLED = r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+[\x20]?[\[({]at[\])}][\x20]?[A-Za-z0-9-]{1,63}+(?:[\x20]?[\[({]dot[\])}][\x20]?[A-Za-z0-9-]{1,63}+|\.[A-Za-z0-9-]{1,63}+)++"
_IPV6 = r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}|:):(?:[0-9A-Fa-f]{0,4}:){1,6}[0-9A-Fa-f]{0,4}(?![\w:.])"
_NATIONAL = r"(?<![0-9+(.-])(?:\([0-9]{3}\)[\x20]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}(?:[\x20]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_SECRET = r"""(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{16})(?<=(?i:token|secret|key|password|passwd|pwd)["']?[\x20]?[:=][\x20]?["']?)[A-Za-z0-9+/_-]++"""
_NAME = r"(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra)\.?[\x20]\p{Lu}\p{Ll}{1,40}+(?:[\x20-]\p{Lu}\p{Ll}{1,40}+){0,2}"
#: (kind, base, pattern, cheap test that a text must pass)
PATTERNS = (
    ("email", True, _EMAIL, "@"),
    ("ip", True, _IP, r"[0-9]\.[0-9]"),
    ("card", True, _CARD, "[0-9]"),
    ("phone", True, _PHONE, r"\+[0-9]"),
    ("email", False, _SPELLED, r"(?i)[\[({]at[\])}]"),
    ("ip", False, _IPV6, ":[0-9A-Fa-f]{0,4}:"),
    ("phone", False, _NATIONAL, r"[0-9]{3}[\x20.-][0-9]{4}"),
    ("iban", False, _IBAN, "[A-Z]{2}[0-9]{2}"),
    ("secret", False, _SECRET, "(?i)(?:token|secret|key|password|passwd|pwd)[\"']?[\\x20]?[:=]"),
    ("name", False, _NAME, r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra)\.?[\x20]\p{Lu}"),
)

#: Gazetteers and context words.
TLDS = "com org net edu gov mil info io co us uk de fr es it nl eu at ch be pl pt se no dk fi ca au br mx jp cn in ru".split()
COUNTRIES = "AT BE CH CZ DE DK ES FI FR GB GR HU IE IT LU NL NO PL PT SE".split()
CONTEXT = {
    "email": "mail|e-mail|email|contact|write|kontakt|courriel|correo",
    "ip": "ip|host|server|address|adresse|login|client",
    "card": "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta",
    "phone": "tel|phone|call|fax|mobile|cell|telefon|appelez|llame",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "secret": "token|secret|key|api|password|passwd|pwd|auth|bearer",
    "name": "name|contact|dear|signed|liebe|lieber|cher|chère|estimado|estimada",
}
AGAINST = "version|isbn|issn|order|invoice|build|serial|sku|article|token|hash"
VOTES = 4
ROUNDS = 50


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        d = _digits(m)
        return F.length(d).between(12, 19) & F.call_function("luhn_check", d)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "ipv6":
        twice = F.size(F.split(m, "::")) - 1
        return (twice == 1) | (twice == 0) & (F.size(F.split(m, ":")) == 8)
    if kind == "iban":  # the remainder by 97 of the number with its head put last, letters as two digits
        bare = F.regexp_replace(m, " ", "")
        turned = F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4))
        digits = F.filter(F.split(turned, ""), lambda c: c != "")
        rest = lambda acc, c: F.when(c < "A", acc * 10 + F.ascii(c) - 48).otherwise(acc * 100 + F.ascii(c) - 55) % 97
        return F.aggregate(digits, F.lit(0), rest) == 1
    return F.lit(True)


def _gazetteer(kind: str, m: Column) -> Column:
    """1: the span names something that exists, -1: it can't."""
    if kind == "email":
        good = F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1)).isin(*TLDS)
    elif kind == "ip":
        good = ~m.rlike(r"^(0|10|127|169\.254|192\.168|22[4-9]|2[3-5][0-9])\.")
    elif kind == "card":
        good = _digits(m).rlike(r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35)")
    elif kind == "phone":
        good = _digits(m).rlike(r"^(1?[2-9][0-9]{2}[2-9]|[2-9][0-9])")
    elif kind == "iban":
        good = F.substring(m, 1, 2).isin(*COUNTRIES)
    elif kind == "secret":
        good = m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    else:
        good = m.rlike(r"[\x20-]\p{Lu}\p{Ll}+[\x20-]\p{Lu}\p{Ll}")
    return F.when(good, 1).otherwise(-1)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column, merge) -> Column:
    """Inclusive running sums (or maxima) of an array by doubling steps: n log n, where an array
    that grows by one in each step of a fold would be copied each time."""

    def step(acc: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(acc, lambda x, i: F.when(i >= back, merge(x, F.get(acc, i - back))).otherwise(x))

    rounds = lambda v: F.filter(F.sequence(F.lit(0), F.lit(30)), lambda k: F.call_function("shiftleft", F.lit(1), k) < F.size(v))
    return _let(values, lambda v: F.aggregate(rounds(v), v, step))


_SPAN = "struct<kind:int,start:int,end:int,base:boolean,cell:string>"


def _spans(text: Column, kind: str, base: bool, pattern: str, test: str) -> Column:
    """array<struct> of the pattern's matches with their votes.

    Positions come from the pieces between the matches: a match ends where the running sum of
    the lengths of all pieces and matches up to it does.
    """
    none = F.array().cast(f"array<{_SPAN}>")
    valid = "ipv6" if pattern is _IPV6 else kind

    def span(m: Column, before: Column, after: Column, end: Column) -> Column:
        near = F.lower(F.right(before, F.lit(40)))
        ok = _valid(valid, m)
        context = F.when(near.rlike(rf"\b({CONTEXT[kind]})\b"), 1).when(near.rlike(rf"\b({AGAINST})\b"), -1).otherwise(0)
        joined = F.right(before, F.lit(1)).rlike("[A-Za-z0-9_]") | F.substring(after, 1, 1).rlike("[A-Za-z0-9_]")
        cell = F.concat_ws(
            ",",
            F.lit(KINDS.index(kind)),
            F.when(ok & F.lit(base), 1).when(ok, 0).otherwise(-1),
            _gazetteer(kind, m),
            context,
            F.when(joined, -1).otherwise(1),
            F.least(F.floor(F.length(m) / 8), F.lit(4)),
        )
        keep = ok | F.length(_digits(m)).between(15, 16) if kind == "card" else ok
        return F.when(keep, F.struct(F.lit(KINDS.index(kind)).alias("kind"), (end - F.length(m)).alias("start"), end.alias("end"), (ok & F.lit(base)).alias("base"), cell.alias("cell")))

    def place(found: Column) -> Column:
        def ends(gaps: Column) -> Column:
            sums = running(F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m)), lambda x, y: x + y)
            each = lambda at: F.transform(found, lambda m, i: span(m, F.get(gaps, i), F.get(gaps, i + 1), F.get(at, i)))
            return _let(sums, each)

        return F.filter(_let(F.split(text, pattern, -1), ends), lambda s: s.isNotNull())

    may = F.instr(text, test) > 0 if test == "@" else text.rlike(test)
    found = F.when(may, F.regexp_extract_all(text, F.lit(pattern), 0))
    return _let(found, lambda found: F.when(F.size(found) > 0, place(found)).otherwise(none))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<kind,start,end,base,cell>>), a row for each row of ``docs``.

    Candidates of the method that overlap a base span are left out: among spans by start, the
    farthest end of a base span so far lies beyond the start, or the next base span starts
    before the end.
    """
    text = F.coalesce("text", F.lit(""))

    def apart(spans: Column) -> Column:
        far = running(F.transform(spans, lambda s: F.when(s["base"], s["end"]).otherwise(-1)), F.greatest)
        near = F.reverse(running(F.reverse(F.transform(spans, lambda s: F.when(s["base"], s["start"]).otherwise((1 << 31) - 1))), F.least))
        clear = lambda far, near: F.filter(spans, lambda s, i: s["base"] | (F.get(far, i) <= s["start"]) & (F.get(near, i) >= s["end"]))
        return _let(far, lambda x: _let(near, lambda y: clear(x, y)))

    by_start = lambda spans: F.transform(
        F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (~s["base"]).alias("more"), s["end"].alias("end"), s["kind"].alias("kind"), s["cell"].alias("cell")))),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), (~s["more"]).alias("base"), s["cell"].alias("cell")),
    )
    kept = docs.select("doc_id", F.concat(*[_spans(text, *p) for p in PATTERNS]).alias("found"))
    mixed = F.exists("found", lambda s: ~s["base"]) & F.exists("found", lambda s: s["base"])
    return kept.select("doc_id", F.when(mixed, _let(by_start(F.col("found")), apart)).otherwise(F.col("found")).alias("spans"))


def fit(cells: list[tuple[str, int]], rounds: int = ROUNDS) -> dict[str, float]:
    """Cell -> probability that its spans are personal data. At most 7 x 3^4 x 5 cells.

    EM (two classes, labelers independent given the class, smoothed counts), each kind on its
    own; then a logistic classifier on the votes and the length class, weighted by counts and
    fitted to the posteriors by gradient steps.
    """
    out: dict[str, float] = {}
    for kind in range(len(KINDS)):
        rows = [([int(x) for x in c.split(",")], n, c) for c, n in cells if c.split(",")[0] == str(kind)]
        if not rows:
            continue
        total = sum(n for _, n, _ in rows)
        post = [min(0.95, max(0.05, 0.5 + 0.15 * sum(v[1 : 1 + VOTES]))) for v, _, _ in rows]
        for _ in range(rounds):
            prior = (sum(p * n for p, (_, n, _) in zip(post, rows)) + 1) / (total + 2)
            table_ = {}
            for y in (0, 1):
                weight = [(p if y else 1 - p) * n for p, (_, n, _) in zip(post, rows)]
                for j in range(VOTES):
                    for value in (-1, 0, 1):
                        hit = sum(w for w, (v, _, _) in zip(weight, rows) if v[1 + j] == value)
                        # labelers are taken to be better than chance: their pseudo-counts say so
                        table_[y, j, value] = (hit + (2.0 if value == (1 if y else -1) else 0.5)) / (sum(weight) + 3.0)
            post = []
            for v, _, _ in rows:
                score = math.log(prior / (1 - prior)) + sum(math.log(table_[1, j, v[1 + j]] / table_[0, j, v[1 + j]]) for j in range(VOTES))
                post.append(1 / (1 + math.exp(-max(-30.0, min(30.0, score)))))
        feats = [[1.0, *map(float, v[1 : 1 + VOTES]), v[-1] / 4] for v, _, _ in rows]
        beta = [0.0] * len(feats[0])
        for _ in range(300):
            grad = [0.02 * b for b in beta]
            for x, p, (_, n, _) in zip(feats, post, rows):
                z = max(-30.0, min(30.0, sum(a * b for a, b in zip(beta, x))))
                miss = (1 / (1 + math.exp(-z)) - p) * n / total
                grad = [g + miss * a for g, a in zip(grad, x)]
            beta = [b - g for b, g in zip(beta, grad)]
        for x, (_, _, c) in zip(feats, rows):
            out[c] = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(beta, x))))))
    return out


def find(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, spans): array<struct<kind,start,end,base>> by start, then kind, per row of ``docs``.

    Base spans (the four patterns with their checks) always stay; further candidates (of the
    four kinds, account numbers, secrets, names) stay if the classifier gives them ``least`` or
    more and they overlap no base span. Offsets are code
    points, the end exclusive. The text is read once; what remains of it, the candidates, is
    cut and read twice (counts, scores).

    Nulls: a null text is empty; a null doc_id is carried along. Repeated rows are rows of
    their own. No candidates at all, or an empty table: empty spans, or no rows.
    """
    found = cut(candidates(docs))
    counts = found.select(F.explode("spans.cell").alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    scores = fit(sorted((r.cell, r.n) for r in counts.collect()))  # bounded: one row per cell
    good = F.array(*[F.lit(c) for c, p in sorted(scores.items()) if p >= least]).cast("array<string>")
    kept = F.filter("spans", lambda s: s["base"] | F.array_contains(good, s["cell"]))
    return found.select(
        "doc_id",
        F.transform(
            F.array_sort(F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base")))),
            lambda s: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base")),
        ).alias("spans"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        *[F.size(F.array_remove(F.transform(base, lambda s: s["kind"] == k), False)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )
