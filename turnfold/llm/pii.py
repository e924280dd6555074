"""Operator 3: personal data by weak supervision, in DataFrame functions only.

Patterns give candidate spans. Four labelers vote on each: the strict format, a gazetteer, the words
before it, and its neighbouring characters. Expectation-maximisation over the counts of vote patterns
(at most 4 * 3^4 rows, whatever the input) estimates how reliable each labeler is for each kind, and
its posteriors train a logistic span classifier, applied as an expression. Spans of the strict
formats always stay; the classifier adds others.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("format", "gazetteer", "context", "edges")
ROUNDS, STEPS, RATE = 30, 300, 0.5
#: A span beyond the strict formats needs so much probability.
ADD = 0.9
#: Characters of context before a span.
BEFORE = 40

# fixed values of the formats; repeats are possessive, or start only where a run starts, so that the
# time is linear in the text
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
IP_PARTS = rf"^{PART}\.{PART}\.{PART}\.{PART}$"
#: On a text whose separators beside separators are blotted out; so each that is left stands alone.
CARD = "[0-9][0-9 -]*[0-9]"
DOUBLED = "[ -](?=[ -])|(?<=[ -])[ -]"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
SPELT_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}+(?: ?[\[(] ?dot ?[\])] ?[A-Za-z0-9-]{1,63}+){1,4}+"
LONG_IP = "(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])"
LOCAL_PHONE = r"(?<![0-9A-Za-z+.(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"

# gazetteers
DOMAINS = r"(?i)(?:\.|dot ?[\])] ?)(?:com|org|net|edu|gov|mil|info|io|co|eu|uk|de|fr|es|it|nl|ch|at|be|us|ca|au|in|br|jp|cn)$"
ISSUERS = "^(?:4|5[1-5]|2[2-7]|3[4-9]|6)"
UNROUTED = r"^(?:0|127|255)\."
COUNTRIES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
# words before a span
SAYS = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|login|from)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment)\b",
    "phone": r"(?i)\b(?:tel|telephone|phone|call|fax|mobile|cell)\b",
}
DENIES = r"(?i)\b(?:version|order|invoice|isbn|issn|serial|page|section)\b"

Span = "struct<kind:int,s:int,e:int,base:boolean,format:int,gazetteer:int,context:int,edges:int>"


def _found(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>> of all matches, in code points: gaps and matches add up to places."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m")))
    none = F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["g"]
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.array_append(acc["out"], F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"))).alias("out"))

    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int")
        twice = F.substr(F.lit("0246813579"), d + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _spans(text: Column, kind: str, pattern: str, where: Column, strict, candidate, gazetteer, scan: Column | None = None) -> Column:
    """Candidates of one pattern with their votes. strict, candidate, gazetteer: of a match."""
    number = KINDS.index(kind)

    def span(x: Column) -> Column:
        before = F.substr(text, F.greatest(F.lit(1), x["s"] + 1 - BEFORE), F.least(F.lit(BEFORE), x["s"]))
        sides = F.concat(F.when(x["s"] > 0, F.substr(text, x["s"], F.lit(1))).otherwise(" "), F.substr(text, x["e"] + 1, F.lit(1)))
        good = strict(x["m"])
        return F.struct(
            F.lit(number).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), good.alias("base"),
            _vote(good, ~good).alias("format"),
            _vote(gazetteer(x["m"]), ~gazetteer(x["m"])).alias("gazetteer"),
            _vote(before.rlike(SAYS[kind]), before.rlike(DENIES)).alias("context"),
            _vote(~sides.rlike("[0-9A-Za-z]"), sides.rlike("[0-9A-Za-z]")).alias("edges"),
        )

    out = F.transform(F.filter(_found(text if scan is None else scan, pattern), lambda x: candidate(x["m"])), span)
    return F.when(where, out).otherwise(F.expr(f"cast(array() as array<{Span}>)"))


def candidates(text: Column) -> Column:
    """All candidate spans of a text with their votes, strict ones before others."""
    yes, no = (lambda m: F.lit(True)), (lambda m: F.lit(False))
    n = lambda m: F.length(_digits(m))
    blotted = F.regexp_replace(text, DOUBLED, "_")
    return F.concat(
        _spans(text, "email", EMAIL, F.contains(text, F.lit("@")), yes, yes, lambda m: m.rlike(DOMAINS)),
        _spans(text, "ip", IP, text.rlike("[0-9][.][0-9]"), yes, lambda m: m.rlike(IP_PARTS), lambda m: ~m.rlike(UNROUTED)),
        _spans(text, "card", CARD, text.rlike("[0-9](?:[ -]?[0-9]){12}"), lambda m: _luhn(_digits(m)), lambda m: n(m).between(13, 19), lambda m: _digits(m).rlike(ISSUERS), blotted),
        _spans(text, "phone", PHONE, text.rlike("[+][0-9]"), yes, lambda m: n(m).between(9, 15), lambda m: m.rlike(COUNTRIES)),
        _spans(text, "email", SPELT_EMAIL, text.rlike(r"[\[(] ?at ?[\])]"), no, yes, lambda m: m.rlike(DOMAINS)),
        _spans(text, "ip", LONG_IP, text.rlike("(?::[0-9A-Fa-f]{1,4}){7}"), no, yes, yes),
        _spans(text, "phone", LOCAL_PHONE, text.rlike("[0-9]{3}[ .-][0-9]{4}"), no, yes, lambda m: ~m.rlike(r"^\(?[01]")),
    )


def reliabilities(patterns: Sequence[tuple[int, tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[dict, dict]:
    """EM over (kind, votes, count): posterior of each pattern, and per kind (prior, yes, no), where
    yes[j][v] is the chance that labeler j votes v on a true span. Labelers that abstain count too;
    labelers are taken as independent given the truth, and start as right in 3 of 4 votes."""
    posterior, model = {}, {}
    for kind in sorted({k for k, _, _ in patterns}):
        own = [(v, n) for k, v, n in patterns if k == kind]
        post = {v: 1 / (1 + 3.0 ** -sum(v)) for v, _ in own}
        for _ in range(rounds):
            total = sum(n for _, n in own)
            mass = sum(n * post[v] for v, n in own)
            prior = (mass + 1) / (total + 2)
            yes = [{x: (sum(n * post[v] for v, n in own if v[j] == x) + (2 if x == 1 else 0.5)) / (mass + 3) for x in (-1, 0, 1)} for j in range(len(LABELERS))]
            no = [{x: (sum(n * (1 - post[v]) for v, n in own if v[j] == x) + (2 if x == -1 else 0.5)) / (total - mass + 3) for x in (-1, 0, 1)} for j in range(len(LABELERS))]
            for v, _ in own:
                odds = math.log(prior / (1 - prior)) + sum(math.log(yes[j][x] / no[j][x]) for j, x in enumerate(v))
                post[v] = 1 / (1 + math.exp(-max(-40.0, min(40.0, odds))))
        posterior |= {(kind, v): p for v, p in post.items()}
        model[kind] = (prior, yes, no)
    return posterior, model


def classifier(patterns: Sequence[tuple[int, tuple[int, ...], int]], posterior: dict) -> dict[int, list[float]]:
    """Per kind the weights (votes, then bias) of a logistic classifier trained on the posteriors."""
    out = {}
    for kind in sorted({k for k, _, _ in patterns}):
        own = [((*v, 1), n, posterior[kind, v]) for k, v, n in patterns if k == kind]
        total, w = sum(n for _, n, _ in own), [0.0] * (len(LABELERS) + 1)
        for _ in range(STEPS):
            g = [1e-3 * x for x in w]
            for x, n, p in own:
                err = n / total * (1 / (1 + math.exp(-max(-40.0, min(40.0, sum(a * b for a, b in zip(w, x, strict=True)))))) - p)
                g = [a + err * b for a, b in zip(g, x, strict=True)]
            w = [a - RATE * b for a, b in zip(w, g, strict=True)]
        out[kind] = w
    return out


def _printed(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    name = lambda x: F.get(kinds, x["kind"])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["s"].cast("string"), x["e"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for every row of `docs`.

    The counts and the hash are of the strict formats; `spans` also has what the classifier adds, at
    least ADD likely and apart from all strict spans of its kind. Null and empty texts have no spans.
    Repeated rows are treated alike, each by itself. Without any candidate nothing is learnt or added.
    Other columns are not read. Empty tables give no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    seen = C.written(docs.select("doc_id", text.alias("text")).select("doc_id", candidates(F.col("text")).alias("all")), "pii-candidates")
    votes = [F.col(f"x.{j}") for j in LABELERS]
    counted = seen.filter(F.size("all") > 0).select(F.explode("all").alias("x")).groupBy("x.kind", *votes).count().collect()  # at most 4 * 3^4 rows
    patterns = [(r[0], tuple(r[1:5]), r[5]) for r in sorted(counted)]
    weights = classifier(patterns, reliabilities(patterns)[0])
    base = F.array_sort(F.filter("all", lambda x: x["base"]))

    def likely(x: Column) -> Column:
        odds = F.lit(-40.0)
        for kind, w in weights.items():
            odds = F.when(x["kind"] == kind, sum((x[j] * F.lit(w[i]) for i, j in enumerate(LABELERS)), F.lit(w[-1]))).otherwise(odds)
        return 1 / (1 + F.exp(-odds)) >= ADD

    apart = lambda x: ~F.exists("base", lambda b: (b["kind"] == x["kind"]) & (b["s"] < x["e"]) & (x["s"] < b["e"]))
    out = seen.withColumn("base", base)
    out = out.withColumn("added", F.filter("all", lambda x: ~x["base"] & likely(x) & apart(x)))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *[count(k) for k in KINDS], F.sha2(_printed(F.col("base")), 256).alias("base_sha256"), _printed(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))
