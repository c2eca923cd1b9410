"""Personal data by weak supervision: labelers vote, EM weighs them, a trained classifier decides.

Candidates are the matches of the base patterns, base matches that fail their check, and two looser forms
(spelled-out e-mail addresses, phone numbers without a country code). Six labelers vote +1, -1 or 0 on each:
the strict pattern, the checksum or value range, a gazetteer (domain endings, calling codes, issuer digits,
reserved address ranges), cue words before, words before that speak against, and the written shape. Vote
patterns are counted over all documents; expectation-maximisation on the counts estimates each labeler's
reliability and each pattern's probability. A logistic regression is trained on surface features with those
probabilities as soft labels, over all candidates (as weighted distinct patterns). Base spans always stay; other
candidates are added where the classifier gives 0.5 or more.

Only DataFrame functions and MLlib are used on documents. What reaches the driver is one row per distinct
(kind, votes, features), at most ``6 * 3**6 * 2**5`` rows whatever the input.

Positions are code points, found by summing the lengths of what lies between matches, so no
position is searched for again. Defined cases: null and empty texts have no spans; long texts are read
whole; rows with equal ids are separate; without candidates nothing is trained and only base spans exist.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mutascope.llm import text as X

# The base patterns, written so that matching is linear: a match can only begin where a run of its characters
# begins or where the last match ended, and runs are not given back.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Looser forms.
SPELLED = r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]{1,63}){1,4}"
LOCAL = r"(?<![0-9+(.-])(?<![0-9] )\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])"

BASE = ("email", "ip", "card", "phone")
KINDS = BASE + ("spelled", "local")
VOTES = ("strict", "check", "gazetteer", "cue", "against", "shape")
FEATURES = ("long", "grouped", "fresh", "ended", "near")

# Public gazetteers.
ENDINGS = r"(?i)(?:com|org|net|edu|gov|int|mil|info|io|de|fr|es|uk|eu|us|ca|it|nl|ch|at|be|pt|se|no|pl|ru|cn|jp|in|br|au)$"
CALLING = r"^\+(?:1|20|27|3[0-46-9]|4[0-13-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"
ISSUER = r"^(?:4|5[1-5]|2[2-7]|3[47]|35|6011|65)"
RESERVED = r"^(?:0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
CUES = {
    "email": r"(?i)(?:mail|contact|write|reach|correo|courriel)[^.\n]{0,30}$",
    "spelled": r"(?i)(?:mail|contact|write|reach|correo|courriel)[^.\n]{0,30}$",
    "ip": r"(?i)(?:\bip\b|address|host|server|login|from)[^.\n]{0,30}$",
    "card": r"(?i)(?:card|visa|credit|account|iban|karte|carte|tarjeta)[^.\n]{0,30}$",
    "phone": r"(?i)(?:phone|tel\b|call|fax|mobile|whatsapp|telefon)[^.\n]{0,30}$",
    "local": r"(?i)(?:phone|tel\b|call|fax|mobile|whatsapp|telefon)[^.\n]{0,30}$",
}
AGAINST = r"(?i)(?:\bversion\b|\bv\.?|\bisbn\b|\bissn\b|\border\b|\binvoice\b|\bserial\b|\bbuild\b|\bsection\b|\bno\.|[#$€£%=])\s*$"


def _matches(text: Column, pattern: str) -> tuple[Column, Column]:
    """(matches, what lies between them)."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def _placed(matches: Column, between: Column) -> Column:
    """Array of (value, start, end, before, after)."""
    kind = "array<struct<value:string,start:int,end:int,before:string,after:string>>"
    state = f"struct<at:int,out:{kind}>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")).cast(state)

    def step(acc: Column, i: Column) -> Column:
        gap, value = F.get(between, i), F.get(matches, i)
        begin = acc["at"] + F.length(gap)
        end = begin + F.length(value)
        one = F.struct(value.alias("value"), begin.alias("start"), end.alias("end"), F.right(gap, F.lit(40)).alias("before"),
                       F.left(F.get(between, i + 1), F.lit(1)).alias("after"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out")).cast(state)

    whole = F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), start, step, lambda acc: acc["out"])
    return F.when(F.size(matches) > 0, whole).otherwise(F.array().cast(kind))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn's check on a digit string."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    """The base check of a base pattern's match."""
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")
    size = F.length(_digits(value))
    if kind == "card":
        return size.between(13, 19) & luhn(F.when(size.between(13, 19), _digits(value)).otherwise("1"))
    return size.between(9, 15) if kind == "phone" else F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit(1)).when(no, F.lit(-1)).otherwise(F.lit(0))


def _judged(kind: str, found: Column) -> Column:
    """Candidates of one kind with their votes and binary features."""
    never = F.lit(False)

    def one(m: Column) -> Column:
        value, before, after = m["value"], m["before"], m["after"]
        size = F.length(_digits(value))
        ok = passes(kind, value) if kind in BASE else never
        check = {"email": _vote(value.rlike(r"\.[A-Za-z]{2,24}$"), value.rlike(r"\.[0-9]+$")),
                 "ip": _vote(ok, ~ok), "card": _vote(ok, ~ok), "phone": _vote(ok, ~ok),
                 "spelled": _vote(value.rlike(r"[A-Za-z]{2,24}$"), value.rlike(r"[0-9]$")),
                 "local": _vote(size.between(9, 11), ~size.between(8, 12))}[kind]
        gazetteer = {"email": _vote(value.rlike(ENDINGS), never), "spelled": _vote(value.rlike(ENDINGS), never),
                     "ip": _vote(~value.rlike(RESERVED), value.rlike(RESERVED)),
                     "card": _vote(_digits(value).rlike(ISSUER) & size.between(13, 19), ~size.between(13, 19)),
                     "phone": _vote(value.rlike(CALLING), ~value.rlike(CALLING)),
                     "local": _vote(value.rlike(r"^\("), never)}[kind]
        shape = {"email": _vote(F.length(value) <= 64, F.length(value) > 254),
                 "spelled": _vote(F.length(value) <= 80, never),
                 "ip": _vote(value.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), value.rlike("[0-9]{4}")),
                 "card": _vote(value.rlike(r"^[0-9]{15,16}$|^[0-9]{4}(?:[ -][0-9]{4}){3}$"), value.rlike(r"^[0-9]+(?:[ -][0-9]{1,2})+$") | (size < 13)),
                 "phone": _vote(value.rlike(r"[ ().-]"), size < 9),
                 "local": _vote(value.rlike(r"^\(?[0-9]{3}\)?([ .-])[0-9]{3}[.-][0-9]{4}$"), value.rlike(r"^[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}$"))}[kind]
        ends = after.rlike(r"^[\s.,;:!?)\]\"']|^$")
        flags = (F.length(value) > 12, value.rlike(r"[ ().-]"), before.rlike(r"(?:^|[\s(:\"'<])$"), ends, before.rlike(r":\s*$"))
        return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), F.coalesce(ok, never).alias("base"),
                        _vote(ok, ~ok if kind in BASE and kind != "email" else never).alias("strict"), check.alias("check"), gazetteer.alias("gazetteer"),
                        _vote(before.rlike(CUES[kind]), never).alias("cue"), _vote(never, before.rlike(AGAINST)).alias("against"),
                        shape.alias("shape"), *[f.cast("int").alias(n) for n, f in zip(FEATURES, flags)])

    return F.transform(found, one)


def with_candidates(df: DataFrame, name: str = "candidates") -> DataFrame:
    """``df`` with an array of judged candidates of its ``text``, by kind and start. Digit runs shorter
    than a card's least length are not candidates of any kind."""
    text = F.coalesce("text", F.lit(""))
    # what each pattern cannot match without; found by a plain search
    digit = text.rlike("[0-9]")
    hints = {"email": F.instr(text, "@") > 0, "ip": digit & (F.instr(text, ".") > 0), "card": digit,
             "phone": F.instr(text, "+") > 0, "spelled": F.instr(text, "at)") + F.instr(text, "at]") > 0, "local": digit}
    patterns = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE, SPELLED, LOCAL)))
    columns = df.columns
    # one projection per step: matches, then places, then votes, so that nothing is worked out twice
    raw = []
    for kind, pattern in patterns.items():
        found, _ = _matches(text, pattern)
        raw.append(F.when(hints[kind], found).otherwise(F.array().cast("array<string>")).alias(f"_m_{kind}"))
    df = df.select(*columns, *raw)
    placed = []
    for kind, pattern in patterns.items():
        between = F.when(F.size(f"_m_{kind}") > 0, F.split(text, pattern, -1))
        placed.append(between.alias(f"_b_{kind}"))
    df = df.select(*columns, *[f"_m_{k}" for k in KINDS], *placed)
    df = df.select(*columns, *[_placed(F.col(f"_m_{k}"), F.col(f"_b_{k}")).alias(f"_p_{k}") for k in KINDS])

    def useful(kind: str) -> Column:
        if kind != "card":
            return F.col(f"_p_{kind}")
        return F.filter(F.col("_p_card"), lambda m: F.length(_digits(m["value"])) >= 13)

    df = df.select(*columns, *[_judged(k, useful(k)).alias(f"_c_{k}") for k in KINDS])
    return df.select(*columns, F.concat(*[f"_c_{k}" for k in KINDS]).alias(name))


# ---- learning ------------------------------------------------------------------------------------
def reliabilities(patterns: list, rounds: int = 40) -> tuple[list[float], dict]:
    """EM over vote patterns (rows with kind, votes, count): the probability of each row and, for each labeler,
    the smoothed chance of its vote being right when it votes."""
    p = [1 / (1 + math.exp(-1.5 * sum(r[v] for v in VOTES))) for r in patterns]
    rates: dict = {}
    for _ in range(rounds):
        prior = {}
        for k in KINDS:
            mine = [(q, r["count"]) for q, r in zip(p, patterns) if r["kind"] == k]
            prior[k] = (sum(q * c for q, c in mine) + 1) / (sum(c for _, c in mine) + 2)
        for v in VOTES:
            tally = {(y, x): 1.0 for y in (0, 1) for x in (-1, 0, 1)}
            tally[1, 1] += 2  # a labeler is taken to be better than chance until the counts say otherwise
            tally[0, -1] += 2
            for q, r in zip(p, patterns):
                tally[1, r[v]] += q * r["count"]
                tally[0, r[v]] += (1 - q) * r["count"]
            rates[v] = {k: t / sum(t2 for (y, _), t2 in tally.items() if y == k[0]) for k, t in tally.items()}
        p = []
        for r in patterns:
            odds = math.log(prior[r["kind"]] / (1 - prior[r["kind"]]))
            odds += sum(math.log(rates[v][1, r[v]] / rates[v][0, r[v]]) for v in VOTES)
            p.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    return p, rates


def _inputs(row) -> list[float]:
    """Kind, its surface features, and the votes that need no checksum."""
    return ([float(row["kind"] == k) for k in KINDS] + [float(row[f]) for f in FEATURES]
            + [float(row[v] == s) for v in VOTES for s in (1, -1)])


def train(candidates: DataFrame) -> list[float] | None:
    """Weights (last: intercept) of the span classifier from a table with ``candidates`` arrays."""
    spark = candidates.sparkSession
    rows = (candidates.select(F.explode("candidates").alias("c")).select("c.*")
            .groupBy("kind", *VOTES, *FEATURES).agg(F.count(F.lit(1)).alias("count"))).collect()
    rows.sort(key=lambda r: tuple(r))
    if not rows:
        return None
    p, _ = reliabilities(rows)
    data = [{"label": float(y), "weight": max(w, 1e-6) * r["count"], "features": _inputs(r)}
            for r, q in zip(rows, p) for y, w in ((1, q), (0, 1 - q))]
    # as an Arrow table: a list would start Python workers of a second kind in the executors
    frame = spark.createDataFrame(pa.Table.from_pylist(data)).withColumn("features", array_to_vector("features")).coalesce(1)
    model = LogisticRegression(weightCol="weight", regParam=0.001, maxIter=50).fit(frame)
    return [*map(float, model.coefficients), float(model.intercept)]


def accepted(candidates: Column, weights: list[float] | None) -> Column:
    """Candidates that are base spans or that the classifier accepts."""
    if weights is None:
        return F.filter(candidates, lambda c: c["base"])

    def odds(c: Column) -> Column:
        inputs = ([c["kind"] == k for k in KINDS] + [c[f] == 1 for f in FEATURES] + [c[v] == s for v in VOTES for s in (1, -1)])
        total = F.lit(weights[-1])
        for w, x in zip(weights, inputs):
            total = total + F.when(x, F.lit(w)).otherwise(F.lit(0.0))
        return total

    return F.filter(candidates, lambda c: c["base"] | (odds(c) >= 0))


def _text_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """Counts, digest of base spans, and all spans of every document."""
    found = X.written(with_candidates(docs.select("doc_id", "text")).drop("text"), "pii")
    weights = train(found)
    base = F.filter("candidates", lambda c: c["base"])
    out = found.select("doc_id", base.alias("base"), accepted(F.col("candidates"), weights).alias("all"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda c: c["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    return out.select("doc_id", *counts, F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"), _text_of(F.col("all")).alias("spans"))


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets; other columns as they are.

    The texts are read twice: once for training, once for masking; they are neither stored nor shuffled.
    """
    weights = train(X.written(with_candidates(docs.select("text")).drop("text"), "pii"))
    rows, back = X.hidden(docs, "text")
    found = with_candidates(rows, "_candidates")
    spans = F.array_sort(F.transform(accepted(F.col("_candidates"), weights),
                                     lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))))
    found = found.withColumn("_spans", spans)
    text = F.col("text")
    state = "struct<at:int,out:array<string>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")).cast(state)

    def step(acc: Column, s: Column) -> Column:
        fresh = F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(s["start"] >= acc["at"], F.concat(acc["out"], fresh)).otherwise(acc["out"]).alias("out")).cast(state)

    clean = F.aggregate("_spans", zero, step,
                        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return found.withColumn("text", F.when(F.size("_spans") > 0, clean).otherwise(text)).select(*back)
