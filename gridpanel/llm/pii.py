"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score. SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of the base, then kinds that the method adds, in the order in which spans are listed.
BASE, ADDED = ("email", "ip", "card", "phone"), ("iban", "ssn", "tel")
LOCAL = "A-Za-z0-9._%+-"
#: The base patterns are the plain ones, written so that no text takes more than one pass: runs are
#: possessive, and an address is only tried where a run of its signs, or the rest after a match, begins.
PATTERN = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "tel": r"(?<![0-9+.-])\(?0[0-9]{2,4}\)?[\x20-][0-9]{3,4}[\x20-]?[0-9]{3,4}(?![0-9])",
}
#: A text without this sign has no match, which saves the pattern's pass.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-", "tel": "0"}
WORDS = {
    "email": "e-?mail|mail|contact|kontakt|correo|courriel",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon|telefono",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social|security|tax",
    "tel": "phone|tel|call|mobile|fax|telefon|telefono",
}
#: Score of a confirmed span, what a nearby word adds, what a span of an added kind needs, and how near is near.
SCORE = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "tel": 0.3}
NEARBY, LEAST, NEAR = 0.2, 0.5, 40
_STEP = "struct<at:int,n:int,m:string,near:string>"
#: Matches whose positions are summed up at a time, so that the work doesn't grow with their square.
_GROUP = 256


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number of capitals and digits leaves 1 modulo 97 (first four signs last, letters as 10 to 35)."""
    moved = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, F.lit(1), F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        a = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(a >= 65, rest * 100 + a - 55).otherwise(rest * 10 + a - 48) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(code)), F.lit(0), add) == 1


def _confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        short = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda p: F.when(F.length(short(p)) <= 3, F.concat(F.lit("0"), short(p)).cast("int") <= 255).otherwise(False))
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    if kind == "iban":
        code = F.regexp_replace(m, " ", "")
        return F.when(F.length(code).between(15, 34), mod97(code)).otherwise(False)
    return F.lit(True)


def _positions(matches: str, gaps: str) -> Column:
    """Start, length, match and surroundings of each match, from the matches and the text between them."""
    steps = f"transform(sequence(0, size({matches}) - 1), i -> named_struct('at', length({gaps}[i]), 'n', length({matches}[i]), 'm', {matches}[i], 'near', concat(right({gaps}[i], {NEAR}), '|', left({gaps}[i + 1], {NEAR}))))"
    groups = f"transform(sequence(0, (size(steps) - 1) div {_GROUP}), g -> slice(steps, g * {_GROUP} + 1, {_GROUP}))"
    walk = "aggregate(group, named_struct('pos', base, 'out', cast(array() as array<" + _STEP + ">)), (s, x) -> named_struct('pos', s.pos + x.at + x.n, 'out', concat(s.out, array(named_struct('at', s.pos + x.at, 'n', x.n, 'm', x.m, 'near', x.near)))), s -> s.out)"
    length = "aggregate(group, 0, (s, x) -> s + x.at + x.n)"
    bases = f"aggregate({{groups}}, named_struct('pos', 0, 'out', cast(array() as array<int>)), (s, group) -> named_struct('pos', s.pos + {length}, 'out', concat(s.out, array(s.pos))), s -> s.out)"
    one = lambda name, value, body: f"transform(array({value}), {name} -> {body})[0]"  # noqa: E731  a name for a value
    inner = one("groups", groups, one("bases", bases.replace("{groups}", "groups"), f"flatten(zip_with(groups, bases, (group, base) -> {walk}))"))
    return F.expr(f"CASE WHEN size({matches}) = 0 THEN cast(array() as array<{_STEP}>) ELSE {one('steps', steps, inner)} END")


def _kept(kind: str) -> Column:
    """The confirmed spans of a kind with their scores, from the column of its matches."""
    near = F.lit(rf"\b(?:{WORDS[kind]})\b")
    score = lambda x: F.least(F.lit(1.0), F.lit(SCORE[kind]) + F.when(F.regexp(F.lower(x["near"]), near), NEARBY).otherwise(0.0))
    found = F.coalesce(F.col(f"__s_{kind}"), F.expr(f"cast(array() as array<{_STEP}>)"))
    out = F.transform(F.filter(found, lambda x: _confirmed(kind, x["m"])), lambda x: F.struct(F.lit(kind).alias("kind"), x["at"].alias("start"), (x["at"] + x["n"]).alias("end"), score(x).alias("score")))
    return out if kind in BASE else F.filter(out, lambda x: x["score"] >= LEAST)


def spans(docs: DataFrame, keys: list[str], text: str = "text", kinds: tuple[str, ...] = BASE + ADDED) -> DataFrame:
    """keys and spans: array of (kind, start, end, score), by kind in the order of `kinds`, then start; code points, end exclusive.

    Matches of a kind are the leftmost ones that don't overlap; those whose
    checksum or numbers fail are dropped and their signs not tried again. Spans
    of the base kinds stay whatever their score; those of the added kinds need LEAST,
    which patterns without a checksum reach only with a word of their kind within
    NEAR characters. Null and empty texts have an empty array.
    """
    own = docs.select(*[F.col(k) for k in keys], F.coalesce(F.col(text), F.lit("")).alias("__t"))
    none = F.lit(None).cast("array<string>")
    found = lambda k: F.regexp_extract_all("__t", F.lit(PATTERN[k]), F.lit(0))
    own = own.select("*", *[(F.when(F.contains("__t", F.lit(NEEDS[k])), found(k)) if k in NEEDS else found(k)).alias(f"__m_{k}") for k in kinds])
    own = own.select("*", *[F.when(F.size(f"__m_{k}") > 0, F.split("__t", PATTERN[k], -1)).otherwise(none).alias(f"__g_{k}") for k in kinds])
    own = own.select(*keys, *[F.when(F.size(f"__m_{k}") > 0, _positions(f"__m_{k}", f"__g_{k}")).alias(f"__s_{k}") for k in kinds])
    parts = [_kept(k) for k in kinds]
    return own.select(*keys, F.concat(*parts).alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of(kind: str):
    return lambda s: s["kind"] == kind


def report(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, the counts of the base kinds, the digest of the base spans, all spans as a string, and their scores."""
    out = spans(docs, keys, text)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [F.size(F.filter("spans", _of(k))).cast("long").alias(f"n_{k}") for k in BASE]
    scores = F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",")
    return out.select(*keys, *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), scores.alias("scores"))

