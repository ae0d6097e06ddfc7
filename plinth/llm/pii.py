"""Personal data, with DataFrame functions only.

Regular expressions propose spans of each kind, validators confirm them (Luhn
for cards, mod-97 for IBANs, part ranges for addresses, digit counts for
telephone numbers), and words near a span adjust its score.

A pattern's places come from splitting the text at its matches: the gaps and the
matches alternate, so a running sum of their lengths gives each start.  The sum
goes on in chunks of ``CHUNK`` matches, whose own sums are added up first, and
only confirmed spans are collected, so a text of very many matches takes no list
that is copied for each of them.  A span's surroundings are the ends of the gaps
on either side, so that no place in the text has to be looked up.

The patterns are written so that a failed start isn't tried again inside the same
run (possessive quantifiers, and starts only where a run begins or the previous
match ended), which keeps the time linear and the stack flat in very long runs
without changing a match that a validator can confirm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm import common

#: Characters of a bank account number by country, as registered.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS",
    23: "AE GI IL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ CY DO GT HU LB PL",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT",
}
#: Patterns of the kinds.  Fixed values of the result's contract: email, ip, card, phone.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # A run of fewer than 12 digits is no card, and no place within a run is tried but its first.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])(?:" + "|".join(f"(?:{'|'.join(c.split())})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + r")(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+.-])(?<!\+[0-9]{1,3}[\x20-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:.])",
    "secret": r"(?i)(?<![A-Za-z0-9])(?:api[_-]?key|access[_-]?key|secret(?:[_-]?key)?|(?:auth|access)[_-]?token|token|password|passwd|pwd)[\x22\x27]?[\x20\t]{0,3}[:=][\x20\t]{0,3}[\x22\x27]?[A-Za-z0-9+/_=.~-]{8,}+",
    "key": r"(?<![A-Za-z0-9_])(?:AKIA[0-9A-Z]{16}(?![0-9A-Z])|gh[pousr]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9_-]{20,}+|eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)|-----BEGIN(?:\x20[A-Z]{1,12}){0,3}\x20PRIVATE\x20KEY-----",
}
BASE = ("email", "ip", "card", "phone")
#: A text without this needs no search for the kind.
HINT = {
    "email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"[0-9]-[0-9]{2}-[0-9]", "local_phone": r"[0-9][.-][0-9]{4}",
    "ipv6": r":[0-9A-Fa-f]{0,4}:", "secret": r"(?i)(?:key|secret|token|passw|pwd)[a-z]*[\x22\x27]?[\x20\t]{0,3}[:=]", "key": r"AKIA|gh[pousr]_|sk-|eyJ|-----BEGIN",
}
#: Score of a confirmed span before its surroundings are looked at; base kinds start above the threshold.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "local_phone": 0.35, "ipv6": 0.6, "secret": 0.8, "key": 0.9}
#: Words that speak for a kind, within ``NEAR`` characters before or after a span.
CONTEXT = {
    "email": r"e-?mail|mail|contact|write",
    "ip": r"\bip\b|address|server|host",
    "card": r"card|visa|credit|payment|karte|carte|tarjeta",
    "phone": r"phone|tel|call|mobile|fax|anruf",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "ssn": r"ssn|social|security|tax",
    "local_phone": r"phone|tel|call|mobile|fax|anruf",
    "ipv6": r"\bip(?:v6)?\b|address|server|host",
    "secret": r"login|user|auth|credential",
    "key": r"key|token|secret|auth",
}
#: Words that speak against personal data.
AGAINST = r"version|isbn|issn|example|order\s*(?:no|number)"
NEAR, BOOST, THRESHOLD = 40, 0.3, 0.5
#: Matches whose running sum is carried on together.
CHUNK = 512
_SPANS = "array<struct<start:bigint,end:bigint,m:string,near:string>>"


def matches(text: Column, kind: str) -> Column:
    """The confirmed ones of all leftmost non-overlapping matches: start, end (code points), the text and what is near it."""
    none = F.array().cast(_SPANS)

    def walk(gaps: Column, found: Column) -> Column:
        n = F.size(found)
        inside = lambda c: F.sequence(c * CHUNK, F.least(n, (c + 1) * CHUNK) - 1)
        size = lambda i: (F.length(F.get(gaps, i)) + F.length(F.get(found, i))).cast("long")

        def start_of_next(acc: Column, c: Column) -> Column:
            total = F.aggregate(inside(c), F.lit(0).cast("long"), lambda k, i: k + size(i))
            return F.struct((acc["at"] + total).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

        def one(acc: Column, i: Column) -> Column:
            m = F.get(found, i)
            end = acc["at"] + size(i)
            near = F.concat(F.right(F.get(gaps, i), F.lit(NEAR)), F.lit(" "), F.left(F.get(gaps, i + 1), F.lit(NEAR)))
            span = F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("m"), near.alias("near"))
            return F.struct(end.alias("at"), F.when(confirmed(kind, m), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

        chunks = F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int"))
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
        starts = F.aggregate(chunks, zero, start_of_next, lambda acc: acc["out"])
        within = lambda at, c: F.aggregate(inside(c), F.struct(at.alias("at"), none.alias("out")), one, lambda acc: acc["out"])
        return F.when(n > 0, F.flatten(F.transform(starts, within))).otherwise(none)

    split = F.struct(F.split(text, PATTERNS[kind], -1).alias("gaps"), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)).alias("found"))
    # The array of one makes the two a variable, that is found once.
    walked = F.get(F.transform(F.array(split), lambda s: walk(s["gaps"], s["found"])), F.lit(0))
    return F.when(text.rlike(HINT[kind]), walked).otherwise(none)


def luhn(digits: Column) -> Column:
    """Whether a string of digits has the check digit of payment cards."""

    def step(acc: Column, c: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.struct((acc["sum"] + F.when(acc["odd"], twice).otherwise(d)).alias("sum"), (~acc["odd"]).alias("odd"))

    zero = F.struct(F.lit(0).alias("sum"), F.lit(False).alias("odd"))
    return F.aggregate(F.split(F.reverse(digits), "(?!^)(?=.)"), zero, step, lambda acc: acc["sum"] % 10 == 0)


def mod97(iban: Column) -> Column:
    """Whether a bank account number, without spaces, leaves 1 by ISO 7064 mod 97-10."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(F.split(turned, "(?!^)(?=.)"), F.lit(0), step) == 1


def confirmed(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.when(F.length(digits) <= 19, luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "ip":
        return ~F.exists(F.split(m, r"\."), lambda p: ~p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "iban":
        return mod97(F.regexp_replace(m, " ", ""))
    if kind == "ssn":
        return ~m.rlike("^(?:000|666|9)|-00-|-0000$")
    if kind == "ipv6":
        groups = F.filter(F.split(m, ":"), lambda g: g != "")
        short = m.contains("::") & ~m.rlike(":::|::.*::") & F.size(groups).between(2, 7)
        whole = ~m.contains("::") & ~m.rlike("^:|:$") & (F.size(groups) == 8)
        return m.rlike("[0-9]") & (short & ~m.rlike("^:[^:]|[^:]:$") | whole)
    if kind == "secret":
        value = F.regexp_replace(m, r"^[^:=]*[:=][\x20\t\x22\x27]*", "")
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return F.lit(True)


def score(kind: str, near: Column) -> Column:
    """The prior, raised by a context word of the kind and lowered by a word that speaks against it."""
    around = F.lower(near)
    raised = F.when(around.rlike(CONTEXT[kind]), BOOST).otherwise(0.0)
    lowered = F.when(around.rlike(AGAINST), BOOST).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(PRIOR[kind]) + raised - lowered))


def _accepted(kind: str, rank: int) -> Column:
    """The kind's confirmed spans, scored."""

    def shaped(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), score(kind, s["near"]).alias("score"))

    spans = F.transform(matches(F.col("text"), kind), shaped)
    return spans if kind in BASE else F.filter(spans, lambda s: s["score"] >= THRESHOLD)


def _count(rank: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its id and ``spans``, by start, then kind as listed in ``PATTERNS``.

    A span has start and end (code points, end exclusive), kind, rank of the kind
    and score.  Base kinds are kept when confirmed, whatever
    their score; other kinds need a score of ``THRESHOLD``.  Null and empty texts
    have no spans; repeated rows are each searched; other columns are not read.
    """
    df = common.id_text(docs, id_col, text_col)
    parts = [_accepted(kind, rank) for rank, kind in enumerate(PATTERNS)]
    return df.select("doc_id", F.array_sort(F.concat(*parts)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query, from what ``find`` gives."""
    show = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    scores = F.array_join(F.transform("spans", lambda s: F.format_string("%.2f", s["score"])), ",")
    return found.select("doc_id", *(_count(i).alias(f"n_{k}") for i, k in enumerate(BASE)), F.sha2(show(base), 256).alias("base_sha256"), show(F.col("spans")).alias("spans"), scores.alias("scores"), F.size("spans").cast("long").alias("n_spans"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find(common.table(spark, sf_dir, "documents")))
