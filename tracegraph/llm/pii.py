"""Personal data spans: patterns propose, checksums confirm, words nearby move the score.

All of it is column expressions over the row. Places are code points, end exclusive. They
follow from the lengths of the matches and of the pieces between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracegraph.llm.common import fresh

# The patterns match what their plain forms match: an unbroken run is entered at its start only and
# quantifiers never give back, so long runs cost linear time and no stack.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# account numbers have one length for each country; where no country's length fits, the longest run is taken
IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
                23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
                28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
_FIXED = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])" for n, c in IBAN_LENGTHS.items())
IBAN = rf"(?<![A-Za-z0-9])(?:{_FIXED}|[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}(?![A-Za-z0-9]))"
# a long value of keys and tokens: letters and digits without a break
SECRET = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+=*+"
# a cheaper look that every text with a match passes
GUARD = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]",
         "secret": r"[A-Za-z0-9+/_-]{20}"}
PATTERN = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "secret": SECRET}
KINDS = list(PATTERN)  # base kinds first; the order breaks ties of equal starts
BASE = 4
# score without context; words within CONTEXT code points raise or lower it
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.85, "secret": 0.3}
GAIN = {"secret": 0.3}  # by what a word nearby raises the score, 0.15 for other kinds
RAISES = {"email": "mail|contact|write", "ip": "ip|host|server|address", "card": "card|visa|master|credit|pay", "phone": "phone|tel|call|mobile|fax",
          "iban": "iban|account|bank|transfer", "secret": "token|key|api|secret|passw|pwd|auth|credential|bearer"}
LOWERS = "order|invoice|version|serial|isbn|sample|test"
CONTEXT = 40  # code points on either side
CHUNK = 256


def _offsets(lengths: Column) -> Column:
    """Sums of ``lengths`` up to and with each place, by chunks, so that no array is built step by step."""
    add = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, v: s + v)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / CHUNK).cast("int")),
                         lambda c: add(F.slice(lengths, c * CHUNK + 1, F.lit(CHUNK))))
    whole = lambda i: F.floor(i / CHUNK).cast("int")
    return F.transform(F.array(chunks), lambda cs: F.transform(lengths, lambda _, i: add(F.slice(cs, F.lit(1), whole(i)))
                       + add(F.slice(lengths, whole(i) * CHUNK + 1, i % CHUNK + 1))))[0]


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    at = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.when((n - i) % 2 == 1, doubled(at(i))).otherwise(at(i)))
    return total % 10 == 0


def _mod97(account: Column) -> Column:
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda s, c: (s * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def _confirmed(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.rlike("^0*[0-9]{1,3}$") & (F.regexp_extract(p, "([0-9]{1,3})$", 1).cast("int") <= 255))
    if kind == "card":
        # Luhn over the whole number; the length comes first, so that long runs are not summed
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        plain = F.replace(match, F.lit(" "), F.lit(""))
        return F.when(F.length(plain).between(15, 34), _mod97(plain)).otherwise(False)
    if kind == "secret":
        # length, both letters and digits, and too many different characters for a word, a number or a rule of signs
        count = lambda p: F.regexp_count(match, F.lit(p))
        varied = F.size(F.array_distinct(F.split(match, ""))) >= 10
        return F.when(F.length(match) <= 512, (count("[0-9]") >= 4) & (count("[A-Za-z]") >= 4) & varied).otherwise(False)
    return F.lit(True)


SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string,text:string,score:double>>"


def _spans(text: Column, kind: str) -> Column:
    """Confirmed spans of one kind, in order."""
    pattern, rank = PATTERN[kind], KINDS.index(kind)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    lengths = F.zip_with(gaps, found, lambda g, m: (F.length(g) + F.coalesce(F.length(m), F.lit(0))).cast("bigint"))

    def build(ms: Column, ends: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            end = F.get(ends, i)
            start = end - F.length(m)
            around = F.lower(F.substring(text, F.greatest(start - CONTEXT + 1, F.lit(1)).cast("int"), (F.length(m) + 2 * CONTEXT).cast("int")))
            score = (F.lit(PRIOR[kind]) + F.when(around.rlike(rf"\b({RAISES[kind]})"), GAIN.get(kind, 0.15)).otherwise(0.0)
                     - F.when(around.rlike(rf"\b({LOWERS})"), 0.2).otherwise(0.0))
            return F.struct(start.cast("bigint").alias("start"), F.lit(rank).alias("rank"), end.cast("bigint").alias("end"),
                            F.lit(kind).alias("kind"), m.alias("text"), F.round(score, 2).alias("score"))

        return F.filter(F.transform(ms, one), lambda s: _confirmed(kind, s["text"]))

    bound = F.transform(F.array(F.struct(found.alias("m"), _offsets(lengths).alias("e"))), lambda b: build(b["m"], b["e"]))[0]
    guard = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(GUARD[kind])
    return F.when(guard, bound).otherwise(F.array().cast(SPAN)).cast(SPAN)


def find_pii(docs: DataFrame, text: str = "text", min_score: float = 0.5) -> DataFrame:
    """Add ``pii`` to ``docs``: array of (start, rank, end, kind, text, score), by start, then kind.

    Spans of the base kinds (email, ip, card, phone) stay whatever their score; an account number (iban) needs a
    right mod-97 checksum and ``min_score``, a secret (the value of a key or token) its length, characters and ``min_score``, which it reaches by a word nearby. Spans of different kinds may overlap. A null or empty text has no
    spans, repeated rows get equal ones, an empty table stays empty, and a column named ``pii`` gives way.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "pii"])
    t = fresh(docs.columns, "_t")
    kinds = [fresh(docs.columns, f"_{k}") for k in KINDS]
    x = docs.withColumn(t, F.coalesce(F.col(f"`{text}`"), F.lit("")))
    x = x.withColumns({c: _spans(F.col(t), k) for c, k in zip(kinds, KINDS)})
    good = F.filter(F.concat(*kinds), lambda s: (s["rank"] < BASE) | (s["score"] >= min_score))
    return x.withColumn("pii", F.sort_array(good)).drop(t, *kinds)


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """Replace every span found by its kind in brackets; of overlapping spans the first one counts. Adds ``redacted``."""
    t, p = F.col(f"`{text}`"), F.col("pii")
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(acc["out"], F.substring(t, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]"))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), piece.alias("out"))).otherwise(acc)

    tail = lambda acc: F.concat(acc["out"], F.substring(t, (acc["at"] + 1).cast("int"), F.length(t)))
    return found.withColumn("redacted", F.aggregate(p, begin, step, tail))
