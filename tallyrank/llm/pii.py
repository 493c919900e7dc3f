"""Personal data: patterns propose, checksums confirm, context scores (DataFrame functions only).

Base kinds are reported wherever they occur: ``email``, ``ip`` (parts at most 255),
``card`` (16 to 19 digits passing Luhn) and ``phone`` (8 to 15 digits). Added kinds:
``iban`` (mod-97 holds) and ``shortcard`` (13 to 15 digits passing Luhn), which are
reported if their score reaches ``threshold``. A score starts at the trust that the kind's
validator earns; it rises where a word of the kind's context stands within ``CONTEXT`` code
points, and falls where a word stands there that gives such a number another meaning.

Defined results: a null text counts as empty; each row is judged alone, so repeated rows
and null ids keep their place; no spans gives an empty string; an empty table gives an
empty result; other columns of the input are ignored, whatever their names; very long texts
are searched whole, in time linear in their length (closing repeats are possessive, which
Java matches in a loop; nothing follows them, so they find the same).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPANS, let, spans_between, spans_text

#: The base patterns. Where a run can't match from its middle, a look-behind
#: (or \G, just after a match) keeps the search linear without changing what is found.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"

#: kind -> (score of a confirmed match, context words that raise it, words that lower it)
_PAYMENT = "card|visa|master|mastercard|amex|credit|pay|payment|karte|tarjeta|carte"
_COUNTED = "isbn|ean|order|invoice|serial|tracking|reference|version"
TRUST = {
    "email": (0.9, "mail|email|contact|write|address", "example"),
    "ip": (0.5, "ip|host|server|addr|address", "version|release|section|chapter"),
    "card": (0.8, _PAYMENT, _COUNTED),
    "phone": (0.6, "phone|telephone|tel|call|mobile|fax", _COUNTED),
    "iban": (0.9, "iban|bank|account|konto|cuenta|compte", "example"),
    "shortcard": (0.3, _PAYMENT, _COUNTED),
}
CONTEXT = 40
BONUS = 0.3
PENALTY = 0.3
THRESHOLD = 0.5


def context_pattern(words: str) -> str:
    """One of the words, plural or not, with no letter beside it; for Java and RE2 alike."""
    return rf"(?i)(?:^|[^a-z])(?:{words})s?(?:[^a-z]|$)"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Luhn checksum of a string of ASCII digits."""
    each = F.transform(F.split(F.reverse(value), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(value: Column) -> Column:
    """ISO 7064 mod 97-10 over an IBAN: country and check digits last, letters as 10 to 35."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    place = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    step = lambda a, c: let(place(c), lambda v: (a * F.when(v < 10, 10).otherwise(100) + v) % 97)
    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def small_parts(value: Column) -> Column:
    def small(p):
        bare = F.regexp_replace(p, "^0+", "")
        return F.when(F.length(bare) > 3, False).otherwise(F.concat(F.lit("0"), bare).cast("int") <= 255)

    return F.forall(F.split(value, r"\."), small)


def _if(needle: Column, spans: Column) -> Column:
    return F.when(needle, spans).otherwise(F.array().cast(SPANS))


def _some(spans: Column, test) -> Column:
    return F.filter(spans, lambda s: test(s["value"]))


def proposals(text: Column) -> dict[str, Column]:
    """Confirmed spans by kind, base kinds first, in the order of the contract."""
    n = lambda v: F.length(digits(v))
    numbers = _if(text.rlike("[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]"), F.filter(spans_between(text, CARD), lambda s: F.length(s["value"]) >= 13))
    return {
        "email": _if(F.contains(text, F.lit("@")), spans_between(text, EMAIL)),
        "ip": _if(text.rlike(r"[0-9]\.[0-9]"), _some(spans_between(text, IP), small_parts)),
        "card": _some(numbers, lambda v: F.when(n(v).between(16, 19), luhn(digits(v))).otherwise(False)),
        "phone": _if(F.contains(text, F.lit("+")), _some(spans_between(text, PHONE), lambda v: n(v).between(8, 15))),
        "iban": _some(spans_between(text, IBAN), mod97),
        "shortcard": _some(numbers, lambda v: F.when(n(v).between(13, 15), luhn(digits(v))).otherwise(False)),
    }


SCORED = "array<struct<rank:int,start:int,end:int,kind:string,score:double>>"


#: Code points of the blocks in which context is looked up; finding a place in a text takes time in proportion to the place.
_BLOCK = 1024


def scored(text: Column, kind: str, rank: int, spans: Column) -> Column:
    trust, good, bad = TRUST[kind]

    def of(blocks):
        def one(s):
            first = F.greatest(s["start"] - CONTEXT, F.lit(0))
            block = lambda at: (at / _BLOCK).cast("int")
            cut = lambda at, n: F.substring(F.concat(F.get(blocks, block(at)), F.coalesce(F.get(blocks, block(at) + 1), F.lit(""))), at % _BLOCK + 1, n)
            after = F.when(block(s["end"]) < F.size(blocks), cut(s["end"], F.lit(CONTEXT)))
            around = F.concat_ws(" ", cut(first, s["start"] - first), F.coalesce(after, F.lit("")))
            near = lambda words, gain: F.when(around.rlike(context_pattern(words)), gain).otherwise(0.0)
            score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(trust) + near(good, BONUS) - near(bad, PENALTY)))
            return F.struct(F.lit(rank).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), score.alias("score"))

        return F.transform(spans, one)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, let(blocks, of)).otherwise(F.array().cast(SCORED))


def find_spans(df: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``key``, ``base`` and ``added`` spans with scores, each sorted by kind, then start."""
    t = F.coalesce(F.col("__t"), F.lit(""))
    rows = df.select(F.col(key).alias("__id"), F.col(text).alias("__t"))
    parts = [scored(t, kind, i, spans).alias(kind) for i, (kind, spans) in enumerate(proposals(t).items())]
    found = rows.select("__id", *parts)
    added = F.filter(F.concat("iban", "shortcard"), lambda s: s["score"] >= threshold)
    return found.select(F.col("__id").alias(key), F.concat("email", "ip", "card", "phone").alias("base"), added.alias("added"))


def report(df: DataFrame) -> DataFrame:
    found = find_spans(df)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    everything = F.concat("base", "added")
    return found.select(
        "doc_id",
        *(count(k) for k in ("email", "ip", "card", "phone")),
        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(everything).alias("spans"),
        F.array_join(F.transform(everything, lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )
