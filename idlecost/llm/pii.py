"""Personal data: patterns propose spans, checksums confirm them, context adjusts a score.

All of it is DataFrame functions.  A kind is a pattern, a check of the found string
and the words that make it likelier or unlikelier nearby.  ``split`` and
``regexp_extract_all`` on the same pattern give the pieces between matches and the
matches, whose lengths add up to each match's place in code points.  The patterns are
possessive and begin where a match can begin (``\\G`` or not inside a run of their first
class), so they take time in proportion to the text whatever it holds; a text without
a kind's tell-tale character is skipped for that kind.

Base kinds (email, ip, card, phone) are kept whenever their check holds.  The added
kinds need a score of ``MIN_SCORE``: their own score plus ``NEAR_BONUS`` if one of their
context words stands within ``NEAR`` code points, minus ``FAR_MALUS`` if a denying word does.
Context words are whole words (``classname`` is no ``ssn``); one that the distance cuts is not near.

Defined cases: null counts as empty; without a match counts are 0 and both span
strings empty; matches that fail their check are dropped without another try; repeated
rows get equal results; other columns are ignored by ``pii_spans`` and returned
unchanged by ``redact``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idlecost.llm.common import full_text, table

NEAR = 40
NEAR_BONUS = 0.35
FAR_MALUS = 0.25
MIN_SCORE = 0.6
#: Words near any kind that make it unlikelier.
DENYING = r"(?i)\b(?:example|sample|dummy|test|version|order no|isbn)\b"


class Kind(NamedTuple):
    name: str
    tell_tale: str  # no match without one of these (a pattern), or "" to search always
    pattern: str
    score: float
    context: str
    base: bool


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

# The base patterns of the contract in possessive form, and the added kinds.
KINDS = [
    Kind("email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9,
         r"(?i)\b(?:e-?mails?|contact|correos?|courriels?|write to)\b", True),
    Kind("ip", r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6,
         r"(?i)\b(?:ips?|address(?:es)?|servers?|hosts?|adressen?)\b", True),
    Kind("card", "[0-9]", r"[0-9](?:[\x20-]?+[0-9])++", 0.6,
         r"(?i)\b(?:cards?|visa|master(?:card)?|credit|(?:kredit)?karten?|tarjetas?|cartes?)\b", True),
    Kind("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6,
         r"(?i)\b(?:(?:tele)?phones?|tel|call|mobile|fax|anruf|anrufen|llama|llamar)\b", True),
    Kind("iban", "[A-Z][A-Z][0-9][0-9]", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", 0.7,
         r"(?i)\b(?:ibans?|accounts?|konto|kontonummer|banks?|bankverbindung|cuentas?|comptes?)\b", False),
    Kind("ssn", "[0-9]-[0-9][0-9]-[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.4,
         r"(?i)\b(?:ssns?|social security|tax ids?)\b", False),
]
_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _mod97(s: Column) -> Column:
    """The number that the rearranged letters and digits spell, modulo 97."""
    plain = F.regexp_replace(s, r"\x20", "")
    turned = F.concat(F.substring(plain, 5, 1000), F.substring(plain, 1, 4))
    values = F.transform(F.split(turned, ""), lambda c: F.instr(F.lit(_ALPHABET), c) - 1)
    return F.aggregate(values, F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97)


def _confirmed(kind: str, s: Column) -> Column:
    if kind == "ip":
        return s.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        # Only strings of the right length reach the checksum.
        digits = _digits(s)
        return F.when(F.length(digits).between(12, 19), F.call_function("luhn_check", digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(s)).between(9, 15)
    if kind == "iban":
        return _mod97(s) == 1
    if kind == "ssn":
        return ~s.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _spans(text: Column, order: int, kind: Kind) -> Column:
    """array<struct<start, order, end, kind, score>> of one kind's confirmed spans."""
    between, found = F.split(text, kind.pattern), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    # Running places: the pieces and matches before each match.
    steps = F.transform(found, lambda m, i: F.struct(
        F.length(F.element_at(between, i + 1)).alias("gap"), F.length(m).alias("size"), m.alias("match")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,match:string>>").alias("out"))
    placed = F.aggregate(steps, begin, lambda a, s: F.struct(
        (a["at"] + s["gap"] + s["size"]).alias("at"),
        F.concat(a["out"], F.array(F.struct((a["at"] + s["gap"]).alias("start"), (a["at"] + s["gap"] + s["size"]).alias("end"), s["match"].alias("match")))).alias("out")),
        lambda a: a["out"])

    def scored(s: Column) -> Column:
        # One code point more than NEAR tells whether the distance cuts a word.
        before = F.substring(text, F.greatest(s["start"] - NEAR, F.lit(1)), F.least(s["start"], F.lit(NEAR + 1)))
        after = F.substring(text, s["end"] + 1, F.lit(NEAR + 1))
        near = F.concat_ws(" ", F.when(s["start"] > NEAR, F.regexp_replace(before, r"^\w+", "")).otherwise(before),
                           F.when(F.length(after) > NEAR, F.regexp_replace(after, r"\w+$", "")).otherwise(after))
        score = F.lit(kind.score) + F.when(near.rlike(kind.context), NEAR_BONUS).otherwise(0.0) - F.when(near.rlike(DENYING), FAR_MALUS).otherwise(0.0)
        return F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind.name).alias("kind"),
                        F.round(F.least(score, F.lit(1.0)), 2).alias("score"))

    spans = F.transform(F.filter(placed, lambda s: _confirmed(kind.name, s["match"])), scored)
    if not kind.base:
        spans = F.filter(spans, lambda s: s["score"] >= MIN_SCORE)
    tell_tale = text.contains("@") if kind.tell_tale == "@" else text.rlike(kind.tell_tale)
    return F.when(tell_tale, spans).otherwise(F.array().cast("array<struct<start:int,order:int,end:int,kind:string,score:double>>"))


def with_spans(docs: DataFrame, text_col: str = "text", out: str = "pii_spans") -> DataFrame:
    """``docs`` with all confirmed spans in order of their start, then of the kinds."""
    text = full_text(text_col)
    return docs.withColumn(out, F.array_sort(F.flatten(F.array(*[_spans(text, i, k) for i, k in enumerate(KINDS)]))))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span in ``text_col`` replaced by its kind in brackets; of overlapping spans the first."""
    # The caller's row travels as one column, whatever its columns are called.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    found = with_spans(rows, "text", "spans")
    text = full_text("text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    masked = F.aggregate("spans", start, lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(
        s["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"))))
    new = F.when(F.size("spans") > 0, F.concat("masked.out", F.substring(text, F.col("masked.at") + 1, F.length(text)))).otherwise(F.col("text"))
    return found.withColumn("masked", masked).select(
        *[(new if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, and all spans."""
    found = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    spans = F.col("pii_spans")

    def joined(a: Column) -> Column:
        return F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    n_base = sum(k.base for k in KINDS)
    def number(order: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["order"] == order)).cast("long")

    counts = [number(i).alias(f"n_{k.name}") for i, k in enumerate(KINDS) if k.base]
    return found.select("doc_id", *counts, F.sha2(joined(F.filter(spans, lambda s: s["order"] < n_base)), 256).alias("base_sha256"),
                        joined(spans).alias("spans"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(table(spark, sf_dir, "documents"))
