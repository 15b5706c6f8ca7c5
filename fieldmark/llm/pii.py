"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Native: built-in functions only; one pass over the documents, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import ascii_lower, table, whole_text
from fieldmark.llm.spans import ONE, matches, said, spans

# The base patterns, written so that each has the plain pattern's leftmost matches
# but gives up a run of its characters after one try (no quadratic search in long runs).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Added by the method.
#: Length of an IBAN without blanks -> country codes (the ISO 13616 registry, and countries that use IBANs without an entry).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CM CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR",
    27: "BF BI CF CG DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
# A match is an IBAN's start, so that a candidate which fails its check hides no other; group 1 is the whole candidate.
IBAN = r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?=(" + "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + r")(?![A-Za-z0-9]))[A-Z]{2}[0-9]{2}"
NATIONAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: Words that raise a span's score when they stand, whole, within spans.NEAR code points before or after it.
CONTEXT = {
    "email": "e-?mail|mail|contact|write|kontakt|correo",
    "ip": "ip|host|server|address|adresse",
    "card": "card|visa|credit|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon|telefono",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "national": "ssn|social|security|insurance|national",
}
PRIOR = {"email": 0.7, "ip": 0.5, "card": 0.4, "phone": 0.5, "iban": 0.4, "national": 0.3}
CONFIRMED, NEARBY, KEEP = 0.4, 0.3, 0.5


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9]", "")


def _luhn(x: Column) -> Column:
    each = F.transform(
        F.split(F.reverse(_digits(x)), ""),
        lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise((d.try_cast("int") * 2) % 10 + F.floor(d.try_cast("int") / 5).cast("int")),
    )
    total = F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0)))
    return total % 10 == 0


def _mod97(x: Column) -> Column:
    bare = F.replace(x, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))
    rest = F.aggregate(
        F.filter(F.split(turned, ""), lambda c: c != ""),
        F.lit(0),
        lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97).cast("int"),
    )
    return F.length(bare).between(15, 34) & (rest == 1)


def _ibans(text: Column, found: Column) -> Column:
    """The IBANs among the candidates whose starts are found: those that pass mod-97, none within another."""
    whole = F.when(F.size(found) > 0, F.regexp_extract_all(text, F.lit(IBAN), F.lit(1))).otherwise(F.array().cast("array<string>"))
    each = F.zip_with(spans(text, IBAN, found), whole, lambda s, v: F.struct(s["start"].alias("start"), (s["start"] + F.length(v)).cast("bigint").alias("end"), v.alias("value"), s["before"].alias("before"), F.substring(s["after"], F.length(v) - 3, F.lit(64)).alias("after")))
    valid = F.filter(each, lambda s: _mod97(s["value"]))
    apart = lambda acc, s: F.when(s["start"] >= F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0)), F.concat(acc, F.array(s)).cast(ONE)).otherwise(acc)
    return F.aggregate(valid, F.array().cast(ONE), apart)


def maybe(text: Column) -> dict[str, tuple[str, Column]]:
    """kind -> its pattern and a cheap necessary condition, in the contract's order of kinds, then the method's own."""
    digit = text.rlike("[0-9]")
    return {
        "email": (EMAIL, F.contains(text, F.lit("@"))),
        "ip": (IP, digit & F.contains(text, F.lit("."))),
        "card": (CARD, digit),
        "phone": (PHONE, F.contains(text, F.lit("+"))),
        "iban": (IBAN, digit),
        "national": (NATIONAL, digit & F.contains(text, F.lit("-"))),
    }


def confirmed(kind: str, found: Column) -> Column:
    """Without the spans that fail their kind's check."""
    small = lambda s: F.forall(F.split(s["value"], r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))
    many = lambda s, lo, hi: F.length(_digits(s["value"])).between(lo, hi)
    tests = {"ip": small, "card": lambda s: many(s, 16, 19) & _luhn(s["value"]), "phone": lambda s: many(s, 8, 15)}
    return F.filter(found, tests[kind]) if kind in tests else found


BASE = ("email", "ip", "card", "phone")
CHECKED = ("card", "iban", "ip")


SCORED = "array<struct<kind:string,start:bigint,end:bigint,value:string,score:double,context:string>>"


def scored(kind: str, found: Column) -> Column:
    """Adds kind, score and the context word that raised it ("" without one); spans of the method's own kinds need a
    score of KEEP, base spans stay whatever it is."""

    def one(s: Column) -> Column:
        near = ascii_lower(F.concat_ws("\n", s["before"], s["after"]))
        word = F.regexp_extract(near, rf"(?<![a-z0-9])({CONTEXT[kind]})(?![a-z0-9])", 1)
        score = F.lit(PRIOR[kind] + CONFIRMED * (kind in CHECKED)) + F.when(word != "", NEARBY).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.least(score, F.lit(1.0)).alias("score"), word.alias("context"))

    out = F.transform(found, one)
    return (out if kind in BASE else F.filter(out, lambda s: s["score"] >= KEEP)).cast(SCORED)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, then per kind an array<struct<kind,start,end,value,score,context>>.

    Null text counts as empty and has no spans; empty tables give empty results; repeated rows are
    judged each by itself; a null doc_id is kept. Only doc_id and text are read of the input, so
    further columns never clash.
    """
    rows = docs.select("doc_id", whole_text().alias("text"))
    text, kinds = F.col("text"), maybe(F.col("text"))
    rows = rows.select("doc_id", "text", *[matches(text, *v).alias(k) for k, v in kinds.items()])
    rows = rows.select("doc_id", "text", *[(_ibans(text, F.col(k)) if k == "iban" else confirmed(k, spans(text, v[0], F.col(k)))).alias(k) for k, v in kinds.items()])
    return rows.select("doc_id", *[scored(k, F.col(k)).alias(k) for k in kinds])


def op4_personal_data(spark, sf_dir: str) -> DataFrame:
    rows = personal_data(table(spark, sf_dir, "documents"))
    texts = {k: said(k, F.col(k)) for k in PRIOR}
    base = F.concat(*[texts[k] for k in BASE])
    return rows.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(*texts.values()), ",").alias("spans"),
        F.size("iban").cast("long").alias("n_iban"),
        F.size("national").cast("long").alias("n_national"),
        F.array_join(F.transform(F.concat(*map(F.col, PRIOR)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), F.format_number(s["score"], 1), s["context"])), ",").alias("scores"),
    )
