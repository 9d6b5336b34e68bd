"""Personal data: patterns propose spans, checksums confirm them, context words move the score.

Only DataFrame functions are used. One pass over the scan, no shuffle.

Defined results: a null text is an empty text (no spans); null or repeated ids and repeated rows
are reported row by row; other columns of the input are ignored by ``detect`` and kept by
``redact``, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_rows
from .spans import Kind, count_of, cut, joined, pieces, replaced, with_spans

BASE = ["email", "ip", "card", "phone"]
ADDED = ["iban", "ssn", "short_card"]

#: Words that make a finding more likely when they stand near it.
CONTEXT = {
    "email": "mail|contact|write|correo|courriel",
    "ip": "ip|host|server|address|adresse|login",
    "card": "card|visa|mastercard|credit|payment|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|telefon",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social|security|taxpayer",
    "short_card": "card|visa|maestro|credit|payment|karte|carte|tarjeta",
}
#: Score of a bare pattern match, what a checksum that holds adds, what a near context word adds.
PRIOR = {"email": 0.7, "ip": 0.6, "card": 0.3, "phone": 0.6, "iban": 0.2, "ssn": 0.4, "short_card": 0.1}
CHECKSUM = {"card": 0.4, "iban": 0.5, "short_card": 0.3}
NEAR = 0.3
#: Added spans below this score are not reported; base spans always are. So an account number needs its
#: checksum, a social security number a context word, and a short card number both.
THRESHOLD = 0.6
#: Code points looked at on either side of a span.
REACH = 40

#: Length of account numbers by country, after the registry of ISO 13616. Fixed values.
IBAN_LENGTH = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
    32: "LC", 33: "RU",
}
IBAN = "(?:" + "|".join(rf"(?:{'|'.join(names.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, names in IBAN_LENGTH.items()) + ")"


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a string of digits passes the Luhn check."""
    def weigh(i: Column) -> Column:
        d = F.substring(digits, F.char_length(digits) - i + 1, F.lit(1)).cast("int")
        doubled = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 0, doubled).otherwise(d)
    weights = F.transform(F.sequence(F.lit(1), F.char_length(digits)), weigh)
    return F.aggregate(weights, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """True if an account number without blanks has remainder 1."""
    turned = F.concat(F.substring(iban, F.lit(5), F.char_length(iban)), F.substring(iban, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c))) == 1


def _byte(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return (F.char_length(bare) < 3) | ((F.char_length(bare) == 3) & (bare <= "255"))


def _alone(before: Column, after: Column) -> Column:
    return ~before.rlike("[A-Za-z0-9]") & ~after.rlike("[A-Za-z0-9]")


#: Runs start only where no character of the run's own class stands before, or where the last match
#: ended (\G); with possessive quantifiers no text can make the matcher go quadratic or recurse.
KINDS = [
    Kind(
        "email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        hint=lambda t: F.contains(t, F.lit("@")),
    ),
    Kind(
        "ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        accept=lambda m, g, b, a: F.forall(F.split(m, r"\."), _byte),
        hint=lambda t: t.rlike(r"[0-9]\.[0-9]"),
    ),
    Kind(
        "card", r"[0-9](?:[\x20-]?+[0-9])++",
        accept=lambda m, g, b, a: F.char_length(digits_of(m)).between(14, 19) & luhn(digits_of(m)),
        hint=lambda t: t.rlike(r"[0-9](?:[\x20-]?+[0-9]){13}"),
        valid=lambda m: F.lit(True),
    ),
    Kind(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]",
        accept=lambda m, g, b, a: F.char_length(digits_of(m)).between(10, 15),
        hint=lambda t: F.contains(t, F.lit("+")),
    ),
    Kind(
        "iban", IBAN,
        accept=lambda m, g, b, a: _alone(b, a),
        hint=lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
        valid=lambda m: mod97(F.replace(m, F.lit(" "), F.lit(""))),
        neighbours=True,
    ),
    Kind(
        "ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        accept=lambda m, g, b, a: _alone(b, a) & ~F.substring(m, 1, 3).isin("000", "666") & (F.substring(m, 1, 1) != "9") & (F.substring(m, 5, 2) != "00") & (F.substring(m, 8, 4) != "0000"),
        hint=lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
        neighbours=True,
    ),
    Kind(
        "short_card", r"[0-9](?:[\x20-]?+[0-9])++",
        accept=lambda m, g, b, a: F.char_length(digits_of(m)).between(12, 13),
        hint=lambda t: t.rlike(r"[0-9](?:[\x20-]?+[0-9]){11}"),
        valid=lambda m: luhn(digits_of(m)),
    ),
]


def _score() -> str:
    """Prior of a span ``s``'s kind, plus its checksum's weight if that holds, plus the context's; at
    most 1."""
    around = f"concat({cut('__parts', f'greatest(s.start - {REACH}, 0)', 's.start')}, ' ', {cut('__parts', 's.stop', f'least(s.stop + {REACH}, __size)')})"
    sure = " ".join(f"WHEN '{k}' THEN {PRIOR[k]}D + CASE WHEN s.valid THEN {CHECKSUM.get(k, 0.0)}D ELSE 0D END" for k in BASE + ADDED)
    words = " ".join(f"WHEN '{k}' THEN r'(?i)(^|[^A-Za-z])({CONTEXT[k]})([^A-Za-z]|$)'" for k in BASE + ADDED)
    return f"least(1D, CASE s.kind {sure} END + CASE WHEN rlike({around}, CASE s.kind {words} END) THEN {NEAR}D ELSE 0D END)"


def find(df: DataFrame, text: str, to: str) -> DataFrame:
    """Add ``to``: array of (start, rank, stop, kind, body, score) by start, then kind."""
    out = with_spans(df.withColumn("__text", F.coalesce(F.col(text), F.lit(""))), "__text", KINDS, "__found")
    out = out.withColumns({"__parts": F.when(F.size("__found") > 0, pieces("__text")), "__size": F.char_length("__text")})
    scored = F.expr(f"transform(__found, s -> named_struct('start', s.start, 'rank', s.rank, 'stop', s.stop, 'kind', s.kind, 'body', s.body, 'score', round({_score()}, 2)))")
    keep = lambda s: s["kind"].isin(BASE) | (s["score"] >= THRESHOLD)
    return out.withColumn("__scored", scored).withColumn(to, F.filter("__scored", keep)).drop("__found", "__scored", "__text", "__parts", "__size")


def detect(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: counts of the base kinds, a digest of the base spans, all spans, and
    their scores in the same order."""
    found = find(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", "found")
    return found.select(
        "doc_id", *[count_of(F.col("found"), k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(F.col("found"), BASE), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
        F.array_join(F.transform("found", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; a null text stays null. An
    ``n_chars`` column follows the new text."""
    rows = whole_rows(docs, __src=docs[f"`{text_col}`"])
    found = find(rows, "__src", "__spans")
    out = found.select("__row", replaced("__src", "__spans").alias("__clean"))
    return out.select(*[
        (F.col("__clean") if c == text_col
         else F.coalesce(F.char_length("__clean"), F.lit(0)).cast(docs.schema[c].dataType) if c == "n_chars"
         else F.col(f"__row.`{c}`")).alias(c)
        for c in docs.columns
    ])
