"""Secret scanning with a trigram inverted index.

From each rule's regular expression a Boolean trigram query is derived: the texts it can match all
contain one of some sets of three-letter strings. The index has a posting (trigram, document) for
every trigram that some query names. Intersecting postings gives candidates per rule, and the
regular expression runs on these only. A rule without mandatory trigrams runs on every text. Only
DataFrame functions are used. The postings are written as a table; candidates, which are few, go to
the texts by broadcast up to ``BROADCAST_ROWS`` of them, which is checked, and by a shuffled join beyond.

Defined results: a null text is an empty text; postings are kept by a hash of id and text, so that null
and repeated ids are rows of their own; rows equal in both share candidates, and each is verified on
its own text; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re._parser as parser
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .spans import Kind, count_of, joined, with_spans

BASE = ["assign", "access", "hex"]


def _either_case(text: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in text)


_NAMES = "|".join(_either_case(x) for x in ("password", "passwd", "secret", "token", "api_?key"))

KINDS = [
    Kind("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", accept=lambda m, g, b, a: F.char_length(g) >= 6, group=2),
    Kind("access", r"AKIA[A-Z0-9]+", accept=lambda m, g, b, a: F.char_length(m) >= 20),
    Kind("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+"),
    Kind("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Kind("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Kind("google", r"AIza[0-9A-Za-z_-]{35}"),
    Kind("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    # takes a first part without the others as well, so that a failed try is not begun again within it
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{8,}(?:\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})?", accept=lambda m, g, b, a: F.contains(m, F.lit("."))),
    Kind("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Kind("url", r"://[A-Za-z0-9._~-]{1,64}:[^\x00-\x20:/@]{3,64}@"),
]

#: At most this many rows of candidates (a key and the names of rules each) are broadcast.
BROADCAST_ROWS = 500_000
#: More strings than this are not multiplied out when a query is derived.
WIDEST = 64


def _better(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    """The factor whose shortest string is longer; strings under three letters say nothing."""
    usable = [x for x in (a, b) if x and min(map(len, x)) >= 3]
    return max(usable, key=lambda x: (min(map(len, x)), -len(x)), default=None)


def _finite(op, arg) -> tuple[set[str] | None, set[str] | None]:
    """All strings that a node matches (None: too many), and its best mandatory factor."""
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}, None
    if name == "IN":
        chars: set[str] = set()
        for kind, x in arg:
            if str(kind) == "LITERAL":
                chars.add(chr(x).lower())
            elif str(kind) == "RANGE" and x[1] - x[0] < 8:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, None
        return (chars, None) if len(chars) <= 8 else (None, None)
    if name == "SUBPATTERN":
        return _walk(arg[-1])
    if name == "ATOMIC_GROUP":
        return _walk(arg)
    if name == "BRANCH":
        found = [_walk(x) for x in arg[1]]
        if all(exact is not None for exact, _ in found):
            return set().union(*(exact for exact, _ in found)), None
        best = [factor if exact is None else exact for exact, factor in found]
        return None, set().union(*best) if all(x and min(map(len, x)) >= 3 for x in best) else None
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, inner = arg
        exact, factor = _walk(inner)
        if exact is not None and most <= 4 and len(exact) ** int(most) <= WIDEST:
            return {"".join(x) for n in range(least, int(most) + 1) for x in product(sorted(exact), repeat=n)}, None
        return None, (_better(exact, factor) if least else None)
    if name in ("AT", "ASSERT", "ASSERT_NOT"):
        return {""}, None
    return None, None


def _walk(nodes) -> tuple[set[str] | None, set[str] | None]:
    run, best, whole = {""}, None, True
    for op, arg in nodes:
        exact, factor = _finite(op, arg)
        if exact is not None and len(run) * len(exact) <= WIDEST:
            run = {a + b for a in run for b in exact}
            continue
        best = _better(_better(best, run), _better(factor, exact))
        run, whole = {""}, False
    return (run if whole else None), _better(best, run)


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Sets of lower-cased trigrams; a text that the pattern matches has all of some set. None: the
    pattern has no mandatory trigrams."""
    exact, factor = _walk(parser.parse(pattern))
    strings = _better(exact, factor)
    if strings is None:
        return None
    return sorted({frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}, key=sorted)


def _queries() -> list[tuple[str, int, frozenset[str]]]:
    out = []
    for k in KINDS:
        out += [(k.name, len(out) + i, grams) for i, grams in enumerate(trigram_query(k.pattern) or [])]
    return out


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def postings(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The inverted index: (row, gram) for the trigrams that queries name."""
    grams = sorted({g for _, _, s in _queries() for g in s})
    low = docs.select(row_key(id_col, text_col).alias("row"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("low"))
    present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    return low.select("row", F.explode(present).alias("gram"))


def candidates(index: DataFrame) -> DataFrame:
    """(row, rules): rules for which some trigram set lies wholly in the document's postings."""
    spark = index.sparkSession
    terms = [(g, rule, i, len(s)) for rule, i, s in _queries() for g in sorted(s)]
    query = F.broadcast(spark.createDataFrame(terms, "gram string, rule string, conj int, need int"))  # as many rows as the rules name
    met = index.join(query, "gram").groupBy("row", "conj", "rule", "need").agg(F.size(F.collect_set("gram")).alias("have")).where("have = need")
    return met.groupBy("row").agg(F.collect_set("rule").alias("rules"))


def detect(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: counts of the base kinds, a digest of the base spans, and all spans."""
    free = [k.name for k in KINDS if trigram_query(k.pattern) is None]
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    index = materialize(postings(base), "postings")
    cand = materialize(candidates(index).select(F.col("row").alias("__row"), F.col("rules").alias("__rules")), "candidates")
    discard(index)
    few = cand.count() <= BROADCAST_ROWS
    both = base.join(F.broadcast(cand) if few else cand, row_key("doc_id", "text") == F.col("__row"), "left")
    gate = lambda k: F.lit(True) if k.name in free else F.array_contains(F.coalesce(F.col("__rules"), F.array().cast("array<string>")), k.name)
    found = with_spans(both, "text", KINDS, "found", gate=gate)
    return found.select(
        "doc_id", *[count_of(F.col("found"), k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(F.col("found"), BASE), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )
