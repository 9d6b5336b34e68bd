"""Native span finding: where in a text a regular expression matches, in code points.

Spark has no function that returns match positions. ``regexp_extract_all`` gives the matches and
``split`` the gaps between them; both walk the text with the same matcher, so adding up gap and
match lengths gives every start. All of it stays in the JVM, and takes time in proportion to the
text and its matches: running sums go by blocks, and what stands at a position is looked up in a
text cut into pieces of ``PIECE`` code points, never by walking the text from its start.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN_TYPE = "array<struct<start:int,rank:int,stop:int,kind:string,body:string,valid:boolean>>"

#: Code points in a piece of a cut text.
PIECE = 256
#: Two to this power elements are in a block of a running sum; so many times blocks are made of blocks.
BLOCK_BITS, LEVELS = 6, 3


@dataclass(frozen=True)
class Kind:
    """One kind of span. ``hint`` is a cheap necessary condition on the text; ``accept`` decides on
    a match, given the match, its group ``group`` and the text around it; ``valid`` says whether a
    checksum holds."""

    name: str
    pattern: str
    accept: Callable[[Column, Column, Column, Column], Column] = field(default=lambda match, group, before, after: F.lit(True))
    hint: Callable[[Column], Column] = field(default=lambda text: F.lit(True))
    valid: Callable[[Column], Column] = field(default=lambda match: F.lit(False))
    group: int = 0
    neighbours: bool = False


# ---- linear building blocks, as SQL text: parsed in one go, however deep they nest


def let(name: str, value: str, use: str) -> str:
    """``use``, where ``name`` stands for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {use}), 1)"


def running(values: str, add: str = "s + x") -> str:
    """For each element of an array of ints what all before it add up to, from 0: blocks are added
    up, their running sums found likewise, and each element goes on from its block's. ``add`` says
    how ``s`` goes on with ``x``."""
    size = 1 << BLOCK_BITS

    def within(a: str, first: str, n: str, start: str = "0") -> str:
        return f"aggregate(slice({a}, {first}, {n}), {start}, (s, x) -> {add})"

    def by_blocks(a: str, level: int) -> str:
        if not level:
            return f"transform({a}, (e, i) -> {within(a, '1', 'i')})"
        blocks = f"transform(sequence(0, shiftright(size({a}) - 1, {BLOCK_BITS})), i -> {within(a, f'i * {size} + 1', str(size))})"
        b, sums = f"b{level}", f"r{level}"
        block = f"shiftright(i, {BLOCK_BITS})"
        onward = f"transform({a}, (e, i) -> {within(a, f'{block} * {size} + 1', f'i & {size - 1}', f'get({sums}, {block})')})"
        return let(b, blocks, let(sums, by_blocks(b, level - 1), onward))

    return let("a0", values, f"CASE WHEN size(a0) <= {size} THEN {by_blocks('a0', 0)} ELSE {by_blocks('a0', LEVELS)} END")


def pieces(text: str) -> Column:
    """The text of a column in pieces of ``PIECE`` code points."""
    return F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(parts: str, start: str, stop: str) -> str:
    """From ``start`` up to ``stop`` of a text in pieces; empty if nothing lies between."""
    first, last = f"({start}) DIV {PIECE}", f"({stop} - 1) DIV {PIECE}"
    within = f"array_join(slice({parts}, int({first}) + 1, int({last} - {first}) + 1), '')"
    return f"CASE WHEN {stop} > {start} THEN substring({within}, int(({start}) % {PIECE}) + 1, {stop} - {start}) ELSE '' END"


# ---- spans


def with_spans(df: DataFrame, text: str, kinds: list[Kind], to: str, *, gate: Callable[[Kind], Column] | None = None) -> DataFrame:
    """Add the array column ``to`` with the accepted spans of all kinds, by start and then by kind
    in the order given. A null text has no span. ``gate`` may rule a kind out for a row."""
    src = F.col(text)
    stage = df.withColumns({
        f"__m{i}": F.when(k.hint(src) & (gate(k) if gate else F.lit(True)), F.regexp_extract_all(src, F.lit(k.pattern), F.lit(0)))
        for i, k in enumerate(kinds)
    })
    some = lambda i: F.size(F.coalesce(F.col(f"__m{i}"), F.array().cast("array<string>"))) > 0
    columns = {}
    for i, k in enumerate(kinds):
        gaps = F.split(src, k.pattern, -1)
        columns[f"__g{i}"] = F.when(some(i), gaps if k.neighbours else F.transform(gaps, lambda x: F.char_length(x)))
        if k.group:
            columns[f"__x{i}"] = F.when(some(i), F.regexp_extract_all(src, F.lit(k.pattern), F.lit(k.group)))
    stage = stage.withColumns(columns)
    stage = stage.withColumns({f"__s{i}": F.when(some(i), _starts(f"__m{i}", f"__g{i}", k.neighbours)) for i, k in enumerate(kinds)})
    found = [F.coalesce(F.when(some(i), _accepted(k, i)), F.array().cast(SPAN_TYPE)) for i, k in enumerate(kinds)]
    return stage.withColumn(to, F.array_sort(F.concat(*found))).drop(*[f"__{p}{i}" for i in range(len(kinds)) for p in "mgxs"])


def _starts(matches: str, gaps: str, whole: bool) -> Column:
    """0-based starts: the gaps up to a match plus the matches before it."""
    gap = f"char_length(get({gaps}, i))" if whole else f"get({gaps}, i)"
    both = f"transform({matches}, (m, i) -> {gap} + char_length(m))"
    return F.expr(let("sums", running(both), f"transform(sums, (p, i) -> p + {gap})"))


def _accepted(k: Kind, i: int) -> Column:
    matches, starts, gaps = F.col(f"__m{i}"), F.col(f"__s{i}"), F.col(f"__g{i}")
    groups = F.col(f"__x{i}") if k.group else matches

    def span(j: Column) -> Column:
        body, start = F.get(matches, j), F.get(starts, j)
        return F.struct(start.alias("start"), F.lit(i).alias("rank"), (start + F.char_length(body)).alias("stop"), F.lit(k.name).alias("kind"), body.alias("body"), k.valid(body).alias("valid"))

    def good(j: Column) -> Column:
        before = after = F.lit("")
        if k.neighbours:  # in the gap, or in the next match if there is none between
            before = F.right(F.concat(F.coalesce(F.get(matches, j - 1), F.lit("")), F.get(gaps, j)), F.lit(1))
            after = F.left(F.concat(F.get(gaps, j + 1), F.coalesce(F.get(matches, j + 1), F.lit(""))), F.lit(1))
        return k.accept(F.get(matches, j), F.get(groups, j), before, after)

    return F.transform(F.filter(F.sequence(F.lit(0), F.size(matches) - 1), good), span)


def joined(spans: Column, kinds: list[str] | None = None) -> Column:
    """``kind:start:stop`` of the spans, comma-joined; of the named kinds only, if given."""
    chosen = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def replaced(text: str, spans: str) -> Column:
    """The text of a column with every span of another, overlapping ones merged, replaced by the kind
    of its first in brackets."""
    furthest = running(f"transform({spans}, p -> p.stop)", "greatest(s, x)")
    # a span that starts before the ones ahead of it end is inside them
    piece = f"CASE WHEN p.start < get(reached, i) THEN '' ELSE concat({cut('parts', 'get(reached, i)', 'p.start')}, '[', upper(p.kind), ']') END"
    last = f"greatest(get(reached, size({spans}) - 1), element_at({spans}, -1).stop)"
    rebuilt = f"concat(array_join(transform({spans}, (p, i) -> {piece}), ''), {let('z', last, cut('parts', 'z', f'char_length({text})'))})"
    whole = let("parts", f"regexp_extract_all({text}, '(?s).{{1,{PIECE}}}', 0)", let("reached", furthest, rebuilt))
    return F.when(F.size(spans) > 0, F.expr(whole)).otherwise(F.col(text))
