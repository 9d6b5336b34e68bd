"""Scalar text functions, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word characters of keyword search.
TOKEN = r"[\p{L}\p{N}_]+"

#: What counts as white space at the ends of a text.
SPACE = " \t\n\x0b\f\r\x85\xa0"


def trimmed(text: Column) -> Column:
    """Without white space (not only blanks) at both ends."""
    return F.btrim(text, F.lit(SPACE))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n", -1))


def cache_text(text: Column) -> Column:
    """The text that an embedding is cached under: trimmed lines without the empty ones."""
    return F.array_join(F.filter(F.transform(F.split(text, "\n", -1), trimmed), lambda x: x != ""), "\n")


def cache_key(text: Column, model: Column | None = None, role: Column | None = None, template_hash: Column | None = None) -> Column:
    """Key of a cached embedding. Model, role and template are part of it where they are given, so
    that queries and documents never share a vector by accident."""
    parts = [cache_text(text), *(p for p in (model, role, template_hash) if p is not None)]
    return F.sha2(F.concat_ws("\x00", *parts), 256)


def chunk_key(root: Column, path: Column, start_byte: Column, end_byte: Column, start_line: Column, chunk_index: Column) -> Column:
    return F.concat_ws("\x00", root, path, F.concat_ws(":", *(c.cast("string") for c in (start_byte, end_byte, start_line, chunk_index))))


def file_key(root: Column, path: Column) -> Column:
    return F.concat(F.lit("file:"), root, F.lit("\x00"), path)


def structural_hash(tag: str, source_hash: Column, profile_hash: Column) -> Column:
    return F.sha2(F.concat_ws("\x00", F.lit(tag), source_hash, profile_hash), 256)


def project_key(root: Column) -> Column:
    return F.substring(F.sha1(root), 1, 12)


def selector_key(line: Column) -> Column:
    return F.lpad(line.cast("string"), 12, "0")


def template_applied(template: Column, text: Column) -> Column:
    """``{{text}}`` replaced everywhere, or else the template as a prefix."""
    return F.when(F.contains(template, F.lit("{{text}}")), F.replace(template, F.lit("{{text}}"), text)).otherwise(F.concat(template, text))


def branch_name(name: Column) -> Column:
    """A branch as a directory name."""
    flat = F.replace(F.translate(name, "/\\: ~", "-----"), F.lit(".."), F.lit("--"))
    bare = F.regexp_replace(flat, "^-+|-+$", "")
    return F.when(bare == "", "unnamed").otherwise(bare)


def substance(content: Column) -> Column:
    """How far a text match counts: 0.3 for nothing, 1 from 200 bytes on."""
    n = F.octet_length(trimmed(content))
    return F.when(n >= 200, 1.0).otherwise(0.3 + 0.7 * n / 200.0)


def symbol_type(kind: Column) -> Column:
    return (F.when(kind.isin("function", "method", "test", "constructor"), "function")
            .when(kind.isin("class", "type", "struct", "interface", "enum"), "class").otherwise("block"))


def is_hex(text: Column, n: int) -> Column:
    return text.rlike(f"^[0-9a-f]{{{n}}}$")


def lines_between(text: Column, first: Column, last: Column) -> Column:
    """Lines first to last (from 1, both included), joined; clamped to the text."""
    lines = F.split(text, "\n", -1)
    low = F.greatest(first, F.lit(1))
    return F.array_join(F.slice(lines, low, F.greatest(F.least(last, F.size(lines)) - low + 1, F.lit(0))), "\n")


def tag_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ",", -1), trimmed), lambda t: t != "")


def utf8_prefix(text: str, limit: int) -> str:
    """At most ``limit`` bytes, no character cut."""
    return text.encode("utf-8", "replace")[:limit].decode("utf-8", "ignore")


def glob_regex(pattern: str) -> str:
    """A path glob as a regular expression for the whole path: ``*`` and ``?`` stay in a directory,
    ``**`` crosses directories, a leading or inner ``**/`` may be nothing, ``[..]`` is a class."""
    rules = [(r"\*\*/", "(?:.*/)?"), (r"\*\*", ".*"), (r"\*", "[^/]*"), (r"\?", "[^/]"), (r"\[!?[^\]]+\]", None)]
    scan = re.compile("|".join(f"(?P<r{i}>{p})" for i, (p, _) in enumerate(rules)) + "|(?P<other>.)", re.S)
    out = []
    for m in scan.finditer(pattern):
        if m.lastgroup == "other":
            out.append(re.escape(m[0]) if not m[0].isalnum() and m[0] not in "_/-" else m[0])
        else:
            made = rules[int(m.lastgroup[1:])][1]
            out.append(made if made is not None else m[0].replace("[!", "[^"))
    return "^" + "".join(out) + "$"


# ---- imports of source files


def go_import(line: Column) -> Column:
    last = F.element_at(F.split(trimmed(line), r"\s+"), -1)
    path = F.regexp_replace(last, '^"+|"+$', "")
    return F.when(path.isin("", "_"), None).otherwise(path)


def js_import(line: Column) -> Column:
    after = F.when(F.contains(line, F.lit("from ")), F.substring_index(line, "from ", -1)).when(line.startswith("import "), F.substring(line, 8, 1 << 20))
    path = F.regexp_replace(trimmed(after), "^[\"';]+|[\"';]+$", "")
    return F.when(path != "", path)


def required(line: Column) -> Column:
    path = F.regexp_extract(line, r"""require\([^"')]*["')]([^"')]*)["')]""", 1)
    return F.when(path != "", path)


def python_import(line: Column) -> Column:
    """The module of a from-import; of ``import a, b`` only the first."""
    plain = trimmed(F.split(F.split(F.substring(line, 8, 1 << 20), ",")[0], " as ")[0])
    name = F.when(line.startswith("from "), F.get(F.split(trimmed(line), r"\s+"), 1)).when(line.startswith("import "), plain)
    return F.when(name != "", name)
