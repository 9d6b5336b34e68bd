"""DuckDB SQL for the operators whose whole result SQL can express."""

from __future__ import annotations

from . import decontaminate, mixing, pii, repair, secrets, topk, trie


def _spans_sql(kind: str, rank: int, pattern: str, keep: str, group: int = 0) -> str:
    """Spans of one kind: gap and match lengths add up to positions. ``keep`` speaks of ``body``,
    ``grp``, ``pre`` and ``post``."""
    p = pattern.replace("'", "''")
    return f"""
    SELECT doc_id, text, s0 AS "start", {rank} AS rnk, s0 + length(body) AS stop, '{kind}' AS kind, body FROM (
      SELECT doc_id, text, m[i] AS body, x[i] AS grp,
             CAST(list_sum(g[1:i]) + coalesce(list_sum(l[1:i-1]), 0) AS BIGINT) AS s0,
             CASE WHEN CAST(list_sum(g[1:i]) + coalesce(list_sum(l[1:i-1]), 0) AS BIGINT) > 0
                  THEN substr(text, CAST(list_sum(g[1:i]) + coalesce(list_sum(l[1:i-1]), 0) AS BIGINT), 1) ELSE '' END AS pre,
             substr(text, CAST(list_sum(g[1:i]) + coalesce(list_sum(l[1:i]), 0) AS BIGINT) + 1, 1) AS post
      FROM (SELECT *, [length(y) for y in m] AS l, unnest(range(1, len(m) + 1)) AS i FROM (
        SELECT doc_id, text, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {group}) AS x,
               [length(y) for y in string_split_regex(text, '{p}')] AS g
        FROM d WHERE regexp_matches(text, '{p}')))
    ) WHERE {keep}"""


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def _luhn(digits: str) -> str:
    n = f"length({digits})"
    d = f"CAST(substr({digits}, {n} - i + 1, 1) AS INT)"
    return f"list_sum([CASE WHEN i % 2 = 0 THEN CASE WHEN {d} * 2 > 9 THEN {d} * 2 - 9 ELSE {d} * 2 END ELSE {d} END for i in range(1, {n} + 1)]) % 10 = 0"


def _mod97(x: str) -> str:
    turned = f"(substr({x}, 5) || substr({x}, 1, 4))"
    return f"list_reduce(list_prepend(0, [CAST(ascii(substr({turned}, i, 1)) AS BIGINT) for i in range(1, length({turned}) + 1)]), lambda a, c: CASE WHEN c >= 65 THEN (a * 100 + c - 55) % 97 ELSE (a * 10 + c - 48) % 97 END) = 1"


def _digest(names: list[str]) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    item = "kind || ':' || \"start\" || ':' || stop"
    return f"""sha256(coalesce(string_agg({item}, ',' ORDER BY "start", rnk) FILTER (WHERE kind IN ({listed})), ''))"""


def _pii_sql() -> str:
    bare = "replace(body, ' ', '')"
    alone = "NOT regexp_matches(pre, '[A-Za-z0-9]') AND NOT regexp_matches(post, '[A-Za-z0-9]')"
    parts = "[ltrim(y, '0') for y in string_split(body, '.')]"
    keeps = {
        "email": ("[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+", "true"),
        "ip": ("[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)", f"len([1 for y in {parts} if length(y) > 3 OR (length(y) = 3 AND y > '255')]) = 0"),
        "card": ("[0-9]([\\x20-]?[0-9])+", f"CASE WHEN length({_digits('body')}) BETWEEN 14 AND 19 THEN {_luhn(_digits('body'))} ELSE false END"),
        "phone": ("\\+[0-9][\\x20().0-9-]+[0-9]", f"length({_digits('body')}) BETWEEN 10 AND 15"),
        "iban": (pii.IBAN, alone),
        "ssn": ("[0-9]{3}-[0-9]{2}-[0-9]{4}", f"{alone} AND substr(body, 1, 3) NOT IN ('000', '666') AND substr(body, 1, 1) <> '9' AND substr(body, 5, 2) <> '00' AND substr(body, 8, 4) <> '0000'"),
        "short_card": ("[0-9]([\\x20-]?[0-9])+", f"length({_digits('body')}) BETWEEN 12 AND 13"),
    }
    checks = {"card": "true", "iban": _mod97(bare), "short_card": _luhn(_digits("body"))}
    kinds = pii.BASE + pii.ADDED
    union = " UNION ALL ".join(_spans_sql(k, i, *keeps[k]) for i, k in enumerate(kinds))
    sure = " ".join(f"WHEN kind = '{k}' THEN {pii.PRIOR[k]}" + (f" + CASE WHEN {checks[k]} THEN {pii.CHECKSUM[k]} ELSE 0.0 END" if k in checks else "") for k in kinds)
    around = f"(substr(text, greatest(\"start\" - {pii.REACH}, 0) + 1, \"start\" - greatest(\"start\" - {pii.REACH}, 0)) || ' ' || substr(text, stop + 1, {pii.REACH}))"
    near = " ".join(f"WHEN kind = '{k}' AND regexp_matches({around}, '(?i)(^|[^A-Za-z])({pii.CONTEXT[k]})([^A-Za-z]|$)') THEN {pii.NEAR}" for k in kinds)
    counts = ", ".join(f"count(kind) FILTER (WHERE kind = '{k}') AS n_{k}" for k in pii.BASE)
    base = ", ".join(f"'{k}'" for k in pii.BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), s AS ({union}),
scored AS (SELECT *, round(least(1.0, CASE {sure} END + CASE {near} ELSE 0.0 END), 2) AS score FROM s),
kept AS (SELECT * FROM scored WHERE kind IN ({base}) OR score >= {pii.THRESHOLD})
SELECT d.doc_id, {counts}, {_digest(pii.BASE)} AS base_sha256,
       coalesce(string_agg(kind || ':' || "start" || ':' || stop, ',' ORDER BY "start", rnk), '') AS spans,
       coalesce(string_agg(printf('%.2f', CAST(score AS DOUBLE)), ',' ORDER BY "start", rnk), '') AS scores
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id GROUP BY d.doc_id"""


def _secrets_sql() -> str:
    plain = {"hex": "[0-9a-f]{24,}"}
    keep = {"assign": "length(grp) >= 6", "access": "length(body) >= 20", "jwt": "contains(body, '.')"}
    union = " UNION ALL ".join(
        _spans_sql(k.name, i, plain.get(k.name, k.pattern), keep.get(k.name, "true"), k.group) for i, k in enumerate(secrets.KINDS))
    counts = ", ".join(f"count(kind) FILTER (WHERE kind = '{k}') AS n_{k}" for k in secrets.BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), s AS ({union})
SELECT d.doc_id, {counts}, {_digest(secrets.BASE)} AS base_sha256,
       coalesce(string_agg(kind || ':' || "start" || ':' || stop, ',' ORDER BY "start", rnk), '') AS spans
FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id"""


def mixing_sql(docs: str = "documents") -> str:
    u = f"CAST(('0x' || substr(md5('{mixing.SEED}:' || j || ':' || key), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE)"
    return f"""
WITH RECURSIVE src AS (SELECT source, count(*) AS n_docs FROM {docs} GROUP BY source),
tot AS (SELECT sum(n_docs) AS n, sum(pow(CAST(n_docs AS DOUBLE), {mixing.ALPHA})) AS w FROM src),
rates AS (SELECT source, round(pow(CAST(n_docs AS DOUBLE), {mixing.ALPHA}) / w * CAST(n AS DOUBLE) / n_docs, 9) AS rate FROM src, tot),
laws AS (SELECT source, rate, greatest(1, CAST(ceil(rate / {mixing.PART}) AS INT)) AS parts FROM rates),
steps AS (
  SELECT source, rate, parts, 0 AS i, exp(-(rate / parts)) AS p, exp(-(rate / parts)) AS f FROM laws
  UNION ALL
  SELECT source, rate, parts, i + 1, p * (rate / parts) / (i + 1), f + p * (rate / parts) / (i + 1) FROM steps WHERE i < {mixing.TABLE}),
tables AS (SELECT source, rate, parts, list(f ORDER BY i) AS t FROM steps GROUP BY source, rate, parts),
drawn AS (
  SELECT d.*, t.rate, coalesce(CAST(d.doc_id AS VARCHAR), 'null') AS key, t.parts, t.t
  FROM {docs} d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source),
many AS (SELECT * EXCLUDE (parts, t), CAST(list_sum([list_sum([CASE WHEN c <= {u} THEN 1 ELSE 0 END for c in t]) for j in range(1, parts + 1)]) AS BIGINT) AS n FROM drawn),
copies AS (SELECT * EXCLUDE (n), unnest(range(1, n + 1)) AS copy_no FROM many)
SELECT * EXCLUDE (key), md5('order:{mixing.SEED}:' || copy_no || ':' || key) AS shuffle_key FROM copies"""


def _decontamination_sql() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    n = decontaminate.WINDOW
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents), b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {words} AS w FROM benchmark),
bi AS (SELECT item, w, CAST(least(len(w), {n}) AS BIGINT) AS n, unnest(range(1, greatest(len(w) - {n - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM bi),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win)),
hits AS (SELECT doc_id, item, i, di.n FROM di JOIN win ON win.n = di.n AND win.k = array_to_string(w[i:i + di.n - 1], ' ')),
spots AS (SELECT doc_id, hits.item, hits.i, hits.n, bi.i AS j FROM hits JOIN bi ON bi.item = hits.item AND bi.n = hits.n JOIN d USING (doc_id) WHERE array_to_string(bi.w[bi.i:bi.i + bi.n - 1], ' ') = array_to_string(d.w[hits.i:hits.i + hits.n - 1], ' ')),
runs AS (SELECT doc_id, item, min(i) - 1 AS a, min(j) - 1 AS b, max(n) + count(*) - 1 AS size FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item, i - j ORDER BY i) AS island FROM (SELECT DISTINCT * FROM spots)) GROUP BY doc_id, item, i - j, island),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, a, item, b) AS r FROM runs) WHERE r = 1),
pos AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, size AS longest, a AS longest_at, best.item AS longest_item, b AS longest_item_at
FROM d LEFT JOIN best ON best.doc_id = d.doc_id LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id"""


def _topk_sql() -> str:
    return f"""
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, CAST([floor({topk.SCALE} * CAST(x AS DOUBLE)) for x in embedding] AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
pairs AS (SELECT q.vec_id AS query_id, q.r AS qr, c.vec_id, c.r, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % {topk.QUERY_EVERY} = 0 AND q.r <> c.r AND len(q.e) = len(c.e))
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id NULLS LAST, r) AS rank FROM pairs) WHERE rank <= {topk.K}"""


def _crc32(text: str) -> str:
    """The CRC-32 of an ASCII text, from the table of its polynomial."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    codes = f"[CAST(ascii(substr({text}, i, 1)) AS BIGINT) for i in range(1, length({text}) + 1)]"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: xor(CAST({table} AS BIGINT[])[CAST(xor(c, b) & 255 AS BIGINT) + 1], c >> 8)), 4294967295)"


def _repair_sql() -> str:
    moves = ", ".join(f"('{i}', {bool(g)}, {bool(t)}, {a}, {b}, {c}, '{w}')" for k, i in enumerate(["other", *repair.INITIALS], -1) for g in (0, 1) for t in (0, 1) for (a, b), (c, w) in repair.moves_of(k, bool(g), bool(t)).items())
    opening = ", ".join(f"({s}, {c}, '{w}')" for s, c, w in repair.OPENING)
    wanted = " ".join(f"WHEN {s} THEN '{repair.ROLE[w]}'" for s, w in repair.WANTED.items())
    after = " ".join(f"WHEN p.state = {s} AND role[1] = '{w}' THEN {t}" for (s, w), t in repair.AFTER.items())
    return f"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
w AS (SELECT *, {_crc32('key')} % 20 AS what FROM c),
d AS (SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role, CASE what WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN what = 3 THEN 2 ELSE 1 END)) FROM w WHERE what <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS n FROM d),
f AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY n) || role[1] AS pair FROM n),
g AS (SELECT *, NOT blank AND again AS dup, NOT blank AND NOT again AND cut AS trunc, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'other' END AS initial FROM f),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate, count(*) FILTER (WHERE trunc) AS truncated,
  count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS size FROM g GROUP BY conv_id),
moves(initial, gone, trunc, s, t, cost, audit) AS (VALUES {moves}), opening(s, cost, audit) AS (VALUES {opening}),
path AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS p, s AS state, CAST(cost AS BIGINT) AS cost, audit FROM counts, opening
  UNION ALL
  SELECT conv_id, p, state, low.cost, low.audit FROM (
    SELECT path.conv_id, path.p + 1 AS p, m.t AS state, min({{'cost': path.cost + m.cost, 'audit': path.audit || m.audit}}) AS low
    FROM path JOIN g ON g.conv_id IS NOT DISTINCT FROM path.conv_id AND g.n = path.p + 1 JOIN moves m ON m.initial = g.initial AND m.gone = (g.blank OR g.dup) AND m.trunc = g.trunc AND m.s = path.state
    GROUP BY path.conv_id, path.p, m.t)),
best AS (SELECT conv_id, min({{'cost': path.cost, 'audit': path.audit}}) AS low FROM path JOIN counts USING (conv_id) WHERE p = size AND state IN ({repair.NONE}, {repair.ANSWERED}) GROUP BY conv_id),
walk AS (
  SELECT conv_id, low.audit AS audit, 0 AS i, CAST(0 AS BIGINT) AS seen, {repair.NONE} AS state, CAST([] AS VARCHAR[]) AS lines FROM best
  UNION ALL
  SELECT conv_id, audit, i + 1, seen, CASE {after} ELSE p.state END, CASE WHEN role IS NULL THEN lines ELSE list_append(lines, role || ':' || text) END FROM (
    SELECT k.conv_id, k.audit, k.i, k.state, k.lines, k.seen + CAST(k.audit[k.i + 1] <> 'I' AS BIGINT) AS seen,
      CASE k.audit[k.i + 1] WHEN 'D' THEN NULL WHEN 'K' THEN g.role ELSE CASE k.state {wanted} END END AS role, CASE k.audit[k.i + 1] WHEN 'I' THEN '' ELSE g.text END AS text
    FROM walk k JOIN g ON g.conv_id IS NOT DISTINCT FROM k.conv_id AND g.n = greatest(k.seen + CAST(k.audit[k.i + 1] <> 'I' AS BIGINT), 1) WHERE k.i < length(k.audit)) p)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(low.cost, 0) AS cost, coalesce(low.audit, '') AS audit,
  sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN walk ON walk.conv_id IS NOT DISTINCT FROM e.conv_id AND walk.i = length(walk.audit)"""


def _trie_sql() -> str:
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, length(role) || ':' || length(text) || ':' || role || text AS said,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS k FROM c),
v AS (SELECT conv_id, conv_id - conv_id % {trie.FAMILY} AS base, {_crc32('key')} % {trie.HEADS} AS h FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS key FROM c)),
r AS (SELECT v.conv_id, k, said, words FROM v JOIN t ON t.conv_id = v.base AND k <= h UNION ALL SELECT v.conv_id, k, said, words FROM v JOIN t ON t.conv_id = v.conv_id AND k > h),
p AS (SELECT conv_id, row_number() OVER w AS d, list(said) OVER w AS path, words FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
m AS (SELECT conv_id, d, path, words, list_slice(path, 1, d - 1) AS up FROM p UNION ALL SELECT conv_id, 0, CAST([] AS VARCHAR[]), 0, NULL FROM v),
n AS (SELECT path, max(d) AS depth, max(up) AS up, max(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs FROM m GROUP BY path),
kids AS (SELECT up AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY up),
full_n AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (path)),
under AS (SELECT DISTINCT a.path, b.path AS below FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.d >= a.d),
sums AS (SELECT under.path, CAST(sum((f.n_convs - 1) * f.words) AS BIGINT) AS saved, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves FROM under JOIN full_n f ON f.path = under.below GROUP BY under.path),
ends AS (SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT *, max(d) OVER (PARTITION BY conv_id) AS last FROM m) WHERE d = last GROUP BY path)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM full_n f JOIN sums s ON s.path = f.path LEFT JOIN n u ON f.depth > 0 AND u.path = f.up LEFT JOIN ends e ON e.path = f.path"""


ORACLE = {"op8_decontamination": _decontamination_sql(), "op1_pii": _pii_sql(), "op9_mixing": mixing_sql(), "op10_secrets": _secrets_sql(), "op11_topk": _topk_sql(), "op12_conversation_repair": _repair_sql(), "op13_prefix_trie": _trie_sql()}
