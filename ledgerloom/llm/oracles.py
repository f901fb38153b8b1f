"""SQL for what can be told in it of operators whose whole results can't: base spans, rules, sizes and targets."""

from __future__ import annotations

from .urls import RULES

_WORD_SQL = r"[^\x20\x09-\x0D]+"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
_ASSIGN = rf"""(?:{_KEYS})["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
_VALUE = rf"""(?:{_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_PART = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _luhn() -> str:
    digit = lambda i: f"CAST(substr(lpad({_DIGITS}, 19, '0'), {19 - i}, 1) AS INT)"
    return " + ".join(f"CASE WHEN {digit(i)} > 4 THEN 2 * {digit(i)} - 9 ELSE 2 * {digit(i)} END" if i % 2 else digit(i) for i in range(19))


#: Kind, pattern and the condition that a match m holds.
_SECRETS = (
    ("assign", _ASSIGN, f"length(regexp_extract(m, {_quoted(_VALUE)}, 1)) >= 8"),
    ("access", "AKIA[A-Z0-9]+", "length(m) >= 16"),
    ("hex", "[0-9a-f]+", "length(m) >= 32"),
)
_PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", rf"regexp_full_match(m, '{_PART}(\.{_PART}){{3}}')"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 16 AND 19 AND ({_luhn()}) % 10 = 0"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15"),
)


def _spans(kinds: tuple, order: str) -> str:
    """Counts and the digest of the base spans of every text; offsets are running sums of what lies between matches and of these."""
    each = []
    for k, (name, pattern, holds) in enumerate(kinds):
        p = _quoted(pattern)
        each.append(f"""SELECT r, {k} AS k, '{name}:' || (e - length(m)) || ':' || e AS span, e - length(m) AS s FROM (
  SELECT r, m, CAST(sum(length(g) + length(m)) OVER (PARTITION BY r ORDER BY i) AS BIGINT) AS e FROM (
   SELECT r, unnest(hits) AS m, unnest(gaps[1:len(hits)]) AS g, generate_subscripts(hits, 1) AS i FROM (SELECT r, regexp_extract_all(t, {p}) AS hits, string_split_regex(t, {p}) AS gaps FROM d))) WHERE {holds}""")
    counts = ", ".join(f"count(*) FILTER (k = {k}) AS n_{name}" for k, (name, _, _) in enumerate(kinds))
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), found AS ({' UNION ALL '.join(each)})
SELECT doc_id, {counts}, sha256(coalesce(string_agg(span, ',' ORDER BY {order}), '')) AS base_sha256 FROM d LEFT JOIN found USING (r) GROUP BY r, doc_id"""


SECRETS_BASE = _spans(_SECRETS, "s, k")
PII_BASE = _spans(_PII, "k, s")

URL_RULES = f"""WITH p AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (SELECT r, page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM p),
rules AS (SELECT * FROM (VALUES {', '.join(str(x) for x in RULES)}) v(h, start, verdict))
SELECT page_id, host, path, arg_max(h || start, length(h || start)) AS rule, arg_max(verdict, length(h || start)) AS verdict
FROM hp LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, start) GROUP BY r, page_id, host, path"""

#: Of the levels that leave some sources at their caps, the one at which targets add up to all sizes.
SOURCE_TARGETS = f"""WITH z AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD_SQL}')) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM z GROUP BY source),
levels AS (SELECT ((SELECT sum(n) FROM per) - sum(CASE WHEN 3.0 * b.n / b.w < 3.0 * a.n / a.w THEN 3.0 * b.n ELSE 0 END)) / sum(CASE WHEN 3.0 * b.n / b.w < 3.0 * a.n / a.w THEN 0 ELSE b.w END)::DOUBLE AS level FROM per a, per b GROUP BY a.source, a.n, a.w),
best AS (SELECT arg_min(level, abs(reached - (SELECT sum(n) FROM per))) AS level FROM (SELECT level, sum(least(3.0 * n, level * w)) AS reached FROM levels, per GROUP BY level))
SELECT doc_id, z.source, size, n AS source_size, round(CAST(least(3.0 * n, level * w) AS DOUBLE), 3) AS target FROM z JOIN per ON z.source IS NOT DISTINCT FROM per.source, best"""
