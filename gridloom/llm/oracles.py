"""SQL that states the rows of this subpackage's queries, or the columns of them that the contracts fix."""

from __future__ import annotations

from . import quality_rules
from .common import all_stop_words

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words() -> str:
    return f"regexp_extract_all(coalesce(text, ''), '{WORD}')"


#: Sizes and targets of the mix: the water level at which capped shares by weight add up.
MIX = f"""
WITH d AS (SELECT doc_id, source, len({_words()})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END)::DOUBLE AS w, (2.0 * source_size)::DOUBLE AS cap FROM s),
f AS (SELECT *, (1.5 * sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER b, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS weights
      FROM w WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT min_by(rest / weights, cap / w) AS level FROM f WHERE rest / weights * w <= cap),
t AS (SELECT source, source_size, least(cap, coalesce(level * w, cap)) AS target FROM f, l)
SELECT d.doc_id, d.size, t.source_size, t.target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""


def _places(kinds: list[tuple[str, str, str]]) -> str:
    """CTEs up to `hits` (doc_id, kind, name, s, e, v): where the patterns (name, pattern, condition on v) match, by lengths of what lies between."""
    parts = []
    for k, (name, pattern, keep) in enumerate(kinds):
        quoted = pattern.replace("'", "''")
        parts.append(f"""
m{k} AS (SELECT doc_id, unnest(regexp_extract_all(t, '{quoted}')) AS v, generate_subscripts(regexp_extract_all(t, '{quoted}'), 1) AS i, string_split_regex(t, '{quoted}') AS gaps FROM d WHERE regexp_matches(t, '{quoted}')),
n{k} AS (SELECT doc_id, v, i, sum(length(v)) OVER (PARTITION BY doc_id ORDER BY i) - length(v) + sum(length(gaps[i])) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM m{k}),
h{k} AS (SELECT doc_id, {k} AS kind, '{name}' AS name, s::BIGINT AS s, (s + length(v))::BIGINT AS e FROM n{k} WHERE {keep})""")
    return "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)," + ",".join(parts) + ", hits AS (" + " UNION ALL ".join(
        f"SELECT * FROM h{k}" for k in range(len(kinds))
    ) + ")"


def _counted(kinds: list[tuple[str, str, str]]) -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE kind = {k})::BIGINT AS n_{name}" for k, (name, _, _) in enumerate(kinds))
    names = ", ".join(f"coalesce(n_{name}, 0)::BIGINT AS n_{name}" for name, _, _ in kinds)
    return f"""{_places(kinds)}, g AS (SELECT doc_id, {counts}, string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans FROM hits GROUP BY doc_id)
SELECT d.doc_id, {names}, sha256(coalesce(g.spans, '')) AS base_sha256 FROM d LEFT JOIN g ON d.doc_id = g.doc_id"""


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
SECRETS = _counted([
    ("assign", _ASSIGN, "length(regexp_extract(v, '" + _ASSIGN.replace("'", "''") + "', 1)) >= 12"),
    # runs are maximal, so those too short are no matches at all
    ("access", "AKIA[A-Z0-9]{14,}", "true"),
    ("hex", "[0-9a-f]{16,}", "true"),
])

_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_TWICE = f"list_transform(range(length({_DIGITS})), lambda i: {_DIGITS}[(length({_DIGITS}) - i)::BIGINT]::INT * (1 + i % 2))"
PERSONAL = _counted([
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    (
        "ip",
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"len(list_filter(string_split(v, '.'), lambda p: try_cast(p AS HUGEINT) IS NULL OR try_cast(p AS HUGEINT) > 255)) = 0",
    ),
    (
        "card",
        r"[0-9]([\x20-]?[0-9])+",
        f"length({_DIGITS}) BETWEEN 14 AND 19 AND list_sum(list_transform({_TWICE}, lambda x: x // 10 + x % 10)) % 10 = 0",
    ),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15"),
])

LICENCES = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) - 1 AS i, w FROM d),
h AS (SELECT doc_id, i, CASE WHEN a = 'mit' AND w[i + 2] = 'license' THEN 'mit' WHEN a = 'apache' AND w[i + 2] = 'license' THEN 'apache' WHEN a = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license' THEN 'gpl' END AS label FROM p),
g AS (SELECT doc_id, count(*) AS n, min(i) AS low, max(i) AS high, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM h WHERE label IS NOT NULL GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, low::BIGINT AS first_word, high::BIGINT AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORD}') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) q ON d.doc_id = q.doc_id
"""


def rules() -> str:
    """The whole of op8, from the same threshold table."""
    stop = ", ".join(f"'{w}'" for w in all_stop_words())
    failed = []
    for r in quality_rules.RULES:
        ok = [f"{r.numerator} >= {r.low}::DOUBLE * {r.denominator}"] * (r.low != float("-inf")) + [
            f"{r.numerator} <= {r.high}::DOUBLE * {r.denominator}",
        ] * (r.high != float("inf"))
        failed.append(f"CASE WHEN NOT ({' AND '.join(ok)}) THEN '{r.name}' END")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_words()} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM documents),
p AS (SELECT doc_id, i, hash(w[i], w[i + 1], w[i + 2]) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
q AS (SELECT doc_id, i FROM p QUALIFY count(*) OVER (PARTITION BY doc_id, h) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM q, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{SPACE}', '', 'g'))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
      (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(list_filter(w, lambda x: x IN ({stop})))::BIGINT AS n_stop_words FROM d LEFT JOIN c ON d.doc_id = c.doc_id),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, concat_ws(',', {', '.join(failed)}) AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed_rules, NOT base_failed AND failed_rules = '' AS kept FROM v
"""
