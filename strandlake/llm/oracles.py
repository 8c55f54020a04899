"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from strandlake.llm import mixing, rules, secrets

SPACE = r"\x20\x09-\x0D"


def _mix() -> str:
    turn = " ".join(f"WHEN {i} THEN {float(w)}" for i, w in enumerate(mixing.WEIGHTS))
    return rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+'))::BIGINT AS size,
         coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS k
  FROM documents
), totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), turned AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk FROM totals
), weighed AS (
  SELECT *, (CASE (rk - 1) % {len(mixing.WEIGHTS)} {turn} END)::DOUBLE AS w, ({mixing.MOST_COPIES} * source_size)::DOUBLE AS cap FROM turned
), levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce((sum(cap) OVER earlier)::DOUBLE, 0))
            / ((sum(w) OVER ())::DOUBLE - coalesce((sum(w) OVER earlier)::DOUBLE, 0)) AS lvl
  FROM weighed WINDOW earlier AS (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), aims AS (SELECT source, source_size, least(cap, (max(lvl) OVER ()) * w) AS target FROM levels
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM aims
), plan2 AS (SELECT *, target - whole * source_size AS rest FROM plan
), odds AS (
  SELECT s.*, p.source_size, p.target, p.whole, p.rest,
         (('0x' || substr(md5('{mixing.SEED}:' || k), 1, 13))::BIGINT + 0.5::DOUBLE) / {float(1 << 52)}::DOUBLE AS u,
         rest / source_size AS f
  FROM sized s JOIN plan2 p ON s.source IS NOT DISTINCT FROM p.source
), ranked AS (
  SELECT *, CASE WHEN rest > 0 AND size > 0 THEN u / (1.0::DOUBLE - u) / (f / (1.0::DOUBLE - f) * (size / (size + {mixing.HALF_ODDS_WORDS}::DOUBLE))) END AS q FROM odds
), valued AS (SELECT *, q / (1.0::DOUBLE + q) AS x FROM ranked
), keys AS (SELECT source, x, rest, sum(size)::BIGINT AS words FROM valued WHERE x IS NOT NULL GROUP BY source, x, rest
), summed AS (SELECT *, (sum(words) OVER (PARTITION BY source ORDER BY x))::BIGINT AS got FROM keys
), after AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY x) AS n,
         rest - coalesce((SELECT max(got) FROM summed b WHERE b.source IS NOT DISTINCT FROM a.source AND b.got <= b.rest), 0) AS room
  FROM summed a WHERE got > rest
), fill AS (
  SELECT source, n, x, CASE WHEN words <= room THEN room - words ELSE room END AS room, words <= room AS picked FROM after WHERE n = 1
  UNION ALL
  SELECT a.source, a.n, a.x, CASE WHEN a.words <= f.room THEN f.room - a.words ELSE f.room END, a.words <= f.room
  FROM fill f JOIN after a ON a.source IS NOT DISTINCT FROM f.source AND a.n = f.n + 1 WHERE a.n <= {mixing.TAIL}
), drawn AS (
  SELECT source, x FROM summed WHERE got <= rest UNION ALL SELECT source, x FROM fill WHERE picked
), chosen AS (
  SELECT v.*, v.whole + CASE WHEN d.x IS NULL THEN 0 ELSE 1 END AS copies
  FROM valued v LEFT JOIN drawn d ON v.source IS NOT DISTINCT FROM d.source AND v.x = d.x
)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies::BIGINT AS copies FROM chosen
"""


def _rules() -> str:
    w = rules.WINDOW
    return rf"""
WITH texts AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents
), cut AS (
  SELECT id, doc_id, t, regexp_extract_all(t, '[^{SPACE}]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS ls
  FROM texts
), places AS (SELECT id, ws, unnest(range(1, len(ws) - {w - 2})) AS i FROM cut WHERE len(ws) > {w}
), windows AS (SELECT id, i, array_to_string(ws[i:i + {w - 1}], ' ') AS win FROM places
), again AS (SELECT id, i FROM windows QUALIFY count(*) OVER (PARTITION BY id, win) > 1
), covered AS (SELECT DISTINCT id, i + unnest(range(0, {w})) AS j FROM again
), repeats AS (SELECT id, count(*) AS n FROM covered GROUP BY id
), counted AS (
  SELECT c.*, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[{SPACE}]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines
  FROM cut c LEFT JOIN repeats r ON c.id = r.id
), based AS (SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars BETWEEN 2 * n_words AND 15 * n_words AND 10 * n_symbols <= n_words
  AND NOT (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines)
  AND 100 * len(list_filter(ls, lambda x: starts_with(x, '-') OR starts_with(x, '*') OR starts_with(x, '•'))) <= 90 * n_lines
  AND 100 * len(list_filter(ls, lambda x: ends_with(x, '...') OR ends_with(x, '…'))) <= 30 * n_lines
  AND 100 * len(list_filter(ws, lambda x: NOT regexp_matches(x, '[A-Za-z\x{{80}}-\x{{10FFFF}}]'))) <= 30 * n_words
  AND 100 * len(list_filter(ws, lambda x: regexp_matches(x, '[A-Z][A-Z]') AND NOT regexp_matches(x, '[a-z]'))) <= 50 * n_words
  AND 100 * coalesce(list_max(map_values(list_aggregate(ws, 'histogram'))), 0) <= 30 * n_words
  AND 100 * len(list_filter(range(1, n_words), lambda i: ws[i] = ws[i + 1])) <= 20 * n_words AS kept
FROM based
"""


def _secrets() -> str:
    patterns = {"assign": secrets.ASSIGN, "access": secrets.ACCESS, "hex": secrets.HEX, "weak_id": secrets.WEAK_ID, "weak_secret": secrets.WEAK_SECRET, "endpoint": secrets.ENDPOINT}
    tests = {
        "assign": "length(g) >= 6",
        "access": "length(m) >= 20",
        "weak_secret": "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')",
    }
    found = []
    for rank, kind in enumerate(secrets.KINDS):
        p = patterns[kind].replace("'", "''")
        group = 2 if kind == "assign" else 0
        found.append(f"""
  SELECT id, '{kind}' AS kind, {rank} AS rank, unnest(regexp_extract_all(t, '{p}')) AS m, unnest(regexp_extract_all(t, '{p}', {group})) AS g,
         unnest(string_split_regex(t, '{p}')[:len(regexp_extract_all(t, '{p}'))]) AS gap, unnest(range(1, len(regexp_extract_all(t, '{p}')) + 1)) AS i
  FROM texts""")
    keep = " ".join(f"WHEN '{k}' THEN {t}" for k, t in tests.items())
    of = lambda kinds: ", ".join(f"'{k}'" for k in kinds)
    text = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank)"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}')::BIGINT AS n_{k}" for k in secrets.BASE_KINDS)
    return f"""
WITH texts AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents
), found AS ({" UNION ALL ".join(found)}
), placed AS (
  SELECT *, (sum(length(gap) + length(m)) OVER (PARTITION BY id, kind ORDER BY i))::BIGINT AS e FROM found
), spans AS (SELECT id, kind, rank, e - length(m) AS s, e FROM placed WHERE CASE kind {keep} ELSE true END
), fresh AS (
  SELECT * FROM spans a WHERE kind <> 'weak_secret' OR NOT EXISTS (
    SELECT 1 FROM spans b WHERE b.id = a.id AND b.kind IN ({of(secrets.BASE_KINDS)}) AND b.s < a.e AND a.s < b.e)
), shown AS (
  SELECT * FROM fresh a WHERE kind IN ({of(secrets.BASE_KINDS)}) OR EXISTS (
    SELECT 1 FROM fresh b WHERE b.id = a.id AND (a.kind IN ({of(secrets.SECRETS)})) <> (b.kind IN ({of(secrets.SECRETS)}))
      AND b.s - {secrets.SCOPE} < a.e AND a.s < b.e + {secrets.SCOPE})
), base AS (SELECT id, {counts}, {text} AS line FROM shown WHERE kind IN ({of(secrets.BASE_KINDS)}) GROUP BY id
), every AS (SELECT id, {text} AS spans FROM shown GROUP BY id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(line, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN base USING (id) LEFT JOIN every USING (id)
"""


ORACLES = {"op1_pareto_mix": _mix(), "op5_rule_cascade": _rules(), "op10_secret_scan": _secrets()}
