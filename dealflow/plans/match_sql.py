"""DuckDB twins of the matching queries (D1 to D19) over the landed sheets, whose columns are unpivoted deals."""

from __future__ import annotations

import re

from ..functions.catalog import BOOSTS, FIELDS, OPTIONAL, PATTERNS, PROFILE_BLANKS
from ..operators.matching import URL
from ..sources.fixtures import SHEET_HEADERS
from .sql import DEAL_LIST


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(_text(x) for x in xs) + "]::VARCHAR[]"


def plain_matches(pattern: str) -> tuple[list[str], list[str]]:
    """A pattern with look-aheads as patterns that have to match and patterns that must not."""
    if pattern.startswith("(?"):
        ahead = re.findall(r"\(\?([=!])\.\*(\\b\(.*?\)\\b)\)", pattern)
        return [p for s, p in ahead if s == "="], [p for s, p in ahead if s == "!"]
    kept, _, tail = pattern.partition("(?!")
    return [kept], [kept + tail[:-1]] if tail else []


def _norm(x: str) -> str:
    bare = f"regexp_replace(regexp_replace({x}, '\\([a-zA-Z]+\\)', ' ', 'g'), '\\(\\d+\\)', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace(lower({bare}), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def _plain(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '\\([a-z0-9]+\\)', '', 'g'), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g'))"


_tokens = lambda x: f"list_filter(list_distinct(string_split({_norm(x)}, ' ')), lambda t: t <> '')"
_value = lambda x: "'www.' || lower(geography) || '.com'" if x == "geography" else f"{x}::VARCHAR"
_share = lambda cond: f"avg(({cond})::INTEGER) FILTER (num IS NOT NULL)"
_catalogue = ", ".join(f"({_text(f)}, {i}, {_text(label)}, {_list(a)})" for i, (f, label, a, _) in enumerate(FIELDS))
_patterns = ", ".join(f"({_text(f)}, {i}, {_list(yes)}, {_list(no)}, {s})" for f, ps in PATTERNS.items() for i, (p, s) in enumerate(ps) for yes, no in [plain_matches(p)])
_boosts = ", ".join(f"({_text(f)}, {_text(looks)}, {b})" for f, (looks, b) in BOOSTS.items())

#: Cells and profiles of the columns of each file, up to the company multiplier.
COLUMNS = f"""{DEAL_LIST},
cells AS (SELECT * FROM (SELECT gp_name AS file, fund, deal_id, unnest(range(0, {len(SHEET_HEADERS)}))::INTEGER AS col_index, unnest({_list(h for _, h in SHEET_HEADERS)}) AS col_name,
    unnest([{", ".join(_value(x) for x, _ in SHEET_HEADERS)}]) AS value FROM raw WHERE fund IS NOT NULL) WHERE value IS NOT NULL),
vals AS (SELECT *, CASE WHEN trim(value) NOT IN ({", ".join(map(_text, PROFILE_BLANKS))}) THEN trim(value) END AS v FROM cells),
nums AS (SELECT *, try_cast(v AS DOUBLE) AS num, regexp_matches(v, '^\\d{{4}}-\\d{{2}}-\\d{{2}}')::INTEGER AS d,
    CASE WHEN v IS NOT NULL THEN row_number() OVER (PARTITION BY file, col_index, v IS NULL ORDER BY fund, deal_id) END AS place FROM vals),
prof0 AS (SELECT file, col_index, col_name, count(*) AS rows, count(v) AS n, avg(d) AS dates, count(num) AS nums, max(num) AS hi, avg(num) AS mean, count(DISTINCT v) AS dist, avg(length(v)) AS len, {_share("abs(num) <= 2")} AS small,
    avg(contains(v, '%')::INTEGER) AS pct, {_share("num > 0 AND num < 30")} AS m1, {_share("num >= 0.5 AND num <= 15")} AS m2, {_share("num > -0.9 AND num < 3")} AS i1, {_share("num > -90 AND num < 300")} AS i2, {_share("num >= 0.1")} AS c1,
    count(*) FILTER (place <= 10) AS s_n, avg(regexp_matches(v, '{URL}')::INTEGER) FILTER (place <= 10) AS s_url, avg(length(v)) FILTER (place <= 10) AS s_len, avg(len(regexp_split_to_array(v, '\\s+'))) FILTER (place <= 10) AS s_words FROM nums GROUP BY ALL),
prof1 AS (SELECT *, n / rows AS fill, CASE WHEN n = 0 THEN 'empty' WHEN dates >= 0.5 THEN 'date' WHEN nums / n >= 0.75 AND (small >= 0.8 OR pct >= 0.3) THEN 'percent' WHEN nums / n >= 0.75 THEN 'numeric' WHEN nums / n >= 0.3 THEN 'mixed' ELSE 'string' END AS kind FROM prof0),
prof AS (SELECT *, CASE WHEN kind IN ('numeric', 'percent', 'date') THEN 0.1 WHEN fill < 0.3 OR s_n = 0 THEN 0.3 WHEN s_url > 0.3 THEN 0.15 WHEN s_len > 60 OR s_words > 7 THEN 0.3 WHEN dist / greatest(1.0, n::DOUBLE) < 0.35 THEN 0.4 ELSE 1.0 END::DOUBLE AS mult,
    list_filter([CASE WHEN nums >= 3 AND m1 >= 0.85 AND m2 >= 0.6 AND mean > 0.5 AND mean < 20 THEN 'moic' END, CASE WHEN nums >= 3 AND ((i1 >= 0.9 AND kind IN ('numeric', 'mixed') AND mean < 0.5) OR (i2 >= 0.9 AND kind = 'percent')) THEN 'irr' END,
      CASE WHEN nums >= 3 AND c1 >= 0.8 AND hi >= 1 THEN 'currency' END, CASE WHEN dates >= 0.5 THEN 'date' END, CASE WHEN kind = 'string' AND fill >= 0.5 AND dist >= least(3.0, n * 0.3) AND len < 60 THEN 'identifier' END], lambda x: x IS NOT NULL) AS looks FROM prof1)"""

SCORES = f"""{COLUMNS},
cat(field_id, field_ord, label, aliases) AS (VALUES {_catalogue}),
pat(field_id, i, yes, no, score) AS (VALUES {_patterns}),
boost(field_id, look, plus) AS (VALUES {_boosts}),
pairs AS (SELECT file, col_index, col_name, mult, looks, field_id, field_ord, {_norm("col_name")} AS nc, {_tokens("col_name")} AS toks, label, aliases FROM prof, cat),
alias AS (SELECT file, col_index, field_id, arg_min(score, i) AS a FROM (SELECT *, CASE WHEN nc = al THEN 0.95::DOUBLE WHEN (contains(nc, al) OR contains(al, nc)) AND length(al) / greatest(length(nc), length(al)) >= 0.7
    THEN 0.80::DOUBLE + 0.10::DOUBLE * (length(al) / greatest(length(nc), length(al))) END AS score FROM (SELECT *, {_norm("x")} AS al FROM (SELECT file, col_index, field_id, nc, unnest(aliases) AS x, generate_subscripts(aliases, 1) AS i FROM pairs))) WHERE score IS NOT NULL GROUP BY ALL),
bag AS (SELECT file, col_index, field_id, max(CASE WHEN len(toks) = 0 OR len(t) = 0 THEN 0 ELSE len(list_intersect(toks, t)) / len(list_distinct(list_concat(toks, t))) END) AS j
    FROM (SELECT *, {_tokens("x")} AS t FROM (SELECT file, col_index, field_id, toks, unnest(list_concat([label], aliases)) AS x FROM pairs)) GROUP BY ALL),
pattern AS (SELECT file, col_index, p.field_id, arg_min(score, i) AS r FROM pairs p JOIN pat USING (field_id) WHERE len(list_filter(yes, lambda y: NOT regexp_matches(nc, y))) = 0 AND len(list_filter(no, lambda y: regexp_matches(nc, y))) = 0 GROUP BY ALL),
s0 AS (SELECT p.*, coalesce(a, 0)::DOUBLE AS a, coalesce(r, 0)::DOUBLE AS r, CASE WHEN j >= 0.4 THEN least(0.85::DOUBLE, 0.50::DOUBLE + (j - 0.40::DOUBLE) * 3.5::DOUBLE) ELSE 0 END::DOUBLE AS f, CASE WHEN list_contains(looks, look) THEN plus ELSE 0 END::DOUBLE AS b
    FROM pairs p LEFT JOIN alias USING (file, col_index, field_id) LEFT JOIN pattern USING (file, col_index, field_id) LEFT JOIN bag USING (file, col_index, field_id) LEFT JOIN boost USING (field_id)),
s1 AS (SELECT *, greatest(a, r, f) AS top FROM s0),
scored AS (SELECT file, col_index, col_name, field_id, field_ord, least(1.0::DOUBLE, top + CASE WHEN top >= 0.30 THEN b ELSE 0 END) * CASE WHEN field_id = 'company' THEN mult ELSE 1 END AS confidence,
    concat_ws(',', CASE WHEN a > 0 THEN 'alias' END, CASE WHEN r > 0 THEN 'pattern' END, CASE WHEN f > 0 THEN 'tokens' END, CASE WHEN top >= 0.30 AND b > 0 THEN 'profile' END, CASE WHEN field_id = 'company' AND mult < 1 THEN 'penalised' END) AS signals FROM s1)"""

#: Greedy choice by confidence, one step a row. Companies repeat in these files, so that neither headers nor values give
#: a company column.
MAPPED = f"""{SCORES},
items AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY confidence DESC, field_ord, col_index) AS i FROM scored WHERE confidence >= 0.5),
steps(file, i, fields, cols) AS (SELECT DISTINCT file, 0::BIGINT, []::VARCHAR[], []::INTEGER[] FROM items UNION ALL
    SELECT g.file, x.i, CASE WHEN list_contains(fields, field_id) OR list_contains(cols, col_index) THEN fields ELSE list_append(fields, field_id) END, CASE WHEN list_contains(fields, field_id) OR list_contains(cols, col_index) THEN cols ELSE list_append(cols, col_index) END FROM steps g JOIN items x ON x.file = g.file AND x.i = g.i + 1),
picked AS (SELECT file, unnest(fields) AS field_id, unnest(cols) AS col_index FROM (SELECT file, arg_max(fields, i) AS fields, arg_max(cols, i) AS cols FROM steps GROUP BY file)),
mapped AS (SELECT f.file, c.field_id, c.field_ord, c.label, s.col_index, s.col_name, coalesce(s.confidence, 0) AS confidence, CASE WHEN s.confidence >= 0.85 THEN 'auto_confirmed' WHEN s.confidence >= 0.5 THEN 'needs_review' ELSE 'unmapped' END AS status,
    CASE WHEN s.confidence >= 0.85 THEN 'green' WHEN s.confidence >= 0.5 THEN 'yellow' ELSE 'red' END AS tier, c.field_id IN ({", ".join(map(_text, OPTIONAL))}) AS optional
    FROM (SELECT DISTINCT file FROM prof) f, cat c LEFT JOIN picked p ON p.file = f.file AND p.field_id = c.field_id LEFT JOIN scored s ON s.file = p.file AND s.field_id = p.field_id AND s.col_index = p.col_index)"""

RULES = f"""{COLUMNS},
names AS (SELECT f.field_id, f.field_ord, {_plain("x")} AS a, i FROM (SELECT field_id, field_ord, unnest(aliases) AS x, generate_subscripts(aliases, 1) AS i FROM (VALUES {_catalogue}) t(field_id, field_ord, label, aliases)) f),
ruled AS (SELECT file, col_index, col_name, field_id FROM (SELECT file, col_index, col_name, {_plain("col_name")} AS n FROM prof) q, names WHERE contains(n, a) OR contains(a, n) QUALIFY row_number() OVER (PARTITION BY file, col_index, col_name ORDER BY length(a) DESC, field_ord, i) = 1),
first50 AS (SELECT *, trim(value) AS x, try_cast(regexp_replace(trim(value), 'x+$', '') AS DOUBLE) AS m, try_cast(regexp_replace(trim(value), '%+$', '') AS DOUBLE) AS r FROM cells QUALIFY row_number() OVER (PARTITION BY file, col_index ORDER BY fund, deal_id) <= 50),
valued AS (SELECT file, col_index, col_name, CASE WHEN avg(regexp_matches(x, '^\\d{{4}}-\\d{{2}}-\\d{{2}}')::INTEGER) > 0.6 THEN 'entry_date' WHEN avg(coalesce(regexp_matches(x, '^\\d+\\.?\\d*x?$') AND m > 0 AND m < 25, false)::INTEGER) > 0.7 THEN 'gross_moic'
    WHEN avg(coalesce(r > -0.5 AND r < 1.5, false)::INTEGER) > 0.7 THEN 'gross_irr' END AS field_id FROM first50 GROUP BY file, col_index, col_name),
one AS (SELECT *, 1 AS layer, 0.95::DOUBLE AS confidence FROM ruled QUALIFY row_number() OVER (PARTITION BY file, field_id ORDER BY col_index) = 1),
layered AS (SELECT * FROM (SELECT * FROM one UNION ALL SELECT *, 2, 0.75::DOUBLE FROM valued v WHERE field_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM one o WHERE o.file = v.file AND o.col_index = v.col_index)) QUALIFY row_number() OVER (PARTITION BY file, field_id ORDER BY layer, col_index) = 1)"""

_with = lambda ctes, body: f"WITH RECURSIVE {ctes} {body}"
TWINS = {
    "D1_D9_scores": _with(SCORES, "SELECT file, col_name, field_id, round(confidence, 6) AS confidence, signals FROM scored WHERE confidence > 0"),
    "D10_D12_mapping": _with(MAPPED, "SELECT file, field_id, col_name, round(confidence, 6) AS confidence, status, tier, optional FROM mapped"),
    "D12_unmapped_columns": _with(MAPPED, "SELECT file, col_index, col_name FROM prof ANTI JOIN picked USING (file, col_index)"),
    "D13_review_report": _with(
        MAPPED,
        """, counted AS (SELECT file, count(*) FILTER (status = 'auto_confirmed') AS auto_confirmed, count(*) FILTER (status = 'needs_review') AS needs_review, count(*) FILTER (status = 'unmapped') AS unmapped FROM mapped GROUP BY file),
        found AS (SELECT gp_name AS file, count(*) FILTER (total_ic < 0) AS errors, count(*) FILTER (NOT coalesce(total_ic < 0, false)) AS warnings FROM raw GROUP BY gp_name)
        SELECT *, needs_review = 0 AND errors = 0 AS is_clean, auto_confirmed || ' auto confirmed, ' || needs_review || ' needs review, ' || unmapped || ' unmapped, ' || errors || ' errors, ' || warnings || ' warnings' AS summary
        FROM (SELECT counted.*, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings FROM counted LEFT JOIN found USING (file))""",
    ),
    "D14_mapping_log": _with(MAPPED, "SELECT file, label, col_name, round(confidence, 4) AS confidence, tier FROM mapped"),
    "D15_rule_match": _with(RULES, "SELECT * FROM ruled"),
    "D16_value_match": _with(RULES, "SELECT * FROM valued"),
    "D17_layered": _with(RULES, "SELECT * FROM layered"),
    "D19_review_queue": _with(MAPPED, "SELECT file, CASE WHEN status = 'auto_confirmed' THEN 'confirmed' WHEN status = 'unmapped' AND optional THEN 'expected_gaps' ELSE 'review' END AS queue, count(*) AS fields, string_agg(field_id, ', ' ORDER BY field_ord) AS field_ids FROM mapped GROUP BY 1, 2"),
}
