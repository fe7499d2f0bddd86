"""Check SQL for the quality checks of any table, written straight from the definitions."""

from __future__ import annotations


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def facts_sql(source: str, columns: list[str], text: list[str], edge: str = "both") -> str:
    """CTE bodies ``base``, ``heads`` and ``marks`` over a table or view."""
    missing = " + ".join(f"({quoted(c)} IS NULL)::INT" for c in columns)
    names = ", ".join(f"({literal(c)})" for c in columns)
    marks = []
    for position, c in enumerate(text):
        cell = quoted(c)
        trimmed = f"trim({cell}, {{WS}})" if edge == "both" else f"ltrim({cell}, {{WS}})"
        marks.append(
            f"SELECT {position} AS position, {literal(c)} AS name, count({cell}) AS filled, "
            f"count(DISTINCT lower(trim({cell}, {{WS}}))) AS forms, "
            f"coalesce(bool_or({cell} <> {trimmed}), false) AS edge, "
            f"count(DISTINCT {cell}) > count(DISTINCT lower(trim({cell}, {{WS}}))) AS varies FROM {source}"
        )
    snake = "lower(trim(regexp_replace(trim(name, {WS}), '[^0-9a-zA-Z]+', '_', 'g'), '_'))"
    return f"""
base AS (SELECT count(*) AS n, sum({missing}) AS missing,
                (SELECT count(*) FROM (SELECT DISTINCT * FROM {source})) AS distinct_rows FROM {source}),
heads AS (SELECT count(*) AS k, string_agg(name, ',' ORDER BY name) AS names
          FROM (VALUES {names}) h(name) WHERE {snake} <> trim(name, {{WS}})),
marks AS ({" UNION ALL ".join(marks)}),
ratios AS (SELECT n, missing, n - distinct_rows AS duplicates,
                  missing::DOUBLE / greatest(n * {len(columns)}, 1) AS missing_ratio,
                  (n - distinct_rows)::DOUBLE / greatest(n, 1) AS duplicate_ratio,
                  (SELECT k FROM heads) AS n_header,
                  (SELECT count(*) FROM marks WHERE edge) AS n_whitespace,
                  (SELECT count(*) FROM marks WHERE varies) AS n_case FROM base),
penalties AS (SELECT *, least(35.0::DOUBLE, missing_ratio * 100) AS p_missing,
                     least(20.0::DOUBLE, duplicate_ratio * 120) AS p_duplicate,
                     least(8.0::DOUBLE, n_header * 2.0::DOUBLE) AS p_header,
                     least(10.0::DOUBLE, n_whitespace * 2.0::DOUBLE) AS p_whitespace,
                     least(12.0::DOUBLE, n_case * 2.0::DOUBLE) AS p_case FROM ratios),
scored AS (SELECT *, greatest(0, least(100, round_even(100 - (p_missing + p_duplicate + p_header
                     + p_whitespace + p_case), 0)))::INT AS quality_score FROM penalties)"""


def score_sql(source: str, columns: list[str], text: list[str], edge: str = "both") -> str:
    return f"""WITH {facts_sql(source, columns, text, edge)}
SELECT n AS row_count, missing_ratio, duplicate_ratio, n_header::INT AS n_header,
       n_whitespace::INT AS n_whitespace, n_case::INT AS n_case, quality_score FROM scored"""
