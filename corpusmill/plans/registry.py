"""Where queries and their SQL are registered, and what the catalogues share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_sql(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def list_sql(xs: list[str]) -> str:
    return "[" + ", ".join(map(text_sql, xs)) + "]"


def pick(xs: list[str], n: Column) -> Column:
    """xs[n mod len]; in SQL: ``pick_sql``."""
    return F.element_at(F.array(*map(F.lit, xs)), (F.pmod(n, F.lit(len(xs))) + 1).cast("int"))


def pick_sql(xs: list[str], n: str) -> str:
    return f"{list_sql(xs)}[CAST(({n}) % {len(xs)} AS BIGINT) + 1]"


NOT_COMMENT = r"""NOT regexp_matches(t, '^\s*(#|//|\*|/\*|"""  + r'"""' + r"""|''''''|--)')"""
_SIGNAL = r"NOT regexp_matches({}, '(?i)\b(example|sample|placeholder|example\.com|xxx+|your[_-]?\w+|todo|fixme|mock|dummy|redacted|changeme)\b')"
SNIPPET = r"substr(regexp_replace(t, '^\s+|\s+$', '', 'g'), 1, 200)"


def _rule_sql(rule: scan.Rule) -> str:
    """Whether line t matches; look-aheads, which RE2 lacks, as a match less the excluded form."""
    if rule.id == "unsafe_deserialization":
        return r"(regexp_matches(t, '\b(pickle\.loads?|cPickle\.loads?|marshal\.loads?|dill\.loads?)\b') OR (regexp_matches(t, '\byaml\.load\s*\(\w') AND NOT regexp_matches(t, '\byaml\.load\s*\([^)]*Loader\s*=')))"
    if rule.id == "xss_innerhtml":
        return r"regexp_matches(t, '\.innerHTML\s*=[^=]')"
    pattern = rule.pattern.replace("(?idU)", "(?i)").replace("(?dU)", "")
    return f"regexp_matches(t, {text_sql(pattern)})"


def found_sql(lines: str, key: str) -> str:
    """CTEs up to found(key, rule, severity, line, t, entropy) over lines(key, line, t): every rule line by line, and the entropy of values."""
    parts = []
    for r in scan.RULES:
        spared = f" AND {NOT_COMMENT} AND {_SIGNAL.format(SNIPPET)}" if r.skip_comments else ""
        parts.append(f"SELECT {key}, '{r.id}' AS rule, '{r.severity}' AS severity, line, t, CAST(NULL AS DOUBLE) AS entropy FROM {lines} WHERE {_rule_sql(r)}{spared} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY line) <= 5")
    value = scan.ASSIGNMENT.replace("(?iU)", "(?i)")
    share = "(len(list_filter(string_split(v, ''), lambda x: x = c)) / length(v))"
    union = "\n UNION ALL ".join(parts)
    return f"""pattern AS ({union}),
    vals AS (SELECT {key}, line, t, unnest(regexp_extract_all(t, {text_sql(value)}, 2)) AS v FROM {lines} WHERE length(t) <= 1000 AND {NOT_COMMENT} AND {_SIGNAL.format('t')}),
    scored AS (SELECT *, abs(-list_sum(list_transform(list_distinct(string_split(v, '')), lambda c: {share} * log2({share})))) AS h FROM vals WHERE NOT regexp_matches(v, '^(?:https?://|[./\\\\]|[\\w./-]*\\{{|%s|\\$\\{{)')),
    random AS (SELECT {key}, 'high_entropy_value' AS rule, 'HIGH' AS severity, line, t, h AS entropy FROM scored
        WHERE NOT regexp_matches(v, '\\s') AND (h >= 4.2 OR (length(v) >= 32 AND h >= 3.5 AND (regexp_matches(v, '^[0-9a-fA-F]+$') OR len(list_distinct(string_split(v, ''))) >= 12)))),
    found AS (SELECT * FROM pattern UNION ALL SELECT * FROM random)"""
