"""Queries and the SQL that must give the same rows, side by side; pieces of DuckDB SQL that mirror the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.functions import fixed
from sparkloom.shared import spread

Query = Callable[[SparkSession, str], DataFrame]


class Plans:
    """Queries by name and, where there is one, the equivalent SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def register(query: Query) -> Query:
            self.queries[query.__name__] = query
            if sql is not None:
                self.oracle[query.__name__] = sql
            return query

        return register


#: Tables with long texts, on which work is worth being spread.
TEXTS = {"documents", "web_pages", "sample_results", "prompts", "qa_train"}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df) if name in TEXTS else df


def quote(value: object) -> str:
    """A literal of DuckDB."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(quote, value)) + "]"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return repr(value)


def values(rows: list[tuple], names: str) -> str:
    """A table of literals."""
    return "(VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + f") AS t({names})"


# ---- SQL that mirrors sparkloom.functions ------------------------------------------------------------------------

S = fixed.SPACE


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{S}+|{S}+$', '', 'g')"


def clean(x: str) -> str:
    x = rf"regexp_replace({x}, '[\x{{200B}}\x{{200C}}\x{{200D}}\x{{FEFF}}]', '', 'g')"
    x = rf"regexp_replace({x}, '\r\n|\r', chr(10), 'g')"
    x = rf"regexp_replace({x}, '\n{{4,}}', chr(10)||chr(10)||chr(10), 'g')"
    return strip(rf"regexp_replace({x}, '[ \t]+', ' ', 'g')")


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{S}+'), lambda w: w <> '')"


def tokens(x: str) -> str:
    stop = quote(fixed.STOPWORDS)
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: length(t) > 1 AND NOT list_contains({stop}, t))"


def hits(x: str, patterns: list[str]) -> str:
    return "(" + " + ".join(f"CASE WHEN regexp_matches({x}, {quote(p)}) THEN 1 ELSE 0 END" for p in patterns) + ")"


def any_in(x: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {quote(p)})" for p in parts) + ")" if parts else "FALSE"


# RE2 sees no word boundary after an accented letter, so the pattern ends without one there.
PERSONAL_BODY = "(?is)(?:" + "|".join(fixed.PERSONAL_BODY).replace(r"\b(curriculum\s+vitae|résumé|resume)\b", r"(?:\bcurriculum\s+vitae\b|\brésumé|\bresume\b)") + ")"


def documents_cte(extra: str = "") -> str:
    """CTE ``d`` of normalised documents: doc_id, title, source, url, text, chars, key."""
    return f"""d0 AS (SELECT doc_id, coalesce(title, '') AS title, lower(trim(coalesce(source, 'unknown'))) AS source, coalesce(url, '') AS url, {clean("coalesce(text, '')")} AS text FROM documents{extra}),
d AS (SELECT *, length(text) AS chars, substr(sha1(url || title), 1, 12) AS key FROM d0)"""


def scored_cte() -> str:
    """CTE ``s`` of scored documents, from ``d``."""
    body = PERSONAL_BODY
    total = "greatest(length(text), 1)"
    part = lambda r: f"(length(regexp_replace(text, '[^{r}]', '', 'g')) / {total})"
    scripts = [(n, part(rf"\x{{{a}}}-\x{{{b}}}")) for n, a, b in fixed.SCRIPTS]
    top = "greatest(" + ", ".join(p for _, p in scripts) + ")"
    name = "CASE " + " ".join(f"WHEN {p} = {top} THEN '{n}'" for n, p in scripts) + " END"
    raw = f"least(len(list_distinct(list_transform(w, lambda x: lower(x)))) / words, 1.0) * 0.6 + least(words / 2000, 1.0) * 0.2 - least({hits('text', ['(?i)' + p for p in fixed.BOILERPLATE])} * 0.15, 0.5)"
    return f"""s0 AS (SELECT *, {words("text")} AS w FROM d),
s1 AS (SELECT *, len(w) AS words, len(regexp_extract_all(text, '[.!?]+')) AS sentences, regexp_extract(text, {quote(body)}) AS found, {top} AS other, {name} AS script, {part("a-zA-Z")} AS latin FROM s0),
s2 AS (SELECT *, CASE WHEN {strip("text")} = '' THEN 'empty document'
  WHEN regexp_matches(title, {quote('(?i)' + fixed.PERSONAL_TITLE)}) THEN 'personal document title: ''' || title || ''''
  WHEN found <> '' THEN 'personal document pattern: ''' || replace(substr(found, 1, 60), chr(10), ' ') || ''''
  WHEN other > 0.20 AND other > latin * 0.5 THEN CAST(CAST(floor(other * 100) AS BIGINT) AS VARCHAR) || '% ' || script || ' script — likely not research content'
  WHEN words < 50 THEN 'too short' ELSE '' END AS reason FROM s1),
s AS (SELECT *, CASE WHEN reason = 'too short' THEN 0.1 WHEN reason <> '' THEN 0.0 ELSE greatest(0.0, least(1.0, {raw})) END AS score,
  CASE WHEN NOT list_contains({quote(fixed.ALWAYS_EXTERNAL)}, source) AND {any_in("lower(title)", fixed.INTERNAL_TITLES)} THEN 'internal' ELSE 'external' END AS kind FROM s2)"""


def chunks_cte(source: str, size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP) -> str:
    """Recursive CTEs ending in ``c`` (id, kind, chunk_no, chunk) from ``source`` with id, kind and text."""
    keep = f"right(f.cur, {overlap}) || chr(10) || chr(10) || p.piece" if overlap else "p.piece"
    return rf"""paras AS (SELECT id, kind, unnest(ps) AS para, generate_subscripts(ps, 1) AS pn FROM (SELECT id, kind, regexp_split_to_array({strip("text")}, '\n\n+') AS ps FROM {source})),
cuts AS (
  SELECT id, kind, pn, para, 1 AS pos, CAST(NULL AS VARCHAR) AS piece, 0 AS k FROM paras
  UNION ALL
  SELECT id, kind, pn, para, pos + n, {strip("substr(para, pos, n)")}, k + 1 FROM (
    SELECT *, CASE WHEN length(para) <= {size} THEN length(para) + 1 WHEN length(para) - pos + 1 <= {size} THEN {size}
      WHEN strpos(reverse(substr(para, pos, {size})), ' ') BETWEEN 1 AND {size} - 1 THEN {size} - strpos(reverse(substr(para, pos, {size})), ' ') ELSE {size} END AS n
    FROM cuts WHERE pos <= length(para) OR (k = 0 AND length(para) = 0))),
numbered AS (SELECT id, kind, CASE WHEN length(para) <= {size} THEN para ELSE piece END AS piece, row_number() OVER (PARTITION BY id ORDER BY pn, k) AS n FROM cuts WHERE k > 0),
fold AS (
  SELECT id, kind, CAST(0 AS BIGINT) AS n, CAST('' AS VARCHAR) AS cur, CAST(NULL AS VARCHAR) AS out FROM (SELECT DISTINCT id, kind FROM numbered)
  UNION ALL
  SELECT f.id, f.kind, p.n, CASE WHEN length(f.cur) + length(p.piece) + 2 > {size} AND f.cur <> '' THEN {keep} WHEN f.cur <> '' THEN f.cur || chr(10) || chr(10) || p.piece ELSE p.piece END,
    CASE WHEN length(f.cur) + length(p.piece) + 2 > {size} AND f.cur <> '' THEN {strip("f.cur")} END
  FROM fold f JOIN numbered p ON p.id = f.id AND p.n = f.n + 1),
emitted AS (SELECT id, kind, n, out AS chunk FROM fold WHERE out IS NOT NULL
  UNION ALL SELECT id, kind, n + 1, {strip("cur")} FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC) AS r FROM fold) WHERE r = 1 AND {strip("cur")} <> ''),
c AS (SELECT id, kind, row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS chunk_no, chunk FROM emitted)"""
