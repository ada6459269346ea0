"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import answers, form_labels, leaks, mixture, near_copies, page_bodies, site_lines, split_overlap, splitting, subject_areas, text_forms
from sparkloom.llm.base import read
from sparkloom.shared import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return text_forms.forms(read(spark, d, "documents")).where("form <> 'prose'").select("doc_id", "form")


def p1_statistics(spark: SparkSession, d: str) -> DataFrame:
    return text_forms.statistics(read(spark, d, "documents"), read(spark, d, "doc_stats"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return site_lines.repeated_lines(docs, site_lines.by_arrival(docs))


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every text without its site's recurring lines."""
    docs = read(spark, d, "documents")
    state = site_lines.LineCounts(spark)
    for batch, part in site_lines.by_arrival(docs):
        state.add(batch, part)
    return site_lines.cleaned(docs, state.recurring())


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return near_copies.near_copies(read(spark, d, "documents"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Group and number of links of every document."""
    return near_copies.grouped(read(spark, d, "documents"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return page_bodies.main_bodies(read(spark, d, "web_pages")).distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_long(read(spark, d, "documents")).where("piece = 0").select("doc_id")


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every long text."""
    return splitting.split_long(read(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(read(spark, d, "documents"), read(spark, d, "benchmark"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return answers.unsound(answers.answer_pairs(read(spark, d, "sample_results"), read(spark, d, "prompts")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.overlaps(read(spark, d, "qa_train"), read(spark, d, "qa_val"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    train, val = read(spark, d, "qa_train"), read(spark, d, "qa_val")
    return split_overlap.report(split_overlap.matches(train, val), train, val)


def p7_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How far each evaluation record is covered by training records."""
    train, val = read(spark, d, "qa_train"), read(spark, d, "qa_val")
    return split_overlap.coverage(split_overlap.matches(train, val), val)


#: Vocabulary of the public tokenizer that sizes are counted with.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _mixed(spark: SparkSession, d: str, counts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    counts, targets = table(counts, "tokens"), read(spark, d, "mix_targets")
    return mixture.mix(counts, targets), counts, targets


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d, mixture.token_counts(read(spark, d, "documents"), VOCABULARY))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.shares(*_mixed(spark, d, mixture.token_counts(read(spark, d, "documents"), VOCABULARY)))


def p9_mix_chars(spark: SparkSession, d: str) -> DataFrame:
    """The same with sizes in characters, which SQL can count."""
    return _mixed(spark, d, mixture.character_counts(read(spark, d, "documents")))[0]


def p9_shares_chars(spark: SparkSession, d: str) -> DataFrame:
    return mixture.shares(*_mixed(spark, d, mixture.character_counts(read(spark, d, "documents"))))


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subject_areas.document_subjects(read(spark, d, "documents"), read(spark, d, "doc_labels"), read(spark, d, "subjects"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject").distinct()


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).groupBy("subject").agg(F.countDistinct("doc_id").alias("documents"), F.round(F.sum("part"), 3).alias("weight"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_statistics, p2_found, p2_clean, p3_found, p3_groups, p4_found, p5_found, p6_found, p6_pieces, p7_found, p7_report, p7_coverage, p8_found, p9_mix, p9_shares, p9_mix_chars, p9_shares_chars, p10_found, p10_composition)}
# SQL of the cases where it can say the same: words, runs of words and lines as texts instead of hashes.
_PLAIN = r"replace(lower(nfc_normalize(regexp_replace({x}, '\p{{Cf}}', '', 'g'))), 'ß', 'ss')"
_WORDS = "list_filter(regexp_split_to_array(" + _PLAIN.format(x="text") + r", '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> '')"
_SITE = r"""CASE WHEN lower(trim(coalesce(url, ''))) = '' OR starts_with(lower(trim(url)), 'file:') THEN lower(trim(coalesce(source, '')))
ELSE regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)', 1) END"""

_RECURRING = rf"""raw AS (SELECT row_number() OVER () AS r, doc_id, {_SITE} AS site, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, site, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM raw WHERE ls IS NOT NULL),
k AS (SELECT r, doc_id, site, line_no, trim(regexp_replace({_PLAIN.format(x="line")}, '[^\p{{L}}\p{{M}}]+', ' ', 'g')) AS key FROM l),
n AS (SELECT site, count(*) AS docs FROM raw GROUP BY site),
f AS (SELECT site, key FROM k JOIN n USING (site) WHERE key <> '' GROUP BY site, key, docs HAVING count(DISTINCT r) >= 5 AND count(DISTINCT r) * 10 >= docs)"""
# all characters but spaces and controls; figures of lines that show any, recurring ones aside
_SHOWN = r"regexp_replace({x}, '[\p{{Z}}\p{{C}}]+', '', 'g')"
_COMMON = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted({w for x in form_labels.GLUE | form_labels.ARTICLES for w in re.findall(r"[^\W_]+", x)}))

_MIXED = """c AS (SELECT doc_id, lower(trim(source)) AS source, length(text) AS tokens FROM documents WHERE source IS NOT NULL AND length(text) > 0),
w AS (SELECT lower(trim(source)) AS source, max(target_share) AS share, max(coalesce(max_repeats, 1)) AS repeats FROM mix_targets WHERE target_share > 0 GROUP BY 1),
x AS (SELECT c.*, share, unnest(range(1, repeats + 1)) AS copy FROM c JOIN w USING (source)),
k AS (SELECT *, md5('42|' || copy || '|' || doc_id) AS h FROM x),
q AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY copy, h, doc_id) / share AS finish FROM k),
p AS (SELECT *, sum(tokens) OVER (ORDER BY finish, source, copy, h, doc_id) AS place FROM q),
m AS (SELECT CAST(place AS BIGINT) AS place, doc_id, CAST(copy AS INTEGER) AS copy, source, tokens FROM p WHERE place - tokens < (SELECT sum(tokens) FROM c))"""

_GAP = r"\t\n\x0B\f\r \x{85}\x{A0}\x{2028}\x{2029}\x{3000}"
_LAST = lambda before: f"length(regexp_extract(w, '(?s)^(.*{before})[^{_GAP}]', 1))"  # noqa: E731  the last place of that kind in a window

ORACLE: dict[str, str] = {
    "p6_pieces": rf"""WITH RECURSIVE p AS (
  SELECT doc_id, text AS t, length(text) AS n, -1 AS piece, 0 AS begin, 0 AS finish, 0 AS following FROM documents WHERE length(text) > 4096
  UNION ALL
  SELECT doc_id, t, n, piece + 1, s, e, CASE WHEN e = n THEN n WHEN o BETWEEN 1 AND 61 AND a - 1 + o <= e THEN a - 1 + o ELSE a END
  FROM (SELECT *, length(regexp_extract(substr(t, CAST(a AS BIGINT), 62), '(?s)^(.*?[{_GAP}])[^{_GAP}]', 1)) AS o FROM (SELECT *, greatest(e - 200, s + 1) AS a FROM
    (SELECT *, CASE WHEN n - s <= 4096 THEN n WHEN k1 > 2048 THEN s + k1 WHEN k2 > 2048 THEN s + k2 WHEN k3 > 2048 THEN s + k3 WHEN k4 > 2048 THEN s + k4 ELSE s + 4096 END AS e FROM
      (SELECT *, {_LAST(f"{chr(92)}n[{_GAP}]*{chr(92)}n[{_GAP}]*")} AS k1, {_LAST(f"{chr(92)}n[{_GAP}]*")} AS k2, {_LAST(f"[.!?…。！？][{_GAP}]+")} AS k3, {_LAST(f"[{_GAP}]")} AS k4 FROM
        (SELECT doc_id, t, n, piece, following AS s, substr(t, following + 1, 4097) AS w FROM p WHERE following < n)))))
)
SELECT doc_id, CAST(piece AS INTEGER) AS piece, CAST(begin AS INTEGER) AS begin, CAST(finish AS INTEGER) AS finish, substr(t, CAST(begin + 1 AS BIGINT), CAST(finish - begin AS BIGINT)) AS text FROM p WHERE piece >= 0""",
    "p9_mix_chars": f"WITH {_MIXED} SELECT * FROM m",
    "p9_shares_chars": f"""WITH {_MIXED}, g AS (SELECT source, sum(tokens) AS tokens, count(*) AS copies, count(DISTINCT doc_id) AS documents FROM m GROUP BY source), a AS (SELECT source, sum(tokens) AS available FROM c GROUP BY source)
SELECT lower(trim(t.source)) AS source, target_share, coalesce(round(g.tokens / (SELECT sum(tokens) FROM m), 6), 0) AS actual_share, CAST(coalesce(g.tokens, 0) AS BIGINT) AS tokens, coalesce(copies, 0) AS copies, coalesce(documents, 0) AS documents, CAST(coalesce(available, 0) AS BIGINT) AS available_tokens
FROM mix_targets t LEFT JOIN g ON g.source = lower(trim(t.source)) LEFT JOIN a ON a.source = lower(trim(t.source))""",
    "p1_statistics": rf"""WITH {_RECURRING},
v AS (SELECT k.doc_id, replace(nfc_normalize(regexp_replace(l.line, '\p{{Cf}}', '', 'g')), 'ß', 'ss') AS line FROM l JOIN k USING (r, line_no) LEFT JOIN f ON f.site = k.site AND f.key = k.key WHERE f.key IS NULL),
c AS (SELECT doc_id, {_SHOWN.format(x="line")} AS shown, list_filter(regexp_split_to_array(lower(line), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda w: w <> '') AS w,
regexp_matches(line, '[.!?…]["”’)»'']?[\p{{Z}}\p{{C}}]*$') AS ended, length(regexp_replace(regexp_replace(regexp_replace(line, '[.!?…]{{2,}}', '~', 'g'), '[.!?…](["”’)»'']|[\p{{Z}}\p{{C}}]|$)', chr(1), 'g'), '[^\x01]', '', 'g')) AS stops,
length(regexp_replace(line, '[^\p{{L}}\p{{M}}]', '', 'g')) AS letters, length(regexp_replace(line, '[\p{{L}}\p{{M}}\p{{N}}\p{{Z}}\p{{C}}.,:;!?…''"()–—‘’“”„«»/%&-]', '', 'g')) AS symbols FROM v),
s AS (SELECT doc_id, count(*) AS lines, sum(length(shown)) AS chars, sum(len(w)) AS words, sum(stops) AS sentences, sum(letters) AS letters, sum(symbols) AS symbols, count(*) FILTER (ended) AS ended, sum(len(list_filter(w, lambda x: x IN ({_COMMON})))) AS common FROM c WHERE shown <> '' GROUP BY doc_id),
t AS (SELECT * FROM doc_stats WHERE doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY analyzed_at DESC NULLS LAST, words DESC NULLS LAST, sentences DESC NULLS LAST, quality_score DESC NULLS LAST) = 1)
SELECT d.doc_id, CAST(coalesce(lines, 0) AS BIGINT) AS lines, CAST(coalesce(s.chars, 0) AS BIGINT) AS chars, CAST(coalesce(s.words, 0) AS BIGINT) AS words, CAST(coalesce(s.sentences, 0) AS BIGINT) AS sentences,
coalesce(round(letters / nullif(s.words, 0), 9), 0) AS mean_word, coalesce(round(symbols / nullif(s.chars, 0), 9), 0) AS symbol_share, coalesce(round(ended / nullif(lines, 0), 9), 0) AS ended_lines, coalesce(round(common / nullif(s.words, 0), 9), 0) AS common_words,
t.words AS stored_words, t.sentences AS stored_sentences, t.quality_score FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "p2_found": rf"""WITH {_RECURRING}
SELECT DISTINCT doc_id, CAST(line_no AS INTEGER) AS line_no FROM k JOIN f USING (site, key)""",
    "p2_clean": rf"""WITH {_RECURRING},
m AS (SELECT k.r, k.doc_id, k.line_no, l.line, f.key IS NOT NULL AS gone FROM l JOIN k USING (r, line_no) LEFT JOIN f ON f.site = k.site AND f.key = k.key)
SELECT d.doc_id, CASE WHEN d.ls IS NOT NULL THEN coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '') END AS text, CAST(coalesce(count(*) FILTER (gone), 0) AS INTEGER) AS removed FROM raw d LEFT JOIN m USING (r) GROUP BY d.r, d.doc_id, d.ls""",
    "p3_groups": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) > 2),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(1) ORDER BY g)) AS class FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, x.class AS ka, y.class AS kb FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n, x.class, y.class HAVING 2 * count(*) >= x.n + y.n - count(*)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b)
SELECT a AS doc_id, min(b) AS group_id, (SELECT count(DISTINCT kb) FROM p WHERE p.a = r.a AND ka <> kb) AS links FROM r GROUP BY a""",
    "p3_found": f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) > 2),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id)
SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 2 * count(*) >= x.n + y.n - count(*)""",
    "p6_found": "SELECT doc_id FROM documents WHERE length(text) > 4096",
    "p8_found": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
a AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM d WHERE len(w) > 11),
b AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM i WHERE len(w) > 11)
SELECT DISTINCT doc_id, item_id FROM a JOIN b USING (g)""",
}
