"""Queries on documents: cleaning, keys, rules, scores, chunks, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import fixed, rules, text
from sparkloom.operators import chunking, extraction, packaging, quality
from sparkloom.plans.base import PERSONAL_BODY, Plans, S, any_in, chunks_cte, clean, documents_cte, hits, quote, read, scored_cte, strip, values, words
from sparkloom.sources import files, services

plans = Plans()

# Literal rows, on either side, for what the tables don't trigger.
LONG = "word " * 60
CLEANING = [(1, "a\u200bb\u200cc\u200dd\ufeffe"), (2, "x\r\ny\rz"), (3, "a\n\n\nb\n\n\n\nc\n\n\n\n\n\nd"), (4, "  a \t\t b\u00a0 "), (5, ""), (6, "\u3000wide\u3000")]
PERSONAL = [
    (1, "", "Invoice number 12-34 of May"), (2, "", "The invoice was mentioned"), (3, "My Salary 2024", "plain"), (4, "offer_letter", "plain"), (5, "", "subtotal of the day $"), (6, "", "bank   transfer"),
    (7, "", "Terms and conditions apply\nonce the form is signed"), (8, "", "work experience\nten years " + "x" * 40 + "\neducation"), (9, "", "We hereby confirm"), (10, "", "the patient name"), (11, "statement", ""), (12, "understatement", "nothing"),
    (13, "", "payment method: visa"), (14, "", "payment method for the api"), (15, "", "effective date: 3 May"), (16, "", "curriculum vitae"), (17, "", "order # 55"), (18, "cv_2", ""), (19, "", "skills:\n python, some experience"),
]
HEBREW, ARABIC, CHINESE, KANA, HANGUL, CYRILLIC = "\u05d0" * 10, "\u0628" * 10, "\u4e2d" * 10, "\u3042" * 10, "\uac00" * 10, "\u0416" * 10
SCRIPT_TEXTS = [(1, HEBREW), (2, ARABIC), (3, CHINESE), (4, KANA), (5, HANGUL), (6, CYRILLIC), (7, "a" * 40 + HEBREW), (8, "a" * 29 + HEBREW), (9, "a" * 15 + CYRILLIC), (10, "latin only"), (11, ""), (12, "1" * 30 + HEBREW), (13, "a" * 21 + "1" * 8 + CHINESE)]
TITLES = [("pdf", "code_review"), ("local", "My CODE_REVIEW notes"), ("local", "plain"), ("unknown", "walkthrough"), ("WEB", "agents.md"), ("notes", "claude.md"), ("drive", "x"), ("local", "")]
PATHS = ["/home/x/Downloads/a", "C:\\Users\\d\\Desktop", "/data/papers", "/Music", "music_store/x", "/x/Google Drive/y", ""]
TOPICS = ["Survey of vector stores", "Architecture of a pipeline", "RLHF in practice", "A python sdk", "market of caching", "distributed eval", "logging api", "", "Gardening", "BENCHMARK", "red team plugin"]
INPUTS = [
    (1, "2024-01-01T00:00:00 [ERROR] boom"), (2, "Traceback (most recent call last)\nValueError: x"), (3, "# Abstract\nWe propose a thing, et al. 2020"), (4, "def f():\n  pass\nawait g()"), (5, "<html><title>x</title></html>"),
    (6, "[ERROR] only one"), (7, "et al. Figure 3 def\nimport x\nawait y"), (8, "x" * 10_000 + "<html><title>"), (9, ""), (10, "nav {color: red} onClick"), (11, "const a = 1\n```python\nx\n```"), (12, "# References\n[1] Smith, J. arXiv"),
]
MODELS = ["ollama:llama3.2", "ollama:mistral@http://host:11434/", "claude-3-5-haiku", "gemini-pro", "gpt-4o-mini", "", "ollama:a:7b", "claude"]
FENCES = [(1, "```\nx\n```"), (2, "```python\nx"), (3, "no fence"), (4, "text ``` inline"), (5, "```\n```\n```")]
CHUNK_TEXTS = [(-1, "one\n\ntwo\n\n\nthree"), (-2, "x" * 5000), (-3, ("word  " * 700).strip()), (-4, ""), (-5, " \n "), (-6, "\n\n".join("para %d " % i + "y" * 300 for i in range(12))), (-7, "a " * 1500 + "\n\n" + "b" * 100)]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return quality.normalised(read(spark, d, "documents"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return quality.scored(_docs(spark, d))


def _kept(spark: SparkSession, d: str) -> DataFrame:
    return quality.gate(_scored(spark, d)).where("kept")


@plans.add(f"WITH {documents_cte()} SELECT doc_id, chars, md5(text) AS text_md5 FROM d UNION ALL SELECT -i, length({clean('x')}), md5({clean('x')}) FROM {values(CLEANING, 'i, x')}")
def f1_clean(spark: SparkSession, d: str) -> DataFrame:
    made = spark.createDataFrame(CLEANING, "i long, x string").select((-F.col("i")).alias("doc_id"), text.clean(F.col("x")).alias("text"))
    return _docs(spark, d).select("doc_id", "text").unionByName(made).select("doc_id", F.length("text").cast("long").alias("chars"), F.md5("text").alias("text_md5"))


@plans.add(f"WITH {documents_cte()} SELECT doc_id, key FROM d")
def f2_document_key(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", "key")


@plans.add(f"WITH {documents_cte()} SELECT doc_id, chars FROM d WHERE chars >= 1000")
def f3_long_enough(spark: SparkSession, d: str) -> DataFrame:
    return quality.long_enough(_docs(spark, d), 1000).select("doc_id", F.col("chars").cast("long"))


@plans.add(f"WITH {documents_cte()} SELECT min(doc_id) AS doc_id, key FROM d GROUP BY key")
def f4_first_by_key(spark: SparkSession, d: str) -> DataFrame:
    return quality.first_by_key(_docs(spark, d)).select("doc_id", "key")


@plans.add(f"SELECT p AS path, len(list_filter(regexp_split_to_array(lower(p), '[/\\\\]'), lambda x: list_contains({quote(fixed.PERSONAL_FOLDERS)}, x))) > 0 AS personal FROM (SELECT DISTINCT p FROM (SELECT url AS p FROM documents WHERE url IS NOT NULL UNION ALL SELECT p FROM {values([(p,) for p in PATHS], 'p')}))")
def f5_personal_folder(spark: SparkSession, d: str) -> DataFrame:
    paths = read(spark, d, "documents").where("url is not null").select(F.col("url").alias("path")).unionByName(spark.createDataFrame([(p,) for p in PATHS], "path string")).distinct()
    return paths.select("path", rules.in_personal_folder(F.col("path")).alias("personal"))


_INTERNAL = f"NOT list_contains({quote(fixed.ALWAYS_EXTERNAL)}, lower(source)) AND {any_in('lower(title)', fixed.INTERNAL_TITLES)}"


@plans.add(f"SELECT source, title, {_INTERNAL} AS internal FROM (SELECT coalesce(source, '') AS source, coalesce(title, '') AS title FROM documents UNION ALL SELECT source, title FROM {values(TITLES, 'source, title')})")
def f6_internal(spark: SparkSession, d: str) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = read(spark, d, "documents").select(blank("source"), blank("title")).unionByName(spark.createDataFrame(TITLES, "source string, title string"))
    return rows.select("source", "title", rules.is_internal(F.col("title"), F.col("source")).alias("internal"))


_PERSONAL_SQL = f"CASE WHEN regexp_matches(title, {quote('(?i)' + fixed.PERSONAL_TITLE)}) THEN 'personal document title: ''' || title || '''' WHEN regexp_extract(body, {quote(PERSONAL_BODY)}) <> '' THEN 'personal document pattern: ''' || replace(substr(regexp_extract(body, {quote(PERSONAL_BODY)}), 1, 60), chr(10), ' ') || '''' ELSE '' END"


@plans.add(f"SELECT i AS doc_id, {_PERSONAL_SQL} AS reason FROM (SELECT doc_id AS i, coalesce(title, '') AS title, coalesce(text, '') AS body FROM documents UNION ALL SELECT -i, title, body FROM {values(PERSONAL, 'i, title, body')})")
def f7_personal(spark: SparkSession, d: str) -> DataFrame:
    made = spark.createDataFrame(PERSONAL, "i long, title string, text string").select((-F.col("i")).alias("doc_id"), "title", "text")
    rows = read(spark, d, "documents").select("doc_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text")).unionByName(made)
    return rows.select("doc_id", rules.personal_reason(F.col("text"), F.col("title")).alias("reason"))


def _script_sql() -> str:
    total = "greatest(length(x), 1)"
    part = lambda r: f"(length(regexp_replace(x, '[^{r}]', '', 'g')) / {total})"
    made = [(n, part(rf"\x{{{a}}}-\x{{{b}}}")) for n, a, b in fixed.SCRIPTS]
    top = "greatest(" + ", ".join(p for _, p in made) + ")"
    name = "CASE " + " ".join(f"WHEN {p} = {top} THEN '{n}'" for n, p in made) + " END"
    other = f"({top} > 0.20 AND {top} > {part('a-zA-Z')} * 0.5)"
    return f"SELECT i AS doc_id, CASE WHEN {other} THEN {name} ELSE 'latin' END AS script, round(CASE WHEN {other} THEN {top} ELSE {part('a-zA-Z')} END, 6) AS fraction FROM (SELECT doc_id AS i, coalesce(text, '') AS x FROM documents UNION ALL SELECT -i, x FROM {values(SCRIPT_TEXTS, 'i, x')})"


def _scripts(spark: SparkSession, d: str) -> DataFrame:
    made = spark.createDataFrame(SCRIPT_TEXTS, "i long, text string").select((-F.col("i")).alias("doc_id"), "text")
    return read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).unionByName(made).select("doc_id", rules.script(F.col("text")).alias("s"))


@plans.add(_script_sql())
def f8_script(spark: SparkSession, d: str) -> DataFrame:
    return _scripts(spark, d).select("doc_id", "s.script", F.round("s.fraction", 6).alias("fraction"))


@plans.add(f"SELECT doc_id, CASE WHEN script <> 'latin' THEN CAST(CAST(floor(fraction * 100) AS BIGINT) AS VARCHAR) || '% ' || script || ' script — likely not research content' ELSE '' END AS reason FROM ({_script_sql()})")
def f9_language_reason(spark: SparkSession, d: str) -> DataFrame:
    return _scripts(spark, d).select("doc_id", rules.script_reason(F.col("s")).alias("reason"))


@plans.add(f"WITH {documents_cte()}, {scored_cte()} SELECT doc_id, round(score, 6) AS score, reason FROM s")
def f10_quality_score(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("doc_id", F.round("score", 6).alias("score"), "reason")


@plans.add(f"WITH {documents_cte()}, {scored_cte()} SELECT doc_id, (score >= 0.25 AND reason = '') AS kept FROM s")
def f11_quality_gate(spark: SparkSession, d: str) -> DataFrame:
    return quality.gate(_scored(spark, d)).select("doc_id", "kept")


@plans.add("SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[.!?]+')) AS sentences FROM documents")
def f12_sentences(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.sentence_count(F.coalesce("text", F.lit(""))).cast("long").alias("sentences"))


@plans.add(f"SELECT doc_id, len({words(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')}) AS words FROM documents")
def f13_words(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.word_count(F.coalesce("text", F.lit(""))).cast("long").alias("words"))


def _topic_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_in(f'lower({x})', w)} THEN '{n}'" for n, w in fixed.TOPIC_RULES) + " ELSE 'code' END"


@plans.add(f"SELECT topic, {_topic_sql('topic')} AS class FROM (SELECT topic FROM runs WHERE topic IS NOT NULL UNION ALL SELECT topic FROM {values([(t,) for t in TOPICS], 'topic')})")
def f14_topic_class(spark: SparkSession, d: str) -> DataFrame:
    made = read(spark, d, "runs").select("topic").where("topic is not null").unionByName(spark.createDataFrame([(t,) for t in TOPICS], "topic string"))
    return made.select("topic", rules.topic_class(F.col("topic")).alias("class"))


_TABLE = [(n, i, f, len(s.get(f, [])), fixed.TEMPLATES.get(f, "summary.jinja2"), f in fixed.TEMPLATES) for n, fs, s in fixed.DELIVERABLES for i, f in enumerate(fs)]


@plans.add(f"SELECT t.topic, p.class, p.place, p.file, p.sections FROM (SELECT topic, {_topic_sql('topic')} AS class FROM (SELECT DISTINCT topic FROM (SELECT topic FROM runs WHERE topic IS NOT NULL UNION ALL SELECT topic FROM {values([(t,) for t in TOPICS], 'topic')}))) t JOIN (SELECT * FROM {values(_TABLE, 'class, place, file, sections, template, generated')}) p ON p.class = t.class")
def f15_deliverables(spark: SparkSession, d: str) -> DataFrame:
    made = read(spark, d, "runs").select("topic").where("topic is not null").unionByName(spark.createDataFrame([(t,) for t in TOPICS], "topic string")).distinct().withColumn("class", rules.topic_class(F.col("topic")))
    return made.join(F.broadcast(packaging.deliverables(spark)), "class").select("topic", "class", "place", "file", F.size("sections").alias("sections"))


FILES = ["SUMMARY.md", "RISKS.md", "TESTS.md", "", "KEY_TAKEAWAYS.md"]


@plans.add(f"SELECT f AS file, coalesce(element_at(MAP {{{', '.join(f'{quote(k)}: {quote(v)}' for k, v in fixed.TEMPLATES.items())}}}, f)[1], 'summary.jinja2') AS template FROM {values([(f,) for f in FILES], 'f')}".replace("element_at(", "map_extract("))
def f16_template(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(f,) for f in FILES], "file string").select("file", packaging.template(F.col("file")).alias("template"))


def _input_sql(x: str) -> str:
    head = f"substr({x}, 1, 10000)"
    counts = [(n, hits(head, ps)) for n, ps in fixed.INPUT_SIGNALS]
    most = "greatest(" + ", ".join(c for _, c in counts) + ")"
    return f"CASE WHEN {most} < 2 THEN 'text' " + " ".join(f"WHEN {c} = {most} THEN '{n}'" for n, c in counts) + " END"


@plans.add(f"SELECT i AS id, {_input_sql('x')} AS class FROM (SELECT page_id AS i, coalesce(text, '') AS x FROM web_pages UNION ALL SELECT -i, x FROM {values(INPUTS, 'i, x')})")
def f17_input_class(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "web_pages").select(F.col("page_id").alias("id"), F.coalesce("text", F.lit("")).alias("x")).unionByName(spark.createDataFrame(INPUTS, "i long, x string").select((-F.col("i")).alias("id"), "x"))
    return rows.select("id", rules.input_class(F.col("x")).alias("class"))


@plans.add(f"SELECT t.i AS id, p.class, p.place, p.file, p.generated FROM (SELECT i, CASE WHEN {_input_sql('x')} = 'text' THEN {_topic_sql('t')} ELSE {_input_sql('x')} END AS class FROM (SELECT doc_id AS i, coalesce(title, '') AS t, coalesce(text, '') AS x FROM documents UNION ALL SELECT -i, 'Survey of stores', x FROM {values(INPUTS, 'i, x')})) t JOIN (SELECT * FROM {values(_TABLE, 'class, place, file, sections, template, generated')}) p ON p.class = t.class")
def f18_input_deliverables(spark: SparkSession, d: str) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    made = spark.createDataFrame(INPUTS, "i long, x string").select((-F.col("i")).alias("id"), F.lit("Survey of stores").alias("topic"), "x")
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("id"), blank("title").alias("topic"), blank("text").alias("x")).unionByName(made)
    return packaging.package(rows, "id", "topic", "x")


@plans.add(rf"""SELECT m AS model, CASE WHEN starts_with(m, 'ollama:') THEN 'ollama' WHEN starts_with(m, 'claude') THEN 'anthropic' WHEN starts_with(m, 'gemini') THEN 'google' ELSE 'openai' END AS provider,
CASE WHEN starts_with(m, 'ollama:') THEN trim(split_part(substr(m, 8), '@', 1)) ELSE m END AS name,
CASE WHEN starts_with(m, 'ollama:') THEN CASE WHEN contains(m, '@') THEN regexp_replace(regexp_replace(m, '^[^@]*@', ''), '/+$', '') ELSE '{fixed.OLLAMA_BASE}' END END AS base FROM (SELECT DISTINCT m FROM (SELECT coalesce(model, '') AS m FROM prompts UNION ALL SELECT m FROM {values([(m,) for m in MODELS], 'm')}))""")
def f19_model_parts(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "prompts").select(F.coalesce("model", F.lit("")).alias("model")).unionByName(spark.createDataFrame([(m,) for m in MODELS], "model string")).distinct()
    return rows.select("model", rules.model_parts(F.col("model")).alias("p")).select("model", "p.provider", "p.name", "p.base")


@plans.add(f"SELECT i AS id, len(regexp_extract_all(x, '(?m)^```')) % 2 = 0 AS closed FROM (SELECT entry_id AS i, coalesce(response, '') AS x FROM prompts UNION ALL SELECT -i, x FROM {values(FENCES, 'i, x')})")
def f21_fences(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "prompts").select(F.col("entry_id").alias("id"), F.coalesce("response", F.lit("")).alias("x")).unionByName(spark.createDataFrame(FENCES, "i long, x string").select((-F.col("i")).alias("id"), "x"))
    return rows.select("id", rules.fences_closed(F.col("x")).alias("closed"))


MESSAGES = ["HTTP 429", "Quota gone", "RESOURCE_EXHAUSTED", "timeout", "rate limit", "separate"]


@plans.add(f"SELECT m AS message, {any_in('lower(m)', fixed.RATE_LIMITS)} AS limited FROM {values([(m,) for m in MESSAGES], 'm')}")
def f22_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(m,) for m in MESSAGES], "message string").select("message", rules.is_rate_limit(F.col("message")).alias("limited"))


DOMAIN_TEXTS = [(1, "We use pydantic and FastAPI with sqlite, a scraper, anthropic and a skill"), (2, "none here"), (3, "LoRA"), (4, "")]


@plans.add(f"SELECT i AS id, array_to_string(list_filter([{', '.join(f'CASE WHEN contains(lower(x), {quote(w)}) THEN {quote(n)} END' for w, n in fixed.DOMAINS)}], lambda y: y IS NOT NULL)[1:4], '|') AS domains FROM (SELECT doc_id AS i, coalesce(text, '') AS x FROM documents UNION ALL SELECT -i, x FROM {values(DOMAIN_TEXTS, 'i, x')})")
def f23_domains(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("x")).unionByName(spark.createDataFrame(DOMAIN_TEXTS, "i long, x string").select((-F.col("i")).alias("id"), "x"))
    return rows.select("id", F.array_join(rules.domains(F.col("x")), "|").alias("domains"))


@plans.add("SELECT id, CASE WHEN pass_rate IS NULL THEN '—' WHEN pass_rate >= 0.75 THEN 'green' WHEN pass_rate >= 0.5 THEN 'amber' ELSE 'red' END AS badge FROM runs")
def f24_badge(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "runs").select("id", rules.badge(F.col("pass_rate")).alias("badge"))


URLS = [(-1, "https://github.com/a/b/"), (-2, "http://www.github.com/c"), (-3, "https://x.example/y")]


@plans.add(rf"SELECT i AS id, CASE WHEN contains(u, 'github.com') THEN 'repo' ELSE 'url' END AS kind, CASE WHEN contains(u, 'github.com') THEN regexp_replace(regexp_replace(u, '^https?://(www\.)?github\.com/', ''), '/+$', '') ELSE u END AS value FROM (SELECT page_id AS i, url AS u FROM web_pages WHERE url IS NOT NULL UNION ALL SELECT i, u FROM {values(URLS, 'i, u')})")
def f25_route_url(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "web_pages").select(F.col("page_id").alias("id"), "url").where("url is not null").unionByName(spark.createDataFrame(URLS, "id long, url string"))
    return rows.select("id", services.route_url(F.col("url")).alias("r")).select("id", "r.kind", "r.value")


@plans.add(f"SELECT doc_id, len(regexp_split_to_array({strip('text')}, '\\n\\n+')) AS paragraphs FROM (SELECT doc_id, {clean(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS text FROM documents)")
def c1_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.size(chunking.paragraphs(F.col("text"))).cast("long").alias("paragraphs"))


_CHUNK_SOURCE = f"(SELECT doc_id AS id, 'external' AS kind, {clean(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS text FROM documents UNION ALL SELECT i, 'external', x FROM {values(CHUNK_TEXTS, 'i, x')})"


def _chunk_input(spark: SparkSession, d: str) -> DataFrame:
    made = spark.createDataFrame(CHUNK_TEXTS, "doc_id long, text string")
    return _docs(spark, d).select("doc_id", "text").unionByName(made).withColumn("kind", F.lit("external"))


@plans.add(f"WITH RECURSIVE {chunks_cte(_CHUNK_SOURCE)} SELECT id AS doc_id, chunk_no, length(chunk) AS chars, md5(chunk) AS chunk_md5 FROM c")
def c4_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_documents(_chunk_input(spark, d)).select("doc_id", F.col("chunk_no").cast("long"), F.length("chunk").cast("long").alias("chars"), F.md5("chunk").alias("chunk_md5"))


@plans.add(f"WITH RECURSIVE {chunks_cte(_CHUNK_SOURCE, 512, 0)} SELECT id AS doc_id, chunk_no, length(chunk) AS chars, md5(chunk) AS chunk_md5 FROM c")
def c4_chunks_without_overlap(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_documents(_chunk_input(spark, d), 512, 0).select("doc_id", F.col("chunk_no").cast("long"), F.length("chunk").cast("long").alias("chars"), F.md5("chunk").alias("chunk_md5"))


@plans.add(f"WITH RECURSIVE {chunks_cte(_CHUNK_SOURCE)} SELECT id AS doc_id, chunk_no, n - 1 AS passage_no, md5(p) AS passage_md5 FROM (SELECT id, chunk_no, unnest(ps) AS p0, generate_subscripts(ps, 1) AS n FROM (SELECT id, chunk_no, regexp_split_to_array(chunk, '\\n\\n+') AS ps FROM c)), LATERAL (SELECT {strip('p0')} AS p) WHERE length(p) > 150")
def c5_passages(spark: SparkSession, d: str) -> DataFrame:
    rows = chunking.answerable(chunking.chunk_documents(_chunk_input(spark, d)))
    return rows.select("doc_id", F.col("chunk_no").cast("long"), F.col("passage_no").cast("long"), F.md5("passage").alias("passage_md5"))


def _window_sql(x: str, most: int) -> str:
    third = most // 3
    return f"CASE WHEN length({x}) <= {most} THEN {x} ELSE substr({x}, 1, {third}) || chr(10) || chr(10) || '{fixed.MIDDLE_MARK}' || chr(10) || chr(10) || substr({x}, CAST(floor(length({x}) / 2) AS BIGINT) - {third // 2} + 1, {third}) || chr(10) || chr(10) || '{fixed.END_MARK}' || chr(10) || chr(10) || right({x}, {third}) END"


@plans.add(f"SELECT doc_id, md5({_window_sql('x', 1200)}) AS window_md5 FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents)")
def c6_window(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.md5(text.sample_window(F.coalesce("text", F.lit("")), 1200)).alias("window_md5"))


@plans.add(f"SELECT doc_id, md5({_window_sql('x', 700)} || CASE WHEN {strip(_window_sql('t', 300))} <> '' THEN chr(10) || chr(10) || '[--- Additional context from project codebase ---]' || chr(10) || chr(10) || {_window_sql('t', 300)} ELSE '' END) AS window_md5 FROM (SELECT doc_id, coalesce(text, '') AS x, coalesce(title, '') AS t FROM documents)")
def c7_weighted_window(spark: SparkSession, d: str) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return read(spark, d, "documents").select("doc_id", F.md5(chunking.weighted_window(blank("text"), blank("title"), 1000, 0.7)).alias("window_md5"))


@plans.add("SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '\\n\\n')) AS separators, format('{:,}', length(coalesce(text, ''))) AS chars FROM documents")
def c9_corpus_statistics(spark: SparkSession, d: str) -> DataFrame:
    body = F.coalesce("text", F.lit(""))
    return read(spark, d, "documents").select("doc_id", F.regexp_count(body, F.lit("\n\n")).cast("long").alias("separators"), F.format_number(F.length(body), 0).alias("chars"))


_REPORT_CTE = f"{documents_cte()}, {scored_cte()}, kept AS (SELECT doc_id AS id, kind, text FROM s WHERE score >= 0.25 AND reason = ''), {chunks_cte('kept')}"


@plans.add(f"""WITH RECURSIVE {_REPORT_CTE} SELECT * FROM (SELECT count(*) AS total_docs, count(*) FILTER (round(score, 3) >= 0.25 AND reason = '') AS docs_passing_filter, count(*) FILTER (contains(reason, 'personal document') OR contains(reason, 'script')) AS docs_filtered_personal,
count(*) FILTER (reason = '' AND round(score, 3) < 0.25) AS docs_filtered_quality, CAST(sum(chars) AS BIGINT) AS total_chars_raw, floor(avg(round(score, 3)) * 1000 + 0.5000001) / 1000 AS avg_quality_score, count(*) FILTER (kind = 'external' AND reason = '') AS external_docs, count(*) FILTER (kind = 'internal' AND reason = '') AS internal_docs FROM s),
(SELECT count(*) AS total_chunks, count(*) FILTER (kind = 'external') AS external_chunks, count(*) FILTER (kind = 'internal') AS internal_chunks, round(count(*) FILTER (kind = 'external') / count(*), 3) AS external_fraction, CAST(sum(strlen(chunk) + 2) - 2 AS BIGINT) AS total_chars_cleaned FROM c)""")
def a1_report(spark: SparkSession, d: str) -> DataFrame:
    return quality.report(_scored(spark, d))


@plans.add(f"WITH {documents_cte()} SELECT source, count(*) AS documents FROM d GROUP BY source")
def a2_sources(spark: SparkSession, d: str) -> DataFrame:
    return quality.by_source(_docs(spark, d))


@plans.add(f"WITH {documents_cte()}, {scored_cte()} SELECT kind, count(*) FILTER (reason = '') AS documents FROM s GROUP BY kind")
def a3_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).groupBy("kind").agg(F.count_if(F.col("reason") == "").alias("documents"))


@plans.add(f"WITH RECURSIVE {_REPORT_CTE} SELECT count(*) AS chunks, round(count(*) FILTER (kind = 'external') / count(*), 3) AS external_fraction FROM c HAVING count(*) > 0 AND count(*) FILTER (kind = 'external') / count(*) < 1.01")
def a4_low_external(spark: SparkSession, d: str) -> DataFrame:
    return quality.low_external(chunking.chunk_documents(_kept(spark, d)), 1.01)


@plans.add(f"WITH {documents_cte()}, {scored_cte()} SELECT doc_id, source, words, round(score, 3) AS quality FROM s ORDER BY round(score, 3) DESC, doc_id LIMIT 20")
def o1_best_documents(spark: SparkSession, d: str) -> DataFrame:
    return quality.best(_scored(spark, d)).withColumn("words", F.col("words").cast("long"))


@plans.add(f"WITH {documents_cte()} SELECT doc_id, md5('=== ' || title || ' [' || source || '] ===' || chr(10) || text) AS block_md5 FROM d")
def k1_rendered(spark: SparkSession, d: str) -> DataFrame:
    return files.rendered(_docs(spark, d)).select("doc_id", F.md5("block").alias("block_md5"))


@plans.add(f"WITH {documents_cte()} SELECT doc_id, title, source, url, chars, key FROM d")
def k2_metadata(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).drop("text").withColumn("chars", F.col("chars").cast("long"))


@plans.add(f"WITH RECURSIVE {_REPORT_CTE} SELECT id AS doc_id, kind, chunk_no, CAST(kind = 'internal' AS INT) AS part, md5(chunk) AS chunk_md5 FROM c")
def k3_cleaned_corpus(spark: SparkSession, d: str) -> DataFrame:
    rows = chunking.cleaned_corpus(chunking.chunk_documents(_kept(spark, d)))
    return rows.select("doc_id", "kind", F.col("chunk_no").cast("long"), "part", F.md5("chunk").alias("chunk_md5"))


BLOCKS = [(1, "\n=== A title [web] ===\nbody one\n"), (2, "no header here"), (3, "  "), (4, "=== B [github] ===\n\ntwo"), (5, "=== odd [x y] ===\nz")]


@plans.add(rf"SELECT CASE WHEN h THEN regexp_extract(b, '^=== (.+?) \[(\w+)\] ===\n', 1) ELSE 'unknown' END AS title, CASE WHEN h THEN regexp_extract(b, '^=== (.+?) \[(\w+)\] ===\n', 2) ELSE 'unknown' END AS source, {strip(chr(39).join(['regexp_replace(b, ', '^=== (.+?) ' + chr(92) + '[(' + chr(92) + 'w+)' + chr(92) + '] ===' + chr(92) + 'n', ', ', '', ')']))} AS text FROM (SELECT b, regexp_matches(b, '^=== (.+?) \[(\w+)\] ===\n') AS h FROM (SELECT {strip('x')} AS b FROM {values(BLOCKS, 'i, x')})) WHERE b <> ''")
def s14_corpus_file(spark: SparkSession, d: str) -> DataFrame:
    return files.corpus(spark.createDataFrame(BLOCKS, "i long, value string"))


@plans.add(f"SELECT page_id, regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g') AS text FROM web_pages UNION ALL SELECT -i, regexp_replace(x, '<[^>]+>', ' ', 'g') FROM {values(INPUTS, 'i, x')}")
def t2_tags_to_spaces(spark: SparkSession, d: str) -> DataFrame:
    made = spark.createDataFrame(INPUTS, "i long, text string").select((-F.col("i")).alias("page_id"), "text")
    rows = read(spark, d, "web_pages").select("page_id", F.coalesce("text", F.lit("")).alias("text")).unionByName(made)
    return rows.select("page_id", text.html_tags_to_spaces(F.col("text")).alias("text"))


HTML = [(1, "http://a.example/x", "<html><head><title> A &amp; B </title><style>x{}</style></head><body><nav>menu</nav><p>One</p><p>Two &lt;3</p><script>bad()</script></body></html>"), (2, "https://b.example:80/y?z", "<p>no title</p><aside>side</aside>"), (3, "file:///x", ""), (4, "http://c.example", "<TITLE>Up\nper</TITLE>text")]


@plans.add(rf"SELECT i AS id, CASE WHEN t <> '' THEN t ELSE regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) END AS title FROM (SELECT i, u, {strip(chr(39).join(['regexp_extract(x, ', '(?is)<title[^>]*>(.*?)</title>', ', 1)']))} AS t FROM {values(HTML, 'i, u, x')})")
def t3_html_title(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(HTML, "id long, url string, html string").select("id", text.html_title(F.col("html"), F.col("url")).alias("title"))


def _html_sql(x: str) -> str:
    for tag in fixed.MEDIA_TAGS:
        x = rf"regexp_replace({x}, '(?is)<{tag}\b.*?</{tag}\s*>', '', 'g')"
    x = f"regexp_replace({x}, '<[^>]+>', chr(10), 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, {quote(entity)}, {quote(char)})"
    return strip(rf"regexp_replace({x}, '{S}*\n{S}*', chr(10), 'g')")


@plans.add(f"SELECT i AS id, {_html_sql('x')} AS text FROM {values(HTML, 'i, u, x')}")
def t1_html_text(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(HTML, "id long, url string, html string").select("id", text.html_text(F.col("html")).alias("text"))
