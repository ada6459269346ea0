"""Queries on structure found in texts, reports, run lookups and the cache chain, over whole tables, beside SQL that computes the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import fixed, rules, text
from sparkloom.operators import extraction, history, judging, packaging, questions, similarity
from sparkloom.plans.base import Plans, clean, quote, read, strip, values
from sparkloom.plans.scoring import _cache, _digit_sql, _question_sql, _sentences_sql, _vectors

plans = Plans()

BS = chr(92)
SENTENCES = ["Water is wet and cold.", "The method works well.", "We measured everything twice.", "Researchers agree on this.", "Perhaps so.", "This is new...", "A thing", "Dogs were here ", "It rained", "scientists found it"]
REPLIES = [
    (-1, "Accuracy: 4\nRelevance: 5\nCompleteness: 2\nReasoning: sound and short"), (-2, "accuracy 3 relevance: 1"), (-3, "ACCURACY: 6\nRelevance: 2"), (-4, "nothing"), (-5, "Explanation:   "), (-6, "Accuracy: 5 Relevance: 5 Completeness: 5 Reasoning: " + "r" * 600), (-7, "")
]
SECTIONS = [(-1, "## One\nbody 1\n## Two Words\nbody 2\n\nmore\n"), (-2, "intro\n## Same\na\n## Same\nb"), (-3, "no heading"), (-4, "## Deep\n### sub\ntext"), (-5, ""), (-6, "## Overview\nall\n## Key Findings\n- x\n## Summary\ns\n## Risk Register\n| a |\n## Recommended Next Action\ngo")]
CODE = [(-1, "x\n```python\n" + "print(1)\n" * 8 + "```\ny\n```\n" + "a = 1\n" * 20 + "```"), (-2, "```js\nshort\n```"), (-3, "none")]
MARKED = [(-1, "# Heading one.\n## Two\ntext **bold phrase** and **Heading one**\n### Three words here"), (-2, "**only bold** text **only bold**"), (-3, "alpha beta gamma alpha beta delta gamma alpha"), (-4, "")]


def _texts(spark: SparkSession, d: str, more: list[tuple]) -> DataFrame:
    """id, x: cleaned texts of all documents, and literals of negative ids."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), text.clean(F.coalesce("text", F.lit(""))).alias("x"))
    return docs.unionByName(spark.createDataFrame(more, "id long, x string"))


def _texts_sql(more: list[tuple]) -> str:
    return f"(SELECT doc_id AS id, {clean("coalesce(text, '')")} AS x FROM documents UNION ALL SELECT id, x FROM {values(more, 'id, x')})"


# ---- sections and reports -------------------------------------------------------------------------------------------

#: CTE ``m`` (id, h, body) of the named sections of texts and ``p`` of the same by place. A heading right under another is text of it.
_SECTIONS_SQL = rf"""q AS (SELECT id, string_split(regexp_replace(regexp_replace(x, '(##\s+[^\n]+\n)(##\s)', '\1' || chr(2) || '\2', 'g'), '\n(##\s)', chr(1) || '\1', 'g'), chr(1)) AS ss FROM {_texts_sql(SECTIONS)}),
u AS (SELECT id, unnest(ss) AS s, generate_subscripts(ss, 1) AS k FROM q),
v AS (SELECT id, k, replace(lower({strip(r"regexp_extract(s, '(?s)##\s+([^\n]+)\n(.*)', 1)")}), ' ', '_') AS h, {strip(r"replace(regexp_extract(s, '(?s)##\s+([^\n]+)\n(.*)', 2), chr(2), '')")} AS body FROM u WHERE regexp_matches(s, '##\s+[^\n]+\n')),
p AS (SELECT id, '_section_' || (row_number() OVER (PARTITION BY id ORDER BY k) - 1) AS h, body FROM v),
m AS (SELECT id, h, arg_max(body, k) AS body FROM v GROUP BY id, h)"""


@plans.add(f"WITH {_SECTIONS_SQL} SELECT id, h AS heading, body FROM m UNION ALL SELECT id, h, body FROM p")
def t10_sections(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d, SECTIONS).select("id", F.explode(extraction.sections(F.col("x"))).alias("heading", "body"))


@plans.add(f"WITH {_SECTIONS_SQL} SELECT t.id, coalesce(max(body) FILTER (h = 'two_words'), max(body) FILTER (h = 'overview'), {quote(fixed.NO_CONTENT)}) AS body, CAST(floor(count(DISTINCT h) FILTER (h IN ('one', 'overview', 'deep')) * 100 / 3) AS INTEGER) AS covered FROM {_texts_sql(SECTIONS)} t LEFT JOIN m USING (id) GROUP BY t.id")
def t11_t12_section_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = _texts(spark, d, SECTIONS).select("id", extraction.sections(F.col("x")).alias("s"))
    return rows.select("id", extraction.first_section(F.col("s"), ["Missing", "Two Words", "overview"]).alias("body"), extraction.coverage(F.col("s"), ["One", "Overview", "Deep"]).alias("covered"))


def _report_sql() -> str:
    """Every report over every text: the found sections as a map, the parts of ``fixed.REPORTS`` put together."""
    pages = []
    for file, title, slots in fixed.REPORTS:
        get = lambda names, none: "coalesce(" + ", ".join([*(f"found[{quote(n)}]" for n in names), quote(none)]) + ")"
        parts = [quote(f"# {title}: ") + " || CAST(id AS VARCHAR)", quote("**Run ID:** ") + " || CAST(id AS VARCHAR)", quote("---")]
        for heading, names in slots:
            if heading == "+extra":
                parts.append(quote("## Cost Analysis\n\n") + " || " + get(["cost_analysis"], fixed.NO_CONTENT))
            elif heading == "+files":
                parts.append(quote("## Deliverables in This Package\n\n- **SUMMARY.md**") + " || " + quote(" — this file" if file == "SUMMARY.md" else "") + " || " + quote("\n- **RISKS.md**" + (" — this file" if file == "RISKS.md" else "")))
            elif heading[0] == "?":
                parts.append(f"CASE WHEN {get(names, '')} <> '' THEN {quote(f'## {heading[1:]}' + chr(10) * 2)} || {get(names, '')} END")
            else:
                parts.append(quote(f"## {heading}\n\n") + " || " + get(names, fixed.NO_CONTENT))
        pages.append(f"SELECT id, {quote(file)} AS file, md5(concat_ws({quote(chr(10) * 2)}, {', '.join(parts)}, {quote('---' + chr(10))})) AS page_md5 FROM f")
    return " UNION ALL ".join(pages)


@plans.add(f"WITH {_SECTIONS_SQL}, a AS (SELECT * FROM m UNION ALL SELECT * FROM p), f AS (SELECT t.id, coalesce(any_value(found), MAP {{}}) AS found FROM {_texts_sql(SECTIONS)} t LEFT JOIN (SELECT id, map_from_entries(list((h, body))) AS found FROM a GROUP BY id) USING (id) GROUP BY t.id) {_report_sql()}")
def t25_reports(spark: SparkSession, d: str) -> DataFrame:
    """All eleven reports of every text."""
    rows = _texts(spark, d, SECTIONS).select("id", extraction.sections(F.col("x")).alias("found"))
    key = F.col("id").cast("string")
    pages = [F.struct(F.lit(f).alias("file"), packaging.report(f, key, F.col("found"), [("Run ID", key)], ["Cost Analysis"], F.array(F.lit("SUMMARY.md"), F.lit("RISKS.md"))).alias("page")) for f, _, _ in fixed.REPORTS]
    return rows.select("id", F.explode(F.array(*pages)).alias("p")).select("id", "p.file", F.md5("p.page").alias("page_md5"))


@plans.add(f"SELECT '# ' || coalesce(topic, '') || chr(10) || chr(10) || '## Topic' || chr(10) || coalesce(topic, '') || chr(10) || chr(10) || '## Objective' || chr(10) || coalesce(notes, '') || chr(10) || chr(10) || '## Goals' || chr(10) || '- ' || coalesce(status, '') || chr(10) || '- ' || coalesce(judge_model, '') || chr(10) || chr(10) || '## Steps' || chr(10) || '1. ' || coalesce(results_path, '') || chr(10) || '2. ' || coalesce(eval_path, '') || chr(10) AS program, id FROM runs")
def k9_program(spark: SparkSession, d: str) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    made = packaging.program(blank("topic"), blank("topic"), blank("notes"), F.array(blank("status"), blank("judge_model")), F.array(blank("results_path"), blank("eval_path")))
    return read(spark, d, "runs").select("id", made.alias("program"))


@plans.add(rf"""SELECT doc_id, regexp_replace('# P' || chr(10) || '## Topic' || chr(10) || coalesce(title, '') || chr(10) || coalesce(text, ''), '(## Topic\s*\n)([^\n]+)', '\1new $1 topic', 'g') AS program FROM documents""")
def t27_replace_topic(spark: SparkSession, d: str) -> DataFrame:
    program = F.concat(F.lit("# P\n## Topic\n"), F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    return read(spark, d, "documents").select("doc_id", extraction.replace_topic(program, "new $1 topic").alias("program"))


# ---- extraction -----------------------------------------------------------------------------------------------------

_WORDS_SQL = r"regexp_extract_all(regexp_replace(lower({x}), '[^\x00-\x7F]', '_', 'g'), '\b[a-z]{{4,}}\b')"
_PAIRS_SQL = r"""SELECT id, place, pair FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, pos) AS place FROM (SELECT id, pair, count(*) AS n, min(i) AS pos FROM
(SELECT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pair, unnest(range(1, len(w))) AS i FROM (SELECT id, {words} AS w FROM {source})) GROUP BY id, pair)) WHERE place <= {most}"""


def _ascii(df: DataFrame) -> DataFrame:
    """Letters beyond ASCII as a sign that both engines count as part of a word."""
    return df.withColumn("x", F.regexp_replace("x", r"[^\x00-\x7F]", "_"))


_CONCEPTS_SQL = rf"""t AS (SELECT id, regexp_replace(x, '[^\x00-\x7F]', '_', 'g') AS x FROM {_texts_sql(MARKED)}),
h AS (SELECT id, x, list_filter(list_transform(regexp_extract_all(x, '(?m)^#{{1,3}}[ \t]+(.+)$', 1), lambda c: regexp_replace({strip('c')}, '\.+$', '')), lambda c: length(c) > 4 AND length(c) < 80) AS heads, list_transform(regexp_extract_all(x, '\*\*([^*]{{4,60}})\*\*', 1), lambda c: {strip('c')}) AS bold FROM t),
c AS (SELECT id, x, list_concat(heads, list_filter(bold, lambda b, i: list_position(bold, b) = i AND NOT list_contains(heads, b)))[1:8] AS cs FROM h)"""


@plans.add(f"WITH {_CONCEPTS_SQL} SELECT id, unnest(cs) AS concept, generate_subscripts(cs, 1) AS place FROM c UNION ALL SELECT id, pair, place FROM ({_PAIRS_SQL.format(words=_WORDS_SQL.format(x='x'), source='(SELECT id, x FROM c WHERE len(cs) = 0)', most=8)})")
def t9_concepts(spark: SparkSession, d: str) -> DataFrame:
    return extraction.key_concepts(_ascii(_texts(spark, d, MARKED)), "id", "x").select("id", "concept", F.col("place").cast("long"))


PROGRAMS = [(-1, "# My topic\nrest"), (-2, "intro\nTopic: second one \nx"), (-3, "nothing"), (-4, "#tight"), (-5, "")]
_NAMED = f"nullif({strip('regexp_extract(x, ' + quote('(?im)^(?:#[ ' + BS + 't]*|topic:[ ' + BS + 't]*)(.+)$') + ', 1)')}, '')"


@plans.add(f"WITH t AS (SELECT id, regexp_replace(x, '[^{BS}x00-{BS}x7F]', '_', 'g') AS x FROM {_texts_sql(PROGRAMS)}) SELECT id, coalesce({_NAMED}, ps, 'research findings') AS topic FROM t LEFT JOIN (SELECT id, string_agg(pair, ', ' ORDER BY place) AS ps FROM ({_PAIRS_SQL.format(words=_WORDS_SQL.format(x='x'), source='t', most=3)}) GROUP BY id) USING (id)")
def c8_detect_topic(spark: SparkSession, d: str) -> DataFrame:
    """Every text is taken for a program; those that name no topic get the pairs of their own words."""
    return extraction.topics(_ascii(_texts(spark, d, PROGRAMS)).withColumn("program", F.col("x")), "id", "program", "x")


@plans.add(f"SELECT id, n - 1 AS place, b[n].l AS language, b[n].c AS code FROM (SELECT id, b, unnest(range(1, least(len(b), 6) + 1)) AS n FROM (SELECT id, list_sort(list_filter(list_transform(range(1, len(c) + 1), lambda k: {{'m': -length({strip('c[k]')}), 'k': k, 'l': CASE WHEN l[k] = '' THEN 'python' ELSE l[k] END, 'c': {strip('c[k]')}}}), lambda s: s.m < -40)) AS b FROM (SELECT id, regexp_extract_all(x, '(?s)```({BS}w*){BS}n(.*?)```', 1) AS l, regexp_extract_all(x, '(?s)```({BS}w*){BS}n(.*?)```', 2) AS c FROM {_texts_sql(CODE)})))")
def t8_code_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = _texts(spark, d, CODE).select("id", F.posexplode(extraction.code_blocks(F.col("x"))).alias("place", "b"))
    return rows.select("id", F.col("place").cast("long"), "b.language", "b.code")


_FENCED = "result_id % 2 = 0 AND NOT contains(coalesce(question, ''), '```') AND NOT contains(coalesce(reference_answer, ''), '```')"


@plans.add("SELECT result_id, CASE WHEN reference_answer IS NOT NULL THEN question END AS a, CASE WHEN question IS NOT NULL THEN reference_answer END AS b FROM sample_results")
def t13_json(spark: SparkSession, d: str) -> DataFrame:
    """Pairs written as JSON into prose, in fences or bare, come back whole; a missing key gives nothing."""
    made = F.to_json(F.struct(F.col("question").alias("a"), F.col("reference_answer").alias("b")))
    reply = F.when(F.expr(_FENCED), F.concat(F.lit("Here it is:\n```json\n"), made, F.lit("\n```\nDone."))).otherwise(F.concat(F.lit("Well: "), made))
    rows = read(spark, d, "sample_results").select("result_id", extraction.json_object(reply, ["a", "b"]).alias("m"))
    return rows.select("result_id", F.try_element_at("m", F.lit("a")).alias("a"), F.try_element_at("m", F.lit("b")).alias("b"))


@plans.add(f"SELECT s AS sentence, {_question_sql('s')} AS question FROM (SELECT DISTINCT s FROM (SELECT unnest({_sentences_sql('coalesce(text, ' + quote('') + ')')}) AS s FROM documents UNION ALL SELECT s FROM {values([(s,) for s in SENTENCES], 's')}))")
def t6_question(spark: SparkSession, d: str) -> DataFrame:
    found = read(spark, d, "documents").select(F.explode(text.sentences(F.coalesce("text", F.lit("")))).alias("sentence"))
    rows = found.unionByName(spark.createDataFrame([(s,) for s in SENTENCES], "sentence string")).distinct()
    return rows.select("sentence", questions.to_question(F.col("sentence")).alias("question"))


@plans.add(rf"""SELECT id, {_digit_sql('accuracy')} AS accuracy, {_digit_sql('relevance')} AS relevance, {_digit_sql('completeness')} AS completeness,
CASE WHEN r = '' THEN '(judge provided no explanation — raw: ' || substr(x, 1, 200) || ')' ELSE r END AS reasoning, round({_digit_sql('accuracy')} * 0.4 + {_digit_sql('relevance')} * 0.35 + {_digit_sql('completeness')} * 0.25, 2) AS overall
FROM (SELECT id, x, CASE WHEN regexp_matches(x, '(?i)(reasoning|explanation)') THEN substr({strip(f"regexp_extract(x, '(?is)(?:reasoning|explanation)[:{BS}s]*(.*)', 1)")}, 1, 500) ELSE substr(x, 1, 300) END AS r FROM (SELECT entry_id AS id, coalesce(response, '') AS x FROM prompts UNION ALL SELECT id, x FROM {values(REPLIES, 'id, x')}))""")
def t14_judge_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "prompts").select(F.col("entry_id").alias("id"), F.coalesce("response", F.lit("")).alias("x")).unionByName(spark.createDataFrame(REPLIES, "id long, x string"))
    return rows.select("id", judging.judge_scores(F.col("x")).alias("s")).select("id", "s.*")


@plans.add(f"""SELECT result_id, 0 AS pair_no, {strip('question')} AS question, {strip("CASE WHEN o = '' THEN h WHEN h = '' THEN o ELSE o || '. ' || h END")} AS answer
FROM (SELECT result_id, question, CASE WHEN passed IS NULL THEN '' WHEN passed THEN coalesce(model_answer, '') ELSE coalesce(reference_answer, '') END AS o, coalesce(reasoning, '') AS h FROM sample_results) WHERE {strip("coalesce(question, '')")} <> '' AND {strip('o || h')} <> ''""")
def q4_quiz(spark: SparkSession, d: str) -> DataFrame:
    """Every sample as a quiz of one question, two options and a hint."""
    option = lambda c, right: F.struct(F.col(c).alias("text"), right.alias("isCorrect"))
    options = F.array(option("model_answer", F.col("passed")), option("reference_answer", ~F.col("passed")))
    quiz = F.to_json(F.struct(F.array(F.struct("question", options.alias("answerOptions"), F.col("reasoning").alias("hint"))).alias("questions")))
    return questions.quiz_pairs(read(spark, d, "sample_results").select("result_id", quiz.alias("quiz")), ["result_id"], "quiz")


_CHUNKS_SQL = rf"SELECT row_number() OVER (ORDER BY doc_id, k) - 1 AS n, doc_id * 100000 + k AS place, c AS chunk FROM (SELECT doc_id, generate_subscripts(cs, 1) AS k, {strip('unnest(cs)')} AS c FROM (SELECT doc_id, regexp_split_to_array(text, '\n\n+') AS cs FROM documents WHERE text IS NOT NULL)) WHERE length(c) > 150"


@plans.add(f"""WITH ch AS (SELECT place, chunk FROM ({_CHUNKS_SQL})), w AS (SELECT result_id, unnest(list_distinct(list_filter(regexp_split_to_array({strip("coalesce(question, '')")}, '\\s+'), lambda x: x <> '')[1:5])) AS w FROM sample_results WHERE result_id % 100 = 0),
f AS (SELECT w, min(place) AS place FROM (SELECT DISTINCT w FROM w) JOIN ch ON contains(chunk, w) GROUP BY w),
b AS (SELECT s.result_id, coalesce(min(f.place), (SELECT min(place) FROM ch)) AS place FROM (SELECT result_id FROM sample_results WHERE result_id % 100 = 0) s LEFT JOIN w USING (result_id) LEFT JOIN f USING (w) GROUP BY s.result_id)
SELECT result_id, place, md5(coalesce(chunk, '')) AS chunk_md5 FROM b LEFT JOIN ch USING (place)""")
def j9_context(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: questions whose id is divisible by 100, against the chunks of all documents."""
    cut = read(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", r"\n\n+")).alias("k", "c"))
    chunks = cut.select((F.col("doc_id") * 100_000 + F.col("k") + 1).alias("place"), text.strip(F.col("c")).alias("chunk")).where(F.length("chunk") > 150)
    found = questions.contexts(read(spark, d, "sample_results").where("result_id % 100 = 0"), "result_id", F.col("question"), chunks)
    return found.select("result_id", "place", F.md5("chunk").alias("chunk_md5"))


# ---- lookups --------------------------------------------------------------------------------------------------------


def _cosines(a: str, b: str, where: str = "TRUE") -> str:
    """Pairs (qk, ek, sim); the dot product is a whole number, so that no order of summation matters."""
    return f"SELECT a.k AS qk, b.k AS ek, sum(a.n * b.n) / (any_value(a.norm) * any_value(b.norm)) AS sim FROM {a} a JOIN {b} b ON a.t = b.t AND {where} GROUP BY a.k, b.k"


@plans.add(f"SELECT CAST(ek AS BIGINT) AS entry_id, CAST(qk AS BIGINT) AS query_id, round(sim, 3) AS similarity FROM ({_cosines(_vectors('benchmark WHERE item_id % 100 = 0', 'item_id', 'text'), _vectors('sample_results WHERE question IS NOT NULL', 'result_id', 'question'))}) WHERE sim >= 0.2")
def j4_find_similar(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: items whose id is divisible by 100, against all questions."""
    items = read(spark, d, "benchmark").where("item_id % 100 = 0")
    found = similarity.similar(items, read(spark, d, "sample_results").where("question is not null"), 0.2, ("item_id", "text"), ("result_id", "question"))
    return found.select("query_id", "entry_id", F.round("similarity", 3).alias("similarity"))


_NOW = "(SELECT max(started_at) FROM runs)"


@plans.add(f"SELECT CAST(qk AS BIGINT) AS query_id, CAST(ek AS BIGINT) AS entry_id, round(sim, 3) AS similarity FROM ({_cosines(_vectors('benchmark WHERE item_id % 100 = 0', 'item_id', 'text'), _vectors(f'runs WHERE lower(trim(status)) = {quote("completed")} AND started_at >= {_NOW} - INTERVAL 200 DAY', 'id', 'topic'))}) WHERE sim >= 0.05")
def j4_similar_runs(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: items whose id is divisible by 100, against the completed runs of the last 200 days."""
    runs = read(spark, d, "runs")
    now = runs.agg(F.max("started_at")).first()[0]
    return similarity.similar_runs(read(spark, d, "benchmark").where("item_id % 100 = 0"), runs, ("item_id", "text"), 0.05, age="200 days", now=F.lit(now))


_PROMPTS = lambda where: f"(SELECT v.*, p.model FROM {_vectors(f'prompts WHERE length(prompt) <= {fixed.FUZZY_PROMPT_LIMIT} AND {where}', 'entry_id', 'prompt')} v JOIN prompts p ON p.entry_id = v.k)"
_FUZZY = _cosines(_PROMPTS("entry_id % 100 = 0"), _PROMPTS("TRUE"), "a.model = b.model AND a.k <> b.k")


@plans.add(f"SELECT qk AS query_id, ek AS entry_id, round(sim, 3) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY qk ORDER BY sim DESC, ek) AS r FROM ({_FUZZY}) WHERE sim >= 0.5) WHERE r = 1")
def j6_fuzzy_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: entries whose id is divisible by 100, each against all other entries of its model."""
    rows = read(spark, d, "prompts").where(F.length("prompt") <= fixed.FUZZY_PROMPT_LIMIT).select("entry_id", "model", "prompt")
    found = similarity.similar(rows.where("entry_id % 100 = 0"), rows, 0.5, ("entry_id", "prompt"), ("entry_id", "prompt"), ["model"]).where("query_id <> entry_id")
    return similarity.best_match(found, rows.select("entry_id", F.col("entry_id").alias("place")))


_REST = "entry_id % 100 <> 0 AND cached_at >= (SELECT max(cached_at) FROM prompts) - INTERVAL 9000 HOUR"
_NEAR = _cosines(_PROMPTS("entry_id % 100 = 0"), f"(SELECT v.*, p.model FROM {_vectors(f'prompts WHERE {_REST}', 'entry_id', 'prompt')} v JOIN prompts p ON p.entry_id = v.k)", "a.model = b.model")


@plans.add(f"""WITH c AS (SELECT hash, model, max(entry_id) AS entry_id FROM prompts WHERE {_REST} GROUP BY hash, model), q AS (SELECT * FROM prompts WHERE entry_id % 100 = 0),
x AS (SELECT q.entry_id AS query_id, c.entry_id FROM q JOIN c ON q.hash = c.hash AND q.model = c.model),
n AS (SELECT qk AS query_id, ek AS entry_id FROM (SELECT *, row_number() OVER (PARTITION BY qk ORDER BY sim DESC, ek) AS r FROM ({_NEAR}) WHERE sim >= {fixed.FUZZY_THRESHOLD} AND qk NOT IN (SELECT query_id FROM x)) WHERE r = 1),
a AS (SELECT query_id, 'exact' AS how, entry_id FROM x UNION ALL SELECT query_id, 'fuzzy', entry_id FROM n UNION ALL SELECT entry_id, 'computed', NULL FROM q WHERE entry_id NOT IN (SELECT query_id FROM x UNION ALL SELECT query_id FROM n))
SELECT query_id, how, a.entry_id, CASE how WHEN 'computed' THEN 'made' ELSE response END AS response FROM a LEFT JOIN prompts p ON p.entry_id = a.entry_id""")
def j7_cache_chain(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: entries whose id is divisible by 100 are asked again, of the other ones of the last 9,000 hours."""
    rows = read(spark, d, "prompts")
    now = rows.agg(F.max("cached_at")).first()[0]
    asked = rows.where("entry_id % 100 = 0").select(F.col("entry_id").alias("query_id"), "hash", "model", "prompt")
    return similarity.cached(asked, rows.where("entry_id % 100 <> 0"), lambda rest: rest.select("query_id", F.lit("made").alias("response")), age="9000 hours", now=F.lit(now))


@plans.add("""WITH c AS (SELECT run_id, count(*) AS iterations, avg(CAST(passed AS INT)) AS pass_rate, CASE WHEN run_id % 3 = 0 THEN 'failed' END AS status FROM sample_results GROUP BY run_id)
SELECT id, CASE WHEN c.run_id IS NULL THEN r.status ELSE coalesce(c.status, 'completed') END AS status, CASE WHEN c.run_id IS NULL THEN r.iterations ELSE c.iterations END AS iterations, round(CASE WHEN c.run_id IS NULL THEN r.pass_rate ELSE c.pass_rate END, 6) AS pass_rate,
CASE WHEN c.run_id IS NULL THEN r.avg_score END AS avg_score, CASE WHEN c.run_id IS NULL THEN r.notes ELSE '' END AS notes, r.topic FROM runs r LEFT JOIN c ON c.run_id = r.id AND r.id % 5 <> 0""")
def m2_finish(spark: SparkSession, d: str) -> DataFrame:
    """Runs end with what their samples say; what is not said falls back to the defaults of a finished run."""
    said = read(spark, d, "sample_results").groupBy("run_id").agg(F.count(F.lit(1)).alias("iterations"), F.avg(F.col("passed").cast("int")).alias("pass_rate")).where("run_id % 5 <> 0")
    changes = said.withColumn("status", F.when(F.col("run_id") % 3 == 0, "failed")).withColumnRenamed("run_id", "id")
    done = history.finish(read(spark, d, "runs"), changes)
    return done.select("id", "status", "iterations", F.round("pass_rate", 6).alias("pass_rate"), "avg_score", "notes", "topic")


# ---- slugs, prints, prompts, badges ---------------------------------------------------------------------------------


@plans.add("SELECT id, regexp_replace(regexp_replace(lower(t), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS function_name, substr(replace(lower(t), ' ', '-'), 1, 40) AS program_name, substr(regexp_replace(regexp_replace(lower(t), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40) || '-' || strftime(CAST(started_at AT TIME ZONE 'UTC' AS TIMESTAMP), '%Y%m%d-%H%M%S') AS run_name FROM (SELECT id, coalesce(topic, '') AS t, started_at FROM runs)")
def t16_names(spark: SparkSession, d: str) -> DataFrame:
    t = F.coalesce("topic", F.lit(""))
    return read(spark, d, "runs").select("id", text.function_slug(t).alias("function_name"), text.program_slug(t).alias("program_name"), packaging.run_name(t, F.col("started_at")).alias("run_name"))


@plans.add("SELECT doc_id, substr(sha1(coalesce(url, '')), 1, 16) AS url_key, substr(sha1(coalesce(text, '')), 1, 16) AS content_key, CAST(epoch_us(collected_at) * 1000 AS VARCHAR) || ':' || CAST(n_chars AS VARCHAR) AS stamp FROM documents")
def t17_prints(spark: SparkSession, d: str) -> DataFrame:
    """The url, the text as a file of bytes (all are under 512 KiB), time and size of every document."""
    url = F.coalesce("url", F.lit(""))
    return read(spark, d, "documents").select("doc_id", F.substring(F.sha1(url), 1, 16).alias("url_key"), text.content_hash(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("content_key"), text.file_stamp(F.col("collected_at"), F.col("n_chars")).alias("stamp"))


@plans.add("SELECT doc_id, md5('Evaluation question: ' || title || chr(10) || chr(10) || '--- Document to evaluate ---' || chr(10) || substr(text, 1, 8000) || chr(10) || '--- End of document ---') AS criterion_md5 FROM documents")
def t24_criterion_prompt(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.md5(text.criterion_prompt(F.col("title"), F.col("text"))).alias("criterion_md5"))


@plans.add("SELECT id, CASE WHEN avg_score IS NULL THEN '—' ELSE CASE WHEN avg_score >= 0.75 THEN '🟢' WHEN avg_score >= 0.5 THEN '🟡' ELSE '🔴' END || ' ' || printf('%.3f', avg_score) END AS score, CASE status WHEN 'completed' THEN '✅' WHEN 'running' THEN '⏳' WHEN 'failed' THEN '❌' ELSE status END AS state FROM runs")
def f24_badges(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "runs").select("id", rules.score_badge(F.col("avg_score")).alias("score"), rules.status_badge(F.col("status")).alias("state"))


_STUB_SQL = ", ".join(f"CASE WHEN contains(lower(x), {quote(w)}) THEN {quote(f'### {label}' + chr(10) * 2 + '```python' + chr(10) + f'# Pattern: {label}' + chr(10) + fixed.STUBS[w] + chr(10) * 2 + 'def ' + ''.join(c if c.isalnum() else '_' for c in label.lower()) + '():' + chr(10) + '    raise NotImplementedError' + chr(10) + '```')} END" for w, label in fixed.DOMAINS)
_CODE_SQL = f"list_sort(list_filter(list_transform(range(1, len(cc) + 1), lambda k: {{'m': -length({strip('cc[k]')}), 'k': k, 'l': CASE WHEN ll[k] = '' THEN 'python' ELSE ll[k] END, 'c': {strip('cc[k]')}}}), lambda s: s.m < -40))[1:6]"


@plans.add(rf"""WITH {_CONCEPTS_SQL}, e AS (SELECT id, x, cs, regexp_extract_all(x, '(?s)```(\w*)
(.*?)```', 1) AS ll, regexp_extract_all(x, '(?s)```(\w*)
(.*?)```', 2) AS cc FROM c),
g AS (SELECT id, cs, {_CODE_SQL} AS bs, list_filter([{_STUB_SQL}], lambda s: s IS NOT NULL)[1:4] AS st FROM e)
SELECT id, md5(concat_ws(chr(10) || chr(10), '# Code Suggestions (heuristic): ' || id, CASE WHEN len(cs) > 0 THEN '## Key Concepts' || chr(10) || chr(10) || array_to_string(list_transform(cs, lambda k, i: i || '. ' || k), chr(10)) END,
'## Code' || chr(10) || chr(10) || CASE WHEN len(bs) = 0 THEN '_No fenced code blocks found._' ELSE array_to_string(list_transform(bs, lambda b, i: '### Example ' || i || chr(10) || chr(10) || '```' || b.l || chr(10) || b.c || chr(10) || '```'), chr(10) || chr(10)) END,
CASE WHEN len(st) > 0 THEN '## Stubs for Detected Patterns' || chr(10) || chr(10) || array_to_string(st, chr(10) || chr(10)) END)) AS report_md5 FROM g""")
def t26_suggestions(spark: SparkSession, d: str) -> DataFrame:
    rows = _ascii(_texts(spark, d, MARKED))
    return rows.select("id", F.md5(packaging.suggestions(F.col("id").cast("string"), F.col("x"))).alias("report_md5"))
