"""Queries on questions, answers, judgements, similarity, run history, caches and incremental state."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import fixed, text
from sparkloom.operators import extraction, history, incremental, judging, packaging, quality, questions, similarity
from sparkloom.plans.base import Plans, S, quote, read, strip, tokens, values, words
from sparkloom.streaming import collect

plans = Plans()

BS = chr(92)
SINGLE = [(1, "Score: 4\nReasoning: fine"), (2, "score: 2"), (3, "no number"), (4, "Score: 9"), (5, "Score: 1 Reasoning:   x  ")]
PARSED = [(1, "Q: What is it?\nA: A thing.\nMore."), (2, "Question: Why\nAnswer: Because"), (3, "first line\nsecond line\nthird"), (4, "single"), (5, ""), (6, "q: low?\nno reply here")]
LOSSES = [0.0, 5.0, 10.0, 100.0, 1.23456, None]
SLUGS = ["Multi-tenant RAG: a Survey!", "  --x--  ", "", "Ünïcode & more", "y" * 60]
STATE_LOG = [("k1", "h1", 1), ("k2", "h2", 2), ("k1", "h3", 3), ("k3", "h1", 4), (None, "h9", 5)]

_BLANK = lambda c: F.coalesce(F.col(c), F.lit(""))


def _lit(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _results(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "sample_results")


# ---- questions ------------------------------------------------------------------------------------------------------


def _sentences_sql(x: str) -> str:
    marked = rf"regexp_replace({strip(x)}, '([.!?]){S}+', '\1' || chr(1), 'g')"
    return f"list_filter(string_split({marked}, chr(1)), lambda s: length(s) > 40)"


def _question_sql(x: str) -> str:
    s = rf"regexp_replace({strip(x)}, '\.+$', '')"
    first = rf"regexp_extract(lower({s}), '^(\S+)', 1)"
    return rf"""CASE WHEN regexp_matches({s}, '^[A-Z][a-z]+ (is|are|was|were) ') THEN 'What ' || regexp_replace({s}, '^\S+ ', '') || '?'
WHEN {first} IN ('the', 'a', 'an', 'this', 'these', 'it') THEN 'What is ' || lower({s}) || '?'
WHEN {first} IN ('we', 'researchers', 'scientists') THEN 'How did ' || {strip(f'substr(lower({s}), length({first}) + 1)')} || '?'
ELSE 'What do we know about: ' || {s} || '?' END"""


@plans.add(f"SELECT doc_id, len({_sentences_sql('coalesce(text, ' + quote('') + ')')}) AS sentences FROM documents")
def t4_sentences(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.size(text.sentences(_BLANK("text"))).cast("long").alias("sentences"))


@plans.add(f"SELECT doc_id, n - 1 AS pair_no, md5({_question_sql('ss[n]')}) AS question_md5, md5(array_to_string(ss[n:n + 2], ' ')) AS answer_md5 FROM (SELECT doc_id, ss, unnest(range(1, least(len(ss), 5) + 1)) AS n FROM (SELECT doc_id, {_sentences_sql('coalesce(text, ' + quote('') + ')')} AS ss FROM documents))")
def q1_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = questions.pairs(read(spark, d, "documents").select("doc_id", _BLANK("text").alias("text")), ["doc_id"], "text")
    return rows.select("doc_id", F.col("pair_no").cast("long"), F.md5("question").alias("question_md5"), F.md5("answer").alias("answer_md5"))


@plans.add("SELECT record_id, sha1('42|' || CAST(record_id AS VARCHAR)) AS place FROM qa_train")
def q2_shuffle(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "qa_train").select("record_id", questions.shuffle_key(42, F.col("record_id")).alias("place"))


@plans.add("SELECT record_id, CASE WHEN row_number() OVER (ORDER BY sha1('42|' || CAST(record_id AS VARCHAR))) <= greatest(1, CAST(floor(count(*) OVER () * 0.1) AS BIGINT)) THEN 'val' ELSE 'train' END AS split FROM qa_train")
def q3_split(spark: SparkSession, d: str) -> DataFrame:
    return questions.split(read(spark, d, "qa_train").select("record_id"), ["record_id"], 0.1)


@plans.add("SELECT * FROM (SELECT record_id, list_filter(messages, lambda m: m.role = 'user')[1].content AS question, list_filter(messages, lambda m: m.role = 'assistant')[1].content AS answer, list_filter(messages, lambda m: m.role = 'system')[1].content AS told FROM qa_train) WHERE question IS NOT NULL AND answer IS NOT NULL")
def q6_roles(spark: SparkSession, d: str) -> DataFrame:
    """Records that lack a question or an answer are left out."""
    m = F.col("messages")
    rows = read(spark, d, "qa_train").select("record_id", *(questions.first_content(m, r).alias(n) for r, n in (("user", "question"), ("assistant", "answer"), ("system", "told"))))
    return rows.where("question is not null and answer is not null")


@plans.add(rf"""SELECT i AS id, CASE WHEN q <> '' AND a <> '' THEN {strip('q')} WHEN len(ls) >= 2 THEN ls[1] END AS question, CASE WHEN q <> '' AND a <> '' THEN substr({strip('a')}, 1, 1024) WHEN len(ls) >= 2 THEN substr(array_to_string(ls[2:], ' '), 1, 1024) END AS answer
FROM (SELECT i, regexp_extract(x, '(?i)(?:Q:|Question:)\s*(.+?)(?:\n|\z)', 1) AS q, regexp_extract(x, '(?is)(?:A:|Answer:)\s*(.+)', 1) AS a, list_filter(list_transform(string_split(x, chr(10)), lambda l: {strip('l')}), lambda l: l <> '') AS ls FROM {values(PARSED, 'i, x')})""")
def t7_parse_answer(spark: SparkSession, d: str) -> DataFrame:
    return _lit(spark, PARSED, "id int, x string").select("id", questions.parse_answer(F.col("x")).alias("p")).select("id", "p.question", "p.answer")


@plans.add("SELECT record_id, array_to_string(list_transform(messages, lambda m: m.role || ': ' || m.content), chr(10)) AS lines, array_to_string(list_transform(messages, lambda m: '[' || m.role || '] ' || m.content), chr(10)) AS key FROM qa_val")
def t20_t21_chat_lines(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("messages")
    return read(spark, d, "qa_val").select("record_id", history.chat_lines(m).alias("lines"), history.chat_lines(m, "bracket").alias("key"))


@plans.add("SELECT result_id, 'You answer.' AS system, question AS user, model_answer AS assistant, substr(reference_answer, 1, 512) AS context FROM sample_results WHERE question IS NOT NULL AND model_answer IS NOT NULL")
def t22_records(spark: SparkSession, d: str) -> DataFrame:
    made = questions.record(F.col("question"), F.col("model_answer"), F.col("reference_answer"), "You answer.")
    rows = _results(spark, d).where("question is not null and model_answer is not null").select("result_id", made.alias("r"))
    return rows.select("result_id", *(F.col("r.messages")[i]["content"].alias(n) for i, n in enumerate(("system", "user", "assistant"))), "r.context")


@plans.add("SELECT result_id, substr(question, 1, 200) AS question, substr(reference_answer, 1, 300) AS reference, substr(model_answer, 1, 300) AS answer FROM sample_results")
def t23_clips(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d).select("result_id", F.substring("question", 1, 200).alias("question"), F.substring("reference_answer", 1, 300).alias("reference"), F.substring("model_answer", 1, 300).alias("answer"))


@plans.add("SELECT result_id, md5('Question: ' || question || chr(10) || chr(10) || 'Reference answer: ' || substr(reference_answer, 1, 800) || chr(10) || chr(10) || 'Model answer to evaluate: ' || substr(model_answer, 1, 800)) AS prompt_md5 FROM sample_results")
def t24_judge_prompt(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d).select("result_id", F.md5(text.judge_prompt(F.col("question"), F.col("reference_answer"), F.col("model_answer"))).alias("prompt_md5"))


@plans.add("SELECT result_id, question FROM sample_results ORDER BY result_id LIMIT 50")
def o4_o5_capped(spark: SparkSession, d: str) -> DataFrame:
    return questions.capped(_results(spark, d).select("result_id", "question"), ["result_id"], 50)


# ---- judging --------------------------------------------------------------------------------------------------------


def _digit_sql(label: str) -> str:
    return rf"coalesce(CAST(nullif(regexp_extract(x, '(?i){label}[:\s]+([1-5])', 1), '') AS INT), 3)"


@plans.add(rf"SELECT i AS id, coalesce(CAST(nullif(regexp_extract(x, '(?i)Score:\s*([1-5])', 1), '') AS INT), 3) AS score, CASE WHEN regexp_extract(x, '(?is)Reasoning:\s*(.+)', 1) <> '' THEN substr({strip(f'regexp_extract(x, {quote(f"(?is)Reasoning:{BS}s*(.+)")}, 1)')}, 1, 500) ELSE substr(x, 1, 300) END AS reasoning FROM {values(SINGLE, 'i, x')}")
def t15_single_score(spark: SparkSession, d: str) -> DataFrame:
    return _lit(spark, SINGLE, "id int, x string").select("id", judging.single_score(F.col("x")).alias("s")).select("id", "s.*")


_SUMMARY = "count(*) AS samples, floor(avg(accuracy) * 1000 + 0.5000001) / 1000 AS accuracy, floor(avg(relevance) * 1000 + 0.5000001) / 1000 AS relevance, floor(avg(completeness) * 1000 + 0.5000001) / 1000 AS completeness, floor(avg(overall) * 1000 + 0.5000001) / 1000 AS overall, floor(coalesce(stddev_samp(overall), 0) * 1000 + 0.5000001) / 1000 AS overall_stdev, floor(avg(CAST(passed AS INT)) * 1000 + 0.5000001) / 1000 AS pass_rate"


@plans.add(f"SELECT {_SUMMARY} FROM sample_results")
def a5_summary(spark: SparkSession, d: str) -> DataFrame:
    return judging.summary(_results(spark, d))


@plans.add(f"SELECT run_id, {_SUMMARY} FROM sample_results GROUP BY run_id")
def a5_summary_by_run(spark: SparkSession, d: str) -> DataFrame:
    return judging.summary(_results(spark, d), ["run_id"])


def _criteria_sql() -> str:
    parts = []
    for name, weight, signals, ceiling in fixed.CRITERIA:
        found = " + ".join(f"CASE WHEN contains(lower(x), {quote(s)}) THEN 1 ELSE 0 END" for s in signals) or "0"
        parts.append(f"SELECT doc_id, {quote(name)} AS criterion, {weight} AS weight, least({ceiling}, greatest(2, {found} + 2)) AS score FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents)")
    return " UNION ALL ".join(parts)


def _criteria(spark: SparkSession, d: str) -> DataFrame:
    return judging.criterion_rows(read(spark, d, "documents").select("doc_id", _BLANK("text").alias("text")), "doc_id", "text")


@plans.add(_criteria_sql())
def a12_j12_criteria(spark: SparkSession, d: str) -> DataFrame:
    return _criteria(spark, d)


@plans.add(f"SELECT doc_id, round(sum(score * weight) / sum(weight), 3) AS weighted FROM ({_criteria_sql()}) GROUP BY doc_id")
def a6_weighted(spark: SparkSession, d: str) -> DataFrame:
    return judging.weighted(_criteria(spark, d), "doc_id")


@plans.add(f"SELECT bool_and(weighted >= 2.2) AS passed, count(*) FILTER (weighted < 2.2) AS failed FROM (SELECT doc_id, round(sum(score * weight) / sum(weight), 3) AS weighted FROM ({_criteria_sql()}) GROUP BY doc_id)")
def a14_verdict(spark: SparkSession, d: str) -> DataFrame:
    return judging.passed(_criteria(spark, d), "doc_id", 2.2)


@plans.add(f"""SELECT result_id, CAST(least(greatest(floor(1 + 4 * CASE WHEN len(r) = 0 THEN 0.0 ELSE len(list_intersect(r, a)) / len(r) END), 1), 5) AS INT) AS score
FROM (SELECT result_id, list_distinct({words("lower(coalesce(reference_answer, ''))")}) AS r, list_distinct({words("lower(coalesce(model_answer, ''))")}) AS a FROM sample_results)""")
def a11_o9_overlap_score(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d).select("result_id", judging.overlap_score(F.col("reference_answer"), F.col("model_answer")).alias("score"))


@plans.add("(SELECT 'worst' AS which, result_id, overall FROM sample_results WHERE overall IS NOT NULL ORDER BY overall, result_id LIMIT 3) UNION ALL (SELECT 'best', result_id, overall FROM sample_results WHERE overall IS NOT NULL ORDER BY overall DESC, result_id LIMIT 3)")
def o2_extremes(spark: SparkSession, d: str) -> DataFrame:
    return judging.extremes(_results(spark, d), "result_id", "overall")


@plans.add(f"SELECT i AS id, CASE WHEN l IS NULL THEN 0.0 ELSE round(greatest(0.0, 1 - l / 10), 4) END AS score FROM {values([(i, x) for i, x in enumerate(LOSSES)], 'i, l')} UNION ALL SELECT 6, 0.0 UNION ALL SELECT 7, 0.0")
def t19_loss_score(spark: SparkSession, d: str) -> DataFrame:
    rows = [*enumerate(LOSSES), (6, float("nan")), (7, float("inf"))]
    return _lit(spark, rows, "id int, loss double").select("id", judging.loss_score(F.col("loss")).alias("score"))


@plans.add("SELECT run_id, result_id, floor(avg(overall) OVER (PARTITION BY run_id ORDER BY result_id ROWS UNBOUNDED PRECEDING) * 1000 + 0.000001) / 1000 AS so_far FROM sample_results")
def a15_running_mean(spark: SparkSession, d: str) -> DataFrame:
    return quality.running_mean(_results(spark, d), "run_id", "result_id", "overall")


# ---- similarity -----------------------------------------------------------------------------------------------------


def _vectors(source: str, key: str, column: str) -> str:
    return f"(SELECT k, t, n, sqrt(sum(n * n) OVER (PARTITION BY k)) AS norm, sum(n) OVER (PARTITION BY k) AS size FROM (SELECT k, t, count(*) AS n FROM (SELECT {key} AS k, unnest({tokens(column)}) AS t FROM {source}) GROUP BY k, t))"


@plans.add(f"SELECT id, array_to_string({tokens('topic')}, ' ') AS tokens FROM runs WHERE topic IS NOT NULL")
def t18_tokens(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "runs").where("topic is not null").select("id", F.array_join(text.tokens(F.col("topic")), " ").alias("tokens"))


@plans.add(f"SELECT k AS id, t AS token, round(n / size, 6) AS tf FROM {_vectors('runs', 'id', 'topic')}")
def j1_term_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return similarity.term_frequencies(read(spark, d, "runs"), "id", "topic")


@plans.add(f"SELECT s.result_id, round(coalesce(d.dot, 0), 6) AS similarity FROM sample_results s LEFT JOIN (SELECT a.k, sum(a.n * b.n / (a.norm * b.norm)) AS dot FROM {_vectors('sample_results', 'result_id', 'question')} a JOIN {_vectors('sample_results', 'result_id', 'model_answer')} b ON a.k = b.k AND a.t = b.t GROUP BY a.k) d ON d.k = s.result_id")
def j2_j3_pair_similarity(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d).select("result_id", F.round(similarity.cosine(_BLANK("question"), _BLANK("model_answer")), 6).alias("similarity"))


_CACHE = "(SELECT hash, coalesce(model, '') AS model, max_by(response, entry_id) AS response FROM prompts GROUP BY hash, coalesce(model, ''))"


def _cache(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "prompts").select("hash", F.coalesce("model", F.lit("")).alias("model"), "entry_id", "response")


@plans.add(f"SELECT q.entry_id, c.response FROM (SELECT entry_id, hash, coalesce(model, '') AS model FROM prompts) q LEFT JOIN {_CACHE} c ON c.hash = q.hash AND c.model = q.model")
def j5_exact_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = _cache(spark, d)
    cache = rows.groupBy("hash", "model").agg(F.max_by("response", "entry_id").alias("response"))
    return similarity.exact(rows.drop("response"), cache, ["hash", "model"], "response").select("entry_id", "response")


@plans.add("SELECT r.id, s.result_id, s.overall FROM runs r JOIN sample_results s ON s.run_id = r.id")
def j10_run_samples(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "runs").select("id").join(_results(spark, d), F.col("run_id") == F.col("id")).select("id", "result_id", "overall")


# ---- extraction -----------------------------------------------------------------------------------------------------


@plans.add(r"""SELECT doc_id, place, pair, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS place FROM (SELECT doc_id, pair, count(*) AS n, min(i) AS pos FROM
(SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pair, unnest(range(1, len(w))) AS i FROM (SELECT doc_id, regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[^\x00-\x7F]', '_', 'g'), '\b[a-z]{4,}\b') AS w FROM documents)) GROUP BY doc_id, pair)) WHERE place <= 3""")
def t5_word_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select("doc_id", F.regexp_replace(F.lower(_BLANK("text")), r"[^\x00-\x7F]", "_").alias("text"))
    return extraction.word_pairs(rows, "doc_id", "text", 3)


@plans.add(f"SELECT s AS topic, substr(regexp_replace(regexp_replace(lower(s), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40) AS slug FROM (SELECT s FROM {values([(s,) for s in SLUGS], 's')} UNION ALL SELECT topic FROM runs WHERE topic IS NOT NULL)")
def t16_slugs(spark: SparkSession, d: str) -> DataFrame:
    rows = _lit(spark, [(s,) for s in SLUGS], "topic string").unionByName(read(spark, d, "runs").select("topic").where("topic is not null"))
    return rows.select("topic", text.slug(F.col("topic")).alias("slug"))


@plans.add(f"SELECT entry_id, substr(sha1({strip('prompt')}), 1, 16) AS key FROM prompts")
def t17_hashes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "prompts").select("entry_id", text.short_hash(F.col("prompt")).alias("key"))


@plans.add("SELECT id, coalesce(strftime(CAST(started_at AT TIME ZONE 'UTC' AS TIMESTAMP), '%Y-%m-%d %H:%M'), '—') AS started FROM runs")
def t28_dates(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "runs").select("id", F.coalesce(F.date_format("started_at", "yyyy-MM-dd HH:mm"), F.lit("—")).alias("started"))


# ---- history and caches ---------------------------------------------------------------------------------------------


@plans.add("SELECT count(*) AS runs, count(*) FILTER (lower(status) = 'completed') AS completed, count(*) FILTER (lower(status) = 'failed') AS failed, count(*) FILTER (lower(status) = 'running') AS running, floor(avg(avg_score) * 1000 + 0.5000001) / 1000 AS avg_score, floor(avg(pass_rate) * 1000 + 0.5000001) / 1000 AS pass_rate, floor(avg(weighted_eval) * 1000 + 0.5000001) / 1000 AS weighted_eval FROM runs")
def a7_run_statistics(spark: SparkSession, d: str) -> DataFrame:
    return history.run_statistics(read(spark, d, "runs"))


@plans.add("SELECT count(*) AS entries, CAST(coalesce(sum(hits), 0) AS BIGINT) AS hits, array_to_string(list_sort(list_distinct(list(model) FILTER (model <> ''))), ',') AS models FROM prompts")
def a8_cache_statistics(spark: SparkSession, d: str) -> DataFrame:
    return history.cache_statistics(read(spark, d, "prompts"))


@plans.add("SELECT 0 AS part, 'All' AS topic UNION ALL SELECT DISTINCT 1, topic FROM runs WHERE lower(status) = 'completed' AND topic IS NOT NULL")
def a9_o10_topics(spark: SparkSession, d: str) -> DataFrame:
    """``All``, then the topics in order."""
    found = read(spark, d, "runs").where("lower(status) = 'completed' and topic is not null").select(F.lit(1).alias("part"), "topic").distinct()
    return spark.createDataFrame([(0, "All")], "part int, topic string").unionByName(found).orderBy("part", "topic")


@plans.add("SELECT judge_model, floor(avg(avg_score) * 10000 + 0.5000001) / 10000 AS mean FROM runs WHERE avg_score IS NOT NULL GROUP BY judge_model ORDER BY floor(avg(avg_score) * 10000 + 0.5000001) / 10000 DESC, judge_model LIMIT 10")
def a10_best_groups(spark: SparkSession, d: str) -> DataFrame:
    return quality.mean_by(read(spark, d, "runs"), "judge_model", "avg_score", 10)


@plans.add("SELECT run_id, count(*) AS iterations, floor(avg(overall) * 10000 + 0.5000001) / 10000 AS score, floor(avg(CAST(passed AS INT)) * 10000 + 0.5000001) / 10000 AS pass_rate FROM sample_results GROUP BY run_id")
def a13_roll_up(spark: SparkSession, d: str) -> DataFrame:
    return history.roll_up(_results(spark, d).select("run_id", F.col("overall").alias("score"), F.col("passed").cast("int").alias("pass_rate")))


@plans.add("SELECT id, topic, epoch_us(started_at) AS started_us FROM runs ORDER BY started_at DESC NULLS LAST, id DESC LIMIT 10")
def o3_recent(spark: SparkSession, d: str) -> DataFrame:
    return history.recent(read(spark, d, "runs"), 10).select("id", "topic", F.unix_micros("started_at").alias("started_us"))


@plans.add("SELECT id, status FROM runs WHERE lower(status) IN ('completed', 'failed') AND contains(lower(topic), 'how')")
def o6_filter(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "runs").where(F.lower("status").isin("completed", "failed") & F.contains(F.lower("topic"), F.lit("how"))).select("id", "status")


@plans.add("SELECT 0 AS place, result_id AS id, md5(coalesce(question, '')) AS text_md5 FROM sample_results UNION ALL SELECT 1, entry_id, md5(coalesce(prompt, '')) FROM prompts UNION ALL SELECT 2, doc_id, md5(coalesce(text, '')) FROM documents")
def o7_o8_union(spark: SparkSession, d: str) -> DataFrame:
    """Rows of three collectors in the order of the sources."""
    part = lambda i, df, key, c: df.select(F.lit(i).alias("place"), F.col(key).alias("id"), F.md5(_BLANK(c)).alias("text_md5"))
    return part(0, _results(spark, d), "result_id", "question").unionByName(part(1, read(spark, d, "prompts"), "entry_id", "prompt")).unionByName(part(2, read(spark, d, "documents"), "doc_id", "text"))


@plans.add("SELECT id, epoch_us(started_at) AS started_us, weighted_eval FROM runs WHERE weighted_eval IS NOT NULL")
def o11_series(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "runs").where("weighted_eval is not null").select("id", F.unix_micros("started_at").alias("started_us"), "weighted_eval").orderBy("started_us")


@plans.add("SELECT id, topic, status FROM runs UNION ALL SELECT (SELECT max(id) FROM runs) + 1, 'new a', 'running' UNION ALL SELECT (SELECT max(id) FROM runs) + 2, 'new b', 'running'")
def m1_m3_append(spark: SparkSession, d: str) -> DataFrame:
    rows = _lit(spark, [("new b", "running", 2), ("new a", "running", 1)], "topic string, status string, place int")
    return history.append(read(spark, d, "runs").select("id", "topic", "status"), rows)


@plans.add("SELECT id, topic FROM runs WHERE id = 7")
def m4_point_read(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "runs").where("id = 7").select("id", "topic")


@plans.add("SELECT hash, coalesce(model, '') AS model, max_by(coalesce(response, ''), entry_id) AS response, coalesce(max(hits), 0) AS hits FROM prompts GROUP BY 1, 2")
def m5_upsert(spark: SparkSession, d: str) -> DataFrame:
    """All entries arrive anew on top of the cache."""
    rows = read(spark, d, "prompts").select("hash", F.coalesce("model", F.lit("")).alias("model"), "entry_id", F.coalesce("response", F.lit("")).alias("response"), "hits")
    return history.upsert(rows, rows.drop("hits"), ["hash", "model"], "entry_id", "response").drop("entry_id")


@plans.add("SELECT p.entry_id, p.hits + coalesce(l.n, 0) AS hits FROM (SELECT entry_id, coalesce(hits, 0) AS hits, model FROM prompts) p LEFT JOIN (SELECT judge_model AS model, count(*) AS n FROM runs GROUP BY judge_model) l ON l.model = p.model")
def m6_hits(spark: SparkSession, d: str) -> DataFrame:
    log = read(spark, d, "runs").select(F.col("judge_model").alias("model"))
    return history.add_hits(read(spark, d, "prompts").select("entry_id", "model", "hits"), log, ["model"]).select("entry_id", "hits")


@plans.add("SELECT entry_id FROM prompts WHERE NOT hash IN (SELECT hash FROM prompts WHERE entry_id = 1) AND NOT (hash, coalesce(model, '')) IN (SELECT hash, model FROM prompts WHERE entry_id = 3)")
def m7_delete(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "prompts").select("entry_id", "hash", "model")
    gone = rows.where("entry_id = 1").select("hash", F.lit("").alias("model")).unionByName(rows.where("entry_id = 3").select("hash", "model"))
    return history.delete(rows, gone).select("entry_id")


@plans.add("SELECT key, max_by(hash, place) AS hash FROM " + values(STATE_LOG, "key, hash, place") + " WHERE key IS NOT NULL GROUP BY key")
def m9_s16_last_entries(spark: SparkSession, d: str) -> DataFrame:
    return incremental.last_entries(_lit(spark, STATE_LOG, "key string, hash string, place int"))


_KEYS = "SELECT DISTINCT CAST(user_id AS VARCHAR) || event_type AS key, props AS hash FROM events"


@plans.add(f"SELECT s.key, s.hash FROM ({_KEYS}) s WHERE NOT EXISTS (SELECT 1 FROM (SELECT key, max(hash) AS hash FROM ({_KEYS}) GROUP BY key) t WHERE t.key = s.key AND t.hash = s.hash)")
def j8_s21_unseen(spark: SparkSession, d: str) -> DataFrame:
    sources = read(spark, d, "events").select(F.concat(F.col("user_id").cast("string"), "event_type").alias("key"), F.col("props").alias("hash")).distinct()
    return incremental.unseen(sources, sources.groupBy("key").agg(F.max("hash").alias("hash")))


@plans.add(f"SELECT count(*) AS total, count(*) - (SELECT count(DISTINCT key) FROM ({_KEYS})) AS fresh, (SELECT count(DISTINCT key) FROM ({_KEYS})) AS skipped FROM ({_KEYS})")
def m10_incremental_run(spark: SparkSession, d: str) -> DataFrame:
    sources = read(spark, d, "events").select(F.concat(F.col("user_id").cast("string"), "event_type").alias("key"), F.col("props").alias("hash")).distinct().withColumn("place", F.xxhash64("hash"))
    return incremental.run(sources, sources.groupBy("key").agg(F.max("hash").alias("hash")))[2]


@plans.add("SELECT CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def e1_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = collect.windowed(read(spark, d, "events"), "ts", "event_type", "value")
    return rows.select(F.floor(F.unix_micros(F.col("start").cast("timestamp")) / 3_600_000_000).cast("long").alias("hour"), "event_type", "n", F.round("total", 2).alias("total"))


@plans.add("""SELECT user_id, min(us) AS begin_us, count(*) AS n FROM (SELECT *, sum(CASE WHEN us - p < 1800000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)) AS p FROM events)) GROUP BY user_id, s""")
def e2_sessions(spark: SparkSession, d: str) -> DataFrame:
    return collect.sessions(read(spark, d, "events"), "ts", "user_id").select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("begin_us"), "n")
