"""Operators that SQL cannot check, and edge cases of those that it can."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom import pipeline, running, shared
from sparkloom.functions import rules, text
from sparkloom.operators import chunking, extraction, history, incremental, packaging, quality, questions, relational, similarity
from sparkloom.sources import files, models, services
from sparkloom.streaming import collect

DOC = "doc_id long, title string, text string, source string, url string, clash string"


def test_empty_table_and_nulls_in_every_column(spark):
    none = spark.createDataFrame([], DOC)
    scored = quality.scored(quality.normalised(none))
    assert quality.report(scored).first().total_docs == 0
    rows = quality.scored(quality.normalised(spark.createDataFrame([(None, None, None, None, None, None), (1, "t", "", "WEB ", "", "x")], DOC))).collect()
    assert {(r.reason, r.source) for r in rows} == {("empty document", "unknown"), ("empty document", "web")}


def test_very_long_text_is_chunked_whole(spark):
    body = "word " * 60_000
    rows = chunking.chunk_documents(spark.createDataFrame([(1, "external", body)], "doc_id long, kind string, text string")).collect()
    assert max(len(r.chunk) for r in rows) <= 2048 + 130
    assert sum(r.chunk.count("word") for r in rows) >= 60_000


def test_first_by_key_keeps_the_first_of_a_hot_key(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("key"))
    rows = {r.key: r.doc_id for r in quality.first_by_key(df).collect()}
    assert rows["hot"] == 0 and len(rows) == 667


@pytest.mark.parametrize("n,fraction,val", [(1, 0.1, 1), (10, 0.25, 2), (500, 0.1, 50), (3, 0.0, 1)])
def test_split_sizes(spark, n, fraction, val):
    rows = questions.split(spark.range(n), ["id"], fraction).collect()
    assert len(rows) == n and sum(r.split == "val" for r in rows) == val


def test_split_of_nothing(spark):
    assert questions.split(spark.range(0), ["id"], 0.5).count() == 0


def test_running_total_matches_a_plain_sum(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 500).alias("o"), (F.col("id") % 10).alias("v"))
    rows = running.running_total(df, ["g"], F.floor(F.col("o") / 16), ["o"], "v", "s").collect()
    for g in range(3):
        total = 0
        for r in sorted((r for r in rows if r.g == g), key=lambda r: r.o):
            total += r.v
            assert r.s == total


def test_hot_groups_in_parts_give_the_same_rows(spark):
    rows = spark.range(900).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 5).cast("string")).alias("k"), (F.col("id") * 7919 % 900).alias("t"), F.when(F.col("id") % 11 != 0, F.col("id") % 10).alias("v"))
    means = [{tuple(r) for r in quality.running_mean(rows, "k", "t", "v", rows=n).collect()} for n in (50, 10**6)]
    assert means[0] == means[1] and len(means[0]) == 900
    bought = rows.where("t % 7 = 0").select("k", "t", F.col("v").alias("b"))
    joined = [sorted(map(str, relational.as_of(rows, bought, "k", "t", "b", rows=n).collect())) for n in (50, 10**6)]
    assert joined[0] == joined[1] and len(joined[0]) == 900


def test_as_of_join_with_ties_and_missing(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 3)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 1.0), ("a", 5, 2.0), ("a", 5, 3.0)], "k string, t int, v double")
    assert {(r.k, r.t, r.v) for r in relational.as_of(left, right, "k", "t", "v").collect()} == {("a", 5, 3.0), ("a", 1, None), ("b", 3, None)}


def test_similarity_is_symmetric_and_zero_without_tokens(spark):
    df = spark.createDataFrame([("vector store survey", "survey of stores"), ("survey of stores", "vector store survey"), ("the of", "x"), ("same words", "same words")], "a string, b string")
    got = [round(r[0], 9) for r in df.select(similarity.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == got[1] and got[2] == 0.0 and got[3] == 1.0


def test_cleaning_is_idempotent(spark):
    df = spark.createDataFrame([("a​ \t b\r\n\r\n\n\n\nc ",), ("",), (" \n ",)], "x string")
    rows = df.select(text.clean(F.col("x")).alias("c")).select("c", text.clean(F.col("c")).alias("d")).collect()
    assert all(r.c == r.d for r in rows) and rows[0].c == "a b\n\n\nc"


def test_hint_decides_input_class(spark):
    df = spark.createDataFrame([("plain", "Error-Log"), ("plain", "nonsense"), ("plain", None)], "x string, h string")
    assert [r[0] for r in df.select(rules.input_class(F.col("x"), F.col("h"))).collect()] == ["error_log", "text", "text"]


def test_incremental_run_twice_finds_nothing_new(spark):
    sources = spark.createDataFrame([("a", "1", 0), ("b", "2", 1), ("a", "3", 2)], "key string, hash string, place long")
    state = spark.createDataFrame([], "key string, hash string")
    fresh, after, counts = incremental.run(sources, state)
    assert counts.first().fresh == 3 and {(r.key, r.hash) for r in after.collect()} == {("a", "3"), ("b", "2")}
    assert {(r.key, r.hash) for r in incremental.unseen(sources, after).collect()} == {("a", "1")}
    assert incremental.run(sources, after, force=True)[2].first().fresh == 3


def test_delete_by_hash_for_all_models(spark):
    cache = spark.createDataFrame([("h", "m", 1), ("h", "n", 2), ("g", "m", 3)], "hash string, model string, n int")
    gone = lambda model: spark.createDataFrame([("h", model)], "hash string, model string")
    assert history.delete(cache, gone("")).count() == 1
    assert history.delete(cache, gone("m")).count() == 2


def test_folder_source(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_bytes(b"# A\xff text")
    (tmp_path / "sub" / "b.txt").write_text("B")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.rst").write_text("skip")
    assert {(r.title, r.text) for r in files.folder(spark, str(tmp_path)).collect()} == {("a", "# A text"), ("b", "B")}
    assert {r.title for r in files.folder(spark, str(tmp_path), pdf=lambda data: data.decode()).collect()} == {"a", "b", "c"}
    assert files.folder(spark, str(tmp_path), ["md", "txt"], most=1).count() == 1


def test_corpus_file_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "One", "body\n\nof one", "web"), (2, "Two", "x", "pdf")], "doc_id long, title string, text string, source string")
    files.write_corpus(docs, str(tmp_path / "corpus"))
    assert {(r.title, r.source, r.text) for r in files.read_corpus(spark, str(tmp_path / "corpus")).collect()} == {("One", "web", "body\n\nof one"), ("Two", "pdf", "x")}


def test_metadata_logs_metrics_and_packages(spark, tmp_path):
    docs = spark.createDataFrame([(1, "One", "body")], "doc_id long, title string, text string")
    files.write_metadata(docs, str(tmp_path / "meta"))
    assert spark.read.json(str(tmp_path / "meta")).columns == ["doc_id", "title"]
    (tmp_path / "state.jsonl").write_text('{"key": "a", "hash": "1"}\nbroken\n{"key": "a", "hash": "2"}\n')
    assert [(r.key, r.hash) for r in incremental.last_entries(files.read_log(spark, str(tmp_path / "state.jsonl"))).collect()] == [("a", "2")]
    files.append_metrics(spark.createDataFrame([(1, "x")], "loss int, note string"), str(tmp_path / "tsv"))
    files.append_metrics(spark.createDataFrame([(2, None)], "loss int, note string"), str(tmp_path / "tsv"))
    assert {(r.loss, r.note) for r in files.read_metrics(spark, str(tmp_path / "tsv")).collect()} == {("1", "x"), ("2", "?")}
    for name, body in (("r1", json.dumps({"run_id": "r1", "topic": "t"})), ("r2", json.dumps({"run_id": "r2"})), ("r3", "{")):
        (tmp_path / "out" / name).mkdir(parents=True)
        (tmp_path / "out" / name / "metadata.json").write_text(body)
    assert [r.run_id for r in files.packages(spark, str(tmp_path / "out")).collect()] == ["r2", "r1"]


def test_criteria_file(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "spec.yaml").write_text("criteria:\n  - name: a\n    question: q\n    weight: 2\n  - name: b\n")
    assert [(r.name, r.weight) for r in files.read_criteria(spark, str(tmp_path / "spec.yaml")).collect()] == [("a", 2.0), ("b", 1.0)]
    (tmp_path / "none.yaml").write_text("criteria: []\n")
    with pytest.raises(ValueError):
        files.read_criteria(spark, str(tmp_path / "none.yaml"))


def test_fetched_source_skips_failures(spark):
    def fetch(key):
        if key == "bad":
            raise OSError(key)
        return [(f"title {key}", f"<p>{key}</p>", f"https://x.example/{key}")]

    spark.dataSource.register(services.Fetched)
    rows = spark.read.format("fetched").options(**services.fetched_options(["a", "bad", "b"], fetch, 2)).load()
    assert {r.title for r in rows.collect()} == {"title a", "title b"}


def test_service_shapes(spark):
    listing = json.dumps({"data": {"children": [{"data": {"title": "T", "selftext": "body", "permalink": "/r/x", "score": 3}}, {"data": {"title": "E", "selftext": " "}}]}})
    posts = services.posts(spark.createDataFrame([(listing,), ("broken",)], "value string")).collect()
    assert [(p.title, p.text) for p in posts] == [("T", "# T\n\nbody")]
    tree = spark.createDataFrame([("r", ["a.py", ".hidden.py", "src/b.md", "c.bin", ".github/d.md", "e.TXT"])], "repo string, paths array<string>")
    assert [r.path for r in services.repository_files(tree, 2).collect()] == ["a.py", "src/b.md"]
    assert services.decoded(spark.createDataFrame([("aGVs\nbG8=",)], "content string")).first().text == "hello"
    found = spark.createDataFrame([("t", "l", "snip", ""), ("t", "l", "snip", "page")], "title string, link string, snippet string, page string")
    assert {r.text for r in services.search_results(found).collect()} == {"snip", "page"}
    mimes = spark.createDataFrame([("application/pdf",), ("application/vnd.google-apps.document",), ("image/png",)], "m string")
    assert [r[0] for r in mimes.select(services.drive_action(F.col("m"))).collect()] == ["download", "export:text/plain", "skip"]
    page = lambda source, title: spark.createDataFrame([(title, "x" * 9000, source, "u")], "title string, text string, source string, url string")
    rows = services.topic_rows(page("web", "w"), page("reddit", "On Topic"), page("github", "g"), "topic").collect()
    assert sorted(len(r.text) for r in rows) == [4000, 8000, 9000]


def test_search_responses(spark):
    listing = json.dumps({"data": {"children": [{"data": {"title": "T", "selftext": "", "permalink": "/r/x", "score": 3}}]}})
    rows = spark.createDataFrame([(200, "application/json; charset=UTF-8", listing), (403, "application/json", listing), (200, "text/html", listing), (200, "application/json", "broken"), (None, None, None)], "status int, content_type string, body string")
    assert [tuple(r) for r in services.top_posts(rows).collect()] == [("T", "", "https://www.reddit.com/r/x", 3)]
    found = spark.createDataFrame([(json.dumps({"items": [{"full_name": f"o/r{i}"} for i in range(8)]}),), ("{}",), (None,)], "body string")
    assert [r.repo for r in services.repository_names(found, most=2).collect()] == ["o/r0", "o/r1"]


def test_registry_of_programmes(spark):
    known = spark.createDataFrame([("a", "old", "o", ["g"], ["s"]), ("b", "tb", "o", ["g"], ["s"])], packaging.PROGRAM)
    registry = packaging.register(known, spark.createDataFrame([("a", "new", "o", ["g"], ["s"])], packaging.PROGRAM))
    made = {r.asked: r.markdown for r in packaging.programmes(spark.createDataFrame([("a",), ("Deep Nets",)], "asked string"), registry, ["goal"], ["step"]).collect()}
    assert registry.count() == 2 and made["a"].startswith("# a\n\n## Topic\nnew\n") and made["Deep Nets"].startswith("# deep-nets\n\n## Topic\nDeep Nets\n") and "1. step" in made["Deep Nets"]


def test_generators_and_package_files(spark, tmp_path):
    rows = spark.createDataFrame([("r", "SUMMARY.md"), ("r", "TESTS.md")], "run_id string, file string")
    made = packaging.generate(rows, {"SUMMARY.md": lambda df: df.withColumn("content", F.lit("# Sü"))})
    assert packaging.generate(rows, {}).count() == 0
    failed = rows.where("file = 'TESTS.md'").withColumn("content", F.lit(None).cast("string")).withColumn("error", F.lit("no generator"))
    contents = made.withColumn("error", F.lit(None).cast("string")).unionByName(failed)
    meta = spark.createDataFrame([("r", "topic", "code")], "run_id string, topic string, type string")
    out = str(tmp_path / "out")
    packaging.write(contents, meta, out)
    assert (tmp_path / "out" / "r" / "SUMMARY.md").read_text() == "# Sü"
    assert sorted(f.name for f in (tmp_path / "out" / "r").iterdir() if not f.name.startswith(".")) == ["SUMMARY.md", "metadata.json"]
    assert json.loads((tmp_path / "out" / "r" / "metadata.json").read_text())["errors"] == {"TESTS.md": "no generator"}
    known = files.packages(spark, out).collect()
    assert [(p.run_id, p.topic, p.type, dict(p.files)) for p in known] == [("r", "topic", "code", {"SUMMARY.md": "SUMMARY.md"})]


def test_reports_of_a_row(spark):
    body = "## Overview\nall of it\n## Key Findings\n- x"
    rows = spark.createDataFrame([(1, "benchmark survey of stores", body), (2, "t", None)], "id int, topic string, body string")
    made = {(r.id, r.file): r.content for r in packaging.reports(rows, "id", "topic", "body").collect()}
    summary = made[1, "SUMMARY.md"]
    assert summary.startswith("# Research Summary: benchmark survey of stores\n\n") and "## Overview\n\nall of it\n\n## Key Findings\n\n- x\n\n" in summary
    assert "- **SUMMARY.md** — this file\n- **ARCHITECTURE.md**" in summary and "## Recommended Next Action\n\n_No content generated._" in summary
    assert "## Component Diagram\n\n_No" not in made[1, "ARCHITECTURE.md"].split("## Components")[0]


def test_sections_by_place_do_not_count_as_found(spark):
    rows = spark.createDataFrame([("## A\none\n## B\ntwo",), ("",), (None,)], "x string").select(extraction.sections(F.col("x")).alias("s"), extraction.coverage(extraction.sections(F.col("x")), ["A", "C"]).alias("c")).collect()
    assert dict(rows[0].s) == {"a": "one", "b": "two", "_section_0": "one", "_section_1": "two"} and [r.c for r in rows[:2]] == [50, 0]


def test_topics_fall_back_to_word_pairs(spark):
    rows = spark.createDataFrame([(1, "# Named", "x"), (2, None, "deep learning with deep learning models"), (3, "nothing", ""), (4, None, None)], "id int, program string, body string")
    assert {r.id: r.topic for r in extraction.topics(rows, "id", "program", "body").collect()} == {1: "Named", 2: "deep learning, learning with, with deep", 3: "research findings", 4: "research findings"}


def test_finished_runs_take_defaults(spark):
    runs = spark.createDataFrame([(1, "t", "running", 5, 0.5, "old"), (2, "u", "running", 1, None, None)], "id long, topic string, status string, iterations long, avg_score double, notes string")
    done = {r.id: r for r in history.finish(runs, spark.createDataFrame([(1, 0.75), (9, 1.0)], "id long, avg_score double")).collect()}
    assert tuple(done[1]) == (1, "t", "completed", 0, 0.75, "") and tuple(done[2]) == (2, "u", "running", 1, None, None)
    assert history.cleared(runs)[1] == 2 and history.cleared(runs)[0].count() == 0


def test_contexts_in_blocks_of_words(spark):
    chunks = spark.createDataFrame([(0, "nothing here"), (1, "Why not"), (2, "it rains. Why?"), (3, None)], "place long, chunk string")
    asked = spark.createDataFrame([(1, "Why does it"), (2, "rain falls"), (3, "zebra"), (4, None), (5, "")], "id int, q string")
    for block in (1, 200_000):
        assert {r.id: r.place for r in questions.contexts(asked, "id", F.col("q"), chunks, block=block).collect()} == {1: 1, 2: 2, 3: 0, 4: 0, 5: 0}
    assert {r.chunk for r in questions.contexts(asked, "id", F.col("q"), chunks.limit(0)).collect()} == {""}


def test_cache_chain(spark):
    cache = spark.createDataFrame([(1, "h1", "m", "alpha beta gamma", "old", 5), (2, "h1", "m", "alpha beta gamma", "new", 9), (3, "h3", "m", "one two three four", "near", 9), (4, "h4", "m", "stale entry here", "stale", 0)], "entry_id long, hash string, model string, prompt string, response string, at int")
    cache = cache.withColumn("cached_at", F.timestamp_seconds(F.col("at") * 3600))
    asked = spark.createDataFrame([(10, "h1", "m", "x y"), (11, "zz", "m", "one two three four!"), (12, "zz", "other", "one two three four"), (13, "h4", "m", "stale entry here"), (14, None, None, None)], "query_id long, hash string, model string, prompt string")
    found = similarity.cached(asked, cache, lambda rest: rest.select("query_id", F.lit("made").alias("response")), age="6 hours", now=F.timestamp_seconds(F.lit(10 * 3600)))
    assert {r.query_id: (r.how, r.entry_id, r.response) for r in found.collect()} == {10: ("exact", 2, "new"), 11: ("fuzzy", 3, "near"), 12: ("computed", None, "made"), 13: ("computed", None, "made"), 14: ("computed", None, "made")}


def test_many_query_tokens_are_salted(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"common word{i % 7} thing{i % 3}") for i in range(60)], "id int, t string")
    want = {tuple(r) for r in similarity.similar(rows, rows, 0.5, ("id", "t"), ("id", "t")).collect()}
    monkeypatch.setattr(similarity, "QUERY_TOKENS", 10)
    assert {tuple(r) for r in similarity.similar(rows, rows, 0.5, ("id", "t"), ("id", "t")).collect()} == want and len(want) > 60


def test_completed_by_provider_with_retries_and_fallback(spark):
    def reply(model, prompt):
        if prompt == "down":
            raise ValueError("bad request")
        return f"{model}: ```" if prompt == "open" else f"{model}: {prompt}"

    rows = spark.createDataFrame([(1, "hi", "claude-x"), (2, "down", "claude-x"), (3, "hi", "gpt-x"), (4, None, "claude-x"), (5, "open", "claude-x")], "id int, prompt string, model string")
    got = {r.id: (r.reply, r.error) for r in models.completed(rows, "prompt", F.col("model"), {"anthropic": reply}, F.lit("none")).collect()}
    assert got == {1: ("claude-x: hi", None), 2: ("none", "bad request"), 3: ("none", None), 4: ("none", None), 5: ("claude-x: ```", None)}


def test_pipeline_writes_every_step(spark, tmp_path):
    text_ = "## Overview\n" + " ".join(f"The river near town{i} was measured with great care, and the results of the survey were kept in the archive." for i in range(40))
    source = lambda rows: spark.createDataFrame(rows, "title string, text string, source string, url string")
    docs = pipeline.collected(source([("A", text_, "web", "u1"), ("short", "x", "web", "u2")]), source([("A", "later " + text_, "web", "u1"), ("B", text_[::-1], "pdf", None), (None, None, None, None)]))
    assert sorted(r.title for r in docs.collect()) == ["A", "B"] and docs.where("title = 'A'").first().text.startswith("## Overview")
    paths = pipeline.run(docs, f"file://{tmp_path}", "survey of rivers", "r1")
    assert set(paths) == {"corpus", "metadata", "cleaned", "external", "report", "records", "package", "evaluation"}
    report = json.loads(spark.read.text(paths["report"]).first().value)
    assert report["total_docs"] == 2 and report["source_breakdown"] and report["doc_stats"]
    assert {r.split for r in spark.read.json(paths["records"]).collect()} == {"train", "val"}
    assert files.packages(spark, paths["package"]).count() == 2 and spark.read.parquet(paths["evaluation"]).count() == 2
    with pytest.raises(ValueError):
        pipeline.run(docs, str(tmp_path), "t", "r", steps=["publish"])


def test_loop_keeps_runs_and_tells_events(spark):
    runs = spark.createDataFrame([(1, "old", "completed", 1, 0.5, 0.5)], "id long, topic string, status string, iterations long, avg_score double, pass_rate double")
    metrics = spark.createDataFrame([], "run_id long, iteration long, val_score double, pass_rate double")
    heard, calls = [], []
    loop = pipeline.Loop(runs, metrics, [lambda kind, what: heard.append(kind)])
    assert loop.research("new", lambda i: {"val_score": i / 10, "pass_rate": None}, 2, collect=calls.append, prepare=calls.append) == 2
    assert calls == [1, 1, 2, 2] and heard == ["status", "log", "log", "result", "done"]
    assert loop.research("bad", lambda i: 1 / 0) == 3 and "error" in heard
    assert loop.research("again", lambda i: {}, similar=lambda topic: runs) is None
    got = {r.id: (r.status, r.iterations, r.avg_score) for r in loop.runs.collect()}
    assert got == {1: ("completed", 1, 0.5), 2: ("completed", 2, 0.15), 3: ("failed", 0, None)} and loop.metrics.count() == 2


def test_small_sinks_and_text_functions(spark, tmp_path):
    log = spark.createDataFrame([("k", "h", 1.5)], "key string, hash string, last_seen double")
    files.flush_log(log, str(tmp_path / "log"))
    assert [tuple(r)[:3] for r in files.read_log(spark, str(tmp_path / "log")).collect()] == [("k", "h", 1.5)]
    line = files.metrics_summary(spark.createDataFrame([("1", None, "t")], "iteration string, val_loss string, topic string")).first().line
    assert line == "  iter   1  val_loss=       ?  val_score=     ?  topic=t"
    row = spark.range(1).select(text.minute(F.lit("2024-05-06T07:08:09")).alias("a"), text.minute(F.lit("soon")).alias("b"), text.minute(F.lit("")).alias("c"), text.content_hash(F.lit(b"x" * 600_000)).alias("d"), text.content_hash(F.lit(b"x" * 524_288)).alias("e"), text.report_prompt(F.lit("T"), F.lit("body"), F.lit("note"), F.lit(None).cast("string")).alias("f")).first()
    assert (row.a, row.b, row.c) == ("2024-05-06 07:08", "soon", "—") and row.d == row.e and row.f.startswith("Research topic: T\n\nnote") and "(4 chars)" in row.f
    windows = spark.createDataFrame([("ext", "main"), (None, "main")], "e string, m string").select(chunking.corpus_window(F.col("e"), F.col("m")).alias("w")).collect()
    assert windows[0].w.text.startswith("ext\n\n[---") and "70%" in windows[0].w.note and windows[1].w.text == "main"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "A.TXT").write_text("upper")
    assert [r.title for r in files.folder(spark, str(tmp_path / "in")).collect()] == ["A"]


def test_stream_collects_each_key_once(spark, tmp_path):
    schema = StructType.fromDDL("doc_id long, text string")
    target, state, folder = (str(tmp_path / x) for x in ("target", "state", "in"))
    spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], schema).write.parquet(folder)
    collect.collect(collect.new_rows(spark, folder, schema), target, state).awaitTermination()
    spark.createDataFrame([(2, "d"), (3, "e")], schema).write.mode("append").parquet(folder)
    collect.collect(collect.new_rows(spark, folder, schema), target, state).awaitTermination()
    assert sorted((r.doc_id, r.text) for r in spark.read.parquet(target).select("doc_id", "text").collect()) == [(1, "a"), (2, "c"), (3, "e")]


def test_stream_windows_equal_batch(spark, tmp_path):
    schema = StructType.fromDDL("ts timestamp, kind string, value double")
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,cast(id as int)*7) AS ts, if(id % 2 = 0, 'a', 'b') AS kind, cast(id as double) AS value FROM range(100)")
    rows.write.parquet(str(tmp_path / "ev"))
    stream = collect.windowed(collect.new_rows(spark, str(tmp_path / "ev"), schema), "ts", "kind", "value")
    query = stream.writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    want = collect.windowed(rows, "ts", "kind", "value")
    assert sorted(map(str, spark.table("win").collect())) == sorted(map(str, want.collect()))


def test_shared_table_reads_back(spark):
    assert shared.table(spark.range(5), "t").count() == 5
    path = shared.new_path(spark, "gone")
    spark.range(1).write.parquet(path)
    assert shared.exists(spark, path)
    shared.remove(spark, path)
    assert not shared.exists(spark, path)
    assert shared.shared_dir(spark) == shared.shared_dir(spark)
    assert shared.qualified(spark, "/tmp/x/") == shared.qualified(spark, "file:///tmp/x") == "file:///tmp/x"
    assert shared.names(spark, path) == [] and shared.mark(spark, f"{path}/a") and not shared.mark(spark, f"{path}/a") and shared.names(spark, path) == ["a"]
