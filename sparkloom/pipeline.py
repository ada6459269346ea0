"""The whole way from documents to a package, as functions from DataFrames to DataFrames and folders, and the loop over them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import fixed
from sparkloom.operators import chunking, history, judging, packaging, quality, questions
from sparkloom.shared import table
from sparkloom.sources import files

STEPS = ["collect", "analyse", "prepare", "package", "evaluate"]


def collected(*sources: DataFrame) -> DataFrame:
    """doc_id, title, text, source, url of all sources in the order given; of equal url and title the first, too short ones left out.

    Sources have title, text, source, url. Ids follow the order of source, url, title and text, so a rerun gives the same ones.
    """
    rows = None
    for place, source in enumerate(sources):
        part = source.select(F.lit(place).alias("_source"), "title", "text", "source", "url")
        rows = part if rows is None else rows.unionByName(part)
    order = F.concat(F.lpad(F.col("_source").cast("string"), 3, "0"), F.sha1(F.concat_ws("\x01", *(F.coalesce(c, F.lit("")) for c in ("url", "title", "text")))))
    numbered = rows.distinct().withColumn("doc_id", order)
    found = quality.first_by_key(quality.long_enough(quality.normalised(numbered)))
    return found.select("doc_id", "title", "text", "source", "url", "chars")


@dataclass
class Corpus:
    """What the analysis of documents gives."""

    scored: DataFrame
    kept: DataFrame
    chunks: DataFrame
    report: DataFrame


def analysed(docs: DataFrame, threshold: float = fixed.QUALITY_THRESHOLD) -> Corpus:
    """Scores, the documents that pass, their chunks and the report of documents (doc_id, title, text, source, url)."""
    scored = table(quality.scored(quality.normalised(docs)), "scored")
    kept = quality.gate(scored, threshold)
    return Corpus(scored, kept, chunking.chunk_documents(kept), quality.report(scored, threshold))


def prepared(chunks: DataFrame, system: str, program: str = "", fraction: float = 0.1, most: int = 5, seed: int = 42, backends: list[Callable[[DataFrame], DataFrame]] = ()) -> DataFrame:
    """messages, context, split: records made of the chunks' passages, shuffled and split.

    ``backends`` (passages to keys, pair_no, question, answer) are tried in order; the first that gives a row is taken, else the
    heuristic questions.
    """
    passages = chunking.answerable(chunks)
    keys = ["doc_id", "chunk_no", "passage_no"]
    made = None
    for backend in backends:
        rows = table(backend(passages), "pairs")
        if rows.limit(1).count():
            made = rows
            break
    if made is None:
        made = questions.pairs(passages, keys, "passage", most)
    rows = made.join(passages, keys).select(*keys, "pair_no", questions.record(F.col("question"), F.col("answer"), F.col("passage"), system, program).alias("r"))
    return questions.split(table(rows, "records"), [*keys, "pair_no"], fraction, seed).select("r.messages", "r.context", "split")


def run(docs: DataFrame, out: str, topic: str, run_id: str, system: str = "You answer from the corpus.", steps: list[str] | None = None, threshold: float = fixed.QUALITY_THRESHOLD) -> dict[str, str]:
    """The steps asked for (by default all) on collected documents, each written below ``out``; the folders by name.

    ``collect`` writes the corpus file and its metadata, ``analyse`` the cleaned and the external-only corpus and the report,
    ``prepare`` training records by split, ``package`` the reports of the topic, ``evaluate`` the criteria of each document.
    """
    steps = steps or STEPS
    unknown = set(steps) - set(STEPS)
    if unknown:
        raise ValueError(f"unknown steps: {sorted(unknown)}")
    out = out.rstrip("/")
    paths: dict[str, str] = {}
    docs = table(docs, "docs")
    if "collect" in steps:
        paths["corpus"], paths["metadata"] = f"{out}/corpus", f"{out}/metadata"
        files.write_corpus(docs, paths["corpus"])
        files.write_metadata(docs, paths["metadata"])
    found = analysed(docs, threshold) if {"analyse", "prepare"} & set(steps) else None
    if "analyse" in steps:
        paths |= files.write_cleaned(found.chunks, out) | {"report": f"{out}/report"}
        files.write_report(found.report, quality.by_source(found.scored), quality.best(found.scored), paths["report"])
    if "prepare" in steps:
        paths["records"] = f"{out}/records"
        files.write_split(prepared(found.chunks, system), paths["records"])
    if "package" in steps:
        paths["package"] = f"{out}/packages"
        rows = docs.select("doc_id", F.lit(topic).alias("topic"), "text").withColumn("run_id", F.concat_ws("-", F.lit(run_id), F.col("doc_id").cast("string")))
        made = table(packaging.reports(rows, "run_id", "topic", "text", [("Run ID", F.col("run_id"))]).withColumn("error", F.lit(None).cast("string")), "reports")
        meta = made.groupBy("run_id").agg(F.first("class").alias("type")).withColumn("topic", F.lit(topic))
        packaging.write(made, meta, paths["package"])
    if "evaluate" in steps:
        paths["evaluation"] = f"{out}/evaluation"
        judging.weighted(judging.criterion_rows(docs, "doc_id", "text"), "doc_id").write.mode("overwrite").parquet(paths["evaluation"])
    return paths


@dataclass
class Loop:
    """Research runs: tables of runs and of their iterations, as they are after the calls so far."""

    runs: DataFrame
    metrics: DataFrame
    listeners: list[Callable[[str, dict], None]] = field(default_factory=list)

    def _tell(self, kind: str, **what: object) -> None:
        for listener in self.listeners:
            listener(kind, what)

    def research(self, topic: str, train: Callable[[int], dict], iterations: int = 1, collect: Callable[[int], object] | None = None, prepare: Callable[[int], object] | None = None, similar: Callable[[str], DataFrame] | None = None) -> int | None:
        """A run of ``iterations``: collect, prepare, train (giving val_score and pass_rate); its id.

        With ``similar`` (topic to similar runs) a topic that has any is not researched again; the id is None. Listeners hear
        ``status``, ``log``, ``error``, ``result`` and ``done`` events. A failed iteration ends the run as failed.
        """
        spark: SparkSession = self.runs.sparkSession
        if similar is not None and similar(topic).limit(1).count():
            self._tell("status", topic=topic, state="skipped")
            return None
        new = spark.createDataFrame([(topic, "running", 1)], "topic string, status string, place int")
        self.runs = table(history.append(self.runs, new), "runs")
        number = self.runs.agg(F.max("id")).first()[0]
        self._tell("status", run=number, topic=topic, state="running")
        seen: list[dict] = []
        status = "completed"
        for i in range(1, iterations + 1):
            try:
                for step in (collect, prepare):
                    if step is not None:
                        step(i)
                seen.append(train(i))
            except Exception as error:  # noqa: BLE001  the run is kept, as failed
                status = "failed"
                self._tell("error", run=number, iteration=i, error=str(error))
                break
            row = spark.createDataFrame([(number, i, seen[-1].get("val_score"), seen[-1].get("pass_rate"))], "run_id long, iteration long, val_score double, pass_rate double")
            self.metrics = table(self.metrics.unionByName(row, allowMissingColumns=True), "metrics")
            self._tell("log", run=number, iteration=i, **seen[-1])
        mean = lambda name: (lambda xs: round(sum(xs) / len(xs), 4) if xs else None)([m[name] for m in seen if m.get(name) is not None])
        change = spark.createDataFrame([(number, status, len(seen), mean("val_score"), mean("pass_rate"))], "id long, status string, iterations long, avg_score double, pass_rate double")
        self.runs = table(history.finish(self.runs, change), "runs")
        self._tell("result", run=number, avg_score=mean("val_score"), pass_rate=mean("pass_rate"))
        self._tell("done", run=number, state=status)
        return number
