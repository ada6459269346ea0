"""Sources and sinks on files: folders, corpus files, JSON lines, tables of tab-separated values, specifications."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.functions import fixed, text
from sparkloom.operators import chunking
from sparkloom.shared import remove

SEPARATOR = "<DOC_SEP>"
DOCUMENT = "title string, text string, source string, url string"


def folder(spark: SparkSession, path: str, suffixes: list[str] | None = None, pdf: Callable[[bytes], str] | None = None, most: int | None = None) -> DataFrame:
    """Documents of all files below ``path`` with one of ``suffixes``: title (stem), text, source ``local``, url.

    Texts are UTF-8, broken bytes dropped. PDF files need a parser, ``pdf`` (bytes to text), and are left out without one;
    files that are missing or fail to parse are skipped. ``most`` keeps the first files by path.
    """
    suffixes = suffixes or fixed.FILE_SUFFIXES
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in x) for x in suffixes) + "}").option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True).load(path)
    if most is not None:
        files = files.join(files.select("path").orderBy("path").limit(most), "path", "left_semi")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"]):
                stem, _, suffix = name.rsplit("/", 1)[-1].rpartition(".")
                if suffix.lower() == "pdf":
                    if pdf is None:
                        continue
                    try:
                        body = pdf(bytes(content))
                    except Exception:  # noqa: BLE001  a file that cannot be parsed is skipped
                        continue
                else:
                    body = bytes(content).decode("utf-8", "ignore")
                rows.append((stem, body, "local", name))
            yield pd.DataFrame(rows, columns=["title", "text", "source", "url"])

    return files.select("path", "content").mapInPandas(parse, DOCUMENT)


def corpus(lines: DataFrame, column: str = "value") -> DataFrame:
    """title, source, text of the blocks of a corpus file, one a row; blocks without a header are ``unknown``, blank ones left out."""
    block = text.strip(F.col(column))
    header = r"^=== (.+?) \[(\w+)\] ===\n"
    has = block.rlike(header)
    part = lambda i: F.when(has, F.regexp_extract(block, header, i)).otherwise("unknown")
    return lines.where(block != "").select(part(1).alias("title"), part(2).alias("source"), text.strip(F.regexp_replace(block, header, "")).alias("text"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a corpus file. Its blocks are records of the text source, so a large file is split."""
    return corpus(spark.read.option("lineSep", SEPARATOR).text(path))


def rendered(docs: DataFrame) -> DataFrame:
    """doc_id, block: the corpus file's block of each document."""
    return docs.select("doc_id", F.concat(F.lit("=== "), "title", F.lit(" ["), "source", F.lit("] ===\n"), "text").alias("block"))


def write_corpus(docs: DataFrame, path: str) -> None:
    """Blocks to a folder of text files, replacing what is there."""
    rendered(docs).select("block").write.mode("overwrite").option("lineSep", f"\n{SEPARATOR}\n").text(path)


def write_metadata(docs: DataFrame, path: str) -> None:
    """JSON lines of all columns but the text."""
    docs.drop("text").write.mode("overwrite").json(path)


def json_lines(spark: SparkSession, path: str, schema: StructType | str, strict: bool = False) -> DataFrame:
    """JSON lines; malformed ones fail if ``strict``, else they are dropped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """key, hash, last_seen, place of the entries of a state log, malformed lines left out; place grows along each file."""
    rows = spark.read.text(path).withColumn("place", F.monotonically_increasing_id())
    entry = F.from_json("value", "key string, hash string, last_seen double")
    return rows.select(entry.alias("e"), "place").where("e.key is not null").select("e.*", "place")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated metrics with a header, all columns as text; missing ones as ``?``."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    return rows.select(*(F.coalesce(c, F.lit("?")).alias(c) for c in rows.columns))


def append_metrics(rows: DataFrame, path: str) -> None:
    """Append metrics; every file of the folder has the header once."""
    rows.write.mode("append").option("sep", "\t").option("header", True).csv(path)


def read_criteria(spark: SparkSession, path: str) -> DataFrame:
    """name, question, weight of the criteria of a YAML specification; fails if there is none."""
    import yaml

    lines = spark.read.text(path, wholetext=True).first()
    found = (yaml.safe_load(lines.value) if lines else None) or {}
    rows = [(c["name"], (c.get("question") or "").strip(), float(c.get("weight", 1.0))) for c in found.get("criteria") or []]
    if not rows:
        raise ValueError(f"no criteria in {path}")
    return spark.createDataFrame(rows, "name string, question string, weight double")


def packages(spark: SparkSession, path: str) -> DataFrame:
    """Metadata of the packages below ``path``, newest name first; broken files are left out."""
    rows = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").schema("run_id string, topic string, type string, files map<string,string>").json(f"{path}/*/metadata.json")
    return rows.orderBy(F.desc("run_id"))


def write_split(records: DataFrame, path: str) -> None:
    """JSON lines by split."""
    records.write.mode("overwrite").partitionBy("split").json(path)


def write_cleaned(chunks: DataFrame, path: str) -> dict[str, str]:
    """The cleaned corpus ``cleaned``, external chunks first, and ``external`` with those alone; the latter goes if there are none.

    Chunks are ordered by ranges, so that the files of a folder, in the order of their names, make up the corpus.
    """
    rows = chunking.cleaned_corpus(chunks)
    order = ["part", "doc_id", "chunk_no"]
    paths = {"cleaned": f"{path}/cleaned", "external": f"{path}/external"}
    rows.orderBy(*order).select("chunk").write.mode("overwrite").option("lineSep", "\n\n").text(paths["cleaned"])
    outer = rows.where("kind = 'external'")
    if outer.limit(1).count():
        outer.orderBy(*order).select("chunk").write.mode("overwrite").option("lineSep", "\n\n").text(paths["external"])
    else:
        remove(chunks.sparkSession, paths.pop("external"))
    return paths


def report_json(report: DataFrame, sources: DataFrame, best: DataFrame) -> DataFrame:
    """json: one row, the report with its breakdown by source and its best documents (twenty of them)."""
    by_source = sources.agg(F.array_sort(F.collect_list(F.struct(*sources.columns))).alias("source_breakdown"))  # a row for each source
    shown = best.agg(F.collect_list(F.struct(*best.columns)).alias("doc_stats"))
    return report.crossJoin(F.broadcast(by_source)).crossJoin(F.broadcast(shown)).select(F.to_json(F.struct("*")).alias("json"))  # one row each


def write_report(report: DataFrame, sources: DataFrame, best: DataFrame, path: str) -> None:
    """The report as one file of JSON."""
    report_json(report, sources, best).coalesce(1).write.mode("overwrite").text(path)


def metrics_summary(rows: DataFrame) -> DataFrame:
    """line: iteration, losses and topic of each row of metrics (all texts), unknown columns and nulls as ``?``, in aligned columns."""
    get = lambda c: F.coalesce(F.col(c), F.lit("?")) if c in rows.columns else F.lit("?")
    padded = lambda c, n: F.lpad(get(c), F.greatest(F.lit(n), F.length(get(c))), F.lit(" "))
    return rows.select(F.concat(F.lit("  iter "), padded("iteration", 3), F.lit("  val_loss="), padded("val_loss", 8), F.lit("  val_score="), padded("val_score", 6), F.lit("  topic="), get("topic")).alias("line"))


def flush_log(entries: DataFrame, path: str) -> None:
    """The whole state (key, hash, last_seen) as JSON lines, replacing what is there. The old state must not be read from ``path`` itself."""
    entries.select("key", "hash", "last_seen").write.mode("overwrite").json(path)
