"""Deliverables: which files a topic or an input calls for, and their Markdown."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import fixed, rules, text
from sparkloom.operators import extraction


def deliverables(spark: SparkSession) -> DataFrame:
    """class, place, file, sections, template, generated for every file of every class: a fixed table of a few rows."""
    rows = [(name, i, file, sections.get(file, []), fixed.TEMPLATES.get(file, "summary.jinja2"), file in fixed.TEMPLATES) for name, files, sections in fixed.DELIVERABLES for i, file in enumerate(files)]
    return spark.createDataFrame(rows, "class string, place int, file string, sections array<string>, template string, generated boolean")


def input_class_or_topic(body: Column, topic: Column) -> Column:
    """The class of the input; for plain text that of the topic."""
    found = rules.input_class(body)
    return F.when(found == "text", rules.topic_class(topic)).otherwise(found)


def package(docs: DataFrame, key: str, topic: str, body: str) -> DataFrame:
    """key, class, place, file, generated: the files that each document's package consists of."""
    rows = docs.select(key, input_class_or_topic(F.col(body), F.col(topic)).alias("class"))
    table = F.broadcast(deliverables(docs.sparkSession).select("class", "place", "file", "generated"))  # 39 rows
    return rows.join(table, "class").select(key, "class", "place", "file", "generated")


def template(template: Column) -> Column:
    """Template of a file; that of the summary for unknown ones."""
    known = F.create_map(*(F.lit(x) for pair in fixed.TEMPLATES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, template), F.lit("summary.jinja2"))


def report(file: str, topic: Column, found: Column, header: list[tuple[str, Column]], extra: list[str] = (), files: Column | None = None) -> Column:
    """One report of ``fixed.REPORTS`` as Markdown from the map ``found`` of sections.

    ``header`` are its bold lines, ``extra`` the headings that the class of the topic adds, ``files`` the files of the package. A section
    that was not found says so; a heading marked as optional is left out without one.
    """
    title, slots = next((t, x) for f, t, x in fixed.REPORTS if f == file)
    part = lambda heading, names: F.concat(F.lit(f"## {heading}\n\n"), extraction.first_section(found, names, fixed.NO_CONTENT))
    parts: list[Column] = [F.concat(F.lit(f"# {title}: "), topic), F.concat_ws("\n", *(F.concat(F.lit(f"**{name}:** "), value) for name, value in header)), F.lit("---")]
    for heading, names in slots:
        if heading == "+extra":
            parts += [part(h, [h]) for h in extra]
        elif heading == "+files":
            listed = F.transform(files if files is not None else F.array(), lambda f: F.concat(F.lit("- **"), f, F.lit("**"), F.when(f == file, " — this file").otherwise("")))
            parts.append(F.concat(F.lit("## Deliverables in This Package\n\n"), F.array_join(listed, "\n")))
        elif heading[0] == "?":
            parts.append(F.when(F.coalesce(extraction.first_section(found, names, ""), F.lit("")) != "", part(heading[1:], names)))  # nulls are left out by concat_ws
        else:
            parts.append(part(heading, names))
    return F.concat_ws("\n\n", *parts, F.lit("---\n"))


def reports(rows: DataFrame, key: str, topic: str, body: str, header: list[tuple[str, Column]] = ()) -> DataFrame:
    """key, class, place, file, content of every file that has a report, for every row: its class by input or topic, sections by headings.

    All of it are column expressions over one pass: each row's files are exploded with their contents.
    """
    placed = rows.select("*", input_class_or_topic(F.col(body), F.col(topic)).alias("_class"), extraction.sections(F.col(body)).alias("_found"))
    made = None
    for name, files, sections in fixed.DELIVERABLES:
        listed = F.array(*map(F.lit, files))
        pages = [F.struct(F.lit(i).alias("place"), F.lit(f).alias("file"), report(f, F.col(topic), F.col("_found"), list(header), sections.get(f, []), listed).alias("content")) for i, f in enumerate(files) if f in fixed.TEMPLATES]
        if pages:
            made = F.when(F.col("_class") == name, F.array(*pages)) if made is None else made.when(F.col("_class") == name, F.array(*pages))
    return placed.select(key, F.col("_class").alias("class"), F.explode(made).alias("_p")).select(key, "class", "_p.place", "_p.file", "_p.content")


def suggestions(topic: Column, body: Column) -> Column:
    """Report on a text without a model: its concepts, its code, and stubs for the techniques it names."""
    found = F.slice(extraction.concepts(body), 1, 8)
    numbered = F.array_join(F.transform(found, lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c)), "\n")
    blocks = extraction.code_blocks(body)
    code = F.array_join(F.transform(blocks, lambda b, i: F.concat(F.lit("### Example "), (i + 1).cast("string"), F.lit("\n\n```"), b["language"], F.lit("\n"), b["code"], F.lit("\n```"))), "\n\n")
    low = F.lower(body)
    made = [F.when(F.contains(low, F.lit(word)), F.lit(f"### {label}\n\n```python\n# Pattern: {label}\n{fixed.STUBS[word]}\n\ndef {re.sub('[^a-z0-9]+', '_', label.lower()).strip('_')}():\n    raise NotImplementedError\n```")) for word, label in fixed.DOMAINS]
    stubs = F.array_join(F.slice(F.array_compact(F.array(*made)), 1, 4), "\n\n")
    section = lambda heading, text_: F.when(text_ != "", F.concat(F.lit(f"## {heading}\n\n"), text_))
    return F.concat_ws(
        "\n\n", F.concat(F.lit("# Code Suggestions (heuristic): "), topic), section("Key Concepts", numbered), F.concat(F.lit("## Code\n\n"), F.when(code == "", "_No fenced code blocks found._").otherwise(code)), section("Stubs for Detected Patterns", stubs)
    )


def program(name: Column, topic: Column, objective: Column, goals: Column, steps: Column) -> Column:
    """A research programme as Markdown: goals as bullets, steps numbered."""
    bullets = F.array_join(F.transform(goals, lambda g: F.concat(F.lit("- "), g)), "\n")
    numbers = F.array_join(F.transform(steps, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n")
    return F.concat(F.lit("# "), name, F.lit("\n\n## Topic\n"), topic, F.lit("\n\n## Objective\n"), objective, F.lit("\n\n## Goals\n"), bullets, F.lit("\n\n## Steps\n"), numbers, F.lit("\n"))


PROGRAM = "name string, topic string, objective string, goals array<string>, steps array<string>"


def register(programs: DataFrame, new: DataFrame) -> DataFrame:
    """The registry of programmes (``PROGRAM``) with ``new`` ones, which replace those of the same name."""
    columns = [c.split()[0] for c in PROGRAM.split(", ")]
    return programs.select(columns).join(new.select("name"), "name", "left_anti").unionByName(new.select(columns))


def programmes(asked: DataFrame, programs: DataFrame, goals: list[str], steps: list[str]) -> DataFrame:
    """asked, markdown of every name in ``asked`` (asked): the registered programme, else one made for that topic with ``goals`` and ``steps``."""
    rows = asked.select("asked").distinct().join(programs.withColumnRenamed("name", "asked"), "asked", "left")
    known = F.col("topic").isNotNull()
    pick = lambda c, other: F.when(known, F.col(c)).otherwise(other)
    made = program(pick("asked", text.program_slug(F.col("asked"))), pick("topic", F.col("asked")), pick("objective", F.concat(F.lit("Collect and combine what is known about "), "asked", F.lit("."))), pick("goals", F.array(*map(F.lit, goals))), pick("steps", F.array(*map(F.lit, steps))))
    return rows.select("asked", made.alias("markdown"))


def generate(rows: DataFrame, generators: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Contents of the files in ``rows`` (key, file, …) from one function by file; files without one are left out."""
    made = [f(rows.where(F.col("file") == name)) for name, f in generators.items()]
    if not made:
        return rows.limit(0)
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def write(contents: DataFrame, meta: DataFrame, path: str) -> None:
    """Packages below ``path``: ``<run_id>/<file>`` in Markdown, and ``<run_id>/metadata.json``.

    ``contents`` has run_id, file, content (null where its generator failed) and error; ``meta`` has run_id, topic, type. Files are
    written by the tasks that hold them, through temporary names, so a task run again leaves no half file.
    """
    files = contents.groupBy("run_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("content").isNotNull(), F.struct("file", F.col("file").alias("path")))))).alias("files"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("content").isNull(), F.struct("file", "error"))))).alias("errors"),
    )
    described = meta.join(files, "run_id").select("run_id", F.lit("metadata.json").alias("file"), F.to_json(F.struct("run_id", "topic", "type", "files", "errors")).alias("content"))
    rows = contents.where("content is not null").select("run_id", "file", "content").unionByName(described)
    rows.mapInArrow(_writer(path.rstrip("/")), "file string").write.format("noop").mode("overwrite").save()


def _writer(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        for batch in batches:
            names = []
            for row in batch.to_pylist():
                where = f"{base}/{row['run_id']}/{row['file']}"
                system.create_dir(where.rsplit("/", 1)[0], recursive=True)
                part = f"{where}.{uuid.uuid4().hex}.part"
                with system.open_output_stream(part) as out:
                    out.write(row["content"].encode())
                system.move(part, where)
                names.append(where)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["file"])

    return run


def run_name(topic: Column, stamp: Column) -> Column:
    """Slug of the topic and a time stamp."""
    return F.concat(text.slug(topic), F.lit("-"), F.date_format(stamp, "yyyyMMdd-HHmmss"))
