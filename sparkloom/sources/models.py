"""Calls of language models as an extension point: a provider by the model's name, retries, fences checked, a fallback without any model."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sparkloom.functions import rules

#: Waits between attempts where a provider's rate limit is hit.
RATE_WAITS = [15, 30, 60, 120]


def with_retries(call: Callable[[], str], retries: int = 3, base: float = 1.0, jitter: float = 0.3, sleep: Callable[[float], None] = time.sleep) -> str:
    """The result of ``call``, tried again after errors of the network with doubled waits; other errors pass through.

    >>> waits = []
    >>> def call():
    ...     if len(waits) < 2: raise ConnectionError("away")
    ...     return "there"
    >>> with_retries(call, jitter=0, sleep=waits.append), waits
    ('there', [1.0, 2.0])
    """
    for attempt in range(retries):
        try:
            return call()
        except OSError as error:
            if attempt + 1 == retries:
                raise RuntimeError(f"failed after {retries} attempts: {error}") from error
            sleep(max(0.1, base * 2**attempt + jitter * (0.5 - random.random())))
    raise ValueError("retries must be over 0")


def completed(df: DataFrame, prompt: str, model: Column, providers: dict[str, Callable[[str, str], str]], fallback: Column | None = None, attempts: int = 3, name: str = "reply") -> DataFrame:
    """``df`` with the reply to the column ``prompt`` and ``error`` (null where all went well).

    ``providers`` are functions of (model name, prompt) by provider, as ``rules.model_parts`` names it. A reply that leaves a code fence
    open is asked for again, up to ``attempts`` times. Rows without a provider, with a null prompt or whose call fails get ``fallback``.
    """
    parts = rules.model_parts(model)
    rows = df.withColumn("_provider", parts["provider"]).withColumn("_name", parts["name"]).withColumn("_fallback", fallback if fallback is not None else F.lit(None).cast("string"))
    schema = StructType([*(StructField(f.name, f.dataType) for f in df.schema if f.name not in (name, "error")), StructField(name, StringType()), StructField("error", StringType())])
    packed = cloudpickle.dumps(providers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = cloudpickle.loads(packed)
        for batch in batches:
            data = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            replies, errors = [], []
            for provider, model_name, asked, other in zip(*(data[c].to_pylist() for c in ("_provider", "_name", prompt, "_fallback"))):
                reply, error = None, None
                call = known.get(provider)
                if call is not None and asked is not None:
                    try:
                        for _ in range(attempts):
                            reply = with_retries(lambda: call(model_name, asked))  # noqa: B023
                            if reply.count("```") % 2 == 0:
                                break
                    except Exception as failure:  # noqa: BLE001  a failed call is told in its row
                        reply, error = None, str(failure)
                replies.append(other if reply is None else reply)
                errors.append(error)
            kept = [data[f.name] for f in schema if f.name not in (name, "error")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(replies, pa.string()), pa.array(errors, pa.string())], names=[*(f.name for f in schema if f.name not in (name, "error")), name, "error"])

    return rows.mapInArrow(run, schema)


def best_model(available: dict[str, Callable[[], bool]]) -> str | None:
    """The first model, in the order given, whose check holds; a check that fails counts as no.

    >>> best_model({"a": lambda: 1 / 0, "b": lambda: False, "c": lambda: True})
    'c'
    """
    for model, check in available.items():
        try:
            if check():
                return model
        except Exception:  # noqa: BLE001  an unreachable service is not available
            continue
    return None
