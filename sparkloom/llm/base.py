"""What the training-data operators have in common: running chunk functions over texts, reading tables, sites."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from sparkloom.llm import textkernel
from sparkloom.shared import spread

#: Fewer lines, fingerprints or rules than this are broadcast; beyond it the same rows are joined by a shuffle.
BROADCAST_ROWS = 100_000


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the input folder; one small file is spread over all cores."""
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))


def map_chunks(df: DataFrame, text: str, schema: str, function: Callable[[dict], dict], size: int = 600_000) -> DataFrame:
    """Run ``function`` on chunks of rows holding about ``size`` characters of the column ``text``.

    The function gets lists by column name and returns arrays or lists by column of ``schema``.
    A text longer than ``size`` makes up a chunk alone; it is never cut.
    """
    parsed = _parse_datatype_string(schema)
    assert isinstance(parsed, StructType)
    arrow = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
            for a, b in textkernel.chunks(data[text], size):
                out = function({k: v[a:b] for k, v in data.items()})
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in ((out[f.name], f) for f in arrow)], schema=arrow)

    return df.mapInArrow(run, parsed)


def site(url: str = "url", source: str = "source") -> Column:
    """Host of the url in lower case, without ``www.`` and port; the trimmed lower-case source where there is no web address.

    A row without url and source belongs to the site ``''``.
    """
    address = F.lower(F.trim(F.coalesce(F.col(url), F.lit(""))))
    host = F.regexp_extract(address, r"^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)", 1)
    bare = F.regexp_extract(address, r"^(?:www\.)?([^/?#:]*)", 1)
    origin = F.lower(F.trim(F.coalesce(F.col(source), F.lit(""))))
    return F.when((address == "") | address.startswith("file:"), origin).otherwise(F.when(host != "", host).otherwise(bare))


def documents(df: DataFrame, *columns: str) -> DataFrame:
    """The columns used of ``df``, rows without an id left out; extra columns don't matter."""
    key = columns[0]
    return df.select(*columns).where(F.col(key).isNotNull())
