import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from sparkloom import session

    made = session.local(4, "4g")
    made.sparkContext.setLogLevel("ERROR")
    made.conf.set("spark.sql.shuffle.partitions", "4")
    return made


@pytest.fixture(scope="session")
def bare_tables(tmp_path_factory):
    """Two folders of all tables: without rows, and with rows of nulls beside two real rows of which one is there twice."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    source = Path("/root/testdata/sf0.001")
    if not source.exists():
        pytest.skip("no test tables")
    empty, nulls = tmp_path_factory.mktemp("empty"), tmp_path_factory.mktemp("nulls")
    for path in source.glob("*.parquet"):
        table = pq.read_table(path)
        schema = pa.schema([pa.field(f.name, f.type) for f in table.schema])
        pq.write_table(table.slice(0, 0), empty / path.name)
        rows = pa.table([pa.nulls(3, f.type) for f in schema], schema=schema)
        pq.write_table(pa.concat_tables([rows, table.slice(0, 2).cast(schema), table.slice(0, 1).cast(schema)]), nulls / path.name)
    return [str(empty), str(nulls)]
