import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from caretally.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = str(tmp_path_factory.mktemp("warehouse"))
    session = local_session(4, shuffle_partitions=4, memory="4g", conf={"spark.sql.warehouse.dir": warehouse})
    yield session
    session.stop()


def rows(df, *order):
    """Rows as tuples, sorted with nulls first unless an order was asked for."""
    out = [tuple(r) for r in df.collect()]
    return out if order else sorted(out, key=lambda r: [(v is not None, str(type(v)), v) for v in r])


@pytest.fixture(scope="session")
def as_rows():
    return rows
