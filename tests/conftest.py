import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from medallion.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(shuffle_partitions=4, app="tests")
    yield session
    session.stop()


@pytest.fixture
def layout(tmp_path):
    from medallion.spec import Layout

    return Layout(str(tmp_path), "medical")


def rows(df):
    """Rows as sorted tuples; NULLs sort first."""
    return sorted((tuple(r) for r in df.collect()),
                  key=lambda r: tuple((v is not None, v) for v in r))
