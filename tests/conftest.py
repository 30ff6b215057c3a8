import os
import sys
from datetime import date, timedelta
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

from panelspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def d(n: int) -> date:
    """Day n of a test calendar."""
    return date(2021, 1, 1) + timedelta(days=n)


def rows(df, *cols):
    """Rows as sorted tuples, missing values last."""
    out = [tuple(r) for r in df.select(*cols).collect()]
    return sorted(out, key=lambda r: [(x is None, x) for x in r])
