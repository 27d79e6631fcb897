import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))

from lynceus.operators.ordering import ROWS_SETTING  # noqa: E402
from lynceus.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("lynceus-tests", "local[8]", spark__sql__shuffle__partitions="4",
                            spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                            spark__driver__memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def small_tasks(spark):
    """Pretend that a task holds few rows, so that the paths for large data run."""
    def use(rows: int):
        spark.conf.set(ROWS_SETTING, str(rows))
    yield use
    spark.conf.unset(ROWS_SETTING)
