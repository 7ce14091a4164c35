import pathlib
import sys
from datetime import datetime, timedelta, timezone

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
from settlegrid.session import build_session  # noqa: E402

PANEL = "series string, pos int, ts timestamp, value double, source string"


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
                      spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def make_panel(spark):
    """Panel rows from {series: values}; None and NaN are gaps."""
    def build(columns, start="2022-06-01T00:00:00"):
        t0 = datetime.fromisoformat(start).replace(tzinfo=timezone.utc)
        rows = []
        for series, values in columns.items():
            for i, v in enumerate(values):
                v = None if v is None or v != v else float(v)
                rows.append((series, i, t0 + timedelta(minutes=30 * i), v, "missing" if v is None else "observed_import"))
        return spark.createDataFrame(rows, PANEL)
    return build
