from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from metricloom.session import STATE_STORE, build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        app="tests",
        master="local[8]",
        conf={
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def series(spark):
    """Metric frame from lists: ``series({"loss": [..]}, run_id="r")``."""
    import datetime as dt

    import pandas as pd

    def make(values: dict[str, list], run_id: str = "r", steps: dict[str, list] | None = None):
        rows = []
        start = dt.datetime(2024, 1, 1)
        for name, points in values.items():
            at = (steps or {}).get(name, range(len(points)))
            for s, v in zip(at, points):
                rows.append((run_id, name, None if v is None else float(v), int(s), start + dt.timedelta(seconds=int(s))))
        return spark.createDataFrame(
            rows, "run_id string, name string, value double, step long, timestamp timestamp"
        ).repartition(3)

    return make


def rows_of(df, *order):
    """Rows as plain tuples, sorted."""
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple(str(x) for x in t))
