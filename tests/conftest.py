import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pdwatch.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def labelled(spark):
    """Ten labelled scores with known metrics."""
    scores = [0.05, 0.10, 0.15, 0.20, 0.30, 0.45, 0.55, 0.65, 0.80, 0.90]
    labels = [0, 0, 0, 0, 0, 1, 0, 1, 1, 1]
    rows = [(str(1001 + i), p, y) for i, (p, y) in enumerate(zip(scores, labels))]
    return spark.createDataFrame(rows, "application_id string, predicted_probability double, actual_default int")


@pytest.fixture(scope="session")
def calibration_rows(spark):
    scores = [0.05, 0.10, 0.20, 0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90]
    labels = [0, 0, 0, 1, 0, 1, 1, 0, 1, 1]
    rows = [(str(i), p, y) for i, (p, y) in enumerate(zip(scores, labels))]
    return spark.createDataFrame(rows, "application_id string, predicted_probability double, actual_default int")
