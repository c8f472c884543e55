import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from docketry.session import build_session  # noqa: E402


# Started on import: column expressions in test modules need a session.
SESSION = build_session(
    "docketry-tests", "local[8]",
    **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
)
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    return SESSION


@pytest.fixture
def one(spark):
    """Evaluate a column expression over named text values: ``one(expr, a="x")``."""

    def run(expr, **values):
        names = list(values) or ["_"]
        row = tuple(values.get(n) for n in names)
        schema = ", ".join(f"{n} string" for n in names)
        return spark.createDataFrame([row], schema).select(expr.alias("out")).first()["out"]

    return run
