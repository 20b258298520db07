import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from turnloom.scaling import session  # noqa: E402

# Column expressions need a running session, also while test modules are imported.
_SPARK = session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
                                        "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
_SPARK.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    yield _SPARK
    _SPARK.stop()


@pytest.fixture
def one(spark):
    """Evaluate expressions on single texts: ``one(expression, text, …)`` gives the list of values."""
    def evaluate(expression, *texts):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, text STRING")
        return [r[1] for r in sorted(rows.select("i", expression.alias("v")).collect(), key=lambda r: r[0])]
    return evaluate
