import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from lumberline.session import SETTINGS

    builder = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for k, v in SETTINGS.items():
        builder = builder.config(k, v)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def entries(spark):
    """Logs from tuples (ts, host, severity, message[, fields[, app]]), ids in order from 1."""
    from lumberline.model import LOGS

    def make(rows):
        full = [(i, r[0], r[1], r[5] if len(r) > 5 else "app", r[2], r[3], r[4] if len(r) > 4 else None) for i, r in enumerate(rows, 1)]
        return spark.createDataFrame(full, LOGS)

    return make
