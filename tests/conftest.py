import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from driftmark.session import get_spark


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="driftmark-test-")})
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def micro(spark):
    rows = [(1, "The cat sat. The cat ran!", 0), (2, "A model may run, however fast.", 1), (3, "the model ran", 1),
            (4, "cat model", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(2)
