import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from vitrina.session import builder  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = builder("tests", "local[8]").config("spark.sql.shuffle.partitions", "8").config(
        "spark.driver.memory", "6g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s
