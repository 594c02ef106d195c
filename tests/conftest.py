import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from larkspur.session import session

    spark = session("local[4]", 4)
    spark.sparkContext.setLogLevel("ERROR")
    return spark
