import os
import sys
import warnings

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
warnings.simplefilter("ignore")

from edgeloom.session import local_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, 4)
    s.sparkContext.setLogLevel("ERROR")
    ship_package(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def wide(spark):
    def make(x):
        rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)]
        return spark.createDataFrame(rows, "row_id BIGINT, x ARRAY<DOUBLE>").repartition(3)

    return make
