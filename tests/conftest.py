import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from webreach.session import get_spark
    s = get_spark("local[4]", shuffle_partitions=8, app_name="webreach-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def one_col(spark, values, name="v", dtype="string"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {dtype}")
