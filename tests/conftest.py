import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from towerfill.session import get_spark
    s = get_spark("local[4]", shuffle_partitions=4, **{"spark.driver.memory": "8g"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tower_df(spark):
    from towerfill.fixtures import tower
    return tower(spark, SF).cache()
