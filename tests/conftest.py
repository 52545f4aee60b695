import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))


@pytest.fixture(scope="session")
def spark():
    from tracewright.session import local_session, ship

    spark = local_session(cores=4, memory="4g", name="tests")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    ship(spark)
    yield spark
    spark.stop()
