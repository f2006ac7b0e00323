import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from ratewise.session import get_spark
    import tempfile
    s = get_spark("local[4]", app="ratewise-tests", shuffle_partitions=8,
                  **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="ratewise-tests-")})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small_dir():
    return SMALL


@pytest.fixture(scope="session")
def bookings_small(spark):
    from ratewise.sources.bookings import bookings
    from ratewise.session import cut_lineage
    return cut_lineage(bookings(spark, SMALL))
