import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from nearfold.session import local_session

    s = local_session(4, shuffle_partitions=8)
    yield s


@pytest.fixture(scope="session")
def toy(spark):
    """the ten 3-d rows, ids 1..10 in insertion order."""
    # The toy table's vectors in id order.
    vecs = [[4, 5, 6], [1, 2, 3], [28, 29, 30], [7, 8, 9], [22, 23, 24], [16, 17, 18], [19, 20, 21],
            [10, 11, 12], [25, 26, 27], [13, 14, 15]]
    rows = [(i + 1, [float(x) for x in v]) for i, v in enumerate(vecs)]
    return spark.createDataFrame(rows, "id bigint, embedding array<float>")
