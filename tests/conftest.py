import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from quarry.session import local_session, ship_package

    s = local_session(cores=4, shuffle_partitions=4, app="quarry-tests")
    ship_package(s)
    yield s
    s.stop()


@pytest.fixture()
def tmp_table(spark):
    from quarry.session import work_path

    return lambda name: work_path(spark, name)
