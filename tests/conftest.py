import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from millrace.session import checkpoint_dir, get_spark, ship_package
    s = get_spark("millrace-tests", master="local[4]", shuffle_partitions=4)
    checkpoint_dir(s)
    ship_package(s)
    yield s
    s.stop()


@pytest.fixture()
def tmp(tmp_path_factory):
    return str(tmp_path_factory.mktemp("run"))


@pytest.fixture(scope="session")
def smoke_dir():
    return "/root/testdata/sf0.001"
