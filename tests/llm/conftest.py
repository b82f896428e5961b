import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def sf():
    return SF


@pytest.fixture()
def frame(spark):
    """frame(rows, schema) with the given rows, in two partitions."""
    def make(rows, schema):
        return spark.createDataFrame(rows, schema).repartition(2)
    return make


assert os.path.isdir(SF)
