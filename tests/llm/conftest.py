import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fixtures import documents  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    return documents(spark).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return documents(spark, [])
