import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tests_llm_corpus import IDS_AND_TEXTS, corpus  # noqa: E402


@pytest.fixture(scope="session")
def small(spark):
    """(rows, frame): the corpus, over several partitions."""
    rows = corpus()
    return rows, spark.createDataFrame(rows, IDS_AND_TEXTS).repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], IDS_AND_TEXTS)
