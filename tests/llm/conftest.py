import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from edge_rows import CLASH, documents  # noqa: E402


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string, n_chars long, " + CLASH).repartition(3)


@pytest.fixture(scope="session")
def none(edge):
    return edge.filter("doc_id > 100")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(12)] + [(None, 1, 1), (3, None, None), (2, 1, 1)], "doc_id long, quality int, toxic int")
