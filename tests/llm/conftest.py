import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [HERE, os.path.dirname(HERE), os.path.dirname(os.path.dirname(HERE))]

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def table(spark):
    """Documents from (doc_id, text) pairs, with the other columns of the table."""

    def make(rows):
        return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], DOCUMENT).repartition(3)

    return make
