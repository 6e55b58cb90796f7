import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

#: Rows that every operator must take: nulls, empty, blank and long texts, repeats, ties, odd signs.
EDGE = [(1, None), (2, ""), (3, " \t\n "), (4, "x" * 300_000), (5, "same line of eight words stands here twice\n" * 3), (5, "same line of eight words stands here twice\n" * 3), (6, "!" * 5000), (7, "héllo wörld ñandú 日本語"), (None, "no id but a text of a few words"), (8, "no id but a text of a few words")]


@pytest.fixture(scope="session")
def edge(spark):
    """EDGE with extra columns whose names the operators use inside."""
    cols = "doc_id long, text string, lang string, source string, n_chars long, cls string, line string, bucket string, word string, key string, held_out string, label string, score string, _d string, _gone string, _all string, _text string, _id string, line_gone string, line_all string, component_own_id string, sample_rate string"
    return spark.createDataFrame([(i, t, None, "s", 1, *["z"] * 17) for i, t in EDGE], cols)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)
