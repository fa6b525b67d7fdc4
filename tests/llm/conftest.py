import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from tallyspark.llm import common  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True)
def prepared(spark):
    common.prepare(spark)


@pytest.fixture
def docs(spark):
    """rows of (doc_id, text) as a documents table; ``extra`` adds columns with clashing names."""

    def make(rows, extra=()):
        schema = SCHEMA + "".join(f", `{c}` string" for c in extra)
        data = [(i, t, "en", "s0", None if t is None else len(t), *("x" for _ in extra)) for i, t in rows]
        return spark.createDataFrame(data, schema)
    return make


#: ids and texts that every operator must take: nulls, empty and blank texts, repeated rows, one id for two texts, long
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (4, "two words"), (None, "no id here"), (None, None),
       (5, "long " * 30_000), (6, "Ünïcödé ßtring　wide space \U0001f600 end"), (7, "a\x00b \x1f c")]
