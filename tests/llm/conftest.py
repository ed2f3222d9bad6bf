"""Fixtures of the llm tests: documents with every odd case, no documents, a given table."""
import os
import sys

import pytest

from docfields.llm.common import read

sys.path.insert(0, os.path.dirname(__file__))

from llm_models import ROWS, SF  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    """Edge-case documents with columns whose names clash with the operators' own."""
    data = [(i, t, "en", f"src{k % 3}", len(t or ""), "x", k, None) for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(
        data, "doc_id long, text string, lang string, source string, n_chars long, tkey string, row int, spans string"
    ).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def docs(spark):
    return read(spark, SF, "documents").limit(10_000)


@pytest.fixture(scope="session")
def labels(spark):
    return read(spark, SF, "labels")
