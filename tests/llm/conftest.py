import uuid

import pytest


@pytest.fixture
def docs(spark):
    """Small documents from texts, with null and clashing extra columns."""

    def make(texts, **more):
        rows = [(i, t, None, f"src{i % 3}", None) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")

    return make


@pytest.fixture
def folder(spark, tmp_path):
    """Writes tables below a new folder and returns its path."""

    def make(**tables):
        path = f"{tmp_path}/{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{path}/{name}.parquet")
        return path

    return make
