import uuid

import pytest


@pytest.fixture
def reread(spark, tmp_path):
    """Writes rows as Parquet and reads them back, as operators get their tables."""

    def make(rows, schema, parts=2):
        path = str(tmp_path / uuid.uuid4().hex)
        spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
        return spark.read.parquet(path)

    return make


def pytest_configure(config):
    config.addinivalue_line("markers", "slow: longer tests")


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = "id long, row long, fp long, node long, label long, key string, kept boolean, n_words int, component long, digest string, total long, _llm_row int, _text string"
