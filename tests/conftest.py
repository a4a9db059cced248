import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from curveframe.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8")
    yield session
    session.stop()


@pytest.fixture
def raw(spark):
    """Raw documents from (document_id, file_name, content) triples."""

    def make(*documents):
        rows = [(key, name, len(text), text) for key, name, text in documents]
        return spark.createDataFrame(
            rows, "document_id string, file_name string, file_size_bytes bigint, content string"
        )

    return make
