import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from wardlake.model import FILES_SCHEMA  # noqa: E402
from wardlake.session import session_builder  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    settings = {
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "4g",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    session = session_builder("tests", **settings).master("local[4]").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def corpus_of(spark):
    """File rows from ``{path: content}``, or ``{(repo, path): content}``."""

    def build(files):
        rows = []
        for key, content in files.items():
            repo, path = key if isinstance(key, tuple) else ("r", key)
            rows.append((repo, path, len(content.encode()), content))
        return spark.createDataFrame(rows, FILES_SCHEMA)

    return build
