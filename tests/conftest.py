import sys
import tempfile
from pathlib import Path

import pytest
from pyspark import cloudpickle

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


def pytest_collection_modifyitems(items):
    # Providers defined in a test module must reach the workers with their code.
    for module in {item.module for item in items}:
        cloudpickle.register_pickle_by_value(module)


@pytest.fixture(scope="session")
def spark():
    from quillrank.session import build_session

    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="run-"),
        spark__driver__memory="8g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
