import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import lineward  # noqa: E402
import registry  # noqa: E402
from lineward.session import local_session  # noqa: E402

cloudpickle.register_pickle_by_value(lineward)
cloudpickle.register_pickle_by_value(registry)


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores="8", memory="8g")
    yield session
    session.stop()
