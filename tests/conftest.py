import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from markloom.session import local_session

    folder = tmp_path_factory.mktemp("spark")
    session = local_session(4, 4, "4g", **{"spark.sql.warehouse.dir": str(folder / "warehouse"), "spark.checkpoint.dir": str(folder / "shared"), "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
