from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))
# Callables defined in test modules are imported by name inside the tasks.
os.environ["PYTHONPATH"] = os.pathsep.join(
    [str(ROOT / "tests"), *filter(None, [os.environ.get("PYTHONPATH")])])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from topicloom.session import build_session

    session = build_session("topicloom-tests", **{
        "spark.master": "local[8]",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "6g",
        "spark.sql.shuffle.partitions": "4",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
