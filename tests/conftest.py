from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from areametrics.session import session

    s = session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="6g",
        spark__ui__enabled="false",
        spark__sql__warehouse__dir=tempfile.mkdtemp(prefix="areametrics-wh-"),
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
