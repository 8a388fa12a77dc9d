"""One local session for all tests."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lithospark.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    made = session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="4g"
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
