"""One local session for all tests."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from voxloom.session import local_session

    session = local_session(4, 4, "4g", spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")), spark__sql__autoBroadcastJoinThreshold="256k")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small() -> str:
    return "/root/testdata/sf0.001"
