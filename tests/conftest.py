from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from sparkguard.session import local_session, shared_dir  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "tests", "8g")
    shared_dir(session)
    yield session
    session.stop()


@pytest.fixture()
def folder(tmp_path):
    """Fresh folders by name."""
    return lambda name: str(tmp_path / name)
