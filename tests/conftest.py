from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pactlane.plans.registry import tune
    from pactlane.session import local_session

    session = local_session("4", "tests", 4)
    tune(session)
    return session
