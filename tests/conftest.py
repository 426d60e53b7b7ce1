import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from seslog.session import local_session  # noqa: E402

FIXTURES = os.path.join(os.path.dirname(os.path.abspath(__file__)), "fixtures")


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "seslog-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def fixture_records(spark):
    from seslog.sources.logs import read_session_logs

    return read_session_logs(spark, FIXTURES)


@pytest.fixture(scope="session")
def fixture_events(fixture_records):
    from seslog.functions.staging import stage
    from seslog.operators.normalize import normalize

    return stage(normalize(fixture_records))


@pytest.fixture(scope="session")
def fixture_assembly(fixture_events):
    from seslog.operators.turns import assemble, slim_events

    return assemble(slim_events(fixture_events), block_size=3)
