import os
import sys

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

import pytest  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from ostra.session import checkpoint_dir, local_session, ship

    session = local_session("tests")
    checkpoint_dir(session)
    ship(session)
    return session
