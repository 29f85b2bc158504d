import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from taxomatch.session import local_session  # noqa: E402

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture()
def scratch(spark, request):
    """A fresh folder under the checkpoint folder of the session."""
    import uuid

    from taxomatch.session import scratch_path

    return scratch_path(spark, f"test-{request.node.name}-{uuid.uuid4().hex[:8]}")
