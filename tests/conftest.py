import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from basketlab.session import build_session
    scratch = tempfile.mkdtemp(prefix="basketlab-tests-")
    s = build_session("local[4]", app="basketlab-tests", shuffle_partitions=8,
                      extra={"spark.checkpoint.dir": f"{scratch}/ckpt",
                             "spark.local.dir": f"{scratch}/local"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def scratch_dir():
    return tempfile.mkdtemp(prefix="basketlab-scratch-")
