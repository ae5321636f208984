import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from threadlens.session import get_spark

    scratch = tempfile.mkdtemp(prefix="threadlens-tests-")
    s = get_spark(
        "local[4]",
        app_name="threadlens-tests",
        shuffle_partitions=4,
        extra_conf={
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
            "spark.default.parallelism": "4",
        },
    )
    yield s


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="threadlens-case-")
