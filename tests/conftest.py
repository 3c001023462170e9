import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from storefront.session import build_session
    s = build_session(master="local[*]", shuffle_partitions=8, driver_memory="4g",
                      checkpoint_dir=str(tmp_path_factory.mktemp("checkpoints")))
    yield s


@pytest.fixture(scope="session")
def seed(spark):
    from seed_data import seed_tables
    return seed_tables(spark)
