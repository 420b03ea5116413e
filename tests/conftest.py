"""One local session for all tests."""

from __future__ import annotations

import pytest

from tessera.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(cpus=4, memory="4g", checkpoints=str(tmp_path_factory.mktemp("checkpoints")))
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    return session
