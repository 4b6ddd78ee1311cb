from types import SimpleNamespace

import pytest

from lacuna.session import materialize, shared_dir


def test_shared_folder_is_the_sessions_own(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    df = materialize(spark.range(3), "rows")
    assert df.count() == 3 and df.inputFiles()[0].startswith(shared_dir(spark))


def test_a_folder_of_our_own_where_it_is_unset():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default), sparkContext=SimpleNamespace(master="local[2]"))
    first = shared_dir(session)
    assert first.startswith("file:///") and shared_dir(session) == first


def test_a_cluster_needs_the_shared_folder():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default), sparkContext=SimpleNamespace(master="spark://driver:7077"))
    with pytest.raises(ValueError):
        shared_dir(session)
