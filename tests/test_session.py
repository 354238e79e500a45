"""Where intermediate tables go."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from sift.session import working_folder


def session(master, folder=None):
    conf = SimpleNamespace(get=lambda name, default: folder or default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_the_shared_folder_is_used_where_it_is_named():
    for master in ("local[4]", "yarn", "local-cluster[3,2,1000]", "k8s://x"):
        assert working_folder(session(master, "hdfs://x/shared/")) == "hdfs://x/shared"


def test_a_cluster_without_one_is_refused():
    for master in ("yarn", "spark://a:7077", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError):
            working_folder(session(master))
    assert working_folder(session("local")) != working_folder(session("local[*]"))
