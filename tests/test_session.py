"""Scratch tables: where they are written, and that they go."""

from pathlib import Path

import pytest

from waxmill.session import checkpoint_dir, materialize, scratch_scope


class Elsewhere:
    """A session on a cluster without a shared folder."""

    class conf:  # noqa: N801
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:  # noqa: N801
        master, applicationId = "spark://somewhere:7077", "app-1"


@pytest.mark.parametrize("master", ["spark://somewhere:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"])
def test_a_cluster_needs_a_shared_folder(master):
    Elsewhere.sparkContext.master = master
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(Elsewhere)


def test_the_named_folder_is_used(monkeypatch):
    monkeypatch.setattr(Elsewhere.conf, "get", staticmethod(lambda key, default=None: "hdfs://shared/x/"))
    assert checkpoint_dir(Elsewhere) == "hdfs://shared/x"


def test_scratch_goes_with_its_scope(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("waxmill.session.checkpoint_dir", lambda session: f"file://{tmp_path}")
    with scratch_scope():
        inside = materialize(spark.range(5), "inside")
        assert inside.count() == 5
        assert len(list(Path(tmp_path).iterdir())) == 1
    assert list(Path(tmp_path).iterdir()) == []


def test_outer_tables_stay(spark):
    outer = materialize(spark.range(3), "outer")
    with scratch_scope():
        materialize(outer, "inner")
    assert outer.count() == 3
