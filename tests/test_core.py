"""The shared folder: who names it, and what is removed."""

import os

import pytest
from loomway.core import forget, materialize, scratch, shared_dir


class Far:
    """A session on a cluster that names no folder."""

    class conf:
        @staticmethod
        def get(key, default):
            return default

    class sparkContext:
        master = "spark://somewhere:7077"


def test_a_cluster_must_name_its_folder(spark):
    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        shared_dir(Far)
    assert shared_dir(spark)


def test_what_is_written_can_be_removed(spark):
    kept = materialize(spark.range(3))
    with scratch(spark):
        inner = materialize(spark.range(4))
        assert inner.count() == 4
    assert not os.path.exists(inner._loomway_path)
    assert kept.count() == 3
    forget(kept, spark.range(1), None)
    assert not os.path.exists(kept._loomway_path)
