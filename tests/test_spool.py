import os

import pytest

from corvata.sources import spool as s


def test_scratch_deletes_all_but_what_is_kept(spark):
    with s.scratch(spark) as outer:
        with s.scratch(spark) as keep:
            _, gone = s.spool(spark.range(3).toDF("x"), "gone")
            kept, path = s.spool(spark.range(4).toDF("x"), "kept")
            keep.append(path)
        assert kept.count() == 4 and not os.path.exists(gone.removeprefix("file://"))
        outer.append(path)
    assert kept.count() == 4
    s.discard(spark, path)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://one:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(RuntimeError):
        s.shared_dir(Session())
