"""Intermediate tables."""

import pytest

from codeloom.plans.storage import scratch, shared_dir


def test_scratch_tables_go(spark, tmp_path):
    with scratch(spark) as put:
        kept = put(spark.range(5), "a")
        assert kept.count() == 5
        (path,) = {f.rsplit("/", 1)[0] for f in kept.inputFiles()}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
