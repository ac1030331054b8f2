"""Intermediate tables: where they go, and that they go away."""

import os
from types import SimpleNamespace

import pytest

from rastermill.sources import shared


def test_tables_are_deleted_when_nothing_needs_them(spark):
    def there(name):
        return [f for f in os.listdir(shared.shared_dir(spark).removeprefix("file:")) if f.startswith(f"rastermill-{name}")]

    mark = shared.written(spark)
    a = shared.save(spark.range(10), f"a{os.getpid()}")
    b = shared.save(a.where("id > 5"), f"b{os.getpid()}")
    assert len(there(f"a{os.getpid()}")) == 1
    shared.drop_since(spark, mark, keep=b)
    assert b.count() == 4 and shared.written(spark) == mark + 1 and not there(f"a{os.getpid()}")
    shared.drop(b, spark.range(1))
    assert shared.written(spark) == mark and not there(f"b{os.getpid()}")


def test_a_cluster_must_name_its_folder():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="x"))
    with pytest.raises(ValueError):
        shared.shared_dir(session)
