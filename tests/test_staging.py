"""Staged tables: written once, read back, removable."""

from __future__ import annotations

from logfold.staging import clear_staged, stage


def test_stage_and_clear(spark, tmp_path):
    base = str(tmp_path / "ckpt")
    df = spark.range(100).selectExpr("id", "id * 2 AS twice")
    staged = stage(df, "t", base=base)
    assert staged.count() == 100 and staged.filter("twice = 10").first().id == 5
    assert (tmp_path / "ckpt" / "logfold").exists()
    assert clear_staged(spark, base=base)
    assert not (tmp_path / "ckpt" / "logfold").exists()


def test_no_local_fallback_on_a_cluster():
    import pytest

    from logfold.session import ensure_checkpoint_dir

    class Ctx:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext = Ctx()
        conf = Conf()

    with pytest.raises(RuntimeError, match="shared folder"):
        ensure_checkpoint_dir(Session())


def test_run_removes_only_its_own_tables(spark, tmp_path):
    from logfold.staging import staging_run

    base = str(tmp_path / "shared")
    other = stage(spark.range(3), "other", base=base)
    with staging_run(spark, base) as folder:
        own = stage(spark.range(5), "own")
        assert own.count() == 5 and folder in own.inputFiles()[0]
    assert other.count() == 3
    assert [p.name[:5] for p in (tmp_path / "shared" / "logfold").iterdir()] == ["other"]
