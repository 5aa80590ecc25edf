from pathlib import Path

from chronolex import scratch


def test_only_its_own_tables_are_deleted(spark, tmp_path, monkeypatch):
    root = tmp_path / "chronolex" / "ckpt"
    root.mkdir(parents=True)
    (root / "theirs").mkdir()
    (root / "theirs" / "x").write_text("x")
    monkeypatch.setattr(scratch, "folder", lambda s: str(root))
    a, b = scratch.written(spark.range(3), "a"), scratch.written(spark.range(4), "b", partition_by=None)
    scratch.drop(a)
    scratch.drop(spark.read.parquet(b._scratch_path))  # not the frame that written() gave
    scratch.delete(spark, str(root))
    scratch.delete(spark, str(root / "theirs"))
    assert not Path(a._scratch_path).exists() and b.count() == 4 and (root / "theirs" / "x").exists()

    def build():
        return scratch.written(scratch.written(spark.range(5), "one").where("id > 1"), "two").where("id > 2")

    out = scratch.settled(build, "out")
    assert {p.name.split("-")[0] for p in (root / "chronolex").iterdir()} == {"b", "out"} and out.count() == 2
    scratch.clear(spark)
    assert not list((root / "chronolex").iterdir()) and root.exists()
