"""Everything written goes below the session's spark.checkpoint.dir."""

from reviewlens.session import ensure_checkpoint_dir, shared_path


def test_shared_paths_live_under_the_checkpoint_dir(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    base = ensure_checkpoint_dir(spark)
    assert configured and base.rstrip("/").split(":")[-1].startswith(configured.rstrip("/").split(":")[-1])
    a, b = shared_path(spark, "x"), shared_path(spark, "x")
    assert a != b and a.startswith(base.rstrip("/") + "/reviewlens/")
    assert shared_path(spark, "fixed", unique=False).endswith("/reviewlens/fixed")
