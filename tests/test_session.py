from medallion.session import checkpoint_root, scratch_path, unique_name


def test_checkpoint_root_follows_the_session(spark):
    root = checkpoint_root(spark)
    named = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        assert root == named.rstrip("/")
    assert spark.sparkContext.getCheckpointDir() is not None


def test_scratch_paths_are_fresh_and_shared(spark):
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(checkpoint_root(spark))
    assert unique_name("t") != unique_name("t")


def test_a_cluster_must_name_its_shared_folder():
    import pytest

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return self

        def get(self, key, default=None):
            return default

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = conf = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(Session())
