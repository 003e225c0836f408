from types import SimpleNamespace

import pytest

from adloom.session import checkpointed, use_checkpoint_dir


class Context:
    """Stands for a Spark context that has a master and a checkpoint folder."""

    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = f"{folder}/run"


def session(master, named=None, folder=None):
    conf = SimpleNamespace(get=lambda key, default: named if key == "spark.checkpoint.dir" else default)
    return SimpleNamespace(conf=conf, sparkContext=Context(master, folder))


def test_named_folder_is_used():
    spark = session("yarn", "/shared/checkpoints")
    use_checkpoint_dir(spark)
    assert spark.sparkContext.folder == "/shared/checkpoints/run"
    use_checkpoint_dir(spark)
    assert spark.sparkContext.folder == "/shared/checkpoints/run"


def test_named_folder_replaces_another():
    spark = session("yarn", "/shared/checkpoints", "/other/run")
    use_checkpoint_dir(spark)
    assert spark.sparkContext.folder == "/shared/checkpoints/run"


def test_a_cluster_gets_no_temporary_folder():
    with pytest.raises(ValueError):
        use_checkpoint_dir(session("yarn"))


def test_a_folder_set_in_code_is_kept():
    spark = session("yarn", folder="/set/run")
    use_checkpoint_dir(spark)
    assert spark.sparkContext.folder == "/set/run"


def test_checkpointed_rows_do_not_depend_on_their_source(spark):
    rows = checkpointed(spark.range(5).selectExpr("id * 2 as n"))
    assert "Range" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.n for r in rows.collect()) == [0, 2, 4, 6, 8]
