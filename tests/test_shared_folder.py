import pytest

from quern.sources import shared


class Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = f"file:{folder}"


class Session:
    def __init__(self, master, **conf):
        self.sparkContext, self.conf = Context(master), conf


def test_the_sessions_setting_comes_first():
    for master in ("local[2]", "spark://host:7077"):
        assert shared.checkpoint_folder(Session(master, **{"spark.checkpoint.dir": "/shared/x"})) == "file:/shared/x"


def test_only_a_local_master_may_do_without():
    assert shared.checkpoint_folder(Session("local[4]")).startswith("file:")
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared.checkpoint_folder(Session(master))


def test_fresh_folders_differ(spark):
    a, b = (shared.fresh_folder(spark, "t") for _ in range(2))
    assert a != b and a.startswith(shared.checkpoint_folder(spark))
