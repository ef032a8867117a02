import pytest

from sievemark import session


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class Fake:
    def __init__(self, **conf):
        self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", ""):
        with pytest.raises(RuntimeError):
            session.shared_folder(Fake(spark_master=master))
    named = Fake(spark_master="yarn")
    named.conf["spark.checkpoint.dir"] = "hdfs://x/y/"
    assert session.shared_folder(named) == "hdfs://x/y"
    assert session.shared_folder(Fake(spark_master="local[4]")) == session.shared_folder(Fake(spark_master="local")) != ""
