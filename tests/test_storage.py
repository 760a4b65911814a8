import pytest

from codestrata.functions import storage


class _Session:
    def __init__(self, **conf):
        self.conf = self
        self._conf = conf

    def get(self, key, default=None):
        return self._conf.get(key, default)


def test_shared_folder():
    assert storage.shared_dir(_Session(**{"spark.checkpoint.dir": "hdfs://x/y/", "spark.master": "yarn"})) == "hdfs://x/y"
    assert storage.shared_dir(_Session(**{"spark.master": "local[4]"})).startswith("file:///")
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError):
            storage.shared_dir(_Session(**{"spark.master": master}))
