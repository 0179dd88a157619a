import os

import pyarrow as pa
import pytest

from spectraframe.llm import _common as C


def test_tables_go_when_they_are_released(spark):
    df = C.materialize(spark.range(5), "five")
    folder = C._FOLDERS[spark.sparkContext.applicationId].removeprefix("file://").removeprefix("file:")
    assert df.count() == 5 and os.path.isdir(folder) and any(x.startswith("five-") for x in os.listdir(folder))
    C.release(spark)
    assert not os.path.exists(folder)
    assert C.materialize(spark.range(3)).count() == 3


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="checkpoint"):
        C.shared_folder(Session())


def test_batches_are_bounded_by_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    C.bound_batches(spark)
    df = spark.range(2000, numPartitions=1).selectExpr("repeat('x', 20000) AS text")
    assert max(r.n for r in df.mapInArrow(sizes, "n long").collect()) < 2 * C.BATCH_BYTES
