"""Tables that Spark takes for small are not sent to every task."""

import pyarrow as pa
import pytest

from ontospark import runtime
from ontospark.llm import simhash

STATIC, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def test_variants_are_not_broadcast(spark, tmp_path):
    # 64 rows of each fingerprint, of a table of some hundred kilobytes: far below the threshold as Spark sees it.
    spark.range(20_000).selectExpr("xxhash64(id) as fp").write.parquet(f"{tmp_path}/fps")
    links = simhash.fingerprint_links(spark.read.parquet(f"{tmp_path}/fps"))
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("own, held", [("10MB", [str(1 << 18), str(1 << 22)]), ("64k", [str(1 << 16)] * 2), ("-1", ["-1", "-1"])])
def test_broadcasts_are_bounded(spark, own, held):
    before = spark.conf.get(STATIC)
    spark.conf.set(STATIC, own)
    try:
        with runtime.broadcasts_bounded(spark):
            assert [spark.conf.get(STATIC), spark.conf.get(MEASURED)] == held
        assert spark.conf.get(STATIC) == own and spark.conf.get(MEASURED, None) is None
    finally:
        spark.conf.set(STATIC, before)


def test_numbers_reach_the_driver_as_arrays(spark, monkeypatch):
    # Shared passages make shingles common and keys heavy; both lists are as long as there are such.
    from ontospark.llm import nearcopies

    text = " ".join(f"w{k}" for k in range(400))
    docs = spark.createDataFrame([(k, f"{text} own{k} " + " ".join(f"x{k}y{j}" for j in range(400))) for k in range(40)], "doc_id long, text string")
    most, collect = [], type(docs).collect

    def spy(self):
        out = collect(self)
        most.append(len(out))
        return out

    monkeypatch.setattr(type(docs), "collect", spy)
    assert len(nearcopies._common_shingles(nearcopies._slim(docs, "doc_id", "text"), 5)) == 396
    assert max(most, default=0) <= 1


def test_batches_for_python_are_bounded(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    texts = spark.range(0, 6000, 1, 1).selectExpr("repeat('abcdefgh', 250) as text")
    found = runtime.materialize(texts.mapInArrow(sizes, "n long, size long"), "sizes").collect()
    assert sum(r["n"] for r in found) == 6000 and max(r["size"] for r in found) < 1.1 * runtime.BATCH_BYTES
    assert spark.conf.get(runtime._BATCH, None) is None
