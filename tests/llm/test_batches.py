import uuid

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from placeloom.llm import common


@pytest.fixture
def own_setting(spark):
    before = spark.conf.getAll.get(common.BATCH_SETTING)
    spark.conf.unset(common.BATCH_SETTING)
    yield
    spark.conf.unset(common.BATCH_SETTING)
    if before is not None:
        spark.conf.set(common.BATCH_SETTING, before)


def test_stages_hand_python_few_texts_at_once(spark, own_setting, monkeypatch, tmp_path):
    """4 MB of texts in one partition: no batch of a stage that runs Python is larger than the bound and one row."""
    text = F.concat_ws(" ", *[F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"/{i}")), 512) for i in range(30)])
    docs = spark.range(0, 1000, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"), F.length(text).cast("long").alias("n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kind, stages = type(docs), dict(C.STAGES)
    plain = kind.mapInArrow
    for name in ("language_id", "near_dedup", "pii"):
        (seen := tmp_path / f"{name}-batches").mkdir()

        def noted(self, run, *rest, to=str(seen)):
            def sized(batches):
                for batch in batches:
                    with open(f"{to}/{uuid.uuid4().hex}", "w") as f:
                        f.write(str(batch.nbytes))
                    yield batch

            return plain(self, lambda batches: run(sized(batches)), *rest)

        with monkeypatch.context() as patch:
            patch.setattr(kind, "mapInArrow", noted)
            assert stages[name](spark, docs, str(tmp_path)).count() == 1000
        assert 0 < max(int(x.read_text()) for x in seen.iterdir()) <= common.BATCH_BYTES + 10_000, name


def test_a_bound_of_the_session_stays(spark, own_setting):
    spark.conf.set(common.BATCH_SETTING, "3m")
    common.map_batches(spark.range(3), lambda batches: batches, "id long").count()
    assert spark.conf.get(common.BATCH_SETTING) == "3m"
