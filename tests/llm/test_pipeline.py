import corpus_pipeline as C
from placeloom.llm import langid


def test_stages(spark, make_docs, words, tmp_path):
    bench_item = words(30)
    texts = [words(80) for _ in range(12)]
    texts += [texts[0], texts[1] + " ", None, "123 ... 456", words(10) + " " + bench_item + " " + words(10), words(20) + " write to bosbt.42@mail8.example.com now"]
    langs = ["en"] * len(texts)
    make_docs(texts, langs=langs).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench_item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = [{*range(14), 16, 17}, {*range(12), 16, 17}, {*range(12), 17}, {*range(12), 17}]
    for (name, stage), ids in zip(C.STAGES, want, strict=False):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes], name
        out.write.parquet(f"{tmp_path}/{name}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        assert {r.doc_id for r in docs.select("doc_id").collect()} == ids, name
    assert docs.filter("doc_id = 17").first().text.endswith(" write to [EMAIL] now")
    last = C.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in last} == want[-1] and all(0 <= r.taken <= 2 * r.size for r in last)
    assert langid.REJECT_BELOW < 0.5
