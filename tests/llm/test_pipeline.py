import corpus_pipeline
from pyspark.sql import functions as F

from larkspur.llm import toxicity

from .test_minhash_dedup import brute as groups
from .test_tokens import simple_best_fit

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_one_after_the_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = kept[name] = spark.read.parquet(str(tmp_path / name))
        if name != "best_fit_packing":
            assert docs.columns == before.columns and dict(docs.dtypes) == dict(before.dtypes)
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    source = spark.read.parquet(f"{SF}/documents.parquet")
    scored = toxicity.score(source, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(kept["toxicity"]) == ids(scored.where("score < 0.3"))
    texts = [(r["doc_id"], r["text"]) for r in kept["toxicity"].collect()]
    assert ids(kept["minhash_dedup"]) == {i for i, (_, _, stays) in groups(texts).items() if stays}
    first, want = {}, {}
    texts = {r["doc_id"]: r["text"].encode() for r in kept["minhash_dedup"].collect()}
    for i in sorted(texts):
        for k in range(len(texts[i]) - 49):
            first.setdefault(texts[i][k : k + 50], i)
    for i, raw in texts.items():
        gone = [False] * len(raw)
        for k in range(len(raw) - 49):
            if first[raw[k : k + 50]] < i:
                gone[k : k + 50] = [True] * 50
        at, out = 0, []
        for c in raw.decode():
            n = len(c.encode())
            if not all(gone[at : at + n]):
                out.append(c)
            at += n
        want[i] = "".join(out)
    assert {r["doc_id"]: r["text"] for r in kept["suffix_dedup"].collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in kept["suffix_dedup"].collect())
    packed = kept["best_fit_packing"].toPandas()
    assert set(packed["doc_id"]) == ids(kept["suffix_dedup"])
    assert packed["sequence_id"].nunique() == len(simple_best_fit(packed["length"].tolist(), 1024))


def test_run_equals_its_stages_and_bears_odd_rows(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "a b c d e f", "en", "s", 11), (2, "", None, "s", 0), (2, "", None, "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, SF)
            assert out.columns == rows.columns
            assert out.count() == rows.count()
        assert corpus_pipeline.STAGES[-1][1](spark, rows.withColumn("x", F.lit(1)), SF).count() == rows.count()
