"""The pipeline against the plain versions of its stages, on the smallest tables."""

from collections import Counter

import brute

SMALL = "/root/testdata/sf0.001"


def test_pipeline_equals_plain_stages(spark):
    import corpus_pipeline
    from sentencepiece import SentencePieceProcessor

    from guardlake.llm import mixing, queries
    rows = [r.asDict() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = [r for r in rows if not brute.base_failed(r["text"])]  # 200 documents certify no cutoff
    keep = {i for i, _, _, stays, _ in brute.dedup([(r["doc_id"], r["text"]) for r in want]) if stays}
    want = [r for r in want if r["doc_id"] in keep]
    groups = brute.near_groups([(r["doc_id"], r["text"]) for r in want])
    want = [r for r in want if groups[r["doc_id"]][0] == r["doc_id"]]

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    counts = []
    for name, step in corpus_pipeline.STAGES[:3]:
        docs = step(spark, docs, SMALL)
        counts.append(docs.count())
        assert docs.columns == list(rows[0])
    assert sorted(r["doc_id"] for r in docs.collect()) == sorted(r["doc_id"] for r in want)
    assert len(rows) > counts[0] > counts[1] > counts[2]

    copies = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.report(docs).collect() if r["size"]}
    model = SentencePieceProcessor(model_file=queries.piece_model())
    tokens = Counter((r["doc_id"], tuple(model.encode(r["text"]))) for r in want for _ in range(copies[r["doc_id"]]))
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, SMALL).collect()) == tokens
    assert sum(brute.mix_targets(Counter({s: sum(len(brute.words(r["text"])) for r in want if r["source"] == s) for s in {r["source"] for r in want}})).values()) > 0


def test_the_stages_in_order():
    import corpus_pipeline
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "ngram_join", "mixing", "sentencepiece"]


def test_the_chain_over_odd_and_empty_tables(spark, edge, empty, tmp_path):
    import corpus_pipeline
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for n, docs in enumerate((edge, empty)):
        rows = docs.select("doc_id", "text", "lang", "source", "n_chars")
        for name, step in corpus_pipeline.STAGES:
            out = f"{tmp_path}/{n}-{name}"
            step(spark, rows, str(tmp_path)).write.parquet(out)
            last, rows = rows, spark.read.parquet(out)
            assert name == "sentencepiece" or rows.columns == last.columns
        assert (rows.count() == 0) == (n == 1)
