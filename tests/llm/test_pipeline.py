import corpus_pipeline
from tessella.llm import labels, packing, quality_crf

from test_dedup import brute_groups, brute_lines, brute_print, brute_substrings


def test_stages_against_brute_force(spark, sf, tmp_path):
    """Every stage's rows are those of a plain account of what the stage before kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], sf).write.parquet(str(tmp_path / str(k)))
        frames.append(spark.read.parquet(str(tmp_path / str(k))))
        if k < 4:
            assert frames[-1].columns == columns, name
            assert frames[-1].filter("n_chars <> length(text)").count() == 0
    texts = [sorted((r.doc_id, r.text) for r in f.select("doc_id", "text").collect()) for f in frames[:5]]
    model = quality_crf.fit_quality(labels.labelled_sample(docs, spark.read.parquet(f"{sf}/labels.parquet"), "quality"))
    assert texts[1] == [(i, t) for i, t in texts[0] if model.score(t) >= quality_crf.THRESHOLD]
    assert texts[2] == sorted((i, t) for i, t, _, _ in brute_lines(texts[1]))
    groups = brute_groups(texts[2], [brute_print(t) for _, t in texts[2]])
    assert texts[3] == [row for row, g in zip(texts[2], groups, strict=True) if row[0] == g]
    assert texts[4] == sorted((i, t) for i, t, _, _ in brute_substrings(texts[3], 13))
    assert len(texts[0]) > len(texts[1]) and texts[1] != texts[2] and len(texts[2]) > len(texts[3]) and texts[3] != texts[4]
    encode = packing.byte_bpe()()
    ids = [i for i, _ in texts[4]]
    want = {i: len(x) // 4 + 1 for i, x in zip(ids, encode([t for _, t in texts[4]]), strict=True)}
    got: dict[int, int] = {}
    for r in frames[5].collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_stages_of_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_good_documents_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.keep_good(spark, docs, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").join(docs, "doc_id").count()
    assert sum(r.quality == 1 for r in kept) >= 0.97 * good and quality_crf.THRESHOLD == 0.3
