import numpy as np
import pytest
from helpers import prose

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_planted_cases(spark, tmp_path):
    """Each stage drops what was planted for it and keeps the rest."""
    r = np.random.default_rng(16)
    clean = [prose(r, int(r.integers(30, 80))) for _ in range(80)]
    toxic = ["vile slur filth scum vile slur " + prose(r, 20) for _ in range(40)]
    item = prose(r, 30)
    near = clean[0].split()
    near[5] = "changed"
    texts = clean + toxic + [clean[1], " ".join(near) if len(near) > 40 else clean[1], prose(r, 15) + " " + item, None, "", ""]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 80)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "token_ids", "n_tokens", "round_trip"]
    assert {x.doc_id for x in got.collect()} == set(range(80)) | {123, 124}


def test_edited_benchmark_passages(spark, tmp_path):
    """One edited copy of an item, and edited copies of another in several documents; neither occurs whole."""
    r = np.random.default_rng(17)
    lone, often = prose(r, 30), prose(r, 30)

    def edited(item):
        return " ".join("changed" if k % 7 == 5 else w for k, w in enumerate(item.split()))

    texts = [prose(r, int(r.integers(60, 90))) for _ in range(40)] + [" ".join([prose(r, 60), edited(x), prose(r, 60)]) for x in [lone] + [often] * 12]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, lone), (2, often)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).count() == len(texts)  # they are no near copies
    assert {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(range(40))


def test_stages_in_order_and_their_columns(spark, tmp_path, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "SentencePiece encoding"]
    d = docs(["a b c d", None, ""])
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert sorted(map(str, stage(spark, d, str(tmp_path)).collect())) == sorted(map(str, d.collect())), name
        assert stage(spark, d.filter("false"), str(tmp_path)).columns == d.columns


def test_odd_and_empty_tables_from_end_to_end(spark, tmp_path, odd, empty):
    """Null, empty, very long and repeated texts, null ids, columns of clashing names; then no rows at all."""
    spark.createDataFrame([(1, "a b c d e")], "item_id long, text string").write.parquet(f"{tmp_path}/odd/benchmark.parquet")
    spark.createDataFrame([(5, 1), (6, 0), (None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/odd/labels.parquet")
    odd.write.parquet(f"{tmp_path}/odd/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd")
    added = ["token_ids", "n_tokens", "round_trip"]
    assert got.columns == [c for c in odd.columns if c not in added] + added
    rows = got.collect()
    assert sorted(str(x.doc_id) for x in rows) == ["1", "2", "3", "4", "5", "6", "7", "8", "None"]
    assert all((x.n_tokens is None) == (x.text is None) for x in rows) and all(x.score == "own" for x in rows)
    empty.write.parquet(f"{tmp_path}/empty/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/empty/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/empty/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
