"""The pipeline's stages over nulls, repeated rows, clashing columns and an empty table."""

import pytest

import corpus_pipeline

KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint, copy string, digest string, keep_id string"


def stages(spark, docs, folder):
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, None)
        if k < len(corpus_pipeline.STAGES) - 1:
            out.write.parquet(f"file://{folder}/{name}")
            out = spark.read.parquet(f"file://{folder}/{name}")
            yield name, docs, out
        else:
            yield name, docs, out
        docs = out


@pytest.mark.parametrize("empty", [True, False])
def test_edges(spark, tmp_path, empty):
    words = " ".join(f"word{chr(97 + k % 26)}{k}" for k in range(40))
    rows = [(1, words), (1, words), (2, words + " end"), (3, words.replace(" ", "  ")), (4, None), (5, ""), (6, "12 34"), (None, "of no id"), (7, "é" * 3000), (8, "a")]
    rows = [(i, t, None, None if i == 8 else "s", 1, "own", "own", "own") for i, t in rows]
    docs = spark.createDataFrame(rows, KIND)
    seen = {}
    for name, before, after in stages(spark, docs.limit(0) if empty else docs, tmp_path):
        seen[name] = after.collect()
        if name != "byte_bpe":
            assert set(before.columns) - set(after.columns) <= ({"copy"} if name == "mixing" else set()), name
        if empty:
            assert not seen[name], name
    if empty:
        return
    # Texts without a letter go; of equal and near texts one stays; nothing else is lost before mixing.
    ids = {name: sorted((r.doc_id or 0) for r in kept) for name, kept in seen.items()}
    assert ids["language_id"] == [0, 1, 1, 2, 3, 7, 8]
    assert ids["exact_dedup"] == [0, 2, 3, 7, 8] and ids["minhash"] == [0, 2, 7, 8]
    assert set(ids["mixing"]) <= {0, 2, 7, 8} and ids["byte_bpe"] == ids["mixing"]
