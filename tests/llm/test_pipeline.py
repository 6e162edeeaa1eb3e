import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from levelstream.llm import substring_dedup  # noqa: E402

from .test_simhash import brute_components, brute_print  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "simhash", "substring_dedup", "mixing", "piece_codes"]
    kept = stages["toxicity"](spark, docs, SF)
    assert kept.columns == corpus_pipeline.COLUMNS and 0 < kept.count() <= docs.count()
    rows = docs.collect()
    prints = {r.doc_id: brute_print(r.text) for r in rows}
    ids = sorted(prints)
    root = brute_components(ids, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 4])
    single = stages["simhash"](spark, docs, SF)
    assert sorted(r.doc_id for r in single.collect()) == sorted(d for d in ids if root[d] == d)
    cut = {r.doc_id: r for r in stages["substring_dedup"](spark, single, SF).collect()}
    texts = {r.doc_id: r.text.encode() for r in single.collect()}
    seen = {}
    for t in texts.values():
        for i in range(len(t) - substring_dedup.LENGTH + 1):
            seen[t[i : i + substring_dedup.LENGTH]] = seen.get(t[i : i + substring_dedup.LENGTH], 0) + 1
    assert all(len(cut[d].text) == cut[d].n_chars <= len(t.decode()) for d, t in texts.items())
    assert {d for d, t in texts.items() if any(seen[t[i : i + 200]] > 1 for i in range(len(t) - 199))} == {d for d, t in texts.items() if cut[d].text != t.decode()}
    mix = stages["mixing"](spark, single, SF)
    assert mix.columns == corpus_pipeline.COLUMNS
    whole = {r.doc_id: r.text for r in single.collect()}
    for r in mix.collect():
        words = r.text.split()
        assert words and r.n_chars == len(r.text) and all(w in whole[r.doc_id] for w in words)
    out = stages["piece_codes"](spark, mix, SF)
    assert out.count() == mix.count() and out.where("not lossless").count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_run(spark):
    assert corpus_pipeline.run(spark, SF).where("lossless").count() > 0


def test_stages_take_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, text_hash string"
    odd = [(1, None, None, None, None, 1, "c"), (1, None, None, None, None, 1, "c"), (None, "a b c", "en", "s", 5, 1, "c"), (2, "", "en", "", 0, 1, "c"), (3, "a b c " * 200, "en", "s", 1200, 1, "c"), (4, "z " * 50, "en", None, 100, 1, "c")]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, SF).count() >= 0, name
