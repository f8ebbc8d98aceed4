"""The pipeline and the contract of the corpus queries."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from loanloom.llm import contamination, pii, queries
from loanloom.llm.common import table

SF = "/root/testdata/sf0.001"


def test_registered():
    found = contract.queries()
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in queries.QUERIES}
    assert "pipeline" in found and queries.QUERIES.keys() <= found.keys()
    assert contract.oracle_sql().keys() <= found.keys()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "mixture"]


def rows_of(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        before, after = {r.doc_id: r.text for r in kept.collect()}, {r.doc_id: r.text for r in out.collect()}
        assert after.keys() <= before.keys() and len(after) == out.count()
        if name != "mixture":
            assert out.columns == docs.columns
        if name == "decontamination":
            items = next(contamination.item_blocks(table(spark, SF, "benchmark")))
            finder = contamination.Decontaminator(items)
            assert after.keys() == {i for i, t in before.items() if not finder.matches(t)} != before.keys()
        elif name == "personal_data":
            assert any("[" in t and t != before[i] for i, t in after.items())
            assert all(not pii.base_spans(t) for t in after.values())
        else:
            assert all(before[i] == t for i, t in after.items())
        kept = out
    assert rows_of(corpus_pipeline.run(spark, SF), docs.columns) == rows_of(kept, docs.columns)


@pytest.mark.parametrize("place", range(5))
def test_odd_and_empty_documents(spark, odd_docs, no_docs, place):
    name, stage = corpus_pipeline.STAGES[place]
    out = stage(spark, odd_docs, SF)
    columns = odd_docs.columns if name != "mixture" else [*odd_docs.columns, "mix_tokens", "mix_posterior", "mix_rate", "mix_copies"]
    assert out.columns == columns
    assert out.count() <= 8 and (name == "quality" or out.count() == 8)
    assert stage(spark, no_docs, SF).count() == 0
    if name == "personal_data":
        assert out.where(F.col("text").contains("[EMAIL]")).count() == 1


def test_ids_on_several_texts(spark):
    """Every stage judges rows, not ids."""
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    other = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    item = next(r.text for r in table(spark, SF, "benchmark").collect())
    rows = [(5, long), (5, other), (3, other), (3, None), (9, f"{long} {item}"), (9, "clean words only, nothing else"), (None, other)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, SF)
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, (r for r in rows if r != (5, other))))
    clean = corpus_pipeline.drop_contaminated(spark, docs, SF)
    assert sorted(map(str, ((r.doc_id, r.text) for r in clean.collect()))) == sorted(map(str, (r for r in rows if item not in (r[1] or ""))))
    for stage in (corpus_pipeline.mask_personal_data, corpus_pipeline.weight_sources):
        assert stage(spark, docs, SF).count() == len(rows)
