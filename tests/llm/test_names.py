"""Stages on tables whose columns are called like the operators' own, and on null, repeated and empty rows."""

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tandemlake.llm import decontaminate, near_copies, packing, simhash, suffix_dedup, toxicity

from .helpers import DOCS, prose
from .test_toxicity import LABELS

OTHERS = [
    "n_hit", "n_words", "items", "hit_runs", "whole_text", "had_no_text", "toxicity_score", "score", "predicted", "held_out", "carried", "rest", "none", "k1", "k2", "kept", "kept_id", "own_digest", "digest",
    "spans", "found", "packed", "n_bytes", "fp", "root", "node", "n", "key", "keys", "runs", "start", "length", "offset", "a.b", "we`ird", "two words", "_joined_by",
]
PASSAGE = prose(31, 90)
ROWS = [
    (1, PASSAGE + " " + prose(1, 60)), (2, prose(2, 60) + " " + PASSAGE), (3, prose(3, 80)), (None, prose(4, 80)), (None, prose(4, 80)), (None, prose(5, 80)), (5, None), (5, ""), (None, None),
    (6, prose(6, 50)), (6, prose(7, 50)), (8, prose(8, 30)), (9, prose(8, 30)), (0, None), (7, None),
]
STAGES = {
    "toxicity": lambda spark, docs: toxicity.remove_toxic(docs, spark.createDataFrame([(0, 1, 0), (7, 1, 1), (3, 1, 0), (6, 1, 0)], LABELS)),
    "simhash": lambda spark, docs: simhash.keep_one(docs),
    "near copies": lambda spark, docs: near_copies.keep_one(docs),
    "suffix": lambda spark, docs: suffix_dedup.without_repeats(docs),
    "benchmark": lambda spark, docs: decontaminate.remove_contaminated(docs, spark.createDataFrame([(1, prose(3, 20)), (2, "no such thing")], "item_id long, text string")),
    "benchmark by blocks": lambda spark, docs: decontaminate.remove_contaminated(docs, spark.createDataFrame([(1, prose(3, 20)), (2, "no such thing")], "item_id long, text string"), block=3),
}


def tables(spark):
    plain = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in ROWS], DOCS)
    named = plain
    for i, c in enumerate(OTHERS):
        named = named.withColumn(c, F.concat(F.lit(f"{i} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    return plain, named


@pytest.mark.parametrize("stage", STAGES)
def test_other_columns_are_carried(spark, stage):
    plain, named = tables(spark)
    want, got = STAGES[stage](spark, plain), STAGES[stage](spark, named)
    assert want.columns == plain.columns and got.columns == named.columns
    rows = got.collect()
    assert sorted(str(r[:5]) for r in rows) == sorted(str(tuple(r)) for r in want.collect())
    assert all(r[5 + i] == f"{i} {'-' if r.doc_id is None else r.doc_id}" for r in rows for i in range(len(OTHERS)))
    assert STAGES[stage](spark, named.limit(0)).count() == 0


def test_packing_ignores_other_columns(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, named = (sorted(map(str, packing.pack(x.coalesce(1), path).collect())) for x in tables(spark))
    assert plain == named


def test_pipeline_with_null_and_repeated_rows(spark, tmp_path):
    """Of ids 0 and 7 the texts are null and the labels known; texts that are nobody's copy stay, whatever their ids."""
    plain, _ = tables(spark)
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (7, 1, 0), (3, 1, 0), (6, 1, 0)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    clean = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))
    assert clean.count() == len(ROWS)
    one = corpus_pipeline.STAGES[1][1](spark, clean, str(tmp_path))
    assert sorted(r.text or "" for r in one.collect()) == sorted({t or "" for _, t in ROWS})
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() >= 7


def test_written_tables_go(spark, tmp_path):
    from tandemlake.llm import common

    before = common.written()
    plain, _ = tables(spark)
    suffix_dedup.without_repeats(plain).collect()
    assert len(common.written() - before) == 1  # what the result itself is read from
    common.drop_all_but(spark, before)
    assert common.written() == before
