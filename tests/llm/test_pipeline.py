import corpus_pipeline
from tandemlake.llm import decontaminate, simhash, suffix_dedup

from .helpers import DOCS, prose
from .test_decontaminate import slow as slow_hits
from .test_packing import check, plain
from .test_simhash import slow_components, slow_fingerprint
from .test_suffix_dedup import slow as slow_repeats
from .test_toxicity import LABELS, corpus


def test_stages_against_brute_force(spark, tmp_path):
    rows, labels = corpus(300)
    passage = prose(777, 60)
    rows = [(i, t + (" " + passage if i in (1, 2, 6) else ""), "en", "s", len(t)) for i, t, *_ in rows]
    rows += [(500, rows[5][1], "en", "s", 1), (501, None, None, None, None), (502, "", None, None, None), (503, prose(42, 30), "en", "s", 1), (504, prose(43, 700), "en", "s", 1)]
    bench = [(1, prose(42, 30)), (2, "never seen here at all")]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    def stage(k, docs):
        corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        return spark.read.parquet(f"{tmp_path}/out{k}")

    clean = stage(0, docs)
    assert clean.schema == docs.schema
    left = {r.doc_id: r.text for r in clean.collect()}
    bad = {d for d, _, y in labels if y}
    assert len(set(left) & bad) <= 0.1 * len(bad) and {r[0] for r in rows} - bad <= set(left)

    single = stage(1, clean)
    fps = sorted((d, slow_fingerprint(t)) for d, t in left.items())
    left = {d: left[d] for (d, _), c in zip(fps, slow_components(fps)) if d == c}
    assert {r.doc_id: r.text for r in single.collect()} == left and single.columns == docs.columns
    assert 500 not in left or 5 not in left

    cut = stage(2, single)
    ids = sorted(left)
    want = slow_repeats([left[d] for d in ids], 200)
    got = {r.doc_id: r for r in cut.collect()}
    assert sorted(got) == ids and cut.columns == docs.columns
    for d, (n, gone, _, _) in zip(ids, want):
        assert (len((left[d] or "").encode()) - len((got[d].text or "").encode())) >= gone
        if not gone:
            assert got[d].text == left[d]
        else:
            assert got[d].n_chars == len(got[d].text)
    assert sum(w[1] for w in want) > 0

    held = stage(3, cut)
    kept = {d for d, (n, hit, _) in zip(ids, slow_hits([got[d].text for d in ids], bench)) if not (hit and 20 * hit >= n)}
    assert {r.doc_id for r in held.collect()} == kept and 503 not in kept

    pieces = stage(4, held).collect()
    check(pieces, {r.doc_id: [*plain(r.text), 1] for r in held.collect()})
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "suffix_dedup", "decontamination", "packing"]
    assert (decontaminate.WINDOW, simhash.DISTANCE, suffix_dedup.GRAM) == (13, 3, 200)
