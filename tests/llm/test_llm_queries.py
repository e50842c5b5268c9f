"""The registered queries over whole tables: SQL oracles, and the pipeline against its operators."""

import hashlib

import pytest

import corpus_pipeline
from feedpulse.llm import queries, quality, toxicity
from feedpulse.llm.common import stored
from feedpulse.plans.compare import connect_duckdb, rows_of, spark_types
from feedpulse.sources.tables import table

SF = "/root/testdata/sf0.001"


def test_names():
    assert sorted(queries.QUERIES) == sorted([
        "op1_url_filter", "op2_toxicity", "op3_warc", "op4_sentencepiece", "op5_best_fit_packing", "op6_jaccard_join", "op7_exact_topk",
        "op8_sharding", "op9_substring_dedup", "op10_quality_rules", "op11_secret_scan",
        "op12_merkle_manifest", "op13_prefix_trie", "pipeline"])


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracles(spark, name):
    df = queries.QUERIES[name](spark, SF)
    con = connect_duckdb(SF)
    rel = con.sql(queries.ORACLE[name])
    assert spark_types(df) == {c: str(t) for c, t in zip(rel.columns, rel.types)}
    cur = con.execute(queries.ORACLE[name])
    cols = [d[0] for d in cur.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, cur.fetchall())


def test_pipeline_against_brute_force(spark):
    """Each stage judged on its own input by the brute-force versions of the operators' tests."""
    from test_jaccard import brute as jaccard_brute
    from test_quality import brute as quality_brute
    from test_substring_dedup import brute as substring_brute
    docs = first = table(spark, SF, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = stored(stage(spark, docs, SF), "test-stage")
        if name != "best_fit_packing":
            assert out.columns == first.columns and out.dtypes == first.dtypes
        rows = out.collect()
        if name == "toxicity":
            scores = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, table(spark, SF, "labels")).collect()}
            assert {r["doc_id"] for r in rows} == {i for i, p in scores.items() if not p}
        elif name == "quality_rules":
            kept = {r["doc_id"] for r in quality.apply_policy(quality.ledger(docs)).filter("kept").collect()}
            assert {r["doc_id"] for r in rows} == kept
            for i, t in before:
                n, *_, repeated = quality_brute(t)
                assert i not in kept or not (n < 20 or 100 * repeated > 30 * n)
        elif name == "jaccard_join":
            assert {r["doc_id"] for r in rows} == {root for _, root in jaccard_brute(before).values()}
        elif name == "substring_dedup":
            want = {k[0]: (k[2], k[3]) for k in substring_brute(before, 35)}
            for r in rows:
                removed, digest = want[r["doc_id"]]
                assert hashlib.sha256(r["text"].encode()).hexdigest() == digest if removed else r["text"] == dict(before)[r["doc_id"]]
                assert r["n_chars"] == len(r["text"])
        else:
            assert {r["doc_id"] for r in rows} == {i for i, _ in before}
        seen[name], docs = len(rows), out
    assert corpus_pipeline.run(spark, SF).count() == seen["best_fit_packing"]


def test_the_rest_does_not_import_the_subpackage():
    import pathlib
    root = pathlib.Path(corpus_pipeline.__file__).parent / "feedpulse"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "feedpulse.llm" not in p.read_text() and "corpus_pipeline" not in p.read_text(), p
