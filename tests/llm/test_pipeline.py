"""The pipeline's stages against plain Python, each on its own input, and the registered queries."""

import brute

import __spark_entry__ as contract
import corpus_pipeline
from sitewright.llm import toxicity
from sitewright.llm.tables import load, stored

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = load(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas()
        rows = list(zip(before.doc_id.tolist(), before.text.tolist(), strict=True))
        after = stored(stage(spark, docs, SF))
        ids = {row.doc_id for row in after.select("doc_id").collect()}
        if name == "toxicity":
            found = toxicity.report(docs, load(spark, SF, "labels")).where("toxic").collect()
            assert ids == {doc_id for doc_id, _ in rows} - {row.doc_id for row in found}
        elif name == "near_duplicates":
            component, _ = brute.components(rows, 80)
            assert ids == {doc_id for (doc_id, _), c in zip(rows, component, strict=True) if c == doc_id}
        elif name == "substring_dedup":
            want = brute.removals(rows)
            assert ids == {doc_id for doc_id, (n, removed, _) in want.items() if not n or removed < n}
            texts = dict(rows)
            for row in after.collect():
                n, removed, _ = want[row.doc_id]
                assert len(brute.split(row.text)) == n - removed
                assert removed or row.text == texts[row.doc_id]
        elif name == "decontamination":
            items = [(row.item_id, row.text) for row in load(spark, SF, "benchmark").collect()]
            assert ids == {row[0] for row in brute.benchmark_hits(rows, items) if not row[-1]}
        else:
            assert ids <= {doc_id for doc_id, _ in rows} and set(columns) <= set(after.columns)
            break
        assert after.columns == columns
        docs = after


def test_run_and_registration(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    names = [name for name in contract.queries() if name.startswith("op")]
    assert sorted(int(name[2:].split("_")[0]) for name in names) == list(range(1, 14))
    assert "pipeline" in contract.queries()


def test_stages_on_an_empty_table(spark):
    docs = load(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF))
        assert docs.count() == 0
