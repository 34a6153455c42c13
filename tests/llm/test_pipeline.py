"""Every stage of the pipeline against what its operator is to keep, and the whole of it."""

from collections import Counter

import corpus_pipeline as cp
from ionweave.llm import decontaminate as dc
from ionweave.llm import line_dedup as ld
from ionweave.llm import simhash as sm
from ionweave.llm import toxicity as tx
from ionweave.llm.common import documents, store

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontaminate", "packing"] and cp.ORACLE_SQL is None
    docs = documents(spark, SF)
    columns = docs.columns
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    ids = lambda df: Counter(r["doc_id"] for r in df.select("doc_id").collect())
    for name, stage in cp.STAGES[:-1]:
        after = store(stage(spark, docs, SF), name)
        assert after.columns == columns
        if name == "toxicity":
            assert ids(after) == ids(tx.score(docs, tx.fit(docs, labels)).where("predicted = 0"))
        elif name == "line_dedup":
            text = {r["doc_id"]: r["text"] for r in ld.dedup_lines(docs).collect()}
            assert {r["doc_id"]: r["text"] for r in after.collect()} == text and all(r["n_chars"] == len(r["text"]) for r in after.collect())
        elif name == "near_dedup":
            classes = {r["component_id"] for r in sm.near_duplicates(docs).collect()}
            assert ids(after) == Counter(classes)
        else:
            leaked = {r["doc_id"] for r in dc.contaminated(docs, bench).collect()}
            assert set(ids(after)) == set(ids(docs)) - leaked and leaked
        docs = after
    packed = cp.STAGES[-1][1](spark, docs, SF)
    assert set(ids(packed)) == set(ids(docs))
    assert cp.run(spark, SF).count() == packed.count()


def test_awkward_rows_pass_every_stage(spark, awkward, empty, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    for docs in (awkward, empty):
        before = docs.count()
        for name, stage in cp.STAGES:
            after = store(stage(spark, docs, str(tmp_path)), name)
            assert after.columns == docs.columns if name != "packing" else True
            docs = after
        assert (docs.count() > 0) == (before > 0)
