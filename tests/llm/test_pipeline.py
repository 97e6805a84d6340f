from collections import Counter

import __spark_entry__
import corpus_pipeline as P
from refrain.llm.packing import CAPACITY


def test_stages_in_order_over_all_rows_kept(spark, sf):
    assert [name.split("_")[0] for name, _ in P.STAGES] == ["op8", "op4", "op6", "op10", "op9"]
    queries = __spark_entry__.queries()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in queries["op8_quality_classifier"](spark, sf).where("kept").collect()}
    kept &= {r.doc_id for r in queries["op4_toxicity"](spark, sf).where("not toxic").collect()}
    rows = docs.where(docs.doc_id.isin(sorted(kept)))
    for name, stage in P.STAGES[:2]:
        docs = stage(spark, docs, sf)
    assert sorted(r.doc_id for r in docs.collect()) == sorted(kept)
    for name, stage in P.STAGES[2:4]:
        rows = stage(spark, rows, sf)
    words = {r.doc_id: len(r.text.split()) for r in rows.collect()}
    got, length = queries["pipeline"](spark, sf).collect(), Counter()
    for r in got:
        length[r.doc_id] += r.length
    assert 0 < len(words) < 200 and length == words
    full = Counter()
    for r in got:
        full[r.bin_id] += r.length
    assert max(full.values()) <= CAPACITY
