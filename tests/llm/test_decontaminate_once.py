"""Cutting the benchmark out of texts is one pass of one Python worker."""
import pytest
from scanledger.llm import decontamination


@pytest.mark.parametrize("block_bytes", [1 << 20, 30])
def test_marks_and_cuts_in_one_worker(spark, block_bytes):
    words = [f"w{i}" for i in range(40)]
    bench = spark.createDataFrame([("a", " ".join(words[:10])), ("b", " ".join(words[20:30]))], "item_id string, text string")
    docs = spark.createDataFrame([(1, f"before {' '.join(words[:10])} after", 0), (2, " ".join(words[20:30]), 0), (3, "nothing of it", 13), (4, None, 0)],
                                 "doc_id long, text string, n_chars int")
    cut = decontamination.decontaminate(docs, bench, block_bytes=block_bytes)
    assert {r.doc_id: (r.text, r.n_chars) for r in cut.collect()} == {1: ("before  after", 13), 3: ("nothing of it", 13), 4: (None, 0)}
    marked = decontamination.mark_passages(docs, bench, block_bytes=block_bytes)

    def workers(df):
        return df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")

    assert workers(cut) == workers(marked)
