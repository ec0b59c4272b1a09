"""What an executor holds at once: batches of rows for Python workers, and rows that needn't be shuffled."""

import re
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe_trie, cluster, mixing
from tidemark.llm.vocabulary import default_path


def test_batches_for_python_are_small(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "bytes"])

    texts = spark.range(0, 3_000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 800).alias("text"))
    long_one = texts.limit(1).select("doc_id", F.repeat("text", 2_000).alias("text"))
    seen = lambda df: df.mapInArrow(sizes, "n long, bytes long").collect()
    spark.conf.unset(cluster.BATCH_LIMIT)
    try:
        assert len(seen(texts)) == 1  # 12 MB, as Spark does it
        coded = bpe_trie.encoded(texts, default_path("byte_bpe_50k.json"))
        found = seen(texts)
        assert sum(r["n"] for r in found) == 3_000 and max(r["bytes"] for r in found) <= cluster.BATCH_BYTES + 100_000
        assert [r["n"] for r in seen(long_one)] == [1]
        assert coded.where("intact").count() == 3_000
        spark.conf.set(cluster.BATCH_LIMIT, 1 << 20)  # a session's own limit stays
        cluster.in_python(texts, sizes, "n long, bytes long")
        assert max(r["bytes"] for r in seen(texts)) <= (1 << 20) + 100_000
    finally:
        spark.conf.unset(cluster.BATCH_LIMIT)


def test_mix_shuffles_no_texts(spark):
    rows = [(i, " ".join(f"w{k % 50}" for k in range(i % 90)), ("a", "b", None)[i % 3], i) for i in range(600)]
    rows += [(600, None, "a", 0), (601, "", None, 0), (602, "text of a lone source", "c", 0)]
    schema = "doc_id long, text string, source string, copies long"
    per_id = lambda df, n: {r["doc_id"]: r["k"] for r in df.groupBy("doc_id").agg(n.alias("k")).collect() if r["k"]}
    df = spark.createDataFrame(rows, schema)
    out = mixing.mixed_rows(df)
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert per_id(out, F.count("*")) == per_id(mixing.mix(df), F.sum("copies"))
    assert {tuple(r) for r in out.collect()} <= set(rows)
    # Rows that repeat id, text and source, and an id with other texts and sources.
    again = [*rows, *[(7, rows[7][1], rows[7][2], 1_000 + k) for k in range(9)], (7, "another text", "a", 1), (7, rows[7][1], "b", 2), (600, None, "a", 5), (None, "no id", "b", 6), (None, "no id", "b", 7)]
    df = spark.createDataFrame(again, schema)
    out = mixing.mixed_rows(df)
    assert per_id(out, F.count("*")) == per_id(mixing.mix(df), F.sum("copies"))
    taken = {r: 0 for r in again}
    for r in out.collect():
        taken[tuple(r)] += 1
    assert max(taken.values()) <= 2 and all(0 <= n for n in taken.values())


def test_tasks_give_back_unused_memory(spark):
    if not Path("/proc/self/status").exists() or cluster._trim() is None:
        pytest.skip("needs Linux and malloc_trim()")

    def held():
        return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) >> 10

    class Table:
        sparkSession = spark

        def mapInArrow(self, function, schema):
            return function

    kept = []

    def hungry(batches):
        for batch in batches:
            blocks = [b"x" * 20_000 for _ in range(10_000)]  # 200 MB, with a little that stays among and after them
            kept.extend(blocks[::1_000])
            kept.append(b"y" * 20_001)
            del blocks
            yield batch

    before, most = held(), 0
    for _ in cluster.in_python(Table(), hungry, "n long")(iter([pa.record_batch({"n": [1]})])):
        most = held()
    assert most > before + 100  # freed, but not given back while the task runs
    assert held() < before + 50
