"""What the operators leave in Python workers, and that numbers need none."""

from __future__ import annotations

import weakref

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxelloom.llm import near_copies, packing, quality, simhash
from voxelloom.llm import queries as llm

TEXTS = ["the river stone light over garden", "", "slow paper winter glass " * 20]


class Table:
    """Hands out the function that an operator gives to mapInArrow."""

    def select(self, *columns):
        return self

    def mapInArrow(self, read, kind):  # noqa: N802
        return read


@pytest.mark.parametrize("of", [near_copies.parity_bits, simhash.fingerprints, quality.rule_statistics])
def test_a_worker_at_rest_keeps_no_caches(spark, monkeypatch, of):
    for module in (near_copies, simhash, quality):
        monkeypatch.setattr(module, "in_small_batches", lambda df: df)
    tokenizer = weakref.ref(packing.tokenizer_of(llm.tokenizer_path()))
    assert packing.tokenizer_of(llm.tokenizer_path()) is tokenizer()  # from task to task of its own
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(TEXTS)], names=["node", "text"])
    assert sum(b.num_rows for b in of(Table())(iter([batch]))) == 3
    assert tokenizer() is None and not near_copies._words()


def test_places_are_told_without_python_workers(spark):
    rows = spark.range(50).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("start"), (F.col("id") % 7 + 1).alias("length"))
    plan = packing.pack(rows, 16)._jdf.queryExecution().optimizedPlan().toString()
    assert "ExistingRDD" not in plan and "LogicalRDD" not in plan
