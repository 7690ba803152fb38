"""What a Python worker holds: a batch at a time, and nothing once a task is over."""

import gc
import re
import weakref
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.serializers import CloudPickleSerializer

from tallyloom.llm import _shared, decontamination, jaccard_join, packing, toxicity
from tallyloom.llm.queries import tokenizer_path

WORDS = np.array([f"w{i:05d}" for i in range(20_000)])


def anonymous() -> int:
    """Bytes of this process that belong to no file."""
    return 1024 * int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1])


def batches(n: int):
    pick = np.random.default_rng(7)
    for _ in range(n):
        texts = [" ".join(WORDS[pick.integers(0, len(WORDS), 150)]) for _ in range(4000)]
        keys = pa.array(np.arange(len(texts)))
        yield pa.RecordBatch.from_arrays([keys, pa.array(texts), keys, pa.array(np.ones(len(texts), np.int32))], names=["doc_id", "text", "text_key", "label"])


@pytest.mark.parametrize(
    "run",
    [decontamination._training_side(20, np.zeros(1 << 17, np.uint8), 100), jaccard_join._named(5), toxicity._bag_rows],
    ids=["decontamination", "jaccard_join", "toxicity"],
)
def test_task_gives_memory_back(run):
    for _ in run(batches(1)):  # what is kept for good
        pass
    _shared.tidy()
    before = anonymous()
    for _ in run(batches(3)):
        pass
    assert anonymous() - before < 12_000_000


def test_batches_are_small(spark):
    """A stage's worker gets no more than ARROW_BYTES (and a row) at a time."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    _shared.ready(spark)
    rows = spark.range(0, 4000, 1, 1).selectExpr("id", "repeat(cast(id as string), 1000) as text")

    def sizes(got):
        for b in got:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    found = [r["n"] for r in rows.mapInArrow(sizes, "n long").collect()]
    assert sum(found) > 14_000_000 and max(found) < 1_500_000


def test_cutting_frees_the_tokenizer():
    """A worker that comes from the tokenising stage drops its encoder and cache of words before it cuts."""
    held = weakref.ref(packing.encoder(tokenizer_path()))
    gc.disable()
    try:
        sent = CloudPickleSerializer().dumps(packing._cutter(packing.Mixture([1], [1], 4096), {"s": 0}, 2, True))
        assert len(sent) < 100_000
        list(CloudPickleSerializer().loads(sent)([]))
        assert held() is None
    finally:
        gc.enable()
