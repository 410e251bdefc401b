"""Python workers keep little of the memory that they have used."""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import pyarrow as pa

from timegrid.llm import pitman_yor


def _own_mb() -> float:
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


def test_a_run_of_texts_leaves_little_memory():
    rng = np.random.default_rng(1)
    text = " ".join(map(str, rng.integers(0, 1 << 40, 200_000)))
    batch = pa.RecordBatch.from_pydict({"text": [text] * 10})
    pinned, before = [], _own_mb()
    for tokens, _, _ in pitman_yor._gatherer(iter([batch]), np.zeros(0, np.uint64), 800_000, []):
        small = [np.full(10_000, i) for i in range(2_000)]  # 160 MB in blocks that come from the heap
        pinned.append(small[-1])  # the heap's top stays in use
        del small, tokens
    assert len(pinned) == 3
    assert _own_mb() - before < 80
