"""What a Python worker keeps of its work, in a process of its own."""

import subprocess
import sys
from pathlib import Path

RUN = """
import numpy as np, pyarrow as pa
from plumbline.llm import packing as K
rng = np.random.default_rng(1)
letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
run = K._pieces(None, 4096, 1, False)
for _ in range(10):
    words = rng.choice(letters, (100_000, 6)).astype("<U1").view("<U6").ravel().tolist()
    texts = [" ".join(words[i : i + 400] * 20) for i in range(0, len(words), 400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["id", "text"])
    assert sum(x.num_rows for x in run(iter([batch]))) >= len(texts)
del words, texts, batch
print([int(x.split()[1]) // 1024 for x in open("/proc/self/smaps_rollup") if x.startswith("Pss_Anon")][0])
"""


def test_tokenizing_leaves_little_behind():
    """A million different words: more are read than are remembered."""
    out = subprocess.run([sys.executable, "-c", RUN], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-900:]
    assert int(out.stdout) < 350
