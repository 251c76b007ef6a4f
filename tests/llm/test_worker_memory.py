"""What Python workers hold in the pipeline's last stages, and what they keep for the stages after."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
CODE = """
import random, re
import pyarrow as pa
from quern.llm import common, decontaminate
from quern.llm.token_output import TOKENIZER, Tokenizer

def held(what):
    return int(re.search(what + r":\\s+(\\d+)", open("/proc/self/status").read())[1]) // 1024

rng = random.Random(3)
words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(20_000)]
batch = pa.record_batch({"id": pa.array(range(8000), pa.int64()), "text": pa.array([" ".join(rng.choices(words, k=300)) for _ in range(8000)])})
with open(TOKENIZER, "rb") as f:
    tokenizer = Tokenizer(f.read())
tokenizer.encoding(), tokenizer.widths()
runs = {
    "tokens": lambda batches: (len(ids) for b in batches for _, _, ids, _ in tokenizer.encode_slices(b)),
    "windows": lambda batches: (r.num_rows for b in batches for r in decontaminate.window_rows(b, [(6, False), (8, False), (8, True)], common.np.zeros(1 << 21, "u1"))),
}
before = held("VmRSS")
sum(common.lean(runs[NAME])(iter([batch])))
print(held("VmHWM") - before, held("VmRSS") - before)
"""


@pytest.mark.parametrize("name, most, kept", [("tokens", 250, 100), ("windows", 120, 60)])
def test_a_worker_s_memory_over_15_mb_of_texts(name, most, kept):
    code = f"NAME = {name!r}\n{CODE}"
    peak, after = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=ROOT).stdout.split())
    assert peak < most and after < kept, (peak, after)


def test_contaminated_ids_are_a_written_table(spark):
    import corpus_pipeline as P

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    plan = P.decontaminate(spark, docs, d)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "Aggregate" not in plan
