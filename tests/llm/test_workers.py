"""Executors need no copy of the package: workers of a session started elsewhere cannot import it."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from caretally.session import local_session
from caretally.llm import classlm, decontam, langid, quality, ranked, runs, toxicity
spark = local_session(2, shuffle_partitions=2, memory="1g")

def importable(batches):
    import importlib.util
    import pyarrow as pa
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("caretally") is not None] * len(batch))], ["found"])

assert not any(r[0] for r in spark.range(2).mapInArrow(importable, "found boolean").collect())
docs = spark.createDataFrame([(k, f"some words number {{k % 3}} of a text that is long enough {{'scum' if k % 4 == 0 else ''}}", "en") for k in range(40)], "doc_id long, text string, lang string")
labels = docs.selectExpr("doc_id", "1 AS quality", "CAST(doc_id % 4 = 0 AS int) AS toxic")
items = spark.createDataFrame([(1, "some words number 1 of a text that")], "item_id long, text string")
for frame in (decontam.contaminated(docs, items), decontam.clean(docs, items), langid.predictions(docs), toxicity.scored(docs, labels), quality.judge(docs, labels),
              classlm.scored(docs), ranked.ranked(docs, items), runs.collapsed(docs)):
    assert frame.count() > 0
print("all ran")
"""


def test_workers_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-3000:]
