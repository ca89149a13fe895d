"""What workers hold between tasks, and how many of them a task needs."""

import os
import random
import re
import subprocess
import sys

import numpy as np

from payproof.llm import neardup, substrings
from payproof.llm import words as W

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: A new process, as tests before this one may have filled what is kept.
KEPT = """
import tracemalloc
import numpy as np, pyarrow as pa
from payproof.llm import neardup
texts, sign = pa.array(["some words of a text " * 9, None]), neardup._signature(np.ones(neardup.BUCKETS, np.float32))
tracemalloc.start()
sign(texts)
print(tracemalloc.get_traced_memory()[0])
"""


def test_little_is_kept_once_texts_are_signed():
    kept = subprocess.run([sys.executable, "-c", KEPT], cwd=ROOT, capture_output=True, text=True, check=True).stdout
    assert int(kept) < 8_000_000


def test_prefix_hashes_are_those_of_plain_powers():
    r = np.random.default_rng(3)
    for n in (0, 1, 2047, 2048, 2049, 5000):
        data = np.frombuffer(r.bytes(n), np.uint8)
        want = [0]
        for i, byte in enumerate(data.tolist()):
            want.append((want[-1] + int(W._BYTE[byte]) * pow(W._BASE, i, 1 << 64)) % (1 << 64))
        prefix = W.prefix_hash(data)
        assert prefix.tolist() == want
    again = np.concatenate([data, data, data])
    prefix, starts = W.prefix_hash(again), np.array([7, 5007, 10_007])
    for length in (0, 1, 2500, 4993):
        assert len(set(W.range_hash(prefix, starts, starts + length).tolist())) == 1


def test_parts_of_samples_do_not_depend_on_other_levels():
    every = neardup._parts(np.arange(neardup.LEVELS)).reshape(neardup.LEVELS, -1)
    some = np.array([0, 3, 17, 439])
    assert np.array_equal(neardup._parts(some).reshape(4, -1), every[some])


def functions_of_a_stage(df):
    """The most Python functions that follow each other in the plan without an exchange between."""
    path, most = [], 0
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        name = re.search(r"[A-Za-z]", line)
        if not name:
            continue
        while path and path[-1][0] >= name.start():
            path.pop()
        held = path[-1][1] if path else 0
        held = 0 if re.match(r"\w*Exchange", line[name.start() :]) else held + bool(re.match(r"ArrowEvalPython|MapIn", line[name.start() :]))
        path.append((name.start(), held))
        most = max(most, held)
    return most


def test_a_task_cuts_passages_with_one_worker(spark):
    r = random.Random(2)
    passage = " ".join(f"w{r.randrange(500)}" for _ in range(60))
    texts = [f"first {passage} end", f"and  {passage}\nthen", f"first {passage} end", "short", None, f"alone {passage} here {passage}"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, "another of this id"), (None, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cut = substrings.without_repeats(docs)
    want = [texts[0], "and then", "", "short", None, "alone here", "another of this id", passage]
    assert sorted(map(str, (x.text for x in cut.collect()))) == sorted(map(str, want))
    assert functions_of_a_stage(cut) == 1
