"""Fill-in-middle against a row-at-a-time version."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from cinefold.llm import middle
from pyspark.sql import functions as F


def plain(ident, text, rate=100, suffix_first=50, seed=7):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(lines)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < suffix_first:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


ODD = [None, "", "\n", "\n\n\n", "a", "a\n", "a\nb", "é\n語\r\n\U0001f600\n", "<P>", "x<S", ">y", "<", "M>", "<M>\nz", "<<P", "P>\n<S\n>", "é" * 70_000 + "\n" + "b\n" * 9000, "\n" * 5000, "no end\nat all " * 50]


def test_batches_equal_rows():
    rng = random.Random(3)
    for _ in range(200):
        texts = [rng.choice(ODD[1:16]) if rng.random() < 0.3 else "".join(rng.choice("ab\n<PSM>é語") for _ in range(rng.randrange(30))) for _ in range(rng.randrange(12))]
        hashes = [hashlib.sha256(f"7:{k}".encode()).hexdigest() for k in range(len(texts))]
        draws = [np.array([int(h[8 * k : 8 * k + 8], 16) for h in hashes], np.int64) for k in range(4)]
        whole = pa.array(["before\n<P>", *texts, "behind"], pa.string())
        for given in (pa.array(texts, pa.string()), whole.slice(1, len(texts))):  # also as a slice of a longer array
            out = middle.transform(given, draws)
            assert list(zip(*(out[c].to_pylist() for c in ("n", "form", "prefix_chars", "middle_chars", "output")), strict=True)) == [plain(k, t) for k, t in enumerate(texts)]


def test_rows(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "a\nb\nc"), (5, "a\n"), (5, "a\n"), (-3, "q\nr\ns\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "form", "output", "id", "h1", "drawn")})
    for options in ({}, {"rate": 50, "suffix_first": 20, "seed": 11}):
        found = middle.fill_in_middle(docs, **options).withColumn("back", middle.restored()).collect()
        wanted = [(i, *plain(i, t, **options), t or "") for i, t in rows]
        assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, wanted))
    assert middle.fill_in_middle(docs.where("false")).count() == 0
