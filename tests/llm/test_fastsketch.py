"""Near-duplicates by sketches against all pairs of sets."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from cinefold.llm import fastsketch, sketches
from pyspark.sql import functions as F


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_set(text, k=2):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def plain(rows, similar=80):
    sets = [plain_set(t) for _, t in rows]
    top = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= similar * len(a | b):
                low, high = sorted((top[i], top[j]))
                top = [low if t == high else t for t in top]
    out = []
    for (ident, _), s, t in zip(rows, sets, top, strict=True):
        ids = [r[0] for r, u in zip(rows, top, strict=True) if u == t and r[0] is not None]
        least = (min(ids) if ids else None) if s else ident
        out.append((ident, len(s), least, ident is not None and ident == least))
    return sorted(out, key=repr)


def made(rng, n):
    """Texts with copies, edits around the threshold, chains of edits and shared passages."""
    vocabulary = [f"w{k}" for k in range(60)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    texts = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 5, 6, 10, 40, 200]))] for _ in range(8)]
    while len(texts) < n:
        base = list(rng.choice(texts[-20:] if rng.random() < 0.5 else texts))
        for _ in range(rng.randrange(1 + len(base) // 8)):
            base[rng.randrange(len(base))] = rng.choice(vocabulary)
        texts.append([*passage, *base] if rng.random() < 0.15 else base)
    return [(k, " ".join(x).replace("w1", "W1" if rng.random() < 0.3 else "w1")) for k, x in enumerate(texts)]


ODD = [(None, "a b c d"), (-4, "a b c d"), (-5, None), (-5, ""), (-6, " \t\n"), (-7, "Solo"), (-8, "solo"), (-8, "solo"), (None, "nobody has this"), (-9, "É a"), (-10, "é a"), (-11, "z " * 9000), (-12, "x" * 70_000)]


@pytest.mark.parametrize("options", [{}, {"shard": 5}])
def test_rows(spark, options):
    rng = random.Random(7)
    rows = made(rng, 260) + ODD
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "n", "key", "digest", "node", "component_id", "kept")})
    assert sorted(map(tuple, fastsketch.near_duplicates(docs.repartition(3), **options).collect()), key=repr) == plain(rows)
    assert fastsketch.near_duplicates(docs.where("false"), **options).count() == 0
    kept = {r[0] for r in plain(rows) if r[3]}
    assert sorted(r[0] for r in fastsketch.deduplicate(docs, **options).collect()) == sorted(r[0] for r in rows if r[0] in kept)


def test_shingles():
    for _, text in made(random.Random(1), 60) + ODD:
        found = sketches.shingles(text or "")
        assert len(found) == len(plain_set(text)) and (np.diff(found.astype(object)) > 0).all()


def test_sketch_fills_every_coordinate_by_the_first_round_that_reaches_it(monkeypatch):
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 20, 700, 5000):
        found = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        t, slow = sketches.COORDINATES, {}
        for i in range(2 * t):
            values = sketches.hashed(found, slice(i, i + 1))[0]
            for v in values.tolist():
                b = (v >> 32) * t >> 32 if i < t else i - t
                if b not in slow or slow[b][0] == i and v < slow[b][1]:
                    slow[b] = i, v
            if len(slow) == t:
                break
        assert sketches.sketch(found).tolist() == [slow[b][1] for b in range(t)]
        monkeypatch.setattr(sketches, "AT_ONCE", 512)
        assert sketches.sketch(found).tolist() == [slow[b][1] for b in range(t)]
        monkeypatch.undo()


def test_sketches_agree_as_sets_do():
    rng = np.random.default_rng(6)
    for n, similar in ((9, 0.8), (90, 0.8), (900, 0.8), (900, 0.5)):
        agree, apart = [], []
        for _ in range(60):
            pool = rng.integers(0, 1 << 63, n).astype(np.uint64)
            only = round(n * (1 - similar) / 2)
            a, b = sketches.sketch(pool[only:]), sketches.sketch(pool[: n - only])
            agree.append((a == b).mean())
            apart.append(int(sketches.differing(sketches.bits(a), sketches.bits(b))))
        true = (n - 2 * only) / n
        assert abs(np.mean(agree) - true) < 0.02
        assert np.std(agree) < 1.35 * (true * (1 - true) / sketches.COORDINATES) ** 0.5
        assert abs(np.mean(apart) / sketches.COORDINATES - (1 - true) / 2) < 0.02
