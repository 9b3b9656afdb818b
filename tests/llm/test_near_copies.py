"""The pipeline's near-duplicate stage against brute force on five-word shingles."""

import random

import corpus_pipeline

from .fixtures import frame


def grams(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def test_stage_drops_every_copy_of_similarity_08(spark):
    rows, copies = [], set()
    for k in range(40):
        rng = random.Random(k)
        base = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(120)]
        rows.append((10 * k, " ".join(base)))
        for i, changes in enumerate(((20,), (20, 60), (60, 61, 62, 63, 64, 65, 66, 67), (5, 30, 55, 80, 105), (10, 20, 30, 40, 50, 60, 70, 80)), 1):
            text = " ".join(f"new{k}x{j}x{i}" if j in changes else w for j, w in enumerate(base))
            a, b = grams(text), grams(rows[10 * k // 10 * 6][1])
            if len(a & b) >= 0.8 * len(a | b):
                copies.add(10 * k + i)
            rows.append((10 * k + i, text))
    left = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, frame(spark, rows), "").collect()}
    assert len(copies) >= 80 and not copies & left
    assert {10 * k for k in range(40)} <= left
    assert {10 * k + 5 for k in range(40)} & left  # eight changed words apart: similarity under 0.8
