"""Repeated passages against brute force."""

import random
from collections import defaultdict

import numpy as np

from lexspark.llm import substring_dedup as sub
from lexspark.llm.common import table

from .fixtures import SCHEMA, frame, prose, texts

LEAST_WORDS = sub.LEAST + sub.SHINGLE - 1


def tree_places(values, least):
    """Nodes of the Cartesian tree with ``least`` values or more below them."""
    out, stack = set(), [(0, len(values))]
    while stack:
        low, high = stack.pop()
        if high - low >= least:
            at = min(range(low, high), key=values.__getitem__)
            out.add(at)
            stack += [(low, at), (at + 1, high)]
    return out


def test_sliding_minima_are_the_trees_nodes():
    rng = random.Random(3)
    sizes = [0, 1, 6, 7, 8, 50, 400, 3]
    parts = [[rng.getrandbits(62) + 1 for _ in range(n)] for n in sizes]
    values = np.array([v for p in parts for v in p], np.uint64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    start, want = 0, set()
    for p in parts:
        want |= {start + k for k in tree_places(p, 7)}
        start += len(p)
    assert set(sub.compact_windows(values, owner, 7).tolist()) == want


def test_extents_and_agreements_are_the_trees():
    """A window holds what lies below its node; two windows agree that share enough and hold each other's places."""
    rng = random.Random(4)
    sizes, least = [5, 60, 200, 7], 7
    owner = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.cumsum(sizes) - sizes
    found = []
    for _ in range(2):
        values = np.array([rng.getrandbits(60) * 8 + 7 for _ in range(sum(sizes))], np.uint64)
        places = sub.compact_windows(values, owner, least)
        left, right = sub.extents(values, owner, places)
        for at, a, b in zip(places.tolist(), left.tolist(), right.tolist()):
            low, high = starts[owner[at]], starts[owner[at]] + sizes[owner[at]] - 1
            span = values[at - a : at + b + 1]
            assert values[at] == span.min() and low <= at - a and at + b <= high
            assert at - a == low or values[at - a - 1] < values[at]
            assert at + b == high or values[at + b + 1] < values[at]
        found.append((values[places], places, left, right))
    keys = [(f[0] ^ np.uint64(k)).view(np.int64) for k, f in enumerate(found)]
    mine = owner[np.concatenate([f[1] for f in found])] == 2
    columns = [np.concatenate(c)[mine] for c in (keys, *([f[k] for f in found] for k in (1, 2, 3)))]
    got = sorted(zip(*(x.tolist() for x in sub.agreements(*columns, least))))
    rows = list(zip(*(c.tolist() for c in columns)))
    pairs = [
        (x, y)
        for x in rows
        for y in rows
        if x[0] & 7 == 7 and y[0] & 7 == 6 and x[1] - x[2] <= y[1] <= x[1] + x[3] and y[1] - y[2] <= x[1] <= y[1] + y[3] and min(x[1] + x[3], y[1] + y[3]) - max(x[1] - x[2], y[1] - y[2]) + 1 >= least
    ]
    assert len(pairs) > 10
    turned = [(y, x) for x, y in pairs]  # the function with the lesser last bits comes first
    assert [at for _, at in got] and sorted(at for _, at in got) == sorted(x[1] for x, _ in turned)


def test_equal_least_values_part_windows():
    values = np.array([9, 5, 9, 9, 5, 9, 1, 9], np.uint64)
    left, right = sub.extents(values, np.zeros(8, np.int64), np.array([1, 4, 6]))
    assert left.tolist() == [1, 2, 6] and right.tolist() == [2, 1, 1]


def test_repeats_of_one_value_are_thinned():
    values = np.full(1000, 5, np.uint64)
    places = sub.compact_windows(values, np.zeros(1000, np.int64), 50)
    assert 20 <= len(places) <= 42 and places[0] == 0 and places[-1] == 999


def covered(rows):
    spans = defaultdict(set)
    for r in rows:
        spans[r.doc_id].update(range(r.first_word, r.end_word))
    return spans


def exact_repeats(docs, size):
    """doc_id: the words of every stretch of ``size`` words that another document has too."""
    owners = defaultdict(set)
    words = {i: (t or "").encode().lower().split() for i, t in docs}
    for i, w in words.items():
        for k in range(len(w) - size + 1):
            owners[tuple(w[k : k + size])].add(i)
    out = defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - size + 1):
            if len(owners[tuple(w[k : k + size])]) > 1:
                out[i].update(range(k, k + size))
    return out, words


def test_every_exact_repeat_is_found(spark, small):
    docs = [tuple(r) for r in table(spark, small, "documents").select("doc_id", "text").collect()]
    want, words = exact_repeats(docs, LEAST_WORDS)
    rows = sub.repeated_passages(table(spark, small, "documents")).collect()
    got = covered(rows)
    assert want and all(want[i] <= got[i] for i in want)
    for r in rows:
        a, b = words[r.doc_id][r.first_word : r.end_word], words[r.source_id][r.source_first_word : r.source_end_word]
        grams = [{tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (a, b)]
        assert min(len(a), len(b)) >= LEAST_WORDS and len(grams[0] & grams[1]) / len(grams[0] | grams[1]) >= 0.75 and 0.8 <= r.similarity <= 1


def passage(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]


def test_planted_passages_in_shared_surroundings(spark):
    """A line that all share, three passages that some share, one of them with a changed word."""
    line = passage(100, 30)
    rows, where = [], {}
    for i in range(60):
        own = passage(i, 120)
        if i % 3 == 0:  # the line stands before the passage
            middle = line + passage(200 + i % 2, 52)
        elif i % 10 == 1:
            middle = passage(300, 60)
            if i > 30:
                middle[25] = "changed"
        else:
            middle = line
        rows.append((i, " ".join(own[:60] + middle + own[60:])))
        where[i] = (60, 60 + len(middle))
    got = covered(sub.repeated_passages(frame(spark, rows)).collect())
    for i in range(60):
        if i % 3 == 0 or i % 10 == 1:
            assert set(range(*where[i])) <= got[i], i
            assert len(got[i]) <= where[i][1] - where[i][0] + 8
        else:
            assert not got[i]


def edited(words, kind):
    half = len(words) // 2
    return words[:half] + ["inserted"] * (kind == "insert") + words[half + (kind == "delete") :]


def test_a_moved_half_is_found_from_the_other():
    shingles = sub.Shingler()
    for n in (52, 56, 60):
        for kind in ("insert", "delete"):
            own, other = passage(1, 40), passage(2, 40)
            text, changed = passage(3, n), edited(passage(3, n), kind)
            a, b = (shingles(" ".join(x)) for x in (own[:20] + text + own[20:], other[:33] + changed + other[33:]))
            for at in (22, 20 + n - 10):  # a window that met in the left half alone, or in the right one alone
                moved = 13 + (at > 22) * (len(changed) - n)
                found = sub.passages(a, b, np.array([at]), np.array([at + moved]))
                assert [f[:4] for f in found] == [(20, 20 + n - 4, 33, 33 + len(changed) - 4)], (n, kind, at)


def test_planted_passages_with_an_inserted_or_deleted_word(spark):
    rows, where = [], {}
    for k in range(120):
        own, text = passage(2000 + k, 80), passage(1000 + k, (52, 56, 60)[k % 3])
        for i, middle in ((2 * k, text), (2 * k + 1, edited(text, ("insert", "delete")[k % 2]))):
            rows.append((i, " ".join(own[: 40 * (i % 2) + 10] + middle + passage(5000 + i, 60))))
            where[i] = (40 * (i % 2) + 10, 40 * (i % 2) + 10 + len(middle))
    got = covered(sub.repeated_passages(frame(spark, rows)).collect())
    whole = sum(set(range(*where[i])) <= got[i] for i in where)
    assert whole >= 0.98 * len(where), whole


def test_an_earlier_document_with_the_unchanged_part(spark):
    """The first document shares only half of a passage that two later ones share, one of them with a changed word in the other half."""
    rows, where = [], {}
    for k in range(100):
        text, size = passage(7000 + k, 64), (30, 40)[k % 2]
        changed = text[:]
        changed[size + 8] = "changed"
        own = [passage(9000 + 3 * k + i, 80) for i in range(3)]
        for i, middle in enumerate((text[:size], text, changed)):
            rows.append((3 * k + i, " ".join(own[i][:30] + middle + own[i][30:])))
        where[3 * k + 1] = where[3 * k + 2] = (30, 94)
    got = covered(sub.repeated_passages(frame(spark, rows)).collect())
    whole = sum(set(range(*where[i])) <= got[i] for i in where)
    assert whole >= 0.9 * len(where), whole
    assert not any(got[3 * k] for k in range(100))


def test_many_links_within_repeated_text():
    """A passage whose halves lie far apart in a list of chains is one passage."""
    shingles = sub.Shingler()
    text = passage(1, 80)
    other = text[:40] + ["changed"] + text[41:]
    filler = ["x", "y"] * 30
    a, b = shingles(" ".join(filler + text + filler)), shingles(" ".join(filler + other + filler))
    found = sub.passages(a, b, np.array([62, 62, 64, 66, 10]), np.array([62, 64, 62, 62, 12]))
    assert any(f[0] <= 60 and f[1] >= 136 for f in found)


def test_one_id_with_several_texts_and_many_equal_rows(spark):
    one, two = prose(11, 120), prose(12, 120)
    rows = [(1, one)] * 300 + [(1, two)] + [(2, one), (3, two)]
    got = covered(sub.repeated_passages(frame(spark, rows)).collect())
    assert set(got) in ({1, 2}, {1, 3}) and all(len(v) == 120 for v in got.values())


def test_awkward_rows(spark):
    got = covered(sub.repeated_passages(frame(spark)).collect())
    assert set(got) == {3, 7, 12, 28}
    assert len(got[3]) == len(got[7]) == 300
    assert sub.repeated_passages(spark.createDataFrame([], SCHEMA)).count() == 0
    one = sub.repeated_passages(frame(spark, [(1, prose(1, 90)), (1, prose(1, 90)), (None, prose(1, 90))]))
    assert one.count() == 0 and one.columns[0] == "doc_id"
    assert len(texts()) == frame(spark).count()
