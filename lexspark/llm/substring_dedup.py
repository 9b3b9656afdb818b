"""Near-duplicate passages, by compact windows.

Texts are sequences of five-word shingles. Under a hash function, a compact window (l, c, r) holds
all subsequences around place c within l..r that have their least hash at c: a node of the
hashes' Cartesian tree, l..r being what lies below it. Nodes with ``LEAST`` shingles or more
below them are the places that are the least of some ``LEAST`` in a row, which
sliding minima find; they are closed upwards, so the tree is built over them alone.

Two subsequences whose signatures agree in a function lie in windows of one least hash. Windows of
``AGREE`` of the ``FUNCTIONS`` functions are joined by interval within each document: those that
hold each other's least place and have ``LEAST`` shingles or more in common stand for the
subsequences with both least hashes. Documents meet by such a pair of hashes, so only where enough hashes
agree on one stretch. Two passages at similarity 0.8 and the least length have two of four
functions in common with probability 0.97, and longer ones have more windows. Windows whose least hash is in one
document only go before that join.

Each group's first document (by id) is its source, and every other member is compared with it, so a
passage that a third of all documents share gives a pair for each of them, not for each two. Pairs are
verified on the ``MARGIN`` shingles around their windows' places, read as blocks of hashes: runs of equal
shingles along the windows' diagonals, and those that follow them within ``GAP`` on any other
diagonal, are chained over small gaps, and a chain of at
least ``LEAST`` shingles on both sides with Jaccard similarity ``SIMILARITY`` is a passage. A passage of which more than
twice ``MARGIN`` have no window in common comes as several.

Windows that find no passage with their source are grouped anew by where they part from it,
to the left and to the right, and by what they have there: two that share a passage which the
source lacks part from it at one place and in one way. So a line that many share, within different passages, falls apart
into those passages in as many rounds as it has branches in a row, not in as many as it has members.

Equal texts are one text to all this: the first id stands for them, and each later one is a
passage of its own, from end to end.

Defined cases: texts of under ``LEAST`` + 4 words, null and empty ones have no passage. Rows
without an id take no part, as no result could name them. Rows of one id and text are one
document; of several texts with one id that with the least hash counts. Repeats within
one document are left to the other operators. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, with_ids, written

SHINGLE = 5
LEAST = 46
FUNCTIONS, AGREE = 4, 2
#: Runs of equal shingles along a diagonal that count by themselves are longer than this.
REACH = 10
SIMILARITY = 0.8
GAP = 12
#: Shingles to either side of a place that verification reads, in whole blocks.
MARGIN = BLOCK = 64
#: Words that a task remembers, and shingles that are looked through together.
MEMORY = 200_000
CHUNK = 1 << 18

_U = np.uint64
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """Shingle hashes of texts; remembers words."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        n = len(words) - SHINGLE + 1
        if n < 1:
            return np.zeros(0, np.uint64)
        if len(self.known) > MEMORY:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        s = h[:n] * _ODD[0]
        for k in range(1, SHINGLE):
            s = s + h[k : n + k] * _ODD[k]
        return mixed(s)


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least (or greatest) of every ``width`` values in a row, from two passes over blocks."""
    take, n = (np.minimum, len(x)) if least else (np.maximum, len(x))
    blocks = np.full((-(-n // width), width), ~_U(0) if least else _U(0))
    blocks.reshape(-1)[:n] = x
    upto = take.accumulate(blocks, axis=1).reshape(-1)
    since = take.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return take(since[: n - width + 1], upto[width - 1 : n])


def compact_windows(values: np.ndarray, owner: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Places of the compact windows of ``least`` or more, over texts end to end.

    ``owner`` numbers the text that each value (not zero) is of. Of equal values near
    each other, as in text that repeats itself, the first, the last and one in each ``least`` stand for all.
    """
    n = len(values)
    if n < least:
        return np.zeros(0, np.int64)
    smallest = _sliding(values, least, True)
    smallest[owner[: n - least + 1] != owner[least - 1 :]] = 0
    around = np.zeros(n + least - 1, np.uint64)
    around[least - 1 : n] = smallest
    places = np.flatnonzero(values == _sliding(around, least, False))
    order = np.lexsort((places, values[places]))
    at, value = places[order], values[places[order]]
    near = (value[1:] == value[:-1]) & (at[1:] - at[:-1] < least) & (owner[at[1:]] == owner[at[:-1]])
    gone, kept = [], 0
    for k in (np.flatnonzero(near) + 1).tolist():  # at[k] repeats at[k - 1]
        if k < 2 or not near[k - 2]:
            kept = at[k - 1]
        if k < len(near) and near[k] and at[k] - kept < least:
            gone.append(at[k])
        else:
            kept = at[k]
    return np.setdiff1d(places, np.array(gone, np.int64), assume_unique=True) if gone else places


def extents(values: np.ndarray, owner: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each place's compact window goes to the left and to the right of it.

    The Cartesian tree over the places, by a stack of its right spine. A window ends before
    a lesser value, an equal one and the text's end.
    """
    ends = np.flatnonzero(np.diff(owner, append=-1)) + 1
    of = owner[places]
    low, high = (np.concatenate([[0], ends[:-1]])[of], ends[of]) if len(ends) else (places, places)
    left, right = low.tolist(), high.tolist()  # exclusive on the right
    stack: list[int] = []
    text = -1
    at, value = places.tolist(), values[places].tolist()
    for k, (o, v) in enumerate(zip(of.tolist(), value)):
        if o != text:
            stack.clear()
            text = o
        while stack and value[stack[-1]] >= v:
            top = stack.pop()
            right[top] = at[k]
            if value[top] == v:
                left[k] = at[top] + 1
                break
        else:
            if stack:
                left[k] = at[stack[-1]] + 1
        stack.append(k)
    return places - np.array(left, np.int64), np.array(right, np.int64) - 1 - places


#: ``place`` holds a window's place, and how far it goes to the left and to the right (to ``FAR`` at most: longer passages hold shorter ones).
WINDOWS = "doc_id long, text_hash long, words int, key array<long>, place array<long>"
FAR = (1 << 16) - 1


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's compact windows; the last bits of a key tell the function."""
    shingles = Shingler()
    seeds = mixed(np.arange(1, FUNCTIONS + 1, dtype=np.uint64) * _ODD[5])
    names = [part.split()[0] for part in WINDOWS.split(", ")]

    def found(ids: list[tuple], texts: list[np.ndarray]) -> pa.RecordBatch:
        s, sizes = np.concatenate(texts), np.array([len(t) for t in texts])
        owner, starts = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes
        parts = []
        for k, seed in enumerate(seeds):
            values = mixed(s ^ seed) | _U(7)  # not zero
            places = compact_windows(values, owner)
            parts.append((values[places] ^ _U(k), places, *extents(values, owner, places)))
        key, at, left, right = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(owner[at], kind="stable")
        own = owner[at][order]
        cuts = pa.array(np.searchsorted(own, np.arange(len(texts) + 1)).astype(np.int32))
        place = (at - starts[owner[at]]) << 32 | np.minimum(left, FAR) << 16 | np.minimum(right, FAR)
        lists = [pa.ListArray.from_arrays(cuts, pa.array(c[order])) for c in (key.view(np.int64), place)]
        words = pa.array((sizes + SHINGLE - 1).astype(np.int32))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*ids)), words, *lists], names)

    ids: list[tuple] = []
    texts: list[np.ndarray] = []
    held = 0
    for batch in batches:
        for *own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            s = shingles(text.as_py())
            if len(s) < LEAST:
                continue
            ids.append(own)
            texts.append(s)
            held += len(s)
            if held > CHUNK:
                yield found(ids, texts)
                ids, texts, held = [], [], 0
    if texts:
        yield found(ids, texts)


def agreements(key: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(group, place) of each two windows of one document that share ``least`` shingles and hold each other's places."""
    groups, places = [], []
    function = (key & 7).astype(np.int64)
    low, high = at - left, at + right
    order = np.lexsort((at, function))
    parts = [order[function[order] == f] for f in np.unique(function)]
    for n, a in enumerate(parts):
        for b in parts[n + 1 :]:
            first, end = np.searchsorted(at[b], low[a]), np.searchsorted(at[b], high[a], "right")
            size = end - first
            x = np.repeat(a, size)
            y = b[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)]
            both = np.minimum(high[x], high[y]) - np.maximum(low[x], low[y]) + 1 >= least
            both &= (low[y] <= at[x]) & (at[x] <= high[y])
            x, y = x[both], y[both]
            groups.append(mixed(key[x].view(np.uint64) * _ODD[0] + mixed(key[y].view(np.uint64))).view(np.int64))
            places.append(at[x])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *groups]), np.concatenate([none, *places])


def _grouped():
    kind = pa.struct([("group", pa.int64()), ("at", pa.int32())])

    @F.arrow_udf("array<struct<group:long,at:int>>")
    def groups(windows: pa.Array) -> pa.Array:
        key, place = (f.to_numpy() for f in windows.flatten().flatten())
        columns = (key, place >> 32, place >> 16 & FAR, place & FAR)
        cuts = (windows.offsets.to_numpy() - windows.offsets[0].as_py()).tolist()
        found = [agreements(*(c[a:b] for c in columns)) for a, b in zip(cuts, cuts[1:])]
        flat = [np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in range(2)]
        values = pa.StructArray.from_arrays([pa.array(flat[0]), pa.array(flat[1].astype(np.int32))], fields=list(kind))
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(f[0]) for f in found)]).astype(np.int32)), values)

    return groups


def _equal_from(a: np.ndarray, b: np.ndarray, i: int, j: int) -> int:
    """How many values in a row are equal from places i and j on."""
    n, at, step = min(len(a) - i, len(b) - j), 0, 64
    while at < n:
        m = min(step, n - at)
        other = np.flatnonzero(a[i + at : i + at + m] != b[j + at : j + at + m])
        if len(other):
            return at + int(other[0])
        at, step = at + m, 2 * step
    return n


def continuations(a: np.ndarray, b: np.ndarray, end: int, other: int) -> list[tuple[int, int, int]]:
    """(place, place, length) of the runs that may follow one that ends before these places.

    They start within ``GAP`` on any diagonal, at whatever length: the longest and the nearest.
    """
    i, j = max(0, end - SHINGLE + 1), max(0, other - SHINGLE + 1)
    p, q = max(0, i - 1), max(0, j - 1)
    equal = a[p : end + GAP + 1, None] == b[None, q : other + GAP + 1]
    if not equal.any():
        return []
    starts = equal.copy()
    starts[1:, 1:] &= ~equal[:-1, :-1]
    found = [(x, y, _equal_from(a, b, x, y)) for x, y in (np.argwhere(starts[i - p :, j - q :]) + (i, j)).tolist()]
    if not found:
        return []
    return [max(found, key=lambda r: (r[2], -r[0] - r[1])), min(found, key=lambda r: (abs(r[0] - end) + abs(r[1] - other), -r[2]))]


def gaps(last: tuple[int, int, int], run: tuple[int, int, int]) -> tuple[int, int]:
    """Shingles between two runs, on either side."""
    return run[0] - last[1], (run[0] - run[2]) - (last[1] - last[2])


def passages(a: np.ndarray, b: np.ndarray, at: np.ndarray, other: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int, int, float]]:
    """(first, end, first, end, similarity): near-equal stretches of two shingle sequences, around pairs of places."""
    runs = set()
    for d in np.unique(at.astype(np.int64) - other).tolist():
        low, high = max(0, d), min(len(a), len(b) + d)
        if high <= low:
            continue
        edges = np.diff(np.concatenate([[False], a[low:high] == b[low - d : high - d], [False]]).astype(np.int8))
        for start, end in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()):
            if end - start > REACH:
                runs.add((low + start, low + end, d))
    # An inserted or deleted word moves the rest of a passage to a diagonal where no window may have met.
    back, back_b, open_ends = a[::-1], b[::-1], list(runs)
    while open_ends:
        start, end, d = open_ends.pop()
        more = [(x, x + n, x - y) for x, y, n in continuations(a, b, end, end - d)]
        more += [(len(a) - x - n, len(a) - x, len(a) - x - len(b) + y) for x, y, n in continuations(back, back_b, len(a) - start, len(b) - start + d)]
        new = set(more) - runs
        runs |= new
        open_ends += new
    chains: list[list[tuple[int, int, int]]] = []
    near: list[list[tuple[int, int, int]]] = []  # those that a run may still follow
    for run in sorted(runs):
        near = [c for c in near if run[0] - c[-1][1] <= GAP]
        for chain in reversed(near):
            last = chain[-1]
            gap, other = gaps(last, run)
            if -SHINGLE < gap <= GAP and -SHINGLE < other <= GAP:
                chain.append(run)
                break
        else:
            chains.append([run])
            near.append(chains[-1])
    found = []
    while chains:
        chain = chains.pop()
        first, end = chain[0][0], chain[-1][1]
        other, other_end = chain[0][0] - chain[0][2], chain[-1][1] - chain[-1][2]
        shared = sum(e - s for s, e, _ in chain)
        if min(end - first, other_end - other) < least:
            continue
        similarity = shared / (end - first + other_end - other - shared)
        if similarity >= SIMILARITY:
            found.append((first, end, other, other_end, min(1.0, similarity)))
        elif len(chain) > 1:
            cut = max(range(1, len(chain)), key=lambda k: max(gaps(chain[k - 1], chain[k])))
            chains += [chain[:cut], chain[cut:]]
    return sorted(found)


SPANS = "array<struct<first:int,end:int,source_first:int,source_end:int,similarity:double>>"
_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("source_first", pa.int32()), ("source_end", pa.int32()), ("similarity", pa.float64())]))
_AGAIN = pa.list_(pa.struct([("group", pa.int64()), ("at", pa.int32())]))


def partings(a: np.ndarray, b: np.ndarray, at: int, other: int, group: int) -> list[int]:
    """Groups of a window that found no passage: where and how it parts from its source, left and right."""
    d, out = at - other, []
    low, high = max(0, d), min(len(a), len(b) + d)
    right = np.flatnonzero(a[at:high] != b[other : high - d])
    left = np.flatnonzero((a[low : at + 1] != b[low - d : other + 1])[::-1])
    for sign, spot in ((1, at + int(right[0]) if len(right) else high), (-1, at - int(left[0]) if len(left) else low - 1)):
        if 0 <= spot < len(a) and a[spot] < _APART[0]:
            what = np.array([group, spot - at, a[spot]], np.int64).view(np.uint64)
            out.append(int(mixed((what * _ODD[:3]).sum(dtype=np.uint64, keepdims=True) + _ODD[6 + (sign > 0)]).view(np.int64)[0]))
    return out


#: What stands for shingles that weren't read, of a document and of its source: equal to nothing.
_APART = np.array([1 << 40, 1 << 41], np.int64)


def blocks_of(shingles: np.ndarray, places: np.ndarray) -> list[tuple[int, bytes]]:
    """(number, 32-bit hashes) of the blocks around the places."""
    wanted = np.unique((places[:, None] + np.array([-MARGIN, 0, MARGIN])) // BLOCK)
    raw = (shingles >> _U(32)).astype("<u4").tobytes()
    return [(k, raw[4 * BLOCK * k : 4 * BLOCK * (k + 1)]) for k in wanted.tolist() if 0 <= BLOCK * k < len(shingles)]


def _cut_blocks():
    kind = pa.list_(pa.struct([("block", pa.int32()), ("hashes", pa.binary())]))

    @F.arrow_udf("array<struct<block:int,hashes:binary>>")
    def cut(texts: pa.Array, places: pa.Array) -> pa.Array:
        shingles, out = Shingler(), []
        for text, at in zip(texts.to_pylist(), places.to_pylist()):
            out.append([{"block": k, "hashes": h} for k, h in blocks_of(shingles(text), np.array(at, np.int64))])
        return pa.array(out, kind)

    return cut


class Stretches:
    """Blocks of one text side by side, those that aren't neighbours with a space between them."""

    def __init__(self, numbers: np.ndarray, hashes: list[bytes], apart: int):
        space = np.full(2 * GAP + SHINGLE, apart, np.int64)
        numbers, kept = np.unique(numbers, return_index=True)
        cuts = [0, *(np.flatnonzero(np.diff(numbers) > 1) + 1).tolist(), len(numbers)]
        parts, self.first, self.shift, size = [space], [], [], len(space)
        for a, b in zip(cuts, cuts[1:]):
            values = np.frombuffer(b"".join(hashes[k] for k in kept[a:b].tolist()), "<u4").astype(np.int64)
            self.first.append(size)
            self.shift.append(BLOCK * int(numbers[a]) - size)
            parts += [values, space]
            size += len(values) + len(space)
        self.values = np.concatenate(parts)

    def place(self, at: np.ndarray) -> np.ndarray:
        """Where places of the text lie here."""
        starts = np.array(self.first) + np.array(self.shift)
        return at - np.array(self.shift)[np.searchsorted(starts, at, "right") - 1]

    def of(self, place: int) -> int:
        """The place of the text, of one here."""
        return place + self.shift[bisect_right(self.first, place) - 1]


def verified(own: Stretches, source: Stretches, group: np.ndarray, real: np.ndarray, other_real: np.ndarray) -> tuple[list[tuple], list[tuple[int, int]]]:
    """Passages (as ``passages``, in places of the texts), and (group, place) of the windows that lie in none."""
    at, other = own.place(real), source.place(other_real)
    found = passages(own.values, source.values, at, other)
    alone = np.ones(len(at), bool)
    for s in found:
        alone &= (at < s[0]) | (at >= s[1])
    again = set()
    for n in np.flatnonzero(alone).tolist():
        again |= {(g, int(real[n])) for g in partings(own.values, source.values, int(at[n]), int(other[n]), int(group[n]))}
    spans = [(own.of(f), own.of(e - 1) + 1, source.of(g), source.of(h - 1) + 1, s) for f, e, g, h, s in found]
    return spans, sorted(again)


def _verifier():
    def lists(kind: pa.ListType, rows: list[list[tuple]]) -> pa.Array:
        kinds = list(kind.value_type)
        flat = pa.StructArray.from_arrays([pa.array([x[k] for r in rows for x in r], f.type) for k, f in enumerate(kinds)], fields=kinds)
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32)), flat)

    def cuts(column: pa.Array) -> list[int]:
        return (column.offsets.to_numpy() - column.offsets[0].as_py()).tolist()

    @F.arrow_udf(f"struct<spans:{SPANS},again:array<struct<group:long,at:int>>>")
    def verify(places: pa.Array, blocks: pa.Array) -> pa.Array:
        group, at, source_at = (f.to_numpy() for f in places.flatten().flatten())
        side, number, hashes = blocks.flatten().flatten()
        side, number, hashes = side.to_numpy(), number.to_numpy(), hashes.to_pylist()
        p, b = cuts(places), cuts(blocks)
        spans, again = [], []
        for k in range(len(places)):
            here, own = slice(p[k], p[k + 1]), np.arange(b[k], b[k + 1])
            both = [Stretches(number[own[side[own] == n]], [hashes[x] for x in own[side[own] == n].tolist()], int(_APART[n])) for n in (0, 1)]
            found, left = verified(*both, group[here], at[here].astype(np.int64), source_at[here].astype(np.int64))
            spans.append(found)
            again.append(left)
        return pa.StructArray.from_arrays([lists(_SPANS, spans), lists(_AGAIN, again)], names=["spans", "again"])

    return verify


def copies(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, first_id) of documents whose text an earlier one has too, and (doc_id, text_hash) of ids with several texts: the one that counts."""
    prints = named.select("doc_id", F.struct(F.col("text_hash").alias("a"), F.xxhash64(F.coalesce("text", F.lit("")), F.lit(1)).alias("b")).alias("p"))
    one = written(prints.groupBy("doc_id").agg(F.min("p").alias("p"), F.max("p").alias("q")).select("doc_id", "p", (F.col("p") != F.col("q")).alias("several")), "prints")
    firsts = one.groupBy("p").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("z")).where("first_id <> z").select("p", "first_id")
    later = one.join(firsts, "p").where("doc_id <> first_id").select("doc_id", "first_id")
    return later, one.where("several").select("doc_id", F.col("p.a").alias("text_hash"))


RESULT = "doc_id long, first_word int, end_word int, source_id long, source_first_word int, source_end_word int, similarity double"


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Passages that occur in several documents, in words of the text, ends exclusive.

    (doc_id, first_word, end_word, source_id, source_first_word, source_end_word, similarity):
    a row for each stretch of a document like one of its source, and one for each such stretch of
    the source itself (``source_id`` = ``doc_id``), which is the first document that has it.
    """
    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    later, several = copies(named)
    later, several = written(later, "copies"), written(several, "several")
    out = later.select(F.col("doc_id").alias("out_id"), F.lit(None).cast("long").alias("only")).union(several)
    other = (F.col("doc_id") == F.col("out_id")) & ~F.col("text_hash").eqNullSafe(F.col("only"))
    packed = written(named.mapInArrow(_windows, WINDOWS).join(out, other, "left_anti"), "windows")
    found = packed.select("doc_id", F.inline(F.arrays_zip("key", "place")))
    shared = found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    kept = found.join(shared, "key", "left_semi").groupBy("doc_id").agg(F.collect_set(F.struct("key", "place")).alias("windows"))
    members = written(kept.select("doc_id", F.inline(_grouped()("windows"))).select("group", "doc_id", "at"), "members")
    whole = written(later.join(packed.select(F.col("doc_id").alias("first_id"), "words").distinct(), "first_id"), "whole")
    discard(packed)
    zero = F.lit(0)
    results = [whole.select("doc_id", zero.alias("first_word"), F.col("words").alias("end_word"), F.col("first_id").alias("source_id"), zero.alias("source_first_word"), F.col("words").alias("source_end_word"), F.lit(1.0).alias("similarity"))]
    last = SHINGLE - 1
    blocks = None
    verify = _verifier()
    around = lambda at: F.array(*((F.col(at) + step * MARGIN).alias("x") for step in (-1, 0, 1)))
    while True:
        sources = members.groupBy("group").agg(F.min(F.struct("doc_id", "at")).alias("source"), F.max("doc_id").alias("z")).where("source.doc_id <> z").select("group", "source")
        linked = (
            members.join(sources, "group")
            .where("doc_id <> source.doc_id")
            .groupBy("doc_id", F.col("source.doc_id").alias("source_id"))
            .agg(F.collect_set(F.struct("group", "at", F.col("source.at").alias("source_at"))).alias("places"))
        )
        linked = written(linked, "links")
        discard(members)
        if linked.isEmpty():
            break
        each = linked.select("doc_id", "source_id", F.explode("places").alias("p"))
        if blocks is None:  # later rounds read but these
            ends = each.select("doc_id", "p.at").union(each.select("source_id", "p.source_at")).groupBy("doc_id").agg(F.collect_set("at").alias("at"))
            ends = written(ends.join(several.withColumnRenamed("text_hash", "only"), "doc_id", "left"), "ends")
            texts = with_ids(named, ends).join(ends, "doc_id").where("only is null or text_hash = only")
            blocks = written(texts.select("doc_id", F.inline(_cut_blocks()("text", "at"))).dropDuplicates(["doc_id", "block"]), "blocks")
        sides = F.array(F.struct(F.lit(0).alias("side"), F.col("doc_id").alias("owner"), around("p.at").alias("x")), F.struct(F.lit(1).alias("side"), F.col("source_id").alias("owner"), around("p.source_at").alias("x")))
        needed = each.select("doc_id", "source_id", F.inline(sides)).select("doc_id", "source_id", "side", "owner", F.explode("x").alias("x"))
        needed = needed.select("doc_id", "source_id", "side", "owner", F.floor(F.col("x") / BLOCK).cast("int").alias("block")).distinct()
        got = needed.join(blocks.withColumnRenamed("doc_id", "owner"), ["owner", "block"]).groupBy("doc_id", "source_id").agg(F.collect_list(F.struct("side", "block", "hashes")).alias("blocks"))
        both = linked.join(got, ["doc_id", "source_id"])
        checked = written(both.select("doc_id", "source_id", verify("places", "blocks").alias("v")).select("doc_id", "source_id", "v.*"), "passages")
        discard(linked)
        spans = checked.select("doc_id", "source_id", F.explode("spans").alias("p"))
        results.append(
            spans.select(
                "doc_id", F.col("p.first").alias("first_word"), (F.col("p.end") + last).alias("end_word"),
                "source_id", F.col("p.source_first").alias("source_first_word"), (F.col("p.source_end") + last).alias("source_end_word"), F.round("p.similarity", 6).alias("similarity"),
            )
        )
        # A window that lies within a passage found with some source needs no other one.
        again = checked.select("doc_id", F.explode("again").alias("g")).select("doc_id", "g.*").distinct()
        alone = again.groupBy("group").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a <> z").select("group")
        members = again.join(alone, "group").select("group", "doc_id", "at")
        covered = spans.select("doc_id", "p.first", "p.end").groupBy("doc_id").agg(F.collect_set(F.struct("first", "end")).alias("spans"))
        members = members.join(covered, "doc_id", "left").where(~F.coalesce(F.exists("spans", lambda s: (s["first"] <= F.col("at")) & (F.col("at") < s["end"])), F.lit(False))).select("group", "doc_id", "at")
        members = written(members, "members")
    rows = results[0]
    for more in results[1:]:
        rows = rows.union(more)
    rows = rows.distinct()
    own = rows.select(
        F.col("source_id").alias("doc_id"), F.col("source_first_word").alias("first_word"), F.col("source_end_word").alias("end_word"), "source_id", "source_first_word", "source_end_word", F.lit(1.0).alias("similarity")
    ).distinct()
    columns = [c.split()[0] for c in RESULT.split(", ")]
    return rows.select(*columns).union(own.select(*columns))
