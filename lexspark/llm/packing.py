"""Packing documents along a space-filling curve.

Each document's token ids are hashed to vectors; their mean, projected to four dimensions,
gives a Hilbert key. Documents are range-sorted by (key, id), so that a key which many
copies share is split like any other stretch; there are as many ranges as make about ``RANGE_IDS`` ids each, and each is cut into sequences of
``length`` ids along the curve: neighbours on the curve share sequences. What is left at the
end of a range goes into sequences whose lengths are powers of two, so nothing is padded.

Defined cases: a null or empty text is the end id alone. A text that spells a special token
gets that token's id, as the tokenizer itself gives it. Rows without an id come first in
their key's order; repeated rows are packed as often as they occur. Texts count whole and may
be cut anywhere, over any number of sequences. An empty table gives no pieces.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, written

LENGTH = 4096
#: Ids in a range: a task cuts as many. Ranges are as many as that takes.
RANGE_IDS = 1 << 22
END_ID = 2
DIMS, BITS = 4, 15
#: Chunks of text whose ids a task remembers.
MEMORY = 200_000
MARK = "\x00"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """The ids of the tokenizer in ``path``, faster: pairs are merged by tiktoken.

    The file's merges work on words whose last byte carries an end mark. As ids of merged
    pairs ascend in the order of merging, byte strings with a mark as their last byte and those ids
    as ranks give the same merges. White space always ends a word, so the ids of a
    text are those of its chunks between spaces; a task remembers the chunks it has seen.
    A chunk with other than printable Latin-1 characters goes to the tokenizer as it is.
    """

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        whole = json.load(open(path, encoding="utf-8"))
        model = whole["model"]
        special = [t["content"] for t in whole.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, special)), regex.IGNORECASE) if special else None
        if len(model["vocab"]) > 1 << 16 or not any(word.endswith("</w>") for word in model["vocab"]):
            raise ValueError("a vocabulary of merged bytes with end marks and at most 65,536 ids is needed")
        codes = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(c): c for c in codes} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in codes)}
        ranks: dict[bytes, int] = {}
        for word, k in model["vocab"].items():
            end = word.endswith("</w>")
            body = word.removesuffix("</w>")
            if all(c in letters for c in body):
                ranks[bytes(letters[c] for c in body) + MARK.encode() * end] = k
        self.merge = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.gap = ranks[b"\n" + MARK.encode()]
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|\n|[^\s\p{L}\p{N}]+")
        self.known: dict[str, bytes] = {}

    def exact(self, chunk: str) -> bytes:
        return np.array(self.plain.encode(chunk, add_special_tokens=False).ids, "<u2").tobytes()

    def learn(self, chunks: list[str]) -> None:
        """Fills ``known`` for printable Latin-1 chunks without spaces, all in one go.

        Such letters are composed already, and their lower case depends on no neighbour.
        """
        words = self.words.findall("\n".join(chunks).lower())
        ids = np.array(self.merge.encode_ordinary(MARK.join(words) + MARK), "<u2")
        cuts = np.flatnonzero(ids == self.gap)
        raw, known = ids.tobytes(), self.known
        for c, a, b in zip(chunks, [0, *(2 * cuts + 2).tolist()], [*(2 * cuts).tolist(), 2 * len(ids)]):
            known[c] = raw[a:b]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian 16-bit numbers; a few texts at a time are learnt together."""
        if len(self.known) > MEMORY:
            self.known.clear()
        known, split, new = self.known, [], set()
        for text in texts:
            if self.special and self.special.search(text):
                split.append([text])
                known[text] = self.exact(text)
                continue
            flat = text.replace("\n", " ")
            chunks = flat.split(" ")
            split.append(chunks)
            own = set(chunks).difference(known)
            if not easy(flat):
                for c in own:
                    if not easy(c):
                        known[c] = self.exact(c)
                own = own.difference(known)
            new |= own
        if new:
            self.learn(list(new))
        return [b"".join(map(known.__getitem__, chunks)) for chunks in split]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]


def easy(text: str) -> bool:
    """Printable (spaces, but no other white space) and Latin-1."""
    if not text.isprintable():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=1)
def _directions() -> np.ndarray:
    """Hashed vectors of all 16-bit ids, projected to ``DIMS`` dimensions."""
    x = np.arange(65536 * DIMS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) / 2.0**52 - 1).reshape(-1, DIMS)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of rows of unsigned ``bits``-bit coordinates."""
    x = points.astype(np.int64).copy()
    n, dims = x.shape
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess work of the inverse transform
        p = q - 1
        for i in range(dims):
            high = (x[:, i] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] = np.where(high, x[:, 0] ^ p, x[:, 0] ^ swap)
            x[:, i] ^= swap if i else 0
        q >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(n, np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[:, dims - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def curve_keys(ids: list[bytes]) -> np.ndarray:
    """Hilbert keys of documents given as 16-bit ids, none empty."""
    sums = np.array([_directions()[np.frombuffer(b, "<u2")].mean(0) for b in ids]).reshape(-1, DIMS)
    spread = np.clip(2 * sums, -1, 1)  # means of many ids lie near zero
    return hilbert(((spread + 1) / 2 * ((1 << BITS) - 1)).astype(np.int64))


def tokens(text: Column, path: str) -> Column:
    """struct(ids: 16-bit numbers with the end id, key: place on the curve)."""

    @F.arrow_udf("struct<ids:binary,key:long>")
    def tokenize(texts: pa.Array) -> pa.Array:
        end, ids = np.array([END_ID], "<u2").tobytes(), []
        for at in range(0, len(texts), 32):
            ids += [b + end for b in encoder(path).encode_many([t.as_py() or "" for t in texts[at : at + 32]])]
        release()
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(curve_keys(ids), pa.int64())], names=["ids", "key"])

    return tokenize(text)


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Pieces of one range, in order. Sequence ids: the partition's number, then a count."""
    base = TaskContext.get().partitionId() << 40
    names = [part.split()[0] for part in PIECE.split(", ")]
    held: list[tuple] = []  # documents' parts that aren't in a sequence yet: (doc_id, start, ids, doc_tokens)
    size, count = 0, 0

    def emit(room: int, rows: list[list]) -> None:
        """Takes ``room`` ids off ``held`` as one sequence."""
        nonlocal size, count
        offset = taken = 0
        while offset < room:
            doc_id, start, ids, total = held[taken]
            n = min(len(ids), room - offset)
            crc = zlib.crc32(ids[:n].astype("<u4").tobytes())
            rows.append([doc_id, start, n, crc, total, base + count, offset])
            offset += n
            if n == len(ids):
                taken += 1
            else:
                held[taken] = (doc_id, start + n, ids[n:], total)
        del held[:taken]
        size -= room
        count += 1

    def batch_of(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))], names)

    for batch in batches:
        rows: list[list] = []
        for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = np.frombuffer(raw.as_py(), "<u2")
            held.append((doc_id, 0, ids, len(ids)))
            size += len(ids)
            while size >= length:
                emit(length, rows)
        yield batch_of(rows)
    rows = []
    while size:
        emit(1 << (size.bit_length() - 1), rows)
    yield batch_of(rows)
    del rows, held
    release()


def packed(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """The pieces (see ``PIECE``) of all rows of ``docs``."""
    path = path or default_vocabulary()
    rows = docs.select("doc_id", tokens(F.col("text"), path).alias("t")).select("doc_id", "t.ids", "t.key")
    rows = written(rows, "tokens")
    ids = rows.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    spark = docs.sparkSession
    parts = max(1, -(-ids // (2 * RANGE_IDS)), int(spark.conf.get("spark.sql.shuffle.partitions")))
    curve = rows.repartitionByRange(parts, "key", "doc_id").sortWithinPartitions("key", "doc_id", "ids")
    return curve.select("doc_id", "ids").mapInArrow(lambda batches: _cut(batches, length), PIECE)
