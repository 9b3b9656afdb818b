"""The k best documents of many queries at once, over documents that come in blocks: what is kept doesn't grow with them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

HITS = "query_id string, doc_id string, score double"
#: Scores (documents by queries) that are held at a time.
MOST_SCORES = 1 << 21


class BatchRanking:
    """Queries that are sums of weighted terms. ``leaves``: (query, field, term, boost, idf, average length) in the order of each query's sum."""

    def __init__(self, leaves: Iterable[tuple[str, str, str, float, float, float]], k: int, k1: float, b: float):
        self.k, self.k1, self.b = k, k1, b
        by_query: dict[str, list[tuple[int, float]]] = {}
        self.codes: dict[str, dict[bytes, int]] = {}
        terms: list[tuple[float, float]] = []
        for query, name, term, boost, idf, average in leaves:
            known = self.codes.setdefault(name, {})
            code = known.setdefault(term.encode("utf-8", "surrogateescape"), len(terms))
            if code == len(terms):
                terms.append((idf, average))
            by_query.setdefault(query, []).append((code, boost))
        self.idf, self.average = (np.array([t[x] for t in terms], np.float64) for x in (0, 1))
        self.queries = list(by_query)
        self.leaf_codes = [np.array([c for c, _ in x], np.int64) for x in by_query.values()]
        self.leaf_boosts = [np.array([s for _, s in x], np.float64) for x in by_query.values()]
        sums: list[dict[int, float]] = [{} for _ in terms]
        for q, x in enumerate(by_query.values()):
            for code, boost in x:
                sums[code][q] = sums[code].get(q, 0.0) + boost
        self.asking = [np.array(list(x), np.int64) for x in sums]
        self.boosts = [np.array(list(x.values()), np.float64) for x in sums]
        self.faint = any((x < 1e-100).any() for x in self.boosts)  # a match may score zero
        self.kept: list[list[tuple[float, bytes]]] = [[] for _ in self.queries]
        self.least = np.full(len(self.queries), -np.inf)

    def texts(self, ids: pa.Array, fields: list[tuple]) -> None:
        """Documents as (field, analyzer, texts as bytes or None)."""
        size, keys, lengths = len(self.idf), [], []
        for name, analyzer, texts in fields:
            known = self.codes.get(name)
            if known is None:
                continue
            for row, text in enumerate(texts):
                found = analyzer.terms(text)[0] if text is not None else ()
                own = [known[t] for t in found if t in known]
                if own:
                    keys.append(np.array(own, np.int64) + row * size)
                    lengths.append((len(own), len(found)))
        if not keys:
            return
        keys, first, tf = np.unique(np.concatenate(keys), return_index=True, return_counts=True)
        lengths = np.array(lengths, np.int64)
        self.postings(ids, keys // size, keys % size, tf, np.repeat(lengths[:, 1], lengths[:, 0])[first])

    def postings(self, ids: pa.Array, row: np.ndarray, code: np.ndarray, tf: np.ndarray, dl: np.ndarray) -> None:
        """Documents as their postings, sorted by row and term."""
        if not len(row):
            return
        tf = tf.astype(np.float64)
        w = self.idf[code] * (tf * (self.k1 + 1) / (tf + self.k1 * ((1 - self.b) + self.b * dl.astype(np.float64) / self.average[code])))
        step = max(1, MOST_SCORES // max(1, len(self.queries)))
        for start in range(0, len(ids), step):
            lo, hi = np.searchsorted(row, [start, start + step])
            if lo < hi:
                self._block(ids.slice(start, step), row[lo:hi] - start, code[lo:hi], w[lo:hi])

    def _block(self, ids: pa.Array, row: np.ndarray, code: np.ndarray, w: np.ndarray) -> None:
        """Scores are summed term by term, which tells the documents that may be among the best; theirs are summed again in their queries' order."""
        size, n = len(self.idf), len(ids)
        near = np.zeros((n, len(self.queries)))
        there = np.zeros(near.shape, bool) if self.faint else None
        order = np.argsort(code, kind="stable")
        first = np.flatnonzero(np.diff(code[order], prepend=-1)).tolist()
        for a, z in zip(first, [*first[1:], len(order)]):
            own = order[a:z]
            term = code[own[0]]
            at = row[own, None], self.asking[term]
            near[at] += w[own, None] * self.boosts[term]
            if there is not None:
                there[at] = True
        least = self.least
        new = np.flatnonzero(least == -np.inf)
        if len(new) and n >= self.k:
            least = least.copy()
            least[new] = np.partition(near[:, new], n - self.k, axis=0)[n - self.k]
        maybe = near >= least - 1e-9 * (1 + np.abs(least))
        queries, rows = np.nonzero((maybe & (near > 0 if there is None else there)).T)
        keys = row * size + code
        first = np.flatnonzero(np.diff(queries, prepend=-1)).tolist()
        for a, z in zip(first, [*first[1:], len(queries)]):
            q, own = int(queries[a]), rows[a:z]
            wanted = own[:, None] * size + self.leaf_codes[q]
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            parts = np.where(keys[at] == wanted, w[at] * self.leaf_boosts[q], 0.0)
            scores = np.add.accumulate(parts, axis=1)[:, -1]
            found = zip((-scores).tolist(), ids.take(pa.array(own)).cast(pa.binary()).to_pylist())
            self.kept[q] = best = sorted([*self.kept[q], *found])[: self.k]
            if len(best) == self.k:
                self.least[q] = -best[-1][0]

    def hits(self) -> Iterator[pa.RecordBatch]:
        """(query_id, doc_id, score): the best of all documents so far."""
        for query, best in zip(self.queries, self.kept):
            if best:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([query] * len(best), pa.string()), pa.array([d for _, d in best], pa.binary()).view(pa.string()), pa.array([-s for s, _ in best], pa.float64())], ["query_id", "doc_id", "score"]
                )
