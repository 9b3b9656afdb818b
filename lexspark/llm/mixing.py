"""Mixing to target weights with soft domain membership, in DataFrame functions alone.

A classifier trained on the label table predicts for each document how likely it belongs to
each domain (``good``, ``low``, ``toxic``). Its scores are those of naive Bayes over hashed words, each counted once a
document in training, with log ratios against the first domain that are moved towards zero by ``SHRINK`` standard errors
and by ``MARGIN``: what chance may explain counts for nothing, nor do the slight differences that large samples make certain.
Scores are then calibrated: the labelled documents are dealt into ``FOLDS`` parts, each part is scored by
what the other ones teach, and a document's posterior is the share of the domains among the labelled documents whose
scores fall into the same cell (between ``EDGES``), smoothed by ``PRIOR`` documents.

A document's rate is how many times it is expected to
enter the mix. Projected gradient descent fits rates that aren't negative, from one on, to
least squares between the domains' expected token totals and their targets: the total
budget is what gives the first domain all its tokens, and each domain is to get its weight's part. Each step
is scaled by the curvature over the rates that are free to move, tried at several lengths beside the plain one, and
the best is taken, until each total is within ``TOLERANCE`` of its target (as a part of all tokens) or no step takes ``LEAST_GAIN`` off the squares.
What is left is in the column ``residual``.

A rate follows from a document's posteriors alone. So documents are first summed
to cells of equal posteriors (in hundredths), a table of bounded size that holds the rates; each step
is two aggregates over the cells, and only some numbers for each domain reach the driver. A document
enters the mix floor(rate + u) times, u hashed from its id and text. A stage repeats no row: there, rates are
scaled by the greatest, which leaves the weights as they are.

Defined cases: a null or empty text has no tokens and the posteriors of its cell. Rows with one id
and text share one decision. Labels with a null class are ignored. Without labels every document is in
the first domain at rate one. An empty table gives no rows. The fit reads at most ``most`` labelled rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .ngrams import SCALE, grams, labelled, log_ratio, scores

DOMAINS = ("good", "low", "toxic")
TARGETS = {"good": 0.90, "low": 0.05, "toxic": 0.05}
BUCKETS = 1 << 16
MOST_LABELLED = 100_000
#: Standard errors and a margin (log 2) by which log ratios shrink.
SHRINK, MARGIN = 2.0, 0.6931471805599453
#: Bounds of the calibration's cells, in nats of score, and the documents by which it is smoothed.
EDGES = (-8.0, -4.0, -2.0, -1.0, -0.25, 0.25, 1.0, 2.0, 4.0, 8.0, 16.0)
PRIOR, FOLDS = 6.0, 5
CELLS = 100
#: Where a fit ends: the distance of a total, and what a step has to take off the sum of squares.
TOLERANCE, LEAST_GAIN = 1e-4, 0.02


def domain_of_labels() -> Column:
    return F.when(F.col("toxic") == 1, F.lit("toxic")).when((F.col("quality") == 0) & (F.col("toxic") == 0), F.lit("low")).when((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit("good"))


def model(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(bucket, a weight for each domain but the first, of all labels and without either fold), the labelled documents (row, domain, fold, g), and the domains' numbers of them."""
    rows = labelled(docs, labels, most, domain_of_labels())
    fold = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int").alias("fold")
    known = written(rows.select(F.monotonically_increasing_id().alias("row"), "domain", fold, grams(F.col("text"), buckets).alias("g")), "labelled")
    sizes = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    each = known.select("domain", "fold", F.explode(F.array_distinct("g")).alias("bucket")).groupBy("bucket", "domain", "fold").count()
    parts = [(d, k) for d in DOMAINS for k in range(FOLDS)]
    counts = each.groupBy("bucket").agg(*(F.coalesce(F.sum(F.when((F.col("domain") == d) & (F.col("fold") == k), F.col("count"))), F.lit(0)).alias(f"{d}_{k}") for d, k in parts))
    counts = written(counts, "domains")
    totals = counts.agg(*(F.sum(f"{d}_{k}").alias(f"{d}_{k}") for d, k in parts)).first()
    first, names, weights = DOMAINS[0], [], []
    for without in (None, *range(FOLDS)):
        kept = [k for k in range(FOLDS) if k != without]
        n = {d: reduce(lambda a, b: a + b, (F.col(f"{d}_{k}") for k in kept)) for d in DOMAINS}
        whole = {d: F.lit(float(sum(totals[f"{d}_{k}"] or 0 for k in kept))) for d in DOMAINS}
        names += [d if without is None else f"{d}_{without}" for d in DOMAINS[1:]]
        weights += [log_ratio(n[d], whole[d], n[first], whole[first], buckets, SHRINK, MARGIN) for d in DOMAINS[1:]]
    return written(counts.select("bucket", *(w.alias(c) for w, c in zip(weights, names))).where(" or ".join(f"{c} <> 0" for c in names)), "weights"), known, sizes


def bins(scores: list[Column]) -> list[Column]:
    """The calibration's cell of scores in millionths, a number for each domain but the first."""
    return [reduce(lambda a, b: a + b, (F.when(s >= e * SCALE, 1).otherwise(0) for e in EDGES)) for s in scores]


def calibrated(weights: DataFrame, known: DataFrame, sizes: dict[str, int]) -> list[tuple]:
    """(bin, bin, posteriors in hundredths) of every cell; there are (len(EDGES) + 1)^2."""
    others = DOMAINS[1:]
    tokens = known.select("row", "domain", "fold", F.explode_outer("g").alias("bucket")).join(F.broadcast(weights), "bucket", "left")
    own = lambda d: reduce(lambda a, k: F.when(F.col("fold") == k, F.col(f"{d}_{k}")).otherwise(a), range(1, FOLDS), F.col(f"{d}_0"))
    theirs = [F.coalesce(F.sum(own(d)), F.lit(0)).alias(d) for d in others]
    scored = tokens.groupBy("row", "domain").agg(*theirs)
    named = [b.alias(f"bin_{d}") for b, d in zip(bins([F.col(d) for d in others]), others)]
    found = scored.select("domain", *named).groupBy("domain", *(f"bin_{d}" for d in others)).count().collect()
    whole = sum(sizes.values())
    prior = [(sizes.get(d, 0) + 1) / (whole + len(DOMAINS)) for d in DOMAINS]
    seen: dict[tuple, list[float]] = {}
    sides: list[dict[int, list[float]]] = [{} for _ in others]
    for r in found:
        key = tuple(r[f"bin_{d}"] for d in others)
        at = DOMAINS.index(r["domain"])
        for counts in (seen.setdefault(key, [0.0] * len(DOMAINS)), *(side.setdefault(k, [0.0] * len(DOMAINS)) for side, k in zip(sides, key))):
            counts[at] += r["count"]

    def smoothed(counts: list[float], towards: list[float]) -> list[float]:
        n = sum(counts) + PRIOR
        return [(c + PRIOR * t) / n for c, t in zip(counts, towards)]

    none, out = [0.0] * len(DOMAINS), []
    for key in product(range(len(EDGES) + 1), repeat=len(others)):
        # Where a cell has few documents, the scores count as independent given the domain.
        guess = list(prior)
        for side, k in zip(sides, key):
            guess = [g * p / q for g, p, q in zip(guess, smoothed(side.get(k, none), prior), prior)]
        p = smoothed(seen.get(key, none), [g / sum(guess) for g in guess])
        rest = [round(x * CELLS) for x in p[1:]]
        out.append((*key, [CELLS - sum(rest), *rest]))
    return out


def posteriors(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, text_hash, rows, tokens, p: array of hundredths in the order of ``DOMAINS``)."""
    weights, known, sizes = model(docs, labels, most)
    others = DOMAINS[1:]
    scored = scores(docs, weights.select("bucket", *others), list(others), BUCKETS)
    if not sizes:
        return scored.select("doc_id", "text_hash", "rows", F.col("n").alias("tokens"), F.array(*(F.lit(x) for x in (CELLS, *(0 for _ in others)))).alias("p"))
    table = docs.sparkSession.createDataFrame(calibrated(weights, known, sizes), ", ".join([*(f"bin_{d} int" for d in others), "p array<int>"]))
    named = [b.alias(f"bin_{d}") for b, d in zip(bins([F.col(d) for d in others]), others)]
    binned = scored.select("doc_id", "text_hash", "rows", F.col("n").alias("tokens"), *named)
    return binned.join(F.broadcast(table), [f"bin_{d}" for d in others]).select("doc_id", "text_hash", "rows", "tokens", "p")


def solved(a: list[list[float]], b: list[float]) -> list[float]:
    """x with a x = b, by elimination; ``a`` is small and positive definite."""
    n, rows = len(b), [[*r, x] for r, x in zip(a, b)]
    for k in range(n):
        top = max(range(k, n), key=lambda i: abs(rows[i][k]))
        rows[k], rows[top] = rows[top], rows[k]
        for i in range(k + 1, n):
            f = rows[i][k] / rows[k][k]
            rows[i] = [x - f * y for x, y in zip(rows[i], rows[k])]
    out = [0.0] * n
    for k in range(n - 1, -1, -1):
        out[k] = (rows[k][n] - sum(rows[k][j] * out[j] for j in range(k + 1, n))) / rows[k][k]
    return out


def fitted(cells: DataFrame, targets: dict[str, float], tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    """(p, rate) of cells (p, tokens), and the largest distance that is left between a total and its target."""
    n = len(DOMAINS)
    share = [F.element_at("p", k + 1) / CELLS for k in range(n)]
    exact = lambda x: F.sum(F.round(x * 1000).cast("decimal(38,0)")).cast("double") / 1000  # noqa: E731  in any order of rows
    now = cells.withColumn("rate", F.lit(1.0))
    totals = [x or 0.0 for x in now.agg(*(exact(F.col("tokens") * s) for s in share)).first()]
    scale = sum(totals)
    if not scale or not targets[DOMAINS[0]]:
        return now.select("p", "rate"), 0.0
    wanted = [totals[0] / targets[DOMAINS[0]] * targets[d] for d in DOMAINS]
    weigh = lambda numbers: reduce(lambda a, b: a + b, (s * F.lit(float(x)) for s, x in zip(share, numbers)))
    missed = lambda t: [(a - b) / scale for a, b in zip(t, wanted)]
    ways = [2.0**-k for k in range(8)]
    while True:
        gradient = missed(totals)
        if max(map(abs, gradient)) < tolerance:
            break
        free = (F.col("rate") > 0) | (weigh(gradient) < 0)
        pairs = [(j, k) for j in range(n) for k in range(j, n)]
        sums = now.agg(*(exact(F.when(c, F.col("tokens") * share[j] * share[k]).otherwise(F.lit(0.0))) for c in (free, F.lit(True)) for j, k in pairs)).first()
        square = [[(sums[pairs.index((min(j, k), max(j, k)))] or 0.0) / scale + 1e-9 * (j == k) for k in range(n)] for j in range(n)]
        largest = max(sum((sums[len(pairs) + pairs.index((min(j, k), max(j, k)))] or 0.0) for k in range(n)) for j in range(n)) / scale
        newton = solved(square, gradient)
        steps = [F.when(free, F.greatest(F.lit(0.0), F.col("rate") - weigh([w * x for x in newton]))).otherwise(F.lit(0.0)) for w in ways]
        steps.append(F.greatest(F.lit(0.0), F.col("rate") - weigh([x / largest for x in gradient])))
        found = now.agg(*(exact(r * F.col("tokens") * s) for r in steps for s in share)).first()
        tried = [[x or 0.0 for x in found[k * n : (k + 1) * n]] for k in range(len(steps))]
        length = lambda t: sum(x * x for x in missed(t))
        best = min(range(len(steps)), key=lambda k: (length(tried[k]), k))
        if length(tried[best]) > (1 - LEAST_GAIN) * length(totals):
            break
        last, now, totals = now, written(now.select("p", "tokens", steps[best].alias("rate")), "rates"), tried[best]
        discard(last)
    return now.select("p", "rate"), max(map(abs, missed(totals)))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, seed: int = 42, repeats: bool = True) -> DataFrame:
    """(doc_id, text_hash, rows, tokens, p_good, p_low, p_toxic, rate, copies, residual) for each id and text."""
    found = written(posteriors(docs, labels), "posteriors")
    cells = written(found.groupBy("p").agg(F.sum(F.col("tokens") * F.col("rows")).alias("tokens")), "cells")
    rates, residual = fitted(cells, targets or TARGETS)
    if not repeats:
        greatest = rates.agg(F.max("rate")).first()[0] or 1.0
        rates = rates.withColumn("rate", F.col("rate") / max(1.0, greatest))
    uniform = F.shiftrightunsigned(F.xxhash64("doc_id", "text_hash", F.lit(seed)), 11).cast("double") / float(1 << 53)
    rated = found.join(F.broadcast(rates.select("p", F.round("rate", 6).alias("rate"))), "p")  # a row for each cell of the calibration at most
    return rated.select(
        "doc_id", "text_hash", "rows", "tokens",
        *((F.element_at("p", k + 1) / CELLS).alias(f"p_{d}") for k, d in enumerate(DOMAINS)),
        "rate", F.floor(F.col("rate") + uniform).alias("copies"), F.lit(round(residual, 9)).alias("residual"),
    )


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, tokens, posteriors, rate, copies, residual): a row for each row of ``docs``."""
    found = mixed(docs, labels, targets)
    return found.select("*", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("row")).drop("row", "rows", "text_hash")


def keep_mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """The rows of ``docs`` that a mix without repeats draws."""
    chosen = mixed(docs, labels, targets, repeats=False).where("copies > 0").select(F.col("doc_id").alias("m_id"), F.col("text_hash").alias("m_hash"))
    whole, hashed = docs.select(F.struct("*").alias("row")), F.xxhash64(F.coalesce("row.text", F.lit("")))
    return whole.join(chosen, F.col("row.doc_id").eqNullSafe(F.col("m_id")) & (hashed == F.col("m_hash"))).select("row.*")
