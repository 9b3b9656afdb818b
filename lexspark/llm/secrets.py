"""Secret scans with a battery of randomness tests, in DataFrame functions alone.

Three base patterns are looked for (assignments, access keys, long hex runs). The method
adds spans of kind ``random``: long runs of base-64 letters whose symbols pass for random.
The encoding of such a run (hex, base 32, base 62, base 64) is inferred from its letters;
a chi-squared test of uniformity over the encoding's alphabet (in equal bins, and over its classes of letters, capitals, digits and signs), a runs test about its middle
and a test of serial correlation are combined by Fisher's rule into one statistic: how far the run is from "drawn uniformly".

A run is reported if it is nearer to that than ordinary text is. What ordinary text scores is measured on the same
corpus: each document gives one stretch of its words for each of ``STYLES``, written in the encoding's letters (hex: a to f;
base 32: capitals; base 62: as they are, and each with a capital; base 64: joined by its signs), of a length drawn by hash. A run's p-value is the share
of these that score as low, among those of its encoding and band of lengths.
Benjamini-Hochberg at ``ALPHA`` over the runs of an encoding and band decides which are reported, so that at most that part of
the reported ones is expected to be ordinary. ``BUILT_IN`` stretches of common words count beside the corpus's own, which a small one has
few of. Bands keep the many short runs from setting
the threshold of the few long ones; under ``LEAST`` letters the tests have too little power.

Statistics count in bins of a hundredth of a decade, so the rules need tables of bounded size however many runs there are.

Defined cases: null and empty texts have no span. Runs of digits alone are numbers, not
secrets. Repeated rows are scanned alike, a row each. Positions are code points of the
whole text. Runs that overlap a base span aren't added. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_or_empty, written

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
LEAST = 20
RUN = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}"
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encoding: what its runs look like, its alphabet. The first that fits is taken.
ENCODINGS = {
    "number": (r"^[0-9_-]+$", ""),
    "hex": (r"^([0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef"),
    "base32": (r"^[A-Z2-7]+=*$", UPPER + "234567"),
    "base62": (r"^[A-Za-z0-9]+=*$", UPPER + LOWER + DIGITS),
    "base64url": (r"^[A-Za-z0-9_-]+=*$", UPPER + LOWER + DIGITS + "-_"),
    "base64": (r"", UPPER + LOWER + DIGITS + "+/"),
}
BANDS = (24, 32, 48, 64, 128)
ALPHA = 0.01
BINS, DECADE = 5000, 100
#: Letters of the stretches of ordinary text: drawn from these lengths, the shortest ones most often.
STRETCHES = (20, 20, 24, 24, 32, 48, 64, 128)
#: How stretches are written: the encoding, what joins the words, and whether each has a capital.
STYLES = (("hex", "", False), ("base32", "", False), ("base62", "", False), ("base62", "", True), ("base64url", "-", False), ("base64", "/", False))
#: Common words, and how many stretches of them (each in an order of its own) count beside those of the corpus.
COMMON = (
    "the and that have with this from they would there their what about which when make like time just know people into year your good some could them other than then now look only come over think also back after "
    "use two how our work first well way even new want because any these give day most der die und nicht mit sich auf eine auch nach wie aus les des une dans pour pas que sur plus avec los las por para como pero"
).split()
BUILT_IN = 2000
#: Matches that are placed together.
BLOCK = 256

SPAN = "struct<start:int,kind:int,end:int>"


def _found(text: Column, pattern: str, group: int = 0, only_if: Column | None = None) -> Column:
    every = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return every if only_if is None else F.when(only_if, every).otherwise(F.array().cast("array<string>"))


def _placed(text: Column, pattern: str, matches: Column) -> Column:
    """array(struct(start, end)) of the matches, from the lengths of what lies between them.

    Folds that append copy what they have, so they run over ``BLOCK`` matches at a time, from where each block starts.
    """
    between = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(between, F.lit(1), F.size(matches)), matches, lambda a, b: F.struct(F.length(a).alias("skip"), F.length(b).alias("own")))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / BLOCK).cast("int")), lambda k: F.slice(steps, k * BLOCK + 1, F.lit(BLOCK)))
    sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, s: a + s["skip"] + s["own"]))
    starts = F.aggregate(sizes, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def walked(block: Column, start: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(start.alias("at"), none.alias("got")),
            lambda acc, s: F.struct(
                (acc["at"] + s["skip"] + s["own"]).alias("at"),
                F.concat(acc["got"], F.array(F.struct((acc["at"] + s["skip"]).alias("start"), (acc["at"] + s["skip"] + s["own"]).alias("end")))).alias("got"),
            ),
        )["got"]

    every = F.flatten(F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), walked))
    return F.when(F.size(matches) > 0, every).otherwise(none)


def _spans(places: Column, kind: int) -> Column:
    return F.transform(places, lambda p: F.struct(p["start"].alias("start"), F.lit(kind).alias("kind"), p["end"].alias("end")))


def _normal_tail(z: Column) -> Column:
    """P(Z > z), by a rational Chebyshev fit of erfc (relative error under 1.2e-7)."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + 0.5 * x)
    fit = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)
    poly = reduce(lambda acc, c: acc * t + F.lit(c), fit[1:], F.lit(fit[0]))
    tail = 0.5 * t * F.exp(-x * x + poly)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _chi2_tail(x: Column, df: Column) -> Column:
    """Wilson and Hilferty's approximation."""
    v = F.lit(2.0) / (9 * df)
    return _normal_tail((F.pow(x / df, F.lit(1 / 3)) - (1 - v)) / F.sqrt(v))


def _pick(encoding: Column, values: dict) -> Column:
    return reduce(lambda acc, kv: F.when(encoding == kv[0], F.lit(kv[1])).otherwise(acc), values.items(), F.lit(None))


def inferred(run: Column) -> Column:
    """The first encoding that a run fits."""
    return reduce(lambda acc, kv: F.when(run.rlike(kv[1][0]), F.lit(kv[0])).otherwise(acc), reversed(list(ENCODINGS.items())[:-1]), F.lit("base64"))


def tested(runs: Column) -> Column:
    """Encoding, band and bin of the statistic for each of array(struct(start, end, encoding, run))."""
    sizes = {k: float(len(a)) for k, (_, a) in ENCODINGS.items()}
    letters = {k: a for k, (_, a) in ENCODINGS.items()}

    def encoded(r: Column) -> Column:
        fits = r["encoding"]
        return F.struct(r["start"].alias("start"), r["end"].alias("end"), fits.alias("encoding"), F.when(fits == "hex", F.lower(r["run"])).otherwise(F.rtrim(r["run"], F.lit("="))).alias("run"))

    def coded(r: Column) -> Column:
        alphabet = _pick(r["encoding"], letters)
        return F.struct(
            *(r[k].alias(k) for k in ("start", "end", "encoding")),
            F.transform(F.sequence(F.lit(1), F.length(r["run"])), lambda k: (F.instr(alphabet, F.substr(r["run"], k, F.lit(1))) - 1).cast("double")).alias("codes"),
            _pick(r["encoding"], sizes).cast("double").alias("size"),
        )

    def counted(r: Column) -> Column:
        """What the tests need, each worked out once: a lambda's expressions are evaluated wherever they stand."""
        codes, size = r["codes"], r["size"]
        n = F.size(codes).cast("double")
        bins = F.greatest(F.lit(2.0), F.least(size, F.floor(n / 5).cast("double")))
        held = lambda test: F.size(F.filter(codes, test)).cast("double")
        squares = F.transform(F.sequence(F.lit(0), bins.cast("int") - 1), lambda b: F.pow(held(lambda c: F.floor(c * bins / size) == b), F.lit(2.0)))
        later = F.sequence(F.lit(1), F.size(codes) - 1)
        half, middle = size / 2, (size - 1) / 2
        return F.struct(
            *(r[k].alias(k) for k in ("start", "end", "encoding", "size")),
            n.alias("n"),
            bins.alias("bins"),
            F.aggregate(squares, F.lit(0.0), lambda a, c: a + c).alias("squares"),
            held(lambda c: c < F.when(size == 16, 10.0).otherwise(26.0)).alias("first"),
            held(lambda c: c >= F.when(size == 16, 10.0).when(size == 32, 26.0).otherwise(52.0)).alias("last"),
            F.size(F.filter(later, lambda k: (F.get(codes, k) >= half) != (F.get(codes, k - 1) >= half))).cast("double").alias("turns"),
            F.aggregate(later, F.lit(0.0), lambda a, k: a + (F.get(codes, k) - middle) * (F.get(codes, k - 1) - middle)).alias("serial"),
        )

    def scored(r: Column) -> Column:
        """Normal scores of the four tests: a chi-squared one by Wilson and Hilferty's approximation."""
        n, size = r["n"], r["size"]

        def root(x: Column, df: Column) -> Column:
            v = F.lit(2.0) / (9 * df)
            return (F.pow(F.greatest(x, F.lit(1e-9)) / df, F.lit(1 / 3)) - (1 - v)) / F.sqrt(v)

        off = lambda seen, share: F.pow(seen - n * share, F.lit(2.0)) / (n * share)
        first = F.when(size == 16, 10.0).otherwise(26.0) / size
        last = F.when(size == 16, 6.0).when(size == 32, 6.0).otherwise(size - 52) / size
        classes = off(r["first"], first) + off(r["last"], last) + F.when(size > 32, off(n - r["first"] - r["last"], 26 / size)).otherwise(0.0)
        return F.struct(
            *(r[k].alias(k) for k in ("start", "end", "encoding", "n")),
            root(r["squares"] * r["bins"] / n - n, r["bins"] - 1).alias("even"),
            root(classes, F.when(size > 32, 2.0).otherwise(1.0)).alias("classes"),
            F.abs((r["turns"] - (n - 1) / 2) / (F.sqrt(n - 1) / 2)).alias("turns"),
            F.abs(r["serial"] / ((size * size - 1) / 12) / F.sqrt(n - 1)).alias("serial"),
        )

    def tests(r: Column) -> Column:
        two_sided = lambda z: F.least(F.lit(1.0), 2 * _normal_tail(z))
        parts = (_normal_tail(r["even"]), _normal_tail(r["classes"]), two_sided(r["turns"]), two_sided(r["serial"]))
        fisher = reduce(lambda a, p: a - 2 * F.log(F.greatest(p, F.lit(1e-300))), parts, F.lit(0.0))
        return F.struct(
            *(r[k].alias(k) for k in ("start", "end", "encoding")),
            reduce(lambda acc, b: acc + (r["n"] >= b).cast("int"), BANDS, F.lit(0)).alias("band"),
            fisher.alias("fisher"),
        )

    def binned(r: Column) -> Column:
        p = F.greatest(_chi2_tail(F.greatest(r["fisher"], F.lit(1e-9)), F.lit(8.0)), F.lit(1e-60))
        return F.struct(
            *(r[k].alias(k) for k in ("start", "end", "encoding", "band")),
            F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor(-F.log10(p) * DECADE))).cast("int").alias("bin"),
        )

    known = F.filter(F.transform(runs, encoded), lambda r: (r["encoding"] != "number") & (F.length(r["run"]) >= 2))
    return reduce(F.transform, (coded, counted, scored, tests, binned), known)


def stretches(doc_id: Column, text: Column) -> Column:
    """One stretch of a document's words for each encoding, where it has enough of them, as array(struct(start, end, encoding, run))."""
    return _stretched(F.xxhash64(doc_id, F.length(text)), F.regexp_extract_all(text, F.lit("[A-Za-z]{2,}"), F.lit(0)))


def _stretched(seed: Column, words: Column) -> Column:
    most = max(STRETCHES) // 2

    def one(encoding: str, join: str, capitals: bool, words: Column) -> Column:
        drawn = F.xxhash64(seed, F.lit(encoding), F.lit(capitals))
        length = F.element_at(F.array(*map(F.lit, STRETCHES)), (F.pmod(drawn, F.lit(len(STRETCHES))) + 1).cast("int"))
        first = F.pmod(F.shiftright(drawn, 8), F.greatest(F.lit(1), F.size(words) - most)).cast("int") + 1
        run = F.array_join(F.slice(words, first, F.lit(most)), " " if capitals else join)
        run = F.left(F.translate(F.initcap(run), " ", join) if capitals else run, length)
        if encoding == "hex":
            run = F.translate(F.lower(run), LOWER, ("abcdef" * 5)[:26])
        elif encoding == "base32":
            run = F.upper(run)
        return F.struct(F.lit(0).alias("start"), F.length(run).alias("end"), F.lit(encoding).alias("encoding"), run.alias("run"))

    every = F.transform(F.array(F.struct(words.alias("words"))), lambda w: F.array(*(one(*style, w["words"]) for style in STYLES)))
    return F.filter(F.element_at(every, 1), lambda r: r["end"] >= LEAST)


def built_in(spark: SparkSession) -> DataFrame:
    """(ordinary: tested stretches of common words)."""
    words = F.transform(F.array_sort(F.transform(F.array(*map(F.lit, COMMON)), lambda w: F.struct(F.xxhash64(w, F.col("id")).alias("order"), w.alias("word")))), lambda x: x["word"])
    return spark.range(BUILT_IN).select(tested(_stretched(F.xxhash64("id"), words)).alias("ordinary"))


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, base: array of spans, runs: array of tested runs, ordinary: tested stretches of its words) per row."""
    text = F.col("text")
    sign = text.contains(":") | text.contains("=")
    found = docs.select("doc_id", text_or_empty().alias("text")).select(
        "doc_id",
        "text",
        _found(text, ASSIGN, 0, sign).alias("assign"),
        _found(text, ASSIGN, 2, sign).alias("value"),
        _found(text, ACCESS, 0, text.contains("AKIA")).alias("access"),
        _found(text, HEX).alias("hex"),
        _found(text, RUN).alias("run"),
    )
    placed = found.select(
        "doc_id",
        F.transform(
            F.filter(
                F.zip_with(_placed(text, ASSIGN, F.col("assign")), F.col("value"), lambda p, v: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.length(v).alias("n"))),
                lambda p: p["n"] >= 8,
            ),
            lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")),
        ).alias("assign"),
        _placed(text, ACCESS, F.col("access")).alias("access"),
        _placed(text, HEX, F.col("hex")).alias("hex"),
        F.zip_with(_placed(text, RUN, F.col("run")), F.col("run"), lambda p, r: F.struct(p["start"].alias("start"), p["end"].alias("end"), inferred(r).alias("encoding"), r.alias("run"))).alias("run"),
        stretches(F.col("doc_id"), text).alias("ordinary"),
    )
    base = F.array_sort(F.concat(*(_spans(F.col(k), at) for at, k in enumerate(KINDS[:3]))).cast(f"array<{SPAN}>"))
    ordinary = F.transform(tested(F.col("ordinary")), lambda r: F.struct(*(r[k].alias(k) for k in ("encoding", "band", "bin"))))
    return placed.select("doc_id", base.alias("base"), tested(F.col("run")).alias("runs"), ordinary.alias("ordinary"))


def thresholds(found: DataFrame, alpha: float = ALPHA) -> dict[tuple[str, int], int]:
    """For each (encoding, band) the greatest bin that is reported, by Benjamini-Hochberg; strata without one are left out.

    A stratum has at most ``BINS`` bins, so the counts that reach the driver are bounded.
    """
    count = lambda found, name: found.select(F.explode(name).alias("r")).groupBy("r.encoding", "r.band", "r.bin").agg(F.count("*").alias("n")).collect()
    seen: dict[tuple[str, int], dict[int, int]] = {}
    for r in count(found, "runs"):
        seen.setdefault((r["encoding"], r["band"]), {})[r["bin"]] = r["n"]
    ordinary = [tuple(r) for df in (found, built_in(found.sparkSession)) for r in count(df, "ordinary")] if seen else []
    cuts = {}
    for (encoding, band), bins in seen.items():
        null = [0] * BINS
        for e, b, at, n in ordinary:
            if e == encoding and b == band:
                null[at] += n
        low, so_far, m, whole = list(accumulate(null)), 0, sum(bins.values()), sum(null)
        for at in sorted(bins):
            so_far += bins[at]
            if (1 + low[at]) / (1 + whole) <= alpha * so_far / m:
                cuts[encoding, band] = at
    return cuts


def secrets(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Per row: counts of base spans, their digest, and all spans as kind:start:end."""
    found = written(scanned(docs), "secrets")
    cuts = thresholds(found, alpha)

    def random(r: Column) -> Column:
        limit = reduce(lambda acc, kv: F.when((r["encoding"] == kv[0][0]) & (r["band"] == kv[0][1]), F.lit(kv[1])).otherwise(acc), cuts.items(), F.lit(-1))
        return (r["bin"] <= limit) & ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))

    extra = F.transform(F.filter("runs", random), lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("kind"), r["end"].alias("end")))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])),
        F.sha2(said(F.col("base")), 256).alias("base_sha256"),
        said(F.array_sort(F.concat("base", extra.cast(f"array<{SPAN}>")))).alias("spans"),
    )
