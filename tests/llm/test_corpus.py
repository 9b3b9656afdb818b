"""Operators on whole tables, and the pipeline, against brute force and held-out labels."""

import html
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexspark.llm import html_extract, line_dedup, mixing, quality_classifier, quality_rules
from lexspark.llm.common import table

from .fixtures import SCHEMA, frame, prose, texts


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).cache()


@pytest.fixture(scope="module")
def labels(spark, small):
    return table(spark, small, "labels")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# line dedup


def kept_lines(rows):
    """Text of each (id, text) once all windows of two lines that occurred earlier are gone."""
    seen, out = set(), {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = (text or "").split("\n")
        full = [(k, x.strip(line_dedup.SPACES)) for k, x in enumerate(lines) if x.strip(line_dedup.SPACES)]
        gone = set()
        for (a, x), (b, y) in zip(full, full[1:]):
            if (x, y) in seen:
                gone |= set(range(a, b + 1))
            seen.add((x, y))
        out[doc_id, text] = text if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_line_dedup(spark, docs, small):
    unique = [r for r in texts() if r[0] is not None]
    for df, rows in ((frame(spark, unique), unique), (table(spark, small, "documents"), None)):
        rows = rows or [tuple(r) for r in df.select("doc_id", "text").collect()]
        want = kept_lines(rows)
        got = line_dedup.lines_deleted(df).collect()
        assert Counter((r.doc_id, r.text) for r in got) == Counter((i, want[i, t]) for i, t in rows)
    kept = line_dedup.keep_lines(docs)
    ids = Counter(r.doc_id for r in kept.collect())
    assert kept.columns == docs.columns and ids[3] == 2 and ids[7] == 0 and ids[20] == ids[21] == 1 and ids[None] == 2
    assert line_dedup.lines_deleted(empty(spark)).count() == 0


def test_line_dedup_windows_are_winnowed():
    text = "\n".join(f"line {k}" for k in range(40))
    for window in (2, 3, 5):
        places = line_dedup.window_places(text, window)
        assert len(places) == 40 - window + 1
        assert all(p["first"] <= p["at"] <= p["last"] for p in places)
        anchors = sorted({p["at"] for p in places})
        assert all(b - a <= window for a, b in zip(anchors, anchors[1:]))


# quality classifier


def test_classifier_counts_every_gram(spark, docs):
    grams = quality_classifier.Grams(64)
    rows = docs.select("text", F.when(F.col("doc_id") == 3, 1).otherwise(0).alias("good"))
    got = {r.bucket: (r.raw, r.target) for r in quality_classifier.counted(rows, 64).collect()}
    raw, target = Counter(), Counter()
    for doc_id, text in texts():
        own = grams(text).tolist()
        words = re.findall(r"\w+|[^\w\s]+", (text or "").lower())
        assert len(own) == len(words) + max(0, len(words) - 1)
        raw.update(own)
        if doc_id == 3:
            target.update(own)
    assert got == {b: (n, target[b]) for b, n in raw.items()}


def test_classifier_weights_are_log_ratios(spark, small, labels):
    """Every document's weight, and the draw, by brute force."""
    rows = [tuple(r) for r in table(spark, small, "documents").select("doc_id", "text").collect()]
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and r.toxic == 0}
    size = quality_classifier.BUCKETS
    grams = quality_classifier.Grams(size)
    raw, target = np.zeros(size), np.zeros(size)
    for doc_id, text in rows:
        np.add.at(raw, grams(text), 1)
        if doc_id in good:
            np.add.at(target, grams(text), 1)
    ratio = np.log((target + 0.5) / (target.sum() + 0.5 * size)) - np.log((raw + 0.5) / (raw.sum() + 0.5 * size))
    want = {i: ratio[grams(t)].sum() for i, t in rows}
    got = quality_classifier.resampled(table(spark, small, "documents"), labels).collect()
    assert all(abs(r.log_weight - want[r.doc_id]) <= 1e-6 * (r.n_grams + 1) for r in got)
    noise = np.array([r.gumbel_key - r.log_weight for r in got])
    assert abs(noise.mean() - 0.577) < 0.4 and 0.8 < noise.std() < 1.8
    order = sorted(got, key=lambda r: (-r.gumbel_key, r.doc_id))
    n = sum(r.kept for r in got)
    assert all(r.kept for r in order[:n])


def test_classifier_draws_the_share(spark, small, labels, docs):
    all_docs = table(spark, small, "documents")
    got = quality_classifier.resampled(all_docs, labels).collect()
    n = all_docs.count()
    judged = {r.doc_id: int(r.quality == 1 and r.toxic == 0) for r in labels.collect()}
    share = np.mean([judged[r.doc_id] for r in got if r.doc_id in judged])
    kept = {r.doc_id for r in got if r.kept}
    assert len(got) == n and len(kept) == round(share * n)
    good, bad = [[i in kept for i in judged if judged[i] == k] for k in (1, 0)]
    assert np.mean(good) > np.mean(bad) + 0.3
    assert min(r.gumbel_key for r in got if r.kept) >= max(r.gumbel_key for r in got if not r.kept)
    half = quality_classifier.resampled(docs, labels, share=0.5).collect()
    assert len(half) == len(texts()) and abs(sum(r.kept for r in half) - 8) <= 1
    none = labels.where("false")
    assert all(r.kept for r in quality_classifier.resampled(docs, none).collect())
    assert quality_classifier.resampled(empty(spark), labels).count() == 0


def test_classifier_on_held_out_labels(spark, small, labels):
    all_docs = table(spark, "/root/testdata/sf0.01", "documents")
    known = table(spark, "/root/testdata/sf0.01", "labels")
    train = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    test = known.join(train, "doc_id", "left_anti")
    got = quality_classifier.resampled(all_docs, train).join(test.where("toxic = 0"), "doc_id").select("log_weight", (F.col("quality") == 1).alias("good")).collect()
    good, bad = ([r.log_weight for r in got if r.good is k] for k in (True, False))
    auc = np.mean([[(a > b) + 0.5 * (a == b) for b in bad] for a in good])
    assert auc > 0.85


def test_least_kept_is_the_kth_greatest(spark):
    keys = spark.createDataFrame([(k * k % 97 * 10**9 - 5, 1 + k % 3) for k in range(200)], "key long, rows long")
    flat = sorted((r.key for r in keys.collect() for _ in range(r.rows)), reverse=True)
    for k in (1, 7, 150, len(flat) - 1):
        low, inside = quality_classifier.least_kept(keys, k)
        assert low == flat[k - 1] and inside == k - sum(x > low for x in flat)
    assert quality_classifier.least_kept(keys, len(flat)) is None


# mixing


def test_mixing_rates(spark, small, labels, docs):
    all_docs = table(spark, small, "documents")
    got = mixing.mix(all_docs, labels).collect()
    assert len(got) == all_docs.count()
    assert all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in got)
    assert all(abs(r.p_good + r.p_low + r.p_toxic - 1) < 0.02 for r in got)
    rates = np.array([[r.p_good, r.p_low, r.p_toxic] for r in got])
    expected = (rates * np.array([[r.tokens * r.rate] for r in got])).sum(0)
    shares = expected / expected.sum()
    before = (rates * np.array([[r.tokens] for r in got])).sum(0)
    wanted = np.array([mixing.TARGETS[d] for d in mixing.DOMAINS])
    assert np.abs(shares - wanted).sum() <= np.abs(before / before.sum() - wanted).sum() + 1e-9
    assert len(mixing.mix(docs, labels).collect()) == len(texts())
    assert mixing.mix(empty(spark), labels).count() == 0


def least_squares(p, tokens, wanted, steps=20_000):
    """Nonnegative rates from one on, by accelerated projected gradients."""
    scale, at = tokens.sum(), p * tokens[:, None]
    step = 1 / np.linalg.eigvalsh(at.T @ p / scale).max()
    r = y = np.ones(len(p))
    t = 1.0
    for _ in range(steps):
        new, faster = np.maximum(0, y - step * (p @ ((at.T @ y - wanted) / scale))), (1 + np.sqrt(1 + 4 * t * t)) / 2
        r, y, t = new, new + (t - 1) / faster * (new - r), faster
    return at.T @ r


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_mixing_meets_its_targets(spark, sf):
    """The expected totals are those of a brute-force least squares, and within 0.01 of the targets."""
    rows = mixing.mix(*(table(spark, f"/root/testdata/{sf}", t) for t in ("documents", "labels"))).select("p_good", "p_low", "p_toxic", "tokens", "rate", "copies", "residual").toPandas()
    p, tokens = rows[["p_good", "p_low", "p_toxic"]].to_numpy(), rows["tokens"].to_numpy(float)
    targets = np.array([mixing.TARGETS[d] for d in mixing.DOMAINS])
    wanted = (p[:, 0] * tokens).sum() / targets[0] * targets
    got, best = (p * (tokens * rows["rate"].to_numpy())[:, None]).sum(0), least_squares(p, tokens, wanted)
    assert np.abs(got / got.sum() - targets).max() < 0.01
    assert np.abs(got - wanted).max() / tokens.sum() <= np.abs(best - wanted).max() / tokens.sum() + 2e-4
    assert abs(rows["residual"][0] - np.abs(got - wanted).max() / tokens.sum()) < 1e-4
    assert abs(rows["copies"].mean() - rows["rate"].mean()) < 0.05


def test_mixing_fit_where_targets_cant_be_met(spark):
    """All documents alike: nothing can part the domains, and what is left is said."""
    cells = spark.createDataFrame([([80, 10, 10], 1000), ([80, 10, 10], 500)], "p array<int>, tokens long")
    rates, residual = mixing.fitted(cells, mixing.TARGETS)
    want = least_squares(np.array([[0.8, 0.1, 0.1]] * 2), np.array([1000.0, 500.0]), 1200 / 0.9 * np.array([0.9, 0.05, 0.05]), 2000)
    wanted = 1200 / 0.9 * np.array([0.9, 0.05, 0.05])
    assert abs(residual - np.abs(want - wanted).max() / 1500) < 1e-3 and len({r.rate for r in rates.collect()}) == 1


def test_mixing_solves_small_systems():
    a, b = np.array([[2.0, 0.5, 0.1], [0.5, 1.0, 0.2], [0.1, 0.2, 3.0]]), np.array([1.0, -2.0, 0.5])
    assert np.allclose(mixing.solved(a.tolist(), b.tolist()), np.linalg.solve(a, b))


def test_mixing_on_held_out_labels(spark):
    all_docs = table(spark, "/root/testdata/sf0.1", "documents")
    known = table(spark, "/root/testdata/sf0.1", "labels").where("toxic = 0")
    train = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    got = mixing.mix(all_docs, train).join(known.join(train, "doc_id", "left_anti"), "doc_id").groupBy("quality").agg(F.avg("p_low").alias("p")).collect()
    by_class = {r.quality: r.p for r in got}
    assert by_class[0] > 0.6 and by_class[1] < 0.25


def test_mixing_keeps_rows_and_columns(spark, labels, docs):
    kept = mixing.keep_mixed(docs, labels.where("false"))
    assert kept.columns == docs.columns
    assert Counter(map(str, kept.collect())) == Counter(map(str, docs.collect()))


# HTML extraction

PAGE = """<!doctype html><html><head><title>T</title><style>p{{}}</style><script>var a = "<p>no</p>";</script></head><body>
<div class="cookie-notice">We use cookies</div><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<article><h2>{title}</h2><p>First &amp; <b>bold</b>
 text&nbsp;here &#8212; caf&eacute;.</p><div class="ad">Buy now</div><ul><li>one</li><li>two <i>three</i></li></ul><pre>x
y</pre><aside>Aside</aside><p>Last<br>line<!-- hidden --></p></article>
<section id="comments"><p>Reader says</p></section><form><input><button>Go</button></form><footer>Imprint</footer></body></html>"""


def test_html_main_text(spark):
    rows = [(k, f"https://h{k % 2}.example/a", PAGE.format(title=f"Title {k}")) for k in range(20)]
    rows += [(100, None, None), (101, "", ""), (102, "https://x.example/", "<p>open <p>and &lt;b&gt; <span>never closed"), (103, "https://x.example/", "plain"), (0, "https://h0.example/a", rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_extract.extracted(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = got.collect()
    assert len(found) == len(rows) and all(len(r.text) == r.n_chars for r in found)
    by_id = {r.page_id: r.text for r in found}
    for k in range(20):
        assert by_id[k] == f"Title {k}\nFirst & bold text here — café.\none\ntwo three\nx y\nLast line"
    assert by_id[100] == by_id[101] == "" and by_id[102] == "open\nand <b> never closed" and by_id[103] == "plain"
    assert html_extract.extracted(df.where("false")).count() == 0


def test_html_style_tree_drops_what_a_host_repeats(spark):
    rows = [(k, "https://one.example/p", f"<article><div class='x1'>Always the same words</div><p>{html.escape(prose(k, 20))}</p></article>") for k in range(30)]
    rows += [(99, "https://two.example/p", "<article><div class='x1'>Always the same words</div><p>own</p></article>")]
    found = {r.page_id: r.text for r in html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(found[k] == prose(k, 20) for k in range(30))
    assert found[99] == "Always the same words\nown"


def test_html_deep_and_broken_pages():
    deep = "<div>" * 30_000 + "core" + "</div>" * 10
    assert html_extract.main_text(deep) == "core"
    for page in ("<", "<a", "</", "<!--", "<![CDATA[x", "<p class='", "&#xZZ;&bogus;", "<script>", "</p></p>", "<table><tr><td>a<td>b<tr><td>c"):
        html_extract.main_text(page)
    assert html_extract.main_text("<table><tr><td>a<td>b<tr><td>c") == "a\nb\nc"


# the pipeline


def test_pipeline_stages(spark, docs, small):
    for source in (docs, table(spark, small, "documents"), empty(spark)):
        now, columns = source, source.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before = Counter(r.doc_id for r in now.select("doc_id").collect())
            now = stage(spark, now, small).cache()
            assert now.columns == columns, name
            assert not Counter(r.doc_id for r in now.select("doc_id").collect()) - before, name
        corpus_pipeline.STAGES[-1][1](spark, now, small).count()


def test_pipeline_is_its_stages(spark, small):
    """Each stage's decisions, taken one after the other by brute force where it is exact."""
    docs = table(spark, small, "documents")
    good = {r.doc_id for r in quality_rules.measured(docs).where("kept").collect()}
    after = corpus_pipeline.STAGES[0][1](spark, docs, small)
    assert {r.doc_id for r in after.collect()} == good
    lines = kept_lines([(r.doc_id, r.text) for r in after.collect()])
    left = {i: t for (i, _), t in lines.items() if t and t.strip(line_dedup.SPACES)}
    assert {r.doc_id: r.text for r in corpus_pipeline.STAGES[1][1](spark, after, small).collect()} == left
    pieces = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id for r in pieces} <= set(left)
    per_doc = Counter()
    for r in pieces:
        per_doc[r.doc_id] += r.length
    assert all(per_doc[r.doc_id] == r.doc_tokens for r in pieces)


def test_oracle_of_line_dedup(spark, small):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{small}/documents.parquet')")
    want = Counter(con.execute(f"select doc_id, n_lines, n_deleted, text from ({line_dedup.ORACLE_SQL})").fetchall())
    got = Counter(tuple(r) for r in line_dedup.lines_deleted(table(spark, small, "documents")).select("doc_id", "n_lines", "n_deleted", "text").collect())
    assert got == want


def test_line_dedup_rows_are_fingerprints():
    """A row for each selected minimum, which together stand for every window."""
    text = "\n".join(f"line {k}" for k in range(60))
    rows = line_dedup.selected(text, 2)
    assert len({r["at"] for r in rows}) == len(rows) < 59 * 0.85
    assert sorted((w["first"], w["last"]) for r in rows for w in r["windows"]) == [(k, k + 1) for k in range(59)]
    assert all(w["first"] <= r["at"] <= w["last"] for r in rows for w in r["windows"])


def test_html_article_keeps_what_only_sounds_like_noise():
    page = "<article><div class='related-work'>Related work</div><p class='social-history note'>History</p><section id='widget'>Widget</section><div class='ad box'>Buy</div><div class='share-bar'>Share</div></article>"
    assert html_extract.main_text(page) == "Related work\nHistory\nWidget"


def test_html_deep_pages_with_classes_stay_small():
    import tracemalloc

    page = "<div class='level'>" * 8000 + "core"
    tracemalloc.start()
    html_extract.style_nodes(page)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 * len(page)
