"""Training-data operators against SQL, brute force, library tokenizers and held-out labels."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from barloom.llm import common, decontam, htmltext, langid, linerules, mixing, neardup, quality, queries, tokencount, toxicity, urlfilter

from ..conftest import SF
from ..oracle import compare

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the quick brown fox jumps over the lazy dog " * 4000
EDGES = [(1, None, "en", "a", 0), (2, "", None, None, None), (3, " \n\t ", "en", "a", 3), (4, LONG, "en", "a", len(LONG)), (4, LONG, "en", "a", len(LONG)), (None, "one two", "de", None, 7), (6, "x" * 70000, "fr", "b", 70000), (7, "…!? 12 　 ß", "fr", "b", 9)]


def edge_docs(spark):
    return spark.createDataFrame(EDGES, DOCS)


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_against_sql(spark, name):
    compare(spark, name, queries.queries()[name], queries.oracle_sql()[name], SF)


# URL filters


def brute_rule(host, path, rules):
    fits = [(len(h + p), host.count("."), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, "allow")


def test_url_filter_brute_force(spark):
    rng = random.Random(1)
    label, seg = ["a", "b", "co", "org"], ["x", "y", "xy", "1"]
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for _ in range(60) for h in [".".join(rng.choice(label) for _ in range(rng.randint(1, 3)))] for p in [rng.choice(["", "/", "/x", "/x/", "/x/y", "/1"])]}.values())
    urls = [f"{rng.choice(['http', 'https'])}://{'.'.join(rng.choice(label) for _ in range(rng.randint(1, 4)))}/{'/'.join(rng.choice(seg) for _ in range(rng.randint(0, 3)))}{rng.choice(['', '?q=://z', '#f'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "HTTP://A.B/X", "http://", "http://b", "http://x.b?y", "http://" + "a." * 3000 + "b/x", urls[0]]
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "id int, url string, host string")
    out = urlfilter.url_filter(df, spark.createDataFrame(rules, "verdict string, host string, path string")).collect()
    assert len(out) == len(urls)
    for r in out:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", urls[r["id"]] or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        assert (r["host"], r["path"]) == (host, path)
        rule, verdict = brute_rule(host, path, rules)
        assert (r["verdict"], r["rule"]) == (verdict, rule)


def test_url_filter_without_rules_or_urls(spark):
    rules = spark.createDataFrame([], "verdict string, host string, path string")
    df = spark.createDataFrame([("http://a/b",)], "url string")
    assert [tuple(r) for r in urlfilter.url_filter(df, rules).select("rule", "verdict").collect()] == [(None, "allow")]
    assert urlfilter.url_filter(df.limit(0), rules).count() == 0


def test_hot_keys_are_dealt(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("k"), "id").where("k < 2 OR id < 9")
    table = spark.createDataFrame([(0, "a"), (2, "c")], "k long, v string")
    got = common.join_dealt(rows, table, ["k"], hot=10)
    assert collections.Counter((r["k"], r["v"]) for r in got.collect()) == {(0, "a"): 167, (1, None): 167, (2, "c"): 3}


# HTML


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>a<p>b<br>c", "a\n\nb\nc"), ("<ul><li>x<li>y<ol><li>z</ol></ul>after", "- x\n- y\n  1. z\n\nafter"), ("<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>tail", "a     bbb\ncccc  d\n\ntail"),
        ("<div hidden>x</div><span style='display: none'>n</span>v<div style='visibility:hidden'>h<b style='visibility:visible'>s</b></div>", "v\ns"), ("a < b <b>c", "a < b c"), ("<pre>a\n  b</pre>", "a\n  b"),
        ("<script>if(a<b){}</script>z<style>p{}</style><!-- c -->", "z"), ("<details><summary>s</summary>no</details>", "s"), ("1 &lt; 2 &amp;", "1 < 2 &"), ("", ""), ("<a href='x", ""), ("<dl><dt>t<dd>d</dl>", "t\n  d"),
    ],
)
def test_rendering(html, text):
    assert htmltext.render(htmltext.build(html)) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<table><caption>A long caption here</caption><tr><td>a<td>b</table>", "A long caption here\na  b"), ("<table><tr><td colspan=2>wide cell<td>c<tr><td>1<td>2<td>3</table>", "wide cell  c\n1  2  3"),
        ("<table><tr><td rowspan=2>r<td>b<tr><td>c</table>", "r  b\n   c"), ("<table><tr><td rowspan=0>r<td>b<tr><td>c<tr><td>d</table>", "r  b\n   c\n   d"), ("x<plaintext><b>&amp;</plaintext>", "x\n\n<b>&amp;</plaintext>"),
        ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"), ("<ol reversed><li>a<li>b</ol>", "2. a\n1. b"), ("<ol start=4><li>a<li value=9>b<li>c</ol>", "4. a\n9. b\n10. c"),
        ("<style>.x{display:none} p.y,#z{visibility:hidden}</style><p class=x>no<p class=y>no<p id=z>no<p>yes", "yes"), ("<style>.x{display:none}</style><p class='x' style='display:block'>shown", "shown"),
        ("<!--<style>p{display:none}</style>--><style>@media print{p{display:none}} div p{display:none}</style><p>shown", "shown"), ("<style>p{display:none!important}</style><p style='display:block'>no</p>x", "x"),
    ],
)
def test_rendering_of_layout_and_styles(html, text):
    assert htmltext.render(htmltext.build(html)) == text


def test_deep_lists_keep_their_markers():
    page = "".join(f"<ul><li>item{i}" for i in range(150))
    lines = htmltext.render(htmltext.build(page), len(page)).split("\n")
    assert lines == ["  " * i + f"- item{i}" for i in range(150)]
    deep = "<blockquote>x" * 20000
    text = htmltext.render(htmltext.build(deep), len(deep))
    assert text.split() == ["x"] * 20000 and len(text) < htmltext.LEAST_ROOM + 8 * len(deep)


def test_a_very_long_cell_does_not_widen_every_row(spark):
    page = f"<table><tr><td>{'y' * 20000}<td>end{'<tr><td>a<td>b' * 2000}</table>"
    pages = spark.createDataFrame([(1, page, "mine"), (1, page, "mine")], "page_id int, html string, Text string")
    rows = htmltext.extract_text(pages).collect()
    lines = rows[0]["text"].split("\n")
    assert rows[0] == rows[1] and rows[0].__fields__ == ["page_id", "html", "text"]
    assert lines[0] == "y" * 20000 + "  end" and lines[1] == "a" + " " * 81 + "b" and len(rows[0]["text"]) < 5 * len(page)
    assert htmltext.extract_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<table>Title<tr><td>a</table>", "Title\na"), ("<table><tr><div>x</div></tr><tr><td>y</table>", "x\ny"), ("<table><tr><td>a</td>stray<td>b</table>", "stray\na  b"),
        ("<table><tr><td>a</td></tr>s<tr><td><table>t<tr><td>b</table></table>u", "s\na\nt\nb\n\nu"), ("x<xmp><b>&lt;\n y</xmp>z", "x\n\n<b>&lt;\n y\n\nz"), ("a <math><mi>x</mi><mo>=</mo><mn>1</mn></math> b", "a x=1 b"),
        ("<math><semantics><mi>x</mi><annotation>no</annotation></semantics></math>y", "xy"), ("<svg><title>no</title><defs/><style/><path d='M0'/><text>one</text><text>two</text></svg>three", "one\ntwo\nthree"),
        ("<svg><desc>no</desc><text x=1>a</text></svg>b", "a\nb"), ("<svg><defs><text>no</text></defs></svg><svg><defs><p>seen", "seen"), ("<svg><foreignObject><div>in</div></foreignObject></svg>", "in"),
    ],
)
def test_rendering_keeps_text_outside_cells_and_of_svg_math_xmp(html, text):
    assert htmltext.render(htmltext.build(html)) == text


def test_deep_and_broken_pages(spark):
    pages = spark.createDataFrame([(1, None), (2, "<div>" * 50000 + "deep"), (3, "<a <b" * 5000), (4, "</p></table>x"), (5, "")], "page_id int, html string")
    assert [r["text"] for r in htmltext.extract_text(pages).orderBy("page_id").collect()] == ["", "deep", "", "x", ""]


def test_all_visible_words_of_the_pages(spark):
    rows = htmltext.extract_text(common.table(spark, SF, "pages")).collect()
    for r in rows:
        bare = re.sub(r"(?s)<head.*?</head>|<!--.*?-->|<(script|style).*?</\1>", " ", r["html"])
        words = __import__("html").unescape(re.sub(r"<[^>]*>", " ", bare)).split()
        assert collections.Counter(words) == collections.Counter(w for w in r["text"].split() if w != "-" or "-" in words)


# Language ID


def all_segmentations(word, probability):
    """Sum over all ways to cut a word into pieces."""
    if not word:
        return 1.0
    return sum(probability.get(word[:k], 0.0) * all_segmentations(word[k:], probability) for k in range(1, len(word) + 1))


def test_forward_sums_all_segmentations():
    import numpy as np

    pieces = sorted(["▁", "▁a", "a", "ab", "b", "▁ab", "ba"])
    finder = langid.Pieces(pieces)
    p = np.array([[0.1 + 0.05 * i] for i in range(len(pieces) + 1)])
    table = dict(zip(pieces, p[:, 0], strict=False)) | {"z": p[-1, 0]}
    words = ["ab", "aba", "bab", "z", "azb", "a"]
    got = np.exp(langid.forward(finder, p, words))[:, 0]
    assert np.allclose(got, [all_segmentations("▁" + w, table) for w in words])
    counts = langid.expected_counts(finder, p[:, 0], ["ab"], np.array([2.0]))
    assert np.isclose(sum(c * len(x) for c, x in zip(counts, [*pieces, "z"], strict=True)), 2 * 3)


def test_language_of_held_out_texts(spark):
    docs = common.table(spark, SF.replace("0.001", "0.01"), "documents")
    out = langid.language_of(docs, docs.where(common.bucket_of_id(F.col("doc_id"), 4) != 2)).where(common.bucket_of_id(F.col("doc_id"), 4) == 2)
    r = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert r[0] > 0.95 and 0 <= r[1] <= r[2] <= 1


def test_forward_sums_of_very_long_words():
    import numpy as np

    pieces = sorted(["▁", "a", "ab", "b", "ba"])
    finder = langid.Pieces(pieces)
    p = np.array([[1e-7, 0.3], [0.2, 1e-7], [0.1, 1e-7], [0.3, 0.2], [1e-7, 0.1], [1e-7, 1e-7]])
    for word in ("ab" * 250, "b" * 500, "z" * 500 + "ab"):
        marked = "▁" + word
        for j in range(2):
            table = dict(zip(pieces, p[:, j], strict=False))
            log = [0.0] + [-np.inf] * len(marked)
            for end in range(1, len(marked) + 1):
                for k in (1, 2):
                    piece = marked[end - k : end]
                    q = table.get(piece, p[-1, j] if k == 1 and piece not in table else 0.0) if end >= k else 0.0
                    if q:
                        log[end] = np.logaddexp(log[end], log[end - k] + np.log(q))
            assert np.isclose(langid.forward(finder, p, [word, "a"])[0, j], log[-1], rtol=1e-10)
    counts = langid.expected_counts(finder, p[:, 0], ["ab" * 190], np.array([1.0]))
    assert np.isclose(sum(c * len(x) for c, x in zip(counts, [*pieces, "z"], strict=True)), 381)


def test_language_edges(spark):
    out = langid.language_of(edge_docs(spark), edge_docs(spark)).collect()
    assert len(out) == len(EDGES) and all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) for r in out)
    none = langid.language_of(edge_docs(spark), edge_docs(spark).limit(0)).collect()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in none)


# Decontamination


def brute_leaks(text, items, n=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = split(text), set(), set()
    for i, t in items:
        x = split(t)
        for p in range(max(1, len(x) - n + 1) if x else 0):
            k = x[p : p + n]
            for q in range(len(w) - len(k) + 1):
                if w[q : q + len(k)] == k:
                    hit |= set(range(q, q + len(k)))
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


def test_leaks_brute_force(spark):
    rng = random.Random(2)
    make = lambda n: " ".join(rng.choice("ab cd ef Gh,ij.kl".replace(" ", "_").split("_")) for _ in range(n))
    items = [(i, make(rng.choice([0, 1, 3, 9, 10, 11, 14]))) for i in range(12)] + [(90, None), (91, "...")]
    texts = [make(rng.randint(0, 60)) + " " + (rng.choice(items)[1] or "").upper() if rng.random() < 0.5 else make(40) for i in range(40)]
    texts += [None, "", items[0][1]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, items string")
    bench = spark.createDataFrame(items, "item_id int, text string")
    for words in (2_000_000, 12):
        for r in decontam.find_leaks(docs, bench, block_words=words).collect():
            assert (r["n_words"], r["n_hit"], r["items"]) == brute_leaks(texts[r["doc_id"]], items)
            assert r["contaminated"] == (r["n_hit"] > 0) and (not r["contaminated"] or r["longest"]["n_words"] <= r["n_hit"])
    assert decontam.find_leaks(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.decontaminate(edge_docs(spark), bench.where("item_id >= 90")).count() == len(EDGES)


# Classifiers


def auc(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_toxicity_held_out(spark):
    sf = SF.replace("0.001", "0.1")
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    model = toxicity.train(docs, labels, train_rows=common.bucket_of_id(F.col("doc_id"), 5) != 0)
    held = docs.join(labels, "doc_id").where(common.bucket_of_id(F.col("doc_id"), 5) == 0)
    rows = toxicity.score(held, spark.sparkContext.broadcast(model)).select("score", "toxic", "predicted").collect()
    toxic, clean = [r for r in rows if r["toxic"]], [r for r in rows if not r["toxic"]]
    assert auc([(r["score"], r["toxic"]) for r in rows]) > 0.9
    assert sum(r["predicted"] for r in toxic) > 0.8 * len(toxic) and sum(r["predicted"] for r in clean) < 0.03 * len(clean)


def test_risk_and_gradient_brute_force():
    """One step of the learner against the risk as the papers write it, differentiated by small differences."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    for seed in range(6):
        rows = [[sorted(rng.choice(7, rng.integers(0, 5), replace=False).tolist()) for _ in range(n)] for n in (9, 14)]
        positive, unlabelled = (toxicity.Sparse(pa.array(r, pa.list_(pa.int32()))) for r in rows)
        w, prior = rng.normal(0, 2, 8), float(rng.uniform(0.05, 0.9))
        picks = rng.integers(0, 9, 5), rng.integers(0, 14, 8)
        loss = lambda z: 1 / (1 + np.exp(z))
        score = lambda w, ids: np.array([sum(w[i] for i in r) + w[-1] for r in ids])

        def parts(w):
            zp, zu = score(w, [rows[0][i] for i in picks[0]]), score(w, [rows[1][i] for i in picks[1]])
            return prior * loss(zp).mean(), loss(-zu).mean() - prior * loss(-zp).mean()

        gain = (lambda w: sum(parts(w))) if parts(w)[1] >= 0 else (lambda w: -parts(w)[1])
        slow = np.array([(gain(w + d) - gain(w - d)) / 2e-6 for d in np.eye(8) * 1e-6])
        assert np.allclose(toxicity.risk_gradient(w, positive.take(picks[0]), 5, unlabelled.take(picks[1]), 8, prior), slow, atol=1e-7)


def test_counts_and_scores_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcxyz") for _ in range(rng.randint(1, 8)))
    rows = [(rng.random() < 0.5, " ".join(word() for _ in range(rng.randint(0, 30)))) for _ in range(60)]
    parts = lambda t: {xxh(p) for w in set(t.split()) for p in (w, *(w[:k] + "-" for k in range(3, 7) if len(w) >= k))}
    xxh = lambda p: __import__("xxhash").xxh32(p.encode()).intdigest() % (1 << toxicity.BITS)
    expected = collections.Counter((f, y) for y, t in rows for f in parts(t))
    df = spark.createDataFrame(rows, "positive boolean, text string").repartition(3)
    got = toxicity.feature_counts(df).collect()
    assert {(r["feature"], y): n for r in got for y, n in ((True, r["positive"]), (False, r["unlabelled"])) if n} == expected
    weights = {f: rng.uniform(-2, 2) for f, _ in expected if rng.random() < 0.5}
    model = spark.sparkContext.broadcast({"weights": weights, "bias": -0.3})
    for r in toxicity.score(df, model).collect():
        z = -0.3 + sum(weights.get(f, 0.0) for f in parts(r["text"]))
        assert abs(r["score"] - 1 / (1 + 2.718281828459045**-z)) < 1e-9 and r["predicted"] == (r["score"] >= 0.5)


def test_quality_held_out(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    held_out = common.bucket_of_id(F.col("doc_id"), 4) == 2
    model = quality.train(docs, labels, metadata=("n_chars",), train_rows=~held_out)
    rows = quality.score(docs.join(labels, "doc_id").where(held_out), spark.sparkContext.broadcast(model), metadata=("n_chars",)).select("score", "quality").collect()
    assert auc([(r["score"], r["quality"]) for r in rows]) > 0.95


def test_classifier_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (4, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")
    d = edge_docs(spark).withColumn("score", F.lit("mine"))
    for rows in (labels, labels.limit(0)):
        t = toxicity.score(d, spark.sparkContext.broadcast(toxicity.train(d, rows)))
        q = quality.score(d, spark.sparkContext.broadcast(quality.train(d, rows, metadata=("n_chars",))), metadata=("n_chars",))
        for out in (t.collect(), q.collect()):
            assert len(out) == len(EDGES) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in out)


def test_factorisation_equals_all_pairs():
    import numpy as np

    rng = np.random.default_rng(0)
    w, v = rng.normal(size=1 << quality.BITS), rng.normal(size=(1 << quality.BITS, quality.FACTORS))
    flat, value = np.array([3, 9, 40, 7, 9]), np.array([0.5, 1.0, 2.0, 1.0, 1.0])
    z, _ = quality.machine(flat, value, np.array([0, 3, 5]), w, v, 0.25)
    slow = lambda f, x: 0.25 + w[f] @ x + sum(v[f[i]] @ v[f[j]] * x[i] * x[j] for i in range(len(f)) for j in range(i))
    assert np.allclose(z, [slow(flat[:3], value[:3]), slow(flat[3:], value[3:])])


# Mixing


def test_mix_meets_its_margins(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("aaaab"), rng.choice(["x", "y", None]), rng.randint(1, 9)) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n long")
    out = mixing.mix(df, {"source": {"a": 0.5, "b": 0.5}, "lang": 1.0}, tokens="n", keep=0.2, detail=True)
    got = {r["source"]: r["t"] for r in out.groupBy("source").agg(F.sum("n").alias("t")).collect()}
    total = df.agg(F.sum("n")).first()[0]
    assert abs(got["a"] / sum(got.values()) - 0.5) < 0.05 and abs(sum(got.values()) / total - 0.2) < 0.02
    assert out.columns == [*df.columns, "probability"] and out.where("probability > 1 OR probability <= 0").count() == 0
    again = mixing.mix(df, {"source": {"a": 0.5, "b": 0.5}, "lang": 1.0}, tokens="n", keep=0.2)
    assert {r[0] for r in again.select("doc_id").collect()} == {r[0] for r in out.select("doc_id").collect()}
    assert mixing.mix(df, {"source": 0.5}, tokens="n", keep=1.0).count() <= 6000
    assert mixing.mix(df.limit(0), {"source": 0.5}, tokens="n").count() == 0
    assert mixing.mix(df.withColumn("n", F.lit(0)), {"source": 0.5}, tokens="n").count() == 0


def test_slow_margins_are_met(spark):
    """A nearly empty cell makes the fitting slow; it goes on until the margins are met, or can't be."""
    cells = spark.createDataFrame([("a", "x", 1_000_000), ("a", "y", 1), ("b", "x", 1), ("b", "y", 1000), ("c", "x", 500), ("c", "y", 3)], "s string, l string, tokens long")
    targets = {"s": {"a": 0.2, "b": 0.5, "c": 0.3}, "l": {"x": 0.4, "y": 0.6}}
    out = mixing.rake(cells, targets)
    for d, target in targets.items():
        sums = {r[d]: r["w"] for r in out.groupBy(d).agg(F.sum("weight").alias("w")).collect()}
        assert all(abs(sums[v] / sum(sums.values()) - t) < 1e-6 for v, t in target.items())
    apart = spark.createDataFrame([("a", "x", 5), ("b", "y", 5)], "s string, l string, tokens long")
    assert mixing.rake(apart, {"s": {"a": 0.9, "b": 0.1}, "l": {"x": 0.5, "y": 0.5}}).count() == 2


def test_pipeline_mix_reaches_its_margins(spark):
    """Expected shares per value against the nearest ones that a sample of KEEP of all tokens can have."""
    import corpus_pipeline as p

    docs = common.table(spark, SF.replace("0.001", "0.01"), "documents")
    dims = list(p.TARGETS)
    cells = {tuple(r[d] for d in dims): r["n"] for r in docs.withColumn("topic", mixing.topic_of(F.col("text"))).groupBy(*dims).agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).where("n > 0").collect()}
    rate = {tuple(r[d] for d in dims): r["probability"] for r in p.mixed(spark, docs, SF).select(*dims, "probability").distinct().collect()}
    total = sum(cells.values())
    assert set(rate) == set(cells) and abs(sum(rate[c] * n for c, n in cells.items()) / total - p.KEEP) < 1e-4
    for i, d in enumerate(dims):
        own, got = collections.Counter(), collections.Counter()
        for c, n in cells.items():
            own[c[i]] += n
            got[c[i]] += rate[c] * n
        aim, low, high = {v: n ** p.TARGETS[d] for v, n in own.items()}, 0.0, float(total)
        for _ in range(200):  # one factor, with each value held to the tokens it has
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(own[v], a * mid) for v, a in aim.items()) < p.KEEP * total else (low, mid)
        off = sum(abs(got[v] - min(own[v], a * high)) for v, a in aim.items()) / total / p.KEEP
        assert off < 1e-3, (d, off)


# Quality rules


def test_rules_edges(spark):
    out = linerules.line_rules(edge_docs(spark)).collect()
    assert len(out) == len(EDGES)
    for r in out:
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        seen = collections.Counter(grams)
        assert r["n_words"] == len(words) and r["word_chars"] == sum(map(len, words))
        assert r["n_repeat_words"] == len({i + d for i, g in enumerate(grams) if seen[g] > 1 for d in range(3)})
        assert r["kept"] in (True, False) and not (r["kept"] and r["base_failed"])


def test_repeats_by_words_equal_the_hashes(spark):
    words = F.array(*[F.lit(x) for x in "a b c a b c d a b".split()])
    df = spark.range(1).select(words.alias("w"))
    assert df.select(F.array_sort(F.array_distinct(linerules.repeats_by_words(F.col("w")))).alias("p")).select(linerules.covered(F.col("p"))).first()[0] == 6


def test_lines_that_go(spark):
    good = "This is a sentence of plain words that says something about nothing in particular today."
    text = "\n".join([good, "Home | News | Sport | Shop | About", "Accept all cookies to go on.", "Menu", *[f"{i} {good}" for i in range(6)]])
    r = linerules.line_rules(spark.createDataFrame([(text,)], "text string")).first()
    assert r["n_lines"] == 10 and r["n_lines_kept"] == 7 and r["kept"] is False  # its words repeat
    assert r["clean_text"].startswith(good) and "Menu" not in r["clean_text"]


@pytest.mark.parametrize("sentence", ["今天的天气很好，我们一起去公园散步吧。", "यह एक साधारण वाक्य है जो किसी बात के बारे में कुछ बताता है।", "هل هذا نص بسيط يقول شيئا عن لا شيء على وجه الخصوص؟", "今日は良い天気です。「散歩に行きましょう」"])
def test_sentences_of_other_scripts_stay(spark, sentence):
    text = "\n".join(f"{i} {sentence}" for i in range(60))
    r = linerules.line_rules(spark.createDataFrame([(text,)], "text string")).first()
    assert r["n_lines_kept"] == 60


def test_rules_of_clashing_and_empty_tables(spark):
    df = edge_docs(spark).withColumns({"Kept": F.lit("mine"), "__w": F.lit(1), "N_Words": F.lit(2)})
    out = linerules.line_rules(df)
    assert [c for c in out.columns if c.lower() in ("kept", "n_words")] == ["n_words", "kept"] and "__w" in out.columns
    assert out.count() == len(EDGES) and linerules.line_rules(df.limit(0)).count() == 0


# Near-duplicates


def brute_components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return [root(a) for a in range(len(texts))], sets


def test_near_duplicates_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    texts = [None, "", "one", "One", "one two three", "x"]
    for _ in range(6):
        base = [word() for _ in range(rng.randint(30, 150))]
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    shared = [word() for _ in range(60)]
    texts += [" ".join(shared + [word() for _ in range(rng.randint(5, 60))]) for _ in range(25)]
    expected, sets = brute_components(texts)
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    for rounds in (0, 3):
        for r in neardup.near_duplicates(df, hub_rounds=rounds).collect():
            i = r["doc_id"]
            assert (r["component_id"], r["n_shingles"], r["kept"]) == (expected[i], len(sets[i]), expected[i] == i), i


def test_near_duplicate_edges(spark):
    out = {(r["doc_id"], r["text"]): r for r in neardup.near_duplicates(edge_docs(spark)).collect()}
    assert len(out) == len(EDGES) - 1 and out[(1, None)]["kept"] and out[(4, LONG)]["component_id"] == 4 and out[(None, "one two")]["kept"]
    assert neardup.near_duplicates(edge_docs(spark).limit(0)).count() == 0


def test_a_hot_hub_is_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 4)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join([*base[:79], f"x{i}"])) for i in range(40)] + [(99, "other words that are like nothing else here")]
    out = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {**{i: 0 for i in range(40)}, 99: 99}


def test_one_row_of_each_group_stays(spark):
    copy = "one two three four five six seven eight"
    rows = [(5, copy, "a"), (5, copy, "a"), (None, copy + " ", "b"), (7, copy.upper(), "c"), (None, "lone words without a key", "d"), (None, "lone  words without a key", "e"), (8, "", "f"), (8, None, "g"), (9, "", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Kept string")
    out = neardup.one_of_each(df).collect()
    assert sorted(r["Kept"] for r in out if r["Kept"] in "fgh") == ["f", "g", "h"] and sum(r["Kept"] == "a" for r in out) == 1
    assert len(out) == 5 and sum(r["Kept"] in "de" for r in out) == 1 and out[0].__fields__ == df.columns
    assert neardup.one_of_each(df.limit(0)).count() == 0


def test_odd_sketches_estimate_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    for share in (0.75, 0.9):
        a = rng.integers(0, 1 << 62, 2000).astype(np.uint64)
        b = np.concatenate([a[: int(2000 * 2 * share / (1 + share))], rng.integers(0, 1 << 62, 2000 - int(2000 * 2 * share / (1 + share))).astype(np.uint64)])
        s = neardup.odd_sketches(np.stack([neardup.samples(a), neardup.samples(b)]))
        bits = sum(bin(int(x) & (2**64 - 1)).count("1") for x in s[0] ^ s[1])
        estimate = 1 + neardup.SKETCH_BITS / (4 * neardup.BANDS * neardup.ROWS) * np.log(1 - 2 * bits / neardup.SKETCH_BITS)
        assert abs(estimate - share) < 0.12 and bits <= neardup.most_odd_bits(0.75)


# Token counts


def test_counts_equal_the_tokenizer():
    """The library's unigram model also finds its unknown and byte pieces in a text, which are no text; so texts that spell them are left to the next test."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = tokencount.unigram_vocabulary()
    spelled = [("<unk>", min(s for _, s in vocabulary)), *((f"<0x{b:02X}>", -1e9) for b in range(256))]
    exact = Tokenizer(models.Unigram(spelled + vocabulary, 0, True))
    exact.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    rng = random.Random(6)
    texts = ["".join(rng.choice("aeit ▁\nsAxhello日本語😀é the  ") for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["", " ", "  ", "a", "▁", "日日日", "z" * 3000]
    viterbi = tokencount.Viterbi(vocabulary)
    viterbi.unknown = -1e9 - tokencount.UNKNOWN_PENALTY  # what the library derives from its least score
    for t, e in zip(texts, exact.encode_batch(texts, add_special_tokens=False), strict=True):
        assert sum(viterbi.count(w) for w in tokencount.words_of(t)) == len(e.ids), t


def test_control_and_byte_pieces_are_no_text():
    vocabulary = tokencount.unigram_vocabulary()
    pieces = {p for p, _ in vocabulary}
    assert not pieces & {"<s>", "</s>", "<unk>", "<0x0A>", "<0xFF>"} and len(pieces) > 30000
    viterbi = tokencount.Viterbi(vocabulary)
    assert viterbi.count("▁<s>") > 1 and viterbi.count("▁<0x0A>") > 3
    assert viterbi.count("▁日\U0001F9FF") == viterbi.count("▁日") + 4


def test_ties_go_to_the_earlier_start():
    v = [("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0), ("▁ab", -3.0)]
    from tokenizers import Tokenizer, models

    exact = Tokenizer(models.Unigram(v, 0, False))
    for w in ("▁ab", "▁a", "▁abab", "▁ba"):
        assert tokencount.Viterbi(v).count(w) == len(exact.encode(w).ids)


def test_token_count_edges(spark):
    out = tokencount.token_counts(edge_docs(spark).withColumn("n_tokens", F.lit("mine"))).collect()
    assert len(out) == len(EDGES) and all((r["n_tokens"] == 0) == (not r["text"]) for r in out)
    clash = edge_docs(spark).withColumns({"N_Tokens": F.lit("mine"), "__text": F.lit("x")})
    assert tokencount.token_counts(clash).columns == [*clash.columns[:-2], "__text", "n_tokens"] and tokencount.token_counts(clash.limit(0)).count() == 0


# Names that clash, and sessions without a shared folder


def test_clashing_names_in_every_operator(spark):
    docs = edge_docs(spark).withColumns({c: F.lit("mine") for c in ("Kept", "Score", "Lang_Pred", "Predicted", "Items", "__text", "__h", "__w", "__hash", "Probability", "node", "id")})
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (4, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "the quick brown fox")], "item_id long, text string")
    share = lambda m: spark.sparkContext.broadcast(m)
    made = {
        "lang_pred": langid.language_of(docs, docs), "predicted": toxicity.score(docs, share(toxicity.train(docs, labels))), "score": quality.score(docs, share(quality.train(docs, labels))),
        "items": decontam.find_leaks(docs, bench), "kept": neardup.near_duplicates(docs), "probability": mixing.mix(docs, {"source": 0.5}, tokens="n_chars", keep=1.0, detail=True),
    }
    for new, out in made.items():
        assert [c.lower() for c in out.columns].count(new) == 1 and new in out.columns and {"__text", "__h", "__w", "node", "id"} <= set(out.columns), new
        assert all(r["__text"] == "mine" for r in out.collect()) and out.count() >= len(EDGES) - 2, new
    urls = spark.createDataFrame([("http://a.b/c", 1, 2, 3)], "url string, Host int, __h int, PATH int")
    out = urlfilter.url_filter(urls, spark.createDataFrame([("block", "b", "/c")], "verdict string, host string, path string"))
    assert out.columns == ["url", "__h", "host", "path", "rule", "verdict"] and out.first()["rule"] == "b/c"


def test_a_shared_folder_is_asked_for(spark, monkeypatch):
    class Context:
        master, folder = "spark://somewhere:7077", None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, d):
            self.folder = d

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(ValueError, match="checkpoint"):
        common.scratch_dir(Session())
    Session.sparkContext.master = "local[2]"
    first = common.scratch_dir(Session())
    assert first.rsplit("/", 1)[0] == common.scratch_dir(Session()).rsplit("/", 1)[0] == Session.sparkContext.folder


# Queries and pipeline


@pytest.mark.parametrize("name", [n for n in queries.queries() if n not in queries.oracle_sql()])
def test_query_returns_every_row(spark, name):
    sf = SF.replace("0.001", "0.01")
    out = queries.queries()[name](spark, sf)
    assert out.count() == common.table(spark, sf, "pages" if name.startswith("op2") else "documents").count()


def test_pipeline_equals_its_operators(spark, tmp_path):
    import corpus_pipeline as p

    docs = common.table(spark, SF, "documents")
    rows = docs.limit(0).unionByName(docs).collect()
    kept, by = docs, {}
    for name, stage in p.STAGES:
        made = stage(spark, kept, SF)
        made.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        by[name] = {r["doc_id"]: r for r in kept.collect()}
        if name != "mixing":
            assert kept.columns == docs.columns
    assert len(by["language_id"]) <= len(rows)
    after = sorted(by["toxicity"])
    expected, _ = brute_components([by["toxicity"][i]["text"] for i in after])
    assert set(by["near_dedup"]) == {after[i] for i in set(expected)}
    items = [(r["item_id"], r["text"]) for r in common.table(spark, SF, "benchmark").collect()]
    assert set(by["decontamination"]) == {i for i, r in by["near_dedup"].items() if not decontam_hit(r["text"], items)}
    for i, r in by["mixing"].items():
        u = int(hashlib.md5(f"{i}:mix".encode()).hexdigest()[:13], 16) / (1 << 52)
        assert i in by["decontamination"] and u < r["probability"] + 1e-6
    assert {r["doc_id"] for r in p.run(spark, SF).collect()} == set(by["mixing"])


def decontam_hit(text, items, n=10):
    words = [decontam.words_of(t or "") for _, t in items]
    windows = {tuple(w[i : i + n]) for w in words for i in range(max(1, len(w) - n + 1) if w else 0)}
    own = decontam.words_of(text or "")
    return any(tuple(own[i : i + k]) in windows for k in {len(w) for w in windows} for i in range(len(own) - k + 1))


def test_pipeline_edges(spark):
    import corpus_pipeline as p

    for docs in (edge_docs(spark), edge_docs(spark).limit(0)):
        for _, stage in p.STAGES:
            docs = common.cut(stage(spark, docs, SF))
        assert docs.count() <= len(EDGES)


def test_a_kept_text_goes_to_python_once(spark):
    from barloom.llm.common import with_columns_from_text

    df = spark.createDataFrame([(1, "a b"), (2, None)], "id int, text string")
    lengths = lambda: lambda texts: [[len(t or "") for t in texts]]
    whole = with_columns_from_text(df, "text", "n int", lengths, df.columns)
    assert "__text" not in whole._jdf.queryExecution().analyzed().toString()
    assert sorted(map(tuple, whole.collect())) == [(1, "a b", 3), (2, None, 0)]
    assert sorted(map(tuple, with_columns_from_text(df, "text", "text int", lengths, df.columns).collect())) == [(1, 3), (2, 0)]
    assert sorted(map(tuple, with_columns_from_text(df, "text", "n int", lengths, ["id"]).collect())) == [(1, 3), (2, 0)]
