"""Toxicity, URL filters, pseudonyms and page texts against small cases and brute force."""

import datetime
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldspark.llm import html_text, pseudonyms, queries, toxicity, url_filter

from .helpers import AWKWARD, docs


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op1_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert len(got) > 500
    assert (got["predicted"] == got["toxic"]).mean() > 0.95
    assert (got["predicted"][got["toxic"] == 1]).mean() > 0.9
    assert got["score"].between(0, 1).all()


def test_toxicity_pieces_and_awkward_texts(monkeypatch):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words, 40)) + (" vile" if i % 3 == 0 else "") for i in range(200)]
    packed = toxicity.pack(pa.array(texts), toxicity.Settings())
    model = toxicity.train(packed, np.array([int(i % 3 == 0) for i in range(200)]))
    toxicity.calibrate(model, packed, np.array([int(i % 3 == 0) for i in range(200)]))
    whole = model.scores(pa.array([*texts, *AWKWARD], pa.string()))
    assert (whole[:200] >= 0.5).tolist() == [i % 3 == 0 for i in range(200)]
    assert np.isfinite(whole).all() and whole[200] == whole[201] == whole[202]
    monkeypatch.setattr(toxicity, "PIECE_WORDS", 50)
    assert np.allclose(model.scores(pa.array([*texts, *AWKWARD], pa.string())), whole, atol=1e-5)


def test_toxicity_of_a_text_in_pieces_is_that_of_the_whole(monkeypatch):
    """Different words, cut at many places: not one bit differs, and a plain pass over all windows agrees."""
    rng = np.random.default_rng(1)
    model = toxicity.Model.start(toxicity.Settings())
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 5000, n)) for n in (0, 1, 2, 3, 57, 400, 1001)]
    packed = toxicity.pack(pa.array(texts), model.settings)
    whole = model.logits(packed)
    for size in (3, 4, 7, 50, 56, 57, 58, 399):
        monkeypatch.setattr(toxicity, "PIECE_WORDS", size)
        assert (model.logits(packed) == whole).all()
    for text, logit in zip(texts, whole, strict=True):
        words = text.split()
        vectors = [model.embedding[b].sum(0) for b in toxicity.word_buckets(words, model.settings)] if words else []
        vectors += [np.zeros(model.settings.size)] * max(model.settings.widths)
        tops = [np.max([sum(vectors[p + j] @ model.filters[w][j] for j in range(w)) for p in range(len(words) + 1)], axis=0) for w in model.settings.widths]
        assert abs(np.maximum(np.concatenate(tops), 0) @ model.out + model.out_bias - logit) < 1e-4


def test_toxicity_sample_passes_over_a_huge_text(spark):
    rows = [(i, f"plain text number {i} of many" + (" vile" if i % 3 == 0 else "")) for i in range(300)] + [(k, "huge " * 5000) for k in range(300, 330)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(330)] + [(None, 1)], "doc_id long, toxic int")
    d = docs(spark, [*rows, (None, "no id"), (5, "another text of an id")])
    model = toxicity.fit(d, labels, sample_chars=20_000)
    assert model.constant is None
    got = {r.doc_id: r.s for r in toxicity.score(d, model, out="s").filter("doc_id < 300").collect()}
    assert np.mean([(got[i] >= 0.5) == (i % 3 == 0) for i in range(300)]) > 0.95
    assert [r.h for r in d.filter("doc_id IS NULL").select(toxicity.held_out().alias("h")).collect()] == [False]


def test_toxicity_learns_from_all_labelled_rows_in_shards(spark):
    """Toxic rows that come after the first ten thousand ids by hash are learnt from, in several shards."""
    ids = spark.range(14_000).filter(~toxicity.held_out("id")).orderBy(F.xxhash64("id")).toPandas()["id"].tolist()
    toxic = set(ids[10_000:])
    assert len(toxic) > 500
    rows = [(k, f"plain number w{k} of many" + (" vile" if k in toxic else "")) for k in ids]
    labels = spark.createDataFrame([(k, int(k in toxic)) for k in ids], "doc_id long, toxic int")
    d = docs(spark, [*rows, (-1, "long " * 3000)])
    model = toxicity.fit(d, labels.union(spark.createDataFrame([(-1, 0)], labels.schema)), shard_rows=3000)
    assert model.constant is None
    got = {r.doc_id: r.s for r in toxicity.score(d, model, out="s").collect()}
    assert np.mean([(got[k] >= 0.5) == (k in toxic) for k in ids]) > 0.99


def test_toxicity_training_in_pieces_is_that_of_the_whole(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 300, n)) for n in rng.integers(0, 90, 64)]
    packed, labels = toxicity.pack(pa.array(texts), toxicity.Settings()), np.arange(64) % 2
    whole = toxicity.train(packed, labels)
    monkeypatch.setattr(toxicity, "PIECE_WORDS", 20)
    assert np.allclose(toxicity.train(packed, labels).embedding, whole.embedding, atol=1e-5)


def test_toxicity_without_labels(spark):
    d = docs(spark, AWKWARD, score="taken")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(d, none)
    out = toxicity.score(d, model, out="toxicity_score").toPandas()
    assert len(out) == len(AWKWARD) and (out["toxicity_score"] < 0.01).all() and (out["score"] == "taken").all()
    assert toxicity.score(d.limit(0), model).count() == 0


@pytest.mark.parametrize("kind", ["threshold"])
def test_best_threshold(kind):
    assert toxicity.best_threshold(np.array([0.0, 1.0, 5.0, 6.0]), np.array([0, 0, 1, 1])) == 3.0
    assert toxicity.best_threshold(np.array([1.0]), np.array([1])) == 0.0


URLS = [
    None, "", "no scheme", "http://", "http://EXAMPLE.com", "http://example.com/", "http://www.example.com/en/1",
    "https://a.example.com/en/x?y", "http://example.com/en", "http://xexample.com/en/", "http://b.net/es/1#z", "http://net/fr/", "http://b.net/de/",
    "http://b.net?/es/", "x://u@b.com:80/", "a://b://c.com/", "http://" + "a." * 300 + "com/" + "p" * 5000,
]


def _judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = host.lower()
    fits = [(len(h + p), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_url_filter(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS * 2)], "page_id long, url string").withColumn("judged", F.lit(1))
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages.drop("judged"), rules).collect()}
    assert got == {i: _judge(u) for i, u in enumerate(URLS * 2)}
    assert url_filter.filter_urls(pages.drop("judged").limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages.drop("judged"), rules.limit(0)).collect()} == {"allow"}


def test_url_filter_confirms_strings(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "digest", lambda text: len(text) % 2)  # nearly everything collides
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    name = url_filter.build(spark, rules)
    from pyspark import SparkFiles

    index = url_filter.DigestArray(lambda part: SparkFiles.get(f"{name}-{part}.npy"))
    for u in URLS:
        host, path, rule, verdict = _judge(u)
        found = index.judge([host], [path])[0]
        assert (found["rule"], found["verdict"] or "allow") == (rule, verdict)


NUMBERS = [
    "card 4539 1488 0343 6467 and 4539148803436467", "bad 4539148803436468", "iban DE89 3704 0044 0532 0130 00, GB82WEST12345698765432",
    "on 2024-02-29, 31.12.1999, 02/30/2020, 12/31/2020 or 31/12/2020", "ssn 123-45-6789 not 666-12-1234", "ip 97.51.17.173 not 300.1.1.1",
    "+1 (017) 555-7713", "und.34@mail7.example.com a@b.com 7@x.org",
]


def _luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms(spark):
    d = docs(spark, NUMBERS + AWKWARD + NUMBERS, masked="x")
    got = pseudonyms.pseudonymize(d.drop("masked"), "k").orderBy("doc_id").collect()
    text = [r.masked for r in got]
    assert text[:len(NUMBERS)] == text[-len(NUMBERS):]  # equal values stay linked
    assert text[len(NUMBERS):len(NUMBERS) + len(AWKWARD)] == AWKWARD
    assert got[0].kinds == ["card", "card"] and got[1].kinds == []
    a, b = re.findall(r"\d[\d ]+\d", text[0])
    assert a.replace(" ", "") == b and _luhn(b) and re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", a) and b != "4539148803436467"
    assert text[1] == NUMBERS[1]
    for iban in re.findall(r"[A-Z]{2}\d\d[A-Z0-9 ]+\d", text[2]):
        plain = iban.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    assert got[3].kinds == ["date"] * 4 and "02/30/2020" in text[3]
    datetime.date.fromisoformat(re.search(r"\d{4}-\d\d-\d\d", text[3])[0])
    assert "666-12-1234" in text[4] and "123-45-6789" not in text[4]
    assert "300.1.1.1" in text[5] and all(int(v) < 256 for v in re.search(r"ip ([\d.]+)", text[5])[1].split("."))
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", text[6]) and text[6] != NUMBERS[6]
    assert text[7].endswith("a@b.com " + text[7][-7:]) and "34@" not in text[7]
    other = pseudonyms.pseudonymize(docs(spark, NUMBERS), "another").orderBy("doc_id").collect()
    assert other[0].masked != text[0]


def test_pseudonyms_inside_runs(spark):
    card, iban = "4539 1488 0343 6467", "BE68 5390 0754 7034"
    rows = [
        (f"{card} 12/25", ["card"]), (f"{card} 123", ["card"]), (f"{card} 12 apples", ["card"]), (f"12345 {card}", ["card"]),
        (f"{card} {card} 77 {card}", ["card"] * 3), (f"{card} 12/25/2026", ["card", "date"]), (f"{card} 10.0.0.1", ["card", "ipv4"]),
        (f"{card} a7@x.org", ["card", "email"]), ("4539148803436467/1225", ["card"]), ("3782-822463-10005 1234", ["card"]), ("1234 123-45-6789", ["ssn"]),
        ("12 2024-01-02 1234567", ["date"]), (f"{iban} BANK", ["iban"]), (f"{iban} BIC 12", ["iban"]), (f"{iban} 1234 {card} 99", ["iban", "card"]),
        (f"XX12 {card}", ["card"]), ("1 2 3 4 5 6 7th", []), ("call 12-12 OR 13", []), ("4539 1488 0343 6468 12", []),
    ]
    alone = {}
    for r in pseudonyms.pseudonymize(docs(spark, [card, iban, "123-45-6789", "2024-01-02", "3782-822463-10005"]), "k").collect():
        alone[r.text] = r.masked
    got = pseudonyms.pseudonymize(docs(spark, [t for t, _ in rows]), "k").orderBy("doc_id").collect()
    for (t, kinds), r in zip(rows, got, strict=True):
        assert r.kinds == kinds, (t, r.masked)
        for old, new in alone.items():
            assert t.count(old) == r.masked.count(new) and old not in r.masked, (t, r.masked)
        if not kinds:
            assert r.masked == t
        assert re.sub("[0-9]", "0", r.masked) == re.sub("[0-9]", "0", t) or "10.0.0.1" in t


def test_feistel_is_a_permutation(spark):
    n = spark.range(146_097)
    pair = pseudonyms.feistel(F.floor(F.col("id") / 773), F.col("id") % 773, F.lit(189), F.lit(773), F.lit("k"), F.lit("d"))
    out = n.select(pair.alias("p")).select((F.col("p.l") * 773 + F.col("p.r")).alias("x"))
    assert out.agg(F.countDistinct("x"), F.min("x"), F.max("x")).first()[:] == (146_097, 0, 146_096)


def test_no_python_in_pseudonyms(spark):
    plan = pseudonyms.pseudonymize(docs(spark, NUMBERS), "k")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class=top><h1>Site</h1></header><nav><ul><li><a href="/a">a</a></ul></nav><!-- c --><div class="ad">buy</div>
<div class="notice cookie">accept</div><article><h1>Title &amp; more</h1><p>One <b>two</b>&nbsp; three<br>four<p>five &lt;x&gt;
<ul><li>a<li>b</ul>%s<form><input><label>name</label></form><div class="share-bar share">tweet</div></article>
<aside class="sidebar">related</aside><section id="comments"><p>nice</p></section><footer>&copy; x</footer></body></html>"""


def test_page_text(spark):
    pages = spark.createDataFrame(
        [(1, "http://h.com/1", PAGE % ""), (2, "http://h.com/2", PAGE % "<p>six</p><p>seven"), (3, "http://o.com/", "<p>plain<p>page"), (4, None, None),
         (5, "http://o.com/2", ""), (6, "http://h.com/3", "<html><body><p>no article</p><nav>x</nav>"), (7, "http://z.com", "a < b &am; c"),
         (8, "http://z.com", "<div>" * 3000 + "deep" + "</div>" * 10), (1, "http://h.com/1", PAGE % "")],
        "page_id long, url string, html string").withColumn("host", F.lit("x"))
    got = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    base = "Title & more\nOne two three four\nfive <x>\na\nb"
    assert got == {1: base, 2: base + "\nsix\nseven", 3: "plain\npage", 4: "", 5: "", 6: "no article", 7: "a < b &am; c", 8: "deep"}
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_page_texts_of_the_table(spark, sf):
    import html as h

    raw = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.op8_html_text(spark, sf).collect():
        inner = re.sub("</?b>", "", raw[r.page_id].split("<article>")[1].split("</article>")[0])
        lines = [" ".join(h.unescape(x).split()) for x in re.split("</?(?:p|h1)>|<br>", inner)]
        assert r.text == "\n".join(x for x in lines if x)


def test_wrappers():
    s = html_text.structure(html_text.page_tree("<body><div class=a><p>1<p>2</div><dl><dt>x<dd>y<dt>x<dd>y</dl>"))
    div = s[3][0][3][0]
    assert div[3] == [["p", True, False, [html_text.SLOT]]]
    dl = s[3][0][3][1]
    assert dl[3][0][0] == "" and dl[3][0][1] and [e[0] for e in dl[3][0][3]] == ["dt", "dd"]
    a, b = (html_text.structure(html_text.page_tree(x)) for x in ("<div><h1>t</h1><p>x", "<div><p>x<p>y</div><footer>z"))
    both = html_text.merge(a, b)[3]
    assert [(e[0], e[2]) for e in both] == [("div", False), ("footer", True)]
    assert [(e[0], e[1], e[2]) for e in both[0][3]] == [("h1", False, True), ("p", True, False)]


def _texts(spark, *pages, host="http://h.com/"):
    table = spark.createDataFrame([(i, f"{host}{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in html_text.extract_text(table).orderBy("page_id").collect()]


def test_equal_siblings_apart(spark):
    a = "<article><p>First</p><h2>x</h2><p><img></p></article>"
    b = "<article><div>intro</div><h2>y</h2><div><p>in</p></div></article>"
    assert _texts(spark, a) == ["First\nx"] and _texts(spark, b) == ["intro\ny\nin"]
    assert _texts(spark, a, b, a.replace("First", "Other")) == ["First\nx", "intro\ny\nin", "Other\nx"]


def test_names_and_unread_elements(spark):
    for i, (a, b) in enumerate([
            ("<div class='content has-sidebar'>", "</div>"), ("<main class='no-sidebar'>", "</main>"),
            ("<article class='post category-social comment-enabled'>", "</article>"),
            ("<main class='search'>", "</main>"), ("<div class='main-content'>", "</div>")]):
        pages = [f"<nav>n</nav><div class=x><p>out</p></div>{a}<h1>t{k}</h1><p>text<div class='ad'>buy</div>{b}" for k in range(2)]
        assert _texts(spark, *pages, host=f"http://h{i}.com/") == ["t0\ntext", "t1\ntext"], a
    page = "<form class=search><input>go<article><h1>t%d</h1>text<div class=ad>buy</div></article></form>"
    assert _texts(spark, page % 1, page % 2) == ["t1\ntext", "t2\ntext"]
    page = "<div class=x>%s</div><aside>more<article>%s</article></aside>"
    assert _texts(spark, page % ("one", "two"), page % ("three", "four")) == ["one\ntwo", "three\nfour"]
    texts = _texts(
        spark, "<article><p>let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be</p></article>", "<article><p>a <button>b <p>c</p><p>d</p></article>",
        "<article><object data=x><p>e</p></article>", "<article><p>f <button>g<div>h</div></button> i</p><svg><svg></svg>j</svg></article>",
        "<article><select><option>k<p>l</p></article><footer>z")
    assert texts == ["let x=2 be", "a\nc\nd", "e", "f i", "l"]


def test_different_deep_pages(spark):
    a, b = ("<div>" * n + f"deep {n}<p>x" for n in (6000, 20_000))
    assert _texts(spark, a, b) == ["deep 6000\nx", "deep 20000\nx"]
    assert _texts(spark, a + "</div>" * 6000 + b + "</div>" * 20_000) == ["deep 6000\nx\ndeep 20000\nx"]
    deep = html_text.structure(html_text.page_tree(b))
    assert html_text.packed(html_text.unpacked(html_text.packed(deep))) == html_text.packed(deep)


def test_constant_text_of_a_host(spark):
    page = "<div class=x7>We use cookies</div><ul><li>Home<li>About</ul><div><p>text %s<p>more %s</div><div class=y>all rights <b>reserved</b></div>"
    pages = [page % (k, k * k) for k in range(2, 5)]
    assert _texts(spark, *pages) == [f"text {k}\nmore {k * k}" for k in range(2, 5)]
    whole = "We use cookies\nHome\nAbout\ntext 2\nmore 4\nall rights reserved"
    assert _texts(spark, pages[0]) == [whole] and _texts(spark, pages[0], pages[0]) == [whole] * 2  # nothing to compare with
    odd = "<div class=y>only here</div>"  # this place differs, so it is a slot
    assert _texts(spark, *pages, odd) == [f"text {k}\nmore {k * k}\nall rights reserved" for k in range(2, 5)] + ["only here"]
    inside = "<main><h2>Same</h2><p>%s</main>"
    assert _texts(spark, inside % 1, inside % 2) == ["Same\n1", "Same\n2"]


def test_reader_comments_and_quotes(spark):
    page = "<main><p>Real text %d</p></main><div><article class='comment'>nice</article><article class='comment'>no %d</article></div>"
    assert _texts(spark, page % (1, 2), page % (3, 4)) == ["Real text 1", "Real text 3"]
    own = "<article class='post comment'>mine<article class=comment>theirs</article></article>"
    assert _texts(spark, own, host="http://own.com/") == ["mine"]
    quoted = "<article><p>One <a href=it's>link</a> two.</p><p>We don't stop here.</p><p title=a \"b\">Last</p><p class==\"x>y</p></article>"
    assert _texts(spark, quoted, host="http://q.com/") == ["One link two.\nWe don't stop here.\nLast\ny"]
    named = "<article><p>kept</p>%s<div class='category-social'>also</div><p title='class=ad' data-class=ad>shown</p></article>"
    for n, name in enumerate(("comments-area", "cookie-notice", "ad-slot", "related-posts", "share-buttons", "disqus_thread")):
        beside = f"<div id={name}>out</div>"
        assert _texts(spark, named % beside, host=f"http://n{n}.com/") == ["kept\nalso\nshown"], name
