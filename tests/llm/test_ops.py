"""The corpus operators beside SQL, brute force, round trips and labels, and on odd rows."""

import collections
import gzip
import hashlib
import html
import itertools
import math
import re
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest import duck_rows, rows
from pyspark.sql import functions as F

from wrenfold.llm import decontam, html_text, langid, mixing, queries, simhash, substring, topk, toxicity, urlfilter, warc
from wrenfold.llm.common import Scratch, Words, components, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty and white-space texts, one word, ties and repeated rows, a null id, a very long text.
ODD = [
    (1, None, "en", "a", None), (2, "", "en", None, 0), (3, " \t\n", None, "a", 3), (4, "word", "de", "b", 4), (5, "same text here with some words", "en", "a", 30), (5, "same text here with some words", "en", "a", 30),
    (6, "same text here with some words", "fr", "c", 30), (None, "same text here with some words", "fr", "c", 30), (7, "x " * 200_000, "en", "a", 400_000), (8, "É ü\x00 😀".encode("utf-16", "surrogatepass").decode("utf-16"), None, None, 6),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumns({"size_": F.lit(1), "h": F.lit("x"), "id": F.lit(9), "items_": F.lit(None).cast("string"), "_low": F.lit(1)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", list(queries.SQL))
def test_sql(name, spark, sf, duck):
    assert rows(queries.QUERIES[name](spark, sf)) == duck_rows(duck.sql(queries.SQL[name]))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_whole_tables(name, spark, sf):
    out, source = queries.QUERIES[name](spark, sf), "pages" if name.startswith("op2") else "documents"
    assert out.count() == table(spark, sf, source).count() and "id" in out.columns[0]


# --- mixing -----------------------------------------------------------------------------------------------------------


def test_mix_odd(spark, odd, empty):
    out = mixing.mix(Scratch(spark, "t"), odd.withColumn("size", mixing.n_words("text"))).collect()
    assert len(out) == len(ODD) and all(0 <= r.taken <= 3 * r.size for r in out)
    total = sum(r.size for r in out)
    for s in {r.source for r in out}:
        own = [r for r in out if r.source == s]
        assert sum(r.taken for r in own) == own[0].budget and own[0].target <= 3 * own[0].source_size
    assert abs(sum({(r.source, r.target) for r in out} and {r.source: r.target for r in out}.values()) - total) < 1e-6
    assert mixing.mix(Scratch(spark, "t"), empty.withColumn("size", mixing.n_words("text"))).count() == 0
    again = mixing.mix(Scratch(spark, "t"), odd.repartition(7).withColumn("size", mixing.n_words("text"))).collect()
    assert sorted(map(str, ((r.doc_id, r.taken) for r in out))) == sorted(map(str, ((r.doc_id, r.taken) for r in again)))


def test_mix_targets(spark):
    sizes = {"a": 1, "b": 1, "c": 1000, "d": 1000, None: 10}
    df = spark.createDataFrame([("n" if k is None else f"s{k}", k, v) for k, v in sizes.items()], "skey string, source string, source_size long")
    got = {r.skey: r.target for r in mixing.targets(df).collect()}
    left, weights, want = float(sum(sizes.values())), dict(zip(["sa", "sb", "sc", "sd", "n"], [5, 2, 1, 5, 2], strict=True)), {}
    caps = {"n" if k is None else f"s{k}": 3 * v for k, v in sizes.items()}
    while True:
        w = sum(weights.values())
        over = [k for k in weights if left * weights[k] / w >= caps[k]]
        if not over:
            break
        for k in over:
            want[k] = caps[k]
            del weights[k]
        left = sum(sizes.values()) - sum(want.values())
    want |= {k: left * v / sum(weights.values()) for k, v in weights.items()}
    assert got == pytest.approx(want)


# --- pages ------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><div class="cookie-notice">Cookies</div><div id="sidebar"><p>side</p></div>
<main><div class=content><h1>T&eacute;st &amp; more</h1><p>one<p>two <b>bold</b><br>x<ul><li>a<li>b</ul><div class="share">share</div><section class="comments"><article class=comment><p>c</p></article></section>
<script>var a="</p>";</script><form>f<input></form></div></main><footer>f</footer></body>"""


def test_html_page():
    assert html_text.main_text(PAGE) == "Tést & more\n\none\n\ntwo bold x\n\na\n\nb"
    assert html_text.main_text("") == "" and html_text.main_text("plain &lt; text") == "plain < text"
    assert html_text.main_text("<article><p>a<p>b</article") == "a\n\nb" and html_text.main_text("<p>" * 5000 + "x") == "x"


def test_style_tree_removes_what_repeats(spark):
    pages = [(i, f"http://h.example/{i}", f"<body><div class='x1'><p>Same line on each page</p></div><div class='y'>" + "".join(f"<p>Own text {i * k} " + f"w{i} " * (i * k % 40) + "</p>" for k in range(1, 2 + i % 5)) + "</div></body>") for i in range(40)]
    pages += [(100, "http://one.example/", "<body><div class='z1'><p>Same line on each page</p></div></body>"), (101, None, None), (101, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"text": F.lit(1), "host": F.lit("c"), "path": F.lit("c"), "id": F.lit(1), "_key": F.lit(1)})
    got = collections.Counter((r.page_id, r.text) for r in html_text.extract(Scratch(spark, "t"), df).collect())
    own = lambda i: "\n\n".join(" ".join(f"Own text {i * k} {f'w{i} ' * (i * k % 40)}".split()) for k in range(1, 2 + i % 5))
    assert all(got[i, own(i)] == 1 for i in range(40)) and got[100, "Same line on each page"] == 1 and got[101, ""] == 2 and html_text.extract(Scratch(spark, "t"), df.where("false")).count() == 0


def test_style_tree_looks_at_all_words(spark):
    """Articles that share a few words and differ in all others stay, whichever words have the smallest hashes."""
    common = sorted((f"c{k}" for k in range(10_000)), key=html_text._hash)[:4]
    text = lambda i: " ".join([*common, *(w for k in range(10 << i % 4) if html_text._hash(w := f"w{i}x{k}") > html_text._hash(common[-1]))])
    pages = [(i, f"http://h.example/{i}", f"<body><div class='y'>{text(i)}</div></body>") for i in range(32)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.extract(Scratch(spark, "t"), df).collect()} == {i: text(i) for i in range(32)}


def test_style_tree_sums_in_batches_of_any_size(monkeypatch):
    """Features that are counted in many parts, and a node's slices that go on in the next batch, have the sums of all at once."""
    monkeypatch.setattr(html_text, "FEATURES", 40)
    text = lambda i: " ".join(f"w{k * k % 23}" for k in range(i, i + 9))
    pages = [(i % 3 - 1, f"<div><p>{text(i)}</p>x{i % 5} y</div><i>\ud800 {i}</i>" + "<p class='c'>z" * (i % 4)) for i in range(60)] + [(5, ""), (5, "<p>")]
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in pages], pa.int64()), pa.array(range(len(pages)))], ["key", "html"])
    monkeypatch.setattr(html_text, "page_parts", lambda i, real=html_text.page_parts: real(pages[i][1]))  # Arrow has no lone surrogates
    packed = pa.Table.from_batches(html_text._features(8)([batch.slice(0, 7), batch.slice(7, 0), batch.slice(7)])).sort_by([("id", "ascending"), ("kind", "ascending"), ("slice", "ascending")])
    monkeypatch.undo()
    counts = collections.Counter((k, *f) for key, source in pages for f in html_text.page_features(source) for k in (key, None))
    want = collections.defaultdict(lambda: [0, 0, 0.0])
    for (key, i, kind, _), c in counts.items():
        for k, x in enumerate((c, 1, c * math.log(c))):
            want[key, i, kind][k] += x
    for most in (1, 2, 7, 10_000):
        got = collections.defaultdict(lambda: [0, 0, 0.0])
        for b in html_text._tally(iter(packed.to_batches(max_chunksize=most))):
            for r in b.to_pylist():
                for k, x in enumerate((r["n"], r["styles"], r["clogc"])):
                    got[r["key"], r["id"], r["kind"]][k] += x
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_style_tree_shuffles_little(spark):
    """Every word of every text is counted, by host and over all hosts, and goes through the shuffle once, as little more than its hash."""
    text = lambda i: " ".join(f"{i % 7}x{(i * 977 + k * k) % 100_003}" for k in range(400))
    pages = spark.createDataFrame([(f"h{i % 5}", f"<body><div>{text(i)}</div></body>") for i in range(200)], "host string, html string")
    features = len({(r.host, *f) for r in pages.collect() for f in html_text.page_features(r.html)})
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def written():
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}

    before = written()
    assert len(html_text.style_tree(pages).collect()) == 10
    assert 8 < sum(n for k, n in written().items() if k not in before) / features < 12


def brute_importance(pages, by_host=True):
    """The importance of the nodes of pages (host, html), without Spark; hosts are put together if by_host is false."""
    feats = collections.defaultdict(lambda: collections.defaultdict(collections.Counter))
    for h, source in pages:
        for i, kind, f in html_text.page_features(source):
            feats[(h, i) if by_host else i][kind][f] += 1
    out = {}
    for node, x in feats.items():
        m = sum(x["s"].values())
        entropy = -sum(c / m * math.log(c / m) for c in x["s"].values())
        spread = [sum(c * math.log(c) for c in x[k].values()) / sum(x[k].values()) / math.log(max(m, 2)) for k in "aw" if x[k]]
        told = 1 - (sum(spread) / len(spread) if spread else 1)
        weight = html_text.GAMMA ** len(x["s"])
        out[node] = (m, 1.0 if m == 1 else (1 - weight) * min(1, entropy / math.log(min(max(m, 2), html_text.BASE))) + weight * told)
    if not by_host:
        return out
    every = brute_importance(pages, False)
    return {(h, i): ((m - 1) * v + html_text.PRIOR_PAGES * every[i][1]) / (m - 1 + html_text.PRIOR_PAGES) for (h, i), (m, v) in out.items()}


def test_style_tree_against_brute_force(spark, sf):
    pages = [(r.host, r.html) for r in table(spark, sf, "pages").select(urlfilter.host(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html")).collect()]
    want = brute_importance(pages)
    got = {(r.host, r.id): r.importance for r in html_text.style_tree(spark.createDataFrame(pages, "host string, html string")).collect()}
    assert got == pytest.approx(want) and len(got) > 300


def read_articles(spark, sf):
    """The tables' pages: what stands in the article element, read by patterns."""
    out = {}
    for r in table(spark, sf, "pages").collect():
        body = (r.html or "").partition("<article>")[2].partition("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        out[r.page_id] = "\n\n".join(x for x in blocks if x)
    return out


def test_html_against_plain_reading(spark, sf):
    want = read_articles(spark, sf)
    for r in html_text.op2_html_text(spark, sf).collect():
        assert r.text == want[r.page_id] and r.n_chars == len(r.text)


@pytest.mark.parametrize("rows", [html_text.BROADCAST_ROWS, 0])
def test_style_tree_without_names(spark, sf, monkeypatch, rows):
    """With all lists of names switched off, the tree alone takes menus, adverts and footers off the pages; by broadcast and by shuffle."""
    monkeypatch.setattr(html_text, "BROADCAST_ROWS", rows)
    big = sf.replace("sf0.001", "sf0.01")
    want = read_articles(spark, big)
    got = {r.page_id: r.text for r in html_text.extract(Scratch(spark, "t"), table(spark, big, "pages"), prior=False).collect()}
    assert sum(got[k] == want[k] for k in want) / len(want) > 0.95
    assert not any(html_text.main_text(r.html, prior=False) == want[r.page_id] for r in table(spark, big, "pages").collect())


def test_hostile_pages():
    """Depth, unmatched closers, odd quotes and unclosed tags cost no more than their length."""
    pages = ["<div>" * 100_000 + "x", "<div>x" * 100_000, "<b>" * 100_000 + "</i>" * 100_000, "<i><div>" + "<b>" * 50_000 + "</i>" * 50_000 + "x", "<a '" * 50_001 + "x", "<a " * 100_000 + '"', "<!--" * 100_000, "<script>" * 100_000, "&" * 300_000, "<p class='" + "a " * 200_000 + "'>x", "<td>" * 100_000, "<li><ul>" * 50_000]
    for source in pages:
        began = time.perf_counter()
        html_text.main_text(source)
        html_text.page_features(source)
        assert time.perf_counter() - began < 5, source[:20]
    assert html_text.main_text("<div>" * 100_000 + "x") == "x" and html_text.main_text("<i><div>" + "<b>" * 50_000 + "</i>" * 50_000 + "x") == "x"


def test_warc(spark, tmp_path):
    big = "".join(chr(97 + (i * i) % 26) for i in range(3000))
    noise = "".join(map(chr, np.random.default_rng(1).integers(33, 0x2FFF, 9_000_000)))
    pages = [(1, "http://a/ b\r\nX: y", big), (2, "http://b/", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (None, "u", big), (2, "http://b/", big), (6, "u", noise), (7, "u", "x" * 999), (8, "u", "x" * 999), (9, "u", "é" * 500), (10, "u", "é" * 500)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    scratch = Scratch(spark, "t")
    folder = warc.write(scratch, df)
    got = collections.Counter(map(tuple, warc.read(spark, folder, 50_000).collect()))
    assert got == collections.Counter(map(tuple, warc.read(spark, folder).collect()))
    last = {big: 2, "é" * 500: 10}
    want = []
    for i, _, h in pages:
        h = h or ""
        to = last[h] if h in last and i is not None and i < last[h] else None
        want.append((i, len(h.encode()), hashlib.sha1(h.encode()).hexdigest(), "revisit" if to else "response", to))
    assert got == collections.Counter(want)
    import glob

    for f in glob.glob(folder.removeprefix("file://") + "/part-*"):
        data = gzip.open(f).read()
        assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")
    none = warc.write(scratch, df.where("false"), "none")
    assert warc.read(spark, none).count() == 0


def test_warc_tasks(spark, tmp_path, monkeypatch):
    """Each range is a task's, though adaptive execution would put such small rows together."""
    (tmp_path / "a").write_bytes(b"x" * 1000)
    (tmp_path / "b").write_bytes(b"x" * 2000)
    (tmp_path / "c").write_bytes(b"")
    got = warc.ranges(spark, f"file://{tmp_path}", 100).withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == 30 and len({r.task for r in got}) == 30 and sum(r.stop - r.start for r in got) == 3000
    monkeypatch.setattr(warc, "MOST_TASKS", 7)
    got = collections.Counter(r.task for r in warc.ranges(spark, f"file://{tmp_path}", 100).withColumn("task", F.spark_partition_id()).collect())
    assert len(got) == 7 and max(got.values()) <= 6


def test_urls(spark):
    urls = ["http://X.Example.com/en/7?x", "http://example.com/en/8", "https://com/en/", "https://xcom/en/", "ftp://a.net/de/8#f", "http://a.example.net/de/81", "no scheme", "", None, "http://h", "://?", "http://a.org/es/x/://b"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumns({"host": F.lit(1), "token": F.lit(1)})
    labels = spark.createDataFrame([(0, True), (99, True), (None, False)], "id long, block boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(Scratch(spark, "t"), df, labels).collect()}
    assert got[0] == ("x.example.com", "/en/7", "example.com/en/7", "allow") and got[1][2:] == ("com/en/", "block") and got[2][2:] == ("com/en/", "block") and got[3][2:] == (None, "allow")
    assert got[4][2:] == ("net/de/", "block") and got[5][2:] == ("example.net/de/8", "allow") and got[6][:2] == got[7][:2] == got[8][:2] == ("", "") and got[9][:2] == ("h", "") and got[11][2] == "org/es/"


def test_rules_of_the_contract(spark):
    """Each given rule's word, on its host, a subdomain and beside its path; the longest rule wins."""
    want = {
        "http://com/en/": "block", "http://a.com/en/7": "block", "http://example.com/en/7": "allow", "http://w.example.com/en/71": "allow", "http://net/de/": "allow",
        "http://a.net/de/8": "allow", "http://example.net/de/8": "block", "http://w.example.net/de/81": "block", "http://example.net/de/7": "allow", "http://org/es/": "block", "http://a.org/de/": "allow",
    }
    df = spark.createDataFrame([(i, u) for i, u in enumerate(want)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urlfilter.judge(Scratch(spark, "t"), df, spark.createDataFrame([], "id long, block boolean")).collect()}
    assert [got[i] for i in range(len(want))] == list(want.values())


def test_mined_rules(spark):
    urls = [(i, f"http://{'spam' if i % 2 else 'good'}.site/{'a' if i % 4 < 2 else 'b'}/{i}") for i in range(200)]
    df = spark.createDataFrame(urls, "page_id long, url string")
    labels = df.select(F.col("page_id").alias("id"), (F.col("page_id") % 2 == 1).alias("block")).where("page_id < 100")
    got = urlfilter.judge(Scratch(spark, "t"), df, labels).collect()
    assert all((r.verdict == "block") == (r.page_id % 2 == 1) for r in got) and len(got) == 200
    assert urlfilter.judge(Scratch(spark, "t"), df.where("false"), labels).count() == 0


def test_rules_of_many_tokens(spark):
    """Only four tokens together tell what is blocked; repeated rows and labels count each on their own."""
    urls = [(i, "http://h/" + "/".join(c for c, on in zip("abcd", f"{i % 16:04b}", strict=True) if on == "1")) for i in range(640)]
    urls += urls[:1] + [(15, urls[15][1])] * 2
    df = spark.createDataFrame(urls, "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 16 == 15) for i in range(640)] + [(15, True)], "id long, block boolean")
    got = urlfilter.judge(Scratch(spark, "t"), df, labels).collect()
    assert len(got) == 643 and all((r.verdict == "block") == (r.page_id % 16 == 15) for r in got)


# --- languages and toxicity -------------------------------------------------------------------------------------------


def test_language_held_out(spark, sf, odd, empty):
    docs = table(spark, sf.replace("sf0.001", "sf0.01"), "documents")
    model = langid.fit(docs)
    got = langid.identify(docs, model).where(langid.held_out("doc_id")).select("lang", "lang_pred", "rejected").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97 and not any(r.rejected for r in got)
    out = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in out.values())
    assert langid.fit(empty) is None and langid.identify(odd, None).where("lang_pred != 'und'").count() == 0
    foreign = spark.createDataFrame([("Это русский текст о погоде и о природе, достаточно длинный для решения. " * 4,)], "text string")
    assert langid.identify(foreign, model).first().rejected
    same = [tuple(r) for r in langid.identify(docs, langid.fit(docs.repartition(5))).select("doc_id", "lang_pred").orderBy("doc_id").collect()]
    assert same == [tuple(r) for r in langid.identify(docs, model).select("doc_id", "lang_pred").orderBy("doc_id").collect()]


def brute_language(text, m):
    """The nearest centroid of a text by plain loops: language, cosine, whether it is rejected."""
    if text is None or not any(ch.isalpha() for ch in text):
        return "und", 0.0, True
    chain, before = [0], 1
    for ch in text.lower():
        c = ord(ch) if ch.isalpha() else 0
        if c or before:
            chain.append(c)
        before = c
    chain.append(0)
    counts = collections.Counter()
    for n in (2, 3, 4):
        for k in range(len(chain) - n + 1):
            gram = chain[k : k + n]
            if all(gram[1:-1]):
                h = gram[0]
                for j, c in enumerate(gram[1:], 2):
                    h = (h * 0x9E3779B97F4A7C15 + c + j) % 2**64
                counts[((h ^ h >> 29) * 0xBF58476D1CE4E5B9 % 2**64) >> 52] += 1
    x = {k: math.log1p(v) * float(m.idf[k]) for k, v in counts.items()}
    norm = math.sqrt(sum(v * v for v in x.values())) or 1e-12
    sims = [sum(v * float(c[k]) for k, v in x.items()) / norm for c in m.centroids]
    best = max(range(len(sims)), key=lambda k: sims[k])
    chance = sims[best] - float(m.centroids[best].mean()) * sum(x.values()) / norm
    least = m.least[min(31, int(math.log2(1 + sum(counts.values()))))]
    return m.langs[m.of[best]], min(1.0, max(0.0, sims[best])), chance < langid.SLACK * least


def test_language_against_brute_force(spark, sf, odd):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs)
    texts = docs.select("doc_id", F.substring("text", 1, 1500).alias("text")).limit(80).union(odd.select("doc_id", F.substring("text", 1, 3000)))
    texts = texts.union(spark.createDataFrame([(None, "Это русский текст о погоде. " * 9), (None, "ok"), (None, "1 2 3 a"), (None, "İstanbul ßẞ ǅ  x--y"), (None, "zq xj kv " * 30)], "doc_id long, text string"))
    for r in langid.identify(texts, model).collect():
        lang, score, rejected = brute_language(r.text, model)
        assert (r.lang_pred, r.rejected) == (lang, rejected) and r.score == pytest.approx(score, abs=1e-5), r.text


def test_toxicity_held_out(spark, sf, odd):
    big = sf.replace("sf0.001", "sf0.1")
    docs, labels = table(spark, big, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("t")), table(spark, big, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("y"))
    model = toxicity.fit(Scratch(spark, "t"), docs, labels.where("y IS NOT NULL"))
    got = toxicity.rate(docs.join(labels.where(langid.held_out("id")), "id").withColumnRenamed("t", "text"), model).select("y", "score").collect()
    hit = collections.Counter((r.y, r.score >= 0.5) for r in got)
    assert hit[1, True] / (hit[1, True] + hit[1, False]) > 0.85 and hit[0, True] / (hit[0, False] + hit[0, True]) < 0.02
    # the lexicon is learned: words of English, stems of other languages; the given list is no part of it
    assert {u for u in model.lexicon if u.startswith("=") and u[1:] not in toxicity.INSULTS or not u.startswith("=")} and all(v < 1 for v in model.lexicon.values())
    model = toxicity.fit(Scratch(spark, "t"), odd.select(F.col("doc_id").alias("id"), F.col("text").alias("t")).where("false"), spark.createDataFrame([], "id long, y int"))
    assert set(model.lexicon) == {f"={w}" for w in toxicity.INSULTS}
    out = toxicity.rate(odd, model).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    clash = odd.select(F.col("doc_id").alias("id"), F.col("text").alias("t"), F.lit(1).alias("y"), F.lit(1).alias("us"), F.lit(1).alias("k"))
    again = toxicity.fit(Scratch(spark, "t"), clash, spark.createDataFrame([(i, i % 2) for i in range(1, 9)] + [(None, 1), (3, None)], "id long, y int"))
    assert 0 <= again.score((0.0,) * 6) <= 1


def test_grammar():
    s = toxicity.Scorer({f"={w}": 1.0 for w in toxicity.INSULTS})
    plain, negated, said, quoted, aimed = (s.clause(x) for x in ("an idiot", "he is not an idiot", "she said he is an idiot", 'the word "idiot"', "you idiot"))
    assert aimed > plain > max(said, quoted) > negated > 0 and s.clause("i will kill you") > 1 > s.clause("kill the process") == 0
    assert s.features("") == (0,) * 6 and s.features("nice day. you idiot! fine") == (math.log1p(1), math.log1p(1), 0, 0, 0, 1.5)


def test_composed_machine():
    """The composed machine against its three parts run in turn, over random clauses."""
    rng = np.random.default_rng(8)
    for without in ((), ("negation",), ("report",), ("target",), toxicity.PARTS):
        machine = toxicity.grammar(without)
        for _ in range(400):
            symbols = "".join(rng.choice(list("ITYNRQOO"), rng.integers(0, 14)))
            state, got, kinds = machine.start, 0.0, ""
            for x in symbols:
                state, out, w = machine.step(state, x)
                got, kinds = got + w, kinds + out
            # by hand: negated within three words, then said by others, then aimed
            left, said, quote, far, seen, want = [], False, False, 99, None, 0.0
            for x in symbols:
                far = 0 if x == "N" else far + 1
                y = x.lower() if x in "IT" and far <= 3 and "negation" not in without else x
                if "report" not in without:
                    said, quote = said or y == "R", quote != (y == "Q")
                    y = {"I": "p", "T": "q"}.get(y, y) if said or quote else y
                left.append(y)
            for y in left:
                if y == "I":
                    want, seen = want + (1.5 if seen == "Y" else 1.0), "Y" if seen == "Y" else "I"
                elif y == "T":
                    want, seen = want + (1.2 if seen == "Y" else 0.0), "Y" if seen == "Y" else "T"
                elif y == "Y" and "target" not in without:
                    want, seen = want + {"I": 0.5, "T": 1.2}.get(seen, 0.0), "Y"
                else:
                    want += {"i": 0.05, "t": 0.05, "p": 0.25, "q": 0.25}.get(y, 0.0)
            assert got == pytest.approx(want), (symbols, kinds, without)


def test_grammar_tells_what_words_cannot(spark):
    """Where clean and toxic texts have the same words, aimed or negated and reported: each part of the grammar adds."""
    rng, docs, labels = np.random.default_rng(9), [], []
    words = [f"w{k}" for k in range(300)] + ["again", "are", "will", "that", "the"] * 12
    some = lambda n: " ".join(rng.choice(words, n))
    toxic = ["you are {0} again", "they are the {0}", "that {0} again", "i will {1} you", "we will {1} them again"]
    clean = ["you are not {0} again", "they are never the {0}", "she said that {0} again", 'you are "{0}" again', "i will not {1} you", "he said we will {1} them again", "that will {1} the w1"]
    for i in range(3000):
        frame = rng.choice(toxic if i % 2 else clean)
        docs.append((i, f"{some(12)}. {frame.format(rng.choice(['blorf', 'snark', 'gnarl']), rng.choice(['kill', 'burn']))}. {some(9)}."))
        labels.append((i, i % 2))
    df, known = spark.createDataFrame(docs, "id long, t string"), spark.createDataFrame(labels, "id long, y int")
    right = {}
    for without in ((), *((x,) for x in toxicity.PARTS), toxicity.PARTS):
        model = toxicity.fit(Scratch(spark, "t"), df, known, without)
        got = toxicity.rate(df.join(known, "id").where(langid.held_out("id")), model, "t").collect()
        right[without] = sum((r.score >= 0.5) == (r.y == 1) for r in got) / len(got)
        if not without:
            assert {"=blorf", "=snark", "=gnarl"} <= set(model.lexicon)
    assert right[()] > 0.98 and all(v < 0.95 for k, v in right.items() if k) and right[toxicity.PARTS] < 0.8, right


# --- near duplicates and repeats --------------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_clusters(prints):
    root = {k: k for k in range(len(prints))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    v = np.array([p for _, p in prints], np.uint64)
    for i in range(len(v)):
        d = np.unpackbits((v ^ v[i]).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=1)
        for j in np.flatnonzero(d <= 2):
            root[find(int(j))] = find(i)
    groups = collections.defaultdict(list)
    for k in range(len(v)):
        groups[find(k)].append(k)
    out = {}
    for g in groups.values():
        ids = [prints[k][0] for k in g if prints[k][0] is not None]
        out |= {k: min(ids) if ids else None for k in g}
    return collections.Counter((prints[k][0], f"{prints[k][1]:016x}", out[k]) for k in range(len(v)))


def test_simhash(spark, sf, odd, empty):
    for df in (table(spark, sf, "documents").select("doc_id", "text"), odd.select("doc_id", F.substring("text", 1, 3000).alias("text"))):
        got = simhash.clusters(Scratch(spark, "t"), simhash.fingerprints(df)).collect()
        got = collections.Counter((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in got)
        assert got == brute_clusters([(r.doc_id, brute_fingerprint(r.text)) for r in df.collect()])
    assert simhash.clusters(Scratch(spark, "t"), simhash.fingerprints(empty)).count() == 0
    assert simhash.fingerprints(odd).count() == len(ODD)


def test_ball_links(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40)
    values = sorted({int(b) ^ sum(1 << int(k) for k in rng.choice(62, n, replace=False)) for b in base for n in (0, 1, 2, 3, 4) for _ in range(4)})
    prints = [(i, v) for i, v in enumerate(values)]
    got = simhash.clusters(Scratch(spark, "t"), spark.createDataFrame(prints, "doc_id long, fp long")).collect()
    assert collections.Counter((r.doc_id, f"{r.fp:016x}", r.component_id) for r in got) == brute_clusters(prints)


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101)] + [(200, i) for i in range(201, 230)]
    got = dict(map(tuple, components(Scratch(spark, "t"), spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys((100, 101, 102), 100), **dict.fromkeys(range(200, 230), 200)}


def brute_near(docs):
    """Ids kept when texts of five-word shingle similarity 0.8 or more are linked."""
    sets = []
    for i, t in docs:
        w = (t or "").encode("utf-8", "surrogatepass").lower().split()
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x == y or min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
                root[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for k, (i, _) in enumerate(sets):
        groups[find(k)].append(-1 if i is None else i)
    return sorted(min(g) for g in groups.values())


def test_near_duplicates(spark, sf, odd, empty):
    words = [f"w{i}" for i in range(300)]
    made = [(1000, " ".join(words)), (1001, " ".join(words[:100] + ["x"] + words[101:])), (1002, " ".join(words[:295])), (1003, " ".join(words[:150]).upper()), (1004, " ".join(words[:150]))]
    docs = table(spark, sf, "documents").select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string"))
    got = sorted(r.doc_id for r in simhash.deduplicated(Scratch(spark, "t"), docs).collect())
    assert got == brute_near([tuple(r) for r in docs.collect()])
    kept = simhash.deduplicated(Scratch(spark, "t"), odd)
    assert kept.columns == odd.columns and sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted([1, 4, -1, 7, 8])
    assert simhash.deduplicated(Scratch(spark, "t"), empty).count() == 0


def test_near_duplicates_of_a_crowded_bucket(spark, monkeypatch):
    """A family with a common passage: buckets hold many groups, of which a member's partners are few."""
    monkeypatch.setattr(simhash, "MEMBERS", 16, raising=False)
    rng = np.random.default_rng(1)
    made = []
    for i in range(400):
        words = [f"w{k}" for k in range(254)]
        for k in rng.choice(254, rng.integers(2, 9), replace=False):
            words[k] = f"x{rng.integers(10**9)}"
        made.append((i, " ".join(words)))
    docs = spark.createDataFrame(made, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.deduplicated(Scratch(spark, "t"), docs).collect()) == brute_near(made)


def test_near_duplicates_of_a_template(spark):
    """300 pairs at 0.825 that share a long template with all others, which they are at 0.77 to."""
    made, template = [], [f"t{k}" for k in range(404)]
    for p in range(300):
        own = [f"p{p}w{k}" for k in range(16)]
        made += [(2 * p + d, " ".join(template[:200] + own + template[200:] + [f"d{2 * p + d}w{k}" for k in range(44)])) for d in range(2)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.deduplicated(Scratch(spark, "t"), docs).collect()) == list(range(0, 600, 2))


def test_near_duplicates_by_fingerprints_alone(spark, monkeypatch):
    """With bands that never meet, all pairs of nodes whose fingerprints are equal or two bits apart are verified."""
    real = simhash.sketch

    def apart(h):
        bands, kept = real(h)
        return [hash((b, kept)) >> 1 for b in bands], kept

    monkeypatch.setattr(simhash, "sketches", lambda docs, id_col, text_col: docs.sparkSession.createDataFrame(made, "k long, id long, node long, fp long, bands array<long>, kept binary"))
    rng = np.random.default_rng(6)
    one, two, three = (rng.integers(0, 1 << 63, 300, dtype=np.uint64) for _ in range(3))
    rows = [(0, one), (0, two), (0, two[:290]), (1, three), (2, three[:290]), (3, one[:290]), (2, np.zeros(0, np.uint64))]
    made = [(k, k, 10 + k, fp, *apart(np.sort(h))) for k, (fp, h) in enumerate(rows)]
    got = simhash.near_duplicates(Scratch(spark, "t"), spark.createDataFrame([], "doc_id long, text string"))
    assert sorted(r.k for r in got.collect()) == [0, 1, 3, 6]
    prints = spark.createDataFrame([(0,), (1,), (3,), (7,), (-1,)], "fp long")
    assert sorted(map(tuple, simhash.ball_pairs(prints).collect())) == [(0, 1), (0, 3), (1, 3), (1, 7), (3, 7)]


def test_near_duplicates_of_long_texts(spark):
    """Pairs of 4000 shingles, similar by little more or less than 0.8: a sample of 1024 would misjudge some."""
    rng, made = np.random.default_rng(4), []
    for p in range(40):
        words = [f"p{p}w{k}" for k in range(4004)]
        other = list(words)
        for k in range(88 if p % 2 else 90):  # each changed word changes five shingles: 0.802 or 0.798
            other[20 + 40 * k] = f"x{rng.integers(10**9)}"
        made += [(2 * p, " ".join(words)), (2 * p + 1, " ".join(other))]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.deduplicated(Scratch(spark, "t"), docs).collect()) == brute_near(made)


def brute_cut(docs, n):
    seen = collections.defaultdict(list)
    for i, t in docs:
        w = WORD.findall(t or "")
        for k in range(len(w) - n + 1):
            if i is not None:
                seen[tuple(w[k : k + n])].append(i)
    least, out = {k: min(v) for k, v in seen.items()}, []
    for i, t in docs:
        w = WORD.findall(t or "")
        gone = {k + j for k in range(len(w) - n + 1) if i is not None and least[tuple(w[k : k + n])] < i for j in range(n)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return collections.Counter(out)


@pytest.mark.parametrize("n", [5, 13, 50])
def test_substring(spark, sf, odd, n):
    extra = [(900, " ".join(f"a{i % 40}" for i in range(400))), (901, " ".join(f"a{i % 40}" for i in range(7, 300))), (901, "q " + " ".join(f"a{i}" for i in range(30))), (None, " ".join(f"a{i % 40}" for i in range(90)))]
    docs = table(spark, sf, "documents").select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    for df in (docs, odd.select("doc_id", F.substring("text", 1, 2000).alias("text"), "h", "id")):
        out = substring.cut(df, substring.repeated(Scratch(spark, "t"), df, n), n, joined=True).collect()
        assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.text or "") for r in out) == brute_cut([(r.doc_id, r.text) for r in df.collect()], n)


def test_substring_keeps_white_space(spark, empty):
    a = " ".join(f"b{i}" for i in range(60))
    df = spark.createDataFrame([(1, a), (2, f"start\n\n{a}\tnew   end \n"), (3, "  left  alone ")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in substring.cut(df, substring.repeated(Scratch(spark, "t"), df, 50), 50).collect()}
    assert out == {1: a, 2: "start\tnew   end", 3: "  left  alone "}
    assert substring.ladder(13) == [7, 13] and substring.ladder(50) == [7, 13, 25, 50] and substring.ladder(5) == [5]
    e = empty.select("doc_id", "text")
    assert substring.cut(e, substring.repeated(Scratch(spark, "t"), e)).count() == 0


# --- benchmark leaks --------------------------------------------------------------------------------------------------


def plain(t):
    return re.sub(r"[^\w\s]+|_", " ", (t or "").lower()).split()


def test_decontamination(spark, sf, odd, empty):
    bench = table(spark, sf.replace("sf0.001", "sf0.01"), "benchmark")
    docs = table(spark, sf.replace("sf0.001", "sf0.01"), "documents").select("doc_id", "text")
    items = {r.item_id: r.text for r in bench.collect()}
    grams = collections.defaultdict(set)
    for i, t in items.items():
        w = plain(t)
        for k in range(len(w) - 12):
            grams[tuple(w[k : k + 13])].add(i)
    got = {r.doc_id: set(r["items"]) for r in decontam.overlaps(docs, bench).collect()}
    for r in docs.collect():  # every exact overlap of 13 words is found, and a document without one of 8 is left alone
        w = plain(r.text)
        exact = {i for k in range(len(w) - 12) for i in grams.get(tuple(w[k : k + 13]), ())}
        assert exact <= got[r.doc_id]
    some = plain(items[0])
    swapped = ["zz" if k % 7 == 3 else x for k, x in enumerate(some)]
    cases = [(1, "Intro. " + " ".join(some).upper() + "! end"), (2, " ".join(swapped)), (3, " ".join("zz" if k % 2 else x for k, x in enumerate(some))), (4, " ".join(some[:8])), (5, None), (6, "one two three four five six")]
    tiny = spark.createDataFrame([(70, "one two three four five"), (71, "a b"), (72, None), (None, "x")], "item_id long, text string").union(bench.select("item_id", "text"))
    df = spark.createDataFrame(cases, "doc_id long, text string").withColumns({"items": F.lit(1), "h": F.lit(1)})
    out = {r.doc_id: r["items"] for r in decontam.overlaps(df, tiny).collect()}
    assert 0 in out[1] and 0 in out[2] and not out[3] and not out[4] and not out[5] and out[6] == [70]
    assert decontam.overlaps(odd, bench.where("false")).where(F.size("items") > 0).count() == 0 and decontam.overlaps(odd, bench).count() == len(ODD) and decontam.overlaps(empty, bench).count() == 0


def test_masks_hit_every_pattern():
    """Of 12 to 25 words each choice of a fifth of them leaves one mask whole somewhere."""
    for n in range(decontam.SPAN, 26):
        left = np.array([sum(1 << i for i in c) for c in itertools.combinations(range(n), n // 5)])
        for mask in decontam.MASKS:
            for at in range(n - max(mask)):
                left = left[left & sum(1 << (at + i) for i in mask) != 0]
        assert not len(left), n


def test_short_items(spark):
    """Items of 1 to 12 words, with each choice of a fifth of their words substituted, and with one more."""
    items, docs, want = [], [], {}
    for n in range(1, 13):
        words = [f"item{n}w{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        for spare in (n // 5, n // 5 + 1):
            for out in itertools.combinations(range(n), spare):
                docs.append((len(docs), " ".join(["before", "it", *("zz" if k in out else x for k, x in enumerate(words)), "after"])))
                want[docs[-1][0]] = [n] if spare == n // 5 else []
    found = decontam.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id: r["items"] for r in found.collect()} == want


def brute_overlap(words, item):
    """The longest run, ending with an equal word, of 80 % equal words on any diagonal; 0 if it is too short."""
    best = 0
    for shift in range(1 - len(item), len(words)):
        a, z = max(0, -shift), min(len(item), len(words) - shift)
        same = [item[k] == words[k + shift] for k in range(a, z)]
        if 10 * sum(same) < 8 * min(13, len(item)):
            continue  # too few for any run that counts
        if z - a == len(item) <= 13 and 10 * sum(same) >= 8 * len(item):
            best = len(item)
        total = np.concatenate(([0], np.cumsum([2 if x else -8 for x in same])))
        for e in (k + 1 for k, x in enumerate(same) if x):
            best = max(best, e - int(np.flatnonzero(total[:e] <= total[e])[0]))
    return best if best >= min(13, len(item)) else 0


@pytest.mark.parametrize("joined", [False, True])
def test_decontamination_against_brute_force(spark, sf, monkeypatch, joined):
    """Both ways: every document and item of sf0.01, and planted parts with substituted words; by broadcast and by shuffle."""
    if joined:
        monkeypatch.setattr(decontam, "BROADCAST_SEEDS", 0)
        monkeypatch.setattr(decontam, "BROADCAST_FOUND", 0)
    big, rng = sf.replace("sf0.001", "sf0.01"), np.random.default_rng(7)
    bench = table(spark, big, "benchmark").select("item_id", "text")
    items = {r.item_id: plain(r.text) for r in bench.collect()}
    docs = [(r.doc_id, plain(r.text)) for r in table(spark, big, "documents").select("doc_id", "text").collect()]
    docs = docs[::4] if joined else docs
    for k in range(400):  # 12 to 30 words of an item, a sixth to a quarter of them substituted
        w = items[int(rng.integers(len(items)))]
        n = min(int(rng.integers(12, 31)), len(w))
        at = int(rng.integers(len(w) - n + 1))
        part = list(w[at : at + n])
        for x in rng.choice(n, int(n * rng.choice([0.17, 0.2, 0.25])), replace=False):
            part[x] = "zz"
        docs.append((100_000 + k, ["some", "words", *part, "and", "more"]))
    got = {r.doc_id: (r["items"], r.overlap) for r in decontam.overlaps(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string"), bench).collect()}
    number, some = {}, 0
    code = lambda w: np.array([number.setdefault(x, len(number)) for x in w], np.int64)
    coded = {i: code(w) for i, w in items.items()}
    for d, w in docs:
        text, want = code(w), {}
        for i, item in coded.items():
            x, y = np.nonzero(text[:, None] == item[None, :])
            if len(x) and np.bincount(x - y + len(item)).max() >= 0.8 * min(13, len(item)):  # as many equal words on a diagonal
                if n := brute_overlap(text.tolist(), item.tolist()):
                    want[i] = n
        some += bool(want)
        assert got[d] == (sorted(want), max(want.values(), default=0)), d
    assert some > 200


def test_decontamination_of_repeated_words(spark):
    """Texts and items of one word, and of two in turn: places multiply, memory and time don't."""
    docs = [(1, "a " * 500_000), (2, "a b " * 20_000), (3, "c " * 100), (1, "a " * 500_000)]
    bench = spark.createDataFrame([(1, "a " * 500), (2, "a b " * 250), (3, "c"), (4, "b a " * 20)], "item_id long, text string")
    out = decontam.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert sorted((r.doc_id, r["items"], r.overlap) for r in out) == [(1, [1], 500), (1, [1], 500), (2, [2, 4], 500), (3, [3], 1)]


def test_best_overlap():
    rng = np.random.default_rng(3)
    for _ in range(500):
        same = rng.random(rng.integers(1, 40)) < rng.choice([0.5, 0.8, 0.95])
        want = max([z - a for a in range(len(same)) for z in range(a + 1, len(same) + 1) if same[z - 1] and 10 * same[a:z].sum() >= 8 * (z - a)] or [0])
        assert decontam.best_overlap(same) == want


# --- nearest vectors --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("groups", [topk.GROUPS, 4])
def test_topk(spark, monkeypatch, groups):
    monkeypatch.setattr(topk, "SLICE", 16)
    monkeypatch.setattr(topk, "BLOCK", 4)
    monkeypatch.setattr(topk, "GROUPS", groups)
    rng = np.random.default_rng(2)
    v = [(i, [float(x) for x in rng.normal(0, 0.3, 8)]) for i in range(150)] + [(i, [0.5] * 8) for i in range(150, 260)]
    v += [(300, None), (320, [1.0, None]), (340, [float("nan")] * 8), (360, [float("inf")] * 8), (380, []), (400, [0.1] * 3), (None, [0.1] * 8), (20, v[20][1]), (420, [-3.0] * 8)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>").withColumns({"label": F.lit(1), "qid": F.lit(1), "v": F.lit(1)})
    got = collections.defaultdict(list)
    for r in topk.search(Scratch(spark, "t"), df).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    fine = {i: [math.floor(64 * float(np.float32(x))) for x in e] for i, e in v if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    for q in (i for i in fine if i % 20 == 0):
        s = sorted((-sum(a * b for a, b in zip(fine[q], e, strict=False)), i) for i, e in fine.items() if i != q)[:20]
        assert sorted(got[q]) == [(k + 1, i, -x) for k, (x, i) in enumerate(s)]
    assert set(got) == {i for i in fine if i % 20 == 0} and topk.search(Scratch(spark, "t"), df.where("false")).count() == 0


def test_topk_opens_little_of_clusters(spark, monkeypatch):
    """The share of vectors that queries meet: little of clustered vectors, all of those that fill the space evenly."""
    monkeypatch.setattr(topk, "SLICE", 64)
    rng, share = np.random.default_rng(11), {}
    centres = rng.normal(0, 1, (60, 64))
    clustered = centres[rng.integers(0, 60, 6000)] + rng.normal(0, 0.1, (6000, 64))
    for name, x in (("clustered", clustered), ("even", rng.normal(0, 1, (6000, 64)))):
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        compared = spark.sparkContext.accumulator(0)
        df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
        got = collections.defaultdict(list)
        for r in topk.search(Scratch(spark, "t"), df, compared=compared).collect():
            got[r.query_id].append((r.rank, r.vec_id, r.score))
        share[name] = compared.value / (300 * 6000)
        whole = np.floor(64 * x).astype(np.int64)
        for q in range(0, 6000, 20):
            scores = whole @ whole[q]
            best = sorted((-int(scores[i]), i) for i in np.argsort(-scores)[:60].tolist() if i != q)[:20]
            assert [(s, i) for _, i, s in sorted(got[q])][:5] == [(-s, i) for s, i in best][:5] and sorted(s for _, _, s in got[q]) == sorted(-s for s, _ in best)
    print(share)
    assert share["clustered"] < 0.1 and share["even"] <= 1.01, share


def test_topk_keeps_vectors_from_the_driver(spark, monkeypatch):
    """The driver gets pivots and bounds, no vectors; few rows in many partitions are still cut into full slices and blocks."""
    monkeypatch.setattr(topk, "SLICE", 64)
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setitem(sent := {}, "bytes", 0)
    arrow, put, plan = type(spark.range(1)).toArrow, Scratch.put, lambda df: df._jdf.queryExecution().executedPlan().toString()

    def counted(df):
        out = arrow(df)
        sent["bytes"] += out.nbytes
        return out

    def kept(self, df, name):
        assert "Broadcast" not in plan(df), name
        sent[name] = put(self, df, name)
        return sent[name]

    monkeypatch.setattr(type(spark.range(1)), "toArrow", counted)
    monkeypatch.setattr(Scratch, "put", kept)
    x = np.random.default_rng(12).normal(0, 0.2, (3000, 32))
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 100)
    try:
        got = collections.defaultdict(list)
        found = topk.search(Scratch(spark, "t"), spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>"))
        assert "Broadcast" not in plan(found)
        for r in found.collect():
            got[r.query_id].append((r.rank, r.vec_id, r.score))
        pivots = 3000 // (2 * 64)
        assert sent["bytes"] < 3000 * 32 * 8 / 20
        assert sent["slices"].count() <= 3000 / 64 * 1.3 + pivots and sent["blocks"].select("sid").count() <= 150 / 16 * 1.3 + pivots
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    whole = np.floor(64 * x).astype(np.int64)
    for q in range(0, 3000, 20):
        best = sorted((-int(s), i) for i, s in enumerate(whole @ whole[q]) if i != q)[:20]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_words():
    import pyarrow as pa

    texts = ["a b", None, "", "b a", "a " + "z" * 10, " b"]
    w = Words(pa.array(texts), spans=True)
    assert list(w.counts()) == [2, 0, 0, 1, 2, 1] and w.hash[0] == w.hash[3] and w.hash[1] == w.hash[5]
    sliced = Words(pa.array(["skip", *texts]).slice(1))
    assert (sliced.hash == w.hash).all()
    long = "y" * 1_200_000
    assert Words(pa.array([long + " a"])).hash[-1] == w.hash[0]


def test_long_words(spark):
    """A word of more than a hash block is one word with one hash, wherever it lies."""
    import pyarrow as pa

    long = "".join(map(chr, np.random.default_rng(5).integers(97, 123, 1_200_000)))
    texts = [long, "a " * 70_001 + long + " b", long * 3, long[:-1], long, long + "\n" + long * 3]
    w = Words(pa.array(texts), spans=True)
    assert list(w.counts()) == [len(t.split()) for t in texts] and w.begin[-1] - w.end[-2] == 1
    assert w.hash[0] == w.hash[70_002] == w.hash[-3] == w.hash[-2] != w.hash[-4] and w.hash[-1] == w.hash[70_004] != w.hash[0]
    assert b"".join(w.buf[a:z].tobytes() for a, z in zip(w.begin, w.end, strict=True)) == "".join("".join(texts).split()).encode()
    same = " ".join(f"w{k}" for k in range(20))
    df = spark.createDataFrame([(1, f"{same} {long}"), (2, f"x {long} {same} y")], "doc_id long, text string")
    out = {r.doc_id: r for r in substring.cut(df, substring.repeated(Scratch(spark, "t"), df), joined=True).collect()}
    assert (out[1].n_words, out[1].n_removed, out[2].n_words, out[2].n_removed) == (21, 0, 23, 20) and out[2].text == f"x {long} y"
