import io
import random
import wave
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusloom.llm import chroma, html_extract, mixing, packing, toxicity, url_filter

from .fixtures import collected, documents


# -- 1: mixing -----------------------------------------------------------------------------------------


def filled(sizes, weights, most):
    """Targets by resharing the excess again and again."""
    target, fixed, left = dict.fromkeys(sizes, 0.0), set(), float(sum(sizes.values()))
    while True:
        free = [s for s in sizes if s not in fixed]
        if not free:
            return target
        total = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / total > most * sizes[s]]
        if not over:
            return target | {s: left * weights[s] / total for s in free}
        for s in over:
            target[s] = float(most * sizes[s])
        left -= sum(target[s] for s in over)
        fixed |= set(over)


@pytest.mark.parametrize("bins", [4096, 2])
def test_mix_meets_targets(spark, bins):
    docs = documents(spark)
    rows = collected(docs)
    words = [len((r["text"] or "").split(None)) if r["text"] else 0 for r in rows]
    size = defaultdict(int)
    for r, n in zip(rows, words):
        size[r["source"]] += n
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    want = filled(size, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 3)
    got = collected(mixing.select_mix(docs, bins=bins))
    assert len(got) == len(rows) and sorted(r["size"] for r in got) == sorted(words)
    taken = defaultdict(int)
    for r in got:
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    key = lambda rs: sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in rs)
    if bins == 2:
        assert key(got) == key(collected(mixing.select_mix(docs.repartition(7))))
    for s in want:  # complete epochs precede the fractional part
        epochs = int(want[s]) // size[s]
        assert all(r["taken"] >= epochs * r["size"] for r in got if r["source"] == s)
    assert mixing.select_mix(documents(spark, empty=True)).count() == 0


def test_mixed_documents_repeat_whole_rows(spark):
    docs = documents(spark)
    out = collected(mixing.mixed_documents(docs))
    texts = {(r["doc_id"], r["text"]) for r in collected(docs)}
    assert out and all((r["doc_id"], r["text"]) in texts for r in out) and set(out[0]) == set(docs.columns)


# -- 2: chroma -----------------------------------------------------------------------------------------


def tune(seed, seconds=30, rate=11025):
    rng, t = random.Random(seed), np.arange(int(0.4 * rate)) / rate
    notes = [sum(np.sin(2 * np.pi * 220 * 2 ** (rng.randint(0, 24) / 12) * t) for _ in range(2)) for _ in range(int(seconds / 0.4))]
    return (np.concatenate(notes) * 6000).astype("<i2")


def test_recordings_align(spark):
    a, b = tune(1), tune(2)
    noisy = (a + np.random.default_rng(3).normal(0, 60, len(a))).astype("<i2")
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(11025)
        w.writeframes(noisy[10 * 1365 :].tobytes())
    rows = [(100, a.tobytes()), (1, out.getvalue()), (2, b.tobytes()), (3, a.tobytes()), (4, None), (5, b"\0")]
    media = spark.createDataFrame([(i, bytearray(x) if x is not None else None) for i, x in rows], "id long, media binary")
    got = {r["id"]: r for r in collected(chroma.align(media, chroma.pcm_frames))}
    assert got == {r["id"]: r for r in collected(chroma.align(media, chroma.pcm_frames, block_bytes=200, pass_bytes=200, parts=2))}
    assert got[3]["class_id"] == got[100]["class_id"] == 3
    assert [(m["query_id"], m["offset"]) for m in got[1]["matches"]] == [(3, 10)]
    assert not got[2]["matches"] and got[4]["n_items"] == 0 and got[4]["class_id"] == got[5]["class_id"] == 4


def test_text_scores_find_their_copies(spark):
    docs = documents(spark)
    media = docs.selectExpr("doc_id AS id", "text AS media", "size", "n_chars AS crc", "digest")
    rows = collected(media)
    ints = [chroma.integers(chroma.text_frames(r["media"])) for r in rows]
    got = collected(chroma.align(media, every=2))
    assert len(got) == len(rows)
    classes = defaultdict(list)
    for r, x in zip(rows, ints):
        classes[x.tobytes()].append(r["id"])
    asks = {min((i for i in ids if i is not None), default=None) for ids in classes.values() if any(i is not None and i % 2 == 0 for i in ids)}
    # brute force over every offset: `most` at the thresholds that define a match, `want` where the overlap is no
    # chance one (a few integers of unrelated texts agree to three quarters at some of very many offsets)
    want, most = defaultdict(set), defaultdict(set)
    named = {min((i for i in ids if i is not None), default=None): np.frombuffer(x, np.uint32) for x, ids in classes.items() if x}
    for q in asks & named.keys():
        for c, y in named.items():
            x = named[q]
            near = [n for n, e in (chroma.bit_error(x, y, o) for o in range(-len(y) + 1, len(x))) if e <= 0.25] if c != q and c is not None else []
            if any(n >= min(8, len(x), len(y)) for n in near):
                most[c].add(q)
            if any(n >= 32 for n in near):
                want[c].add(q)
    found = {r["class_id"]: {m["query_id"] for m in r["matches"]} for r in got}
    hits = sum(len(want[c] & found[c]) for c in want)
    assert hits >= 0.9 * sum(map(len, want.values())) and hits > 3
    assert all(found[c] <= most[c] for c in found)  # no false match
    assert sorted(map(str, got)) == sorted(map(str, collected(chroma.align(media, every=2, block_bytes=6000, pass_bytes=12000, parts=3))))


def test_integers_of_long_texts_come_in_portions(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 500))) for _ in range(60)] + [None, "", " a\tb "]
    want = [chroma.integers(chroma.text_frames(t)) for t in texts]
    for portion in (1 << 20, 700, 60):
        monkeypatch.setattr(chroma, "PORTION", portion)
        assert all(np.array_equal(x, y) for x, y in zip(want, chroma.text_integers(texts), strict=True))


@pytest.mark.parametrize("hits", [1 << 21, 50, 1])
def test_every_position_votes(monkeypatch, hits):
    """All pairs of equal integers count, those at later places of a repeated value too."""
    monkeypatch.setattr(chroma, "HITS", hits)
    rng = np.random.default_rng(7)
    asks, rows = ([rng.integers(0, 40, n).astype(np.uint32) for n in sizes] for sizes in ((30, 1, 90), (50, 3, 0, 80)))
    value, at, query = chroma._marks(asks)
    order = np.argsort(value, kind="stable")
    marks, places, who = chroma._marks(rows)
    got = chroma.candidates((value[order], query[order], at[order]), marks, places, who, np.array([-1, 2, -1, 0])).tolist()
    want = Counter((i, j, a - b) for i, y in enumerate(rows) for j, x in enumerate(asks) if (i, j) not in ((1, 2), (3, 0)) for a in range(len(x)) for b in range(len(y)) if x[a] == y[b])
    assert got == [[i, j, o, n] for (i, j, o), n in sorted(want.items(), key=lambda kv: (*kv[0][:2], -kv[1], abs(kv[0][2]), kv[0][2]))]


def test_altered_texts_are_found(spark):
    """Words inserted mid-text or replaced, against every offset at the thresholds that define a match."""
    rng, rows, want = random.Random(5), [], set()
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    for k in range(60):
        base = [word() for _ in range(rng.randint(150, 600))]
        half = len(base) // 2
        copy = [base[:half] + [word() for _ in range(5 - 2 * (k % 2))] + base[half:], [word() if rng.random() < 0.12 else w for w in base]][k % 3 == 2]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        x, y = (chroma.integers(chroma.text_frames(t)) for _, t in rows[-2:])
        if any(n >= 8 and e <= 0.25 for n, e in (chroma.bit_error(x, y, o) for o in range(-len(y) + 8, len(x) - 7))):
            want.add(2 * k)
    media = spark.createDataFrame(rows, "id long, media string")
    found = {m["query_id"] for r in collected(chroma.align(media, every=2)) for m in r["matches"] if m["query_id"] == r["id"] - 1}
    print(f"recall {len(want & found)} of {len(want)}")
    assert len(want) > 50 and len(want & found) >= 0.9 * len(want)


# -- 4: pages ------------------------------------------------------------------------------------------

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var x = "</p><article>no</article>";</script></head>
<body><header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></ul></nav><div class="cookie-notice">We use cookies</div>
<!-- <article>no</article> --><article><h1>Head &amp;  line</h1><p>One <b>two</b>
three&nbsp;four<p>Five<br>six<div class="ad">Buy</div><aside>Side</aside><form><input>Name</form><ul><li>x<li>y</ul>
<section id="comments"><p>Nice!</p></section></article><footer>&copy; F</footer></body></html>"""


def test_extract():
    assert html_extract.extract(PAGE) == "Head & line\n\nOne two three four\n\nFive six\n\nx\n\ny"
    assert html_extract.extract(None) == html_extract.extract("") == html_extract.extract("<p>") == ""
    assert html_extract.extract("<article><p>never closed &lt;b&gt; " + "w" * 100_000) == "never closed <b> " + "w" * 100_000
    body = "".join(f"<p>{'long text ' * 20}{i}</p>" for i in range(5))
    plain = f"<div><a href=x>Home</a></div><div><a href=x>News</a></div>{body}<div>ok</div>"
    kept = html_extract.extract(plain)
    assert kept.count("long text") == 100 and "Home" not in kept
    assert html_extract.regions([0, 100, 5, 0, 0, 0, 3, 0], 3, 86) == [(1, 3)]


def test_regions_decide():
    link = "<li><a href=x>some link text</a>"
    page = f"<div><h1>Title</h1><p>{'Body text. ' * 9}<ul>{link * 4}</ul><p>{'More body text. ' * 9}</div>"
    kept = html_extract.extract(page)
    assert kept.startswith("Title\n\nBody") and "More body" in kept and "link" not in kept  # a run of links is a dive
    assert "some link text" in html_extract.extract(page.replace(link * 4, link))  # one link between texts is none
    assert html_extract.extract(page.replace("div>", "main>")).count("some link text") == 4  # a marked article loses nothing
    assert html_extract.extract("<div><p>A short page.</p></div>") == "A short page."
    assert html_extract.extract("<div><h2>A title</h2><p>Two short.</p><p>Lines here.</p></div>") == "A title\n\nTwo short.\n\nLines here."
    assert html_extract.extract("<p><a href=x>only a link</a>") == "only a link"
    assert html_extract.extract("<main></main><div><p>A short page.</p></div>") == "A short page."
    assert html_extract.regions([5, 0, 0, 9, 9], 2, 86) == [(3, 5)] and html_extract.regions([0, 0], 2, 86) == []


def test_nothing_of_an_article_is_lost():
    refs = "".join(f"<li><a href=r{k}>Reference {k}</a></li>" for k in range(5))
    page = f"<article><h1>T</h1><p>{'Long text. ' * 30}</p><h2>References</h2><ol>{refs}</ol><p>Short end.</p></article>"
    kept = html_extract.extract(page).split("\n\n")
    assert kept[0] == "T" and kept[2:] == ["References", *(f"Reference {k}" for k in range(5)), "Short end."]
    page = '<article><p class="share">Share of the market grew.</p><section id="promotion"><p>Prose on promotion.</p></section><div class="share"><a href=x>Tweet</a></div><div class=related><a href=y>More</a> of it</div><p>End</article>'
    assert html_extract.extract(page) == "Share of the market grew.\n\nProse on promotion.\n\nEnd"
    for value in ("<b>y</b>" * 2000, "x > y " * 4000, "</article><p>" * 3000):
        assert html_extract.extract(f"<article><p title=\"{value}\" data-x='{value}'>One</p></article>") == "One"
    many = " ".join(f"a{k}='p > q'" for k in range(2000))
    assert html_extract.extract(f"<article><p {many}>One</p></article>") == "One"
    assert html_extract.extract('<article><p title="never closed>One</p><p>Two</p></article>') == "One\n\nTwo"


def built_page(rng):
    """A page and its article's blocks, put together from parts whose meaning is known."""
    words = ["alpha", "be&amp;ta", "&lt;b&gt;", "gam&#109;a", "x&nbsp;y", "<b>bold</b>", "<i>it</i>al", "<a href='u?a=1&b=2'>link</a>", "d<wbr>elta", "1 < 2", "\n line"]
    plain = ["alpha", "be&ta", "<b>", "gamma", "x y", "bold", "ital", "link", "delta", "1 < 2", "line"]
    odd = ["", ' title="a > b"', " data-x='<p>no</p>'", ' class="lead text"', " hidden-by=me", ' id="related-work"', " onclick='if (a < b) go(\"x\")'"]
    junk = ["<nav><ul><li><a href=x>Home</a></ul></nav>", "<aside><p>Side text, long enough to be a block of its own.</p></aside>", "<script>if (a<b) document.write('<p>no</p>')</script>", "<style>p>b{}</style>",
            '<div class="ad">Buy these shoes now, they are cheap and good.</div>', "<form><label>Name</label><input></form>", "<!-- <p>no</p> -->", '<div id="cookie-banner"><p>We use cookies on this page.</p></div>',
            '<section class="comments"><div><p>Nice article, I liked it a lot.</p></div></section>', '<ul class="share"><li><a href=x>Post</a><li><a href=y>Mail</a></ul>', "<svg><text>no</text></svg>", "<div hidden>unseen</div>", "<footer>End</footer>"]

    def text():
        at = [rng.randrange(len(words)) for _ in range(rng.randint(1, 12))]
        return " ".join(words[k] for k in at), " ".join(" ".join(plain[k] for k in at).split())

    out, blocks = [], []
    for _ in range(rng.randint(1, 9)):
        kind = rng.choice(["p", "h2", "blockquote", "li", "open", "div", "junk"])
        if kind == "junk":
            out.append(rng.choice(junk[:-1]))
            continue
        inner, said = text()
        blocks.append(said)
        end = "" if kind == "open" else "</p>" if kind == "p" else f"</{kind}>"
        tag = "p" if kind == "open" else kind
        attrs = rng.choice(odd)
        out.append(f"<ul><li{attrs}>{inner}</li></ul>" if kind == "li" else f"<{tag}{attrs}>{inner}{end}")
    mark = rng.choice(["article", "main"])
    around = [rng.choice(junk) for _ in range(4)]
    return f"<!DOCTYPE html><html><head><title>no</title></head><body>{around[0]}{around[1]}<{mark}>{''.join(out)}</{mark}>{around[2]}{around[3]}</body></html>", "\n\n".join(blocks)


def test_built_pages():
    rng = random.Random(12)
    for _ in range(1500):
        page, want = built_page(rng)
        assert html_extract.extract(page) == want, page


def test_names_and_broken_markup():
    page = "<html><head><meta charset=utf-8><body><form id=all><article><header><h1>Title</h1></header><div class='related-work'>On related work.</div><p class=search>On search.</p><h2 id=comments-on-method>Comments on it</h2>"
    page += "<div class='comment-list'>Nice!</div><div id=adSlot3>Buy</div><p class=notice>Take care</p><ul class=share-links><li>Share</ul></article></form>"
    assert html_extract.extract(page) == "Title\n\nOn related work.\n\nOn search.\n\nComments on it"
    assert html_extract.extract('<article><p title="a > b < c">One</p><p>two <b') == "One\n\ntwo"


def test_malformed_pages_take_linear_time():
    import time

    for unit in ('<a href="x ', '<a "<b"x"', "<script ", "<p title='", "<!-- ", "<", "<title>", "<div class=share>", '<p a="', "<a b=", '<a "" ', ' "" "'):
        began = time.process_time()
        html_extract.extract(unit * 30_000)
        assert time.process_time() - began < 10


class Dom:
    """Another way to the article's blocks: html.parser's events, for well-formed structure."""

    def __init__(self, page):
        from html.parser import HTMLParser

        out, open_, dom = [], [], self
        blocks = {"p", "h1", "h2", "li", "ul", "div", "article", "br?"}

        class Parser(HTMLParser):
            text = ""

            def flush(self):
                if self.text.strip():
                    out.append(" ".join(self.text.split()))
                self.text = ""

            def handle_starttag(self, tag, attrs):
                if tag in blocks:
                    self.flush()
                if tag == "br":
                    self.text += " "
                elif tag not in ("b", "p", "meta", "li"):
                    open_.append((tag, dict(attrs).get("class")))

            def handle_endtag(self, tag):
                if tag in blocks:
                    self.flush()
                if open_ and open_[-1][0] == tag:
                    open_.pop()

            def handle_data(self, data):
                names = [t for t, _ in open_]
                if "article" in names and not {"nav", "aside", "form", "footer"} & set(names) and ("div", "ad") not in open_:
                    self.text += data

        parser = Parser(convert_charrefs=True)
        parser.feed(page)
        parser.close()
        parser.flush()
        dom.text = "\n\n".join(out)


def test_tables_pages_against_another_parser():
    import os

    import duckdb

    path = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables here")
    pages = [h for (h,) in duckdb.sql(f"SELECT html FROM '{path}'").fetchall()]
    assert len(pages) > 100 and all(html_extract.extract(p) == Dom(p).text for p in pages)


def test_extract_pages(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 3), (None, None, None, 4), (1, "u", PAGE, 3)], "page_id long, url string, html string, n_chars int")
    got = collected(html_extract.extract_pages(pages))
    assert len(got) == 3 and {(r["page_id"], r["n_chars"]) for r in got} == {(1, 47), (None, 0)}


# -- 5: packing ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("size,windows", [(1024, 32), (64, 2)])
def test_packing_round_trip(spark, size, windows):
    docs = documents(spark)
    encode = packing.encoder()
    want = defaultdict(int)
    for r in collected(docs):
        want[(r["doc_id"], np.append(encode(r["text"] or ""), np.uint32(0)).astype("<u4").tobytes())] += 1
    ids = {k[0]: [] for k in want}
    for d, data in want:
        ids[d].append(np.frombuffer(data, "<u4"))
    rows = collected(packing.pack(docs, size=size, open_windows=windows, merge=2))
    assert sum(r["length"] for r in rows) == sum(len(d) // 4 * n for (_, d), n in want.items())
    windows = defaultdict(list)
    for r in rows:
        windows[r["sequence_id"]].append(r)
        assert any(len(x) == r["doc_tokens"] and zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in ids[r["doc_id"]])
    padding = 0
    for parts in windows.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    assert padding == 0
    once = [(d, len(x)) for (d, x), n in want.items() if n == 1 and sum(k[0] == d for k in want) == 1]
    for d, n in once[:20]:  # each id lies in exactly one piece
        pieces = sorted((r["start"], r["length"]) for r in rows if r["doc_id"] == d)
        assert [s for s, _ in pieces] == [0, *np.cumsum([k for _, k in pieces])[:-1]] and sum(k for _, k in pieces) == n // 4
    assert packing.pack(documents(spark, empty=True)).count() == 0


def test_encoder_agrees_with_tokenizers():
    from tokenizers import Tokenizer

    slow, encode = Tokenizer.from_file(packing.tokenizer_path()), packing.encoder()
    for t in ["", "Hello  world\n\n x", "a" * 3000, " " * 500, "é ß 漢字 🙂", "x <|endoftext|> y", "it's 12345!?"]:
        assert encode(t).tolist() == slow.encode(t, add_special_tokens=False).ids


# -- 6: toxicity ---------------------------------------------------------------------------------------


def labelled(spark, n=400):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        words = [rng.choice("river stone cloud letter window garden music bread".split()) for _ in range(12)]
        bad = i % 3 == 0
        if bad:
            words += rng.choices(["vile", "scumbag"], k=2) + (["women"] if rng.random() < 0.8 else [])
        elif rng.random() < 0.1:
            words.append("men")
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(bad)))
    docs = spark.createDataFrame([(i, t, 0.0, 1) for i, t, _ in rows] + [(None, None, 0.0, 1), (9999, "", 0.0, 1)], "doc_id long, text string, score double, toxic int")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_toxicity_held_out_and_counterfactual(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in collected(toxicity.score_documents(docs, model))}
    truth = {r["doc_id"]: r["toxic"] for r in collected(labels) if r["doc_id"] is not None and r["toxic"] is not None}
    for i, y in truth.items():
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i]["predicted"] == y
    assert got[None]["predicted"] == got[9999]["predicted"] == 0 and got[None]["held_out"] is False
    neutral = "the women in the garden read a letter"
    biased = toxicity.fit(docs, labels, fair=0.0)
    assert model.scores([neutral])[0] < biased.scores([neutral])[0]
    swapped = neutral.replace("women", "men")
    assert abs(model.scores([neutral])[0] - model.scores([swapped])[0]) < abs(biased.scores([neutral])[0] - biased.scores([swapped])[0])


def test_toxicity_without_labels(spark):
    docs, labels = labelled(spark, 12)
    model = toxicity.fit(docs, labels.where("doc_id < 0"))
    assert {r["score"] for r in collected(toxicity.score_documents(docs, model))} == {0.5}
    assert toxicity.score_documents(docs.limit(0), model).count() == 0


# -- 7: urls -------------------------------------------------------------------------------------------


def test_url_rules_and_model(spark):
    urls = ["https://A.Example.org/es/1", "http://example.org/en/12?x", "http://example.org/en/2", "https://notexample.org.com/de/x", "http://x.com/fr/#a", "http://org", None, "no scheme", "a://b?c://d/", "http://free-casino-bets.example.net/en/1", "https://www.thorening.example.net/en/22", "http://x.net/y://z/"]
    pages = spark.createDataFrame([(k, u, 1, "r") for k, u in enumerate(urls)], "page_id long, url string, host int, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in collected(url_filter.judge(pages))}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == ("example.org", "/en/2", "org/", "allow")
    assert got[3][2:] == ("com/de/", "block") and got[4] == ("x.com", "/fr/", "com/fr/", "allow")
    assert got[5][:3] == ("org", "", None) and got[6][:3] == got[7][:3] == ("", "", None)
    assert got[8][:2] == ("b", "") and got[9][3] == "block" and got[10][3] == "allow" and got[11][1] == "/y://z/"
    for url, y in url_filter.labelled_urls():  # the model separates its own table
        bias, w = url_filter.weights()
        assert (bias + sum(w[g] for g in url_filter._features(*url_filter._split(url))) > 0) == bool(y), url


HELD_OUT = (
    ("https://royal-casino.example.com/en/9", 1), ("http://casino-bonus.example.net/join", 1), ("https://www.bets-today.example.org/en/3", 1),
    ("http://cheap-pills-online.example.com/de/1", 1), ("https://buy-pills.example.net/cart", 1), ("http://ads-click.example.com/pixel", 1),
    ("https://spam-links.example.net/fr/8", 1), ("http://adult-video.example.com/watch", 1), ("https://payday-loans-fast.example.org/apply", 1), ("http://win-free-money.example.com/claim", 1),
    ("https://www.geology.example.com/en/44", 0), ("http://garden-club.example.net/de/18", 0), ("https://choir.example.org/fr/2", 0), ("https://m.railways.example.net/es/70", 0),
    ("http://blog.sailing.example.com/en/512", 0), ("https://www.chemistry.example.net/en/31", 0), ("http://theatre-group.example.com/en/6", 0), ("https://weather.example.org/de/129", 0),
    ("https://history-museum.example.net/fr/77", 0), ("http://www.cycling.example.com/en/205", 0),
)


#: Written before the model first judged them (11 right then, with fewer bad names in the frames; now 16).
FRESH = (
    ("https://vip-casino-club.example.org/en/4", 1), ("http://m.live-bets.example.net/de/31", 1), ("https://mega-poker.example.com/fr/2", 1), ("http://www.pills-direct.example.net/es/9", 1),
    ("https://my-ads-server.example.com/img", 1), ("http://spam-blast.example.org/en/71", 1), ("https://blog.adult-stories.example.net/en/6", 1), ("http://quick-loans.example.com/de/8", 1),
    ("https://casino-review.example.net/en/15", 1), ("http://viagra-store.example.org/fr/22", 1),
    ("https://beekeeping.example.com/en/4", 0), ("http://m.tennis.example.net/de/31", 0), ("https://newspaper.example.org/fr/2", 0), ("http://www.insurance-law.example.net/es/9", 0),
    ("https://genealogy.example.com/fr/60", 0), ("http://fire-brigade.example.org/en/71", 0), ("https://blog.watercolour.example.net/en/6", 0), ("http://bicycle-repair.example.com/de/8", 0),
    ("https://m.economics.example.com/en/15", 0), ("http://www.trains.example.net/fr/22", 0),
)


def test_url_model_on_held_out_urls(spark):
    pages = spark.createDataFrame([(k, u, y) for k, (u, y) in enumerate(HELD_OUT + FRESH)], "page_id int, url string, bad int")
    judged = {r["page_id"]: r["verdict"] for r in collected(url_filter.judge(pages, rules=()))}
    right = [(judged[k] == "block") == bool(y) for k, (_, y) in enumerate(HELD_OUT + FRESH)]
    old, fresh = sum(right[: len(HELD_OUT)]), sum(right[len(HELD_OUT) :])
    print(f"held-out urls judged right: {old} and {fresh} of 20 each")
    assert old >= 17 and fresh >= 16


#: Frozen: written before the model of this table first judged them (38 right then), and no change may be made for their sake.
FROZEN = tuple((u, 1) for u in (
    "https://freebetting.com/", "http://slots777.net/play", "http://buy-viagra.ru/", "https://adserver.doubleclick.net/ddm/clk", "https://www.pokerstars-bonus.com/join", "http://casino.netbet-promo.co/en", "https://pornmovies.tube/watch/9",
    "http://sexdating.club/", "https://cams.adultlive.net/", "http://cialis-online.shop/order", "https://pills-discount.biz/", "http://ads.trackpixel.com/img", "https://click.adtracker.io/r", "http://payday-cash-loans.net/apply",
    "https://win-prizes-now.xyz/claim", "http://crypto-doubler.top/", "https://roulette-live.bet/", "http://xxxvideos.pro/", "https://banner.adnetwork.biz/", "http://replica-bags-cheap.cn/",
)) + tuple((u, 0) for u in (
    "https://www.nytimes.com/2020/", "https://www.washingtonpost.com/politics/", "https://www.heise.de/news/1", "https://www.lefigaro.fr/sciences/", "https://www.elmundo.es/deportes/", "https://www.stanford.edu/academics", "https://www.nih.gov/health",
    "https://postgresql.org/docs/", "https://www.ecosia.org/", "https://www.tate.org.uk/art", "https://www.thetimes.co.uk/", "https://www.sciencedirect.com/journal", "https://pytorch.org/tutorials", "https://www.bergfreunde.de/",
    "https://www.cookinglight.com/recipes", "https://www.historyextra.com/period", "https://www.parks.ca.gov/", "https://www.violinist.com/blog", "https://www.fahrrad-xxl.de/", "https://www.essex.gov.uk/",
))


def test_url_model_on_frozen_urls(spark):
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(FROZEN)], "page_id int, url string")
    judged = {r["page_id"]: r["verdict"] == "block" for r in collected(url_filter.judge(pages, rules=()))}
    hits = sum(judged[k] and y for k, (_, y) in enumerate(FROZEN))
    false = sum(judged[k] and not y for k, (_, y) in enumerate(FROZEN))
    print(f"recall {hits} of 20, precision {hits} of {hits + false}")
    assert hits >= 17 and false <= 1
    seen = {h.lower() for h in url_filter.BLOCKED + url_filter.ORDINARY}
    assert not [u for u, _ in FROZEN + HELD_OUT + FRESH if url_filter._split(u)[0] in seen]
    assert not [h for h in seen for n in ("casino-win", "free-bets", "ads-track", "cheap-pills", "spam-farm", "adult-x") if h.partition(".")[0] == n]


def test_empty_and_awkward_pages(spark):
    schema = "page_id long, url string, html string, text string, host string, verdict string"
    none = spark.createDataFrame([], schema)
    assert html_extract.extract_pages(none).count() == url_filter.judge(none).count() == 0
    assert chroma.align(none.selectExpr("page_id AS id", "html AS media")).count() == 0
    long_ = "<article>" + "<p>word &lt; " * 30_000 + "</article>"
    rows = [(1, "http://a.example.com/en/" + "x" * 50_000, long_, "t", "h", "v"), (1, None, "<p" * 1000, "t", "h", "v"), (None, "://", "&#0;&#x110000;<!-- <p>", "t", "h", "v")]
    pages = spark.createDataFrame(rows, schema)
    got = {r["n_chars"] for r in collected(html_extract.extract_pages(pages))}
    assert max(got) == 30_000 * 6 + 2 * 29_999
    assert url_filter.judge(pages).count() == 3


def test_awkward_documents_are_scored(spark):
    docs, labels = labelled(spark, 60)
    model = toxicity.fit(docs, labels)
    odd = documents(spark)
    scores = [r["score"] for r in collected(toxicity.score_documents(odd, model))]
    assert len(scores) == odd.count() and all(0 <= s <= 1 for s in scores)
    kept = toxicity.clean_documents(odd, model)
    assert kept.columns == odd.columns and kept.count() <= len(scores)
