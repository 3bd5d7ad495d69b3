"""Main text of pages, and the pipeline against a brute-force version."""

import random
from collections import Counter

import time

import pytest

import corpus_pipeline
from palimpsest.llm import decontaminate, html_text, mixing, pipeline, sharding, simhash


def page(lang, title, body, nav="a b", extra=""):
    return (
        f'<!DOCTYPE html><html lang="{lang}"><head><title>{title}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>'
        f'<nav><ul><li><a href="/x">{nav}</a></li></ul></nav><!-- ad 1 --><div class="ad">Buy now</div>{extra}<article><h1>{title}</h1>{body}</article>'
        f"<footer>&copy; host</footer>"
    )


def test_main_text(spark):
    aside = (
        '<header class="site"><p>Site name</p></header><div id="cookie-notice">We use cookies</div><aside>Side</aside><form><p>Mail</p><input></form>'
        '<section class="comments"><article class="comment"><p>First!</p></article></section><div hidden>no</div>'
    )
    rows = [
        (1, "http://a.example/1", page("en", "T&amp;one", "<p><b>One  bold<br>line<p>Two\n  lines</p><p>AT&amp;T &eacute; &#233;</p>", extra=aside)),
        (2, "http://a.example/2", page("fr", "Same", "<p>Licence line</p>", nav="c d")),
        (3, "http://a.example/3", page("fr", "Same", "<p>Licence line</p>")),
        (4, None, None), (5, "nonsense", ""), (6, "http://b.example/", "plain text &lt;b&gt; <i>and"), (2, "http://a.example/2", page("fr", "Same", "<p>Licence line</p>")),
        (7, "http://a.example/4", "<article><p>cut off <a href='x"),
    ]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    text = {r.page_id: r.text for r in got}
    assert text[1] == "T&one\n\nOne bold line\n\nTwo lines\n\nAT&T é é"
    assert text[2] == text[3] == "Same\n\nLicence line"
    assert (text[4], text[5], text[6], text[7]) == ("", "", "plain text <b> and", "cut off")


def test_wrapper_without_article(spark):
    """Pages that say nothing of their parts: what repeats over the host goes, what varies stays."""
    rows = []
    for i in range(12):
        rows.append((i, f"http://w.example/{i}", f"<body><div><p>All rights belong to us</p><ul><li>Home</li></ul></div><div><h1>Story {i}</h1><p>Tale number {i} is long.</p></div><div><p>Call us today</p></div></body>"))
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Story {i}\n\nTale number {i} is long." for i in range(12)}


def pages_of(spark, host, sources):
    rows = [(i, f"http://{host}/{i}", html) for i, html in enumerate(sources)]
    return {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_template_inside_the_article(spark):
    """What a host says in each article goes, and what varies stays; without alignment it would stay."""
    notice = "<p>You have read one of five free stories this month.</p>"
    tales = [f"<article><h1>Story {i}</h1>{notice}<p>Tale number {i} is {'long ' * (20 + i)}and told.</p><p>Our desk writes every day.</p></article>" for i in range(9)]
    want = {i: f"Story {i}\n\nTale number {i} is {'long ' * (20 + i)}and told." for i in range(9)}
    assert pages_of(spark, "n.example", tales) == want
    alone = html_text.extract(tales[3], html_text.Wrapper(None))
    assert "free stories" in alone and "every day" in alone
    # An odd, an empty or a missing first page of the host changes nothing.
    odd = [None, "", "<frameset><frame></frameset>"]
    got = pages_of(spark, "n.example", odd + tales)
    assert {i: got[i + 3] for i in want} == want and got[0] == got[1] == ""


def test_copies_are_no_template(spark):
    """Pages that repeat the reference, wholly or nearly, keep their text."""
    body = "<article><h1>The one</h1><p>Said once.</p><p>And again.</p></article>"
    more = [f"<article><h1>Other {i}</h1><p>Only {i}.</p></article>" for i in range(3)]
    near = [f"<article><h1>The one {i}</h1><p>Said once.</p><p>And again.</p></article>" for i in range(6)]
    got = pages_of(spark, "c.example", [body] * 8 + more + near)
    assert all(got[i] == "The one\n\nSaid once.\n\nAnd again." for i in range(8))
    assert all(got[11 + i] == f"The one {i}\n\nSaid once.\n\nAnd again." for i in range(6))


def test_parts_beside_the_article():
    text = lambda html: html_text.extract(html, html_text.Wrapper(None))
    assert text("<body><main><h1>Title</h1><p>Lead.</p><article><p>Body.</p></article><div>3 replies</div></main></body>") == "Title\n\nLead.\n\nBody."
    teasers = '<article><h2><a href="/1">Other story</a></h2></article>'
    assert text(f"<div><p>The long story itself is here.</p></div>{teasers}") == "The long story itself is here."
    assert text(f"<article><p>The long story itself is here, with all that is in it.</p></article>{teasers * 3}") == "The long story itself is here, with all that is in it."
    assert text("<section class=comments><article><p>First!</p></article></section><article><p>Main.</p></article>") == "Main."
    for names in ("content no-sidebar", "share-price", "page-with-nav", "related-works", "entry social-science", "breaking-news"):
        assert text(f'<article><div class="{names}"><p>Kept.</p></div></article>') == "Kept."
        assert text(f'<div class="{names}"><p>Kept.</p></div>') == "Kept."
    for names in ("sidebar", "main-nav", "cookie-notice", "site_footer", "ad-slot-3", "comments-area", "share-buttons", "related-posts", "x sidebar y"):
        assert text(f'<article><p>Kept.</p><div class="{names}"><p>Gone.</p></div></article>') == "Kept."
    assert text("<form><article><p>All in a form.</p></article></form>") == "All in a form."


def test_deep_and_wide_pages():
    deep = "<div>" * 5000 + "<p>deep"
    wide = "<ul>" + "".join(f"<li class=c{i % 7}><a>x{i}</a>" + "<b>q</b>" * (i % 5) + "</li>" for i in range(5000)) + "</ul>"
    other = "<ul>" + "".join(f"<li class=c{i % 5}><a>x{i}</a>" + "<b>q</b>" * (i % 3) + "</li>" for i in range(5000)) + "</ul>"
    for page, reference in ((deep, "<div>" * 4000 + "<p>x"), ("<b>" * 5000 + "x", "<b>" * 3000), (wide, other), ("</i>" * 5000 + "x", deep)):
        began = time.perf_counter()
        assert html_text.extract(page, html_text.Wrapper(reference, [1]))
        assert time.perf_counter() - began < 3


def test_hostile_markup_is_linear():
    """A megabyte of tags, strings or raw elements that nothing closes, and of elements that none ends, takes about a second."""
    n = 1_000_000
    parts = ["<a ", "<a x='", "<a x=\"'", "<a \">\" ", "<a '>\" ", "</script", "<script ", "<!-- ", "<! ", "<? ", "< ", "<", "<a=", "&lt;", "</", "<a\n"]
    pages = [p * (n // len(p)) for p in parts] + ["<a " * 300_000 + ">", "<p><td>" + "<b>" * 60_000 + "<h1></h1>" * 60_000, "<ul>" + "<i>" * 60_000 + "<li>x" * 60_000, "<script>" + "</script" * 120_000]
    for page in pages:
        began = time.perf_counter()
        html_text.parse(page)
        assert time.perf_counter() - began < 4, page[:20]


def test_tags_end_outside_strings():
    """The scanner against a plain automaton, from every tag of random markup."""
    rng = random.Random(3)
    for _ in range(3000):
        source = "<a" + "".join(rng.choices("\"'><ab= ", weights=[3, 3, 2, 3, 1, 1, 1, 1], k=rng.randrange(30)))
        tags = html_text.Tags(source)
        for at in [k + 2 for k in range(len(source)) if source.startswith("<a", k)]:
            quote, end = "", -1
            for k in range(at, len(source)):
                c = source[k]
                if quote:
                    quote = "" if c == quote else quote
                elif c == ">":
                    end = k
                    break
                elif c in "\"'":
                    quote = c
            assert tags.end(at) == (end if end >= 0 else source.find(">", at)), (source, at)


def test_nothing_else_is_dropped():
    text = lambda html: html_text.extract(html, html_text.Wrapper(None))
    long, short = "<article><p>" + "A long story. " * 30 + "</p></article>", '<article><p>A short one, after <a href="/x">that</a>.</p></article>'
    assert text(long + short).endswith("A short one, after that.")
    assert text("<main><h1>T</h1><div class=lead>A lead in a div.</div><article><p>Body.</p></article></main>") == "T\n\nA lead in a div.\n\nBody."
    assert text('<article><p class="social">On social matters.</p><p class="alert">An alert.</p></article>') == "On social matters.\n\nAn alert."
    for gone in ('<ol class="commentlist"><li>First!</li></ol>', '<ins class="adsbygoogle">Buy</ins>', '<div class="usercomments">Hm</div>', '<p class="advert">Buy</p>', '<div class="adslot">Buy</div>', '<div id="sidebarlinks">x</div>'):
        assert text(f"<article><p>Kept.</p>{gone}</article>") == "Kept."


def test_long_lists_align(spark):
    """More blocks in front than any band: the template goes whole, however far it is moved."""
    template = "".join(f"<div><p>House rule number {i}</p>{'<b>x</b>' * (i % 3)}</div>" for i in range(20))
    moved = lambda i: "".join(f"<div><p>Item {i} {k}</p>{'<i>y</i>' * (1 + k % 3)}</div>" for k in range(3 * i))
    got = pages_of(spark, "m.example", [f"<body>{moved(i)}{template}</body>" for i in range(8)])
    assert all("House rule" not in t for t in got.values()) and all(f"Item {i} {3 * i - 1}" in got[i] for i in range(1, 8))


def test_template_decides_before_names(spark):
    """Parts of no telling name, and a copy of their words in an article that varies, are told apart by place."""
    pages = [f"<div class=zone1>{'Fresh every day'}</div><article><h1>Tale {i}</h1><p>Fresh every day</p><p>{'word ' * i}</p></article><div class=zone2>Line {i % 2}</div>" for i in range(10)]
    got = pages_of(spark, "z.example", pages)
    assert all(got[i].startswith(f"Tale {i}") and "Line" not in got[i] for i in range(10))


def brute_matching(a, b):
    if a.label() != b.label():
        return 0
    x, y = a.kids, b.kids
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + brute_matching(x[i], y[j]))
    return 1 + table[-1][-1]


def test_tree_matching():
    rng = random.Random(5)

    def tree(depth):
        tag = rng.choice(["div", "section", "span", "b"])
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(rng.randrange(4) if depth else 0)) + f"</{tag}>"

    for _ in range(150):
        a, b = (html_text.mark(html_text.parse("".join(tree(3) for _ in range(rng.randrange(5))))) for _ in range(2))
        size, pairs = html_text.match(a, b)
        assert size == len(pairs) == brute_matching(a[0], b[0])
        assert len({x.at for x, _ in pairs}) == len({y.at for _, y in pairs}) == size
        assert all(x.label() == y.label() for x, y in pairs)
        up = {x.at: y.at for x, y in pairs}
        assert all(up[x.parent.at] == y.parent.at for x, y in pairs if x.parent)
        assert sorted(up.values()) == [up[k] for k in sorted(up)]  # page order is kept
    for _ in range(60):  # long lists of children, moved and mixed
        a, b = (html_text.mark(html_text.parse("".join(tree(1) for _ in range(rng.randrange(25, 40))))) for _ in range(2))
        size, pairs = html_text.match(a, b)
        assert size == len(pairs) == brute_matching(a[0], b[0])
    a = html_text.mark(html_text.parse("<div><p>1</p><ul><li>x</li><li>y</li></ul><p>2</p></div>"))
    assert html_text.match(a, html_text.mark(html_text.parse("<p>")))[0] == 1


def test_large_references(spark, monkeypatch):
    """Hosts whose references are too many to broadcast lead their pages in an exchange, with equal results."""
    rng = random.Random(4)
    rows = []
    for i in range(300):
        host = f"h{min(5, rng.randrange(12))}.example"
        rows.append((i, f"http://{host}/{i}", f"<div><p>Rights of {host}</p></div><div><h1>Story {i}</h1><p>{words(rng, 9)}</p></div>"))
    rows += [(300, None, "<p>no host"), (301, "http://h5.example/x", None), (None, "http://h5.example/y", "<div><p>Rights of h5.example</p></div><p>z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    here = sorted(map(str, html_text.main_text(df).collect()))
    monkeypatch.setattr(html_text, "REFERENCE_BYTES", 10)
    monkeypatch.setattr(html_text, "HOT_SHARE", 5)
    assert sorted(map(str, html_text.main_text(df).collect())) == here
    assert not any("Rights" in r for r in here)


def words(rng, n):
    return " ".join(rng.choice("the of and ing tion er".split()) + str(rng.randrange(500)) for _ in range(n))


@pytest.mark.parametrize("node_size", [8, 1 << 20])
def test_similar_texts(spark, node_size):
    rng = random.Random(7)
    rows, family = [], {}
    for g in range(30):
        base = words(rng, rng.randrange(40, 200)).split()
        for k in range(rng.randrange(1, 4)):
            own = list(base)
            for _ in range(k and max(1, len(own) // 90)):
                own[rng.randrange(len(own))] = "edit"
            family[len(rows)] = g
            rows.append((len(rows), " ".join(own)))
    rows += [(1000, None), (1001, ""), (None, "x y z"), (None, rows[3][1]), (None, "x y z"), (5, "another text of this id"), (None, "all alone")]
    found = simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string"), node_size=node_size).collect()
    got = {r.doc_id: r.component_id for r in found if r.doc_id in family and r.doc_id != 5}
    grams = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows if t and i in family}
    for a in got:
        for b in got:
            if len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.8:
                assert got[a] == got[b]
            if family[a] != family[b]:
                assert got[a] != got[b]
    assert {r.component_id for r in found if r.doc_id in (1000, 1001)} == {1000} and len(found) == len(rows)
    assert len([r for r in found if r.doc_id == 5 and r.stays]) == 1 + (got.get(5, 5) == 5 and family[5] not in {family[i] for i in range(5)})
    # Of texts without an id each stays once, but not the copy of a named one.
    assert Counter(r.stays for r in found if r.doc_id is None) == {True: 3, False: 1}
    assert sum(r.stays for r in found if r.doc_id is not None and r.doc_id != 5) == len({v for k, v in got.items()} - {5}) + 1


def edited(base, n):
    """base with n words changed in places five or more apart, away from both ends."""
    own = list(base)
    for k in range(n):
        own[4 + 5 * k] = f"edit{k}"
    return own


def jaccard(a, b):
    x, y = ({tuple(t[k : k + 5]) for k in range(max(1, len(t) - 4))} for t in (a, b))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("block", [1 << 21, 300])
def test_similar_texts_at_the_threshold(spark, monkeypatch, block):
    """Pairs just below 0.8 stay apart and pairs at 0.8 join, for short and long texts."""
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", block)
    rng = random.Random(3)
    pairs = []
    for k in range(20):
        base = words(rng, 8).split()
        pairs += [(base, [*base, f"more{k}"], True), (base[:7], [*base[:7], f"less{k}"], False)]
        long = words(rng, 364 + k).split()
        pairs += [(long, edited(long, 8), True), (long, edited(long, 9), False)]
    rows, expected = [], []
    for k, (a, b, same) in enumerate(pairs):
        a, b = [f"p{k}" + w for w in a], [f"p{k}" + w for w in b]
        assert (jaccard(a, b) >= 0.8) == same
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        expected += [(2 * k, 2 * k), (2 * k + 1, 2 * k + (not same))]
    got = simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == expected and all(r.stays == (r.doc_id == r.component_id) for r in got)


def test_recall_of_near_copies(spark):
    """Planted copies at similarities from 0.8 to 0.95: no pair at 0.8 or more is lost, none below joins."""
    rng = random.Random(13)
    rows, pairs = [], []
    for g in range(150):
        base = [f"{w}x{g}" for w in words(rng, rng.randrange(80, 400)).split()]
        n = len(base) - 4
        most = int(n * (1 - 0.8) / (1 + 0.8) / 5 * 1.2)
        own = edited(base, rng.randrange(1, most + 2))
        same = jaccard(base, own)
        pairs.append((2 * g, same))
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(own))]
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = [(i, s) for i, s in pairs if s >= 0.8]
    caught = sum(got[i + 1] == i for i, _ in near)
    assert len(near) > 80 and caught >= 0.98 * len(near)
    assert all(got[i + 1] == i + 1 for i, s in pairs if s < 0.8) and any(s < 0.8 for _, s in pairs)


def test_large_groups(spark, monkeypatch):
    """A group of many near copies over many blocks, and one that a chain of them holds together."""
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", 400)
    rng = random.Random(21)
    base = [f"{w}b" for w in words(rng, 120).split()]
    rows = [(i, " ".join(edited(base, i % 3) + [f"end{i}"])) for i in range(30)]
    chain = [f"{w}c{k}" for k, w in enumerate(words(rng, 400).split())]
    rows += [(100 + k, " ".join(chain[6 * k : 6 * k + 100])) for k in range(30)]
    texts = {i: t.split() for i, t in rows}
    root = {i: i for i in texts}
    for _ in texts:
        for a in texts:
            for b in texts:
                if a < b and root[a] != root[b] and jaccard(texts[a], texts[b]) >= 0.8:
                    low, high = sorted((root[a], root[b]))
                    root = {i: low if r == high else r for i, r in root.items()}
        break
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == root and len({root[i] for i in range(30)}) == 1 and len({root[100 + i] for i in range(30)}) == 1


def test_near_dedup_stage(spark):
    """Rows that share a doc_id, or have none, are told apart by their texts; a row listed twice stays once."""
    rng = random.Random(2)
    a, b, c, d = (words(rng, 60) for _ in range(4))
    rows = [(1, a, "x"), (1, b, "x"), (2, a, "y"), (None, c, "z"), (None, d, "z"), (None, c, "w"), (3, d, "v"), (4, words(rng, 50), "q"), (4, None, "q"), (5, "", "q")]
    rows += [(4, rows[7][1], "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = Counter((r.doc_id, r.text) for r in pipeline.near_dedup(spark, df, "").collect())
    assert got == Counter([(1, a), (1, b), (None, c), (3, d), (4, rows[7][1]), (4, None)])


def test_unlabelled_pipeline(spark, tmp_path):
    rows = [(i, words(random.Random(i), 40), None, "s", 1) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "nothing of it is here at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()} == set(range(30))


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    items = [(i, words(rng, 25)) for i in range(6)]
    docs, families, leaked = [], {}, set()
    for i in range(80):
        text = words(rng, rng.randrange(60, 150))
        if i % 9 == 4:
            own = rng.choice(docs[: len(docs)])[1]
            families[i] = own
            text = own
        elif i % 7 == 3:
            text += " " + rng.choice(items)[1] + " " + words(rng, 9)
            leaked.add(i)
        docs.append((i, text, "en", rng.choice("abc"), len(text)))
    docs += [(80, None, "en", "a", 0), (81, "123 456 !!", "en", "b", 10), (82, "", None, None, 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = spark.createDataFrame(docs, schema)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    first = {}
    for d in docs[:80]:
        if not any(jaccard(d[1].split(), t.split()) >= 0.8 for t in first):
            first[d[1]] = d
    kept = [d for d in first.values() if not any(t in d[1] for _, t in items)]
    assert {d[0] for d in first.values()} - {d[0] for d in kept} <= leaked
    taken = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(kept, schema)).collect()}
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    rows = got.collect()
    assert Counter(r.doc_id for r in rows) == Counter({i: n for i, n in taken.items() if n})
    shards = {r.doc_id: r.shard for r in sharding.shard(frame).collect()}
    assert all(shards[r.doc_id] == r.shard for r in rows)
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    stage_in = frame
    for _, stage in corpus_pipeline.STAGES[:-1]:
        stage_in = stage(spark, stage_in, str(tmp_path))
        assert stage_in.columns == frame.columns


def test_pipeline_of_empty_tables(spark, tmp_path):
    """No documents give no rows; no test items keep all; null and empty texts, and rows without an id, pass or go as stated."""
    docs, items = "doc_id long, text string, lang string, source string, n_chars long", "item_id long, text string"
    rng = random.Random(6)
    rows = [(i, words(rng, 30), "en", f"s{i % 3}", 100) for i in range(30)] + [(40, None, None, None, None), (41, "", "en", "s0", 0), (None, words(rng, 20), None, None, 9)]
    for name, given, bench in (("none", [], [(1, "a test item of some words here")]), ("items", rows, []), ("both", [], [])):
        spark.createDataFrame(given, docs).coalesce(1).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(bench, items).coalesce(1).write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    for name in ("none", "both"):
        out = pipeline.run(spark, f"{tmp_path}/{name}")
        assert out.count() == 0 and {"doc_id", "text", "shard", "slot"} <= set(out.columns)
    got = pipeline.run(spark, f"{tmp_path}/items").collect()
    assert len({r.doc_id for r in got}) > 20  # each source is mixed to its weight
    assert all(r.text for r in got) and {40, 41}.isdisjoint({r.doc_id for r in got})
