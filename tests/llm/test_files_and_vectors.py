import base64
import hashlib
import io
import random
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import vafile, warc, wrappers

# WARC


def test_directory_against_zipfile_with_and_without_zip64():
    for large in (False, True):
        raw = io.BytesIO(b"")
        with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
            for name, data in (("a", b"x" * 1000), ("b/é", b""), ("c", b"yz")):
                with z.open(zipfile.ZipInfo(name), "w", force_zip64=large) as m:
                    m.write(data)
            z.comment = b"PK\x05\x06 is not the end"[:3]
        size = len(raw.getvalue())
        for m in warc.directory(raw, size):
            with zipfile.ZipFile(raw) as z:
                assert raw.getvalue()[m.offset : m.offset + m.size] == z.read(m.name) and m.method == 0


def test_directory_with_zip64_end_record(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        for i in range(5):
            z.writestr(f"m{i}", bytes([i]) * 200)
    found = warc.directory(raw, len(raw.getvalue()))
    assert b"PK\x06\x06" in raw.getvalue() and [(m.name, raw.getvalue()[m.offset : m.offset + m.size]) for m in found] == [(f"m{i}", bytes([i]) * 200) for i in range(5)]


def test_what_is_no_archive():
    with pytest.raises(ValueError):
        warc.directory(io.BytesIO(b"nothing here"), 12)


def test_round_trip(spark):
    rows = [(1, "http://a/", "<p>é</p>"), (5, "http://b c\r\nX: y", "<p>é</p>"), (3, None, "<p>é</p>"), (2, "u", None), (4, "u", ""), (9, "v", "one\r\n\r\ntwo"), (9, "v", "one\r\n\r\ntwo"), (None, "w", "alone"), (7, "w", "z" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=repr)
    best = {}
    for p, _, h in rows:
        if p is not None:
            best[h or ""] = max(p, best.get(h or "", p))
    expected = []
    for p, _, h in rows:
        data = (h or "").encode()
        other = best.get(h or "")
        expected.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), *(("revisit", other) if other is not None and other != p else ("response", None))))
    assert got == sorted(expected, key=repr)


def test_payloads_come_back_from_several_archives(spark):
    from orrery.llm.shared import new_path, staged

    pages = spark.range(50).selectExpr("id as page_id", "'u' as url", "repeat(string(id), 200) as html").coalesce(2)
    archives = staged(warc.write_archives(warc.with_revisits(pages), new_path(spark, "t"), archive_bytes=500), "t")
    assert archives.count() > 2
    assert {r.page_id: bytes(r.payload).decode() for r in warc.read_archives(archives, True).collect()} == {i: str(i) * 200 for i in range(50)}


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# Exact top-k


def brute_top(rows, k):
    out = []
    for q, v in rows:
        if q is not None and q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 0.02])
def test_top_k_against_all(spark, monkeypatch, scale):
    monkeypatch.setattr(vafile, "BLOCK", 37)
    monkeypatch.setattr(vafile, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(8)
    vectors = (scale * rng.normal(size=(400, 16))).astype(np.float32)
    vectors[300:] = vectors[0]  # many ties
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(450, [1.0, 2.0]), (451, [3.0, -1.0])]
    whole = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows]
    bad = [(500, None), (550, [1.0] * 15 + [None]), (600, [float("nan")] * 16), (650, [float("inf")] * 16)]
    table = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<float>").withColumn("uid", F.lit("clash"))
    got = vafile.top_k(table, F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top(whole, 5)


def test_top_k_of_few_and_repeated_rows(spark):
    table = spark.createDataFrame([(50, [1.0]), (50, [1.0]), (1, [0.5])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in vafile.top_k(table, F.col("vec_id") % 50 == 0).collect())
    assert got == [(50, 1, 50, 65536), (50, 1, 50, 65536), (50, 2, 1, 32768), (50, 2, 1, 32768)]
    assert vafile.top_k(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_hold_whatever_the_size():
    rng = np.random.default_rng(2)
    for size in (3, 200, 1 << 30, 1 << 54):
        v = rng.integers(-size, size, (50, 6))
        grid, cells = vafile._grid(v)
        lower, upper = vafile.bounds(v[:9], grid, cells)
        exact = v[:9].astype(object) @ v.T.astype(object)
        assert (lower <= exact).all() and (exact <= upper).all()


def test_exact_vectors_are_read_for_few_only(spark, monkeypatch):
    """Bounds from the cells leave few vectors to read."""
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(2000, 16))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    reads = []
    plain = vafile.scored
    monkeypatch.setattr(vafile, "scored", lambda asked, q, v: (reads.append(asked.count()), plain(asked, q, v))[1])
    assert vafile.top_k(table, F.col("vec_id") % 50 == 0).count() == 200
    assert reads[0] == 200 and sum(reads) < 0.02 * 40 * 2000


def test_components_that_are_too_large_are_an_error(spark):
    table = spark.createDataFrame([(0, [1e300]), (1, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        vafile.top_k(table, F.col("vec_id") % 50 == 0).collect()
    huge = spark.createDataFrame([(0, [2.0**40, 1.0]), (1, [2.0**40, 2.0]), (2, [-(2.0**22), 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception):  # 2 ** 96
        vafile.top_k(huge, F.col("vec_id") == 0).collect()
    large = spark.createDataFrame([(0, [2.0**22, 1.0]), (1, [2.0**22, 2.0]), (2, [-(2.0**22), 0.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in vafile.top_k(large, F.col("vec_id") == 0).collect()] == [(1, 2**60 + 131072), (2, -(2**60))]


# HTML


def page(body, title="T"):
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/x>More</a></li></ul></nav><div class=\"ad\">BUY {title}</div>{body}<footer>&copy; site</footer>"


def article(i, extra=""):
    rng = random.Random(i)
    return page(f"<article><h1>Title {i} &amp; more</h1>" + "".join(f"<p>Paragraph {rng.random()} of  {i}\n text.</p>" for _ in range(rng.randint(1, 6))) + extra + "</article>", f"T{i}")


def test_wrapper_of_a_host():
    found = wrappers.infer([article(i) for i in range(6)])
    assert found["path"] == [["html"], ["body"], ["article"]] and "(<p>#text</p>)+" in found["expression"] and "(<li>" in found["expression"]


def test_runs_of_elements_become_repeated_groups():
    def of(pairs, more=""):
        return page("<article><h1>Head</h1>" + "".join(f"<h2>Part {i}</h2><p>Text {i}</p><ul><li>{i}</li></ul>" for i in pairs) + f"{more}</article>")

    run = "<h2>#text</h2><p>#text</p><ul><li>#text</li></ul>"
    assert f"<h1>Head</h1>({run})+</article>" in wrappers.infer([of(range(3)), of(range(3, 8))])["expression"]
    # a page that has the run once, and one with something else behind
    assert f"<h1>Head</h1>({run})+(<p><b>End</b></p>)?</article>" in wrappers.infer([of([9]), of(range(3)), of(range(3, 8), "<p><b>End</b></p>")])["expression"]


def test_what_is_not_the_article():
    extra = '<div class="share-bar">Share</div><form><label>Mail</label><input></form><section id="comments"><article class="comment"><p>Nice</p></article></section><aside>Side</aside>'
    pages = [article(i, extra) for i in range(6)]
    text = wrappers.main_text(pages[2], wrappers.infer(pages))
    assert text.startswith("Title 2 & more\n\nParagraph") and not any(x in text for x in ("Share", "Mail", "Nice", "Side", "Home", "BUY", "©"))


def test_what_all_articles_of_a_host_hold_stays():
    """Headings that all recipes have, and parts whose names only sound like something else."""
    recipes = [page(f'<article><h1>Recipe {i}</h1><h2>Ingredients</h2><p>Item {i}</p><h2>Method</h2><p>Step {i}</p><div class="side-effects">None</div><p class="foot-note">Note</p><section id="legal">Law</section></article>') for i in range(5)]
    found = wrappers.infer(recipes)
    for i, html in enumerate(recipes):
        assert wrappers.main_text(html, found) == "\n\n".join([f"Recipe {i}", "Ingredients", f"Item {i}", "Method", f"Step {i}", "None", "Note", "Law"])
    versions = [page(f"<article><div>Lone block</div><p>Same start</p><p>Edited {i}</p></article>") for i in range(6)]
    assert wrappers.main_text(versions[2], wrappers.infer(versions)) == "Lone block\n\nSame start\n\nEdited 2"


def test_siblings_of_one_name_are_told_apart_by_what_they_hold():
    def of(i, menu=True):
        links = '<div><ul><li><a href="/">Home</a></li></ul></div>' if menu else ""
        return f"<html><body>{links}<div><h1>News {i}</h1><p>{'long text ' * 20}{i}</p></div><div><ul><li><a href=/y>About</a></li><li><a href=/z>More</a></li></ul></div></body></html>"

    found = wrappers.infer([of(i) for i in range(6)])
    assert [e[0] for e in found["path"]] == ["html", "body", "div"] and len(found["path"][2]) == 3
    for html, i in ((of(3), 3), (of(11), 11), (of(12, menu=False), 12)):
        assert wrappers.main_text(html, found) == f"News {i}\n\n{('long text ' * 20).strip()} {i}"


def test_two_articles_of_a_page_are_both_read():
    found = wrappers.infer([article(i) for i in range(4)])
    assert wrappers.main_text(page("<article><p>One</p></article><div class=ad>no</div><article><p>Two</p></article>"), found) == "One\n\nTwo"


def test_long_and_deep_pages_are_narrowed_to_their_article(monkeypatch):
    def of(n, deep):
        text = "".join(f"<p>Text {i}</p>" for i in range(n))
        return page('<div class="site">Site text</div>' + "<section>" * deep + f'<div class="post">{text}</div>' + "</section>" * deep)

    for n, deep in ((100, 0), (20_000, 0), (100, 150)):
        assert wrappers.main_text(of(n, deep), None) == "\n\n".join(f"Text {i}" for i in range(n)), (n, deep)
    for html in (of(50, 3), article(3), *(article(i, "<p>one</p><div class=x>two</div><p>three <a href=/>four</a></p>") for i in range(20))):
        assert wrappers.main_text(html, None) == wrappers.main_text(html, {"path": wrappers.article_path(wrappers.page_items(html))})


def test_articles_without_the_element():
    pages = [page(f'<div class="wrap"><div class="sidebar">Links {i}</div><div class="post"><h2>News {i}</h2><p>{"long text " * 30}{i}</p></div></div>', str(i)) for i in range(5)]
    assert wrappers.main_text(pages[3], wrappers.infer(pages)) == f"News 3\n\n{('long text ' * 30).strip()} 3"


@pytest.mark.parametrize("html, text", [(None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b<br>c&nbsp;&eacute;&#65;", "a\n\nb c éA"), ("<script>x</script>", ""), ("<!-- open", ""), ("<p>x < y</p>", "x < y"), ("<div>" * 3000 + "deep", "deep"), ("<ul><li>1<li>2</ul>", "1\n\n2")])
def test_odd_pages(html, text):
    assert wrappers.main_text(html, None) == text


def test_extraction_of_a_table(spark):
    rows = [(i, f"http://h{i % 2}.example/{i}", article(i)) for i in range(30)] + [(100, None, None), (101, "no url", ""), (None, "http://h0.example/", article(3)), (0, "http://h0.example/0", article(0))]
    got = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert next(r for r in got if r.page_id == 7).text.startswith("Title 7 & more\n\nParagraph")
    assert next(r for r in got if r.page_id == 100).text == ""
    assert wrappers.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("unit", ['<b "', "<title>", "<svg>", "<p><a>", "<", "<!", "</x", "<b '>", "&amp", "<div><p>"])
def test_time_does_not_follow_the_square_of_odd_pages(unit):
    took = []
    for n in (20_000, 80_000):
        began = time.process_time()
        wrappers.main_text(f"<article><p>Words here</p>{unit * n}", None)
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 1


def test_elements_that_never_end_hold_no_more_than_their_parent():
    for tag in ("svg", "object", "canvas", "title", "noscript"):
        html = f"<body><article><h1>Head</h1><div><{tag}></div><p>One</p><object><object>x</object>y</object><p>Two</p></article></body>"
        assert wrappers.main_text(html, None) == "Head\n\nOne\n\nTwo", tag
    assert wrappers.main_text("<article><p>One</p><script>var x = 1", None) == "One"
    assert wrappers.main_text("<article><p>One<b><i><u><s><q><em><tt><code><kbd><var>deep<h2>Two</h2>", None) == "One deep\n\nTwo".replace(" ", "")


def test_one_rule_for_pages_of_any_size():
    """The article beside a teaser of the same key: the same answer for a page of some paragraphs and of many thousand."""

    def of(n, also=""):
        text = "".join(f"<p>Paragraph {i} of the story</p>" for i in range(n))
        return f"<html><body><div><ul><li>One teaser</li><li>Other teaser {also}</li></ul></div><div>{text}</div></body></html>"

    for n in (5, 3_000, 9_000):
        for wrapper in (None, wrappers.infer([of(n)])):
            assert wrappers.main_text(of(n), wrapper) == "\n\n".join(f"Paragraph {i} of the story" for i in range(n)), n
    assert wrappers.infer([of(9_000)])["path"] is None and wrappers.infer([of(5)])["path"] is None


def test_what_differs_outweighs_what_is_the_same():
    blurb = "We are a paper of this town and have been so for years. " * 12
    pages = [f'<html><body><div class="about">{blurb}</div><div class="story"><p>{"A word of story " * 4}{i}.</p></div></body></html>' for i in range(16)]
    found = wrappers.infer(pages)
    for i, html in enumerate(pages):
        assert wrappers.main_text(html, found) == " ".join(f"{'A word of story ' * 4}{i}.".split())
    # versions of one article are the same on all pages, and the article all the same
    story = "".join(f"<p>Sentence {i} of a long story that is told again</p>" for i in range(60))
    versions = [f'<html><body><div class="story">{story}</div><div class="seen"><p>Seen {i} times</p></div></body></html>' for i in range(16)]
    assert wrappers.main_text(versions[4], wrappers.infer(versions)).startswith("Sentence 0 of") and "Sentence 59" in wrappers.main_text(versions[4], wrappers.infer(versions))


@pytest.mark.parametrize("name", ["share-prices", "social-history", "legal-text", "side-by-side", "notice-of-works", "comment-culture", "ad-astra", "menu-of-the-day"])
def test_a_word_in_a_name_does_not_empty_a_page(name):
    pages = [f'<html><body><nav><a href="/">Home</a></nav><div class="{name}"><h1>Title {i}</h1><p>The story {i} is here.</p></div><div class="footer">Site text</div></body></html>' for i in range(4)]
    for wrapper in (None, wrappers.infer(pages)):
        assert wrappers.main_text(pages[2], wrapper) == "Title 2\n\nThe story 2 is here."


@pytest.mark.parametrize("tag", ["form", "object", "dialog"])
def test_an_article_in_a_page_wide_container_is_read(tag):
    pages = [f'<html><body><{tag} id="f" action="/"><nav><a href="/">Home</a></nav><div class="story"><p>{"The story is here. " * 5}{i}</p></div><div class="cookie-notice">We use cookies</div></{tag}></body></html>' for i in range(4)]
    for wrapper in (None, wrappers.infer(pages)):
        assert wrappers.main_text(pages[2], wrapper) == f"{'The story is here. ' * 5}2".strip()
    assert wrappers.main_text('<article><p>Short</p></article><form class="login"><p>Log in here with a name and some words</p></form>', None) == "Short"


def test_names_say_nothing_where_nothing_is_left():
    assert wrappers.main_text('<html><body><div class="comments"><p>All there is</p></div></body></html>', None) == "All there is"
    assert wrappers.main_text("<html><body><nav>Home</nav><script>x</script></body></html>", None) == ""


def test_articles_of_made_pages_against_what_they_were_made_from():
    """Pages of random frames around random articles: the text that went in comes out."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    for _ in range(12):
        holder, menu = rng.choice(["article", "div", "main", "td"]), "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(6))
        blurb = " ".join(word() for _ in range(30))
        pages, texts, kind = [], [], rng.choice("ab")
        for _ in range(8):
            blocks = [" ".join(word() for _ in range(rng.randint(8, 40))) for _ in range(rng.randint(2, 9))]
            inner = "".join(f"<{t}>{b}</{t}>" for b, t in zip(blocks, ["h1", *rng.choices(["p", "blockquote", "pre"], k=len(blocks) - 1)]))
            body = f'<{holder} class="body-{kind}">{inner}</{holder}>'
            pages.append(f'<html><body><div class="top-nav"><ul>{menu}</ul></div><div class="who">{blurb}</div>{"<table><tr>" + body + "</tr></table>" if holder == "td" else body}<div class="sidebar">{word()} {word()}</div><div id="comments"><p>{word()} {word()}</p></div><footer>{word()}</footer></body></html>')
            texts.append("\n\n".join(blocks))
        found = wrappers.infer(pages)
        got = [wrappers.main_text(p, found) for p in pages]
        assert sum(a == b for a, b in zip(got, texts)) >= 7, (holder, [(a, b) for a, b in zip(got, texts) if a != b][:1])
