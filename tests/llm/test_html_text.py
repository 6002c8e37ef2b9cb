"""Operator 2: containers, hosts' boilerplate, edge rows."""

from quarry.llm import html_text as H

SCHEMA = "page_id bigint, url string, html string, text string, host string"


def page(body):
    return f"<html><head><title>T</title><style>p{{}}</style><script>var t='</p>'</script></head><body>{body}</body></html>"


def texts(spark, rows, **options):
    df = spark.createDataFrame([(i, u, h, "x", None) for i, u, h in rows], SCHEMA)
    return {r["page_id"]: (r["text"], r["n_chars"]) for r in H.main_text(df, **options).collect()}


def test_article_container():
    html = page('<nav><a>Home</a></nav><div class="ad">Buy</div><article><header><h1>A &amp; B</h1></header><p>one <b>t</b>wo<br>three\n four'
                '<p>f&uuml;nf<div class="comments">x</div><form>y</form></article><footer>&copy;</footer>')
    assert " ".join(H.blocks(html)[0]) == "A & B one two three four fünf"


def test_unique_runs_of_a_host(spark):
    menu = " ".join(f"m{i}" for i in range(9))
    rows = [(i, f"http://h.example/{i}", page(f"<div>{menu}</div><div>n{i} text of this page p{i} here</div>")) for i in range(5)]
    rows += [(9, "http://other.example/", page(f"<div>{menu}</div>")), (10, None, None), (11, "http://h.example/x", "")]
    for chunk in (1 << 20, 64):
        df = spark.createDataFrame([(i, u, h, "x", None) for i, u, h in rows], SCHEMA)
        keys = H._key(df, "page_id", "url", "html")
        spans = H.boilerplate(H._streams(df, keys, "url", "html"), 6, chunk)
        assert spans.count() == 5
    got = texts(spark, rows)
    assert got[3][0] == "n3 text of this page p3 here"
    assert got[9][0] == menu
    assert got[10] == ("", 0) and got[11] == ("", 0)


def test_repeated_rows_and_empty_table(spark):
    row = (1, "http://h.example/", page("<div>some words that only this page has in it</div>"))
    df = spark.createDataFrame([(*row, "x", None)] * 3, SCHEMA)
    assert [r["text"] for r in H.main_text(df).collect()] == ["some words that only this page has in it"] * 3
    assert H.main_text(spark.createDataFrame([], SCHEMA)).collect() == []


def test_windows_equal_brute_force():
    import random

    rnd = random.Random(2)
    streams = ["".join(rnd.choice(["a ", "b ", "cc "]) for _ in range(rnd.randrange(0, 30))).encode() for _ in range(20)]
    page_, begin, end, content = H.repeated_windows(streams, 3)
    data = b"".join(streams)
    cut = [data[s:e] for s, e in zip(begin, end, strict=True)]
    want = [b"".join(t + b" " for t in s.split()[i:i + 3]) for s in streams for i in range(len(s.split()) - 2)]
    assert cut == want
    assert len({(c, t) for c, t in zip(content.tolist(), cut, strict=True)}) == len(set(cut)) == len(set(content.tolist()))


def test_phrases_and_near_copies_are_no_boilerplate(spark):
    import random

    rnd = random.Random(5)
    say = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    menu, phrase, paras = say(9), "as far as we know today it", [say(60) for _ in range(4)]
    own = [f"{say(20)} {phrase} {say(20)}" for _ in range(8)]
    rows = [(i, f"http://h.example/{i}", page(f"<div>{menu}</div><p>{own[i]}</p>")) for i in range(8)]
    copies = [[*paras[:3], paras[3] + x] for x in (" one", " two")]
    rows += [(20 + i, f"http://h.example/c{i}", page(f"<div>{menu}</div>" + "".join(f"<p>{x}</p>" for x in c))) for i, c in enumerate(copies)]
    got = texts(spark, rows)
    assert [got[i][0] for i in range(8)] == own
    assert [got[20 + i][0] for i in range(2)] == [" ".join(c) for c in copies]


def test_container_is_judged_and_dropped_bodies_have_text(spark):
    advert = "buy the new thing today at half the price"
    rows = [(i, f"http://h.example/{i}", page(f"<main><div>{advert}</div><p>text number {i} of page n{i} stays here</p></main>")) for i in range(5)]
    rows += [(10, "http://f.example/", page('<form><article><p>text in a form</p></article><p>more</p></form>')),
             (11, "http://g.example/", page("<div class='side wide'><article><p>text in a side</p></article></div>"))]
    rows += [(20 + i, f"http://k.example/{i}", page(f"<article><p>one article that is copied on five pages of a host</p></article><p>x{i}</p>")) for i in range(5)]
    got = {i: t for i, (t, _) in texts(spark, rows).items()}
    assert [got[i] for i in range(5)] == [f"text number {i} of page n{i} stays here" for i in range(5)]
    assert got[10] == "text in a form" and got[11] == "text in a side"
    assert {got[20 + i] for i in range(5)} == {"one article that is copied on five pages of a host"}


def test_quotes_in_tags():
    assert H.blocks("<p class=a'b>Hello world</p><p title='x>y' a\"b=\"c>d\">z")[1] == ["Hello world", "z"]
    assert H.blocks('<article><p title="a>text here</p><p>b</p></article>')[0] == ["text here", "b"]
    assert H.blocks("<p>a</p><p>1 < 2 and b<3</p><p class='x")[1] == ["a", "1 < 2 and b<3"]
    assert H.blocks("<div data-id='nav' title='class=nav'>kept</div><div CLASS = nav>gone</div>")[1:] == (["kept"], ["gone"])


def test_parts_that_are_and_are_no_article_text():
    got = H.blocks("<article><p>a</p><section class='search results'><p>found</p></section><div class='share-price'>12</div>"
                   "<div class=share-buttons>x</div><div class='page-notice'>n</div><div style='color:red; display:none'>no</div><p hidden>h</p></article>")
    assert got[0] == ["a", "found", "12"] and not got[1]
    assert H.blocks("<div class=search>find</div><div>text</div>")[1:] == (["text"], ["find"])


def test_time_is_linear_in_broken_pages():
    import time

    for part in ("<div>", "</p><div>", "<form><article>", "<span hidden>", "<a ", '<a href="', "<div class='a\" ", "<p", "</form><form><main>"):
        start = time.time()
        H.blocks(part * 40_000)
        assert time.time() - start < 2, part


def test_paragraph_that_two_pages_quote_stays(spark):
    quote = "a paragraph of several words that two articles quote in full"
    rows = [(i, f"http://h.example/{i}", page("<article>" + "".join(f"<p>own text {i} x{i * 7 + j} y{i * 11 + j} of the page</p>" for j in range(9))
                                              + (f"<p>{quote}</p>" if i in (2, 5) else "") + "</article>")) for i in range(10)]
    got = texts(spark, rows)
    assert [quote in got[i][0] for i in range(10)] == [i in (2, 5) for i in range(10)]
