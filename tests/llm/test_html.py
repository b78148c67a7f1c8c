from helpers import prose
from tidemark.llm import html_text as ht

PAGES = "page_id bigint, url string, html string, host string, text int"


def article(i):
    return (
        f'<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>var a="</p>";</script></head><body class="has-sidebar">'
        f'<header>Site</header><nav><ul><li><a href="/a">Menu {i}</a></ul></nav><!-- ad --><div class="ad">Buy {i}</div>'
        f'<article><header><h1>Head &amp; {i}</h1></header><p><b>One\n  two {i}<br><p>Three&nbsp;<i>fo</i>ur &lt;x&gt; 1 < 2</p>'
        f'<aside>See also</aside><form><p>Sign up</p></form><ul><li>a<li>b</ul></article>'
        f'<section id="comments"><article class="comment"><p>Nice {i}</p></article></section><div class="cookie-notice">We use</div>'
        f"<footer>&copy; h{i}</footer>"
    )


def plain(i, host):
    return (
        f"<html><body><div>Welcome to {host}</div><div><a href=x>Home</a> <a href=y>News</a></div>"
        f"<div><h2>{prose(i, 4)}</h2><p>{prose(i, 30)}</p><p>{prose(i + 1, 20)}</p></div><div>All rights kept by {host}</div></body></html>"
    )


def texts(spark, rows):
    pages = spark.createDataFrame([(*row, "h", 1) for row in rows], PAGES)
    found = ht.extract(pages).collect()
    assert len(found) == len(rows)
    assert all(row["n_chars"] == len(row["text"]) for row in found)
    return {(row["page_id"], row["url"]): row["text"] for row in found}


def test_article_without_its_surroundings(spark):
    rows = [(i, f"http://a.example/{i}", article(i)) for i in range(8)]
    found = texts(spark, rows)
    for i in range(8):
        assert found[i, f"http://a.example/{i}"] == f"Head & {i}\nOne two {i}\nThree four <x> 1 < 2\na\nb"


def test_constant_nodes_of_a_host_are_template(spark):
    rows = [(i, f"https://u@B.example:80/{i}", plain(i, "B")) for i in range(12)]
    found = texts(spark, rows)
    for i in range(12):
        assert found[i, rows[i][1]] == f"{prose(i, 4)}\n{prose(i, 30)}\n{prose(i + 1, 20)}"
    # One page of a host has nothing to be compared with.
    assert "Welcome to C" in texts(spark, [(1, "http://c.example/", plain(1, "C"))])[1, "http://c.example/"]


def test_an_article_that_all_pages_share_is_kept(spark):
    rows = [(i, f"http://a.example/{i}", article(1)) for i in range(9)]
    assert set(texts(spark, rows).values()) == {"Head & 1\nOne two 1\nThree four <x> 1 < 2\na\nb"}


def test_edges(spark):
    rows = [
        (1, None, article(1)), (2, "u", None), (3, "u", ""), (4, "u", "no markup & all"), (5, "u", "<p>open <b>bold"),
        (6, "u", "<!-- never closed <p>x"), (7, "u", "<script>never closed <p>x"), (None, "u", "<p>a</p></div></p><p>b"),
        (8, "u", "<div hidden>h</div><p style='display: none'>n</p><p>&#x41;&#66;&unknown;</p>"), (9, "u", "<" * 500 + "x"),
        (10, "u", "<div>" * 3000 + "deep"), (11, "u", "<p>" + "w " * 200_000),
    ]
    found = texts(spark, rows)
    assert found[1, None].startswith("Head & 1")
    assert found[2, "u"] == found[3, "u"] == found[6, "u"] == found[7, "u"] == ""
    assert found[4, "u"] == "no markup & all"
    assert found[5, "u"] == "open bold"
    assert found[None, "u"] == "a\nb"
    assert found[8, "u"] == "AB&unknown;"
    assert found[10, "u"] == "deep"
    assert len(found[11, "u"]) == 399_999
    assert ht.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_deep_and_broken_pages_of_one_host(spark):
    rows = [(i, f"http://d.example/{i}", "<div>" * 3000 + f"deep {i}" + "</div>" * (1500 + i)) for i in range(6)]
    rows += [(50, "http://d.example/x", "<a " * 30_000 + "end"), (51, "http://d.example/y", "<b>" * 5000 + "</i>" * 5000 + "y")]
    found = texts(spark, rows)
    assert all(found[i, rows[i][1]] == f"deep {i}" for i in range(6))
    assert found[50, "http://d.example/x"].endswith("end") and found[51, "http://d.example/y"] == "y"


def test_wrappers_do_not_depend_on_the_order_of_pages():
    pages = [ht.skeleton(ht.page_tree(plain(i, "B"))[0]) for i in range(10)]
    one, two = pages[0], ht.skeleton(ht.page_tree(plain(9, "B"))[0])
    for page in pages[1:]:
        ht.merge(one, page)
    for i in range(8, -1, -1):
        ht.merge(two, ht.skeleton(ht.page_tree(plain(i, "B"))[0]))
    assert one.pages == two.pages == 10
    assert ht.matched(one, two) == ht.matched(one, one) == ht.matched(two, two)


def test_a_constant_text_among_many_neighbours_is_template(spark):
    for host, each in (("few", 31), ("many", 150)):
        wanted = {i: [f"{prose(i * each + k, 6)} {i} {k}" for k in range(each)] for i in range(60)}
        rows = [
            (i, f"http://{host}.example/{i}", "<body><div>" + "".join(f"<p>{text}</p>" for text in ["Read in our app", *own]) + "</div></body>")
            for i, own in wanted.items()
        ]
        found = texts(spark, rows)
        assert all(found[i, f"http://{host}.example/{i}"] == "\n".join(own) for i, own in wanted.items())


def test_a_text_just_above_the_share_is_template(spark):
    for share, left in ((82, 18), (78, 100)):
        rows = [(i, "http://s.example/", f"<div>{'Same' if i < share else f'Own {i}'}</div><p>{prose(i, 9)} {i}</p>") for i in range(100)]
        found = texts(spark, [(i, f"{url}{i}", page) for i, url, page in rows])
        assert sum(1 for text in found.values() if "\n" in text) == left
