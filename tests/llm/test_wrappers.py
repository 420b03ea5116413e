import random

from tessera.llm import wrappers

SHELL = """<!DOCTYPE html><html><head><title>t &amp; t</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<header class="site"><h2>Site name</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="c1"><div class="x9">Read this first.</div>{body}</div><aside>More &raquo;</aside><div class="comments"><article><p>first!</p></article></div>
<form><p>Search</p></form><div class="ad">Buy {n}</div><footer>&copy; me</footer></body></html>"""


def page(n, body):
    return SHELL.format(n=n, body=body)


def test_article_text_blocks_and_references():
    html = "<body><nav>menu</nav><article><h1>A&amp;B</h1><p><b>One<br><p>two\n  words &eacute;&nbsp;x<ul><li>i<li>j</ul><blockquote>q <i>r</i></blockquote><div class='ad'>no</div></article><footer>f"
    text = "\n".join(x.text for x in wrappers.content(wrappers.parse(html)))
    assert text == "A&B\nOne\ntwo words é x\ni\nj\nq r"


def test_names_of_layout_are_no_roles():
    html = "<body class='has-sidebar'><div class='layout with-sidebar no-ads'><div id='page'><article>kept</article></div><div class='sidebar'>gone</div><div class='blog-sidebar'>gone</div></div>"
    assert [x.text for x in wrappers.content(wrappers.parse(html))] == ["kept"]
    plain = "<div class='header-wrapper'><div class='site-header'>gone</div></div><div>one</div><div class='share'>gone</div><ul><li><a href=x>menu</a></ul><div>two <a href=y>link</a> and words</div>"
    assert [x.text for x in wrappers.content(wrappers.parse(plain))] == ["one", "two link and words"]


def test_broken_pages_do_not_crash():
    for html in (None, "", "plain", "<", "<p", "<!-- open", "<script>never closed", "<article><p>cut sho", "</p></div>text", "<p a='<b>' b>x", "<a><p>" * 3000):
        wrappers.content(wrappers.parse(html))
    assert [x.text for x in wrappers.content(wrappers.parse("<article><p>cut sho"))] == ["cut sho"]


def test_wrapper_drops_what_all_pages_of_a_host_share(spark):
    rows = [(i, f"http://h.example/{i}", page(i, f"<div>Story {i} begins</div><div>and goes on {i * 7}</div>")) for i in range(12)]
    rows += [(100, "http://other.example/", page(1, "<div>alone</div>")), (101, None, "<p>no url</p>"), (102, "http://h.example/n", None), (None, "http://h.example/x", "<article>null id</article>")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, n_chars int")
    got = {r["page_id"]: r["text"] for r in wrappers.extract_text(df).collect()}
    assert got[3] == "Story 3 begins\nand goes on 21"
    assert got[100] == "Read this first.\nalone" and got[101] == "no url" and got[102] == "" and got[None] == "null id"
    assert wrappers.extract_text(df.limit(0)).count() == 0


def brute_value(x, y):
    """Simple tree matching as it is defined, by recursion over all pairs of children."""
    if (x.tag, x.name) != (y.tag, y.name):
        return 0
    grid = [[0] * (len(y.kids) + 1)]
    for a in x.kids:
        row = [0]
        for j, b in enumerate(y.kids):
            row.append(max(grid[-1][j + 1], row[j], grid[-1][j] + brute_value(a, b)))
        grid.append(row)
    return 1 + grid[-1][-1]


def random_tree(rng, depth=0):
    node = wrappers.Node(rng.choice("ab"), rng.choice(["", "x"]) if depth < 2 else "")
    node.kids = [random_tree(rng, depth + 1) for _ in range(rng.randint(0, 4 - depth))] if depth < 4 else []
    return node


def test_alignment_is_the_best_ordered_matching():
    rng = random.Random(4)
    for _ in range(300):
        a, b = random_tree(rng), random_tree(rng)
        b.tag, b.name = a.tag, a.name
        order = [wrappers._number(t) for t in (a, b)]
        pairs = wrappers.Matching().pairs(a, b)
        assert len(pairs) == brute_value(a, b)
        up = [{id(k): n.slot for n in o for k in n.kids} for o in order]
        seen = sorted((x.slot, y.slot) for x, y in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(seen, seen[1:], strict=False))
        for x, y in pairs[1:]:
            assert (x.tag, x.name) == (y.tag, y.name) and (up[0][id(x)], up[1][id(y)]) in seen


def test_deep_and_long_pages(spark):
    deep = lambda tail: "<div>" * 2000 + f"<p>{tail}</p><i>x</i>"
    long = lambda k: "<div>" + "".join(f"<{'h2' if (i * k) % 7 < 3 else 'section'}>{i}</section></h2>" for i in range(1500)) + "</div>"
    rows = [(1, "http://d.example/1", deep("one")), (2, "http://d.example/2", deep("two</p><ul><li>more</ul><p>end")), (3, "http://e.example/3", long(2)), (4, "http://e.example/4", long(3))]
    got = {r["page_id"]: r["text"] for r in wrappers.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "one\nx" and got[2] == "two\nmore\nend\nx"
    assert got[3] == got[4] == "\n".join(map(str, range(1500)))


def test_a_site_whose_template_no_name_tells(spark):
    body = lambda i: "".join(f"<div class='b{j}'>Part {j} of story {i}</div>" for j in range(1 + i % 4))
    html = lambda i: f"<div class='q1'>The Daily Page</div><div class='q2'><div>{body(i)}</div><div class='q3'>Sent from our town</div></div><div class='q4'>All rights kept</div>"
    rows = [(i, f"http://plain.example/{i}", html(i)) for i in range(20)] + [(50 + i, "http://small.example/", html(i)) for i in range(2)]
    got = {r["page_id"]: r["text"] for r in wrappers.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "\n".join(f"Part {j} of story {i}" for j in range(1 + i % 4)) for i in range(20))
    assert got[50].startswith("The Daily Page\n")


def test_main_nodes_are_chosen_by_the_host(spark):
    teaser = "<div><article>Teaser</article></div>"
    rows = [(i, f"http://t.example/{i}", teaser + f"<div>A long story number {i} that no element calls an article</div>") for i in range(5)]
    rows += [(10 + i, f"http://a.example/{i}", f"<p>lead {i}</p><article><p>Story {i} with enough words</p></article>") for i in range(5)]
    got = {r["page_id"]: r["text"] for r in wrappers.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[10] == "Story 0 with enough words"


def test_names_of_topics_and_linked_words_stay():
    html = "<article><div class='legal-analysis'>one</div><section class='promotion-history'>two</section><div class='comment-list'>gone</div><div class='related-links'>gone</div></article>"
    assert [x.text for x in wrappers.content(wrappers.parse(html))] == ["one", "two"]
    html = "<div class='post-content'><p>I saw <a>a long linked sentence</a></p><p>tail</p></div>"
    assert [x.text for x in wrappers.content(wrappers.parse(html))] == ["I saw a long linked sentence", "tail"]


def texts_of(spark, rows):
    return {r["page_id"]: r["text"] for r in wrappers.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_sections_of_an_article_stay_whatever_their_names(spark):
    body = lambda i: f"<article><p>Story {i}</p><section class='discussion'>We discuss {i}</section><section class='alert-box'>Mind {i}</section><div class='adsbygoogle'>buy {i}</div><div class='comments'>first {i}</div></article>"
    rows = [(i, f"http://s.example/{i}", body(i)) for i in range(12)] + [(100, "http://one.example/", body(100))]
    got = texts_of(spark, rows)
    assert all(got[i] == f"Story {i}\nWe discuss {i}\nMind {i}" for i in (*range(12), 100))
    same = [(i, f"http://n.example/{i}", f"<article><p>Story {i}</p><div class='notice'>Please be kind</div></article>") for i in range(30)]
    assert texts_of(spark, same)[3] == "Story 3"


def test_few_pages_of_a_host_tell_its_template(spark):
    html = lambda i: f"<div class='q1'>The Daily Page</div><div class='q2'>text {i} is unique</div><div class='q4'>(c) Corp</div>"
    for n in (2, 3, 6):
        got = texts_of(spark, [(i, f"http://few{n}.example/{i}", html(i)) for i in range(n)])
        want = "text 0 is unique" if n > 3 else "The Daily Page\ntext 0 is unique\n(c) Corp"
        assert got[0] == want
    rows = [(i, f"http://art.example/{i}", f"<article><p>The same lead</p><p>Story {i}</p></article>") for i in range(6)]
    assert texts_of(spark, rows)[0] == "The same lead\nStory 0"


def expected(roles, i, marked):
    """A page of a site with a part for each role, and its main text; ``marked`` says whether names tell the roles."""
    name = lambda role, k: f" class='{role if marked else f'z{k}'}'"
    parts, text = [], []
    for k, role in enumerate(roles):
        if role == "text":
            lines = [f"Line {j} of page {i} in part {k}" for j in range(1 + (i * 7 + k) % 3)]
            text += lines
            parts.append(f"<div class='b{k}'>" + "".join(f"<p>{x}</p>" for x in lines) + "</div>")
        else:
            parts.append(f"<div{name(role, k)}>Words of the {role} {k}</div>")
    return "<body>" + "".join(parts) + "</body>", "\n".join(text)


def test_made_up_sites_of_all_sizes(spark):
    rng = random.Random(8)
    rows, want, changed = [], {}, 0
    for site in range(30):
        roles = [rng.choice(["menu", "footer", "sidebar", "text", "newsletter"]) for _ in range(rng.randint(2, 6))] + ["text"]
        marked, n = site % 2 == 0, rng.choice([4, 5, 7, 12, 25])
        for i in range(n):
            key = site * 100 + i
            html, want[key] = expected(roles, i, marked)
            rows.append((key, f"http://site{site}.example/{i}", html))
            changed += "\n".join(x.text for x in wrappers.content(wrappers.parse(html))) != want[key]
    got = texts_of(spark, rows)
    assert got == want and changed > 50
