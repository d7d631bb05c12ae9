import math
import random
import time
from html.parser import HTMLParser

from brackwater.llm import html

PAGE = """<html><head><title>t</title></head><body><div id="nav"><ul><li><a href="/">Home</a></li><li><a href="/b">Blog</a></li></ul></div>
<div id="main"><div class="post"><h1>A title here</h1><p>{p1}</p><p>{p2} <a href="x">a link</a> and more.</p><p>{p3}</p></div></div>
<div id="foot"><a href="/c">Contact</a> <a href="/d">Imprint</a></div></body></html>"""
TEXT = {f"p{k}": f"Paragraph {k} says a good deal about its subject, with commas, words and a full stop at the end of it. " * 3 for k in (1, 2, 3)}


class Tree(HTMLParser):
    """A second way to the same numbers: elements as nested lists, for well-formed pages."""

    def __init__(self):
        super().__init__()
        self.root = ["#root", [], 0, 0]
        self.stack, self.order = [self.root], [self.root]

    def handle_starttag(self, tag, attrs):
        node = [tag, [], 0, 0]
        self.stack[-1][1].append(node)
        self.order.append(node)
        self.stack.append(node)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        if any(n[0] in html.HIDDEN for n in self.stack):
            return
        size = len(data) - data.count(" ") if data.strip() else 0
        self.stack[-1][2] += size
        self.stack[-1][3] += size * any(n[0] == "a" for n in self.stack)


def counts(node):
    c, lc, t, lt = node[2], node[3], 0, 0
    for child in node[1]:
        a = counts(child)
        c, lc, t, lt = c + a[0], lc + a[1], t + a[2] + 1, lt + a[3] + (child[0] == "a")
    return c, lc, t, lt


def density(node, body):
    c, lc, t, lt = counts(node)
    if not c:
        return 0.0
    t, lt = max(1, t), max(1, lt)
    bc, blc, *_ = counts(body)
    value = math.log(c / max(1, lc) * t / lt)
    base = math.log(c / max(1, c - lc) * lc + blc / max(1, bc) * c + math.e)
    return max(0.0, c / t * (value / math.log(base) if base > 1.001 else value))


def test_densities_are_those_of_the_tree():
    page, tree = html.Page(PAGE.format(**TEXT)), Tree()
    tree.feed(PAGE.format(**TEXT))
    assert [n[0] for n in tree.order] == page.name
    body = next(n for n in tree.order if n[0] == "body")
    got, total, _ = page.densities()
    for k, node in enumerate(tree.order):
        assert math.isclose(got[k], density(node, body))
        assert math.isclose(total[k], sum(density(child, body) for child in node[1]))


def subtree(node):
    return [node] + [n for child in node[1] for n in subtree(child)]


def selected(tree):
    """The same choice on nested lists: for each element that reaches the threshold with all above it, the subtree of the highest sum."""
    body = next(n for n in tree.order if n[0] == "body")
    dense = {id(n): density(n, body) for n in tree.order}
    total = {id(n): sum(dense[id(c)] for c in n[1]) for n in tree.order}
    place = {id(n): k for k, n in enumerate(tree.order)}
    parent = {id(c): n for n in tree.order for c in n[1]}

    def best(node):
        return max(subtree(node), key=lambda n: (total[id(n)], -place[id(n)]))

    heart = best(body)
    if heart is body or not total[id(heart)]:
        return [place[id(body)]]
    way = [heart]
    while way[-1] is not body:
        way.append(parent[id(way[-1])])
    least = min(dense[id(n)] for n in way)
    wanted = {place[id(heart)]}

    def down(node):
        for child in node[1]:
            if dense[id(child)] >= least:
                wanted.add(place[id(best(child))])
                down(child)

    down(body)
    inside = {place[id(n)] for k in wanted for n in subtree(tree.order[k])[1:]}
    return sorted(wanted - inside)


def random_tree(d, depth=0):
    """Well-formed markup of blocks, links and text of many densities."""
    out = []
    for _ in range(d.randint(1, 4)):
        kind = d.random()
        if depth > 4 or kind < 0.3:
            out.append("w" * d.randint(1, 9) + " " + "word " * d.choice((0, 1, 5, 40)))
        elif kind < 0.45:
            out.append(f"<a>{'link ' * d.randint(1, 6)}</a>")
        else:
            name = d.choice(("div", "section", "span", "b"))
            out.append(f"<{name}>{random_tree(d, depth + 1)}</{name}>")
    return "".join(out)


def test_chosen_elements_are_those_of_the_tree():
    d = random.Random(17)
    pages = [f"<html><body>{random_tree(d)}</body></html>" for _ in range(300)]
    pages += [f"<html><body>{f'<div><div>{x}</div><div>{x}</div></div>' * 2}</body></html>" for x in (random_tree(d) for _ in range(40))]  # ties
    many = 0
    for page in pages:
        tree = Tree()
        tree.feed(page)
        chosen = html.Page(page).chosen()
        assert chosen == selected(tree), page
        many += len(chosen) > 1
    assert many > 20


def test_scripts_and_depth_take_time_in_proportion():
    pages = ["<body>" + "<script>var a = '<p>no</p>';</SCRIPT >" * 150_000 + "<p>yes</p>", "<body>" + "<script>var a;" * 400_000, "<div><span>" * 30_000 + "<p>deep</p></b>" * 30_000, "<b " * 300_000]
    for page in pages:
        began = time.process_time()
        html.Page(page).text()
        assert time.process_time() - began < 10


def test_content_without_navigation():
    text = html.Page(PAGE.format(**TEXT)).text()
    assert all(TEXT[p].strip() in text for p in TEXT) and "a link" in text
    assert "Home" not in text and "Imprint" not in text


def paragraphs(name, n):
    return [f"{name} paragraph {k} " + "has some words to say here. " * 18 for k in range(n)]


def marked(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def test_every_block_that_reaches_the_threshold_is_content():
    menu = '<div id="nav"><ul><li><a href="/">Home</a></li><li><a href="/b">Blog</a></li></ul></div>'
    for blocks, wrap in (([3, 3], "{}"), ([5, 5, 5], "{}"), ([8, 6], "<main>{}</main>"), ([8, 6], "<div><main>{}</main></div>")):
        texts = [paragraphs(f"block {b}", n) for b, n in enumerate(blocks)]
        inside = wrap.format("".join(f"<div>{marked(t)}</div>" for t in texts))
        page = html.Page(f"<html><body>{menu}{inside}</body></html>")
        assert page.text().split("\n") == [p.strip() for t in texts for p in t]
    # blocks at different depths, and one beside the path to the heart
    a, b, c = paragraphs("a", 6), paragraphs("b", 4), paragraphs("c", 3)
    page = html.Page(f"<body>{menu}<div><div><div>{marked(a)}</div></div></div><section>{marked(b)}</section><article><div>{marked(c)}</div></article></body>")
    assert page.text().split("\n") == [p.strip() for p in a + b + c]


def test_a_head_ends_without_its_end_tag():
    for page, want in (
        ("<html><head><title>t</title><body><p>x</p>", "x"),
        ("<!doctype html><html><head><meta charset=utf-8><title>t</title><style>p {}</style><body class=a><p>x<p>y</body></html>", "x\ny"),
        ("<head><title>t</title><p>x</p><p>y</p>", "x\ny"),
        ("<head><title>t</title>\n<link rel=a href=b>\n<script>var a = 1</script>\n plain words", "plain words"),
        ("<head><title>t</title><img src=a><div>x</div></head><body><p>y</p></body>", "x\ny"),
        ("<head><title>t</title><template><p>no</p></template><main><p>x</p></main>", "x"),
        ("<head><title>t</title><template><p>no</p><body><p>x</p>", "x"),
        ("<body><p>x</p><head><title>t</title><p>y</p></body>", "x\ny"),
        ("<html><head><title>t</title></head><body><p>x</p></body></html>", "x"),
    ):
        assert html.Page(page).text() == want, page


def test_odd_pages(spark):
    rows = [(1, None), (2, ""), (3, "plain words only"), (4, "<p>unclosed <b>bold <a href='x'>link"), (5, "<body></body>"), (None, "<p>x &amp; y</p>"), (6, "<div>" * 3000 + "deep"),
            (7, "<script>var a = '<p>no</p>';</script><p>yes, this</p>"), (8, "a < b <3 </nothing>"), (8, "a < b <3 </nothing>"), (9, "<p>" + "long text here. " * 50_000 + "</p>")]
    pages = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as chars")
    got = [(r.page_id, r.text, r.chars) for r in html.extract(pages).collect()]
    by = {i: t for i, t, _ in got}
    assert len(got) == len(rows) and by[1] is None and by[2] == "" and by[3] == "plain words only" and by[None] == "x & y"
    assert by[5] == "" and by[6] == "deep" and by[7] == "yes, this" and "unclosed bold" in by[4]
    assert all(c == (None if t is None else len(t)) for _, t, c in got)
    assert html.extract(pages.where("false")).count() == 0
