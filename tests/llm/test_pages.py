import pytest

from foliant.llm.pages import extract, extract_pages

LOREM = "This is a sentence of the article, with commas, and a full stop. Here is another one; it goes on."

CASES = {
    "plain": (f"<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><article><h1>Head</h1><p>{LOREM}</p><p>Short.</p></article><footer>Foot, note.</footer></body></html>", f"Head\n{LOREM}\nShort."),
    "no article element": (f"<body><div id='top-menu'><ul><li><a>a</a><li><a>b</a></ul></div><div class=wrap><div class='post'><h2>Head</h2><p>{LOREM}<p>{LOREM}</div><div class='sidebar'><p>{LOREM}</p></div></div>", f"Head\n{LOREM}\n{LOREM}"),
    "comments, forms and notices": (f"<main><div class='cookie-notice'>We use cookies, always.</div><p>{LOREM}</p><form><p>Name, please: <input></p></form><section id=comments><h3>2 comments</h3><p>{LOREM}</p></section></main>", LOREM),
    "references and white space": ("<article><p>a &amp; b&nbsp;&#233;&lt;c&gt;\n\t d <b>bo</b>ld<br>next &copy; &#x41;</p></article>", "a & b é<c> d bold next © A"),
    "scripts and comments": (f"<article><script>var t='</p><p>no';</script><p>{LOREM}</p><!-- <p>gone</p> --><style>p{{x:y}}</style><noscript><p>js off</p></noscript></article>", LOREM),
    "inline menus and adverts": (f"<article><p>{LOREM}</p><div class='ad-slot'>Buy now, cheap!</div><ul><li><a>one</a></li><li><a>two</a></li><li><a>three</a></li></ul><ul><li>first point</li><li>second point</li></ul><aside>aside</aside></article>", f"{LOREM}\nfirst point\nsecond point"),
    "cut off": (f"<article><p>{LOREM}</p><p>Half a sen", f"{LOREM}\nHalf a sen"),
    "cut in a tag": (f"<article><p>{LOREM}</p><p cla", LOREM),
    "table": (f"<article><p>{LOREM}</p><table><tr><td>a</td><td>b</td></tr><tr><th>c<td>d</table></article>", f"{LOREM}\na b\nc d"),
    "header of the article": (f"<header>Site</header><article><header><h1>Head</h1><span>share</span></header><p>{LOREM}</p></article>", f"Head\n{LOREM}"),
    "layout classes": (f"<body class='has-sidebar'><div class='layout with-sidebar'><main><h1>Head</h1><p>{LOREM}</p></main><div class='sidebar'><p>{LOREM}</p></div></div>", f"Head\n{LOREM}"),
    "layout around a title": (f"<div id='content-sidebar-wrap'><div class='text'><h1>Head</h1><p>{LOREM}</p><p>{LOREM}</p></div><div class='widget'><p>{LOREM}</p></div></div>", f"Head\n{LOREM}\n{LOREM}"),
    "site header with a title": (f"<div class='site-header'><h1>Site, of news.</h1></div><article><div class='entry-header'><h1>Head</h1><p>by me</p></div><p>{LOREM}</p></article>", f"Head\n{LOREM}"),
    "comments as articles": (f"<article><h1>Head</h1><p>{LOREM}</p></article><div class='comments'><article><p>{LOREM}</p></article></div>", f"Head\n{LOREM}"),
    "joined words": (f"<div class='story'><h1>Head</h1><p>{LOREM}</p><p>{LOREM}</p></div><ol class='commentlist'><li><p>{LOREM}</p></li></ol><div class='adbox'>{LOREM}</div>", f"Head\n{LOREM}\n{LOREM}"),
    "hidden": (f"<article><p>{LOREM}</p><p style='display: none'>x</p><p hidden>y</p></article>", LOREM),
    "nothing": ("", ""), "null": (None, ""), "text only": ("just text", "just text"), "menus only": ("<nav>a</nav><footer>b</footer>", ""), "stray": ("</div></p><<>> a < b", "<<>> a < b"),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    page, want = CASES[name]
    assert extract(page) == want


def test_selected_text_outside_the_largest_element_stays():
    page = f"<body><div class=intro><h1>Head</h1><p>{LOREM}</p></div><div class=story>{f'<p>{LOREM}</p>' * 20}</div><div class=footer>Foot, note.</div></body>"
    assert extract(page) == "\n".join(["Head"] + [LOREM] * 21)
    assert extract(page.replace("body>", "article>")) == extract(page)


def test_long_page():
    page = "<article>" + f"<p>{LOREM}</p>" * 20_000
    assert extract(page) == "\n".join([LOREM] * 20_000)
    assert extract("<div>" * 30_000 + LOREM) == LOREM


def test_frame(spark):
    rows = [(1, "u", CASES["plain"][0], "x"), (1, "u", CASES["plain"][0], "x"), (2, None, None, "y"), (None, "v", "", "z")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in extract_pages(frame).collect()), key=str)
    want = CASES["plain"][1]
    assert got == sorted([(1, "u", want, len(want))] * 2 + [(2, None, "", 0), (None, "v", "", 0)], key=str)
    assert extract_pages(frame.limit(0)).count() == 0


def test_paths_choose_where_classes_say_nothing():
    menu = "<ul class=k1>" + "".join(f"<li><a href=/{k}>Topic {k}</a></li>" for k in range(9)) + "</ul>"
    teasers = "".join(f"<div class=k2><span class=k3>Item {k}</span></div>" for k in range(9))
    page = f"<body><div class=k0>{menu}</div><div class=k4><h2>Head</h2>{f'<p>{LOREM}</p>' * 6}<p>Short.</p></div><div class=k5>{teasers}</div></body>"
    assert extract(page) == "\n".join(["Head"] + [LOREM] * 6 + ["Short."])


def test_a_class_is_a_prior_only():
    # the whole article under a class that names boilerplate: nothing else competes with it
    page = f"<body><div class=nav-wrap><div class=k4>{f'<p>{LOREM}</p>' * 6}</div></div><footer>Foot, note.</footer></body>"
    assert extract(page).count(LOREM) == 6


def test_path_ratios_equal_brute_force():
    from collections import defaultdict
    from html.parser import HTMLParser

    from foliant.llm.pages import parse, path_ratios

    page = f"<html><body><div><p>{LOREM}</p><p>One, <b>two.</b> three</p></div><div><ul><li>a, b</li><li><a>link; text</a></li></ul><p>Last!</p></div></body></html>"
    texts, stack = defaultdict(list), []

    class Plain(HTMLParser):
        def handle_starttag(self, tag, attrs):
            stack.append(tag)

        def handle_endtag(self, tag):
            stack.pop()

        def handle_data(self, text):
            texts["/".join(stack)].append((0 if "a" in stack else len("".join(text.split())), sum(c in ".,;:!?" for c in text)))

    Plain().feed(page)
    want = {path: tuple(sum(x[k] for x in t) / len(t) for k in (0, 1)) for path, t in texts.items()}
    _, nodes = parse(page)
    of, length, marks = path_ratios(nodes)
    for n, a, b in zip(nodes, length, marks, strict=True):
        path = "/".join([*(e.tag for e in reversed([*n.at.above()]) if e.tag), n.at.tag])
        assert (a, b) == want[path]
    assert len(set(of)) == len(want)
