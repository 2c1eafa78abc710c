"""Main text: every kind of furniture, the density sum by brute force, deep pages, and the contract query."""

import math
import random
import time

import pytest

from waymark.llm import catalog
from waymark.llm.main_text import INLINE, _Node, densities, extract_main_text, main_text, parse

LONG = "This is a sentence of the article that is long enough to be dense. " * 4
BODY = f"<h1>The title</h1><p>{LONG}one</p><p>{LONG}two</p><ul><li>point</li></ul>"
TEXT = f"The title {LONG}one {LONG}two point"

FURNITURE = [
    "<nav><a href=/>Home</a> menu</nav>", "<header>Logo Site slogan</header>", "<footer>&copy; Foot</footer>", "<aside>Sidebar words</aside>",
    "<form>Your name <input><button>Send</button></form>", "<script>var x = '<p>no</p>'</script>", "<style>p{}</style>", "<noscript>Enable it</noscript>",
    "<div class='menu'><a href=1>One</a></div>", "<div id='sidebar'>Side words here</div>", "<div class='sidebar-content'>Side words here</div>",
    "<div class='cookie-notice'>We use cookies</div>", "<div class=\"ad\">Buy this now</div>", "<div class='advert-box'>Buy this now</div>", "<section class='newsletter'>Join us</section>",
    "<div role='navigation'>Go there</div>", "<div hidden>Unseen</div>", "<div style='display: none'>Unseen</div>", "<div class='post-footer'>Filed under x</div>",
    "<section id='comments'><p>Nice post, really nice post indeed, and long too.</p></section>", "<ol class='commentlist'><li>First! " + LONG + "</li></ol>",
    "<div class='comment-body'>" + LONG + "</div>", "<div class='comments post'>" + LONG + "</div>", "<article class='comment'>" + LONG + "</article>", "<div id='disqus_thread'>talk</div>",
]


@pytest.mark.parametrize("part", FURNITURE)
@pytest.mark.parametrize("frame", ["article", "main", "div", ""])
def test_each_kind_of_furniture_goes(part, frame):
    inner = f"<{frame}>{BODY}</{frame}>" if frame else BODY
    for page in (f"<body>{part}{inner}</body>", f"<body>{inner}{part}</body>", f"<body>{inner[:-1 - len(frame) - 2] if frame else inner}{part}{f'</{frame}>' if frame else ''}</body>"):
        assert main_text(page) == TEXT, page


def test_unmarked_links_and_lines_go_and_wrappers_stay():
    links = "<div><a href=1>First other page</a> <a href=2>Second other page</a></div>"
    assert main_text(f"<body>{links}<div><div>{BODY}</div></div><div>(c) 2020</div></body>") == TEXT
    assert main_text(f"<body><div class='has-sidebar page'><div class='menu-open'>{BODY}</div></div></body>") == TEXT
    assert main_text(f"<body><div class='content'>{BODY}</div></body></html><p>{LONG}three</p>") == f"{TEXT} {LONG}three"


def test_all_articles_stay():
    second = f"<article><h2>Second</h2><p>{LONG}again</p></article>"
    assert main_text(f"<body><nav>x</nav><article>{BODY}</article>{second}</body>") == f"{TEXT} Second {LONG}again"
    assert main_text(f"<body><main><section>{BODY}</section><section><h2>Second</h2><p>short one</p></section></main></body>") == f"{TEXT} Second short one"


def plain(node):
    """(characters, tags, link characters, link tags) by plain recursion."""
    chars = tags = links = link_tags = 0
    for part in node.parts:
        if isinstance(part, str):
            chars += sum(not c.isspace() for c in part)
        elif not part.dropped:
            c, t, lc, lt = plain(part)
            chars, tags, links, link_tags = chars + c, tags + t + 1, links + lc, link_tags + lt + (part.tag == "a")
    return chars, tags, chars if node.tag == "a" else links, link_tags


def plain_density(node, body):
    (c, t, lc, lt), (bc, _, blc, _) = plain(node), plain(body)
    if not c:
        return 0.0
    base = math.log(c / max(1, c - lc) * lc + blc / max(1, bc) * c + math.e)
    found = c / max(1, t) * math.log(max(1.0, c / max(1, lc) * max(1, t) / max(1, lt))) / math.log(max(base, 1 + 1e-9)) if base > 1 else 0.0
    return found or (c - lc) / max(1, t)


def test_density_sums_equal_brute_force():
    rng = random.Random(3)

    def tree(depth):
        out = "word " * rng.randrange(6)
        for _ in range(rng.randrange(4) if depth else 0):
            tag = rng.choice(["div", "p", "a", "b", "section", "ul"])
            out += f"<{tag}>{tree(depth - 1)}</{tag}>" + "tail " * rng.randrange(3)
        return out

    for _ in range(80):
        root = parse(f"<body>{tree(4)}</body>")
        body = next(p for p in root.parts if isinstance(p, _Node))
        for node in densities(body):
            assert math.isclose(node.density, plain_density(node, body), abs_tol=1e-9)
            want = sum(plain_density(p, body) for p in node.parts if isinstance(p, _Node) and not p.dropped and p.tag not in INLINE)
            assert math.isclose(node.total, want, abs_tol=1e-9)


def test_deep_and_long_pages():
    for page in ("<div>" * 100_000 + "deep words", "<b>" * 50_000 + "deep words", "</p></div>" * 100_000 + "deep words", "<p>deep words" * 1, "<i></b>" * 50_000 + "deep words"):
        began = time.monotonic()
        assert main_text(page) == "deep words"
        assert time.monotonic() - began < 4
    long = f"<body><article>{'<p>' + LONG + '</p>'}" + f"<p>{LONG}</p>" * 20_000 + "</article></body>"
    assert len(main_text(long)) == 20_001 * len(LONG) - 1


def test_empty_table_and_query(spark):
    pages = spark.createDataFrame([], "page_id long, html string, n_chars string")
    assert extract_main_text(pages).columns == ["page_id", "text", "n_chars"] and extract_main_text(pages).count() == 0
    rows = catalog.op6_main_text(spark, "/root/testdata/sf0.001").collect()
    html = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    assert {r.page_id for r in rows} == set(html) and all(r.n_chars == len(r.text) for r in rows)
    for r in rows:
        start = html[r.page_id].index("<article>")
        assert r.text and r.text == main_text("<body>" + html[r.page_id][start : html[r.page_id].index("</article>")] + "</article></body>")
