from __future__ import annotations

from folioworks.operators.readable import readable

PAGE = """<html><head><title>Why It Works | Some Site</title><meta name="author" content="A. Writer"></head><body>
<nav><a href="/">Home</a></nav><header class="site-header">Menu</header>
<article><h1>Why It Works</h1><p>The first paragraph is long enough, it has commas, and it says something of <b>weight</b>.
<p>The second one has a <a href="/x">link</a>, as well as more than twenty characters.</p><ul><li>one<li>two</ul>
<blockquote><p>A quote of some length stands here.</p></blockquote><table><tr><th>k</th></tr><tr><td>v</td></tr></table></article>
<div class="sidebar"><p>Popular posts, many of them, all of them very long and with links.</p></div><footer>Copyright</footer></body></html>"""


def test_article():
    r = readable(PAGE)
    assert (r["title"], r["author"]) == ("Why It Works", "A. Writer")
    assert r["markdown"].startswith("# Why It Works\n\nThe first paragraph is long enough, it has commas, and it says something of **weight**.\n\nThe second one has a [link](/x)")
    assert "- one\n- two" in r["markdown"] and "> A quote of some length stands here." in r["markdown"] and "| k |\n| --- |\n| v |" in r["markdown"]
    assert "Copyright" not in r["markdown"] and "Popular" not in r["markdown"] and "Home" not in r["markdown"]


def test_odd_pages():
    assert readable("")["markdown"] == ""
    assert readable("plain text only")["markdown"] == "plain text only"
    assert readable("<p>a<p>b</x></p></div>")["markdown"].split() == ["a", "b"]
    assert readable("<div>" * 3000 + "deep")["markdown"].strip() == "deep"
