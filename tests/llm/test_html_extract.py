"""Main texts of made sites whose articles are known, alignment of streams, and odd pages."""

import random
import re

import pytest

from binloom.llm.html_extract import aligned, as_text, extract_text, host_wrappers, reduced
from binloom.llm.html_pages import parsed

PAGES = "page_id long, url string, html string"


def texts(spark, rows):
    got = extract_text(spark.createDataFrame(rows, PAGES)).collect()
    assert all(r.n_chars == len(r.text) for r in got)
    return {r.page_id: r.text for r in got}


def one(page):
    """The blocks that a page alone has."""
    return [b.text for b in parsed(page, {})]


def shown(cells):
    return as_text(cells, {})


def test_streams():
    assert shown(reduced(tuple("abc"))) == "a b c"
    assert shown(reduced(tuple("appppb"))) == "a (p)+ b"
    assert shown(reduced(tuple("dtdtdt"))) == "(d t)+"
    assert shown(reduced(tuple("hpphpuh"))) == "(h p? u?)+"
    assert reduced(()) == []


def test_alignment():
    def of(*streams):
        cells = reduced(tuple(streams[0]))
        for s in streams[1:]:
            cells = aligned(cells, reduced(tuple(s)))
        return shown(cells)

    assert of("abc", "abc") == "a b c"
    assert of("abc", "ac", "abxc") == "a (b)? (x)? c"
    assert of("abc", "abbbc") == "a (b)+ c"
    assert of("abc", "acb") == "a (b c)+"
    assert of("abc", "cba") == "(a b c)+"
    assert of("ab", "xy") in ("(a)? (b)? (x)? (y)?", "(x)? (y)? (a)? (b)?")
    assert of("ahpf", "ahphpf", "ahf") == "a (h p?)+ f"


@pytest.mark.parametrize("seed", range(30))
def test_alignment_matches_both(seed):
    """Any stream that was aligned is matched by the outcome, in any order of alignment."""
    rng = random.Random(seed)
    streams = ["".join(rng.choice("abcdef"[: rng.randint(2, 6)]) for _ in range(rng.randint(0, 7))) for _ in range(6)]
    for _ in range(4):
        rng.shuffle(streams)
        cells = reduced(tuple(streams[0]))
        for s in streams[1:]:
            cells = aligned(cells, reduced(tuple(s)))
        keys = [k for _, _, inner in cells for k, _ in inner]
        assert len(keys) == len(set(keys)) == len(set("".join(streams)))
        groups = re.compile("".join("(?:" + "|".join(k for k, _ in inner) + ")" + ("*" if r else "?") for r, o, inner in cells))
        assert all(groups.fullmatch(s) for s in streams)


def test_markup():
    assert one("<p>a &amp; b&nbsp;&#x41;<br>c <b>d</b>e<p>f</p>g") == ["a & b A c de", "f", "g"]
    assert one("<div><script>var x='</p>'</script><style>p{}</style><!-- <p>no</p> --><p>yes</p></div>") == ["yes"]
    assert one("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == ["a", "b", "c", "d"]
    assert one("<nav>menu</nav><aside>side</aside><form>q <input></form><footer>f</footer><header>h</header><p>text") == ["text"]
    assert one('<div class="cookie-notice">x</div><div id="adBox">y</div><div class="reader comments">z</div><div class="page with-sidebar">text</div>') == ["text"]
    assert one("<article><header><h1>Title</h1></header><p>text</p><footer>by</footer></article>") == ["Title", "text"]
    assert one("<p>1 < 2 & 3 > 2</p><a title='x>y'>link</a>") == ["1 < 2 & 3 > 2", "link"]
    assert one('<p>one <span class="ad">buy</span> two</p>') == ["one", "two"]
    assert one("") == one("<!-- open <p>x") == one("<script>never closed <p>x") == []


def site(rng, kind, k):
    """A page of a made site and its article."""
    words = lambda n: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(n))
    title, paras = words(5), [words(rng.randint(15, 60)) for _ in range(rng.randint(1, 6))]
    body = "".join(f"<p>{p}</p>" for p in paras)
    comments = "".join(f'<div class="comment">{words(20)}</div>' for _ in range(rng.randint(0, 4)))
    menu = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in ("Home", "News", "About"))
    if kind == "article":
        page = f"<header>Site</header><nav><ul>{menu}</ul></nav><main><article><h1>{title}</h1>{body}<aside>{words(9)}</aside></article><section id='comments'>{comments}</section></main><footer>{words(4)}</footer>"
    elif kind == "named":
        page = f"<div id='header'>Site</div><div class='menu'>{menu}</div><div class='post-content'><h2>{title}</h2>{body}</div><div class='sidebar'>{words(30)}</div><div class='comments'>{comments}</div>"
    else:  # nothing names the article
        page = f"<div class='a1 top'><ul>{menu}</ul></div><table><tr><td><p>Welcome to our site, the best of all sites</p></td><td class='x'><h2>{title}</h2>{body}</td></tr></table><div class='b'>All rights reserved by us</div>"
    return f"<html><head><title>{title}</title></head><body>{page}</body></html>", " ".join([title, *paras])


def test_sites(spark):
    rng, rows, want = random.Random(5), [], {}
    for h, kind in enumerate(["article", "named", "plain"]):
        for k in range(12):
            i = 100 * h + k
            page, want[i] = site(rng, kind, k)
            rows.append((i, f"https://host{h}.example.com/{k}", page))
    rows += [(900, rows[0][1], rows[0][2]), (901, rows[0][1], rows[0][2])]  # repeated pages change nothing
    want[900] = want[901] = want[0]
    assert texts(spark, rows) == want


def test_mixed_site(spark):
    """A host with two templates, and one with a single page."""
    rng, rows, want = random.Random(6), [], {}
    for i in range(16):
        page, want[i] = site(rng, ["article", "plain"][i % 2], i)
        rows.append((i, f"http://u@MIXED.example.com:80/{i}", page))
    page, want[50] = site(rng, "article", 0)
    rows.append((50, None, page))
    assert texts(spark, rows) == want


def test_odd_pages(spark):
    deep = "<div>" * 5000 + "<p>deep</p>" + "</div>" * 5000
    long = "<article>" + "".join(f"<p>para{k}</p>" for k in range(60_000)) + "</article>"
    rows = [(1, None, None), (2, "", ""), (3, "http://a/", deep), (4, "http://b/", long), (5, "http://c/", "<a " * 200_000), (None, "http://d/", "<article>x</article>"), (7, "http://e/", "   \n ")]
    got = texts(spark, rows)
    assert got == {1: "", 2: "", 3: "deep", 4: " ".join(f"para{k}" for k in range(60_000)), 5: ("<a " * 200_000).strip(), None: "x", 7: ""}


def test_empty_and_clashing(spark):
    assert extract_text(spark.createDataFrame([], PAGES)).count() == 0
    rows = [(1, "http://a/", "<article>x</article>", 1, 2, "t", 3, [1])]
    got = extract_text(spark.createDataFrame(rows, f"{PAGES}, host int, slots int, text string, level int, blocks array<int>")).collect()
    assert [tuple(r) for r in got] == [(1, "http://a/", "x", 1)]


def test_wrappers(spark):
    pages = [(k, "http://a/", "<ul>" + "<li>x</li>" * k + "</ul>" + "<p>y</p>" * (k % 2)) for k in range(1, 5)]
    got = {r.wrapper for r in host_wrappers(spark.createDataFrame(pages, PAGES)).collect()}
    assert got == {"#", "(li)+", "ul (p)?"}
