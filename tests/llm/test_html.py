"""Main text of pages made by hand and at random."""

import random
import re
from html.parser import HTMLParser

import pytest

from wavemill.llm import html_extract as H

BODY = ["The quick brown fox, it is said, jumps over the lazy dog.", "A second paragraph follows; it has more to tell, much more.", "And the third one ends it."]
NOISE = """<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News, today.</a></li></ul></nav>"""
FOOT = "<footer>&copy; host &middot; Some words, and a sentence.</footer>"


def page(inner, before=NOISE, after=FOOT):
    return f"<!DOCTYPE html><html><head><title>T, t.</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{before}{inner}{after}</body></html>"


PARAGRAPHS = "".join(f"<p>{p}</p>" for p in BODY)
WANT = " ".join(BODY)


@pytest.mark.parametrize(
    "inner",
    [
        f"<article>{PARAGRAPHS}</article>",
        f"<div class='ad'>Buy now, it is cheap. Really, buy.</div><article>{PARAGRAPHS}</article>",
        f"<div id=content>{PARAGRAPHS}</div><div class='sidebar'><p>Other, things. To read, here.</p></div>",
        f"<main>{PARAGRAPHS}</main><section class='comments'><p>First, I say! Nice, very nice post.</p></section>",
        "<div>" + "".join(f"<p>{p}" for p in BODY) + "</div><form><p>Name, please.</p><input></form>",
        f"<div class='cookie-notice'>We use cookies, yes.</div><div>{PARAGRAPHS}</div><aside><p>An aside, of words.</p></aside>",
        f"<article>{PARAGRAPHS}<noscript>No, script.</noscript><iframe>x</iframe><template><p>Hidden.</p></template></article>",
        f"<article>{PARAGRAPHS}<ul><li><a href=x>Link one here</a></li><li><a href=y>Link two here</a></li></ul></article>",
        f"<article>{PARAGRAPHS}<p style='display:none'>Not, shown.</p><!-- <p>gone</p> --></article>",
        f"<article><p>{BODY[0]}<p>{BODY[1]}<br></p>\n\t<p>  And the\nthird\tone <b>ends</b> it.</article>",
    ],
)
def test_pages(inner):
    assert H.main_text(page(inner)) == WANT


@pytest.mark.parametrize(
    "inner",
    [
        f"<div class='content-sidebar-wrap'><main>{PARAGRAPHS}</main></div>",
        f"<div class='has-sidebar'><article>{PARAGRAPHS}</article><div class='sidebar'><article class='card'><p>Teaser, here.</p></article></div></div>",
        f"<div id='page-header-wrap'>{PARAGRAPHS}</div>",
        f"<div id='page-header-wrap'><div class='site-nav'><p>Go, on.</p></div><div class='text'>{PARAGRAPHS}</div></div>",
        f"<div class='sidebar'>{PARAGRAPHS}</div>",
        f"<div>{PARAGRAPHS}</div><article class='card'><a href=x>A teaser, one.</a></article>",
        f"<article>{PARAGRAPHS}</article><section class='comment-list'>{'<p>Long, I say, is what I have to say here.</p>' * 20}</section>",
        f"<article>{PARAGRAPHS}</article><div class='related'><article class='card'><p>Other, things.</p></article></div>",
    ],
)
def test_wrappers_and_teasers(inner):
    assert H.main_text(page(inner)) == WANT


@pytest.mark.parametrize("head", ["<div class='entry-header'>{}</div>", "<header class='entry-header'>{}</header>"])
def test_headers_of_the_article(head):
    title = head.format("<h1>A Title</h1>")
    for inner in (f"<div class='entry-content'>{title}{PARAGRAPHS}</div>", f"<div class='hentry'>{title}<div class='entry-content'>{PARAGRAPHS}</div></div>"):
        assert H.main_text(page(inner)) == "A Title " + WANT


def test_text_beside_a_teaser_stays():
    got = H.main_text(page(f"<div>{PARAGRAPHS}</div><article class='card'><p>A teaser, one.</p></article>"))
    assert WANT in got


def test_headings_references_and_inline():
    got = H.main_text(page("<article><h1>Fish &amp; Chips</h1><p>caf&eacute; &lt;b&gt; &#39;x&#x27; a<i>b</i>c, &nbsp; d.</p><p><b>open <br><p>next &am</p></article>"))
    assert got == "Fish & Chips café <b> 'x' abc, d. open next &am"


def test_headings_without_article():
    got = H.main_text(page(f"<div><h1>A Title</h1>{PARAGRAPHS * 3}</div>"))
    assert got.startswith("A Title The quick")


@pytest.mark.parametrize("text", ["", "plain words, no tags", "<", "<p", "<p>x</p", "<!--", "</div></p><p>a, b.</p>", "<div " + "x" * 5000, "<p>" * 3000 + "deep, text.", "<script>never closed"])
def test_broken_pages(text):
    assert isinstance(H.main_text(text), str)
    if text == "plain words, no tags":
        assert H.main_text(text) == text


@pytest.mark.parametrize("tag", ["<p title=it's>", '<p class="x>', '<p data-a="a > b" title=\'c > d\'>', '<p onclick="if(a<b)">', "<p a=b=c>"])
def test_quotes_leak_no_markup(tag):
    assert H.main_text(f"<div>{tag}Hello, <b>there</b>.</p></div>") == "Hello, there."


@pytest.mark.parametrize("name", ["class='related-work'", "class='social-history'", "id='notices'"])
def test_dense_sections_of_the_article_stay(name):
    inner = f"<article>{PARAGRAPHS}<section {name}>{PARAGRAPHS}</section></article>"
    assert H.main_text(page(inner)) == f"{WANT} {WANT}"
    teaser = f"<article>{PARAGRAPHS}<section {name}><p>Teaser, one.</p></section></article>"
    assert H.main_text(page(teaser)) == WANT


def test_sentences_in_links_stay():
    linked = f"<p><a href=x>{BODY[1]}</a></p>"
    assert H.main_text(page(f"<article>{PARAGRAPHS}{linked}</article>")) == f"{WANT} {BODY[1]}"


def test_lists_tables_and_headings_of_the_article_stay():
    inner = f"<article><h1>A Title</h1>{PARAGRAPHS}<h2>More</h2><ul><li>one</li><li>two</li></ul><table><tr><td>1</td><td>2</td></tr></table><blockquote>Said.</blockquote></article>"
    assert H.main_text(page(inner)) == f"A Title {WANT} More one two 1 2 Said."


def without_marks(html):
    html = re.sub(r"<(/?)(article|main)\b", r"<\1div", html)
    return re.sub(r"(<(?!script|style)[a-z0-9]+)(?:\s+(?:class|id|role|itemprop)=(?:\"[^\"]*\"|'[^']*'))+", r"\1", html)


def test_ratios_find_the_article_without_marks(data):
    """On the test pages with all marks taken away, from all pages whose article outweighs the advert."""
    import pyarrow.parquet as pq

    pages = [r["html"] for r in pq.read_table(f"{data.rsplit('/', 1)[0]}/sf0.01/pages.parquet").to_pylist()]
    same = [H.main_text(without_marks(h)) == H.main_text(h) for h in pages]
    long = [len(H.main_text(h)) >= 300 for h in pages]
    assert all(s for s, n in zip(same, long) if n) and sum(same) >= 0.93 * len(pages)
    assert all(H.main_text(re.sub(r"<(/?)article\b", r"<\1div", h)) == H.main_text(h) for h in pages)


@pytest.mark.parametrize(
    "text",
    ["<div>" * 100_000 + "deep, text." + "</div>" * 100_000, "<x>" * 30_000 + "<li>a, b." * 30_000, "<p>" * 30_000 + "</b>" * 30_000, '<a href="' * 60_000, '<a href="' * 60_000 + ">", "<div class='x " * 60_000, "<svg>" * 30_000, "<table><tr><td>" * 30_000 + "x", "a < b <c " * 60_000, "<div class='sidebar'>" * 30_000 + "x, y.", "words, many. " * 300_000],
    ids=range(11),
)
def test_long_and_deep_pages_take_linear_time(text):
    import time

    began = time.process_time()
    got = H.main_text(text)
    assert time.process_time() - began < 20 and isinstance(got, str)


class Tree(HTMLParser):
    """Well-formed pages as blocks with the list of their ancestors (tag, attributes, number)."""

    def __init__(self, text):
        super().__init__(convert_charrefs=True)
        self.stack, self.blocks, self.n, self.fresh = [], [], 0, True
        self.feed(text)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.stack.append((tag, {}, -1))
            return
        self.n += 1
        self.stack.append((tag, dict(attrs), self.n))
        self.fresh = True

    def handle_endtag(self, tag):
        self.stack.pop()
        self.fresh = self.fresh or tag != "a"

    def handle_data(self, data):
        if self.fresh and not data.isspace():
            self.blocks.append([[s for s in self.stack if s[2] >= 0], "", 0])
            self.fresh = False
        if not self.fresh:
            self.blocks[-1][1] += data
            self.blocks[-1][2] += len(data) * any(s[0] == "a" for s in self.stack)


def brute(text):
    """The rule written out plainly for pages of articles, divs, named divs, lists, links and navigation."""
    blocks = [(up, " ".join(t.split()), linked) for up, t, linked in Tree(text).blocks if not any(s[0] in ("nav", "footer", "head") for s in up)]
    weigh = {"ad": H.NEVER, "related": H.NAMED, "related-work": H.PARTLY}
    names = lambda up: [(s[2], s[1]["class"]) for s in up if s[1].get("class") in weigh]
    total = sum(len(t) - k for _, t, k in blocks)
    marked = sum((len(t) - k) for up, t, k in blocks if any(s[0] == "article" for s in up))
    free = sum(len(t) - k for up, t, k in blocks if not names(up))
    inside = lambda e, up: any(s[2] == e for s in up)
    text_in = lambda e: sum(len(t) - k for up, t, k in blocks if inside(e, up))
    articles = sorted({s[2] for up, _, _ in blocks for s in up if s[0] == "article" and text_in(s[2])}, key=lambda e: (-text_in(e), e))

    def wraps(e, name):
        largest = articles and any(inside(e, up) and inside(articles[0], up) for up, _, _ in blocks) and e < articles[0] and text_in(articles[0]) >= free
        held = sum(len(t) - k for up, t, k in blocks if inside(e, up) and any(s[0] == "article" for s in up))
        return largest or name == "related-work" and 2 * text_in(e) > total and held == marked

    weight = [min([1.0, *(weigh[n] for e, n in names(up) if not wraps(e, n))]) for up, _, _ in blocks]
    path = ["/".join(f"{s[0]}.{s[1].get('class', '')}" for s in up) for up, _, _ in blocks]
    of = lambda p: [k for k, x in enumerate(path) if x == p]
    mean_of = lambda p, f: sum(f(blocks[k]) for k in of(p)) / len(of(p))
    plain = [(mean_of(p, lambda b: len(b[1])) * (1 + mean_of(p, lambda b: sum(c in ".,;:!?" for c in b[1])))) ** 0.5 for p in path]
    share = [sum(min(blocks[k][2], len(blocks[k][1])) for k in of(p)) / sum(len(blocks[k][1]) for k in of(p)) for p in path]
    fused = [a * (1 - b) * w for a, b, w in zip(plain, share, weight)]
    near = {d: 2.718281828459045 ** (-0.5 * d * d) for d in range(-3, 4)}
    smooth = [sum(near[d] * fused[min(max(k + d, 0), len(fused) - 1)] for d in near) / sum(near.values()) for k in range(len(fused))]
    score = [sum(smooth[k] for k in of(p)) / len(of(p)) for p in path]
    mean = sum(s * len(b[1]) for s, b in zip(score, blocks)) / sum(len(b[1]) for b in blocks)
    title = lambda up: any(s[0] == "h1" for s in up)
    titled = {up[-2][2] if len(up) > 1 else 0 for up, _, _ in blocks if title(up) and up[-1][0] == "h1"}
    double = [any(s[0] == "article" for s in up) or bool(titled & {s[2] for s in up[-2:]}) for up, _, _ in blocks]
    mass = [(len(t) - k) * w * (s >= H.SHARE * mean) * (2 if d else 1) for (_, t, k), w, s, d in zip(blocks, weight, score, double)]
    container = None
    whole = sum(mass)
    for depth in range(20):  # from the root inwards, along the elements that hold most of the mass
        found = {up[depth][2]: up[depth] for up, _, _ in blocks if len(up) > depth and sum(m for (u, _, _), m in zip(blocks, mass) if inside(up[depth][2], u)) >= H.MOST * whole}
        if not found:
            break
        (e,) = found.values()
        if e[0] in ("html", "body", "div", "article"):
            container = e
        if e[0] == "article":
            break
    keep = []
    for k, (up, t, _) in enumerate(blocks):
        within, links = inside(container[2], up), share[k] > H.LINKS
        dense = plain[k] * weight[k] >= H.OUTSIDE * mean and mean_of(path[k], lambda b: sum(c in ".,;:!?" for c in b[1])) >= 1
        ok = (weight[k] == 1 or fused[k] >= H.INSIDE * mean) and (not links or dense)
        if container[0] in ("html", "body"):
            ok = ok and (score[k] >= H.SHARE * mean or up[-1][0] in ("h1", "h2") and weight[k] == 1)
        held = sum(len(t) for up, t, _ in blocks if inside(container[2], up))
        enough = sum(len(blocks[j][1]) for j in of(path[k])) >= H.PART * held
        keep.append(ok if within else not links and enough and min(score[k], fused[k]) >= H.OUTSIDE * mean)
    within = [inside(container[2], up) for up, _, _ in blocks]
    begin = within.index(True)
    if begin and not any(w and up[-1][0] in ("h1", "h2") for w, (up, _, _) in zip(within, blocks)):
        before = [k for k in range(begin) if blocks[k][0][-1][0] in ("h1", "h2") and weight[k] > H.NEVER and share[k] <= H.LINKS]
        chain = {0} | {s[2] for up, _, _ in blocks if inside(container[2], up) for s in up[: [x[2] for x in up].index(container[2]) + 1]}
        if before and chain & {([0, 0] + [s[2] for s in blocks[before[-1]][0]])[-2], ([0, 0, 0] + [s[2] for s in blocks[before[-1]][0]])[-3]}:
            keep[before[-1]] = True
    if not any(keep):
        keep = [s <= H.LINKS for s in share]
    return " ".join(t for (_, t, _), k in zip(blocks, keep) if k)


def test_against_the_rule_written_out():
    rng = random.Random(8)
    words = ["lorem", "ipsum,", "dolor", "sit.", "amet", "a"]
    some = lambda most: " ".join(rng.choice(words) for _ in range(rng.randrange(1, most)))

    def element(depth):
        kind = rng.random()
        if depth > 3 or kind < 0.45:
            tag = rng.choice(["p", "p", "p", "h2", "li"])
            return f"<{tag}>{some(40)}</{tag}>" if rng.random() < 0.85 else f"<{tag}><a href=x>{some(9)}</a> {some(2)}</{tag}>"
        name = rng.choice(["", "", ' class="ad"', ' class="related"', ' class="related-work"', ' class="text"'])
        tag = rng.choice(["div", "div", "article"]) if not name else "div"
        inner = "".join(element(depth + 1) for _ in range(rng.randrange(1, 5)))
        return f"<{tag}{name}>{inner}</{tag}>"

    texts = set()
    for _ in range(300):
        html = f"<html><body><nav><p>Go, home.</p></nav>{'<h1>A title</h1>' * (rng.random() < 0.3)}{''.join(element(1) for _ in range(rng.randrange(1, 5)))}<footer>End, here.</footer></body></html>"
        assert H.main_text(html) == brute(html), html
        texts.add(H.main_text(html))
    assert len(texts) > 250


def test_nothing_but_content_is_lost():
    rng = random.Random(3)
    for _ in range(40):
        body = [" ".join(rng.choice(["lorem", "ipsum,", "dolor", "sit.", "a"]) for _ in range(rng.randrange(1, 60))) for _ in range(rng.randrange(1, 30))]
        html = page("<article>" + "".join(f"<p>{b}</p>" for b in body) + "</article>")
        assert H.main_text(html) == " ".join(body)


def test_frame(spark):
    df = spark.createDataFrame([(1, "u", page(PARAGRAPHS and f"<article>{PARAGRAPHS}</article>"), "x"), (None, None, None, "x"), (2, "v", "", "x"), (2, "v", "", "x")], "page_id long, url string, html string, text string")
    got = H.extract(df).collect()
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in got] == [(1, "u", WANT, len(WANT)), (None, None, "", 0), (2, "v", "", 0), (2, "v", "", 0)]
    assert H.extract(df.limit(0)).collect() == []
