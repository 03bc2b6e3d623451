import random
import re
from html import escape, unescape

from larkspur.llm import html


def page(body, head="<title>t</title><style>p{}</style><script>var a='</p>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


CASES = [
    (None, ""),
    ("", ""),
    (page("<nav><ul><li><a href='/'>Home</a><li>More</ul></nav><div class='ad'>Buy</div><article><h1>T&amp;x</h1><p><b>One  two<br><p>thr<i>ee</i>\n four &lt;b&gt;</p></article><footer>end</footer>"), "T&x One two three four <b>"),
    (page("<header>Site</header><main><div class='content'><p>Main text here.</p><form><input value=1>Search<button>Go</button></form></div></main><aside>Side</aside><section id='comments'><p>First!</p></section>"), "Main text here."),
    (page("<div class='ad'>open advert<article><p>Still the article</p></article>"), "Still the article"),
    (page("<div id='cookie-notice'>We use</div><div class='post-content'><p>Words of the post.</p></div><div class='sidebar'>Links links</div>"), "Words of the post."),
    (page("<div><p>No sign of an article at all, only text.</p></div><div class=menu>a b c</div>"), "No sign of an article at all, only text."),
    ("<html><body><article><p>cut off <b>here</b> and <a hre", "cut off here and"),
    (page("<article><p>a</p><!-- no --><div class='comments'>c</div><noscript>n</noscript><table><tr><td>x<td>y</table><ul><li>1<li>2</ul></article>"), "a x y 1 2"),
    ("plain text only &eacute;&nbsp;x", "plain text only é x"),
]


def alone(source):
    return html.extract(source, None, html.Forms())


def test_cases():
    for source, text in CASES:
        assert alone(source or "") == text, source


def test_words_of_class_names_drop_only_whole_names():
    body = '<article><p>Start.</p><p class="share-price">The share price rose.</p><div id="notice-of-sale"><p>Body of it.</p></div><div class="share-buttons">Tweet</div><p>End.</p></article>'
    assert alone(page(body)) == "Start. The share price rose. Body of it. End."


def test_blocks_around_and_inside_the_article_go():
    kept = "<h1>Title</h1><p>One <a href='#'>link</a> of many words in a row.</p><p class='alert-text'>Two.</p><ul class='facts'><li>three</li><li>four</li></ul>"
    gone = "<div class='related-stories'><p>More</p></div><div class='social-icons'>f t</div><form><input>Search</form><aside>Side</aside><section id='user-comments'><article class='comment'><p>First!</p></article></section>"
    around = "<header class='site-header'><div>Site</div></header><nav>Menu</nav><div class='col-sidebar'><p>Links and links</p></div><div class='cookie-banner'>We use</div><div role='complementary'>More</div>"
    text = "Title One link of many words in a row. Two. three four"
    assert alone(page(f"{around}<article>{kept}{gone}</article><footer>end</footer>")) == text
    assert alone(page(f"{around}<main>{kept}{gone}</main><footer>end</footer>")) == text
    assert alone(page(f"{around}<div class='entry-content'>{kept}{gone}</div><footer>end</footer>")) == text


def test_ties_and_repeated_rows(spark):
    two = page("<article><p>same size</p></article><section><article id='x'><p>size same</p></article></section>")
    pages = spark.createDataFrame([(1, "http://a/1", two), (1, "http://a/1", two), (2, "http://a/2", two)], "page_id long, url string, html string")
    assert {r.text for r in html.main_texts(pages).collect()} == {"same size"} and html.main_texts(pages).count() == 3


def test_main_container_of_the_host_and_odd_rows(spark):
    rows = [(i, f"http://a.example/{i}", s) for i, (s, _) in enumerate(CASES)] + [(50, None, CASES[1][0]), (50, "", CASES[2][0])]
    rows = [(a, u or "x", h, "clash", "clash") for a, u, h in rows] + [(60, "http://b.example/", page("<article>" + "<p>word</p>" * 20000 + "</article>"), "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, main string, host string").repartition(3)
    got = [(r.page_id, r.text, r.n_chars) for r in html.main_texts(pages).collect()]
    assert len(got) == len(rows) and all(len(t) == n for _, t, n in got)
    by = {i: t for i, t, _ in got if i != 50}
    assert [by[i] for i in (0, 2, 6)] == ["", CASES[2][1], CASES[6][1]] and by[60] == "word " * 19999 + "word"
    assert html.main_texts(pages.where("false")).collect() == []


def test_hosts_beyond_the_broadcast_bound_are_joined(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = sorted(map(tuple, html.main_texts(pages).collect()))
    before, html.BROADCAST_BYTES = html.BROADCAST_BYTES, 0
    try:
        assert sorted(map(tuple, html.main_texts(pages).collect())) == want
    finally:
        html.BROADCAST_BYTES = before


def wrapper_of(pages):
    w = html.Wrapper(html.Forms())
    for one in pages:
        w.add_page(one)
    return w.whole()


def short(body):
    """A wrapper's body as a regular expression over tags."""
    if body[0] in "#@":
        return body[0]
    inner = " ".join(short(x[2]) + {(1, 0): "", (0, 0): "?", (1, 1): "+", (0, 1): "*"}[x[0], x[1]] for x in (body[4] if body[0] == "<" else body[1]))
    return f"{body[1]}({inner})" if body[0] == "<" else f"({inner})"


def test_wrapper_has_repeated_optional_and_text_parts():
    said = short(wrapper_of(page("<nav>" + "<li><a>l</a></li>" * k + "</nav><article>" + "<p>x</p>" * k + ("<h2>y</h2>" if k == 2 else "") + "</article>") for k in (1, 3, 2)))
    assert said == "root(html(body(nav(li(@)+) article(p(#)+ h2(#)?))))"
    blocks = short(wrapper_of(page("<div>" + "<h2>t</h2><p>x</p><p>y</p>" * k + "</div>") for k in (1, 4)))
    assert blocks == "root(html(body(div((h2(#) p(#)+)+))))"


def test_every_page_matches_its_hosts_wrapper(spark):
    rng = random.Random(8)
    hosts = []
    for _ in range(20):
        made = []
        for _ in range(40):
            parts = ["<p>x</p>", "<h2>t</h2>", "<div>d</div>", "plain", "<div><p>x</p><ul>" + "<li>i</li>" * rng.randint(1, 3) + "</ul></div>", "<ul>" + "<li><a>i</a></li>" * rng.randint(1, 3) + "</ul>", "<section class='a b%d'><p>y</p>%s</section>" % (rng.randint(0, 9), "<div>z</div>" * rng.randint(0, 12))]
            made.append(page("<nav>m</nav><article>" + "".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) + "</article>"))
        hosts.append(made)
    by = {}
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        by.setdefault(r.url.split("/")[2], []).append(r.html or "")
    for made in [*hosts, *by.values()]:
        half = len(made) // 2
        parts = [w for w in (wrapper_of(made[:half]), wrapper_of(made[half:])) if w is not None]
        whole = parts[0] if len(parts) == 1 else html.united(*parts)
        forms = html.Forms()
        matcher = html.Matcher(html.decided(whole), forms)
        assert all(matcher.match(matcher.root, html.read(one, forms)[0]) is not None for one in made), short(whole)


def neutral(rng, k):
    """A page of a host that names nothing: what is the article only the host's pages tell."""
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    body = [words(rng.randint(3, 25)) for _ in range(rng.randint(1, 6))]
    links = "".join(f"<li><a href='/{i}'>Place {i}</a></li>" for i in range(9))
    notice = "We keep what you read for as long as we like, and tell whom we want; reading on you agree to all of it. " * 4
    source = f"<html><body><div><ul>{links}</ul></div><div><div>{notice}</div><div><h1>{words(4)}</h1>"
    return source + "".join(f"<p>{p}</p>" for p in body) + f"</div></div><div>Copyright of us {k % 3}</div></body></html>", body


def test_hosts_that_name_nothing_are_told_by_their_wrappers():
    rng = random.Random(4)
    made = [neutral(rng, k) for k in range(30)]
    forms = html.Forms()
    matcher = html.Matcher(html.decided(wrapper_of(s for s, _ in made)), forms)
    got = [html.extract(s, matcher, forms) for s, _ in made]
    assert all(t.endswith(" ".join(body)) and len(t) < len(" ".join(body)) + 40 for t, (_, body) in zip(got, made, strict=True)), got[:2]
    assert sum(alone(s) != t for (s, _), t in zip(made, got, strict=True)) > 10


def reference(source):
    """The text of a page of the synthetic tables, cut out by its known markup."""
    inner = re.search(r"<article>(.*?)(?:</article>|\Z)", source or "", re.S)
    if not inner:
        return ""
    body = re.sub(r"<(?:/?(?:p|h1|h2|br|ul|li|div|blockquote))\b[^>]*>", " ", inner[1])
    return " ".join(unescape(re.sub(r"<[a-zA-Z/][^>]*(?:>|\Z)", "", body)).split())


def test_synthetic_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html.main_texts(pages).collect()}
    want = {r.page_id: reference(r.html) for r in pages.collect()}
    wrong = [i for i in want if want[i] != got[i]]
    assert not wrong, (len(wrong), [(want[i][:200], got[i][:200]) for i in wrong[:3]])
    assert escape("<") == "&lt;"
