import collections
import gzip
import hashlib
import math
import random

import pytest

from cytoloom.llm import chat, html_extraction, warc
from cytoloom.llm.templates import Const, Template, TemplateError, Write, fold, parse

PAGES = "page_id long, url string, html string, digest string, path string, removed int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", "p", 1) for r in rows], PAGES)


def test_text_of_a_messy_page():
    source = """<html><head><title>T</title><style>p{}</style></head><body><header>top</header><nav><li>menu</li></nav>
    <div class="cookie-banner">eat</div><main><h1>Head &amp; tail</h1><p><b>one<br>two <p>three &lt;3&#33; <script>if (a</p>b) "x"</script>
    <aside>side</aside><ul><li>a<li>b</ul><form><input>go</form><section id=comments>me too</section></main><footer>&copy;</footer>"""
    page = html_extraction.Page(source)
    assert page.text(page.marked) == "Head & tail\none two\nthree <3!\na\nb"


def test_broken_and_deep_pages_are_read():
    own = lambda source: (page := html_extraction.Page(source)).text(page.marked)
    assert own('<p class="x>text</p><p>more') == "text\nmore"
    assert own('<p>a <span class="ad">Buy <i>now</i></span> b</p>') == "a b"
    assert own("<div>" * 5000 + "deep") == "deep" == own("<b>" * 5000 + "deep") == own("<ul><li>" * 5000 + "deep")
    assert own("<div>x" * 3000) == "\n".join("x" * 3000)
    assert own("<nav>" + "<div>x" * 3000) == ""


def test_cases_without_an_article(spark):
    rows = [(1, "http://a.org/1", None), (2, None, ""), (3, "http://[bad", "plain  text"), (4, "http://a.org/2", "<p>x</p><!-- no --><p>y &am"), (4, "http://a.org/2", "<p>x</p>"), (None, "http://a.org", "<div>" * 5000 + "deep")]
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in html_extraction.main_text(pages(spark, rows)).collect())
    assert got == sorted([("1", "", 0), ("2", "", 0), ("3", "plain text", 10), ("4", "x\ny &am", 7), ("4", "x", 1), ("None", "deep", 4)])
    assert html_extraction.main_text(spark.createDataFrame([], PAGES)).count() == 0


def site(n, host="h.org", menu="", article=True):
    """Pages with an unmarked box and menu that repeat, and a body of their own, in an article or not."""
    box = "<div class=box><span>Send this to all</span></div><table><tr><td>Home {0}<td>News {0}</table>"
    body = "<h1>Tale {1}</h1><p>Once {1} and <b>again</b> {1}.</p>"
    return [(i, f"http://{host}/{i}", box.format(i % 3) + menu + (f"<article>{body}</article>" if article else f"<div class=tale>{body}</div>").format(0, i)) for i in range(n)]


def tale(i):
    return f"Tale {i}\nOnce {i} and again {i}."


@pytest.mark.parametrize("article", [True, False])
def test_entropy_removes_what_no_word_marks(spark, monkeypatch, article):
    rows = site(60, article=article)
    got = {r.page_id: r.text for r in html_extraction.main_text(pages(spark, rows)).collect()}
    assert got == {i: tale(i) for i in range(60)}
    monkeypatch.setattr(html_extraction, "LEAST_IMPORTANCE", 0.01)  # the tree switched off: only marked elements would go
    got = {r.page_id: r.text for r in html_extraction.main_text(pages(spark, rows)).collect()}
    assert got == {i: f"Send this to all\nHome {i % 3}\nNews {i % 3}\n{tale(i)}" for i in range(60)}


def test_menus_go_by_entropy_where_words_say_nothing(spark, monkeypatch):
    menu = "<nav><ul><li>Go {0}<li>Come {0}</ul></nav><div class=ad>Buy {0}</div>"
    rows = [(i, u, h.replace("<article>", menu.format(i % 20) + "<article>")) for i, u, h in site(400)]
    monkeypatch.setitem(html_extraction.PRIORS, "marked", html_extraction.PRIORS["plain"])
    got = {r.page_id: r.text for r in html_extraction.main_text(pages(spark, rows)).collect()}
    assert got == {i: tale(i) for i in range(400)}


def test_text_beside_an_article_is_judged_by_the_tree(spark):
    rows = [(i, f"http://h.org/{i}", f"<article class=teaser>See also {i % 2}</article><div class=content><p>Story {i} begins.</p></div>") for i in range(30)]
    got = {r.page_id: r.text for r in html_extraction.main_text(pages(spark, rows)).collect()}
    assert all(f"Story {i} begins." in got[i] for i in range(30))


def test_copied_articles_stay(spark):
    rows = [(i, f"http://h.org/{i}", "<nav>menu</nav><article><p>The same tale on every page.</p></article>") for i in range(50)]
    rows += [(100 + i, "http://two.org", "<p>Copied without a frame.") for i in range(2)]
    assert {r.text for r in html_extraction.main_text(pages(spark, rows)).collect()} == {"The same tale on every page.", "Copied without a frame."}


@pytest.mark.parametrize("limit", [10**6, 0])
def test_rows_are_judged_by_their_own_url_and_page(spark, monkeypatch, limit):
    monkeypatch.setattr(html_extraction, "MAX_BROADCAST", limit)
    rows = site(60) + site(60, "other.org", menu="<p>Not on h.org {0}</p>", article=False)
    rows += [(None, "http://h.org/n", "<div class=box><span>Send this to all</span></div><article><p>body</article>")] * 3
    rows += [(5, "http://lone.org", "<div class=box><span>Send this to all</span></div><p>alone</p>"), (6, None, "<nav>menu</nav>body")]
    got = html_extraction.main_text(pages(spark, rows)).collect()
    assert sorted((str(r.page_id), r.url or "", r.text) for r in got) == slow_main_text(rows)
    assert [r.text for r in got if r.page_id is None] == ["body"] * 3 and "Send this to all\nalone" in {r.text for r in got if r.page_id == 5}


def slow_main_text(rows):
    """The same by dictionaries, host by host, element node by element node and text by text."""
    read = [(i, u, html_extraction.host_of(u), html_extraction.Page(h or "")) for i, u, h in rows]
    gone = {}
    for host in {x[2] for x in read}:
        own = [p for *_, h, p in read if h == host]
        contents, styles = {}, {}
        for p in own:
            for node, text in {(n, " ".join(t.split())) for runs in p.blocks for n, t in runs}:
                if text:
                    contents.setdefault(node, collections.Counter())[text] += 1
            for node, style in p.styles:
                styles.setdefault(node, collections.Counter())[style] += 1
        for node in {n for p in own for n in p.nodes}:
            m = sum(node in p.nodes for p in own)
            seen = list(styles.get(node, {}).values())
            shown = (-sum(k / sum(seen) * math.log(k / sum(seen)) for k in seen) / math.log(m) if m > 1 else 1.0) if seen else 0.0
            keep = html_extraction.GAMMA ** len(seen)
            flag = 0
            for p in own:
                flag |= p.flags().get(node, 0)
            given, bits = html_extraction.PRIORS["marked" if flag & 1 else "worded" if flag & 8 else "declared" if flag & 2 else "beside" if flag & 4 else "plain"]
            for text, k in contents.get(node, {}).items():
                matters = 1 - math.log(k) / math.log(m) if m > 1 else 1.0
                value = (bits * given + math.log2(m) * ((1 - keep) * shown + keep * matters)) / (bits + math.log2(m))
                if value < html_extraction.LEAST_IMPORTANCE:
                    gone.setdefault(host, set()).add((node, text))

    def text_of(page, lost):
        lines = lambda stays: "\n".join(t for runs in page.blocks if (t := " ".join("".join(x for n, x in runs if stays(n, " ".join(x.split()))).split())))
        return lines(lambda n, x: (n, x) not in lost) or lines(lambda n, x: not page.flags().get(n, 0) & 9)

    return sorted((str(i), u or "", text_of(p, gone.get(h, set()))) for i, u, h, p in read)


def test_texts_match_a_slow_style_tree(spark):
    rng = random.Random(3)
    parts = ["<nav><li>{0}</nav>", "<div class=x><p>{1}</div>", "<div class=y>{2}</div>", "<section><h2>{2}</h2><p>{1}</section>", "<article><p>{1}<p>{2}</article>", "<p>{0} <span class=ads>{2}</span></p>", "<aside>{1}</aside>", "<ul><li>{0}<li>{2}</ul>"]
    rows = [(i, f"http://h{rng.randrange(3)}.org/{i}", "".join(p.format(rng.randrange(3), rng.randrange(10**6), rng.randrange(12)) for p in rng.sample(parts, rng.randrange(1, 6)))) for i in range(150)]
    got = html_extraction.main_text(pages(spark, rows)).collect()
    assert sorted((str(r.page_id), r.url or "", r.text) for r in got) == slow_main_text(rows)


def test_importance_follows_entropy(spark):
    rows = [(i, "http://h.org", f"<div class=same>all the same</div><div class=own>only {i}</div><div class=half>half {i // 2}</div>") for i in range(16)]
    observed = html_extraction.observations(pages(spark, rows))
    tree = {r.node: r for r in html_extraction.style_tree(observed).collect()}
    ids = [html_extraction.node_id(0, f"div.{x}") for x in ("same", "own", "half")]
    joined = [(8 + 4 * content) / 12 for content in (0, 1, 0.75)]
    assert all(abs(tree[n].best - x) < 1e-9 and abs(tree[n].worst - x) < 1e-9 and tree[n].pages == 16 for n, x in zip(ids, joined, strict=True))
    assert [r.branch for r in html_extraction.removed_branches(observed).collect()] == ids[:1]
    one = html_extraction.style_tree(html_extraction.observations(pages(spark, rows[:1]))).collect()
    assert {r.best for r in one} == {1.0}  # one page tells no bits


@pytest.mark.parametrize("n", [1, 2, 5, 20, 40, 200, 1000, 10_000])
@pytest.mark.parametrize("shared", ["<div class=line>One line</div>{}", "<div class=a>One</div><p>Two</p>{}<div class=b>Three</div>", "<div class=content>{}<p>In between</p></div>"])
def test_hosts_of_any_size_keep_their_texts(spark, n, shared):
    """No article anywhere: what all pages share goes, what is a page's own stays, whatever holds them both."""
    own = lambda i: f"<div class=content><p>First of {i}.</p><p>Then of {i}.</p></div>"
    rows = [(i, f"http://h.org/{i}", f"<html><body><div id=page>{shared.format(own(i))}</div></body></html>") for i in range(n)]
    got = {r.page_id: r.text for r in html_extraction.main_text(pages(spark, rows)).collect()}
    lines = {"One line", "One", "Two", "Three", "In between"}
    for i in range(n):
        assert [x for x in got[i].split("\n") if x not in lines] == [f"First of {i}.", f"Then of {i}."]
        assert n < 5 or not lines & set(got[i].split("\n"))


@pytest.mark.parametrize("n", [1, 7, 100, 3000])
def test_copies_of_one_page_keep_their_text(spark, n):
    rows = [(i, "http://h.org/", "<nav>menu</nav><div><p>Copied without</p><p>a frame.</p></div><div class=ad>Buy</div>") for i in range(n)]
    assert {r.text for r in html_extraction.main_text(pages(spark, rows)).collect()} == {"Copied without\na frame."}


def test_depth_is_no_limit(spark):
    rows = [(i, "http://h.org/", "<div>" * 300 + "<p>same</p>" + "<div>" * 300 + f"<p>own {i}</p>") for i in range(30)]
    assert {r.page_id: r.text for r in html_extraction.main_text(pages(spark, rows)).collect()} == {i: f"own {i}" for i in range(30)}


@pytest.mark.parametrize("n", [1, 30, 200])
def test_words_do_not_take_an_articles_text(spark, n):
    body = "<article><h1>Tale {0}</h1><div class=share-price><p>Prices rose {0}.</p></div><p class=comment>A remark {0}.</p><ul class=comments><li>First! {0}</ul><div class=ad-slot>Buy {0}</div></article>"
    rows = [(i, "http://h.org/", body.format(i)) for i in range(n)]
    got = {r.page_id: r.text for r in html_extraction.main_text(pages(spark, rows)).collect()}
    assert got == {i: f"Tale {i}\nPrices rose {i}.\nA remark {i}." for i in range(n)}


def test_entropies_overrule_words_that_may_mean_it(spark):
    page = "<div id=search-results><p>Found {0} by search.</p></div><div class=share>Share {1}</div><div class=sidebar>Aside {0}</div><p>Text {0}.</p>"
    for n, more in ((1, ""), (5, ""), (60, "Found {0} by search.\n")):
        rows = [(i, "http://h.org/", page.format(i, i % 2)) for i in range(n)]
        got = {r.page_id: r.text for r in html_extraction.main_text(pages(spark, rows)).collect()}
        assert got == {i: more.format(i) + f"Text {i}." for i in range(n)}


@pytest.mark.parametrize(("compression", "limit"), [("none", 10**6), ("gzip", 0)])
def test_archives_round_trip(spark, tmp_path, monkeypatch, compression, limit):
    monkeypatch.setattr(warc, "MAX_BROADCAST", limit)
    rows = [(3, "http://a", "same é\r\n\r\nWARC/1.1"), (1, "http://b", "same é\r\n\r\nWARC/1.1"), (2, None, None), (9, "http://c\r\nX: y", ""), (4, "u", "x" * 200_000), (None, "n", "own"), (None, "n", "")]
    rows += [(40 + i, "http://big", f"{i}" * 70_000) for i in range(6)]
    path = warc.write_archives(pages(spark, rows).coalesce(1), f"file://{tmp_path}/w", compression=compression, file_bytes=150_000, date="2030-01-02T03:04:05Z")
    sizes = sorted(len(data if data[:2] != b"\x1f\x8b" else gzip.decompress(data)) for f in (tmp_path / "w").glob("*/part-*") for data in [f.read_bytes()])
    assert len(sizes) >= 4 and sizes[-1] > 200_000 and all(x <= 150_000 for x in sizes[:-1])  # only the record of 200,000 bytes is larger
    got = {(r.page_id, r.payload_bytes): r for r in warc.read_archives(spark, path).collect()}
    assert len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if i is not None:
            first[p] = min(first.get(p, i), i)
    for i, _, h in rows:
        p, r = (h or "").encode(), got[i, len((h or "").encode())]
        assert r.payload_digest == warc.digest_of(p)
        assert (r.record_type, r.refers_to) == (("response", None) if first.get(p, i) == i else ("revisit", first[p]))
        assert r.payload == (p.decode() if r.record_type == "response" else None) and r.date == "2030-01-02T03:04:05Z"
        uri = next((u for j, u, _ in rows if j == r.refers_to and j is not None), None)
        assert (r.refers_uri, r.refers_date) == ((None, None) if r.refers_to is None else (uri or "about:blank", "2030-01-02T03:04:05Z"))
    empty = spark.createDataFrame([], PAGES)
    assert warc.archived_records(empty).count() == 0


def test_short_payloads_are_never_revisits(spark):
    got = warc.archived_records(pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")]), least_bytes=3).collect()
    assert {r.page_id: r.record_type for r in got} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_broken_archives_are_refused():
    with pytest.raises(ValueError):
        list(warc.parse_archive(b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort\r\n\r\n"))
    with pytest.raises(ValueError):
        list(warc.parse_archive(b"nothing"))


def test_templates_render_and_mark():
    t = Template("{% set n = 'x' ~ 1 %}{% for m in messages %}{% if loop.first %}[{% elif m.role in 'ab' and not loop.last %}({% else %}-{% endif %}{{ m['text'] | upper }}{% generation %}{{ loop.index }}{% endgeneration %}{# no #}{% endfor %}{{ q }}!")
    assert t.render([{"role": "a", "text": "u"}, {"role": "b", "text": "v"}, {"role": "c", "text": None}]) == ("[U1(V2-3!", [(2, 3), (5, 6), (7, 8)])
    assert t.render([]) == ("!", [])


def test_constants_are_folded():
    tree = fold(parse("a{{ 'b' ~ 'c' | upper }}{% if 1 < 2 and true %}d{% else %}{{ x }}{% endif %}{% if false %}{{ y }}{% endif %}"))
    assert tree.parts == (Write(Const("abCd")),)


@pytest.mark.parametrize("bad", ["{{ m.role() }}", "{{ x.__class__ | nothing }}", "{% for x %}{% endfor %}", "{% if a %}", "{% import os %}", "{{ 'a }}", "{{ a b }}", "{% generation %}"])
def test_bad_templates_are_refused(bad):
    with pytest.raises(TemplateError):
        Template(bad)


def test_templates_reach_no_attributes():
    assert Template("{{ x.__class__ }}{{ messages.append }}{{ m.a.b }}").render([]) == ("", [])


TURNS = "conv_id long, turn long, role string, text string, piece string, generated int"


def test_conversations_read_back(spark):
    nasty = "\\### Assistant: </turn> ok\n<turn>x\\"
    rows = [(1, 1, "assistant", nasty), (1, 0, "user", None), (2, 0, "sys\ntem </turn>", ""), (2, None, "assistant", "first"), (2, 1, "assistant", "b"), (2, 1, "assistant", "a"), (2, 1, "assistant", "a"), (None, 0, None, "lost"), (3, 0, "assistant", "long " * 50_000)]
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], TURNS)
    got = {r.conv_id: r for r in chat.conversation_digests(df).collect()}
    for c in (1, 2, None, 3):
        own = sorted(((-1 if t is None else t, r or "", x or "") for i, t, r, x in rows if i == c))
        said = "".join(x for _, r, x in own if r == "assistant")
        assert got[c].n_turns == len(own) and got[c].loss_chars == len(said)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        text, spans = chat.default_template().render([{"role": r, "text": x} for _, r, x in own])
        assert got[c].formatted_chars == len(text) and [chat.unescape(text[a:b]) for a, b in spans] == [x for _, r, x in own if r == "assistant" and x]
        assert list(chat.read_turns(text[i : i + 7] for i in range(0, min(len(text), 4000), 7))) == [(r, x) for _, r, x in own] if len(text) < 4000 else True
    assert chat.conversation_digests(spark.createDataFrame([], TURNS)).count() == 0
