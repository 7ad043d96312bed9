import html
import random
import re
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from formlens.llm import html_main
from formlens.llm._common import short_word_marks, word_marks
from formlens.llm.html_main import main_text, suffix_order
from formlens.llm.queries import op4_html_extraction

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div>
<main><article><h1>Title &amp; more</h1><p>One  <b>two</b>\n three<br>four<p>Five&nbsp;six &lt;tag&gt; &#233;</p><ul><li>a<li>b</ul>
<aside>side</aside><form><p>sign up</p><input name="x>y"></form><table><tr><td>1</td><td>2</td></tr></table>
<section class="comments"><article class="comment"><p>first!</p></article></section></article></main><div id="cookie-notice">We use</div><footer>&copy; x</footer></body></html>"""


def blocks_of(markup):
    """Whether an article is marked, and the blocks that are text by markup."""
    blocks = html_main.blocks_of(markup)
    return any(b[2] for b in blocks), [b[0] for b, x in zip(blocks, html_main._may(blocks), strict=True) if x]


def test_blocks():
    assert blocks_of(PAGE)[:2] == (True, ["Title & more", "One two three four", "Five six <tag> é", "a", "b", "1 2"])
    assert blocks_of("")[1] == [] and blocks_of("plain <b>te</b>xt")[1] == ["plain text"]
    assert blocks_of("<p>cut <a href='x")[1] == ["cut"] and blocks_of("</p></div>a<p>b")[1] == ["a", "b"]
    assert blocks_of("<p>1 < 2 & 3 > 2</p>")[1] == ["1 < 2 & 3 > 2"]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_generated_pages(spark, sf):
    """The query gives each page's article, whole, and nothing else."""
    want = {}
    for r in pq.read_table(f"/root/testdata/{sf}/pages.parquet").to_pylist():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<br>|</?b>", " " if "br" in x else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner.replace("<br>", " ")) if x.strip()]
        want[r["page_id"]] = [x for x in blocks if x]
        assert blocks_of(r["html"])[1] == want[r["page_id"]]
    got = {r.page_id: r.text for r in op4_html_extraction(spark, f"/root/testdata/{sf}").collect()}
    assert [k for k in want if got[k] != "\n\n".join(want[k])] == [] and len(got) == len(want)


def test_articles_of_small_hosts_stay_whole(spark):
    """A sentence in three of three articles, in another page's advert, or at the beginning of half of a host's articles is text."""
    line = "the same opening sentence of eight words or more stands here"
    rows = [("s.com", f"<article><h1>{line}</h1><p>{own(i)}</p></article>") for i in range(3)]
    rows += [("a.com", f"<article><p>{line}</p><p>{own(10 + i)}</p></article>" if i < 4 else f'<div class="ad">{line}</div><article><p>{own(10 + i)}</p></article>') for i in range(8)]
    rows += [("h.com", f"<article><p>{line * (i % 2)}</p><p>{own(30 + i)}</p></article>") for i in range(12)]
    want = [f"{line}\n\n{own(i)}" for i in range(3)] + [f"{line}\n\n{own(10 + i)}" if i < 4 else own(10 + i) for i in range(8)]
    assert texts(spark, rows) == want + [f"{line}\n\n{own(30 + i)}" if i % 2 else own(30 + i) for i in range(12)]


def test_runs_of_a_host_are_cut(spark):
    notice = "this site has a long notice that stands on each of its pages"
    rows = [(i, f"http://h.com/{i}", f"<body><div>{notice}</div><div>own words of page number {i} are kept here by all means</div></body>") for i in range(5)]
    rows += [(9, "http://o.com/9", rows[0][2]), (10, None, None), (11, "x", ""), (12, "http://h.com/a", f"<article>{notice}</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in main_text(pages).collect()}
    for i in range(5):
        assert got[i].text == f"own words of page number {i} are kept here by all means" and got[i].n_chars == len(got[i].text)
    assert got[9].text.startswith(notice) and got[12].text == notice and got[10].text == got[11].text == "" and got[10].n_chars == 0
    assert main_text(pages.limit(0)).count() == 0


WORDS = [f"word{i}" for i in range(3000)]


def own(i, n=40):
    return " ".join(WORDS[i * n : i * n + n])


def texts(spark, rows):
    pages = spark.createDataFrame([(i, f"http://{host}/{i}", markup) for i, (host, markup) in enumerate(rows)], "page_id long, url string, html string")
    return [r.text for r in main_text(pages.repartition(3)).orderBy("page_id").collect()]


def test_repeated_runs_of_marked_pages(spark):
    licence, also = "All texts of this site may be used under the licence that stands here", "Read also what our readers liked most this week:"
    quote = "a sentence that three of the articles quote in the very same words"
    rows = [("h.com", f"<article><p>{own(i)}</p>" + (f"<p>{quote}</p>" if i < 3 else "") + f"<p>{also} {own(50 + i, 9)}</p><p>{licence}</p></article>") for i in range(9)]
    rows += [("o.com", rows[0][1]), ("n.com", rows[0][1]), *[("c.com", f"<article><p>{own(30)}</p><p>{own(31)} {i}</p></article>") for i in range(5)]]
    got = texts(spark, rows)
    assert got[:9] == ["\n\n".join([own(i)] + [quote] * (i < 3) + [own(50 + i, 9)]) for i in range(9)]
    assert all(licence in x and also in x for x in got[9:11])
    assert got[11:] == [f"{own(30)}\n\n{own(31)} {i}" for i in range(5)]


def test_bare_pages_keep_their_text(spark):
    notice = "this site has a long notice that stands on each of its pages"
    menu = "".join(f"<div>{x}</div>" for x in ("Home", "About us", "Contact", "Our team", "Imprint", "Terms of use"))
    page = lambda text, date: f"<body>{menu}<div>Summary</div><p>{text}</p><h2>Introduction</h2><p>{text[::-1]}</p><div>{notice}</div><div>{date}</div></body>"
    rows = [("h.com", page(own(i), f"{i} May")) for i in range(4)] + [("h.com", page(own(20), f"{i} June")) for i in range(5)]
    rows += [("c.com", f"<p>{own(30)}</p><p>{own(31)}</p><p>read {i} times</p>") for i in range(5)]
    got = texts(spark, rows)
    for i, x in enumerate(got[:9]):
        text = own(min(i, 20) if i < 4 else 20)
        assert f"{text}\n\nIntroduction\n\n{text[::-1]}" in x and notice not in x and "Home" not in x and "Imprint" not in x
    assert got[9:] == [f"{own(30)}\n\n{own(31)}\n\nread {i} times" for i in range(5)]


def test_captions_and_formulas():
    markup = """<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding="t">x=2</annotation></math> holds <svg aria-hidden="true"><text>no</text></svg>here</p>
<figure><svg><path class="share" d="m"/><title>no</title><text>left</text><text>right</text></svg><figcaption>A caption</figcaption></figure><fieldset>A box</fieldset></article>"""
    assert blocks_of(markup)[:2] == (True, ["So x=2 holds here", "left right", "A caption", "A box"])


def test_unclosed_tags():
    assert blocks_of('<p class="notice">ad<p>real text')[1] == ["real text"]
    assert blocks_of('<ul><li class="ad">x<li>keep</ul>')[1] == ["keep"]
    assert blocks_of('<dl><dt class="ad">x<dd>keep</dl><table><tr><td class="ad">x<td>keep<tr><td>more</table>')[1] == ["keep", "keep", "more"]
    assert blocks_of("<p>a <b>b<p>c</b> d")[1] == ["a b", "c d"]


@pytest.mark.parametrize("part", ["<a ", "<b x='", "<svg x ", "<p>", "<b>", "<li>x", "</p>", "<script>", "<!--", "&amp", '<div class="a', "<td><p>"])
def test_hostile_pages_take_linear_time(part):
    began = time.process_time()
    html_main.blocks_of(part * (5_000_000 // len(part) // (20 if len(part) < 6 else 1)))
    assert time.process_time() - began < 20


def test_suffix_order():
    rng = random.Random(2)
    for run in (1, 2, 3, 5, 8, 11):
        streams = [np.array([rng.randint(1, 3) for _ in range(rng.randint(0, 50))], np.uint32) for _ in range(6)]
        order, stream, rank = suffix_order(streams, run)
        all_ = sum(([(0, int(t)) for t in x] + [(1, i)] for i, x in enumerate(streams)), [])
        prefix = [tuple(all_[i : i + run]) for i in range(len(all_))]
        assert [prefix[i] for i in order] == sorted(prefix)
        assert all((rank[i] == rank[j]) == (prefix[i] == prefix[j]) for i in range(len(all_)) for j in range(i))
        assert stream.tolist() == [i for i, x in enumerate(streams) for _ in range(len(x) + 1)]


def test_repeats_as_brute_force(spark):
    """Bare pages of hosts with one cell and with many: what is cut is what stands on enough pages."""
    rng = random.Random(5)
    line = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    chrome = [line(rng.randint(8, 12)) for _ in range(12)]
    rows = [(f"h{k % 2}.com", [*rng.sample(chrome, 2), *[line(rng.randint(20, 40)) for _ in range(3)]]) for k in range(120)]
    markup = lambda blocks: "".join(f"<div>{x}</div>" for x in blocks)
    pages = spark.createDataFrame([(i, f"http://{h}/{i}", markup(b)) for i, (h, b) in enumerate(rows)], "page_id long, url string, html string")
    on = defaultdict(set)
    for i, (h, blocks) in enumerate(rows):
        for x in blocks:
            on[h, x].add(i)
    want = ["\n\n".join(x for x in b if len(on[h, x]) < 6) for h, b in rows]
    assert any(len(x) != len(" ".join(b)) for x, (_, b) in zip(want, rows, strict=True))
    for cell in (512, 25):  # share 0.1 of 60 pages is six
        got = [(r.text, r.n_repeated) for r in main_text(pages.repartition(4), share=0.1, cell=cell).orderBy("page_id").collect()]
        assert [x for x, _ in got] == want
        assert sum(n > 0 for _, n in got) > 60
    off = [r.text for r in main_text(pages, distinct_pages=1000).orderBy("page_id").collect()]
    assert off == ["\n\n".join(b) for _, b in rows]  # without repeats everything stays


def test_names_that_may_mean_anything(spark):
    rows = [("h.com", f'<article><p class="social-science">{own(i)}</p><div class="related">Go on with what our readers liked best this week</div><p class="toc">Part {i}</p></article>') for i in range(4)]
    assert texts(spark, rows) == [f"{own(i)}\n\nPart {i}" for i in range(4)]


def test_odd_rows(spark):
    rows = [(1, "http://a.b/1", "<p>x y</p>", "t", 5), (1, "http://a.b/1", "<p>x y</p>", "t", 5), (None, None, "<article>" + "word " * 300_000 + "</article>", None, None)]
    out = main_text(spark.createDataFrame(rows, "page_id long, url string, html string, TEXT string, host int"))
    assert out.columns == ["page_id", "url", "html", "host", "text", "n_chars", "n_repeated"]
    assert sorted(r.n_chars for r in out.collect()) == [3, 3, 300_000 * 5 - 1]


def test_markup_is_read_once(monkeypatch):
    """All passes over a page's blocks work on what the one reading of its markup gave."""
    calls, read = [], html_main.blocks_of
    monkeypatch.setattr(html_main, "blocks_of", lambda x: calls.append(x) or read(x))
    pages = [PAGE, "", None, "plain", '<p class="ad">x y</p>', f"<div>{own(0)}</div><div>{own(1)}</div>"]
    n = len(pages)
    longs = pa.array(range(n), pa.int64())
    [got] = html_main._read(iter([pa.record_batch([longs, longs, longs, pa.array(pages)], ["row", "host", "page", "html"])]))
    stream, kinds = got.column(3), got.column(4)
    assert [html_main._blocks(x, k) for x, k in zip(stream.to_pylist(), kinds.to_pylist(), strict=True)] == [read(x or "") for x in pages]
    ones = pa.array([1] * n, pa.int32())
    [packed] = html_main._packed(iter([pa.record_batch([pa.array([0] * n, pa.int64()), ones, ones, longs, stream], ["host", "cell", "cells", "page", "stream"])]))
    assert [x.num_rows for x in html_main._repeated(iter([packed]), 8, 3, 0.01)] == [0]
    grams = pa.concat_tables([pa.Table.from_batches([x]) for x in html_main._grams(iter([pa.record_batch([longs, longs, stream, kinds], ["host", "page", "stream", "kinds"])]), 8)])
    assert grams.column("page").to_pylist() == list(range(n)) and len(grams.column("grams")[5]) == 2 * 40 + 3 - 7
    assert grams.column("within")[5].as_py() == [i not in (0, 41) for i in range(76)] and set(grams.column("touches")[0].as_py()) == {0, 1}
    assert not any(any(x) for x in grams.column("touches").to_pylist()[1:5])  # too short for a run
    found = pa.array([None] * n, pa.list_(pa.struct([("gram", pa.int64()), ("wide", pa.int32())])))
    [out] = html_main._texts(iter([pa.record_batch([longs, stream, kinds, found, longs], ["row", "stream", "kinds", "grams", "n_repeated"])]), 8)
    assert out.column("text").to_pylist() == ["\n\n".join(blocks_of(x or "")[1]) for x in pages]
    assert len(calls) == 2 * n  # n here, and n in the line above


def test_short_word_marks():
    rng = random.Random(3)
    for size in (0, 1, 7, 300, 1 << 19, (1 << 19) + 1):
        data = np.array([rng.choice(b" \t\n\x0b\x0c\rab\x1e\xc3") for _ in range(size)], np.uint8)
        offsets = np.array(sorted([0, size, *(rng.randint(0, size) for _ in range(9))]))
        for a, b in zip(word_marks(data, offsets), short_word_marks(data, offsets), strict=True):
            assert a.tolist() == b.tolist()


def test_without_the_markup_column(spark):
    pages = spark.createDataFrame([(1, "http://a.b/1", "<p>x y</p>")], "page_id long, url string, html string")
    assert [tuple(r) for r in main_text(pages, with_markup=False).collect()] == [(1, "http://a.b/1", "x y", 3, 0)]
