import html
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tsforge.llm import page_template, queries
from tsforge.llm.page_blocks import read_page

SCHEMA = "page_id long, url string, html string"


def texts(page):
    return page_template.main_text(page)


@pytest.mark.parametrize(("page", "want"), [
    ("", []),
    ("plain text  only\n here", ["plain text only here"]),
    ("<p>a<p>b <b>c</b>d<br>e", ["a", "b cd e"]),
    ("<article><h1>T &amp; U</h1><p>x&nbsp;&#8217;y<!-- <p>no --></p></article><footer>f</footer>", ["T & U", "x ’y"]),
    ("<nav>n</nav><header>h</header><main><header><h1>T</h1><p>by me</p></header><p>x</p><aside>s</aside></main>", ["T", "x"]),
    ("<article><p>x<script>var a='</p><p>no';</script> y</p><style>p{}</style><form>f<input value='>'></form></article>", ["x y"]),
    ("<article><p>x</p><section class='post-comments'><p>no</p></section><article>reply</article><div id=\"cookieNotice\">no</div></article>", ["x"]),
    ("<body class='has-sidebar'><div class='sidebar'>no</div><div class='no-sidebar text'>yes</div><div role='navigation'>no</div><p hidden>no</p>", ["yes"]),
    ("<div><ul><li><a href='/1'>one</a><li><a href='/2'>two</a></ul><p>see <a href='/3'>three</a> and more words</p></div>", ["see three and more words"]),
    ("<article><table><tr><td>a<td>b<tr><td>c</table>tail <unknown>z</unknown></article>", ["a", "b", "c", "tail", "z"]),
    ("<article><p>1 < 2 && 3 > 2</p><p title='a>b' class=\"x>y\">q</p><p class=\"open>r</p></article>", ["1 < 2 && 3 > 2", "q", "r"]),
    ("<head><title>t</title><p>in body<article>x</article>", ["x"]),
    ("<article>a<!-- open", ["a"]),
    ("<article>a<script>open", ["a"]),
    ("<article>a<p class='open", ["a"]),
    ("<ARTICLE><P>a<UL><LI>b<LI>c</UL></ARTICLE>", ["a", "b", "c"]),
    ("<article><p>x <span class='ad'>buy</span> y <button>no</button> z</p></article>", ["x y z"]),
])
def test_pages_by_themselves(page, want):
    assert texts(page) == want


def site(rnd, k, marked=True):
    """A page of a host: constant menu, a notice without a telling name, and an article of its own words."""
    say = lambda n: " ".join(rnd.choice(["lorem", "ipsum", "dolor", "été", "a&b", "x<y"]) + str(rnd.randrange(1000)) for _ in range(n))
    own = [say(rnd.randint(3, 30)) for _ in range(rnd.randint(1, 5))]
    inner = "<p>Read it in our reader</p>" + "".join(f"<p>{html.escape(x)}</p>" for x in own)
    body = f"<article>{inner}</article>" if marked else f"<div class='text'>{inner}</div>"
    return (f"<html><body><div class='x1'><a href='/{k}'>Home</a> <a href='/b'>Books</a></div><div class='x2'>We use your data to help you</div>{body}"
            f"<div class='x3'>Printed in Lyon</div></body></html>"), own


def test_template_text_is_left_out(spark):
    rnd = random.Random(1)
    rows, want = [], {}
    for k in range(60):
        host = ("big.example", "small.example", "plain.example")[0 if k < 30 else 1 if k < 33 else 2]
        page, own = site(rnd, k, host != "plain.example")
        rows.append((k, f"https://user@{host.upper()}:80/{k}", page))
        want[k] = own if host != "small.example" else ["Read it in our reader", *own]  # too few pages for a template
    got = page_template.extract(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    assert {r.page_id: r.text.split("\n") for r in got} == want


def test_copies_of_a_page_stay_whole(spark):
    page, own = site(random.Random(3), 1)
    rows = [(k, "http://copies.example/", page) for k in range(20)]
    got = page_template.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.text for r in got} == {"\n".join(["Read it in our reader", *own])} and len(got) == 20


def brute_templates(pages, least=page_template.LEAST_PAGES):
    """Explicit occurrence vectors; order and nesting by comparing the rounds' places."""
    hosts = defaultdict(list)
    for host, page in pages:
        hosts[host].append(read_page(page)[1])
    out = {}
    for host, streams in hosts.items():
        if len({tuple(b.text for b in read_page(page)[0]) for h, page in pages if h == host}) < least:
            continue
        vectors = defaultdict(list)
        for t in {t for s in streams for t in s}:
            v = tuple(s.count(t) for s in streams)
            if sum(map(bool, v)) >= max(least, len(streams) / 2):
                vectors[v].append(t)
        groups = {v: set(ts) for v, ts in vectors.items() if len(ts) > 1}
        spans = {}
        for v, ts in groups.items():
            units, places = set(), []
            for s in streams:
                at = [i for i, t in enumerate(s) if t in ts]
                seq = [s[i] for i in at]
                cut = [seq[i:i + len(ts)] for i in range(0, len(seq), len(ts))]
                units.update(map(tuple, cut))
                places.append([at[i:i + len(ts)] for i in range(0, len(at), len(ts))])
            if len(units) == 1 and len(set(next(iter(units)))) == len(ts):
                spans[v] = places
        bad = set()
        for v, mine in spans.items():
            for w, theirs in spans.items():
                for a_page, b_page in zip(mine, theirs):
                    for a in a_page:
                        for b in b_page if v != w else ():
                            if b[0] < a[0] < b[-1] < a[-1]:  # the other round ends inside one of mine that began in it
                                bad.add(v)
        out[host] = {t for v in spans if v not in bad for t in groups[v]}
    return out


def deduced(spark, rows):
    streams = page_template.token_streams(page_template.pages_with_hosts(spark.createDataFrame(rows, SCHEMA).repartition(5))).cache()
    got = page_template.templates(streams).collect()
    return {r.host: set(np.frombuffer(bytes(r.everywhere) + bytes(r.often), "<i8").tolist()) for r in got}


def test_templates_equal_brute_force(spark):
    rnd = random.Random(7)
    rows = []
    parts = ["<div class='a'><h2>News</h2><p>of today</p></div>", "<section><h3>Why</h3></section>", "<ul><li>1</li></ul>", "<div>A</div><div>B</div>", "<p>C</p>"]
    for k in range(120):
        mix = [rnd.choice(parts) for _ in range(rnd.randrange(8))] if k % 3 else rnd.sample(parts, len(parts))
        rows.append((k, f"http://h{k % 4}.example/", "<html><body><h1>Top</h1>" + "".join(mix) + f"<p>own {k}</p><div class='end'>End</div></body></html>"))
    want = brute_templates([(f"h{k % 4}.example", page) for k, _, page in rows])
    got = deduced(spark, rows)
    assert got == {h: t for h, t in want.items() if t}
    assert all(len(t) > 3 for t in got.values())


def test_given_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = {r.page_id: (r.text, r.n_chars) for r in queries.op12_page_templates(spark, sf).collect()}
    want = {}
    for i, _, page in rows:
        inner = re.search(r"<article>(.*?)</article>", page or "", re.S)
        parts = re.split(r"</?(?:p|h1)>", inner[1] if inner else "")
        lines = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in parts]
        want[i] = "\n".join(x for x in lines if x)
    assert {i: t for i, (t, _) in got.items()} == want
    assert all(n == len(t) for t, n in got.values())
    hosts = [(re.match(r"\w+://([^/?#:]*)", u)[1].lower(), page) for _, u, page in rows]
    assert deduced(spark, rows) == {h: t for h, t in brute_templates(hosts).items() if t}


def test_odd_rows_and_other_join(spark, monkeypatch):
    long = "<article>" + "<p>many words here</p>" * 250_000 + "</article>"  # 5 MB
    rows = [(1, None, None), (2, "no host", ""), (2, "x://h", "<p>a</p>"), (None, "x://h", "<p>b</p>"), (3, "x://h/é", long), *((k, "x://t/", site(random.Random(k), k)[0]) for k in range(4, 20))]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS text", "'q' AS host", "2 AS tokens", "3 AS salt")
    first = sorted((r.page_id, r.url or "", r.text) for r in page_template.extract(df).collect())
    assert [x[:2] for x in first[:4]] == [(1, ""), (2, "no host"), (2, "x://h"), (3, "x://h/é")]
    assert first[0][2] == "" and first[2][2] == "a" and first[3][2].count("\n") == 249_999
    monkeypatch.setattr(page_template, "BROADCAST_BYTES", 0)
    assert sorted((r.page_id, r.url or "", r.text) for r in page_template.extract(df).collect()) == first
    assert page_template.extract(spark.createDataFrame([], SCHEMA)).count() == 0
