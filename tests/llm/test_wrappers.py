"""Wrappers: pages of several layouts, alignment of expressions, odd rows."""

import html
import random
import re

from tokenloom.llm import wrappers
from tokenloom.llm.queries import QUERIES

SCHEMA = "page_id long, url string, html string"


def run(df):
    got = wrappers.extract(df).collect()
    assert all(r.n_chars == len(r.text) for r in got)
    return {r.page_id: r.text for r in got}


def test_whole_table_against_plain_reading(spark, sf_dir):
    """The given pages have one article each; read it by pattern, tags as block ends."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = {r.page_id: r for r in QUERIES["op13_host_wrappers"](spark, sf_dir).collect()}
    assert len(got) == len(pages)
    for page in pages:
        inside = re.search(r"(?s)<article>(.*?)</article>", page.html or "")
        blocks = re.split(r"</?(?:p|h1)>", inside.group(1)) if inside else []
        plain = [html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")) for b in blocks]
        want = " ".join(" ".join(b.split()) for b in plain if b.split())
        assert got[page.page_id].text == want and got[page.page_id].n_chars == len(want)


def marked_page(rng, words, n):
    """One layout with much around the article, its optional parts chosen at random."""
    some = lambda k: " ".join(rng.choice(words) for _ in range(k))
    main, out = [], ["<!DOCTYPE html><html><head><title>", some(3), "</title><style>p{}</style></head><body>"]
    out.append('<header class="site"><a href="/">Home</a></header><nav><ul>')
    out += [f"<li><a href='/{i}'>{some(1)}</a>" for i in range(rng.randint(2, 6))] + ["</ul></nav>"]
    if rng.random() < 0.5:
        out.append('<div class="cookie-notice"><p>We use cookies</p></div>')
    out.append('<div class="layout with-sidebar"><article class="post">')
    main.append(some(4) + " & more")
    out.append(f"<h1>{html.escape(main[-1])}</h1>")
    for _ in range(rng.randint(1, 6)):
        kind = rng.choice(["p", "p", "open", "list", "quote", "ad", "split"])
        text = some(rng.randint(3, 12))
        if kind == "ad":
            out.append(f'<div class="ad-slot"><p>{text}</p></div>')
            continue
        if kind == "list":
            out.append("<ul><li>" + text + "<li>" + text + "</ul>")
            main += [text, text]
            continue
        main.append(text)
        out.append({
            "p": f"<p>{text.replace(' ', '  <!-- x -->', 1) if ' ' in text else text}</p>",
            "open": f"<p><b>{text}", "quote": f"<blockquote>\n{text}\t</blockquote>",
            "split": "<p>" + text.replace(" ", "<br>", 1) + "</p>",
        }[kind])
    if rng.random() < 0.5:
        out.append("<form><label>Mail</label><input name=q><button>Go</button></form>")
    out.append("</article>")
    if rng.random() < 0.6:
        out.append("<section id='comments'><h2>Comments</h2>")
        out += [f"<article><p>{some(5)}</p></article>" for _ in range(rng.randint(1, 3))] + ["</section>"]
    out.append(f"<aside><p>{some(8)}</p></aside></div><footer>&copy; {some(4)}</footer>")
    out.append("<script>var a = '<p>no</p>';</script>" + rng.choice(["</body></html>", ""]))
    return "".join(out), " ".join(" ".join(m.split()) for m in main)


def test_marked_layout(spark, monkeypatch):
    rng = random.Random(4)
    words = "alpha beta gamma delta über naïve 12 x".split()
    made = [marked_page(rng, words, i) for i in range(120)]
    monkeypatch.setattr(wrappers, "GROUP", 4)  # several rounds of merging
    rows = [(i, f"https://h{i % 2}.example.org/{i}", m[0]) for i, m in enumerate(made)]
    got = run(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert got == {i: m[1] for i, m in enumerate(made)}


def test_unmarked_layout_by_slots(spark):
    """No element names the content: template text goes, the heaviest element stays."""
    rng = random.Random(1)
    words = "one two three four five six seven".split()
    rows, want = [], {}
    for i in range(30):
        body = [" ".join(rng.choice(words) for _ in range(20)) + f" {i}" for _ in range(rng.randint(2, 5))]
        text = "".join(f"<p>{b}</p>" for b in body)
        rows.append((i, "http://plain.example.com/x", f"<div>Our site</div><div><p>Welcome back</p>{text}</div><div>{i}</div>"))
        want[i] = " ".join(body)
    # The first paragraph of all pages is the same, but folds into the repeated one.
    got = run(spark.createDataFrame(rows, SCHEMA))
    assert {i: t.removeprefix("Welcome back ") for i, t in got.items()} == want


def test_broadcast_and_salted_join_agree(spark, monkeypatch):
    rng = random.Random(9)
    made = [marked_page(rng, ["a", "bc", "d"], i) for i in range(20)]
    df = spark.createDataFrame([(i, "http://a.b/c", m[0]) for i, m in enumerate(made)], SCHEMA)
    first = run(df)
    monkeypatch.setattr(wrappers, "BROADCAST_CHARS", 0)
    assert run(df) == first


def test_odd_rows(spark):
    deep = "<div>" * 3000 + "<article><p>deep</p></article>"
    long = "<article>" + "<p>word word</p>" * 50_000 + "</article>"
    rows = [
        (1, None, None), (2, "no host", ""), (3, "http://a/1", None), (None, "http://a/2", "<article>x</article>"),
        (5, "http://A/3", "plain text, no tags"), (6, "http://b/", "<article>a &am; &lt;b&gt; &nbsp; c &#x41;</article>"),
        (6, "http://b/", "<article>second &amp</article>"), (7, "http://c/", "<script>x"), (8, "http://c/", "<!-- open"),
        (9, "http://d/", "< 3 <article><p class='a>b'>5 < 6</p><img alt='q>'> t<i>ai</i>l</article"),
        (10, "http://e/", deep), (11, "http://f/", long), (12, "http://g/", "<article><p title=\"open>text</p></article>"),
        (13, "http://h/", "<nav>only</nav>"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.page_id or 0, r.text) for r in wrappers.extract(df).collect())
    assert got == sorted([
        (0, "x"), (1, ""), (2, ""), (3, ""), (5, "plain text, no tags"), (6, "a &am; <b> c A"), (6, "second &"),
        (7, ""), (8, ""), (9, "5 < 6 t ail".replace("t ail", "tail")), (10, "deep"),
        (11, " ".join(["word word"] * 50_000)), (12, "text"), (13, ""),
    ])
    clashing = df.selectExpr("*", "'h' AS host", "1 AS expression", "2 AS slots", "3 AS of", "4 AS text")
    assert sorted((r.page_id or 0, r.text) for r in wrappers.extract(clashing).collect()) == got


def test_empty(spark):
    assert run(spark.createDataFrame([], SCHEMA)) == {}


def test_alignment_keeps_what_only_one_side_has():
    def made(source):
        tree, texts = wrappers.page_tree(source)
        return wrappers.expression(tree), wrappers.json.dumps(wrappers.slot_figures(tree, texts))

    text, slots = wrappers.align(
        made("<div>Menu</div><h1>A</h1><p>x</p>"),
        [made("<div>Menu</div><p>y</p><p>z</p><table><tr><td>1</table>")],
    )
    tree = wrappers.loaded(text)
    marks = [(c[0], c[1], c[2]) for c in tree[3]]
    assert marks == [
        ("div", False, False), ("h1", True, False), ("p", False, True), ("table", True, False)
    ]
    assert [s["same"] for s in wrappers.json.loads(slots)] == ["Menu", "A", None, "1"]


def test_recurring_runs_fold_into_a_group():
    tree, texts = wrappers.page_tree("<dl><dt>a<dd>b<dt>c<dd>d</dl>")
    (group,) = tree[3][0][3]
    assert group[0] == "(dt,dd)" and group[2]
    assert [leaf[4] for leaf in wrappers.leaves(tree)] == [[0, 2], [1, 3]]
