"""Periodic runs, conversation repair and page text against brute force, on small tables with nulls, ties and repeated rows."""

import heapq
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import conversation_repair, periodic, site_text

# 11 -----------------------------------------------------------------------------------------------------------------


def plain_runs(w, exponent=4, length=6):
    """All maximal stretches of each period, of one place the smallest period."""
    found, n = {}, len(w)
    for p in range(1, n // exponent + 1):
        start = 0
        for k in range(n - p + 1):
            if k == n - p or w[k] != w[k + p]:
                size = k - start + p
                if size >= max(length, exponent * p) and k > start:
                    found.setdefault((start, size), p)
                start = k + 1
    return sorted((a, b, p) for (a, b), p in found.items())


def periodic_text(r):
    out = []
    for _ in range(r.randint(0, 5)):
        out += [r.choice("abc") for _ in range(r.randint(0, 12))]
        out += [r.choice("abcd") for _ in range(r.randint(1, 9))] * r.randint(1, 9)
    return out


@pytest.mark.parametrize("exponent,length", [(4, 6), (2, 1), (3, 10)])
def test_runs_equal_brute_force(exponent, length):
    r = random.Random(exponent)
    for _ in range(300):
        w = [x.encode() for x in periodic_text(r)]
        assert [tuple(x) for x in periodic.runs_of(w, exponent, length).tolist()] == plain_runs(w, exponent, length), w


def test_runs_do_not_depend_on_appends():
    r = random.Random(5)
    for _ in range(100):
        w = [x.encode() for x in periodic_text(r)]
        catchers, at = periodic.Catchers(2, 2), 0
        while at < len(w):
            step = r.randint(1, 7)
            catchers.append(w[at : at + step])
            at += step
        assert [tuple(x) for x in catchers.finish().tolist()] == plain_runs(w, 2, 2)


def test_runs_of_equal_hashes(monkeypatch):
    plain = periodic._names
    monkeypatch.setattr(periodic, "_names", lambda words, seed: plain(words, seed) if seed > 1 else np.zeros(len(words), np.uint64))  # at first all words look alike
    w = [x.encode() for x in "x y a b a b a b a b c d d d d d d e f g".split()]
    assert [tuple(x) for x in periodic.runs_of(w).tolist()] == plain_runs(w)


def test_long_text_of_one_word():
    w = [b"a"] * 300_000
    assert periodic.runs_of(w).tolist() == [[0, 300_000, 1]]
    assert periodic.collapsed(w, periodic.runs_of(w)) == b"a"


def test_periodic_runs_table(spark):
    r = random.Random(8)
    texts = [None, "", " \n", "a", "a a a a a a", "é é é é é é b", "a b " * 40, *[" ".join(periodic_text(r)) for _ in range(30)], "x x x x x x", "x x x x x x"]
    docs = spark.createDataFrame([(k if k else None, t, -1, "clash") for k, t in enumerate(texts)], "doc_id long, text string, runs int, collapsed string")
    got = sorted(((x["doc_id"] or 0, [tuple(y) for y in x["runs"]], x["collapsed"]) for x in periodic.periodic_runs(docs).collect()))
    for (k, runs, text), t in zip(got, texts, strict=True):
        w = (t or "").split()
        assert runs == plain_runs(w)
        gone = {k for a, n, p in runs for k in range(a + p, a + n)}
        assert text == " ".join(x for k, x in enumerate(w) if k not in gone)
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_looped(spark):
    texts = [None, "", "a", "a b c d e f g h i j k l m n o p q r s t"] * 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for k, text in docs.select("doc_id", periodic.looped(F.col("doc_id"), F.col("text"))).collect():
        h, w = zlib.crc32(str(k).encode()), (texts[k] or "").split()
        if h % 10 or not w:
            assert text == texts[k]
            continue
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        assert text.split() == [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


# 12 -----------------------------------------------------------------------------------------------------------------


def cheapest(turns):
    """Cost and least audit, by search over all edits in order of (cost, audit): turns are (initial, must go, truncated)."""
    states = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    made = {"": "u", "s": "u", "u": "a", "a": "u"}
    queue, seen = [(0, "", 0, "")], set()
    while queue:
        cost, audit, k, state = heapq.heappop(queue)
        if k == len(turns) and state in ("", "a"):
            return cost, audit
        if len(audit) > 2 * len(turns) + 2 or (audit, k, state) in seen:
            continue
        seen.add((audit, k, state))
        heapq.heappush(queue, (cost + 2, audit + "I", k, made[state]))
        if k < len(turns):
            initial, must, cut = turns[k]
            heapq.heappush(queue, (cost + 3, audit + "D", k + 1, state))
            if not must:
                heapq.heappush(queue, (cost + 2 + cut, audit + "R", k + 1, made[state]))
                if initial in states[state]:
                    heapq.heappush(queue, (cost + cut, audit + "K", k + 1, states[state][initial]))


def plain_repair(rows):
    """rows: (turn, role, text), in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        blank = not re.search(r"[^\x20\x09-\x0D]", text)
        again = (role, text) in seen
        seen.add((role, text))
        last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
        faults.append("blank" if blank else "duplicate" if again else "truncated" if last not in tuple(".!?") else "")
    numbers = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] for _, r, _ in rows]
    cost, audit = cheapest([(i, f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, faults)])
    turns, at = [], 0
    for x in audit:
        if x == "I":
            turns.append((None, ""))
            continue
        if x != "D":
            turns.append((rows[at][1] if x == "K" else None, rows[at][2]))
        at += 1
    first = 1 if turns and (turns[0][0] or "")[:1] == "s" else 0
    turns = [(role or ("user", "assistant")[(k - first) % 2], text) for k, (role, text) in enumerate(turns)]
    return {
        "gaps": max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "cost": cost, "audit": audit, "turns": turns,
    }


def some_turns(r, most=7):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    return [(r.choice([None, 0, 1, 1, 2, 3, 7, 9]), r.choice(roles), r.choice(["Yes.", "No!", "cut", " ", "", None, "a b.", "Ok?\n", "x ", "é…"])) for _ in range(r.randint(1, most))]


@pytest.mark.parametrize("long", [2, 10_000])
def test_repair(spark, long):
    import hashlib

    r = random.Random(12)
    given = {k if k else None: some_turns(r) for k in range(60)}
    rows = [(k, *t, True, "x") for k, v in given.items() for t in v] + [(99, 1, "user", "gone", False, "x"), (5, 3, "user", "gone", False, "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, present boolean, audit string").repartition(3)
    got = {x["conv_id"]: x.asDict() for x in conversation_repair.repair(table, present="present", long=long).collect()}
    assert set(got) == {*given, 99}
    given[99] = []
    for k, v in given.items():
        spaced = [(t, " " if a is None else a, " " if b is None else b) for t, a, b in v]
        ordered = sorted(spaced, key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).hexdigest()))
        want = plain_repair(ordered)
        assert {c: [tuple(t) for t in got[k][c]] if c == "turns" else got[k][c] for c in want} == want, (k, ordered)


def test_repair_of_a_long_conversation(spark):
    """Most rows are one conversation's, which is repaired in pieces as it is at once."""
    r = random.Random(3)
    rows = [(1, k, r.choice(["user", "assistant", "system"]), f"t{r.randint(0, 1500)}" + r.choice(["", ".", ".", "."])) for k in range(2000)] + [(2, 0, "user", "a."), (0, 0, "user", "a.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    a, b = ({x["conv_id"]: x.asDict() for x in conversation_repair.repair(table, long=n).collect()} for n in (50, 10_000))
    marks = [(t, role, text, False, text[-1:] != ".") for _, t, role, text in rows[:2000]]
    want = conversation_repair._report(marks)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    assert a == b and [a[1][c] for c in names] == list(want[:7]) and [t.asDict() for t in a[1]["turns"]] == want[7]


def test_repair_of_an_empty_table(spark):
    assert conversation_repair.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# 13 -----------------------------------------------------------------------------------------------------------------

PAGES = [
    ("<article><h1>A &amp; B</h1><p>one\n two&nbsp;three<p>four <b>five<br>six</b></article>", "A & B\none two three\nfour five six"),
    ("<nav>menu</nav><div class='ad'>buy</div><p>x<script>var a='<p>no</p>';</script>y</p><!-- c --><footer>f</footer>", "xy"),
    ("<main><p>m</p><aside>s</aside><ul><li>i<li>j</ul></main><p>outside</p>", "m\ni\nj"),
    ('<article class="comment"><p>reader</p></article><div class="content with-sidebar"><article><p>main</p><section id="comments">c</section></article></div>', "main"),
    ("<p>a<div>b</div>c</p>d", "a\nb\nc\nd"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("<p title='a > b'>t</p><textarea>no</textarea><form>no</form><style>p{}</style>", "t"),
    ("plain &lt;text&gt; 1 < 2", "plain <text> 1 < 2"),
    ("<p>open <b>bold<p>next</b> end", "open bold\nnext end"),
    ("<article><p>x</p><script>unclosed", "x"),
    ("x<!-- > open <p>no", "x"), ("x<!-- open", "x"), ("", ""), (None, ""), ("<p></p>", ""), ("<article></article><p>no</p>", ""),
]


def test_pages_of_their_own_sites(spark):
    pages = spark.createDataFrame([(k, f"http://h{k}.org/", h, "x") for k, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = dict(site_text.main_text(pages).select("page_id", "text").collect())
    assert [got[k] for k in range(len(PAGES))] == [t for _, t in PAGES]


def site(k, host, body, copy=None):
    c = k if copy is None else copy
    return (k, f"https://{host}/p{k}", f"<body><div><b>{host}</b> <span>since 1999</span></div>{body % {'k': c}}<div><p>all rights of {host}</p></div></body>")


@pytest.mark.parametrize("sent", [0, site_text.SENT])
def test_template(spark, sent):
    """Menus without names go where they recur; what an article shares with others, copies and small sites' blocks stay."""
    article = "<article><p>text %(k)s of the article, its longest block</p><div>read also: x</div><p>a license line</p></article>"
    bare = "<div><p>text %(k)s of a page without an article, its longest block</p></div>"
    rows = [site(k, "big.org", article) for k in range(8)] + [site(k, "big.org", article, 77) for k in range(8, 20)]
    rows += [site(k, "bare.org:80", bare) for k in range(20, 30)] + [site(k, "small.org", bare) for k in range(30, 34)] + [site(k, "same.org", bare, 7) for k in range(34, 50)]
    rows += [(50, None, "<p>alone</p>"), (51, "no url", "<p>alone</p>"), (51, "no url", "<p>alone</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {}
    for r in site_text.main_text(pages, sent=sent).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
    assert len(got[51]) == 2 and got[50] == ["alone"]
    for k in range(20):
        assert got[k] == [f"text {k if k < 8 else 77} of the article, its longest block\na license line"]
    for k in range(20, 30):
        assert got[k] == [f"text {k} of a page without an article, its longest block"]
    for k, host, c in [(k, "small.org", k) for k in range(30, 34)] + [(k, "same.org", 7) for k in range(34, 50)]:
        assert got[k] == [f"{host} since 1999\ntext {c} of a page without an article, its longest block\nall rights of {host}"]


def test_pages_of_odd_markup():
    for source in ("<" * 100_000, "<a" * 100_000, "<a'" * 100_000 + ">",  "<p>" * 3000, "</p>" * 100, "<div>" * 3000 + "x", "<a title='" * 500, "&#xD800; &#0; &nope; &amp", "<p/>x<br/>y", "<P CLASS=ad>x</P>y"):
        page = site_text.parse(source)
        assert len(page.tags) == len(page.hashes) and isinstance("\n".join(site_text.blocks(page, *site_text.outline(page))), str)


# What was mended ----------------------------------------------------------------------------------------------------


def test_no_two_rows_share_a_number(spark, monkeypatch):
    from foliant.llm import minhash

    plain = minhash._row_hash
    monkeypatch.setattr(minhash, "_row_hash", lambda key, text, seed: plain(key, text, seed) % 2 if seed < 2 else plain(key, text, seed))
    docs = spark.createDataFrame([(k, f"a text of its own {k * k} {k} {k + 7} and so on {k}") for k in range(12)] + [(3, "a text of its own 9 3 10 and so on 3")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in minhash.one_of_each(docs).collect()) == list(range(12))


def test_scopes_delete_their_own_tables(spark):
    from foliant.llm import sharding
    from foliant.shared import cut, scope

    docs = spark.createDataFrame([(k, f"t {k}") for k in range(9)], "doc_id long, text string")
    before = sharding.shard(docs, 3)
    with scope(spark):
        inner = cut(docs, "inner")
        assert inner.count() == 9
    assert before.count() == 9
    with pytest.raises(Exception, match="(?i)exist"):
        inner.count()


def test_own_columns_of_the_mix_stay(spark):
    from foliant.llm import mixing

    docs = spark.createDataFrame([(k, "a b c d", f"s{k % 2}", 77, "own") for k in range(6)], "doc_id long, text string, source string, size int, target string")
    got = mixing.mixed_rows(docs).collect()
    assert got and {(r["size"], r["target"]) for r in got} == {(77, "own")}


def test_nearest_gives_k(spark):
    from foliant.llm import nearest

    rng = np.random.default_rng(1)
    x = rng.normal(size=(1000, 8))
    x[500:599] = x[0]
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = vectors.where("vec_id in (0, 7)")
    got = nearest.nearest(nearest.build_index(vectors, depth=400), asked, k=400).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in got} == {0: 400, 7: 400}
    with pytest.raises(ValueError, match="built for 5"):
        nearest.nearest(nearest.build_index(vectors, depth=5), asked, k=50)
    found = {r["vec_id"] for r in nearest.nearest(nearest.build_index(vectors, depth=99), vectors.where("vec_id = 0").selectExpr("vec_id", "transform(embedding, v -> v) AS embedding"), k=99).where("query_id = 0").collect()}
    score = x @ x[0]
    best = set(np.lexsort((np.arange(1000), -score))[:100].tolist()) - {0}
    assert len(found & best) >= 95
