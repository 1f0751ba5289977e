import hashlib
import random

import pytest
from pyspark.sql import functions as F

from genoloom.llm import chat, html_text, url_filter


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var a="</p><p>no";</script></head>
<body><header><p>site</p></header><nav><ul><li><a href="/a">one</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article class="post"><h1>Head &lt;1&gt;</h1><p><b>Bold text<br>more&nbsp;&#233; &amp;amp;<p>Next
 para</p><div class="ad">buy</div><form><p>mail</p></form><aside>side</aside><p>Last <a href="x">link</a>.</p>
<section id="comments"><p>a reader</p></section></article><div class="sidebar">other</div><footer>f</footer>"""


def test_article():
    assert html_text.main_text(PAGE) == "Head <1> Bold text more é &amp; Next para Last link."
    assert html_text.main_text(None) == "" == html_text.main_text("") == html_text.main_text("<p>  </p>")
    assert html_text.main_text("<article><p>unclosed <b>x") == "unclosed x"
    assert html_text.main_text("<article><p title=\"a>b\">q</p><!-- <p>no</p> --></article>") == "q"


BODY = "the main text of this page is not in the element and it has the words that a text of its length has to have " * 3


def test_rules_hold_on_pages_with_an_article_element():
    page = f"<article><p>a teaser</p></article><div><p>{BODY}</p></div><div>Buy now !!! 50 % {'offer ' * 40}</div>"
    assert html_text.main_text(page) == f"a teaser {BODY.strip()}"
    # a menu within the element goes by its links, a short line beside it with it
    page = f"<main><div><a href=x>One of the pages</a> <a href=y>and another of them</a></div><div>More</div><div><a href=z>and the last of them</a></div><p>{BODY}</p><p>end</p></main>"
    assert html_text.main_text(page) == f"{BODY.strip()} end"


def test_stop_words_decide(monkeypatch):
    names = "Alder Birch Cedar Dogwood Elm Fir Ginkgo Hazel Ironwood Juniper Katsura Larch Maple " * 4
    page = f"<div><p>{BODY}</p><p>short</p></div><div>{names}</div><div>also</div>"
    mixed = f"<article><p>{BODY}</p><p>{names}</p></article><div>{names}</div><div>{BODY}</div>"
    assert html_text.main_text(page) == f"{BODY.strip()} short"
    assert html_text.main_text(mixed) == f"{BODY.strip()} {names.strip()} {BODY.strip()}"
    monkeypatch.setattr(html_text, "STOP_WORDS", frozenset())
    assert html_text.main_text(page) == html_text.main_text(mixed) == ""


def test_attributes_are_read_by_their_names():
    keep = ['data-id="ad"', 'data-role="form"', 'class="share-price"', 'title="class=ad"', "data-x='id=\"menu\"'", 'class="headered"']
    assert html_text.main_text("".join(f"<p {a}>t{k}</p>" for k, a in enumerate(keep))) == " ".join(f"t{k}" for k in range(len(keep)))
    drop = ['class="ad"', "id=comments", 'class="x site-header"', "CLASS='Cookie-Notice'", "hidden", 'aria-hidden="true"', 'role="navigation"', 'class="ad-slot-2"']
    assert html_text.main_text("".join(f"<p {a}>t</p>" for a in drop) + "<p>in</p>") == "in"


def test_without_an_article_element():
    body = "The house was on the hill and it was the one that we had in the town for all of the years. " * 4
    page = f"<div><a href='/'>Home</a> <a href='/b'>About us here</a></div><h2>Short</h2><p>{body}</p><p>Tail.</p><div><a href='q'>x y z</a></div><div>Imprint</div>"
    assert html_text.main_text(page) == f"Short {body.strip()} Tail."
    assert html_text.classify([("x", 0, False, False), ("y", 0, True, False)]) == [True, False]


def test_very_long_page_and_empty_table(spark):
    page = "<article>" + "<p>the one of the many that is in it</p>" * 60_000 + "</article>"
    rows = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    assert html_text.extract(rows).first()["n_chars"] == 60_000 * 34 - 1
    assert html_text.extract(rows.where("false")).count() == 0


def test_extract_rows(spark):
    rows = spark.createDataFrame([(1, "u", PAGE, "clash"), (None, None, None, "c"), (1, "u", PAGE, "clash")], "page_id long, url string, html string, text string")
    got = html_text.extract(rows).collect()
    assert [r["n_chars"] for r in got] == [len(html_text.main_text(PAGE)), 0, len(html_text.main_text(PAGE))] and got[1]["text"] == ""


def test_rules_and_parts(spark):
    urls = ["http://Www.Example.com/en/1", "https://a.example.com/en/2?x", "http://example.com", "http://x.net/es/#a", "http://net/fr/", "http://notnet/fr/", "a/b", None, "s://h?://x", "http://b.org/en/"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(rows).collect()}
    assert [got[i]["rule"] for i in range(10)] == ["www.example.com/en/", "example.com/en/", None, "net/es/", "net/fr/", None, None, None, None, None]
    assert [got[i]["verdict"] for i in range(5)] == ["allow", "block", "allow", "block", "block"]
    assert (got[0]["host"], got[0]["path"]) == ("www.example.com", "/en/1") and (got[8]["host"], got[8]["path"]) == ("h", "")
    assert got[7]["host"] == got[7]["path"] == "" and got[7]["verdict"] == "allow"
    assert url_filter.filter_urls(rows.where("false")).count() == 0


def test_model_is_a_distribution_and_tells_classes(spark):
    rows = [(i, f"http://a{i % 7}.com/news/{i}") for i in range(150)] + [(1000 + i, f"http://b{i % 5}.net/es/win-{i}") for i in range(150)] + [(5000, "http://q.org/news/5"), (5001, "http://q.org/es/win-9")]
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[5000] == "allow" and got[5001] == "block"
    m = url_filter.Model({"a": 3, "b": 1, "ab": 2, "aa": 1}, 1)
    assert sum(m.p("a", chr(i)) for i in range(256)) == pytest.approx(1)
    cut = url_filter.Model({"a": 3, "aa": 2}, 1, contexts={"": (9, 4), "a": (3, 2)})
    assert sum(cut.p("a", chr(i)) for i in range(256)) == pytest.approx(1)
    assert cut.p("a", "a") == pytest.approx((2 + 3 * cut.p("", "a")) / 5) and cut.p("", "a") == pytest.approx((3 + 10 / 256) / 13)


def test_counts_of_contexts_are_those_of_all_runs(spark):
    urls = [f"http://a{i % 7}.com/n/{i}" for i in range(60)]
    rows = spark.createDataFrame([(u, False) for u in urls] + [("http://b.net/x", True)], "url string, bad boolean")
    seen = {}
    for u in urls:
        x = "\x02\x02" + url_filter._symbols(u) + "\x03"
        for i in range(2, len(x)):
            for k in range(3):
                of = seen.setdefault(x[i - k : i], {})
                of[x[i]] = of.get(x[i], 0) + 1
    few, _ = url_filter.train(rows, order=2, max_grams=20)
    assert len(few.grams) == 20
    for x, (total, shorter) in few.weights.items():
        kept = sum(n for g, n in few.grams.items() if g[:-1] == x)
        assert total == sum(seen[x].values()) + len(seen[x]) and total - shorter == kept
        assert sum(few.p(x, chr(i)) for i in range(256)) == pytest.approx(1)


def test_runs_beyond_the_bound_count_too(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(8))
    urls = [f"http://{word()}.com/{word()}" for _ in range(80)] + [f"http://{word()}.net/es/{word()}" for _ in range(80)] + [f"http://{word()}.org/{word()}" for _ in range(40)]
    rows = spark.createDataFrame([*enumerate(urls), (500, None), (501, ""), (None, urls[0]), (0, urls[0]), (502, "http://É.com/" + "x" * 3000)], "page_id long, url string").repartition(3)
    of = lambda n: sorted(map(repr, url_filter.filter_urls(rows, max_grams=n).collect()))
    assert of(10) == of(200_000)


def test_odd_urls(spark):
    rows = [(None, "http://a.com/x", 1), (1, "", 2), (1, "", 2), (2, "http://a.com/" + "x" * 200_000, 3), (3, "http://a.com/" + "x" * 200_000, 3), (4, "http://casino.net/é", 4)]
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host int")).collect()
    assert len(got) == 6 and got[0]["page_id"] is None
    by = {r["page_id"]: r for r in got}
    assert len(by[2]["path"]) == 200_001 and (by[2]["verdict"], by[2]["ratio"]) == (by[3]["verdict"], by[3]["ratio"]) and by[1]["verdict"] == "allow"


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "\\.\\", "[[INST]INST]", "", None, "é<|text|>", "<\\.s>", "x [/INST"]
    rows = [(1, i, i - 1 if i else None, "assistant" if i % 2 else "us\\er<s>", t, 0.0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, role string, text string, score double")
    r = chat.format_trees(df).withColumn("turns", chat.parse(F.col("formatted"))).first()
    assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[3], x[4] or "") for x in rows]
    assert [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]] == [e for e in ["\\\\.\\\\", "", "é<\\.|text|>", "x [/INST"]]


def test_reply_trees(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 5.0), (1, 4, 2, "user", "u", 9.0), (1, 5, 4, "assistant", "v", None), (1, 6, 3, "user", "w", 1.0),
            (2, 1, 2, "user", "loop", 0.0), (2, 2, 1, "user", "loop", 0.0), (3, 7, 99, "user", "orphan", 1.0), (3, 7, 99, "user", "orphan", 1.0), (None, 1, None, "user", "x", 0.0)]
    df = spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, role string, text string, score double")
    got = {(r["tree_id"], r["rank"]): (r["score"], [t["text"] for t in r["t"]]) for r in chat.format_trees(df, 2).select("*", chat.parse(F.col("formatted")).alias("t")).collect()}
    assert got == {(1, 1): (10.0, ["q", "a", "u", "v"]), (1, 2): (6.0, ["q", "b", "w"]), (3, 1): (1.0, ["orphan"])}
    assert chat.format_trees(df.where("false")).count() == 0


def test_chat_query(spark, data):
    got = {r["conv_id"]: r for r in chat.op1_chat(spark, data).collect()}
    t = "</s>[INST] ok [/INST]"
    assert got[-1]["turns_sha256"] == hashlib.sha256(f"user\n{t}\nassistant\n{t}\n".encode()).hexdigest()
    assert got[-1]["loss_sha256"] == hashlib.sha256(t.encode()).hexdigest() and got[-1]["loss_chars"] == len(t)


def test_side_replies_at_every_level(spark):
    """A thread with a side reply at each message, a circle with a branch, repeats and a column that is not asked for."""
    rng = random.Random(3)
    rows, depth = [], 21
    for t in (1, 2):
        for i in range(depth):
            rows.append((t, 2 * i, 2 * i - 2 if i else None, "user", f"m{i}", float(rng.randint(-3, 3)), "x"))
            rows.append((t, 2 * i + 1, 2 * i, "assistant", f"s{i}", float(rng.randint(-3, 3)), "x"))
    rows += [(3, 1, 2, "user", "a", 1.0, "x"), (3, 2, 1, "user", "b", 1.0, "x"), (3, 3, 1, "user", "c", 1.0, "x")]
    rows += rows[:5] + [(None, 1, None, "user", "n", 0.0, "x"), (4, 7, 99, None, None, None, "x")]
    trees = spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, role string, text string, score double, path string")
    got = {}
    for r in chat.format_trees(trees, top_k=4).withColumn("turns", chat.parse(F.col("formatted"))).collect():
        got[r["tree_id"], r["rank"]] = (r["leaf_id"], r["score"], [x["text"] for x in r["turns"]])
    want = {(4, 1): (7, 0.0, [""])}
    for t in (1, 2):
        of = {r[1]: r for r in rows if r[0] == t}
        found = []
        for leaf in set(of) - {r[2] for r in of.values()}:
            path, at = [], leaf
            while at is not None:
                path.append(of[at])
                at = of[at][2]
            found.append((-sum(r[5] for r in path), leaf, [r[4] for r in reversed(path)]))
        want |= {(t, k + 1): (leaf, -s, texts) for k, (s, leaf, texts) in enumerate(sorted(found)[:4])}
    assert got == want
    assert chat.format_trees(trees.where("false")).count() == 0
