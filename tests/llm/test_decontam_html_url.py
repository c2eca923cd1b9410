import hashlib
import re

import pytest

from mutascope.llm import decontam, html, urlrules

from .conftest import make, prose

WORD = "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(t):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def brute(rows, items, width=10):
    patterns = {}
    for i, t in items:
        w = words(t)
        size = min(width, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            patterns.setdefault(tuple(w[k:k + size]), set()).add("null" if i is None else str(i))
    out = []
    for d, t, _ in rows:
        w, hit, found = words(t), set(), set()
        for size in {len(p) for p in patterns}:
            for k in range(len(w) - size + 1):
                ids = patterns.get(tuple(w[k:k + size]))
                if ids:
                    hit |= set(range(k, k + size))
                    found |= ids
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture()
def case(spark, corpus):
    import random
    rng = random.Random(2)
    item = prose(rng, 25).split()
    items = [(1, " ".join(item)), (2, "Unique short item"), (2, "second text of two"), (None, "item without any id"), (10, None), (11, ""),
             (12, "?!"), (13, " ".join(item[5:20])), (9, "unique SHORT item")]
    rows = corpus + [(300, "x " + " ".join(item[:12]).upper() + ", y", "s"), (301, " ".join(item[:9]), "s"),
                     (302, "unique-short... item! unique short", "s"), (303, "éé " + " ".join(item) + " item without any id", "s"),
                     (304, " ".join(item[15:]) + " " + " ".join(item[:15]), "s"), (305, " ".join(item) * 2, "s")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    return make(spark, rows), bench, rows, items


@pytest.mark.parametrize("shard", [decontam.SHARD_BYTES, 60])
def test_contamination_matches_brute_force(case, shard):
    """One automaton, or several shards mapped one after the other."""
    docs, bench, rows, items = case
    got = sorted((tuple(r) for r in decontam.contamination(docs, bench, shard_bytes=shard).collect()), key=str)
    assert got == brute(rows, items)


@pytest.mark.parametrize("width", [1, 2, 3, 5, 10])
def test_blocks_find_every_window(width):
    """Few words, many repeats: each window of each item against a plain search."""
    import random

    import pyarrow as pa
    rng = random.Random(width)
    text = lambda n: " ".join(rng.choice("ab" if width > 3 else "abcdef") for _ in range(n))
    items = [(str(i % 30), text(rng.randint(0, 2 * width + 3))) for i in range(40)]
    rows = [(i, text(rng.randint(0, 60)), "s") for i in range(60)] + [(60, "", "s"), (61, "zz " + items[7][1] + " zz", "s")]
    a = decontam.Automaton(items, width)
    counts, doc, word, owner, item = a.scan(pa.array([t for _, t, _ in rows]))
    for d, n_words, n_hit, n_items, sha, _ in brute(rows, items, width):
        names = sorted(a.names[item[owner == d]])
        assert (counts[d], (doc == d).sum(), len(names)) == (n_words, n_hit, n_items)
        assert hashlib.sha256(",".join(names).encode()).hexdigest() == sha


def test_hit_spans_cover_the_original_words(case):
    docs, bench, rows, _ = case
    text = {d: t for d, t, _ in rows}
    spans = {r.doc_id: [text[r.doc_id][s.start:s.end] for s in r.spans] for r in decontam.hit_spans(docs, bench).collect()}
    assert spans[302] == ["unique-short... item"]
    assert spans[300] == [text[300][2:-3]] and len(spans[303]) == 1


def test_clean_stage(case, spark):
    docs, bench, rows, items = case
    out = decontam.keep_clean(docs, bench)
    assert out.schema == docs.schema
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r[0]) for r in brute(rows, items) if not r[-1])
    nothing = bench.limit(0)
    assert decontam.keep_clean(docs, nothing).count() == docs.count()
    assert decontam.keep_clean(docs.limit(0), bench).count() == 0


# ---- pages ---------------------------------------------------------------------------------------------
LONG = "The house that was on the hill is the one that we have seen from the road, and it is not for sale at all to anyone."
PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- c --><div class="ad">Buy the thing that is on sale now.</div>
<div class="cookie-notice">We use the cookies of this site and that is it.</div><article><h1>Head &amp; line</h1><p><b>Short.<br><p>%s</p>
<ul><li>One&nbsp;item</li><li>two</li></ul><p>x &lt; y</p><form><p>Your mail</p><input></form><div class="share">Share this</div></article>
<section id="comments"><p>%s</p></section><aside>%s</aside><footer>&copy; the owner of the site</footer></body></html>""" % (LONG, LONG, LONG)


def test_article_is_extracted():
    assert html.main_text(PAGE) == f"Head & line Short. {LONG} One item two x < y"


def test_pages_without_an_article_use_densities():
    page = f"<body><ul><li><a href=x>Home and more of the links</a></li></ul><h2>Title</h2><p>{LONG}</p><p>Short end</p><p>{LONG}</p><div>Lorem xyz {'qwe ' * 40}</div>"
    assert html.main_text(page) == f"Title {LONG} Short end {LONG}"


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<script>", "</div></p>", "<!-- x", "&amp", "<p title=\"x>", "<article>"])
def test_odd_pages_do_not_fail(page):
    assert isinstance(html.main_text(page), str)


def test_truncated_and_unclosed():
    assert html.main_text("<article><p>one two</p><p>half a senten") == "one two half a senten"
    assert html.main_text("<article><div><p>a &am") == "a &am"
    assert len(html.main_text("<article>" + f"<p>{LONG}</p>" * 3000)) == 3000 * (len(LONG) + 1) - 1


def test_extract_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "", "x"), (1, "u", PAGE, "x")],
                                  "page_id long, url string, html string, text string")
    rows = sorted(map(str, ((r.page_id, r.n_chars, r.text == html.main_text(PAGE)) for r in html.extract(pages).collect())))
    n = len(html.main_text(PAGE))
    assert rows == sorted(map(str, [(1, n, True), (1, n, True), (2, 0, False), (None, 0, False)]))
    assert html.extract(pages.limit(0)).collect() == []


def test_every_synthetic_page_gives_its_article(spark):
    """On the given pages the article element holds the whole main text."""
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    from html import unescape
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        want = " ".join(unescape(re.sub(r"<[^>]*(>|\Z)", " ", article)).split())
        assert html.main_text(r.html) == want


def agreement(change):
    """Share of the given pages whose text is the article's, after ``change`` to the markup."""
    from html import unescape

    import pyarrow.parquet as pq
    good, pages = 0, pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column("html").to_pylist()
    for page in pages:
        page = re.sub(r"<(script|style)\b.*?</\1>", "", page, flags=re.S)
        want = " ".join(unescape(re.sub(r"<[^>]*(>|\Z)", " ", change(re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]))).split())
        good += html.main_text(change(page)) == want
    return good / len(pages)


def unnamed(page):
    return re.sub(r"<(/?)article>", r"<\1div>", page)


def ciphered(page):
    """Every letter of the text replaced: a language that no stop-word list knows."""
    def letters(m):
        if m[0][0] in "<&":
            return m[0]
        return "".join(chr(0x430 + ord(c.lower()) * 7 % 32) if c.isalpha() else c for c in m[0])
    return re.sub(r"<[^>]*>?|&[a-z]+;|[^<&]+", letters, page)


def test_rules_decide_without_the_article_element():
    assert agreement(unnamed) >= 0.95


def test_language_without_a_list():
    assert agreement(ciphered) >= 0.99
    assert agreement(lambda page: unnamed(ciphered(page))) >= 0.95


def test_link_lists_in_an_article_and_prose_beside_it():
    links = "<ul>" + "<li><a href=x>Another story of the day that is to be read by all of them in the morning hours</a></li>" * 4 + "</ul>"
    page = f"<body><div>{LONG}</div><div>{LONG}</div><article><p>{LONG}</p>{links}<h2>Line</h2><p>{LONG}</p><p>Short end.</p></article><div>{LONG}</div></body>"
    assert html.main_text(page) == f"{LONG} Line {LONG} Short end."
    assert html.main_text(f"<body><p>{LONG}</p><p>\u00a9 2020 the owner</p></body>") == LONG


# ---- URLs ----------------------------------------------------------------------------------------------
def ruled(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.sub("[A-Z]", lambda m: m.group().lower(), re.split("[/?#]", rest)[0])
    path = re.split("[?#]", rest[len(host):])[0]
    best = (None, None)
    for h, p, v in urlrules.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and len(h + p) > len(best[0] or ""):
            best = (h + p, v)
    return host, path, *best


URLS = ["http://WWW.Example.com/en/1", "https://a.example.com/en/", "http://example.com/fr", "http://xexample.com/en/x", "http://com/", "http://com",
        "http://a.net/es/1?x=http://b.com/", "http://a.net/fr", "ftp://É.net/fr/ü#a", "a.com/en/", "", None, "x?y://b.com/z", "http://b.com?/q", "://c.com/",
        "http://a.net/de/\n1", "http://www.example.com/en/"]


def test_rules_match_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(99, URLS[0], "h")], "page_id long, url string, host string")
    rows = {r.page_id: r for r in urlrules.judge(pages).collect()}
    assert len(rows) == len(URLS) + 1
    for i, u in enumerate(URLS):
        host, path, rule, verdict = ruled(u)
        r = rows[i]
        assert (r.host, r.path, r.rule) == (host, path, rule), u
        assert r.verdict == verdict or verdict is None and r.verdict in ("allow", "block")
    assert urlrules.judge(pages.limit(0)).collect() == []


def test_mined_rules_block_what_they_cover(spark):
    rows = [(i, f"http://s{i}.net/es/{i}/pills?promo={i}") for i in range(60)] + [(100 + i, f"http://s{i}.org/de/{i}") for i in range(60)]
    rows += [(200, "http://new.org/es/7/pills?promo=1"), (201, "http://new.org/de/8"), (202, "http://new.org/de/8")]
    out = {r.page_id: r.verdict for r in urlrules.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert out[200] == "block" and out[201] == out[202] == "allow" and all(out[100 + i] == "allow" for i in range(60))


def test_mined_rules_match_brute_force(spark):
    labelled = [(["h:a", "p:x"], "block")] * 9 + [(["h:a", "p:y"], "allow")] * 6 + [(["h:b", "p:x", "q:z"], "block")] * 5 + [(["h:b"], "open")] * 4
    rules = urlrules.mine(spark.createDataFrame(labelled, "tokens array<string>, verdict string"), 0.05, 0.8).collect()
    got = {(tuple(sorted(r.antecedent)), r.verdict) for r in rules}
    for tokens, verdict in got:
        cover = [v for t, v in labelled if set(tokens) <= set(t)]
        assert cover.count(verdict) >= 0.8 * len(cover)
    assert (("p:x",), "block") in got and (("p:y",), "allow") in got
    assert not any(len(t) > 1 and "p:x" in t for t, _ in got)  # covered by the shorter rule
    assert all(r.anchor in r.antecedent for r in rules)
    urls = spark.createDataFrame([("u1", ["p:x", "h:c"]), ("u2", ["h:c"]), ("u3", [])], "url string, tokens array<string>")
    found = {r.url: r.mined for r in urlrules.match(urls, spark.createDataFrame(rules)).collect()}
    assert found == {"u1": "block"}
