import base64
import collections
import hashlib
import io
import itertools
import random
import re
import zipfile
import zlib

import pytest

from mutascope.llm import audit, spelling, warc
from mutascope.llm import text as X

from .conftest import make

PAGES = "page_id long, url string, html string, record_id string, path string, winner string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], PAGES)


def expected(rows):
    last = {}
    for i, _, t in rows:
        if i is not None:
            last[t or ""] = max(i, last.get(t or "", i))
    out = []
    for i, _, t in rows:
        raw = (t or "").encode()
        to = last.get(t or "")
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                    "response" if i == to else "revisit", None if i == to else to))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


ROWS = [(1, "http://a/", "<p>x</p>"), (2, "http://a/ b\r\nWARC-Type: x", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "é", "\r\n\r\nWARC/1.1"),
        (6, "u", "日本" * 100_000), (7, "u", "日本" * 100_000), (7, "u", "日本" * 100_000), (None, "u", "only"), (None, "u", "<p>x</p>")]


def test_pages_come_back_from_packages(spark):
    assert got(warc.archived(spark, pages_of(spark, ROWS))) == expected(ROWS)
    assert got(warc.archived(spark, pages_of(spark, []))) == []


def test_many_small_packages_and_least_length(spark, monkeypatch):
    monkeypatch.setattr(warc, "RUN", 700)
    rows = [(i, f"http://h/{i}", f"page {i % 7} " * (i % 3)) for i in range(60)]
    packages = warc.write_packages(pages_of(spark, rows), X.scratch(spark, "t"), package=500)
    assert packages.count() > 10
    found = warc.read_packages(packages)
    assert found.count() == 60 and found.where("record_type = 'revisit'").count() == 60 - len({r[2] for r in rows})
    path = packages.first()["path"]
    store, inner = warc.open_store(path)
    with zipfile.ZipFile(io.BytesIO(store.open_input_stream(inner).read())) as z:  # other readers can open it
        assert z.testzip() is None and z.namelist() == [warc.DATA, warc.INDEX]
    long_only = warc.write_packages(pages_of(spark, rows), X.scratch(spark, "t"), least=10)
    kinds = collections.Counter((r.payload_bytes >= 10, r.record_type) for r in warc.read_packages(long_only).collect())
    assert kinds[False, "revisit"] == 0 and kinds[True, "revisit"] > 0


def packed(folder, members):
    path = f"{folder}/{len(members)}-{random.random()}.wacz"
    with zipfile.ZipFile(path, "w") as z:
        for name, data, how in members:
            z.writestr(zipfile.ZipInfo(name), data, how)
    return path


def test_zip64_directory(monkeypatch, tmp_path):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    data = b"".join(warc.record(i, "u", b"x" * i, None) for i in range(5))
    path = packed(tmp_path, [("pad", b"0" * 50, zipfile.ZIP_STORED), ("archive/a.warc", data, zipfile.ZIP_STORED)])
    raw = open(path, "rb").read()
    assert b"PK\x06\x06" in raw and b"PK\x06\x07" in raw
    store, inner = warc.open_store(path)
    with store.open_input_file(inner) as f:
        start, n = warc.stored_members(f, f.size())["archive/a.warc"]
        assert raw[start:start + n] == data
    found = [warc.parse(raw[at:at + n]) for at, n, gz in warc.places(path) if not gz]
    assert [r["payload_bytes"] for r in found] == list(range(5))


def test_archives_without_an_index_are_walked(spark, tmp_path):
    recs = [warc.record(i, f"u{i}", b"p" * (i * 50_000), "<urn:page:9>" if i % 2 else None) for i in range(5)]
    gz = b"".join(map(_gzip, recs))
    path = packed(tmp_path, [("archive/a.warc.gz", gz, zipfile.ZIP_STORED), ("archive/b.warc", b"".join(recs), zipfile.ZIP_STORED),
                             ("other", b"y" * 99, zipfile.ZIP_DEFLATED)])
    found = warc.read_packages(spark.createDataFrame([(path,)], "path string")).collect()
    assert collections.Counter((r.record_id, r.record_type) for r in found) == {
        (f"<urn:page:{i}>", "revisit" if i % 2 else "response"): 2 for i in range(5)}


def _gzip(raw):
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def test_broken_packages_are_reported(tmp_path):
    bad = tmp_path / "x.wacz"
    bad.write_bytes(b"no zip" * 100)
    with pytest.raises(ValueError, match="end record"):
        list(warc.places(str(bad)))
    rec = warc.record(1, "u", b"good", None).replace(b"good", b"evil")
    with pytest.raises(ValueError, match="does not match"):
        warc.parse(rec)


# ---- filter audit --------------------------------------------------------------------------------
def brute_audit(rows, labels):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    docs = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0D]+", t)
        fails = {f for f, bad in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                                               bool(re.search(r"[#$%&*|]", t)), i is not None and i > first[t])) if bad}
        mine = [x for x in labels if x[0] == i and i is not None]
        docs.append((lang or "", fails, any(q == 1 for _, q, _ in mine), any(x == 1 for _, _, x in mine)))
    out, shapley = {}, collections.Counter()
    for part in {d[0] for d in docs}:
        for order in itertools.permutations("ABCDE"):
            here = [d for d in docs if d[0] == part]
            alive = here
            for step, f in enumerate(order, 1):
                gone = [d for d in alive if f in d[1]]
                alive = [d for d in alive if f not in d[1]]
                out[part, "".join(order), step] = (len(alive), len(gone), sum(f in d[1] for d in here) - len(gone),
                                                   sum(d[1] == {f} for d in here), sum(d[2] for d in gone), sum(d[3] for d in gone))
                shapley[part, f] += len(gone)
    return {k: v + (shapley[k[0], k[1][k[2] - 1]],) for k, v in out.items()}


def test_audit_matches_applying_every_order(spark, corpus, no_docs):
    rng = random.Random(3)
    rows = [(i, t, rng.choice(["en", "de", "", None])) for i, t, _ in corpus]
    rows += [(300 + k, "A B# " * (k * 9), "en") for k in range(20)] + [(300, "again", "de"), (301, "B# ", "fr"), (302, "B# ", "fr")]
    rows += [(None, "B# ", "fr"), (400, " ".join(f"w{k}" for k in range(150)), "de"), (401, " ".join(f"w{k}" for k in range(150)), "fr")]
    labels = [(i, rng.randint(0, 1), rng.choice([0, 1, None])) for i, *_ in rows if rng.random() < .6] + [(300, 1, 1), (300, 0, 0), (9999, 1, 1)]
    docs = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], "doc_id long, text string, lang string, mask string, digest string, part string")
    found = audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in found} == brute_audit(rows, labels)
    assert len(found) == 600 * len({r[2] or "" for r in rows})
    assert audit.audit(no_docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_audit_takes_other_filters(spark):
    from pyspark.sql import functions as F
    docs = spark.createDataFrame([(1, "a b", "s"), (2, "a b", "s"), (3, "c", "s")], "doc_id long, text string, source string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = audit.audit(docs, none, {"S": F.col("n_words") < 2}, copies="X", part="source").orderBy("filter_order", "step").collect()
    assert [(r.filter_order, r.step, r.kept, r.removed, r.shapley) for r in found] == [
        ("SX", 1, 2, 1, 2), ("SX", 2, 1, 1, 2), ("XS", 1, 2, 1, 2), ("XS", 2, 1, 1, 2)]


def test_path_counts_cover_all_orders():
    forward, backward = audit.forward_backward(5)
    assert forward[-1] == backward[0] == 120
    assert all(sum(forward[s] * backward[s] for s in range(32) if bin(s).count("1") == k) == 120 for k in range(6))


# ---- spelling ------------------------------------------------------------------------------------
def brute_variants(rows, every=199, least=6, often=5, ratio=5):
    counts = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= often}

    def are_near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))

    near = {w: [v for v in words if are_near(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def variants_of(spark, rows, **kw):
    docs = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], "doc_id long, text string, word string, n string, key string, root string")
    return sorted(tuple(r) for r in spelling.variants(docs, **kw).select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_variants_match_brute_force(spark):
    rng = random.Random(11)
    stems = ["".join(rng.choice("abABéñßÉ") for _ in range(rng.randint(5, 8))) for _ in range(40)]
    stems += ["aaaaaa", "aaaaaaa", "aaaaaaaa", "baaaaaa", "aabaaaa", "banana", "bananas", "bannana", "bananna", "BANANA"]
    rows = [(rng.choice([None, k]), " 1-".join(rng.choices(stems, [1 + (j * j) % 60 for j in range(len(stems))], k=200))) for k in range(60)]
    rows += [(None, None), (5, ""), rows[0], (6, "z" * 30_000), (7, "bananas " * 4000)]
    assert variants_of(spark, rows) == brute_variants(rows)
    assert variants_of(spark, rows, every=3) == brute_variants(rows, every=3)


def test_chains_of_forms_reach_their_root(spark):
    chain = ["abcdef", "abcdeg", "abcdhg", "abcihg", "abjihg"]
    rows = [(k, f"{w} " * 5 ** (k + 1)) for k, w in enumerate(chain)]
    found = variants_of(spark, rows, every=10**9)
    assert found == brute_variants(rows, every=10**9) and {r[2] for r in found} == {"abjihg"}
    assert variants_of(spark, []) == []
