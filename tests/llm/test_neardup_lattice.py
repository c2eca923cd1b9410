import collections
import math
import random
import re
import zlib

import pytest

from mutascope.llm import lattice, neardup

from .conftest import make, prose

SPACE = "[^\x20\x09-\x0D]+"


def low(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def shingle_set(t, width):
    w = re.findall(SPACE, low(t))
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute_components(rows, width=4):
    sets = [(i, shingle_set(t, width)) for i, t, _ in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x[0] is not None and y[0] is not None and x[1] and y[1] and 100 * len(x[1] & y[1]) >= 80 * len(x[1] | y[1]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    groups = collections.defaultdict(list)
    for k, (i, s) in enumerate(sets):
        groups[root(k)].append(k)
    out = []
    for members in groups.values():
        least = min((sets[k][0] for k in members if sets[k][0] is not None), default=None)
        for k in members:
            i, s = sets[k]
            own = None if i is None else i if not s else least
            out.append((i, len(s), own, i is None or i == own))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def test_components_match_brute_force(docs, corpus, no_docs):
    assert got(neardup.near_duplicates(docs)) == brute_components(corpus)
    assert neardup.near_duplicates(no_docs).collect() == []


def test_stage_keeps_one_of_each_group(docs, corpus):
    kept = neardup.keep_one(docs)
    assert kept.schema == docs.schema
    want = sorted(str(i) for i, _, _, k in brute_components(corpus, 5) if k)
    assert sorted(str(r.doc_id) for r in kept.collect()) == want


def test_crowded_regions_are_cut_and_nothing_is_lost(spark, monkeypatch):
    """A group of near copies far beyond the region size stays one component; others stay apart."""
    rng = random.Random(3)
    base = prose(rng, 120).split()
    rows = [(0, " ".join(base), "s")]
    for k in range(1, 80):
        w = list(base)
        w[rng.randrange(120)] = f"v{k}"
        rows.append((k, " ".join(w), "s"))
    rows += [(1000 + k, prose(rng, 60, [f"z{k}x", "the", "of", "and", "to", "in"]), "s") for k in range(20)]
    classes = {}
    original = neardup.candidates
    monkeypatch.setattr(neardup, "candidates", lambda c, **k: classes.setdefault("p", original(c, region=8, **k)))
    assert got(neardup.near_duplicates(make(spark, rows))) == brute_components(rows)


def families(rng, n_bases=12, n_copies=30):
    """Families of copies that are similar to their own base only, while all bases crowd the same regions."""
    root, rows = prose(rng, 120).split(), []
    for _ in range(n_bases):
        base = list(root)
        for k in rng.sample(range(4, 116), 4):
            base[k] = f"b{rng.randrange(10 ** 6)}"
        rows.append(base)
        for _ in range(n_copies):
            w = list(base)
            for k in rng.sample(range(4, 116), 3):
                w[k] = f"v{rng.randrange(10 ** 6)}"
            rows.append(w)
    rng.shuffle(rows)
    return [(k, " ".join(w), "s") for k, w in enumerate(rows)]


def test_links_of_crowded_regions_are_exact(spark, monkeypatch):
    """With one neighbour on each side and no centres, links are missed; the join on prefixes finds them all."""
    near, centre, full = neardup.candidates, neardup.centre_candidates, getattr(neardup, "crowded", None)
    monkeypatch.setattr(neardup, "candidates", lambda c, **k: near(c, reach=1, **k))
    monkeypatch.setattr(neardup, "crowded", lambda c: full(c, reach=1), raising=False)
    monkeypatch.setattr(neardup, "centre_candidates", lambda *a, **k: centre(*a, **k).limit(0))
    rows = families(random.Random(12))
    assert got(neardup.near_duplicates(make(spark, rows))) == brute_components(rows)


def test_prefix_join_loses_no_pair(spark):
    """Every similar pair of different components is a candidate, none of one component is."""
    rows = families(random.Random(13), 3, 12) + [(900 + k, t, "s") for k, t in enumerate(["a b c d e", "a b c d e f", "a b", "", None])]
    docs = make(spark, rows)
    sets = {i: shingle_set(t, 4) for i, t, _ in rows}
    similar = {(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    reps = docs.selectExpr("doc_id as rep")
    none = spark.createDataFrame([], "node long, component long")
    assert similar and similar <= {tuple(r) for r in neardup.prefix_candidates(reps, docs, none, 4).collect()}
    label = {i: i // 5 * 5 for i in sets}
    labels = spark.createDataFrame(list(label.items()), "node long, component long")
    pairs = {tuple(r) for r in neardup.prefix_candidates(reps, docs, labels, 4).collect()}
    assert {(a, b) for a, b in similar if label[a] != label[b]} <= pairs and all(label[a] != label[b] for a, b in pairs)


def test_candidate_count_is_linear_in_a_group(spark):
    rng = random.Random(4)
    base = prose(rng, 100).split()
    rows = []
    for k in range(60):
        w = list(base)
        w[k] = f"u{k}"
        rows.append((k, " ".join(w), "s"))
    sk = neardup.sketches(make(spark, rows), 4).selectExpr("doc_id as rep", "n_shingles as n", "signature")
    pairs = neardup.candidates(sk).count()
    assert pairs <= 60 * neardup.REACH * neardup.TREES and pairs < 60 * 59 // 2 + 1


def test_second_round_leaves_out_pairs_of_one_component(spark):
    """Ten neighbours far below all pairs of a group of 400, and none of them inside a component already found."""
    rng = random.Random(5)
    base = prose(rng, 500).split()
    rows = []
    for k in range(400):
        w = list(base)
        w[k] = f"u{k}"
        rows.append((k, " ".join(w), "s"))
    sk = neardup.X.written(neardup.sketches(make(spark, rows), 4).selectExpr("doc_id as rep", "n_shingles as n", "signature"), "t")
    first, second = (neardup.candidates(sk, turn=t) for t in (1, 2))
    assert first.count() <= 400 * neardup.TREES < 400 * 399 // 2 > second.count()
    assert neardup.candidates(sk.selectExpr("*", "0L as component"), turn=2).count() == 0
    halves = neardup.candidates(sk.selectExpr("*", "rep % 2 as component"), turn=2).collect()
    assert halves and all((r.a - r.b) % 2 for r in halves)


def test_rows_of_one_id_are_judged_by_their_own_text(spark):
    rng = random.Random(6)
    a, b, c = (prose(rng, 80) for _ in range(3))
    rows = [(1, a, "s"), (5, a, "s"), (5, b, "s"), (6, b, "s"), (7, c, "s"), (7, c, "s"), (8, c, "s"), (None, a, "s"), (None, a, "s")]
    kept = sorted(((r.doc_id, r.text) for r in neardup.keep_one(make(spark, rows)).collect()), key=str)
    assert kept == sorted([(1, a), (5, b), (7, c), (7, c), (None, a), (None, a)], key=str)


def test_recall_at_the_threshold(spark):
    """Pairs just at or above 0.8 are all found."""
    rng = random.Random(8)
    rows = []
    for k in range(60):
        w = [f"t{rng.randrange(10 ** 6)}" for _ in range(200)]
        v = list(w)
        for j in range(5):  # 5 separate changes touch 20 of 197 shingles: 177 / 217 = 0.815
            v[20 + 30 * j] = f"new{k}_{j}"
        rows += [(2 * k, " ".join(w), "s"), (2 * k + 1, " ".join(v), "s")]
    out = {r.doc_id: r.component_id for r in neardup.near_duplicates(make(spark, rows)).collect()}
    assert all(out[2 * k + 1] == 2 * k for k in range(60))


def test_star_steps_on_long_chains_and_hubs(spark):
    chain = [(k, k + 1) for k in range(100)] + [(500, 600 + k) for k in range(50)] + [(7000, 7001)]
    out = {r.node: r.component for r in neardup.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(out[k] == 0 for k in range(1, 101)) and all(out[600 + k] == 500 for k in range(50)) and out[7001] == 7000


# ---- language model ------------------------------------------------------------------------------------
def base_scores(rows):
    words = [(i, re.findall(SPACE, low(t)) + [""]) for i, t, _ in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in words]
    c = collections.Counter(w for (_, ws), h in zip(words, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted(((i, h, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 5))
                   for (i, ws), h in zip(words, held)), key=str)


@pytest.mark.parametrize("hot", [3, 40, lattice.HOT])
def test_base_score_matches_brute_force(docs, corpus, hot):
    """With few hot words the counts come by join, with many by broadcast; the result is the same."""
    out = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5))
                  for r in lattice.score(docs, hot=hot).collect()), key=str)
    assert [x[:5] for x in out] == [x[:5] for x in base_scores(corpus)]
    assert all(abs(a[5] - b[5]) < 1e-3 for a, b in zip(out, base_scores(corpus)))


def test_lattice_sums_all_segmentations():
    """Against explicit enumeration over a tiny vocabulary."""
    m = lattice.Model({"▁": math.log(.1), "▁a": math.log(.2), "a": math.log(.1), "b": math.log(.15), "ab": math.log(.25), "aab": math.log(.05)},
                      [math.log(1e-4)] * 256, math.log(.1))

    def every(s):
        if not s:
            return 1.0
        total = 0.0
        for k in range(1, len(s) + 1):
            if s[:k] in m.scores:
                total += math.exp(m.scores[s[:k]]) * every(s[k:])
        if s[0] not in m.scores:
            total += math.prod(math.exp(m.bytes[b]) for b in s[0].encode()) * every(s[1:])
        return total

    for w in ("a", "ab", "aab", "abab", "baab", "aé", "aaaabbbb"):
        assert abs(m.word(w) - math.log(every("▁" + w))) < 1e-9
    assert m.word("ab" * 20_000) < -1000  # long words neither overflow nor underflow


def test_training_improves_held_out_likelihood(spark, docs):
    path = lattice.vocabulary_file()
    trained, n, v = lattice.train(lattice.token_counts(docs), path)
    flat = lattice.Model.trained({}, 0, path)
    words = prose(random.Random(99), 300).split()
    assert sum(map(trained.word, words)) > sum(map(flat.word, words)) + 100
    total = sum(math.exp(s) for s in trained.scores.values()) + sum(map(math.exp, trained.bytes)) + math.exp(trained.end)
    assert abs(total - 1) < 1e-6


def test_score_of_rows_and_empty_tables(docs, no_docs, spark):
    rows = lattice.score(docs).collect()
    assert all(r.score < 0 for r in rows) and len(rows) == docs.count()
    empty = {round(r.score, 9) for r in rows if r.n_tokens == 1}
    assert len(empty) == 1
    assert lattice.score(no_docs).collect() == []
    only_held = make(spark, [(i, "a b", None) for i in range(60) if zlib.crc32(str(i).encode()) % 10 == 0])
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in lattice.score(only_held).collect())
