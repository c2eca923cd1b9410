import hashlib
import math
import random
import re

import pytest

from mutascope.llm import licenses, pii, queries

from .conftest import make, prose

WORD = "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def digits(x):
    return re.sub("[^0-9]", "", x)


def luhn(x):
    total = 0
    for i, c in enumerate(reversed(x)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


KINDS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
         ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
         ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
         ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15))


def brute(t):
    return [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, t or "") if ok(m.group())] for k, p, ok in KINDS]


TEXTS = ["a@b.c_d@e.f x@y..z é.é@x.yz a@b.c@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.255 1.2.3", "4111 1111 1111 1111, 4111-1111-1111-1112 0000000000000",
         "+1 (017) 555-7713 x +1-2 +123456789012345678 ++49 30 1234567", "😀😀 mail me: joe@x.org 10.0.0.1", "1" * 5000, "a" * 20000 + "@x.com", "+" * 3000,
         "1.1.1.1" * 40, "a@b." + "c." * 3000 + "d", "joe (at) example (dot) com", "call (212) 555-0199 now", "9999999999999999999999", "\n1.1.1\n.1 4111\n111111111111",
         "version 10.1.2.3 of it", "12 " * 30]


@pytest.fixture()
def personal(spark, corpus):
    rows = corpus + [(300 + i, t, None) for i, t in enumerate(TEXTS)] + [(400 + i, f"mail: u{i}@mail.example.com +1 (555) 010-{1000 + i}", None) for i in range(30)]
    return make(spark, rows), rows


def test_base_spans_match_brute_force(personal, no_docs):
    docs, rows = personal
    got = sorted(str([r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256]) for r in pii.find(docs).collect())
    want = sorted(str([i, *map(len, brute(t)), hashlib.sha256(",".join(sum(brute(t), [])).encode()).hexdigest()]) for i, t, _ in rows)
    assert got == want
    assert pii.find(no_docs).collect() == []


def test_all_spans_contain_the_base_and_stay_in_order(personal):
    docs, rows = personal
    text = {i: t or "" for i, t, _ in rows}
    for r in pii.find(docs).collect():
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert set(sum(brute(text[r.doc_id]), [])) <= {":".join(s) for s in spans} or r.doc_id is None
        order = [(pii.KINDS.index(k), int(a)) for k, a, _ in spans]
        assert order == sorted(order)


def test_em_finds_good_and_bad_labelers():
    """Labelers with known accuracies: probabilities follow the truth, reliabilities follow the accuracies."""
    import collections
    import random
    rng, counts = random.Random(0), collections.Counter()
    accuracy = dict(zip(pii.VOTES, (0.95, 0.9, 0.85, 0.8, 0.75, 0.55)))
    for _ in range(4000):
        y = rng.random() < 0.4
        votes = tuple((1 if (rng.random() < a) == y else -1) if rng.random() < 0.8 else 0 for a in accuracy.values())
        counts[votes, y] += 1
    patterns = [{"kind": "email", "count": counts[v, True] + counts[v, False], **dict(zip(pii.VOTES, v))} for v in {v for v, _ in counts}]
    p, rates = pii.reliabilities(patterns)
    right = sum(counts[tuple(r[v] for v in pii.VOTES), q >= 0.5] for r, q in zip(patterns, p))
    assert right / 4000 > 0.93
    found = {v: rates[v][1, 1] / (rates[v][1, 1] + rates[v][1, -1]) for v in pii.VOTES}
    assert all(abs(found[v] - a) < 0.08 for v, a in accuracy.items())


def test_classifier_adds_what_the_labelers_support(spark):
    rows = [(i, f"please call phone: +1 (212) 555-{1000 + i} or mail: joe{i}@example.com today", "s") for i in range(40)]
    rows += [(100 + i, f"order 41111111111111{10 + i} shipped", "s") for i in range(30)]
    rows += [(200, "please mail: ann(at)example(dot)com today", "s")]
    out = {r.doc_id: r.spans for r in pii.find(make(spark, rows)).collect()}
    assert "spelled:13:35" in out[200]
    bad = [i for i in range(30) if not luhn(f"41111111111111{10 + i}")]
    assert all("card" not in out[100 + i] for i in bad)


def test_mask_replaces_every_span(personal, spark, no_docs):
    docs, rows = personal
    out = pii.mask(docs)
    assert out.schema == docs.schema or out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[304] == "😀😀 mail me: <EMAIL> <IP>" and got[200] is None
    assert all(t is None or not any(brute(t)[k] for k in (0, 3)) for t in got.values())
    assert pii.mask(no_docs).collect() == []
    plain = make(spark, [(1, "nothing here", None)])
    assert pii.mask(plain).first().text == "nothing here"


# ---- licences ------------------------------------------------------------------------------------------
def brute_licence(t, threshold=licenses.THRESHOLD):
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    starts, base, labels, best = [], set(), set(), 0.0
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
        starts += at
        if at:
            base.add(label)
    for line in (t or "").split("\n"):
        block = set(re.findall(WORD, re.sub("[A-Z]", lambda m: m.group().lower(), line)))
        for label, template in licenses.TEMPLATES:
            words = set(template.split())
            if len(block & words) >= math.ceil(threshold * len(words) - 1e-9):
                labels.add(label)
                best = max(best, len(block & words) / len(words))
    return [len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | labels)), round(1.0 if starts else best, 9)]


NOTICES = ["Released UNDER the MIT\nLicense. under the mit license", "cc by nc cc by nc x cc-by-nc", "Licensed under the Apache License, Version 2.0.",
           "licensed under Apache license version 2", "This work is licensed under the GNU General Public License, version 3.", "K cc by nc", "cc by ncé", "éunder the mit license",
           "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and\nassociated", "the of and to under licensed",
           "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published", "CC BY NCK 4 0 licensed under"]


def test_licences_match_brute_force(spark, corpus, no_docs):
    rows = corpus + [(300 + i, t, None) for i, t in enumerate(NOTICES)]
    out = licenses.scan(make(spark, rows)).collect()
    got = sorted(str([r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)]) for r in out)
    assert got == sorted(str([i, *brute_licence(t)]) for i, t, _ in rows)
    assert licenses.scan(no_docs).collect() == []


WRAPPED = {
    "gpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation",
    "bsd": "Copyright holders\n\n# Redistribution and use in source and binary forms, with or without\r\n#\n# modification, are permitted provided that",
    "mpl-2": "/* This Source\n * Code Form\n * is subject\n * to the\n * terms of\n * the Mozilla\n * Public License,\n * v. 2.0. */"}


def test_notices_wrapped_over_lines(spark):
    rows = [(i, "some words first\n" + t, "s") for i, t in enumerate(WRAPPED.values())]
    apart = "\n".join(f"{w} " + " ".join(f"x{k}" for k in range(40)) for w in dict(licenses.TEMPLATES)["bsd"].split())
    out = {r.doc_id: (r.labels, r.score) for r in licenses.scan(make(spark, [*rows, (9, apart, "s"), (10, "\n\n", "s")])).collect()}
    assert [out[i][0] for i in range(3)] == list(WRAPPED) and all(out[i][1] > 0.8 for i in range(3))
    assert out[9] == out[10] == ("", 0.0)


@pytest.mark.parametrize("threshold", [0.5, 0.65, 1.0])
def test_filters_lose_no_block(spark, threshold):
    import random
    rng = random.Random(7)
    lines = []
    for _, t in licenses.TEMPLATES:
        w = t.split()
        lines += [" ".join(rng.sample(w, k) + ["noise"] * 2) for k in range(1, len(w) + 1)]
    rows = [(i, t, None) for i, t in enumerate(lines)]
    docs = make(spark, rows)
    pairs = licenses.join_blocks(licenses.read_texts(docs, threshold=threshold), threshold=threshold)
    out = {r.row for r in pairs.select("row").distinct().collect()}
    want = sum(bool(brute_licence(t, threshold)[6]) and any(
        len(set(t.split()) & set(x.split())) >= math.ceil(threshold * len(set(x.split())) - 1e-9) for _, x in licenses.TEMPLATES) for _, t, _ in rows)
    assert len(out) == want


# ---- queries and pipeline --------------------------------------------------------------------------------
def test_native_operators_run_no_python(spark):
    """Plans of the three native operators hold no Python or Arrow node."""
    d = "/root/testdata/sf0.001"
    for name in ("op1_pii", "op6_url_filter", "op8_licences"):
        plan = queries.QUERIES[name](spark, d)._jdf.queryExecution().toString()
        assert not re.search("Python|Arrow|Pandas", plan), name


def test_pipeline_against_brute_force(spark, corpus, tmp_path):
    """Stages are applied in order, each on what the one before kept; ids of what is left match."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    from mutascope.llm import bpe
    from .test_decontam_html_url import brute as contaminated
    from .test_neardup_lattice import brute_components
    from .test_quality_bpe_secrets import brute_kept

    rows = [r for r in dict.fromkeys(corpus) if r[0] is not None]
    items = [(1, " ".join(rows[0][1].split()[:12])), (2, "not in there at all")]
    rows += [(400, prose(random.Random(6), 70) + " mail: joe@x.org " + rows[0][1], "s1"),
             (401, prose(random.Random(7), 70) + " +1 (212) 555-0100 or 10.1.2.3", "s1")]
    spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, stage, str(tmp_path))
        assert out.columns == stage.columns and [x.dataType for x in out.schema] == [x.dataType for x in stage.schema], name

    kept = [r for r, k in zip(rows, brute_kept(rows)) if k]
    one = {i for i, _, _, k in brute_components(kept, 5) if k}
    kept = [r for r in kept if r[0] in one]
    bad = {x[0] for x in contaminated(kept, items) if x[-1]}
    kept = [r for r in kept if r[0] not in bad]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in kept} and 401 in got
    library = Tokenizer.from_file(bpe.vocabulary_file())
    masked = {401: prose(random.Random(7), 70) + " <PHONE> or <IP>"}
    for i, t, _ in kept:
        want = library.encode(masked.get(i, t), add_special_tokens=False).ids
        assert list(got[i].ids) == want and got[i].n_tokens == len(want), i


def test_entry_lists_all_queries():
    import __spark_entry__ as e
    names = set(e.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert set(e.oracle_sql()) <= names
