"""Fixture tables shared by the operator tests: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

import pytest

EN = "the of and to in is that it for was on with as are at by this from which have one had not but what all were when".split()


def prose(rng, n, lexicon=None):
    lexicon = lexicon or EN
    words = [rng.choice(lexicon) + rng.choice(["", "", "tion", "ing", "er", "ly"]) for _ in range(n)]
    return " ".join(words)


def make(spark, rows, clash=True):
    """documents (doc_id, text, lang, source, n_chars) with extra columns whose names operators use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    data = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    if clash:
        names = ["n_words", "kept", "token", "row", "key", "rep", "node", "hit_words", "_host", "candidates", "url"]
        schema += "".join(f", {n} string" for n in names)
        data = [d + ("x",) * len(names) for d in data]
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, source) rows with the awkward cases."""
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(1, 120)), f"s{rng.randint(0, 3)}") for i in range(60)]
    base = prose(rng, 150)
    words = base.split()
    rows += [(100, base, "s1"), (101, base, "s1"), (102, base.upper(), None)]
    for k in range(6):
        near = list(words)
        near[10 + 20 * k] = f"changed{k}"
        rows.append((110 + k, " ".join(near), "s2"))
    rows += [(200, None, "s0"), (201, "", "s0"), (202, " \n\t ", None), (203, "a b", "s3"), (204, "a b", "s3"), (205, "A  B", None),
             (206, "short one", None), (207, "x" * 30_000, "s3"), (208, prose(rng, 4000), "s3"),
             (209, "same line\nsame line\nsame line\n\n" * 30, "s3"), (210, "é K İ ñandú 日本語 😀 don't STOP <|endoftext|> x", "s3"),
             (None, base, "s1"), (None, None, None)]
    rows += [rows[0], rows[0]]  # repeated rows
    return rows


@pytest.fixture()
def docs(spark, corpus):
    return make(spark, corpus)


@pytest.fixture()
def no_docs(spark):
    return make(spark, [])
