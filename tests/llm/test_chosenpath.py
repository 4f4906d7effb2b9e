"""The chosen-path similarity join against brute force, with trees of many shapes."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import DOCS, ODD, docs_of, prose
from tracecairn.llm import chosenpath, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_set(text, words=5):
    own = WORD.findall((text or "").translate(UPPER))
    if not own:
        return frozenset()
    return frozenset(tuple(own[k:k + words]) for k in range(max(1, len(own) - words + 1)))


def brute_rows(rows, percent=85):
    """(id, n_shingles, component_id, kept) of (id, text) rows."""
    sets = [brute_set(t) for _, t in rows]
    above = list(range(len(rows)))

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            common = len(s & sets[j])
            if s and 100 * common >= percent * (len(s) + len(sets[j]) - common) and sets[j]:
                above[top(i)] = top(j)
    names = {}
    for k, (i, _) in enumerate(rows):
        names.setdefault(top(k), []).append(i)
    first = {r: min((i for i in ids if i is not None), default=None) for r, ids in names.items()}
    return sorted(((i, len(s), first[top(k)], i == first[top(k)])
                   for k, ((i, _), s) in enumerate(zip(rows, sets))), key=repr)


def near_copy(rng, text, changes):
    words = text.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = prose(rng, 1) + "x"
    return " ".join(words)


def rows_of(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("leaf, levels, block", [(2048, 16, 256), (8, 6, 4), (4, 2, 3), (2, 1, 2)])
def test_components_match_brute_force(spark, monkeypatch, leaf, levels, block):
    monkeypatch.setattr(chosenpath, "BLOCK", block)
    rng = random.Random(leaf)
    base = [prose(rng, rng.randint(30, 120)) for _ in range(40)]
    texts = base + [near_copy(rng, rng.choice(base[:10]), rng.randint(0, 6)) for _ in range(80)]
    shared = prose(rng, 60)   # a passage that many documents share
    texts += [f"{prose(rng, 12)} {shared} {prose(rng, 12)}" for _ in range(30)]
    chain = prose(rng, 200).split()   # neighbours link, the ends don't
    texts += [" ".join(chain[4 * k:4 * k + 100]) for k in range(12)]
    texts += ["One two three four", "one TWO  three\tfour", "one two three", "É é", "é É"]
    texts += ODD + [base[0].upper(), base[1].replace(" ", "\n\n")]
    rows = list(enumerate(texts)) + [(7, texts[7]), (7, texts[50]), (None, texts[3]), (None, None)]
    docs = spark.createDataFrame([(i, t, "a", "b", 0) for i, t in rows],
                                 DOCS.replace("lang", "n_shingles").replace("source", "kept"))
    got = chosenpath.near_duplicates(docs.repartition(3), leaf=leaf, levels=levels)
    assert rows_of(got) == brute_rows(rows)


def test_a_large_group_around_one_text_is_found(spark, monkeypatch):
    """Copies that each link with the original, most of them not with each other."""
    monkeypatch.setattr(chosenpath, "BLOCK", 16)
    rng = random.Random(5)
    original = prose(rng, 150)
    texts = [original] + [near_copy(rng, original, rng.randint(1, 2)) for _ in range(150)]
    texts += [original] * 100 + [prose(rng, 150) for _ in range(50)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = rows_of(chosenpath.near_duplicates(docs_of(spark, texts), leaf=20, levels=3))
    assert got == brute_rows(rows)


def test_threshold_is_exact(spark):
    """17 of 20 shingles in common is a link, 16 of 19 is none."""
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(words[:24]), " ".join(words[:21]), " ".join(words[:20]), " ".join(words[:23])]
    assert [len(brute_set(t)) for t in texts] == [20, 17, 16, 19]
    for pair in ((0, 1), (3, 2)):
        rows = [(i, texts[i]) for i in pair]
        got = rows_of(chosenpath.near_duplicates(spark.createDataFrame(
            [(i, t, "", "", 0) for i, t in rows], DOCS)))
        assert got == brute_rows(rows)
        assert len({r[2] for r in got}) == (1 if pair == (0, 1) else 2)


def test_long_texts_and_empty_tables(spark):
    rng = random.Random(8)
    long = " ".join(f"{prose(rng, 40)} {k}" for k in range(30_000))
    assert len(long) > 5_000_000
    texts = [long, long + " end", long[:len(long) // 2], " ".join(["again"] * 2_000_000), "again again again again again"]
    got = {r["doc_id"]: r for r in chosenpath.near_duplicates(docs_of(spark, texts)).collect()}
    assert got[1]["component_id"] == 0 and not got[1]["kept"]
    assert got[2]["kept"] and got[2]["n_shingles"] < got[0]["n_shingles"]
    assert got[3]["n_shingles"] == 1 and got[4]["component_id"] == 3
    empty = chosenpath.near_duplicates(spark.createDataFrame([], DOCS))
    assert empty.count() == 0
    blank = chosenpath.near_duplicates(docs_of(spark, [None, "", " "]).withColumn(
        "shingles", F.lit("clash")).withColumn("body", F.lit(1)))
    assert rows_of(blank) == [(0, 0, 0, True), (1, 0, 1, True), (2, 0, 2, True)]


def test_query_is_registered():
    assert "op12_chosen_path" in queries.all_queries()
