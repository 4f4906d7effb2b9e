"""Lexical search and tokenizer alignment against plain Python, on odd rows and empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import DOCS, ODD, docs_of, prose
from tracecairn.llm import acsearch, queries, tokalign
from tracecairn.llm.queries import tokenizer_file

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id long, text string"


def terms_of(text):
    return TERM.findall((text or "").translate(UPPER))


def brute_search(docs, items, k=10):
    """``docs`` and ``items``: lists of (id, text)."""
    counted = [(i, Counter(terms_of(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counted]
    documents, total = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, c in counted for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms_of(t))
    out = []
    for item, words in wanted.items():
        scored = []
        for (i, c), n in zip(counted, sizes):
            m = 10 + 90 * n * documents // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1)))
                        * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in words if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def search_rows(spark, docs, items, **more):
    got = acsearch.search(spark.createDataFrame(docs, "doc_id long, text string, item_id string, "
                                                      "rank int, score long"),
                          spark.createDataFrame(items, ITEMS), **more)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize("block_bytes", [acsearch.BLOCK_BYTES, 40])
def test_search_matches_brute_force(spark, block_bytes):
    rng = random.Random(3)
    long_word = "Z" * 1000
    texts = [prose(rng, rng.randint(1, 60)) for _ in range(120)] + ODD * 2
    texts += [f"{long_word} É1x {long_word}", "z" * 1000, "z" * 1001, "ba. BA,ba\x7fba", "ba" * 400]
    docs = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, texts[5]), (None, "ba ke")]
    items = [(1, prose(rng, 12)), (2, prose(rng, 40)), (3, "É1X é ½ 中文 nowhere"), (4, None),
             (5, " .,"), (6, long_word + " ba"), (1, "ba ke Ba"), (None, "lo mi ru"), (None, "lo")]
    got = search_rows(spark, [(i, t, "clash", 1, 2) for i, t in docs], items, block_bytes=block_bytes)
    assert got == brute_search(docs, items)


def test_search_in_very_long_texts_and_empty_tables(spark):
    docs = [(1, "ab " * 3_500_000 + "end"), (2, "ab end"), (3, "x" * 10_000_000)]
    items = [(1, "end AB"), (2, "x" * 10_000_000)]
    found = search_rows(spark, [(i, t, None, None, None) for i, t in docs], items)
    assert found == brute_search(docs, items)
    assert search_rows(spark, [], items) == []
    assert search_rows(spark, [(1, "a", None, None, None)], []) == []


def test_search_keeps_only_the_best_while_it_scans():
    import numpy as np

    rng, best = np.random.default_rng(1), acsearch.Best(3, 4)
    item, score = rng.integers(0, 3, 5000), rng.integers(1, 50, 5000)
    ids = rng.integers(0, 900, 5000)
    for a in range(0, 5000, 17):
        own = slice(a, a + 17)
        best.add(item[own], score[own], np.zeros(len(item[own]), np.int64), ids[own])
    best.settle()
    for i in range(3):
        want = sorted(zip(-score[item == i], ids[item == i]))[:4]
        at = best.rows[0] == i
        assert list(zip(best.rows[1][at], best.rows[3][at])) == want


# -- alignment ----------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))


def token_bytes(a, b, text):
    """(id, bytes) of both sides; None where they don't give the text back."""
    whole = b" " + text.encode()
    encoded = a.encode(" " + text, add_special_tokens=False)
    spots, left = tokalign.byte_level_alphabet(), []
    for i in encoded.ids:
        left.append((i, bytes(spots[c] for c in a.id_to_token(i))))
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        byte = re.fullmatch("<0x(..)>", piece)
        right.append((i, bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()))
    if not text or any(b"".join(x for _, x in side) != whole for side in (left, right)):
        return None
    return left, right


def brute_alignment(libraries, texts):
    docs, counts = [], Counter()
    for text in texts:
        sides = token_bytes(*libraries, text or "")
        if sides is None:
            docs.append(None)
            continue
        spans, ends = [], []
        for side in sides:
            at, own = 0, []
            for i, x in side:
                own.append((i, at, at + len(x)))
                at += len(x)
            spans.append(own)
            ends.append({e for _, _, e in own})
        links = [(i, j) for i, s, e in spans[0] for j, t, f in spans[1] if s < f and t < e]
        counts.update(links)
        groups, start = [], 0
        for cut in sorted(ends[0] & ends[1]):
            groups.append("|".join(",".join(str(i) for i, s, _ in own if start <= s < cut)
                                   for own in spans))
            start = cut
        docs.append((len(spans[0]), len(spans[1]), len(groups), links, ";".join(groups)))
    highest = Counter()
    for (_, j), n in counts.items():
        highest[j] = max(highest[j], n)
    zeros = (0, 0, 0, 0, 0, 0, "")
    return [zeros if d is None else (
        *d[:3], len(d[3]), sum(counts[x] == highest[x[1]] for x in d[3]),
        sum(counts[x] for x in d[3]), hashlib.sha256(d[4].encode()).hexdigest()) for d in docs]


def files():
    return tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")


@pytest.mark.parametrize("block_bytes", [tokalign.BLOCK_BYTES, 300])
def test_alignment_matches_brute_force(spark, libraries, block_bytes):
    rng = random.Random(4)
    alphabet = [" ", "  ", "\n", "the", "ing", "é", "中", "😀", "'s", "12", "▁", "<0x41>", "<s>", "\t",
                "á", " ", "A"]
    texts = [x[:400] if x else x for x in ODD] + [
        "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    texts += ["<|endoftext|> <s> </s>", "▁", "a\x00b", "plain words here", "plain words here"]
    docs = docs_of(spark, texts).withColumn("n_a", F.lit("clash")).withColumn("id", F.lit(1))
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") != 3, F.col("doc_id")))
    got = tokalign.cross_align(docs.repartition(3), *files(), block_bytes=block_bytes)
    assert got.columns == ["doc_id", *tokalign.COUNTERS, "n_best", "count_sum", "groups_sha256"]
    want = [(None if i == 3 else i, *x) for i, x in enumerate(brute_alignment(libraries, texts))]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_alignment_of_repeated_rows_long_texts_and_empty_tables(spark, libraries):
    rng = random.Random(6)
    unit = prose(rng, 300) + "\n"
    texts = [unit * 6_000, unit, unit, None, ""]
    docs = docs_of(spark, texts)
    got = {r["doc_id"]: r for r in tokalign.cross_align(docs, *files()).collect()}
    assert len(texts[0]) > 10_000_000
    a, b = libraries
    assert got[0]["n_a"] == len(a.encode(" " + texts[0], add_special_tokens=False).ids)
    assert got[0]["n_b"] == len(b.encode(texts[0]))
    assert got[0]["n_links"] == got[0]["n_a"] + got[0]["n_b"] - got[0]["n_groups"]
    assert tuple(got[1])[1:] == tuple(got[2])[1:]
    assert all(tuple(got[i])[1:] == (0, 0, 0, 0, 0, 0, "") for i in (3, 4))
    assert tokalign.cross_align(docs.limit(0), *files()).count() == 0
    assert tokalign.cross_align(spark.createDataFrame([], DOCS), *files()).count() == 0


def test_queries_are_registered():
    assert {"op11_token_alignment", "op13_lexical_search"} <= set(queries.all_queries())
    assert "op13_lexical_search" in queries.all_sql()
