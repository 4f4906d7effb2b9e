"""Quality rules as weak supervision.

Each rule looks at a few counts of a text and votes good (1), bad (-1) or abstains (0). Nothing says which
rule is right: expectation-maximisation over the vote patterns estimates how often each rule casts
each vote on good and on bad documents, and the posterior probability of a good document replaces
the demand that every rule pass. It starts from that demand; prior rates and a prior share of good documents, which
weigh as much as the corpus, let the two classes keep their meaning. Abstaining says nothing about a document: bad ones have
one fault each, as a rule, and silence of the other rules must not outvote it.

Everything is DataFrame expressions. The patterns are at most 3 ** len(RULES) rows however large the
corpus, counted after one shuffle of text hashes; each round is one aggregation over them, and the driver carries the
rules' few rates from round to round. Counts cover all documents.

The rates are fitted on distinct texts (told apart by a 64-bit hash), so that copies of one text don't
outvote the rest; every row gets its verdict. Null and empty texts have no words, fail the base
rule and are not kept. Columns of ``docs`` with the names of results are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracecairn.operators.storage import materialize

#: Fixed values of the contract: word separators, symbols, windows and base limits.
SEPARATORS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals",
          "n_shouts", "n_lines")

#: Rules as SQL over the counts: (name, votes good, votes bad); neither: abstains.
RULES = (
    ("symbols", "FALSE", "5 * n_symbols > n_words"),
    ("capitals", "FALSE", "2 * n_capitals > word_chars"),
    ("shouts", "FALSE", "4 * n_shouts > n_words"),
    ("repeats", "FALSE", "5 * n_repeat_words > n_words"),
    ("lines", "FALSE", "2 * n_dup_lines > n_lines"),
    ("word_length", "FALSE", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    ("length", "n_words >= 50", "n_words < 10"),
)
ROUNDS = 12
#: Prior chance of a bad vote on a good and on a bad document, of a good vote likewise, and what
#: the prior weighs against what the corpus shows.
PRIOR_BAD, PRIOR_GOOD, PRIOR_WEIGHT = (0.005, 0.3), (0.5, 0.4), 1.0
#: Starting posterior without, with one, and with more bad votes.
START = (0.95, 0.05, 0.01)
CUT = 0.5
#: Prior share of good documents; the share is estimated with it, at the weight of the rates.
GOOD_SHARE = 0.8


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more."""
    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(hashes) - WINDOW + 1),
                           lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))

    def positions(marks: Column) -> Column:
        same = F.transform(marks, lambda own, i: F.when(
            F.coalesce(own["h"] == F.get(marks, i - 1)["h"], F.lit(False))
            | F.coalesce(own["h"] == F.get(marks, i + 1)["h"], F.lit(False)), own["i"]))
        return F.sort_array(F.filter(same, lambda i: i.isNotNull()))

    def covered(at: Column) -> Column:
        steps = F.zip_with(at, F.slice(at, 2, F.size(at)),
                           lambda a, b: F.least(F.lit(WINDOW), b - a))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    def count(hashes: Column) -> Column:
        marked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(
            h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(
            _let(marked, lambda m: _let(positions(m), covered)))

    return F.when(F.size(words) < WINDOW, 0).otherwise(
        _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _let(windows(h), count)))


def counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the COUNTS columns (long)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, SEPARATORS), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def without(characters: str) -> Column:
        return F.length(text) - F.length(F.translate(text, characters, ""))

    found = _let(words, lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r")))
    by_line = _let(lines, lambda x: F.struct(
        F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    values = {
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")),
        "n_symbols": without(SYMBOLS), "n_capitals": without(CAPITALS), "n_shouts": without("!"),
    }
    return (docs.drop(*COUNTS).withColumns(values | {"_words": found, "_lines": by_line})
            .withColumns({
                "n_words": F.col("_words.n"), "n_repeat_words": F.col("_words.r"),
                "n_lines": F.col("_lines.n"), "n_dup_lines": F.col("_lines.d")})
            .drop("_words", "_lines").withColumns({c: F.col(c).cast("long") for c in COUNTS}))


def votes() -> list[Column]:
    return [F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0).cast("tinyint")
            for _, good, bad in RULES]


def _share(seen: float) -> float:
    return (seen + PRIOR_WEIGHT * GOOD_SHARE) / (1 + PRIOR_WEIGHT)


def _posterior(rates: dict[str, float]) -> Column:
    """Posterior of a good document from the votes v0, v1, ... of a row."""
    odds = F.lit(rates["odds"])
    for i in range(len(RULES)):
        odds += F.when(F.col(f"v{i}") == -1, rates[f"bad{i}"]).when(
            F.col(f"v{i}") == 1, rates[f"good{i}"]).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def fit(patterns: DataFrame) -> Column:
    """Posterior expression after ROUNDS rounds; ``patterns`` has v0.. and their count n."""
    names = [f"v{i}" for i in range(len(RULES))]
    n_bad = sum((F.when(F.col(v) == -1, 1).otherwise(0) for v in names), F.lit(0))
    posterior = F.when(n_bad == 0, START[0]).when(n_bad == 1, START[1]).otherwise(START[2])
    for _ in range(ROUNDS):
        good, bad = F.col("n") * posterior, F.col("n") * (1 - posterior)
        sums = [F.sum(good).alias("good"), F.sum(bad).alias("bad")]
        for v in names:
            sums += [F.sum(F.when(F.col(v) == vote, part).otherwise(0.0)).alias(f"{v}{kind}{tag}")
                     for vote, tag in ((-1, "bad"), (1, "good"))
                     for part, kind in ((good, "g"), (bad, "b"))]
        got = patterns.agg(*sums).first()
        if got["good"] is None:
            return F.lit(START[0])
        share = _share(got["good"] / (got["good"] + got["bad"]))
        rates = {"odds": math.log(share / (1 - share))}
        for i, v in enumerate(names):
            p = {tag: [(got[f"{v}{kind}{tag}"] / got[side] + PRIOR_WEIGHT * prior[k])
                       / (1 + PRIOR_WEIGHT)
                       for k, (kind, side) in enumerate((("g", "good"), ("b", "bad")))]
                 for tag, prior in (("bad", PRIOR_BAD), ("good", PRIOR_GOOD))}
            rates |= {f"bad{i}": math.log(p["bad"][0] / p["bad"][1]),
                      f"good{i}": math.log(p["good"][0] / p["good"][1])}
        posterior = _posterior(rates)
    return posterior


def judge(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns of ``docs`` (all by default) with counts, base_failed, posterior, kept.

    Counts are written once to the shared folder and read for the patterns and the verdict.
    """
    kept = [c for c in (docs.columns if carry is None else carry)
            if c not in (*COUNTS, "base_failed", "posterior", "kept")]
    names = [f"_vote{i}" for i in range(len(RULES))]
    rows = counts(docs, text_col).select(
        *kept, *COUNTS, *(v.alias(x) for v, x in zip(votes(), names)),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"))
    rows = materialize(rows, "quality")
    patterns = rows.select(*names, "_text").distinct().groupBy(
        *(F.col(x).alias(f"v{i}") for i, x in enumerate(names))).agg(F.count("*").alias("n"))
    posterior = fit(materialize(patterns, "patterns").coalesce(1))
    out = rows.withColumns({f"v{i}": F.col(x) for i, x in enumerate(names)})
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (out.withColumn("base_failed", failed).withColumn("posterior", posterior)
            .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= CUT))
            .drop("_text", *names, *(f"v{i}" for i in range(len(RULES)))))


def sql() -> str:
    """The operator as DuckDB SQL over the view ``documents``."""
    rules = ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS v{i}"
                      for i, (_, good, bad) in enumerate(RULES))
    vs = ", ".join(f"v{i}" for i in range(len(RULES)))
    n_bad = " + ".join(f"(v{i} = -1)::INT" for i in range(len(RULES)))
    steps = [f"""p0 AS (SELECT *, CASE {n_bad} WHEN 0 THEN {START[0]} WHEN 1 THEN {START[1]}
        ELSE {START[2]} END::DOUBLE AS p FROM pat)"""]
    for k in range(ROUNDS):
        sums = ["sum(n * p) AS g", "sum(n * (1 - p)) AS b"]
        for i in range(len(RULES)):
            for vote, tag in ((-1, "bad"), (1, "good")):
                sums += [f"sum(CASE WHEN v{i} = {vote} THEN n * p ELSE 0 END) AS g{tag}{i}",
                         f"sum(CASE WHEN v{i} = {vote} THEN n * (1 - p) ELSE 0 END) AS b{tag}{i}"]
        rates = []
        for i in range(len(RULES)):
            rate = {(s, tag): f"(({s}{tag}{i} / {s} + {PRIOR_WEIGHT} * {prior[j]}) / (1 + {PRIOR_WEIGHT}))"
                    for j, s in enumerate("gb")
                    for tag, prior in (("bad", PRIOR_BAD), ("good", PRIOR_GOOD))}
            rates += [f"ln({rate['g', tag]} / {rate['b', tag]}) AS l{tag}{i}"
                      for tag in ("bad", "good")]
        total = " + ".join(f"CASE v{i} WHEN -1 THEN lbad{i} WHEN 1 THEN lgood{i} ELSE 0.0 END"
                           for i in range(len(RULES)))
        share = f"((g / (g + b) + {PRIOR_WEIGHT} * {GOOD_SHARE}) / (1 + {PRIOR_WEIGHT}))"
        rates.append(f"ln({share} / (1 - {share})) AS odds")
        steps += [
            f"s{k} AS MATERIALIZED (SELECT {', '.join(sums)} FROM p{k})",
            f"r{k} AS MATERIALIZED (SELECT {', '.join(rates)} FROM s{k})",
            f"p{k + 1} AS MATERIALIZED (SELECT {vs}, n, 1 / (1 + exp(-(odds + {total}))) AS p FROM pat, r{k})"]
    return rf"""
WITH base AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT rid, i, array_to_string(list_slice(ws, i, i + {WINDOW - 1}), ' ') AS s
    FROM base, unnest(range(1, len(ws) - {WINDOW - 2})) AS u(i)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, range({WINDOW}) AS r(k) GROUP BY rid),
cnt AS (SELECT base.rid, doc_id, t, len(ws)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^{SYMBOLS}]', '', 'g'))::BIGINT AS n_symbols,
    length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals,
    length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_shouts,
    len([x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')])::BIGINT AS n_lines,
    len(list_distinct([x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')]))::BIGINT AS n_own,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM base LEFT JOIN cov ON cov.rid = base.rid),
f AS (SELECT *, n_lines - n_own AS n_dup_lines,
    n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM cnt),
v AS MATERIALIZED (SELECT *, {rules} FROM f),
pat AS MATERIALIZED (SELECT {vs}, count(DISTINCT t)::DOUBLE AS n FROM v GROUP BY {vs}),
{', '.join(steps)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND p >= {CUT} AS kept FROM v JOIN p{ROUNDS} USING ({vs})"""
