"""Quality rules as weak supervision (DataFrame functions only).

Eleven rules look at statistics of a whole text and vote good, bad or abstain. None of them decides: a good
document may well be short or repeat a line. How often each rule votes bad, abstains and votes good on good
and on bad documents is estimated without labels by expectation-maximisation over the counts of vote
patterns (at most 3^11 of them, whatever the corpus size), starting from whether a document has more bad
votes than the documents have on average and with a Dirichlet prior that says no more than that rules are better than chance. A document is kept when the
posterior probability that it is good reaches a threshold, so one bad vote of a rule that misfires is
outvoted. Hard base limits (fewer than 20 words, or more than 30 % of words in repeated 8-word windows)
reject before that; documents that fail them are no evidence about the rules.

Repeated windows are found by 64-bit hashes of 8 word hashes inside a row: no shuffle, and
n log n time in the words of a text.

Defined results: a null or empty text has no words, fails the base limits and is not kept; repeated
rows get equal verdicts; an empty table gives an empty table; texts are read whole however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportmill.llm.common import WHITE, WORD, col, count_chars, documents, fresh, let, materialize

SYMBOLS = "#*$%&|<>"
STOPS = ".?!"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8
RULES = (
    "word_length", "symbols", "symbols_in_text", "symbols_a_line", "dup_lines", "repeats", "capitals", "shouting", "length", "variety", "stops",
)
STEPS = 15
#: What rules are taken for before any document is seen: the probabilities to vote bad, abstain and vote good on bad
#: (first) and on good documents, and their weight as a part of all documents.
PRIOR = ((0.4, 0.1, 0.5), (0.05, 0.05, 0.9))
STRENGTH = 0.1


def _covered(windows: Column) -> Column:
    """Words covered by windows that occur twice or more; takes the windows' hashes in text order."""
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

    def positions(s: Column) -> Column:
        twice = lambda k: (F.get(s, k)["h"] == F.get(s, k - 1)["h"]) | (F.get(s, k)["h"] == F.get(s, k + 1)["h"])
        return F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), twice), lambda k: F.get(s, k)["p"]))

    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"))
    return F.aggregate(let(ordered, positions), start, step, lambda a: a["n"])


def repeat_words(words: Column) -> Column:
    """Words of an array that lie in 8-word windows found twice or more."""
    hashes = lambda w: F.transform(w, lambda x: F.xxhash64(x))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - WINDOW + 1), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))

    found = let(
        let(hashes(words), windows),
        lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), F.lit(0)).otherwise(_covered(x)),
    )
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(found).cast("long")


def statistics(text: Column) -> Column:
    """One struct with the statistics of a text."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r"), F.size(F.array_distinct(w)).cast("long").alias("u")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    t = F.coalesce(text, F.lit(""))
    return F.struct(of_words.alias("w"), of_lines.alias("l"), (F.length(t) - count_chars(t, WHITE)).alias("chars"),
                    count_chars(t, SYMBOLS).alias("symbols"), count_chars(t, CAPITALS).alias("capitals"), count_chars(t, "!").alias("shouts"), count_chars(t, STOPS).alias("stops"))


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_shouts", "n_distinct", "n_stops")


def with_statistics(df: DataFrame, text: str, names: list[str]) -> DataFrame:
    (s,) = fresh(df, "stats")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    x = col(s)
    got = (x["w"]["n"], x["chars"], x["symbols"], x["l"]["d"], x["w"]["r"], x["l"]["n"], x["capitals"], x["shouts"], x["w"]["u"], x["stops"])
    return df.withColumn(s, statistics(col(text))).select(
        *[col(c) for c in df.columns], *[zero(g).alias(n) for g, n in zip(got, names, strict=True)]
    )


def votes(n: dict[str, str]) -> list[Column]:
    """One vote of each rule: 2 good, 1 abstain, 0 bad. Whole-number tests, so that any engine agrees."""
    words, chars, symbols, dup, rep, lines, caps, shouts, distinct, stops = (col(n[f]) for f in FEATURES)

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, 0).when(good, 2).otherwise(1)

    return [
        vote((chars < 3 * words) | (chars > 7 * words), (chars >= 4 * words) & (chars <= 6 * words)),
        vote(20 * symbols >= words, 200 * symbols <= words),
        vote(100 * symbols >= chars, 1000 * symbols <= chars),
        vote(symbols >= 2 * lines, 5 * symbols <= lines),
        vote(10 * dup >= lines, dup == 0),
        vote(20 * rep >= words, rep == 0),
        vote(20 * caps >= chars, 40 * caps <= chars),
        vote(20 * shouts >= words, 100 * shouts <= words),
        vote(words < 50, words >= 100),
        vote(distinct * distinct < 4 * words, distinct * distinct >= 10 * words),
        vote(50 * stops < words, 25 * stops >= words),
    ]


def fit(patterns: Column, steps: int = STEPS) -> Column:
    """Expectation-maximisation over an array of (pattern, n); gives an array of (pattern, posterior).

    The state is the weight of both classes and, for each rule and class, the probabilities of its three votes. It
    starts from the number of bad votes: a document with one more than the average is as likely good as bad.
    """
    rules = len(RULES)
    digit = lambda p, j: F.floor(p["pattern"] / F.pow(F.lit(3.0), j)).cast("int") % 3
    places = F.array(*[F.lit(j) for j in range(rules)])
    plus = lambda a, b: a + b

    def maximise(q: Column) -> Column:
        weight = lambda y: F.zip_with(patterns, q, lambda p, g: p["n"] * (g if y else 1 - g))
        totals = F.array(*[F.aggregate(weight(y), F.lit(0.0), plus) for y in (0, 1)])

        def rate(t: Column, j: int, y: int, v: int) -> Column:
            part = F.zip_with(patterns, q, lambda p, g: F.when(digit(p, F.lit(j)) == v, p["n"] * (g if y else 1 - g)).otherwise(0.0))
            prior = STRENGTH * (F.get(t, F.lit(0)) + F.get(t, F.lit(1))) + 1
            return (F.aggregate(part, F.lit(0.0), plus) + prior * PRIOR[y][v]) / (F.get(t, F.lit(y)) + prior)

        def state(t: Column) -> Column:
            prior = STRENGTH * (F.get(t, F.lit(0)) + F.get(t, F.lit(1))) + 1
            return F.concat(
                F.array(F.get(t, F.lit(0)) + prior, F.get(t, F.lit(1)) + prior),
                F.array(*[rate(t, j, y, v) for j in range(rules) for y in (0, 1) for v in (0, 1, 2)]),
            )

        return let(totals, state)

    def expect(s: Column) -> Column:
        def posterior(p: Column) -> Column:
            side = lambda y: F.aggregate(
                places, F.ln(F.get(s, F.lit(y))), lambda a, j: a + F.ln(F.get(s, 2 + j * 6 + 3 * y + digit(p, j)))
            )
            return 1 / (1 + F.exp(side(0) - side(1)))

        return F.transform(patterns, posterior)

    bad = lambda p: F.size(F.filter(places, lambda j: digit(p, j) == 0)).cast("double")
    total = lambda x: F.aggregate(F.transform(patterns, x), F.lit(0.0), plus)
    average = total(lambda p: p["n"] * bad(p)) / F.greatest(total(lambda p: p["n"]), F.lit(1.0))
    start = let(average, lambda m: F.transform(patterns, lambda p: 1 / (1 + F.exp(2 * (bad(p) - m - 1)))))
    q = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda q, _: let(maximise(q), expect))
    return F.zip_with(patterns, q, lambda p, g: F.struct(p["pattern"].alias("pattern"), g.alias("posterior")))


def judge(df: DataFrame, *, text: str = "text", threshold: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all by default) with statistics, ``base_failed``, ``posterior`` and ``kept``.

    Statistics are computed once and kept in a table of the shared folder, as they are read twice.
    """
    carry = df.columns if carry is None else carry
    names = fresh(df, *FEATURES)
    pattern, base, posterior, kept, vote_key = fresh(df, "votes", "base_failed", "posterior", "kept", "vote_key")
    n = dict(zip(FEATURES, names, strict=True))
    counted = with_statistics(df.select(*map(col, dict.fromkeys([*carry, text]))), text, names)
    code = sum((v * 3**j for j, v in enumerate(votes(n))), F.lit(0))
    failed = (col(n["n_words"]) < 20) | (100 * col(n["n_repeat_words"]) > 30 * col(n["n_words"]))
    counted = counted.withColumn(base, failed).withColumn(pattern, code.cast("int"))
    stored = materialize(counted.select(*[col(c) for c in carry], *map(col, [*names, base, pattern])), "quality")
    counts = stored.where(~col(base)).groupBy(col(pattern).alias("pattern")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    # at most 3 ** len(RULES) rows: bounded by the rules, not by the data
    fitted = counts.agg(F.sort_array(F.collect_list(F.struct("pattern", "n"))).alias("p")).select(F.inline(fit(F.col("p"))))
    fitted = fitted.select(F.col("pattern").alias(vote_key), F.col("posterior").alias(posterior))
    return (
        stored.join(F.broadcast(fitted), col(pattern) == col(vote_key), "left")
        .drop(vote_key)
        .withColumn(posterior, F.when(~col(base), col(posterior)).otherwise(0.0))  # of documents that fail the limits
        .withColumn(kept, ~col(base) & (col(posterior) >= threshold))
    )


def keep_good(docs: DataFrame, *, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    judged = judge(docs, text=text, threshold=threshold)
    return judged.where(col(judged.columns[-1])).select(*[col(c) for c in docs.columns])


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return judge(docs, carry=["doc_id"]).select("doc_id", *FEATURES[:5], "base_failed", "kept")


def _oracle() -> str:
    features = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
win AS (
  SELECT rid, i AS p, hash(list_slice(w, i, i + 7)) AS h
  FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM docs WHERE len(w) >= 9)),
twice AS (
  SELECT rid, p, count(*) OVER (PARTITION BY rid, h) AS c FROM win),
gaps AS (
  SELECT rid, least(8, coalesce(lead(p) OVER (PARTITION BY rid ORDER BY p) - p, 8)) AS g FROM twice WHERE c >= 2),
rep AS (SELECT rid, sum(g) AS r FROM gaps GROUP BY rid),
f AS (
  SELECT d.rid, d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(t) - len(regexp_extract_all(t, '[\x20\x09-\x0D]')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines,
         len(regexp_extract_all(t, '[A-Z]')) AS n_capitals, len(regexp_extract_all(t, '!')) AS n_shouts,
         len(list_distinct(w)) AS n_distinct, len(regexp_extract_all(t, '[.?!]')) AS n_stops
  FROM docs d LEFT JOIN rep USING (rid)),
voted AS (
  SELECT rid, [
    CASE WHEN word_chars < 3 * n_words OR word_chars > 7 * n_words THEN 0 WHEN word_chars >= 4 * n_words AND word_chars <= 6 * n_words THEN 2 ELSE 1 END,
    CASE WHEN 20 * n_symbols >= n_words THEN 0 WHEN 200 * n_symbols <= n_words THEN 2 ELSE 1 END,
    CASE WHEN 100 * n_symbols >= word_chars THEN 0 WHEN 1000 * n_symbols <= word_chars THEN 2 ELSE 1 END,
    CASE WHEN n_symbols >= 2 * n_lines THEN 0 WHEN 5 * n_symbols <= n_lines THEN 2 ELSE 1 END,
    CASE WHEN 10 * n_dup_lines >= n_lines THEN 0 WHEN n_dup_lines = 0 THEN 2 ELSE 1 END,
    CASE WHEN 20 * n_repeat_words >= n_words THEN 0 WHEN n_repeat_words = 0 THEN 2 ELSE 1 END,
    CASE WHEN 20 * n_capitals >= word_chars THEN 0 WHEN 40 * n_capitals <= word_chars THEN 2 ELSE 1 END,
    CASE WHEN 20 * n_shouts >= n_words THEN 0 WHEN 100 * n_shouts <= n_words THEN 2 ELSE 1 END,
    CASE WHEN n_words < 50 THEN 0 WHEN n_words >= 100 THEN 2 ELSE 1 END,
    CASE WHEN n_distinct * n_distinct < 4 * n_words THEN 0 WHEN n_distinct * n_distinct >= 10 * n_words THEN 2 ELSE 1 END,
    CASE WHEN 50 * n_stops < n_words THEN 0 WHEN 25 * n_stops >= n_words THEN 2 ELSE 1 END] AS votes
  FROM f WHERE NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)),
pat AS MATERIALIZED (SELECT votes, CAST(count(*) AS DOUBLE) AS n FROM voted GROUP BY votes),
v AS MATERIALIZED (SELECT votes, n, unnest(range(len(votes))) AS j, unnest(votes) AS v FROM pat),
prior AS (SELECT * FROM (VALUES """ + ", ".join(f"({v}, {PRIOR[0][v]}::DOUBLE, {PRIOR[1][v]}::DOUBLE)" for v in range(3)) + r""") AS x(v, pb, pg)),
cell AS MATERIALIZED (SELECT j, p.* FROM (SELECT unnest(range(""" + str(len(RULES)) + r""")) AS j), prior p),
bad AS (SELECT votes, n, CAST(len(list_filter(votes, lambda x: x = 0)) AS DOUBLE) AS b FROM pat),
q0 AS MATERIALIZED (SELECT votes, 1 / (1 + exp(2 * (b - (SELECT sum(n * b) / sum(n) FROM bad) - 1))) AS q FROM bad)"""
    steps = []
    for i in range(STEPS):
        steps.append(f"""
c{i} AS MATERIALIZED (SELECT sum(n * (1 - q)) AS bad, sum(n * q) AS good, {STRENGTH} * sum(n) + 1 AS a FROM pat JOIN q{i} USING (votes)),
s{i} AS MATERIALIZED (SELECT j, v, sum(n * (1 - q)) AS bad_v, sum(n * q) AS good_v FROM v JOIN q{i} USING (votes) GROUP BY j, v),
t{i} AS MATERIALIZED (
  SELECT j, v, (coalesce(bad_v, 0) + a * pb) / (bad + a) AS tb, (coalesce(good_v, 0) + a * pg) / (good + a) AS tg
  FROM cell LEFT JOIN s{i} USING (j, v), c{i}),
q{i + 1} AS MATERIALIZED (
  SELECT votes, 1 / (1 + exp(ln(any_value(bad) + any_value(a)) - ln(any_value(good) + any_value(a)) + sum(ln(tb) - ln(tg)))) AS q
  FROM v JOIN t{i} USING (j, v), c{i} GROUP BY votes)""")
    return f"""{features},{",".join(steps)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       coalesce(q >= 0.5, false) AS kept
FROM f LEFT JOIN voted USING (rid) LEFT JOIN q{STEPS} USING (votes)"""


ORACLE = _oracle()
