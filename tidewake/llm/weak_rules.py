"""Quality rules under weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a text. Votes are counted by
pattern over all documents; expectation-maximisation over those counts estimates how
often each rule is right about good and about bad texts, and the share of good texts.
A document's posterior probability of good quality replaces a demand that all rules pass.

Rules are expressions of Spark SQL. There are at most 3 ** len(RULES) patterns (6561), so
what the driver gets doesn't grow with the input.

Defined results: null and empty texts, and those without a word, get abstentions only and
so the prior as posterior; repeated rows each get a row; an empty table gives an empty
result; a text of a language without a stop-word list (by ``lang``, or without that by a
script other than Latin) gets no vote on stop words; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.runtime import cut

STOPWORDS = {
    "en": "the of and to in is it that for was on as with be by this are from at an or not",
    "fr": "le la les de des du et un une est que qui en dans pour par sur au aux il elle ne pas avec",
    "de": "der die das und den dem ein eine ist nicht mit von zu sich auf für im es auch als",
    "es": "el los las del y o se su con no lo al una por para como más pero sus",
}
#: name: (measure, bad, good), the latter as SQL conditions on x.
RULES = {
    "symbols": ("symbols / chars", "x > 0.05", "x < 0.01"),
    "capitals": ("capitals / letters", "x > 0.30", "x < 0.12"),
    "stopwords": ("if(listed, stops / words, null)", "x < 0.05", "x > 0.15"),
    "adjacent_repeats": ("repeats / words", "x > 0.10", "x < 0.02"),
    "word_length": ("(chars - words + 1) / words", "x > 12 or x < 2", "x between 3 and 9"),
    "doubled_marks": ("doubled / words", "x > 0.10", "x < 0.005"),
    "length": ("cast(words as double)", "false", "x >= 50"),
    "distinct_words": ("if(words >= 50, distinct_words / words, null)", "x < 0.15", "x > 0.30"),
}
ROUNDS = 200
#: Beliefs before any vote, held as if from SEEN votes: a good text seldom trips a rule, a bad
#: one trips about a third of them, since each rule looks for one kind of fault.
RIGHT_ON_GOOD, RIGHT_ON_BAD, SEEN, PRIOR = 0.98, 0.35, 20.0, 0.8


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, counts of a text)."""
    count = lambda p: F.regexp_count("text", F.lit(p)).cast("double")
    lang = F.lower(F.substring_index("lang", "-", 1)) if "lang" in docs.columns else F.lit(None).cast("string")
    latin = F.regexp_count("text", F.lit(r"\p{IsLatin}")) * 2 >= F.regexp_count("text", F.lit(r"\p{L}"))
    return docs.select(
        "doc_id", F.when(lang.isNull() | (lang == "und"), latin).otherwise(lang.isin(*STOPWORDS)).alias("listed"), F.length("text").cast("double").alias("chars"), count(r"\S+").alias("words"), count(r"[^\p{L}\p{N}\s.,;:!?'\"()-]").alias("symbols"), count(r"\p{Lu}").alias("capitals"), count(r"\p{L}").alias("letters"),
        count(r"(?i)(?<![\p{L}\p{N}])(?:" + "|".join(sorted({w for x in STOPWORDS.values() for w in x.split()})) + r")(?![\p{L}\p{N}])").alias("stops"), count(r"(?i)(?<!\S)(\S+)(?=\s+\1(?!\S))").alias("repeats"), count(r"([!?|#%&*$.])\1").alias("doubled"),
        F.size(F.array_distinct(F.split("text", r"\s+"))).cast("double").alias("distinct_words"),
    )


def votes(docs: DataFrame) -> DataFrame:
    """(doc_id, a vote of each rule)."""
    m = measures(docs)
    for c in ("chars", "words", "letters"):
        m = m.withColumn(c, F.when(F.col(c) > 0, F.col(c)))
    for name, (x, bad, good) in RULES.items():
        m = m.withColumn("x", F.expr(x)).withColumn(f"v_{name}", F.expr(f"cast(case when {bad} then -1 when {good} then 1 else 0 end as tinyint)"))
    return m.select("doc_id", *(f"v_{n}" for n in RULES))


def estimate(patterns: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """(P(vote good | good), P(vote bad | bad), share of good) from distinct vote patterns and their counts."""
    rules = patterns.shape[1]
    good, bad, prior = np.full(rules, RIGHT_ON_GOOD), np.full(rules, RIGHT_ON_BAD), PRIOR
    yes, no = patterns == 1, patterns == -1
    for _ in range(rounds):
        z = np.log(prior / (1 - prior)) + yes @ np.log(good / (1 - bad)) + no @ np.log((1 - good) / bad)
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        w1, w0 = n * p, n * (1 - p)
        good = (w1 @ yes + SEEN * RIGHT_ON_GOOD) / (w1 @ (yes | no) + SEEN)
        bad = (w0 @ no + SEEN * RIGHT_ON_BAD) / (w0 @ (yes | no) + SEEN)
        prior = float((w1.sum() + SEEN * PRIOR) / (n.sum() + SEEN))
    return good, bad, prior


def posteriors(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, votes_good, votes_bad, posterior, keep): a row for each document."""
    v = cut(votes(docs))
    names = [f"v_{n}" for n in RULES]
    got = v.groupBy(*names).count().toPandas()
    good, bad, prior = estimate(got[names].to_numpy(np.int64).reshape(-1, len(names)), got["count"].to_numpy(np.float64), rounds)
    z = F.lit(float(np.log(prior / (1 - prior))))
    for c, g, b in zip(names, good, bad, strict=True):
        z = z + F.when(F.col(c) == 1, float(np.log(g / (1 - b)))).when(F.col(c) == -1, float(np.log((1 - g) / b))).otherwise(0.0)
    p = 1 / (1 + F.exp(-z))
    tally = lambda x: sum((F.when(F.col(c) == x, 1).otherwise(0) for c in names), F.lit(0))
    return v.select("doc_id", tally(1).alias("votes_good"), tally(-1).alias("votes_bad"), p.alias("posterior"), (p >= 0.5).alias("keep"))
