"""Quality rules as weak supervision (operator 6).

Each rule votes good (1) or bad (-1) or abstains (0).  Expectation-maximisation over
the counts of vote patterns estimates how each rule votes on good and on bad documents,
and the posterior probability of a good document replaces all-must-pass filtering: a bad
vote of a rule that others seldom confirm is overruled, one that they confirm condemns.
Features, votes and posterior are DataFrame functions; the driver sees only the counts
of patterns, of which there are at most 3 ** rules, whatever the input.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, log

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import SPACE, UPPER, WORD, column, materialize, refuse, table

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: Frequent function words of English, German, French and Spanish, and what may stand around one.
FUNCTION_WORDS = "the of and to in is that with der die und das nicht ist mit ein de la que el en los et les des un une est por con para y e".split()
AROUND = ".,;:!?\"'()"


@dataclass(frozen=True)
class Rule:
    """Votes -1 where ``bad`` holds, else 1 where ``good`` holds, else abstains."""

    name: str
    bad: str
    good: str

    def vote(self) -> Column:
        return F.expr(f"CASE WHEN {self.bad} THEN -1 WHEN {self.good} THEN 1 ELSE 0 END")


#: Conditions on the feature columns of :func:`text_features`; none divides.
RULES = (
    Rule("length", "n_words < 10", "n_words >= 40"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words", "word_chars >= 3 * n_words AND word_chars <= 12 * n_words"),
    Rule("symbols", "30 * n_symbols > word_chars", "100 * n_symbols <= word_chars"),
    Rule("repeated_words", "10 * n_repeat_words > n_words", "50 * n_repeat_words <= n_words"),
    Rule("duplicate_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines", "n_lines >= 2 AND n_dup_lines = 0"),
    Rule("capitals", "4 * n_upper > word_chars", "10 * n_upper <= word_chars"),
    Rule("exclamations", "10 * n_exclaim > n_words AND n_exclaim >= 3", "100 * n_exclaim <= n_words"),
    Rule("function_words", "n_words >= 20 AND 50 * n_function < n_words", "n_words >= 20 AND 20 * n_function >= n_words"),
)
#: What :func:`text_features` counts.
FEATURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_upper", "n_exclaim", "n_function", "n_repeat_words")


def text_features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col`` and the counts that the rules read, over whole texts; linear but for a sort of a text's windows.

    Repeated windows are told by a 64-bit hash: in a text of n windows, n * n / 2 ** 65 pairs
    are expected to agree by chance (3e-8 in a million words).
    """
    refuse(id_col, *FEATURES, "votes", "good_probability")
    text = F.coalesce(column(text_col), F.lit(""))
    known = F.array(*map(F.lit, FUNCTION_WORDS))
    step = docs.select(column(id_col).alias("__id"), text.alias("t"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"), F.filter(F.split(text, "\n", -1), lambda line: line.rlike(f"[^{SPACE}]")).alias("lines"))
    count_of = lambda chars: F.length("t") - F.length(F.translate("t", chars, ""))
    step = step.select(
        "__id", F.size("words").cast("long").alias("n_words"), F.length(F.translate("t", BLANKS, "")).cast("long").alias("word_chars"), count_of(SYMBOLS).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        count_of(UPPER).cast("long").alias("n_upper"), count_of("!").cast("long").alias("n_exclaim"),
        F.size(F.filter("words", lambda w: F.array_contains(known, F.lower(F.btrim(w, F.lit(AROUND)))))).cast("long").alias("n_function"), F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    rest = [c for c in step.columns if c != "h"]
    # Windows of five words by hash; positions count from 0.
    at = F.when(F.size("h") >= 5, F.sequence(F.lit(0), F.greatest(F.size("h") - 5, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    step = step.select(*rest, F.transform(at, lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(5)])).alias("w"))
    some = F.size(F.array_distinct("w")) < F.size("w")
    step = step.select(*rest, F.when(some, F.sort_array(F.transform("w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))).alias("s"))
    again = F.filter("s", lambda x, k: (x["w"] == F.get("s", k - 1)["w"]) | (x["w"] == F.get("s", k + 1)["w"]))
    step = step.select(*rest, F.when(F.col("s").isNotNull(), F.sort_array(F.transform(again, lambda x: x["i"]))).alias("p"))
    cover = F.aggregate(F.transform("p", lambda p, k: F.least(F.lit(5), F.coalesce(F.get("p", k + 1) - p, F.lit(5)))), F.lit(0).cast("long"), lambda a, x: a + x)
    step = step.select(*rest, F.coalesce(F.when(F.col("p").isNotNull(), cover), F.lit(0).cast("long")).alias("n_repeat_words"))
    return step.withColumnRenamed("__id", id_col)


@dataclass
class VoteModel:
    """For each rule, how often it votes bad when it votes, on good and on bad documents; and the share of good documents."""

    prior: float
    on_good: list[float]
    on_bad: list[float]

    def posterior(self, votes: tuple[int, ...]) -> float:
        z = log(self.prior / (1 - self.prior))
        for g, b, v in zip(self.on_good, self.on_bad, votes, strict=True):
            if v:
                z += log(g / b) if v < 0 else log((1 - g) / (1 - b))
        return 1 / (1 + exp(-max(-50.0, min(50.0, z))))


def fit_votes(patterns: dict[tuple[int, ...], int], *, rounds: int = 1000) -> VoteModel:
    """Expectation-maximisation over vote patterns and their counts; an abstention says nothing.

    The start names the classes: a document with a bad vote is as likely good as bad, any
    other is likely good.  From there on the share of good documents and every rule's rates
    move freely; a count of one on either side (a uniform Beta prior) keeps them off 0 and 1.
    """
    rows = sorted(patterns)
    votes = np.array(rows, float).reshape(len(rows), len(rows[0]) if rows else 0)
    n = np.array([patterns[p] for p in rows], float)
    bad, cast = votes < 0, votes != 0
    good = np.where(bad.any(axis=1), 0.5, 0.9)
    for _ in range(rounds):
        share, rates = (1 + n @ good) / (2 + n.sum()), []
        for weight in (n * good, n * (1 - good)):
            rates.append((1 + weight @ bad) / (2 + weight @ cast))
        on_good, on_bad = rates
        z = log(share / (1 - share)) + bad @ np.log(on_good / on_bad) + (votes > 0) @ np.log((1 - on_good) / (1 - on_bad))
        before, good = good, 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        if np.abs(good - before).max(initial=0.0) < 1e-10:
            break
    return VoteModel(float(share), on_good.tolist(), on_bad.tolist())


def quality_votes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The features, ``votes`` (a string, a digit a rule: vote + 1) and ``good_probability`` of every row.

    Defined cases: a null or empty text has no words and is judged by the votes of
    zero counts.  Rows with equal or null ids are judged each.  Documents with the same
    votes have the same probability.  An empty table gives an empty table.  Other
    columns are not read; an id column with the name of a feature or a result is refused.
    """
    if len(rules) > 9:
        raise ValueError("at most nine rules: the driver counts 3 ** rules patterns")
    voted = text_features(docs, id_col, text_col).withColumn("votes", F.concat(*[(r.vote() + 1).cast("string") for r in rules]))
    voted = materialize(voted, "votes")  # the counts are needed first, and the texts are read once
    patterns = {tuple(int(c) - 1 for c in r.votes): r.n for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    model = fit_votes(patterns)
    known = {"".join(str(v + 1) for v in p): model.posterior(p) for p in sorted(patterns)}
    if not known:
        return voted.withColumn("good_probability", F.lit(None).cast("double"))
    lookup = F.expr("map(" + ", ".join(f"'{k}', {p!r}D" for k, p in known.items()) + ")")
    return voted.withColumn("good_probability", F.element_at(lookup, F.col("votes")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_votes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("good_probability") >= 0.5)).alias("kept"), "votes", "good_probability")
