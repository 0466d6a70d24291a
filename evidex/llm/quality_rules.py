"""Quality rules under weak supervision, in DataFrame functions only.

Rules vote that a text is good (1) or bad (-1), or abstain (0). A two-class mixture, in which rules are independent given
the class, is fitted to the counts of vote patterns by expectation-maximisation: it estimates how accurate each rule's
votes are on good and on bad texts, and how frequent the classes are; abstentions are no evidence. A text is kept when the
posterior probability that it is good reaches 0.5, unless the base limits reject it. Patterns are counted over all documents
by one aggregate; they are 3^rules rows at most, 19,683, whatever the corpus, so they are fetched once and the rounds of the
fit are arithmetic on the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.llm.rows import new_names
from evidex.session import cut

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
ROUNDS, SETTLED = 15, 1e-4
#: Frequent function words of four languages, for the rule on running text.
FUNCTION_WORDS = """a an and are as at be by for from he in is it of on or that the this to was with
au avec dans de des du elle en est et il la le les ne par pas pour que qui se sur un une
als auch auf das dem den der die ein eine er es für im ist mit nicht sich sie und von zu
al como con del el la las lo los más no para por se su y""".split()


def _layer(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns(columns)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base columns and those that the rules read, a row a document. A null text has no words and no lines."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = _layer(d, words=F.array_remove(F.split("text", SPACE), ""), lines=lines)
    d = _layer(d, n_words=F.size("words").cast("long"), n_lines=F.size("lines").cast("long"))
    starts = F.sequence(F.lit(1), F.size("words") - (WINDOW - 1))
    hashes = F.when(F.col("n_words") > WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, WINDOW))))
    d = d.select(
        "doc_id", "words", "n_words", "n_lines",
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.char_length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.char_length(F.regexp_replace("text", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        F.char_length(F.regexp_replace("text", "[^!?]+", "")).cast("long").alias("n_shouts"),
        F.size(F.filter("lines", lambda x: x.rlike(r"[.!?:;][\x20\x09-\x0D]*$"))).cast("long").alias("n_closed_lines"),
        F.size(F.filter("words", lambda x: F.lower(x).isin(FUNCTION_WORDS))).cast("long").alias("n_function_words"),
        hashes.alias("hashes"),
    )
    # equal windows have equal hashes, so only texts with an equal pair of these are looked at window by window
    d = _layer(d, words=F.when(F.size("hashes") > F.size(F.array_distinct("hashes")), F.col("words"))).drop("hashes")
    window = F.transform(starts, lambda i: F.struct(F.array_join(F.slice("words", i, WINDOW), " ").alias("w"), i.alias("i")))
    d = _layer(d, found=F.sort_array(window)).drop("words")
    twice = F.filter(F.sequence(F.lit(0), F.size("found") - 1), lambda k: ((k > 0) & (F.get("found", k - 1)["w"] == F.get("found", k)["w"])) | F.coalesce(F.get("found", k + 1)["w"] == F.get("found", k)["w"], F.lit(False)))
    d = _layer(d, at=F.sort_array(F.transform(twice, lambda k: F.get("found", k)["i"]))).drop("found")
    steps = F.transform("at", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("at", k + 1) - x, F.lit(WINDOW))))
    repeated = F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return _layer(_layer(d, n_repeat_words=repeated).drop("at"), base_failed=failed)


def votes() -> dict[str, Column]:
    """1, -1 or 0 of each rule, from the columns of statistics(). Ratios over no words, letters or lines abstain."""

    def rule(value: Column, bad: Column, good: Column) -> Column:
        return F.when(value.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0).cast("int")

    c = F.col
    per_word = {k: F.try_divide(k, "n_words") for k in ("word_chars", "n_symbols", "n_repeat_words", "n_shouts", "n_function_words")}
    upper, dup, closed = F.try_divide("n_upper", "n_letters"), F.try_divide("n_dup_lines", "n_lines"), F.try_divide("n_closed_lines", "n_lines")
    length, symbols, repeats, shouts, running = per_word["word_chars"], per_word["n_symbols"], per_word["n_repeat_words"], per_word["n_shouts"], per_word["n_function_words"]
    return {
        "v_length": rule(c("n_words"), c("n_words") < 20, c("n_words") >= 50),
        "v_word_length": rule(length, (length < 2.5) | (length > 15), (length >= 3.5) & (length <= 9)),
        "v_symbols": rule(symbols, symbols > 0.3, symbols < 0.02),
        "v_upper": rule(upper, upper > 0.5, upper < 0.15),
        "v_shouts": rule(shouts, shouts > 0.3, shouts < 0.02),
        "v_dup_lines": rule(dup, dup > 0.3, dup == 0),
        "v_repeats": rule(repeats, repeats > 0.2, repeats == 0),
        "v_closed_lines": rule(closed, closed < 0.2, closed > 0.8),
        "v_running_text": rule(running, running < 0.05, running > 0.15),
    }


def fit(voted: DataFrame, rules: list[str], rounds: int = ROUNDS) -> dict:
    """The mixture: the prior of good texts, and the log odds (good against bad) of each rule's votes -1, 0 and 1."""
    rows = voted.groupBy(*rules).agg(F.count("*").alias("n")).orderBy(*rules).collect()  # 3^rules rows at most
    votes_of, n = np.array([r[:-1] for r in rows], int).reshape(-1, len(rules)), np.array([r[-1] for r in rows], float)
    model = {"prior": 0.0, "odds": {r: [-2.0, 0.0, 0.5] for r in rules}}
    total, before = n.sum(), None
    for _ in range(rounds if total else 0):
        odds = np.array([model["odds"][r] for r in rules])
        good = n / (1 + np.exp(-(model["prior"] + np.take_along_axis(odds, (votes_of + 1).T, axis=1).sum(axis=0))))
        n_good = min(max(good.sum(), 1e-9), total - 1e-9)
        model = {"prior": math.log((n_good + 1) / (total - n_good + 1)), "odds": {}}
        for k, r in enumerate(rules):
            (bad_g, good_g), (bad_b, good_b) = ([w[votes_of[:, k] == v].sum() + 1 for v in (-1, 1)] for w in (good, n - good))
            g, b = bad_g + good_g, bad_b + good_b  # of the votes cast; an abstention says nothing
            model["odds"][r] = [math.log(bad_g / g) - math.log(bad_b / b), 0.0, math.log(good_g / g) - math.log(good_b / b)]
        if before is not None and abs(n_good - before) <= SETTLED * total:
            break
        before = n_good
    return model


def posterior(model: dict) -> Column:
    """The probability that a text with these votes is good."""
    total = F.lit(model["prior"])
    for r, odds in model["odds"].items():
        total = total + F.when(F.col(r) < 0, odds[0]).when(F.col(r) > 0, odds[2]).otherwise(odds[1])
    return 1 / (1 + F.exp(-total))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The query's rows: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the posterior.

    Null and blank texts have no words and fail the base. Repeated rows are judged, and counted in the fit, one by one.
    A null doc_id stays null; no documents give no rows. Columns besides the two named are not read.
    """
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rules = votes()
    voted = cut(statistics(docs, id_col, text_col).select(*base, *(v.alias(k) for k, v in rules.items())))
    good = posterior(fit(voted, list(rules)))
    return voted.select(*base, (~F.col("base_failed") & (good >= 0.5)).alias("kept"), good.alias("p_good"), *rules)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all columns, whatever their names. Rows go by their texts, so doc_ids may be null
    or repeated: rows of one text are kept or left together. A null text is rejected. No documents give no rows."""
    (key,) = new_names(docs, "text_key")
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    gone = judged(keyed, key).where("not kept").select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(gone, key, "left_anti").select(*docs.columns)
