"""Quality rules with risk-controlled cutoffs (DataFrame functions only).

Each rule rejects a document whose ratio lies above a cutoff. The cutoffs of a
stratum (the language) are chosen on labelled documents: going from the most
lenient to the strictest, a cutoff holds while the exact binomial probability
of seeing so few false rejections, if the true share were ``alpha`` / rules, is
at most ``delta`` / (strata x rules). So, with probability 1 - ``delta``, in no
stratum do the rules together reject more than ``alpha`` of the good documents
that pass the base rule (fixed-sequence tests within a rule, Bonferroni across
rules and strata). A stratum with too few labels gets no cutoff and keeps all.

All labels are the holdout, as nothing else is learned from them. The same labels may
pick among the cutoffs that hold: the probability is bounded for all of these at once.

Defined results: a null text counts as empty, so it fails the base rule; a row
whose label is null, or whose id has no label, takes no part in the choice; an
id labelled more than once counts with its lowest quality; repeated rows are
judged one by one; a null language is a stratum of its own; a kept column whose name
begins with wm_ comes back with ``_in`` at the end of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import carry, materialize, quoted

#: Rules by name: the ratio, and cutoffs from lenient to strict.
GRID = (4.0, 3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)
RULES = ("symbols_per_word", "bangs_per_word", "dup_line_share", "repeat_share")
MIN_WORDS = 50
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for a row, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more: windows sorted by hash, neighbours compared, covered words counted."""

    def of(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 3, F.lit(0)).otherwise(_let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = lambda s: F.transform(
            s, lambda e, i: F.when(F.coalesce(F.get(s, i - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False)), e["i"]).otherwise(F.lit(-1))
        )
        places = F.sort_array(F.filter(_let(ordered, again), lambda i: i >= 0))
        steps = lambda p: F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3))))
        return F.aggregate(_let(places, steps), F.lit(0), lambda a, x: a + x)

    return _let(words, of)


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the struct ``wm_f``: the base counts and the ratios of the rules."""
    t = F.coalesce(F.col(text), F.lit(""))
    white = "\t\n\x0b\x0c\r"
    words = F.array_remove(F.split(F.translate(t, white, " " * len(white)), " "), "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    repeated = F.array_remove(F.split(F.translate(t, white, " " * len(white)), " "), "")
    counted = docs.withColumn(
        "wm_f",
        F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.translate(t, " " + white, "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            (F.length(t) - F.length(F.translate(t, "!", ""))).cast("long").alias("n_bangs"),
            F.element_at(F.transform(F.array(lines), lambda x: F.struct(F.size(x).cast("long").alias("all"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))), 1).alias("lines"),
            _repeat_words(repeated).cast("long").alias("n_repeat_words"),
        ),
    )
    f = F.col("wm_f")
    n = F.greatest(f["n_words"], F.lit(1))
    ratios = {
        "symbols_per_word": f["n_symbols"] / n,
        "bangs_per_word": f["n_bangs"] / n,
        "dup_line_share": f["lines"]["dup"] / F.greatest(f["lines"]["all"], F.lit(1)),
        "repeat_share": f["n_repeat_words"] / n,
    }
    return counted.withColumn(
        "wm_f",
        F.struct(
            *[f[c].alias(c) for c in BASE if c != "n_dup_lines"],
            f["lines"]["dup"].alias("n_dup_lines"),
            ((f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > 50 * f["n_words"])).alias("base_failed"),
            *[v.alias(k) for k, v in ratios.items()],
        ),
    )


def tail(k: Column, n: Column, p: Column) -> Column:
    """P(X <= k) for X binomial(n, p), summed term by term in logs."""
    first = F.struct((n * F.log(1 - p)).alias("t"), F.exp(n * F.log(1 - p)).alias("s"))

    def step(a: Column, j: Column) -> Column:
        t = a["t"] + F.log((n - j + 1) / j) + F.log(p / (1 - p))
        return F.struct(t.alias("t"), (a["s"] + F.exp(t)).alias("s"))

    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(terms, first, step)["s"]


def choose_cutoffs(labelled: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """(stratum, rule, cutoff, n, rejected, p): the cutoff chosen for each stratum and rule that has one.

    ``labelled`` has stratum, quality (1 good, 0 bad) and a column for each rule.
    Among the cutoffs that hold, the one that rejects the most bad documents less
    ten times the good ones is chosen, the most lenient of equals.
    """
    sums = [F.sum(F.when((F.col("quality") == q) & (F.col(r) > c), 1).otherwise(0)).alias(f"{r}_{q}_{i}") for r in RULES for i, c in enumerate(GRID) for q in (0, 1)]
    by = labelled.groupBy("stratum").agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("n"), *sums)
    cells = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("i"), F.lit(c).alias("cutoff"), F.col(f"{r}_1_{i}").alias("rejected"), F.col(f"{r}_0_{i}").alias("caught")) for r in RULES for i, c in enumerate(GRID)])
    cells = by.select("stratum", "n", F.explode(cells).alias("c")).select("stratum", "n", "c.*")
    share = F.lit(alpha / len(RULES))
    strata = by.agg(F.count(F.lit(1)).alias("strata"))
    # beyond the mean the probability is near one half or more, so those sums needn't be made
    p = F.when(F.col("rejected") <= F.floor(F.col("n") * share), tail(F.col("rejected"), F.col("n"), share)).otherwise(F.lit(1.0))
    tested = cells.withColumn("p", p).join(F.broadcast(strata)).withColumn("holds", F.col("p") <= F.lit(delta) / (F.col("strata") * len(RULES)))
    w = Window.partitionBy("stratum", "rule")
    kept = tested.withColumn("so_far", F.min(F.col("holds").cast("int")).over(w.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))).where("so_far = 1")
    best = kept.groupBy("stratum", "rule").agg(F.max_by(F.struct("cutoff", "n", "rejected", "caught", "p"), F.struct((F.col("caught") - 10 * F.col("rejected")).alias("u"), (-F.col("i")).alias("l"))).alias("b"))
    return best.select("stratum", "rule", "b.*").where("caught > 0")


def judge(docs: DataFrame, labels: DataFrame, columns: list[str], alpha: float = 0.02, delta: float = 0.05, stratum: str = "lang") -> DataFrame:
    """``columns`` of ``docs``, the struct ``wm_f`` and the boolean ``wm_kept``.

    Counts are made once, in one pass over the texts, and written to the shared
    folder. The cutoffs, a row for each stratum that has one, are broadcast.
    """
    own, names, (text, row_id, group), _ = carry(docs, columns, "", ("text", "doc_id", stratum))
    own = own.select(*map(quoted, names), quoted(text).alias("wm_text"), quoted(row_id).alias("wm_id"), quoted(group).cast("string").alias("wm_stratum"))
    made = features(own, "wm_text").drop("wm_text")
    made = materialize(made, "quality")
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("wm_label_id")).agg(F.min("quality").alias("quality"))
    labelled = made.where(~F.col("wm_f.base_failed")).join(known, F.col("wm_id") == F.col("wm_label_id")).select(F.col("wm_stratum").alias("stratum"), "quality", *[F.col(f"wm_f.{r}").alias(r) for r in RULES])
    chosen = choose_cutoffs(labelled, alpha, delta).groupBy(F.col("stratum").alias("wm_cut_stratum")).agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"wm_cut_{r}") for r in RULES])
    chosen = materialize(chosen, "cutoffs")
    bad = F.lit(False)
    for r in RULES:
        bad = bad | F.coalesce(F.col(f"wm_f.{r}") > F.col(f"wm_cut_{r}"), F.lit(False))
    judged = made.join(F.broadcast(chosen), F.col("wm_stratum").eqNullSafe(F.col("wm_cut_stratum")), "left")
    return judged.withColumn("wm_kept", ~F.col("wm_f.base_failed") & ~bad).drop("wm_id", "wm_stratum", *chosen.columns)
