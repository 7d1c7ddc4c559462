"""Quality rules whose cutoffs carry a guarantee on wrongly rejected documents.

Counts per document come from built-in functions only. A family of nested rule sets, from lenient to strict, takes
its cutoffs from quantiles of one half of the good labelled documents. On the other half, the sets' rejections of
good documents are tested with the exact binomial distribution: a set is certified for a stratum if the
Clopper-Pearson upper bound of its false rejection rate is at most `risk`.

Multiple testing: within a stratum the sets are tested in their order, from lenient to strict, until one fails (a
fixed sequence, which needs no correction); `error` is shared equally by the strata that are tested (Bonferroni).
Those are as many, most labels first, as have enough labels for a certificate at their share; how many that is depends
on the numbers of labels alone, not on what the rules do to them. Each verdict holds for its own stratum. The strictest
certified set holds; a stratum with too few labels or no certificate rejects nothing but what fails the base rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameflow.llm.common import stored

_WINDOW = 8
#: Per rule set, from lenient to strict: the quantile of good documents that gives its cutoffs, and their factor.
LEVELS = ((1.0, 2.0), (1.0, 1.5), (1.0, 1.2), (1.0, 1.0), (0.9995, 1.0), (0.999, 1.0), (0.998, 1.0), (0.996, 1.0), (0.993, 1.0), (0.99, 1.0), (0.985, 1.0), (0.98, 1.0))
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def features(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and the counts of FEATURES for every row of docs (doc_id, text, and lang if it has one).

    Words are `[^\\x20\\x09-\\x0D]+`. A null text has none of anything. n_dup_lines: lines with a word that equal an
    earlier one. n_repeat_words: words inside 8-word windows found twice or more in the text. Windows are compared by
    64-bit hashes within one text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    stratum = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    zero = docs.select(F.col("doc_id").cast("long").alias("doc_id"), stratum.alias("stratum"), text.alias("text"), F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"))
    one = zero.select(
        "doc_id",
        "stratum",
        F.length(F.array_join("words", "")).alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).alias("n_symbols"),
        F.regexp_count("text", F.lit("[A-Z]")).alias("n_upper"),
        F.filter(F.split("text", "\n", -1), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]"))).alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    windows = F.when(
        F.size("h") > _WINDOW,
        F.transform(F.sequence(F.lit(1), F.size("h") - (_WINDOW - 1)), lambda i: F.xxhash64(*[F.element_at("h", i + k) for k in range(_WINDOW)])),
    )
    two = one.select(
        "doc_id", "stratum", "word_chars", "n_symbols", "n_upper",
        F.size("h").alias("n_words"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        windows.alias("w"),
    )
    # only texts with a repeated window need the windows in order of hash
    ordered = F.when(F.size(F.array_distinct("w")) < F.size("w"), F.sort_array(F.transform("w", lambda x, i: F.struct(x.alias("h"), i.alias("p")))))
    three = two.withColumn("s", ordered).drop("w")
    pairs = F.zip_with(F.slice("s", F.lit(1), F.size("s") - 1), F.slice("s", F.lit(2), F.size("s") - 1), lambda a, b: F.when(a.h == b.h, F.array(a.p, b.p)).otherwise(F.array().cast("array<int>")))
    places = F.sort_array(F.array_distinct(F.flatten(pairs)))
    covered = F.aggregate(
        places,
        F.struct(F.lit(-_WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda s, p: F.struct(p.alias("last"), (s.n + F.least(F.lit(_WINDOW), p - s["last"])).alias("n")),
        lambda s: s.n,
    )
    return three.select("doc_id", "stratum", *(F.col(c).cast("long") if c != "n_repeat_words" else F.coalesce(F.when(F.col("s").isNotNull(), covered), F.lit(0)).cast("long").alias(c) for c in FEATURES))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """What the rules measure; more is worse."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "short_words": words / chars,
        "long_words": F.col("word_chars") / words,
        "symbols": F.col("n_symbols") / chars,
        "capitals": F.col("n_upper") / chars,
        "dup_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeats": F.col("n_repeat_words") / words,
    }


def log_at_most(k: Column, n: Column, p: float) -> Column:
    """Logarithm of P(X <= k) of a binomial with n trials of probability p, k below n; terms are summed one by one."""
    first = n * math.log1p(-p)
    odds = math.log(p) - math.log1p(-p)

    def add(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i + 1) / i) + odds
        top, low = F.greatest(s["total"], term), F.least(s["total"], term)
        return F.struct(term.alias("term"), (top + F.log1p(F.exp(low - top))).alias("total"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<long>"))
    return F.aggregate(steps, F.struct(first.alias("term"), first.alias("total")), add, lambda s: s["total"])


def certified(rejected: Column, n: Column, risk: float, error: Column | float) -> Column:
    """True if the Clopper-Pearson upper bound at confidence 1 - error, given these rejections, is at most risk."""
    few = rejected <= n * risk  # with more, the bound lies over the risk at any confidence of use
    return (n > 0) & few & (log_at_most(F.when(few, rejected).otherwise(F.lit(0)), n, risk) <= F.log(F.lit(error)))


def exceeded(cutoffs: dict[str, list[float]]) -> Column:
    """How many rule sets reject the document by some rule."""
    each = [sum(((rule > F.lit(c)).cast("int") for c in cutoffs[name]), F.lit(0)) for name, rule in rules().items() if cutoffs.get(name)]
    return F.greatest(*each) if len(each) > 1 else each[0] if each else F.lit(0)


def cutoffs(good: DataFrame) -> dict[str, list[float]]:
    """Per rule the cutoffs of all sets, from rows of features(); none without rows."""
    names = rules()
    shares = sorted({share for share, _ in LEVELS})
    row = good.agg(*(F.percentile_approx(c, shares, 20000).alias(k) for k, c in names.items())).first()
    return {k: [dict(zip(shares, row[k]))[share] * factor for share, factor in LEVELS] for k in names if row[k] is not None}


def tested_strata(sizes: dict[int, int], risk: float, error: float) -> int:
    """How many strata can be tested, from how many there are by number of labels: the most for which as many strata have
    the labels that a certificate takes when none of them is rejected and error is shared."""
    m = 0
    while sum(k for n, k in sizes.items() if n >= least_labels(m + 1, risk, error)) > m:
        m += 1
    return m


def least_labels(strata: int, risk: float, error: float) -> int:
    return math.ceil(math.log(error / strata) / math.log1p(-risk))


def allowances(tested: DataFrame, risk: float, error: float) -> DataFrame:
    """(stratum, allowed) from good documents (stratum, over: how many sets reject it): with more than `allowed` sets
    against it a document goes. Strata without a certificate are left out."""
    sets = len(LEVELS)
    counts = stored(tested.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *(F.sum((F.col("over") >= sets - g).cast("long")).alias(f"r{g}") for g in range(sets))), "strata")
    most = least_labels(10**9, risk, error)  # more labels make no difference to how many strata can be tested
    sizes = {r.n: r["count"] for r in counts.groupBy(F.least("n", F.lit(most)).alias("n")).count().collect()}
    m = tested_strata(sizes, risk, error)
    enough = counts.where(F.col("n") >= (least_labels(m, risk, error) if m else most + 1))
    each = enough.select("stratum", "n", F.posexplode(F.array(*(f"r{g}" for g in range(sets)))).alias("g", "rejected"))
    fine = certified(F.col("rejected"), F.col("n"), risk, error / max(1, m))
    lead = each.groupBy("stratum").agg(F.min(F.when(~fine, F.col("g"))).alias("failed"))
    return lead.select("stratum", (sets - F.coalesce("failed", F.lit(sets))).alias("allowed")).where(F.col("allowed") < sets)


def fit(measured: DataFrame, labels: DataFrame, risk: float = 0.02, error: float = 0.05) -> tuple[dict[str, list[float]], DataFrame]:
    """Cutoffs, and allowances by stratum, from rows of features() and labels (doc_id, quality: 1 good, 0 not; null or
    absent: unlabelled).

    Several labels of a document count as the least. Halves go by the hash of doc_id.
    """
    good = labels.selectExpr("cast(doc_id as long) doc_id", "quality").where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    held = measured.where(~base_failed()).join(good, "doc_id", "left_semi").withColumn("half", F.crc32(F.col("doc_id").cast("string")) % 2)
    found = cutoffs(held.where("half = 0"))
    return found, stored(allowances(held.where("half = 1").select("stratum", exceeded(found).alias("over")), risk, error), "allowances")


def apply(measured: DataFrame, found: dict[str, list[float]], allowed: DataFrame) -> DataFrame:
    """Rows of features() with base_failed, sets exceeded and kept."""
    judged = measured.join(allowed, "stratum", "left").select("*", base_failed().alias("base_failed"), exceeded(found).cast("long").alias("n_exceeded"))
    kept = ~F.col("base_failed") & (F.col("allowed").isNull() | (F.col("n_exceeded") <= F.col("allowed")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "stratum", "n_exceeded")


def judge(docs: DataFrame, labels: DataFrame, risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """One row per row of docs (doc_id, text, lang) with counts, base_failed and kept.

    A null or empty text fails. Null ids and repeated rows are judged like others; without labels only the base rules
    reject. Other columns are ignored.
    """
    measured = stored(features(docs), "quality")
    return apply(measured, *fit(measured, labels, risk, error))
