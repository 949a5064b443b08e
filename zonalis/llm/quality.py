"""Quality rules: text statistics as native expressions, and robust multivariate outliers by minimum covariance determinant per language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.llm.shared import SPACE, forget, small_side, text_or_empty, words, written

WINDOW = 5
#: The transformed statistics, and the least standard deviation each is given, so that a value shared by nearly all rows doesn't make every other value an outlier.
FEATURES = {"log_words": 0.3, "log_word_chars": 0.05, "root_symbols": 0.05, "root_repeats": 0.1}
NAMES = list(FEATURES)
PRIOR_WORDS = 10


def _repeat_words(indexed: str) -> Column:
    """Words inside five-word windows that occur twice or more, from the column of (hash, start) in order: repeated windows' starts in text order, each covering at most five words that the one before didn't."""
    at = lambda k: F.get(F.col(indexed), k)["h"]
    again = F.filter(indexed, lambda x, k: (x["h"] == at(k - 1)) | (x["h"] == at(k + 1)))
    starts = F.sort_array(F.transform(again, lambda x: x["i"]))
    return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at")), lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["at"])).alias("n"), i.alias("at")), lambda s: s["n"])


STATISTICS = ("_n_words", "_word_chars", "_n_symbols", "_n_dup_lines", "_n_repeat_words")


def with_statistics(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (its columns `keep`; all by default) with _n_words, _word_chars, _n_symbols, _n_dup_lines, _n_repeat_words.

    Null text has no words, empty text neither; very long texts are taken whole. Columns of those names that docs already has give way. Each array is made
    in its own projection so that later expressions don't compute it again.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in STATISTICS]
    df = docs.select(F.struct(F.lit(1).alias("_one"), *[F.col(f"`{c}`") for c in keep]).alias("in"), text_or_empty(text_col).alias("text"))
    text = F.col("text")
    df = df.withColumn("w", words(text))
    df = df.withColumn("lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE[1:]}")))
    df = df.withColumn("h", F.transform("w", lambda w: F.xxhash64(w)))
    n = F.size("w")
    h = F.col("h")
    windows = F.transform(F.slice("h", 1, F.greatest(n - WINDOW + 1, F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))
    df = df.withColumn("v", windows)
    starts = F.sequence(F.lit(0), F.size("v") - 1)
    df = df.withColumn("s", F.when(F.size(F.array_distinct("v")) < F.size("v"), F.sort_array(F.arrays_zip(F.col("v").alias("h"), starts.alias("i")))))
    return df.select(
        *[F.col(f"in.`{c}`").alias(c) for c in keep],
        n.cast("long").alias("_n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("_word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("_n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("_n_dup_lines"),
        F.when(F.col("s").isNotNull(), _repeat_words("s")).otherwise(0).cast("long").alias("_n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("_n_words") < 10) | (100 * F.col("_n_repeat_words") > 20 * F.col("_n_words"))


def _features() -> dict[str, Column]:
    """Rates are taken as if each text had PRIOR_WORDS more words of five characters, without symbols or repeats: short texts vary more, and this evens out their spread."""
    n = F.col("_n_words") + PRIOR_WORDS
    chars = F.col("_word_chars") + 5 * PRIOR_WORDS
    return {"log_words": F.log1p("_n_words"), "log_word_chars": F.log(chars / n), "root_symbols": F.sqrt(F.col("_n_symbols") / chars), "root_repeats": F.sqrt(F.col("_n_repeat_words") / n)}


def _moments(rows: DataFrame, group: list[str]) -> DataFrame:
    """Mean and covariance per group from sums that are added up before the shuffle."""
    sums = {f"s_{a}": F.sum(a) for a in NAMES} | {f"s_{a}_{b}": F.sum(F.col(a) * F.col(b)) for i, a in enumerate(NAMES) for b in NAMES[i:]}
    agg = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in sums.items()])
    mean = {f"m_{a}": F.col(f"s_{a}") / F.col("n") for a in NAMES}
    cov = {f"c_{a}_{b}": F.col(f"s_{a}_{b}") / F.col("n") - mean[f"m_{a}"] * mean[f"m_{b}"] for i, a in enumerate(NAMES) for b in NAMES[i:]}
    return agg.select(*group, "n", *[v.alias(k) for k, v in mean.items()], *[v.alias(k) for k, v in cov.items()])


def _factored(shape: DataFrame, group: list[str]) -> DataFrame:
    """The covariance's Cholesky factor, column by column, after the least variances are added to its diagonal."""
    df = shape
    for j, b in enumerate(NAMES):
        used = sum((F.col(f"l_{b}_{NAMES[k]}") * F.col(f"l_{b}_{NAMES[k]}") for k in range(j)), F.lit(0.0))
        df = df.withColumn(f"l_{b}_{b}", F.sqrt(F.greatest(F.col(f"c_{b}_{b}") + F.lit(FEATURES[b] ** 2) - used, F.lit(FEATURES[b] ** 2 / 4))))
        for a in NAMES[j + 1 :]:
            used = sum((F.col(f"l_{a}_{NAMES[k]}") * F.col(f"l_{b}_{NAMES[k]}") for k in range(j)), F.lit(0.0))
            df = df.withColumn(f"l_{a}_{b}", (F.col(f"c_{b}_{a}") - used) / F.col(f"l_{b}_{b}"))
    return df.select(*group, "n", *[f"m_{a}" for a in NAMES], *[f"l_{a}_{b}" for i, a in enumerate(NAMES) for b in NAMES[: i + 1]])


def _distance(df: DataFrame) -> DataFrame:
    """df with d2, the squared Mahalanobis distance, by forward substitution."""
    for i, a in enumerate(NAMES):
        used = sum((F.col(f"l_{a}_{b}") * F.col(f"z_{b}") for b in NAMES[:i]), F.lit(0.0))
        df = df.withColumn(f"z_{a}", (F.col(a) - F.col(f"m_{a}") - used) / F.col(f"l_{a}_{a}"))
    return df.withColumn("d2", sum((F.col(f"z_{a}") * F.col(f"z_{a}") for a in NAMES), F.lit(0.0)))


def _log_determinant() -> Column:
    return sum((2 * F.log(f"l_{a}_{a}") for a in NAMES), F.lit(0.0))


def fit_mcd(rows: DataFrame, group: list[str], share: float = 0.75, falls: float = 0.01, most_steps: int = 30) -> tuple[DataFrame, int]:
    """Per group: mean, Cholesky factor, number of rows and median squared distance of the minimum-covariance-determinant estimate; and the number of groups.

    Concentration steps: keep the `share` of a group's rows that lie nearest, take their mean and covariance, measure again. A group goes on, of its own, until its
    log-determinant doesn't fall by `falls` any more (the share is found within a two-thousandth of the rows, so less would be chance), or most_steps. They are taken from two starts, the coordinate-wise median with the quartiles' spread and the mean with the covariance of all rows,
    and each group keeps the estimate of the lower determinant. Every step is an aggregate with partial sums, over all rows, so a group of any size is never in one task.
    """
    mid = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(a, [0.25, 0.5, 0.75], 2000).alias(f"q_{a}") for a in NAMES])
    spread = {f"c_{a}_{b}": F.pow((F.col(f"q_{a}")[2] - F.col(f"q_{a}")[0]) / 1.349, 2) if a == b else F.lit(0.0) for i, a in enumerate(NAMES) for b in NAMES[i:]}
    middle = mid.select(*group, "n", *[F.col(f"q_{a}")[1].alias(f"m_{a}") for a in NAMES], *[v.alias(k) for k, v in spread.items()])
    own = [*group, "_start"]
    shape = _factored(middle, group).withColumn("_start", F.lit(0)).unionByName(_factored(_moments(rows, group), group).withColumn("_start", F.lit(1)))
    shape = written(shape.drop("n").withColumns({"_det": F.lit(float("inf")), "_goes_on": F.lit(True)}), "start")
    n, parts = shape.count(), [c for c in shape.columns if c.startswith(("m_", "l_"))]
    for step in range(most_steps):
        last = small_side(shape.where("_goes_on").select(*own, *parts), n)
        measured = _distance(rows.join(last, group))
        near = written(measured.groupBy(*own).agg(F.percentile_approx("d2", share, 2000).alias("edge")), f"edge{step}")
        kept = measured.join(small_side(near, n), own).where("d2 <= edge")
        found = _factored(_moments(kept, own), own).withColumn("_det", _log_determinant())
        both = shape.join(small_side(found.select(*own, F.struct(*parts, "_det").alias("_new")), n), own, "left")
        lower = F.col("_new._det") < F.col("_det")
        taken = [F.when(lower, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in (*parts, "_det")]
        before, shape = shape, written(both.select(*own, *taken, F.coalesce(F.col("_new._det") < F.col("_det") - falls, F.lit(False)).alias("_goes_on")), f"shape{step}")
        forget(before, near)
        if shape.where("_goes_on").isEmpty():
            break
    best = shape.groupBy(*group).agg(F.min_by(F.struct(*parts), F.struct("_det", "_start")).alias("s")).select(*group, "s.*")
    best = written(best, "best")
    measured = _distance(rows.join(small_side(best, n), group))
    middle = measured.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), F.percentile_approx("d2", 0.5, 2000).alias("middle"))
    return written(best.join(middle, group), "mcd"), n // 2


#: So many rows' weight pulls a group's estimate to that of its language, that to the one of all rows, and that to a spread SPREAD times the least.
PRIOR_ROWS, SPREAD = 30, 4


def _covariance(prefix: str = "") -> dict[tuple[str, str], Column]:
    """The covariance of a Cholesky factor's columns, less the least variances."""
    factor = lambda a, b: F.col(f"{prefix}l_{a}_{b}")
    return {(a, b): sum((factor(a, c) * factor(b, c) for c in NAMES[: i + 1]), F.lit(0.0)) - (FEATURES[a] ** 2 if a == b else 0.0) for i, a in enumerate(NAMES) for b in NAMES[i:]}


_DIAGONAL = {f"c_{a}_{a}": a for a in FEATURES}


def _pulled(own: dict[str, Column], to: dict[str, Column], n: Column) -> dict[str, Column]:
    """Estimates of n rows, and of PRIOR_ROWS more as the others say."""
    return {k: (n * v + PRIOR_ROWS * to[k]) / (n + PRIOR_ROWS) for k, v in own.items()}


def _shrunk(fit: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, m_, l_, rows, parent's middle): fit_mcd's estimate of each group (level 0), pulled to its language's (level 1), which is pulled to that of all (level 2), by their numbers of rows. So a group of one row is judged as its language is, a large one by itself, and nothing turns at any size."""
    named = lambda level: fit.where(F.col("_level") == level)
    part = lambda level, on: named(level).select(*on, F.struct(*[F.col(c) for c in fit.columns if c.startswith(("m_", "l_"))], "rows", "middle").alias(f"_{level}"))
    # each side has a row a group, a language, and one in all
    both = part(0, keys).join(F.broadcast(part(1, keys[:1])), keys[0]).withColumn("_one", F.lit(1)).join(F.broadcast(part(2, []).withColumn("_one", F.lit(1))), "_one")

    def of(level: int) -> dict[str, Column]:
        at = f"_{level}."
        own = {f"m_{a}": F.col(f"{at}m_{a}") for a in NAMES} | {f"c_{a}_{b}": v for (a, b), v in _covariance(at).items()} | {"middle": F.col(f"{at}middle")}
        above = of(level + 1) if level < 2 else {k: v if k[0] == "m" else F.lit((SPREAD**2 - 1) * FEATURES[_DIAGONAL[k]] ** 2 if k in _DIAGONAL else 0.0) for k, v in own.items()}
        return _pulled(own, above, F.col(f"{at}rows"))

    made = both.select(*keys, F.col("_0.rows").alias("n"), *[v.alias(k) for k, v in of(0).items()])
    return _factored(made, [*keys, "middle"]).withColumnRenamed("n", "rows")


#: Median of the chi-square law with as many degrees of freedom as there are features, to which distances are scaled.
CHI2_MEDIAN = 3.357


def judged(docs: DataFrame, text_col: str = "text", cutoff: float = 75.0, keep_text: bool = False) -> DataFrame:
    """docs with the statistics, _base_failed, _distance and _kept; columns of those names that docs already has give way.

    A document is rejected by the base rules, or if its squared Mahalanobis distance to its language and source, scaled so that the median is the
    chi-square one, exceeds the cutoff (far beyond the 0.9999 quantile, 23.5: clean documents have heavy tails). A group's estimate is pulled to its language's, and that to the one of all documents,
    the more the fewer documents that pass the base rules it has (see _shrunk); no size is judged otherwise than another. Null language or source: groups of their own. Null or empty text: no words,
    fails. Equal rows are judged alike and keep a row each, whatever their ids; an empty table gives an empty result. keep_text False: the result lacks the text, which is read once.
    """
    made = ("_base_failed", "_distance", "_kept")
    named = [c for c in docs.columns if (keep_text or c != text_col) and c not in (*STATISTICS, *made)]
    key = lambda c: F.coalesce(F.concat(F.lit("s"), F.col(f"k.{c}").cast("string")), F.lit("n")) if c in docs.columns else F.lit("n")
    keys = [c for c in ("lang", "source") if c in docs.columns]
    plain = docs.select(text_or_empty(text_col).alias("text"), F.struct(F.lit(1).alias("_one"), *keys).alias("k"), F.struct(F.lit(1).alias("_one"), *[F.col(f"`{c}`") for c in named]).alias("row"))
    table = with_statistics(plain, "text", ["k", "row"])
    table = written(table.select("row", *STATISTICS, base_failed().alias("_base_failed"), key("lang").alias("_lang_"), key("source").alias("_source_")), "statistics")
    group = ["_lang_", "_source_"]
    narrow = table.where(~F.col("_base_failed")).select(*group, *[v.alias(k) for k, v in _features().items()])
    level = lambda k, *kept: F.struct(F.lit(k).alias("_level"), *[(F.col(c) if c in kept else F.lit("")).alias(c) for c in group])
    levels = F.explode(F.array(level(0, *group), level(1, "_lang_"), level(2))).alias("_at")
    fit, n = fit_mcd(narrow.select(levels, *NAMES).select("_at.*", *NAMES), ["_level", *group])
    pulled = written(_shrunk(fit, group), "pulled")
    forget(fit)
    own = _distance(narrow.join(small_side(pulled, n), group)).groupBy(*group).agg(F.percentile_approx("d2", 0.5, 2000).alias("_own"))
    # the middle distance too is pulled to the language's
    fit = written(pulled.join(small_side(own, n), group).withColumn("middle", (F.col("rows") * F.col("_own") + PRIOR_ROWS * F.col("middle")) / (F.col("rows") + PRIOR_ROWS)), "fit")
    forget(pulled)
    out = _distance(table.withColumns(_features()).join(small_side(fit, n), group, "left"))
    scaled = F.col("d2") * CHI2_MEDIAN / F.greatest(F.col("middle"), F.lit(0.5))
    far = F.coalesce(scaled > cutoff, F.lit(False))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in named], *STATISTICS, "_base_failed", scaled.alias("_distance"), (~F.col("_base_failed") & ~far).alias("_kept"))


def quality_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept), a row for each row of docs; nulls, repeats and the empty table as judged has them."""
    out = judged(docs.select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", *[F.col(f"_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])
