"""Quality rules: hard base rules, then robust multivariate outliers per language and source.

Base statistics come from whole texts inside one row (word windows are compared as sorted hashes,
so nothing is exploded). Each document becomes a vector of four transformed statistics. For every
(language, source), every language and the whole corpus, concentration steps find the
minimum-covariance-determinant location and scatter: from the medians, the ``core`` share of
documents with the smallest Mahalanobis distances gives the next mean and covariance. The estimate
of a small group leans on its language's, and that on the corpus's, by ``prior`` documents, in the
same way at every size. A document is rejected if its squared distance exceeds the chi-square
quantile at 1 - ``alpha``.

Where nearly all documents of a group agree in a statistic (no symbols, no repeated lines), their
scatter is no scale. Each statistic's standard deviation is therefore at least the chance noise of a
document of the group's median length (``NOISE``): longer documents are held to tighter bounds.

Everything is DataFrame code. A step shuffles one row per group and distance bin, never documents;
sums are taken over integers, so they do not depend on the order of tasks.

Defined cases: a null or empty text has no words and fails the base rules; null languages and
sources are groups of their own; documents that fail the base rules take no part in the estimates;
repeated rows each count; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import WORD, materialise, row_key

DIMS = 4
UNITS = ["words", "lines"]
GROUP_FILES = 8
SCALE = 4096  # vectors are stored as integers of 1 / SCALE
# Chance noise of each statistic: (a, unit, b) is a deviation of a / sqrt(median of the unit + b). Word
# lengths vary by about half their mean; a root of a count has a deviation of 1/2 if its events
# are single lines, 1 for symbols (which come in pairs and lists), and sqrt(10) / 2 for words under
# repeated windows (10 at a time); b is what the statistic adds to its unit.
NOISE = [(0.5, "words", 30), (1.0, "words", 20), (0.5, "lines", 3), (10 ** 0.5 / 2, "words", 20)]


def base_statistics(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words; drops text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    one = docs.select(
        *[c for c in docs.columns if c != "text"],
        F.regexp_extract_all(text, F.lit(WORD), 0).alias("words"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    n = F.size("words")
    window = F.transform(
        F.when(n >= 5, F.sequence(F.lit(0), n - 5)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(5)]))
    two = one.select(
        *[c for c in one.columns if c not in ("words", "lines")],
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        window.alias("windows"))
    return two.select(*[c for c in two.columns if c != "windows"],
                      _repeat_words(F.col("windows")).alias("n_repeat_words"))


def _repeat_words(windows: Column) -> Column:
    """Words under the windows whose hash occurs twice or more; sorts only where one does."""
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(s: Column) -> Column:
        at = F.filter(
            F.transform(s, lambda x, k: F.when(
                (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"])),
            lambda i: i.isNotNull())
        start = F.struct(F.lit(-5).alias("last"), F.lit(0).alias("total"))
        return F.aggregate(F.sort_array(at), start, lambda acc, i: F.struct(
            i.alias("last"), (acc["total"] + F.least(F.lit(5), i - acc["last"])).alias("total")),
            lambda acc: acc["total"])

    # a one-element array binds the sorted windows to a variable, so they are sorted once
    found = F.get(F.transform(F.array(ordered), covered), F.lit(0))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), found) \
        .otherwise(F.lit(0)).cast("long")


def _vector() -> list[Column]:
    """Transformed statistics; the added counts steady those of short texts."""
    n = F.col("n_words")
    return [F.ln((F.col("word_chars") + 150) / (n + 30)),
            F.sqrt(F.col("n_symbols") / (n + 20)),
            F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 3)),
            F.sqrt(F.col("n_repeat_words") / (n + 20))]


def _keys() -> Column:
    """The groups of a document: the corpus, its language, its language and source."""
    return F.array(F.lit("0"), F.concat(F.lit("1"), F.to_json(F.struct("lang"))),
                   F.concat(F.lit("2"), F.to_json(F.struct("lang", "source"))))


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(DIMS) for j in range(i + 1)]


def _with_inverse_root(stats: DataFrame) -> DataFrame:
    """From columns c_ij (covariance) the lower triangular l_ij with inverse(c) = l' l."""
    out = stats
    for i, j in _pairs():  # Cholesky, by rows
        s = F.col(f"c{i}{j}")
        for k in range(j):
            s = s - F.col(f"g{i}{k}") * F.col(f"g{j}{k}")
        out = out.withColumn(f"g{i}{j}", F.sqrt(s) if i == j else s / F.col(f"g{j}{j}"))
    for j in range(DIMS):  # forward substitution, by columns
        out = out.withColumn(f"l{j}{j}", 1 / F.col(f"g{j}{j}"))
        for i in range(j + 1, DIMS):
            s = F.lit(0.0)
            for k in range(j, i):
                s = s - F.col(f"g{i}{k}") * F.col(f"l{k}{j}")
            out = out.withColumn(f"l{i}{j}", s / F.col(f"g{i}{i}"))
    return out


def _distance() -> Column:
    """Squared Mahalanobis distance of x0.. from m0.. under l_ij."""
    total = F.lit(0.0)
    for i in range(DIMS):
        part = F.lit(0.0)
        for j in range(i + 1):
            part = part + F.col(f"l{i}{j}") * (F.col(f"x{j}") / SCALE - F.col(f"m{j}"))
        total = total + part * part
    return total


def _start(vectors: DataFrame) -> DataFrame:
    """Medians and interquartile ranges as a first location and scatter, and the floors f_i."""
    quartiles = vectors.groupBy("key").agg(
        *[F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 10000).alias(f"q{i}") for i in range(DIMS)],
        *[F.percentile_approx(unit, 0.5, 10000).alias(unit) for unit in UNITS])
    floors = [a / F.sqrt(F.col(unit) + b) for a, unit, b in NOISE]
    roots = [F.lit(0.0).alias(f"l{i}{j}") if i != j else
             (1 / F.greatest(floors[i], (F.col(f"q{i}")[2] - F.col(f"q{i}")[0])
                             / (1.349 * SCALE))).alias(f"l{i}{j}") for i, j in _pairs()]
    return quartiles.select("key", *[(F.col(f"q{i}")[1] / SCALE).alias(f"m{i}") for i in range(DIMS)],
                            *[f.alias(f"f{i}") for i, f in enumerate(floors)], *roots)


def _concentrate(vectors: DataFrame, fit: DataFrame, core: float) -> DataFrame:
    """One concentration step: the mean and covariance of each group's nearest ``core`` share, to
    the next distance bin."""
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(DIMS)] + \
        [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in _pairs()]
    bins = (vectors.join(fit, "key")
            .withColumn("bin", F.floor(64 * F.ln(1 + F.least(_distance(), F.lit(1e12)))))
            .groupBy("key", "bin").agg(F.count(F.lit(1)).alias("n"), *sums))
    # at most 64 * ln(1e12) rows for each group
    before = (Window.partitionBy("key").orderBy("bin")
              .rowsBetween(Window.unboundedPreceding, -1))
    near = (bins.withColumn("nearer", F.coalesce(F.sum("n").over(before), F.lit(0)))
            .withColumn("all", F.sum("n").over(Window.partitionBy("key")))
            .filter(F.col("nearer") < core * F.col("all")))
    floors = [f"f{i}" for i in range(DIMS)]
    total = near.groupBy("key").agg(
        F.max("all").alias("size"), F.sum("n").alias("n"),
        *[F.sum(f"s{i}").alias(f"s{i}") for i in range(DIMS)],
        *[F.sum(f"s{i}{j}").alias(f"s{i}{j}") for i, j in _pairs()]) \
        .join(fit.select("key", *floors), "key")
    mean = {i: F.col(f"s{i}") / F.col("n") / SCALE for i in range(DIMS)}
    return total.select(
        "key", "size", *floors, *[m.alias(f"m{i}") for i, m in mean.items()],
        *[((F.col(f"s{i}{j}") / F.col("n") / SCALE ** 2 - mean[i] * mean[j]) * consistency(core)
           + (F.col(f"f{i}") ** 2 if i == j else F.lit(0.0))).alias(f"c{i}{j}") for i, j in _pairs()])


def _chi2_cdf(x: float, dof: int) -> float:
    """Chi-square distribution for an even number of degrees of freedom."""
    half = x / 2
    return 1 - math.exp(-half) * sum(half ** k / math.factorial(k) for k in range(dof // 2))


def chi2_quantile(p: float, dof: int = DIMS) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, dof) < p else (low, mid)
    return high


def consistency(core: float) -> float:
    """Factor that makes the scatter of the core that of a whole normal sample."""
    return core / _chi2_cdf(chi2_quantile(core), DIMS + 2)


def fit_scatter(vectors: DataFrame, core: float = 0.75, steps: int = 5) -> DataFrame:
    """key, size, m_i, c_ij of every group of (key, x0..x3, words, lines)."""
    fit = materialise(_start(vectors), "mcd", GROUP_FILES)
    for step in range(steps):
        found = _concentrate(vectors, fit, core)
        if step == steps - 1:
            return materialise(found, "mcd", GROUP_FILES)
        fit = materialise(_with_inverse_root(found).select(
            "key", *[f"f{i}" for i in range(DIMS)], *[f"m{i}" for i in range(DIMS)],
            *[f"l{i}{j}" for i, j in _pairs()]), "mcd",
                          GROUP_FILES)
    raise ValueError("steps must be positive")


def _lean(fit: DataFrame, on: DataFrame, prior: float) -> DataFrame:
    """Each group's estimate drawn to that of the group at its ``up`` key by ``prior`` documents."""
    values = [f"m{i}" for i in range(DIMS)] + [f"c{i}{j}" for i, j in _pairs()]
    above = on.select(F.col("key").alias("up"), *[F.col(v).alias(f"up_{v}") for v in values])
    share = F.col("size") / (F.col("size") + prior)
    return fit.join(above, "up").select(
        "key", "size", *[(share * F.col(v) + (1 - share) * F.col(f"up_{v}")).alias(v) for v in values])


def judge(docs: DataFrame, core: float = 0.75, steps: int = 5, prior: float = 50.0,
          alpha: float = 1e-6, min_words: int = 10, repeat_percent: int = 20,
          id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          source_col: str = "source") -> DataFrame:
    """doc_id, row_key (see ``row_key``), the base statistics, base_failed, distance (null if
    base_failed) and kept, for every input row."""
    key = row_key(docs, text_col)
    rows = docs.select(*[F.col(f"`{c}`").alias(k) for k, c in (
        ("doc_id", id_col), ("text", text_col), ("lang", lang_col), ("source", source_col))],
        key.alias("row_key"))
    stats = base_statistics(rows)
    failed = (F.col("n_words") < min_words) | \
        (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    stats = materialise(stats.withColumn("base_failed", failed).select(
        "*", _keys().alias("keys"), *[F.round(x * SCALE).cast("long").alias(f"x{i}")
                                      for i, x in enumerate(_vector())]), "quality")
    coords = [f"x{i}" for i in range(DIMS)]
    passed = stats.filter(~F.col("base_failed"))
    vectors = passed.select(F.explode("keys").alias("key"), *coords, F.col("n_words").alias("words"),
                            F.col("n_lines").alias("lines"))
    keys = passed.select(F.get("keys", F.lit(1)).alias("lang_key"),
                         F.get("keys", F.lit(2)).alias("key")).distinct()
    fit = fit_scatter(vectors, core, steps)
    corpus = fit.filter(F.col("key") == "0")
    langs = _lean(fit.filter(F.col("key").startswith("1")).withColumn("up", F.lit("0")),
                  corpus, prior)
    groups = _lean(fit.join(keys, "key").withColumnRenamed("lang_key", "up"), langs, prior)
    final = materialise(_with_inverse_root(groups).select(
        F.col("key").alias("fit_key"), *[f"m{i}" for i in range(DIMS)],
        *[f"l{i}{j}" for i, j in _pairs()]), "mcd", GROUP_FILES)
    distance = F.when(~F.col("base_failed"), _distance())
    judged = (stats.withColumn("key", F.get("keys", F.lit(2)))
              .join(final, F.col("key") == F.col("fit_key"), "left")
              .withColumn("distance", distance))
    return judged.select(
        "doc_id", "row_key", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "distance",
        (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= chi2_quantile(1 - alpha)))
        .alias("kept"))


def keep_documents(docs: DataFrame, **rules) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns."""
    text_col = rules.get("text_col", "text")
    gone = materialise(judge(docs, **rules).filter(~F.col("kept")).select("row_key").distinct(),
                       "rejected")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                        row_key(docs, text_col).alias("row_key"))
    return keyed.join(gone, "row_key", "left_anti").select("doc.*")
