"""Quality rules: robust multivariate outliers among documents of one language and source.

Each document has a vector of transformed text statistics that vary in any text: word length, marks, short words and
variety of words. Per language and source a minimum-covariance-determinant estimate (location and scatter of the three
quarters of rows that lie closest together) is found by concentration steps. Rows of the language's estimate are added to
those of a language and source, and rows of the general one to those of a language, so that a small group leans on the
larger one and a large one on itself. A document is rejected whose squared Mahalanobis distance exceeds the F point for
that many rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duowave.llm.tables import as_bytes, slices, table
from duowave.plans.scratch import Scratch
from duowave.plans.skew import broadcast_if_small

# Fixed values of the base rule.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
# Vector entries are integers of 1 / GRID below LIMIT * GRID, so that all sums are exact.
GRID, LIMIT = 1024, 16
DIMS = 4
# Share of rows that the estimate rests on, concentration steps, rejection probability of a clean row.
SUPPORT = 0.75
STEPS = 5
REJECT = 1e-6
# Rows of the larger group's estimate that are added to those of a group.
PRIOR_ROWS = 200
# Bins of log2(1 + distance), and of an entry's value.
DISTANCE_BINS, VALUE_BINS = 16, 64
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
# What the vector is made of, besides: bytes in words, marks (visible ASCII but letters and digits), words of up to 3 bytes.
COUNTS = [*STATS, "word_bytes", "n_marks", "n_short", "n_distinct"]
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
SHORT = 3


def base_statistics(text: bytes) -> tuple[int, ...]:
    """The counts in ``COUNTS``."""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    # Code points are the bytes that do not continue one.
    chars = int((np.frombuffer(joined, np.uint8) & 0xC0 != 0x80).sum())
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    marks = len(text) - len(text.translate(None, MARKS))
    short = int((np.fromiter(map(len, words), dtype=np.int64, count=n) <= SHORT).sum())
    seen, doubled = set(), 0
    for line in text.split(b"\n"):
        if line.split(None, 1):
            if line in seen:
                doubled += 1
            else:
                seen.add(line)
    repeated = 0
    if n > 3:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
        if len(number) < n:
            # Pairs are numbered before triples, so that the combined number stays small.
            pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
            _, which, times = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
            again = times[which] > 1
            covered = np.zeros(n, dtype=bool)
            for shift in range(3):
                covered[shift:n - 2 + shift] |= again
            repeated = int(covered.sum())
    return n, chars, symbols, doubled, repeated, len(joined), marks, short, len(set(words))


def with_statistics(packed: DataFrame) -> DataFrame:
    """Add ``COUNTS`` and the integer vector ``x0`` to ``x3``; ``packed`` has ``text`` and columns that do not clash."""
    added = [*COUNTS, *[f"x{i}" for i in range(DIMS)]]
    names = [*packed.columns, *added]

    def compute(batches):
        for batch in slices(batches):
            counts = np.array([base_statistics(t) for t in as_bytes(batch.column("text"))], dtype=np.int64).reshape(-1, len(COUNTS))
            col = dict(zip(COUNTS, counts.T))
            n, size = np.maximum(col["n_words"], 1), np.maximum(col["word_bytes"], 1)
            # Shares by arcsine, whose spread does not depend on the share.
            vectors = [np.log2(np.maximum(col["word_chars"] / n, 1)), np.arcsin(np.sqrt(col["n_marks"] / size)),
                       np.arcsin(np.sqrt(col["n_short"] / n)),
                       np.log2(np.maximum(col["n_distinct"], 1)) / np.log2(np.maximum(n, 2))]
            grid = [np.clip(np.rint(v * GRID), 0, LIMIT * GRID - 1).astype(np.int64) for v in vectors]
            arrays = [pa.array(np.ascontiguousarray(counts[:, i])) for i in range(len(COUNTS))] + [pa.array(v) for v in grid]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names)

    return packed.mapInArrow(compute, T.StructType([*packed.schema.fields, *[T.StructField(c, T.LongType()) for c in added]]))


def base_failed() -> Column:
    """The base rule: too few words, or more than half of them in repeated three-word windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def chi2_tail(x: float, dof: int) -> float:
    """Upper tail probability for even degrees of freedom."""
    term = total = 1.0
    for k in range(1, dof // 2):
        term *= x / 2 / k
        total += term
    return math.exp(-x / 2) * total


def chi2_point(tail: float, dof: int) -> float:
    """Point with the given upper tail, by halving; even degrees of freedom."""
    low, high = 0.0, 1.0
    while chi2_tail(high, dof) > tail:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_tail(mid, dof) > tail else (low, mid)
    return high


def f_point(tail: float, rows: np.ndarray) -> np.ndarray:
    """Point with the given upper tail of squared distances of new rows from an estimate of ``rows`` rows, by halving."""
    n = np.maximum(rows, DIMS + 1).astype(float)
    rest = n - DIMS

    def beyond(f):
        y = rest / (rest + DIMS * f)
        # Closed form for four statistics.
        return y ** (rest / 2) * (1 + rest / 2 * (1 - y))

    low, high = np.zeros(len(n)), np.ones(len(n))
    while (more := beyond(high) > tail).any():
        high = np.where(more, high * 2, high)
    for _ in range(100):
        mid = (low + high) / 2
        above = beyond(mid) > tail
        low, high = np.where(above, mid, low), np.where(above, high, mid)
    return DIMS * (n * n - 1) / (n * (n - DIMS)) * high


# Factor that makes the scatter of the inner SUPPORT of normal rows unbiased.
CONSISTENCY = SUPPORT / (1 - chi2_tail(chi2_point(1 - SUPPORT, DIMS), DIMS + 2))
# Variance of rounding to the grid, the least variance of any entry.
ROUNDING = 1 / 12 / GRID**2
_PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]
_GROUP = ["level", "lang", "source"]
_ESTIMATE = "level int, lang string, source string, n long, centre array<double>, scatter array<double>, precision array<double>"


def _estimate(key: pd.DataFrame, n: int, centre: np.ndarray, scatter: np.ndarray) -> pd.DataFrame:
    scatter = scatter + ROUNDING * np.eye(DIMS)
    precision = np.linalg.inv(scatter)
    out = key[_GROUP].head(1).copy()
    out["n"], out["centre"] = n, [centre.tolist()]
    for name, matrix in (("scatter", scatter), ("precision", precision)):
        out[name] = [[float(matrix[p]) for p in _PAIRS]]
    return out


def _start(rows: DataFrame) -> DataFrame:
    """First estimate per group: medians and median deviations, read off counts on a fixed grid."""
    step = GRID // VALUE_BINS
    entries = F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.expr(f"x{i} div {step}").alias("bin")) for i in range(DIMS)]))
    counted = rows.select(*_GROUP, entries.alias("e")).groupBy(*_GROUP, "e.dim", "e.bin").agg(F.count("*").alias("k"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        centre, spread, n = np.zeros(DIMS), np.zeros(DIMS), 0
        for dim, part in pdf.groupby("dim"):
            value, k = (part["bin"].to_numpy() + 0.5) / VALUE_BINS, part["k"].to_numpy()

            def middle(v: np.ndarray) -> float:
                order = np.argsort(v, kind="stable")
                return float(v[order][np.searchsorted(np.cumsum(k[order]), k.sum() / 2)])

            n, centre[dim] = int(k.sum()), middle(value)
            spread[dim] = 1.4826 * middle(np.abs(value - centre[dim]))
        return _estimate(pdf, n, centre, np.diag(spread**2))

    # At most DIMS * LIMIT * VALUE_BINS rows per group.
    return counted.groupBy(*_GROUP).applyInPandas(fit, _ESTIMATE)


def distance() -> Column:
    """Squared Mahalanobis distance of ``x0`` to ``x3`` from columns ``centre`` and ``precision``."""
    gap = [F.col(f"x{i}") / float(GRID) - F.col("centre")[i] for i in range(DIMS)]
    parts = [(1.0 if i == j else 2.0) * F.col("precision")[k] * gap[i] * gap[j] for k, (i, j) in enumerate(_PAIRS)]
    return sum(parts[1:], parts[0])


def _concentrate(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """One step: location and scatter of the rows nearest to the present estimate."""
    there = broadcast_if_small(estimates.select(*[F.col(c).alias(f"g_{c}") for c in _GROUP], "centre", "precision"))
    same = (rows["level"] == there["g_level"]) & rows["lang"].eqNullSafe(there["g_lang"]) & rows["source"].eqNullSafe(there["g_source"])
    binned = rows.join(there, same).withColumn(
        "bin", F.floor(F.log2(1 + F.greatest(distance(), F.lit(0.0))) * DISTANCE_BINS))
    sums = {f"s{i}": F.sum(f"x{i}") for i in range(DIMS)} | {f"s{i}_{j}": F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i, j in _PAIRS}
    moments = binned.groupBy(*_GROUP, "bin").agg(F.count("*").alias("k"), *[v.alias(c) for c, v in sums.items()])
    summed = ["k", *sums]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        n = int(pdf["k"].sum())
        inner = pdf.head(int(np.searchsorted(np.cumsum(pdf["k"].to_numpy()), SUPPORT * n)) + 1)
        # Sums of integers are exact, so neither partitions nor retries change the estimate.
        total = {c: int(inner[c].sum()) for c in summed}
        k = total["k"]
        scatter = np.zeros((DIMS, DIMS))
        for i, j in _PAIRS:
            scatter[i, j] = scatter[j, i] = (k * total[f"s{i}_{j}"] - total[f"s{i}"] * total[f"s{j}"]) / (k * GRID) ** 2
        return _estimate(pdf, n, np.array([total[f"s{i}"] / (k * GRID) for i in range(DIMS)]), CONSISTENCY * scatter)

    return moments.groupBy(*_GROUP).applyInPandas(fit, _ESTIMATE)


def _matrices(flat: np.ndarray) -> np.ndarray:
    out = np.zeros((len(flat), DIMS, DIMS))
    for k, (i, j) in enumerate(_PAIRS):
        out[:, i, j] = out[:, j, i] = flat[:, k]
    return out


def _added(own, larger, prior_rows: int):
    """Rows, centres and scatters of estimates with up to ``prior_rows`` rows of the larger groups' estimates added."""
    (n, c, s), (m, d, t) = own, larger
    extra = np.minimum(m, prior_rows)
    w = (n / (n + extra))[:, None]
    gap = c - d
    between = (w * (1 - w))[..., None] * gap[:, :, None] * gap[:, None, :]
    return n + extra, w * c + (1 - w) * d, w[..., None] * s + (1 - w)[..., None] * t + between


def blended(own: DataFrame, by_lang: DataFrame, general: DataFrame, prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """``g_lang``, ``g_source``, ``centre``, ``precision`` and ``cutoff`` of every group in ``own``."""
    def named(df: DataFrame, tag: str) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{tag}_{c}") for c in ("lang", "source", "n", "centre", "scatter")])

    # Few rows: one per language and source, with its language's and the general estimate.
    joined = named(own, "a").join(named(by_lang, "b"), F.col("a_lang").eqNullSafe(F.col("b_lang")))
    joined = joined.withColumn("one", F.lit(0)).join(named(general, "c").withColumn("one", F.lit(0)), "one")

    def blend(parts):
        for pdf in parts:
            if not len(pdf):
                continue
            e = {tag: (pdf[f"{tag}_n"].to_numpy(float), np.stack(pdf[f"{tag}_centre"]), _matrices(np.stack(pdf[f"{tag}_scatter"])))
                 for tag in "abc"}
            n, centre, scatter = _added(e["a"], _added(e["b"], e["c"], prior_rows), prior_rows)
            precision = np.linalg.inv(scatter)
            yield pd.DataFrame({"g_lang": pdf["a_lang"], "g_source": pdf["a_source"], "centre": centre.tolist(),
                                "precision": np.stack([precision[:, i, j] for i, j in _PAIRS], 1).tolist(),
                                "cutoff": f_point(REJECT, n)})

    return joined.mapInPandas(blend, "g_lang string, g_source string, centre array<double>, precision array<double>, cutoff double")


def fit_estimates(stats: DataFrame, steps: int = STEPS, prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """``g_lang``, ``g_source``, ``centre``, ``precision`` and ``cutoff`` for every language and source with rows to judge.

    ``stats`` comes from :func:`with_statistics` and should be a written table. Rows that fail the base rule do not
    take part. Each row counts for its language and source, for its language and for all. Rows of one language and source
    with equal vectors count once, so that copies do not narrow the scatter.
    """
    scratch = Scratch(stats.sparkSession, "quality")
    text = F.lit(None).cast("string")
    levels = F.explode(F.array(
        F.struct(F.lit(2).alias("level"), F.col("lang"), F.col("source")),
        F.struct(F.lit(1).alias("level"), F.col("lang"), text.alias("source")),
        F.struct(F.lit(0).alias("level"), text.alias("lang"), text.alias("source"))))
    vector = [f"x{i}" for i in range(DIMS)]
    different = scratch.write(stats.where(~base_failed()).select("lang", "source", *vector).distinct(), "vectors")
    rows = different.select(levels.alias("g"), *vector).select("g.*", *vector)
    estimates = scratch.write(_start(rows), "start")
    for step in range(steps):
        estimates = scratch.write(_concentrate(rows, estimates), f"step_{step}")
    own, by_lang, general = (estimates.where(F.col("level") == level) for level in (2, 1, 0))
    return scratch.write(blended(own, by_lang, general, prior_rows), "estimates")


def judge(stats: DataFrame, estimates: DataFrame) -> DataFrame:
    """Add ``base_failed``, ``distance2``, ``cutoff`` and ``kept`` to rows with statistics.

    Where no row passed the base rule there is no estimate, and none is needed.
    """
    there = broadcast_if_small(estimates)
    joined = stats.join(there, stats["lang"].eqNullSafe(there["g_lang"]) & stats["source"].eqNullSafe(there["g_source"]), "left")
    return joined.withColumn("base_failed", base_failed()).withColumn("distance2", distance()).withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(F.col("distance2") <= F.col("cutoff"), F.lit(True))
    ).drop("g_lang", "g_source", "centre", "precision")


def _packed(df: DataFrame, text_col: str, lang_col: str, source_col: str, **others: Column) -> DataFrame:
    return df.select(df[text_col].cast("string").alias("text"), df[lang_col].cast("string").alias("lang"),
                     df[source_col].cast("string").alias("source"), *[c.alias(n) for n, c in others.items()])


def quality_verdicts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                     source_col: str = "source") -> DataFrame:
    """``id``, ``lang``, ``source``, the counts, ``base_failed``, ``distance2``, ``cutoff`` and ``kept`` per row, without texts.

    Null texts have no words and fail the base rule. Null languages and sources are groups like any other. Rows are
    judged singly, so repeated rows get equal verdicts. An empty table gives no rows. Other columns are not read.
    """
    packed = _packed(df, text_col, lang_col, source_col, id=df[id_col])
    stats = Scratch(df.sparkSession, "statistics").write(with_statistics(packed).drop("text"), "rows")
    return judge(stats, fit_estimates(stats))


def keep_good(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``df`` that are kept, with the columns of ``df``.

    Statistics are made twice, once for the estimates and once beside the texts: that costs a second reading, but no
    text is shuffled or written. Null texts, and empty ones, fail the base rule and go; null languages and sources are
    groups. Repeated rows stay or go together. An empty table gives no rows. Other columns stay as they are.
    """
    packed = _packed(df, text_col, lang_col, source_col)
    stats = Scratch(df.sparkSession, "statistics").write(with_statistics(packed).drop("text"), "rows")
    others = [df[c] for c in df.columns if c != text_col]
    whole = _packed(df, text_col, lang_col, source_col, row=F.struct(F.lit(0).alias(text_col), *others))
    kept = judge(with_statistics(whole), fit_estimates(stats)).where("kept")
    return kept.select(*[(F.col("text") if c == text_col else F.col("row")[c]).alias(c) for c in df.columns])


def op2(spark, sf_dir: str) -> DataFrame:
    """``op2_robust_outliers``: statistics and verdict of every document."""
    found = quality_verdicts(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), *STATS, "base_failed", "kept", "distance2", "cutoff")
