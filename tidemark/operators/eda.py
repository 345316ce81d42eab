"""Exploration: data profile, associations and statistical tests."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import with_rate_cap
from tidemark.functions.pvalues import chi2_p_value, f_p_value
from tidemark.operators.metrics import DECILES
from tidemark.operators.quality import INCOME_FLOOR, MAX_AGE, MIN_AGE
from tidemark.operators.quantiles import group_median, group_quantiles
from tidemark.schema import DATE, LEAK, TARGET
from tidemark.session import write_stage

RANK_CUTS = 1_023
SMOOTHING = 0.5
IV_ALERT = 0.5            # an information value above this is too good to trust
ASSOCIATION_ALERT = 0.7   # correlation or Cramér's V of a trace of the outcome
DRIFT_SLACK = 0.5         # standard errors a month that a cumulative sum forgives
DRIFT_ALERT = 4.0         # a cumulative sum above this is a shift

# Weekday labels, Monday first.
WEEKDAYS = ["lunes", "martes", "miercoles", "jueves", "viernes", "sabado", "domingo"]


def _stacked(df: DataFrame, columns: list[str], kind: str, keep=()) -> DataFrame:
    """Long form ``variable, valor``: one row per column and input row."""
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast(kind).alias("valor"))
                      for c in columns])
    return df.select(*keep, F.explode(pairs).alias("v")).select(*keep, "v.*")


def _rows_of(aggregated: DataFrame, entries: list[Column]) -> DataFrame:
    """Turn one wide row into one row per entry."""
    return aggregated.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


# --- profile ----------------------------------------------------------------

def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing share and, where a valid range is known, values outside it."""
    out_of_range = {
        "edad": (F.col("edad") < MIN_AGE) | (F.col("edad") > MAX_AGE),
        "ingreso_declarado": F.col("ingreso_declarado") <= INCOME_FLOOR,
        "tasa_interes_anual": F.col("tasa_interes_anual") > F.col("tope_tasa"),
    }
    counts = with_rate_cap(df).agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns],
        *[F.count_if(out_of_range.get(c, F.lit(False))).alias(f"out_{c}") for c in columns])
    return _rows_of(counts, [F.struct(
        F.lit(c).alias("variable"), F.col("n").alias("n"), F.col(f"null_{c}").alias("n_nulos"),
        F.try_divide(F.col(f"null_{c}"), F.col("n")).alias("pct_nulos"),
        F.col(f"out_{c}").alias("n_fuera_rango")) for c in columns])


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles per column."""
    long = _stacked(df, columns, "double")
    moments = long.groupBy("variable").agg(
        F.count("valor").alias("n"), F.avg("valor").alias("media"), F.stddev("valor").alias("desviacion"))
    quartiles = group_quantiles(long, "valor", [0.0, 0.25, 0.5, 0.75, 1.0], ["variable"], few_groups=True)
    names = ["minimo", "q25", "mediana", "q75", "maximo"]
    return moments.join(quartiles.drop("n"), "variable").select(
        "variable", "n", "media", "desviacion", *[F.col("q")[i].alias(c) for i, c in enumerate(names)])


def structural_nulls(df: DataFrame, column: str, category: str) -> DataFrame:
    """Share of missing values of one column within each category."""
    return df.groupBy(category).agg(
        F.count("*").alias("n"), F.count_if(F.col(column).isNull()).alias("n_nulos"),
        F.avg(F.col(column).isNull().cast("double")).alias("pct_nulos"))


def weekday_mismatch(df: DataFrame) -> DataFrame:
    """How often the declared weekday is not that of the date."""
    actual = F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.weekday(DATE) + 1)
    differs = F.col("dia_semana_solicitud") != actual
    return df.agg(F.count("*").alias("n"), F.count_if(differs).alias("n_distinto"),
                  F.avg(differs.cast("double")).alias("pct_distinto"))


def default_rate_by_month(df: DataFrame, score: str) -> DataFrame:
    """Observed against predicted default rate per month."""
    return df.groupBy(F.trunc(DATE, "month").alias("mes")).agg(
        F.count("*").alias("n"), F.avg(F.col(TARGET).cast("double")).alias("tasa_observada"),
        F.avg(score).alias("tasa_predicha"))


def default_drift(df: DataFrame, score: str, slack: float = DRIFT_SLACK, alert: float = DRIFT_ALERT) -> DataFrame:
    """Two-sided cumulative sums, over months, of observed less predicted defaults in standard errors.

    ``alza`` is max(0, alza of the month before + z - slack), ``baja`` the same of -z. Both are written as a prefix
    sum less its running minimum, so no month waits for another. ``deriva`` says which of them is above ``alert``.
    Rows without an outcome, date or score don't count; a month whose predictions are all 0 or 1 has z = 0. Rows are
    summed by month first: the windows see one row a month.
    """
    p, y = F.col(score), F.col(TARGET).cast("double")
    months = (df.where(F.col(TARGET).isNotNull() & F.col(DATE).isNotNull() & p.isNotNull())
              .groupBy(F.trunc(DATE, "month").alias("mes")).agg(
                  F.count("*").alias("n"),
                  F.coalesce(F.try_divide(F.sum(y) - F.sum(p), F.sqrt(F.sum(p * (1 - p)))), F.lit(0.0)).alias("z")))
    order = Window.orderBy("mes").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walks = months.select("mes", "n", "z", F.sum(F.col("z") - slack).over(order).alias("up"),
                          F.sum(-F.col("z") - slack).over(order).alias("down"))
    sums = walks.select("mes", "n", "z", *[(F.col(c) - F.least(F.lit(0.0), F.min(c).over(order))).alias(name)
                                           for c, name in (("up", "alza"), ("down", "baja"))])
    return sums.withColumn("deriva", F.when(F.col("alza") > alert, "alza").when(F.col("baja") > alert, "baja")
                           .otherwise("no"))


# --- correlation ------------------------------------------------------------

def _pair_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    pairs = list(combinations(columns, 2))
    row = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return _rows_of(row, [F.struct(F.lit(a).alias("var_a"), F.lit(b).alias("var_b"),
                                   F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])


def pearson_corr(df: DataFrame, columns: list[str]) -> DataFrame:
    """Every pair of columns, in one aggregation."""
    return _pair_correlations(df, columns)


def mid_ranks(df: DataFrame, column: str, cuts: list[float]) -> DataFrame:
    """Mid-rank of each distinct value.

    Values are summed first, numbered inside the intervals between ``cuts``,
    and shifted by the sizes of the intervals before. Any increasing cuts give
    the same ranks.
    """
    # read twice below, so counted once and kept
    values = write_stage(df.groupBy(column).agg(F.count("*").alias("n")), "rank-values")
    splits = [-float("inf"), *(sorted(set(cuts)) or [0.0]), float("inf")]       # no rows, no cuts
    tagged = Bucketizer(splits=splits, inputCol=column, outputCol="bucket").transform(values)
    sizes = tagged.groupBy("bucket").agg(F.sum("n").alias("size"))       # len(splits) rows at most
    before = sizes.select("bucket", (
        F.sum("size").over(Window.orderBy("bucket")) - F.col("size")).alias("before"))
    through = F.sum("n").over(Window.partitionBy("bucket").orderBy(column))
    rank = F.col("before") + F.col("through") - F.col("n") + (F.col("n") + 1) / 2
    return (tagged.withColumn("through", through).join(F.broadcast(before), "bucket")
            .select(column, rank.alias(f"rank_{column}")))


def _products(middle: float, names: list[str]):
    """Task function: sums of products of every two columns, each less ``middle``; one row a task."""
    def add(batches):
        total = np.zeros((len(names), len(names)))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - middle
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total.ravel()], names=[f"{a}_{b}" for a in names for b in names])

    return add


def _rank_correlations(ranks: DataFrame, columns: list[str], n: int) -> DataFrame:
    """Pair correlations of mid-ranks of n rows, whose mean is (n + 1) / 2: a task hands on one row of sums."""
    names = [f"c{i}" for i in range(len(columns))]
    schema = ", ".join(f"{a}_{b} double" for a in names for b in names)
    row = ranks.toDF(*names).mapInArrow(_products((n + 1) / 2, names), schema).agg(
        *[F.sum(f"{a}_{b}").alias(f"{a}_{b}") for a in names for b in names])
    place = dict(zip(columns, names))
    return _rows_of(row, [
        F.struct(F.lit(a).alias("var_a"), F.lit(b).alias("var_b"), F.try_divide(
            F.col(f"{place[a]}_{place[b]}"), F.sqrt(f"{place[a]}_{place[a]}") * F.sqrt(f"{place[b]}_{place[b]}")).alias("r"))
        for a, b in combinations(columns, 2)])


def spearman_corr(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rank correlation with mid-ranks, over rows that have every column."""
    data = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    cuts = data.approxQuantile(columns, [i / (RANK_CUTS + 1) for i in range(1, RANK_CUTS + 1)], 0.001)
    ranked = reduce(lambda acc, pair: acc.join(mid_ranks(data, pair[0], pair[1]), pair[0]),
                    zip(columns, cuts), data)
    ranks = ranked.select(*[F.col(f"rank_{c}").cast("double") for c in columns])
    return _rank_correlations(ranks, columns, data.count())


def _inverse_diagonal(columns: list[str]):
    pairs = list(combinations(range(len(columns)), 2))

    def compute(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                matrix = np.eye(len(columns))
                for value, (i, j) in zip(row, pairs):
                    matrix[i, j] = matrix[j, i] = value
                yield pd.DataFrame({"variable": columns, "vif": np.diag(np.linalg.inv(matrix))})

    return compute


def vif(df: DataFrame, columns: list[str]) -> DataFrame:
    """Variance inflation: diagonal of the inverse correlation matrix, which is
    all that leaves the aggregation. Rows need every column."""
    data = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    row = data.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in combinations(columns, 2)])
    return row.mapInPandas(_inverse_diagonal(columns), "variable string, vif double")


# --- association with the target --------------------------------------------

def quantile_bins(df: DataFrame, columns: list[str], target: str = TARGET) -> DataFrame:
    """Good and bad counts per decile of each numeric column; missing is bin 0."""
    long = _stacked(df, columns, "double", [target])
    edges = group_quantiles(long, "valor", DECILES, ["variable"], few_groups=True).select(
        "variable", F.array_distinct("q").alias("edges"))
    below = reduce(lambda a, b: a + b, [
        F.coalesce((F.get("edges", F.lit(i)) < F.col("valor")).cast("int"), F.lit(0))
        for i in range(len(DECILES))])
    bins = F.when(F.col("valor").isNull(), 0).otherwise(F.greatest(below, F.lit(1)))
    return (long.join(F.broadcast(edges), "variable", "left")
            .groupBy("variable", bins.cast("string").alias("grupo"))
            .agg(F.count_if(F.col(target) == 0).alias("buenos"), F.count_if(F.col(target) == 1).alias("malos")))


def category_bins(df: DataFrame, columns: list[str], target: str = TARGET) -> DataFrame:
    """Good and bad counts per label of each categorical column."""
    return (_stacked(df, columns, "string", [target])
            .groupBy("variable", F.coalesce("valor", F.lit("nulo")).alias("grupo"))
            .agg(F.count_if(F.col(target) == 0).alias("buenos"), F.count_if(F.col(target) == 1).alias("malos")))


def _with_totals(bins: DataFrame) -> DataFrame:
    totals = bins.groupBy("variable").agg(
        F.sum("buenos").alias("total_buenos"), F.sum("malos").alias("total_malos"),
        F.count("*").alias("grupos"))
    return bins.join(F.broadcast(totals), "variable")       # one row per column


def woe_table(bins: DataFrame) -> DataFrame:
    """Weight of evidence of each group; counts are smoothed so none is empty."""
    def share(count, total):
        return (F.col(count) + SMOOTHING) / (F.col(total) + SMOOTHING * F.col("grupos"))

    return (_with_totals(bins)
            .withColumn("p_buenos", share("buenos", "total_buenos"))
            .withColumn("p_malos", share("malos", "total_malos"))
            .withColumn("woe", F.ln(F.col("p_buenos") / F.col("p_malos")))
            .withColumn("iv_grupo", (F.col("p_buenos") - F.col("p_malos")) * F.col("woe")))


def information_value(bins: DataFrame) -> DataFrame:
    return woe_table(bins).groupBy("variable").agg(F.sum("iv_grupo").alias("iv"))


def chi_square(bins: DataFrame) -> DataFrame:
    """Independence test of each variable's groups against the outcome."""
    n = F.col("total_buenos") + F.col("total_malos")
    size = F.col("buenos") + F.col("malos")

    def term(count, total):
        expected = size * F.col(total) / n
        return F.coalesce(F.try_divide(F.pow(F.col(count) - expected, F.lit(2)), expected), F.lit(0.0))

    classes = (F.max("total_buenos") > 0).cast("int") + (F.max("total_malos") > 0).cast("int")
    return _with_totals(bins).groupBy("variable").agg(
        F.sum(size).alias("n"),
        F.sum(term("buenos", "total_buenos") + term("malos", "total_malos")).alias("chi2"),
        ((F.count("*") - 1) * (classes - 1)).alias("gl"))


def cramers_v(bins: DataFrame) -> DataFrame:
    """Association strength; with two outcomes the smaller side has one degree."""
    return chi_square(bins).select(
        "variable", F.sqrt(F.try_divide("chi2", "n")).alias("v_cramer"))


def leakage_screen(df: DataFrame, numeric: list[str], categorical: list[str],
                   target: str = TARGET) -> DataFrame:
    """Information value, correlation and Cramér's V per column, with a verdict."""
    bins = quantile_bins(df, numeric, target).unionByName(category_bins(df, categorical, target))
    row = df.agg(*[F.corr(c, target).alias(c) for c in numeric])
    correlations = _rows_of(row, [
        F.struct(F.lit(c).alias("variable"), F.col(c).alias("r")) for c in numeric])
    strong = F.greatest(F.coalesce(F.abs("r"), F.lit(0.0)), F.col("v_cramer")) > ASSOCIATION_ALERT
    verdict = (F.when((F.col("iv") > IV_ALERT) & strong, "fuga")
                .when(F.col("iv") > IV_ALERT, "revisar").otherwise("ok"))
    return (information_value(bins).join(cramers_v(bins), "variable")
            .join(F.broadcast(correlations), "variable", "left")
            .withColumn("veredicto", verdict))


# --- tests ------------------------------------------------------------------

def _anova(long: DataFrame, group: str) -> DataFrame:
    """One-way F per variable from the size, mean and spread of each group."""
    groups = long.where(F.col("valor").isNotNull() & F.col(group).isNotNull()).groupBy("variable", group).agg(
        F.count("*").alias("n"), F.avg("valor").alias("media"),
        (F.var_pop("valor") * F.count("*")).alias("dentro"))
    totals = groups.groupBy("variable").agg(
        F.sum("n").alias("n_total"), (F.sum(F.col("n") * F.col("media")) / F.sum("n")).alias("media_total"))
    between = F.sum(F.col("n") * F.pow(F.col("media") - F.col("media_total"), F.lit(2)))
    k, n = F.count("*"), F.max("n_total")
    return (groups.join(F.broadcast(totals), "variable").groupBy("variable")
            .agg(n.alias("n"), (k - 1).alias("gl_entre"), (n - k).alias("gl_dentro"),
                 F.try_divide(between / (k - 1), F.sum("dentro") / (n - k)).alias("f")))


def anova_f(df: DataFrame, columns: list[str], group: str) -> DataFrame:
    return _anova(_stacked(df, columns, "double", [group]), group)


def levene_test(df: DataFrame, columns: list[str], group: str, center: str = "median", few_groups: bool = False) -> DataFrame:
    """Equality of variances: F of the distances to the group's median or mean.

    ``few_groups`` states that the groups are a fixed few, such as outcomes: the long rows then stay where they are,
    instead of being dealt by a handful of keys.
    """
    long = _stacked(df, columns, "double", [group])
    if center == "median":
        centres = group_median(long, "valor", ["variable", group], few_groups).withColumnRenamed("mediana", "centro")
    else:
        centres = long.groupBy("variable", group).agg(F.avg("valor").alias("centro"))
    centres = F.broadcast(centres) if few_groups else centres
    distances = long.join(centres, ["variable", group]).withColumn(
        "valor", F.abs(F.col("valor") - F.col("centro")))
    return _anova(distances, group)


def _moments(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    names = [y, *xs]
    return df.agg(
        F.count("*").alias("n"), F.array(*[F.avg(c) for c in names]).alias("mean"),
        F.array(*[F.covar_pop(a, b) for a in names for b in names]).alias("cov"))


def breusch_pagan(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """Heteroscedasticity: n times the R² of squared residuals on the regressors.

    Two aggregations; only means and covariances of the named columns leave
    them. Rows need every column.
    """
    data = df.select(*[F.col(c).cast("double").alias(c) for c in [y, *xs]]).dropna()
    first = _moments(data, y, xs).first()
    cov = np.array(first["cov"]).reshape(len(xs) + 1, -1)
    slopes = np.linalg.solve(cov[1:, 1:], cov[1:, 0])
    fitted = reduce(lambda a, b: a + b, [
        F.lit(float(s)) * (F.col(x) - F.lit(m)) for s, x, m in zip(slopes, xs, first["mean"][1:])])
    squared = F.pow(F.col(y) - F.lit(first["mean"][0]) - fitted, F.lit(2))
    second = _moments(data.withColumn(y, squared), y, xs)

    def statistic(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                c = np.array(row.cov).reshape(len(xs) + 1, -1)
                r2 = c[0, 1:] @ np.linalg.solve(c[1:, 1:], c[1:, 0]) / c[0, 0]
                yield pd.DataFrame({"n": [row.n], "r2": [r2], "lm": [row.n * r2], "gl": [len(xs)]})

    return second.mapInPandas(statistic, "n long, r2 double, lm double, gl long")


def significance(df: DataFrame, numeric: list[str], categorical: list[str], group: str,
                 target: str = TARGET) -> DataFrame:
    """prueba, variable, estadistico, p_valor: all tests of the exploration in one table.

    The statistics are the distributed sums above; a p-value is taken of each of
    their few rows.
    """
    def f_rows(name: str, tests: DataFrame) -> DataFrame:
        return tests.select(F.lit(name).alias("prueba"), "variable", F.col("f").alias("estadistico"),
                            f_p_value("f", F.col("gl_entre").cast("double"), F.col("gl_dentro").cast("double")).alias("p_valor"))

    chi = chi_square(category_bins(df, categorical, target)).select(
        F.lit("chi2").alias("prueba"), "variable", F.col("chi2").alias("estadistico"),
        chi2_p_value("chi2", F.col("gl").cast("double")).alias("p_valor"))
    spread_of_errors = breusch_pagan(df, target, [c for c in numeric if c != LEAK]).select(
        F.lit("breusch_pagan").alias("prueba"), F.lit(target).alias("variable"), F.col("lm").alias("estadistico"),
        chi2_p_value("lm", F.col("gl").cast("double")).alias("p_valor"))
    return (f_rows("anova", anova_f(df, numeric, group)).unionByName(f_rows("levene", levene_test(df, numeric, target, few_groups=True)))
            .unionByName(chi).unionByName(spread_of_errors))
