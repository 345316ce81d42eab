"""Which way of filling missing values ranks best."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import logistic
from tidemark.operators.encode import fit_labels, one_hot_columns
from tidemark.operators.impute import RECIPES, apply_recipe
from tidemark.operators.metrics import eval_summary
from tidemark.operators.quality import between_dates
from tidemark.schema import CATEGORICAL, DATE, ID, IMPUTED, LOGGED, PLAIN, SCORE, TARGET
from tidemark.session import write_stage

SPLIT = "2025-01-01"


def _filled(df: DataFrame) -> DataFrame:
    """Each row once, with the two columns as every recipe fills them: ``<column>_<recipe>``."""
    wide = df.withColumns({f"raw_{c}": F.col(c) for c in IMPUTED})
    for recipe in reversed(RECIPES):        # neighbours first: the others only add columns to their rows
        wide = (apply_recipe(wide.withColumns({c: F.col(f"raw_{c}") for c in IMPUTED}), recipe, df)
                .withColumns({f"{c}_{recipe}": F.col(c) for c in IMPUTED}))
    return wide


def _slots(wide: DataFrame, labels: dict[str, list[str]]) -> tuple[DataFrame, list[str], list[list[int]]]:
    """Features of all recipes as plain columns, their names, and the positions of those each recipe's model uses."""
    income, tenure = IMPUTED
    shared = [*[f"log_{c}" for c in LOGGED], *PLAIN, *[f"{c}_isnull" for c in IMPUTED],
              *[f"{c}_{label}" for c, values in labels.items() for label in values]]
    own = [[f"log_{income}_{recipe}", f"{tenure}_{recipe}"] for recipe in RECIPES]
    names = shared + [name for pair in own for name in pair]
    logs = {f"log_{c}": F.log1p(c) for c in [*LOGGED, *[f"{income}_{recipe}" for recipe in RECIPES]]}
    slots = [f"x{i}" for i in range(len(names))]        # a label may hold any character
    frame = one_hot_columns(wide.withColumns(logs), labels).select(
        ID, DATE, TARGET, *[F.col(f"`{name}`").alias(slot) for name, slot in zip(names, slots)])
    return frame, slots, [[names.index(name) for name in shared + pair] for pair in own]


def _score(w: np.ndarray, slots: list[str]) -> Column:
    """Probability of an intercept and one coefficient a slot."""
    z = reduce(lambda a, b: a + b, [F.lit(float(c)) * F.col(slot) for c, slot in zip(w[1:], slots) if c], F.lit(float(w[0])))
    return 1 / (1 + F.exp(-z))


def imputation_bakeoff(labelled: DataFrame, split: str = SPLIT) -> DataFrame:
    """Validation AUC of the same model on each recipe, best first.

    Recipes learn from all the rows given, before the split, so that only the
    filled values differ between the fits. Their values stand side by side in one
    table of plain columns, so the fits share each pass over its rows.
    """
    labels = {c: fit_labels(between_dates(labelled, None, split), c) for c in CATEGORICAL}
    frame, slots, used = _slots(_filled(labelled), labels)
    frame = write_stage(frame, "recipes")
    train, valid = between_dates(frame, None, split), between_dates(frame, split, None)
    whole = reduce(lambda a, b: a + b, [F.col(s).cast("double") for s in slots])       # null or NaN if one of them is
    row = train.agg(F.count("*").alias("n"), F.sum(TARGET).alias("positives"), F.count_if(~F.isnan(whole)).alias("known"),
                    *[F.stddev_pop(s).alias(s) for s in slots]).first()
    if not row.n or row.known < row.n:
        raise ValueError(f"no rows before {split}, or missing features")
    settings = [logistic.Setting(1.0, slots=at) for at in used]
    if 0 < row.positives < row.n:
        factors = np.array([1.0 / row[s] if row[s] > 0 else 1.0 for s in slots])
        logistic.fit(train, slots, TARGET, ID, factors, settings)
        scores = [_score(s.w * np.r_[1.0, factors], slots) for s in settings]
    else:       # one class only: no minimum, and that class for certain
        scores = [F.lit(float(row.positives > 0)) for _ in settings]
    scored = valid.select(TARGET, F.explode(F.array(*[
        F.struct(F.lit(recipe).alias("receta"), score.alias(SCORE)) for recipe, score in zip(RECIPES, scores)])).alias("r"))
    scored = scored.select("r.receta", F.lit(row.n).cast("long").alias("n_train"), TARGET, f"r.{SCORE}")
    both = eval_summary(scored, by=["receta", "n_train"])
    return both.select("receta", F.col("auc").alias("auc_valid"), "n_train", F.col("n").alias("n_valid")) \
               .orderBy(F.desc("auc_valid"))
