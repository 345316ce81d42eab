"""Modelling rounds: what each one changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tidemark.operators.encode import MonthLabel, QualityCorrector, encoding_stages
from tidemark.operators.quality import between_dates
from tidemark.schema import CATEGORICAL, PLAIN, QUALITY_FLAGS, feature_columns

# Oversampling ratios tried (none first).
SMOTE_RATIOS = [None, 0.3, 0.5, 0.7, 1.0]


@dataclass(frozen=True)
class RoundConfig:
    """Windows are half-open; an open end is None."""

    name: str
    train_start: str | None = None
    train_end: str | None = "2025-01-01"
    valid_start: str | None = "2025-01-01"
    valid_end: str | None = None
    clean: bool = False          # correct impossible ages, incomes and rates
    month: bool = False          # calendar month as a category
    use_rate: bool = True        # keep the priced rate as a feature
    smote: bool = False          # search over oversampling ratios
    refit: bool = True           # the scoring model is refitted on all labelled rows
    logit_c: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0)

    @property
    def plain(self) -> list[str]:
        kept = [c for c in PLAIN if self.use_rate or c != "tasa_interes_anual"]
        return kept + (QUALITY_FLAGS if self.clean else [])

    @property
    def categorical(self) -> list[str]:
        return CATEGORICAL + (["mes_solicitud"] if self.month else [])

    @property
    def raw_columns(self) -> list[str]:
        return feature_columns(self.plain, self.categorical)

    def train(self, labelled: DataFrame) -> DataFrame:
        return between_dates(labelled, self.train_start, self.train_end)

    def valid(self, labelled: DataFrame) -> DataFrame:
        return between_dates(labelled, self.valid_start, self.valid_end)

    def feature_stages(self) -> list:
        """Unfitted stages from raw applications to the assembled vector."""
        flag = "flag_ingreso_declarado_nulo" + ("_original" if self.clean else "")
        return ([QualityCorrector()] if self.clean else []) + ([MonthLabel()] if self.month else []) \
            + encoding_stages(self.plain, self.categorical, flag)


ROUNDS = {
    1: RoundConfig("ronda_1"),
    2: RoundConfig("ronda_2", month=True, refit=False),
    3: RoundConfig("ronda_3", use_rate=False, smote=True, logit_c=(0.01, 0.1, 1.0)),
    4: RoundConfig("ronda_4", clean=True),
    5: RoundConfig("ronda_5", clean=True, train_start="2024-01-01", train_end="2024-07-01",
                   valid_start="2024-07-01", valid_end="2025-01-01"),
    6: RoundConfig("ronda_6", clean=True, train_start="2024-07-01"),
}
