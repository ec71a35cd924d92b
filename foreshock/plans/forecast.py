"""The whole pipeline: calculate, label, train, predict, evaluate, explain."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreshock.functions.expr import rounded
from foreshock.functions.reuse import keep
from foreshock.operators import attribution, evaluation, gaps, labels, lookback, scoring, signal, training
from foreshock.operators import bands as bands_
from foreshock.operators.features.extract import extract_features


@dataclass
class ForecastPlan:
    """Settings shared by all stages; every stage takes and returns DataFrames."""

    bands: Sequence[str]
    window_s: int = 600
    lookback_days: float = 2
    step_hours: int = 6
    days_ahead: int = 2
    methods: Sequence[str] = ("rsam", "dsar", "entropy")
    expected: float | None = None
    anomaly_threshold: float = 300.0
    min_day_ratio: float = 0.3
    include_event_date: bool = True
    feature_names: Sequence[str] | None = None
    filters: Sequence[bands_.Band] | None = None
    rate: float | None = None
    entropy_band: str | None = None
    models: list[training.SeedModel] = field(default_factory=list)

    @property
    def metrics(self) -> list[str]:
        return signal.metric_names(self.bands, self.methods)

    def calculate(self, samples: DataFrame) -> DataFrame:
        """Samples to a gap-free long tremor table; write it before training at scale.

        With ``filters`` the samples are unfiltered, at ``rate`` a second, and
        are split into the bands first.
        """
        if self.filters is not None:
            if [b[0] for b in self.filters] != list(self.bands) or self.rate is None:
                raise ValueError("filters need a rate and the names of bands, in order")
            samples = bands_.bandpass(samples, self.filters, self.rate)
        wide = signal.tremor_table(samples, self.window_s, self.bands, self.methods, self.expected, self.entropy_band)
        good = signal.drop_incomplete_days(wide, self.window_s, self.min_day_ratio)
        cells = ", ".join(f"'{m}', `{m}`" for m in self.metrics)
        long = keep(good.selectExpr("series", "ts", f"stack({len(self.metrics)}, {cells}) as (metric, v)"))
        dated = long.withColumn("day", F.to_date("ts"))
        clean = gaps.robust_anomalies(dated, self.anomaly_threshold, ["series", "metric", "day"]).drop("day")
        return gaps.interpolate_time(clean.select("series", "metric", "ts", "v"), both=True)

    def label(self, dates: DataFrame, start: str, end: str, series: Sequence[str] = ("all",)) -> DataFrame:
        return labels.label_standard(
            dates.sparkSession, dates, start, end, self.step_hours, "hours", self.days_ahead, self.include_event_date, series
        )

    def features(self, tremor: DataFrame, grid: DataFrame) -> DataFrame:
        """Features of every label with a complete look-back; write them before training at scale."""
        matrix = lookback.lookback_matrix(tremor, grid, self.lookback_days, self.step_hours * 3600, self.window_s)
        long = extract_features(keep(matrix), only=self.feature_names)
        return long.withColumn("value", rounded("value", 9))

    def train(self, features: DataFrame, truth: DataFrame, kinds: Sequence[str], seeds: Sequence[int], top_n: int = 20, ratio: float = 0.75) -> list:
        self.models = training.train_ensemble(features, truth, kinds, seeds, top_n, ratio)
        return self.models

    def scores(self, features: DataFrame) -> DataFrame:
        if not self.models:
            raise ValueError("train first")
        return training.score_seeds(self.models, features)

    def predict(self, features: DataFrame) -> DataFrame:
        """Wide forecast table of the consensus and of each classifier."""
        kinds = list(dict.fromkeys(m.classifier for m in self.models))
        return scoring.forecast_table(scoring.seed_consensus(self.scores(features)), kinds)

    def evaluate(self, features: DataFrame, truth: DataFrame) -> DataFrame:
        return evaluation.evaluate(self.scores(features), truth)

    def explain(self, features: DataFrame, truth: DataFrame, dates: DataFrame, top_n: int = 10) -> DataFrame:
        """Largest contributions to the highest forecast of each event."""
        parts = [
            training.attribute_sampled(m, training.matrix(features, m.features, m.fill or None), 4) for m in self.models
        ]
        all_parts = parts[0]
        for p in parts[1:]:
            all_parts = all_parts.unionByName(p)
        picks = evaluation.event_picks(keep(self.scores(features)), truth, dates)
        return attribution.explain_events(all_parts, picks, top_n)
