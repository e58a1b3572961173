"""A whole detection run: profile, route, features, scores, rare categories, explanations, summary."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farstray.config import Settings
from farstray.functions import columns as C
from farstray.functions.checkpoints import checkpointed
from farstray.functions.sampling import uniform_sample
from farstray.operators import categorical, cblof, explain, forest, hbos, incremental, lof, ocsvm, scoring, vectors
from farstray.operators.features import FeatureModel, cast_numeric_strings, fit_features
from farstray.operators.profile import TableProfile, profile
from farstray.plans.route import choose_algorithm

ENSEMBLE = ("iforest", "hbos", "lof")
#: Detectors that score in Python: rows at one place of the table that they are fitted on are scored once.
BY_PLACE = ("iforest", "lof", "ocsvm", "ensemble")
#: Columns of scored places, and the most places that are broadcast to the rows.
OWN, ROWS, SCORE, FEW_PLACES = "__own", "__rows", "__score", 200_000


@dataclass(frozen=True)
class EnsembleModel:
    """The mean of the members' scores, each between its own bounds; a member that can't be fitted is left out."""

    members: tuple[tuple[object, scoring.Bounds], ...]

    def raw(self, names: list[str], key: Column | None = None) -> Column:
        return self.mean([model.raw(names, key) for model, _ in self.members])

    def mean(self, scores: list[Column]) -> Column:
        """Of the members' raw scores."""
        parts = []
        for score, (_, b) in zip(scores, self.members):
            span = (b.high - b.low) or 1.0
            parts.append(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score - F.lit(b.low)) / F.lit(span))))
        return F.round(C.total(parts) / len(parts), scoring.PLACES)


@dataclass(frozen=True)
class Detector:
    """A fitted model with its features and bounds; ``transform`` adds anomaly_score and is_outlier to any table."""

    algorithm: str
    features: FeatureModel | None
    model: object | None
    bounds: scoring.Bounds | None
    key: str | None = None
    #: The table that it was fitted on and the scores of its places; they aren't saved.
    table: DataFrame | None = field(default=None, compare=False, repr=False)
    places: DataFrame | None = field(default=None, compare=False, repr=False)

    @property
    def names(self) -> list[str]:
        return [f"f_{c}" for c in self.features.kept] if self.features else []

    def raw_scores(self, df: DataFrame) -> DataFrame:
        wide = self.features.transform(df) if self.features else df
        key = F.col(f"`{self.key}`") if self.key else None
        if self.places is not None and df is self.table:
            found = self.places.select(*(F.col(f"`{c}`").alias(f"__p{i}") for i, c in enumerate(self.names)), F.col(OWN).alias("__po"), F.col(SCORE).alias(SCORE))
            wide = wide.withColumn(OWN, own_key(self.model, key))
            here = F.col(OWN).eqNullSafe(F.col("__po"))
            for i, c in enumerate(self.names):
                here &= F.col(f"`{c}`") == F.col(f"__p{i}")
            raw = F.when(self.features.complete(), F.col(SCORE))
            return wide.join(F.broadcast(found) if self.places.count() <= FEW_PLACES else found, here, "left").withColumn("raw", raw).drop(*found.columns, OWN)
        raw = self.model.raw(self.names, key)
        return wide.withColumn("raw", F.when(self.features.complete(), raw) if self.features else raw)

    def transform(self, df: DataFrame) -> DataFrame:
        if self.model is None or self.bounds is None:
            return scoring.flagged(df, None)
        out = scoring.flagged(self.raw_scores(df), self.bounds)
        return out.select(*(F.col(f"`{c}`") for c in df.columns), "anomaly_score", "is_outlier")


def fit_model(algorithm: str, everything: DataFrame, sample: DataFrame, names: list[str], key: Column, rows: int, settings: Settings):
    """HBOS counts ``everything``, the others learn from ``sample``."""
    contamination = settings.contamination
    if algorithm == "hbos":
        return hbos.fit_hbos(everything, names)
    if algorithm == "iforest":
        return forest.fit_forest(sample, names)
    if algorithm == "lof":
        return lof.fit_lof(sample.limit(settings.lof_reference_rows), names, key)
    if algorithm == "cblof":
        return cblof.fit_cblof(sample, names, rows)
    if algorithm == "ocsvm":
        return ocsvm.fit_ocsvm(sample.limit(settings.ocsvm_sample_rows), names, contamination)
    raise ValueError(f"unknown algorithm {algorithm!r}")


def own_key(model, key: Column) -> Column:
    """What a score depends on beside the features: the key of a row that is left out of its own neighbours, else null."""
    for member in [m for m, _ in model.members] if isinstance(model, EnsembleModel) else [model]:
        if isinstance(member, lof.LofModel):
            return member.own(key)
    return F.lit(None).cast("string")


def scored_places(models: list, everything: DataFrame, names: list[str], key: Column) -> DataFrame:
    """All different features (and keys that count) with the number of their rows and the models' scores m0, m1, ..., each found once.

    They are dealt by ranges, so that a batch holds neighbours.
    """
    own = next((m.own(key) for m in models if isinstance(m, lof.LofModel)), F.lit(None).cast("string"))
    at = [F.col(f"`{c}`") for c in names]
    places = everything.withColumn(OWN, own).groupBy(*at, OWN).agg(F.count("*").alias(ROWS))
    context = everything.sparkSession.sparkContext
    tasks = max(2 * context.defaultParallelism, int(everything.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = places.repartitionByRange(tasks, *at, OWN).sortWithinPartitions(*at)
    return checkpointed(dealt.select(*at, OWN, ROWS, *(m.raw(names, F.col(OWN)).alias(f"m{i}") for i, m in enumerate(models))))


def place_bounds(places: DataFrame, contamination: float, step: int = 1000) -> scoring.Bounds | None:
    """The bounds of the scores of all rows: each place's score as often as it has rows."""
    parts = places.select(SCORE, ROWS, F.explode(F.sequence(F.lit(0).cast("long"), F.col(ROWS) - 1, F.lit(step).cast("long"))).alias("at"))
    each = parts.select(F.col(SCORE).alias("raw"), F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(step), F.col(ROWS) - F.col("at")))))
    return scoring.fit_bounds(each.select("raw"), contamination)


def fit_ensemble(everything: DataFrame, sample: DataFrame, names: list[str], key: Column, rows: int, settings: Settings, by_place: bool = True) -> tuple[EnsembleModel, scoring.Bounds | None, DataFrame | None]:
    """The members, scored over all rows in one pass from which come their bounds and those of their mean, and the scored places."""
    models = [fit_model(member, everything, sample, names, key, rows, settings) for member in ENSEMBLE]
    scores = scored_places(models, everything, names, key) if by_place else everything.select(*(m.raw(names, key).alias(f"m{i}") for i, m in enumerate(models))).persist()
    r = scores.agg(*(f(f"m{i}") for i in range(len(models)) for f in (F.min, F.max))).first()
    kept = [i for i in range(len(models)) if r[2 * i] is not None]
    model = EnsembleModel(tuple((models[i], scoring.Bounds(r[2 * i], r[2 * i + 1], r[2 * i + 1])) for i in kept))
    if not kept:
        return model, None, None
    mean = model.mean([F.col(f"m{i}") for i in kept])
    if by_place:
        places = scores.withColumn(SCORE, mean)
        return model, place_bounds(places, settings.contamination), places
    bounds = scoring.fit_bounds(scores.select(mean.alias("raw")), settings.contamination)
    scores.unpersist()
    return model, bounds, None


def bounds_of_all(model, everything: DataFrame, names: list[str], key: Column | None, contamination: float) -> scoring.Bounds | None:
    scores = everything.select(model.raw(names, key).alias("raw")).persist()
    bounds = scoring.fit_bounds(scores, contamination)
    scores.unpersist()
    return bounds


def fit_detector(df: DataFrame, algorithm: str, settings: Settings = Settings(), names: list[str] | None = None, key: str | None = None) -> Detector:
    """Fit features, histograms and score bounds on all rows and other models on a bounded uniform sample (all rows, if they fit).

    The detector keeps the scores of all different places of ``df`` and looks them up when it transforms this very table.
    With ``incremental`` the model sees all rows.  Without a varying feature, or with fewer than two rows, nothing is
    flagged.  ``key`` names the column that orders the sample and, for LOF, tells a row from its neighbours.
    """
    exclude = settings.exclude_columns
    if algorithm == "incremental":
        numeric = C.numeric_columns(df, exclude) if names is None else names
        model = incremental.fit_incremental(df, settings.contamination, numeric, C.categorical_columns(df, exclude), keys=[key] if key else None)
        if model is None:
            return Detector(algorithm, None, None, None, key)
        bounds = scoring.fit_bounds(df.select(model.raw().alias("raw")), settings.contamination)
        return Detector(algorithm, None, model, bounds, key)
    arrays = [c for c in vectors.vector_columns(df, exclude) if names is None or c in names]
    if arrays and algorithm == "iforest":  # the others take plain numbers only
        features = vectors.fit_vectors(df, arrays + C.numeric_columns(df, exclude) if names is None else names, settings.scaling, settings.impute, settings.clip)
    else:
        features = fit_features(df, names, settings.scaling, settings.impute, exclude, settings.clip)
    if not features.kept:
        return Detector(algorithm, features, None, None, key)
    wide = features.transform(df.where(features.complete()))
    columns = [f"f_{c}" for c in features.kept]
    keyed = wide.select(*([F.col(f"`{key}`").alias("__key")] if key else []), *columns)
    sample = uniform_sample(keyed, settings.global_sample_rows, ["__key"] if key else None).cache()
    rows = sample.count()
    if rows < 2:
        return Detector(algorithm, features, None, None, key)
    key_column = F.col("__key") if key else F.xxhash64(*columns)
    places = None
    if algorithm == "ensemble":
        model, bounds, places = fit_ensemble(keyed, sample, columns, key_column, rows, settings, key is not None)
    else:
        model = fit_model(algorithm, keyed, sample, columns, key_column, rows, settings)
        if key and algorithm in BY_PLACE:
            places = scored_places([model], keyed, columns, key_column).withColumnRenamed("m0", SCORE)
            bounds = place_bounds(places, settings.contamination)
        else:
            bounds = bounds_of_all(model, keyed, columns, key_column if key else None, settings.contamination)
    sample.unpersist()
    return Detector(algorithm, features, model, bounds, key, df, places)


def lof_of_all(df: DataFrame, settings: Settings, names: list[str] | None, key: str) -> DataFrame:
    """``df`` with anomaly_score and is_outlier by the local outlier factor of each row among all rows, however many.

    Features, neighbours, bounds and threshold come from every row.  Rows that share a key are rows of their own; those without a
    key are nobody's neighbours and have no factor, so they score 0.
    """
    features = fit_features(df, names, settings.scaling, settings.impute, settings.exclude_columns, settings.clip)
    if not features.kept:
        return scoring.flagged(df, None)
    columns = [f"f_{c}" for c in features.kept]
    wide = features.transform(df).withColumn(OWN, F.when(features.complete(), F.col(f"`{key}`").cast("string")))
    if not wide.where(F.col(OWN).isNotNull()).groupBy(OWN).count().where("count > 1").isEmpty():
        at = F.row_number().over(Window.partitionBy(OWN, F.when(F.col(OWN).isNull(), F.xxhash64(*columns))).orderBy(*(F.col(f"`{c}`") for c in columns)))
        wide = checkpointed(wide.withColumn("__at", at).withColumn(OWN, F.when(F.col("__at") > 1, F.concat(OWN, F.lit("\u0001"), "__at")).otherwise(F.col(OWN))).drop("__at"))
    scores = checkpointed(lof.exact_lof(wide.where(F.col(OWN).isNotNull()), columns, OWN).withColumnRenamed("lof", SCORE))
    bounds = scoring.fit_bounds(scores, settings.contamination, SCORE)
    out = scoring.flagged(wide.join(scores, OWN, "left"), bounds, SCORE)
    score = F.when(F.col(SCORE).isNotNull(), F.col("anomaly_score")).otherwise(F.lit(0.0)).alias("anomaly_score")
    return out.select(*(F.col(f"`{c}`") for c in df.columns), score, "is_outlier")


@dataclass(frozen=True)
class Detection:
    algorithm: str
    scored: DataFrame
    profile: TableProfile
    explanations: DataFrame | None
    detector: Detector | None

    def summary(self) -> DataFrame:
        return scoring.summary(self.scored, self.algorithm)


def detect(df: DataFrame, settings: Settings = Settings(), key: str | None = None, names: list[str] | None = None, size_mb: float = 0.0, order: list[str] | None = None) -> Detection:
    """Run everything on a table.  Columns whose names clash with added ones are kept as ``<name>__input``.

    With ``profile_sampled`` the profile is that of ``profiler_sample_rows`` rows and the count of all.
    A table with a date or time column is passed through with zero scores, unless ``on_datetime`` is "ignore".  ``order`` names columns that
    order the rows, for columns that count up in it.
    """
    df = C.without_collisions(df)
    typed = cast_numeric_strings(df, settings.numeric_cast_threshold, settings.exclude_columns)
    few = uniform_sample(typed, settings.profiler_sample_rows, [key] if key else None) if settings.profile_sampled else typed
    found = profile(few, settings.profiler_id_cardinality_ratio, size_mb, typed.count() if settings.profile_sampled else None, order)
    algorithm = choose_algorithm(found, settings)
    zero = {"anomaly_score": F.lit(0.0), "is_outlier": F.lit(False), "cat_anomaly_score": F.lit(0.0), "is_cat_outlier": F.lit(False)}
    if found.datetime and settings.on_datetime == "passthrough":
        return Detection(algorithm, df.withColumns(zero), found, None, None)
    settings = replace(settings, exclude_columns=C.merged_excludes(settings.exclude_columns, found.ids))
    try:
        detector = fit_detector(typed, algorithm, settings, names, key)
        scored = detector.transform(typed)
    except Exception:
        if settings.on_error == "raise":
            raise
        detector, scored = None, scoring.flagged(typed, None)
    strings = C.categorical_columns(typed, settings.exclude_columns)
    freq = None
    if settings.cat_freq_mode == "single-pass":
        freq = categorical.sample_frequencies(typed, strings, settings.global_sample_rows, [key] if key else None)
    scored = categorical.rare_categories(scored, strings, settings.cat_rare_threshold, settings.cat_max_cardinality_ratio, settings.cat_min_cardinality, freq, rows=found.rows)
    explanations = None
    if settings.explain and detector and detector.model is not None and isinstance(detector.features, FeatureModel) and key:
        explanations = explained(detector, typed, key, settings.max_explain_rows)
    return Detection(algorithm, scored, found, explanations, detector)


def explained(detector: Detector, df: DataFrame, key: str, rows: int = 100) -> DataFrame:
    """Explanations of the first flagged rows by the fitted detector itself."""
    everything = detector.features.transform(df.where(detector.features.complete()))
    flagged = detector.features.transform(detector.transform(df).where("is_outlier"))
    names = list(detector.features.kept)
    if detector.algorithm == "hbos":
        return explain.explain_hbos(flagged, everything, detector.model, key, names, detector.names, rows)
    by = explain.explain_forest if detector.algorithm == "iforest" else explain.explain_kernel
    return by(flagged, everything, detector.model, key, names, detector.names, rows, keys=[key])
