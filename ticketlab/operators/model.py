"""Feature encoding, training, scoring and importance."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlab import functions as fn
from ticketlab.config import MISSING_CATEGORY, BoostParams
from ticketlab.operators import order_stats
from ticketlab.operators.boosting import Booster, best_round, boost  # noqa: F401
from ticketlab.operators.features import check_leakage, numeric_features
from ticketlab.operators.permutation import permute
from ticketlab.schema import CATEGORICAL_FEATURES, DELAYED_COUNT, TARGET

# Stands for a missing number, below every real one; infinities are clamped to its size.
SENTINEL = 1.0e30
CUTS = 254  # values that cut a string feature, as many as the trees have split candidates
CATEGORIES = 1 << 15  # codes of a string feature that is declared categorical
CATEGORY, NUMBER, ABSENT = "_cat_", "_num_", "_nul_"


# --- encoding ------------------------------------------------------------------------------


def _texts(df: DataFrame, column: str) -> DataFrame:
    return df.select(fn.fill_category(column).alias("_text")).distinct()


def _order_cuts(df: DataFrame, column: str, n: int) -> list[str]:
    """``n`` of the distinct values, evenly spaced in sorted order; all if there are no more."""
    text = _texts(df, column)
    values = text.count()
    ranks = sorted({values * i // n for i in range(n)})
    keys = order_stats.keys_at(text, ["_text"], ranks)
    return sorted({k["_text"] for k in keys if k is not None})


def fit_encoder(
    train: DataFrame, features: Sequence[str], categorical: Sequence[str] = ()
) -> PipelineModel:
    """Learn the encoding on the training rows.

    A string stands for the last cut value that does not sort after it, and its code is the
    place of that; missing sorts as its own label. The cut values are CUTS of the distinct
    training values, evenly spaced in sorted order, so with no more than CUTS of them
    the codes are their dense ranks. Strings count as ordered numbers unless listed in
    ``categorical``: these have a code for each value, up to CATEGORIES of them, and trees
    split them into groups. Beyond that they are cut like the others.
    Missing numbers get a value below all others and, where training rows have any, an
    indicator beside it.
    """
    check_leakage(features)
    numbers = numeric_features(train, features)
    strings = [c for c in features if c not in numbers]
    found = train.agg(
        *[F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in numbers],
        F.count("*").alias("_n"),
    ).first()
    flagged = [c for c in numbers if found[c]]
    lines = []
    for c in strings:
        if c in categorical and _texts(train, c).limit(CATEGORIES + 1).count() <= CATEGORIES:
            lines.append(f"coalesce(`{c}`, '{MISSING_CATEGORY}') AS `_str_{c}`")
            continue
        quoted = [v.replace("\\", "\\\\").replace("'", "\\'") for v in _order_cuts(train, c, CUTS)]
        cuts = ", ".join(f"'{v}'" for v in quoted)
        lines.append(
            f"coalesce(array_max(filter(array({cuts}), v -> v <= coalesce(`{c}`, '{MISSING_CATEGORY}'))), "
            f"'{quoted[0]}') AS `_str_{c}`"
        )
    for c in numbers:
        x = f"CAST(`{c}` AS DOUBLE)"
        lines.append(
            f"CASE WHEN `{c}` IS NULL OR isnan({x}) THEN -{SENTINEL:.0e}D "
            f"ELSE greatest(least({x}, {SENTINEL:.0e}D), -{SENTINEL:.0e}D / 2) END AS `{NUMBER}{c}`"
        )
        if c in flagged:
            lines.append(
                f"CASE WHEN `{c}` IS NULL OR isnan({x}) THEN 1D ELSE 0D END AS `{ABSENT}{c}`"
            )
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(lines)} FROM __THIS__")]
    if strings:
        stages.append(
            StringIndexer(
                inputCols=[f"_str_{c}" for c in strings],
                outputCols=[f"_code_{c}" for c in strings],
                stringOrderType="alphabetAsc",
                handleInvalid="keep",
            )
        )
        # An expression over the code drops the label metadata, which makes it a plain number.
        codes = [
            (f"`_code_{c}`" if c in categorical else f"`_code_{c}` + 0D") + f" AS `{CATEGORY}{c}`"
            for c in strings
        ]
        stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(codes)} FROM __THIS__"))
    slots = []
    for c in features:
        slots.append(f"{NUMBER}{c}" if c in numbers else f"{CATEGORY}{c}")
        if c in flagged:
            slots.append(f"{ABSENT}{c}")
    stages.append(VectorAssembler(inputCols=slots, outputCol="features"))
    return Pipeline(stages=stages).fit(train)


def slots_of(encoder: PipelineModel) -> list[str]:
    """Encoded columns in vector order."""
    return [s for s in encoder.stages if isinstance(s, VectorAssembler)][0].getInputCols()


def feature_of(slot: str) -> str:
    return slot[len(NUMBER):]


def labels_of(encoder: PipelineModel, feature: str) -> int:
    """How many codes a string feature has, the one of unknown strings included."""
    indexer = [s for s in encoder.stages if isinstance(s, StringIndexerModel)][0]
    return len(indexer.labelsArray[indexer.getInputCols().index(f"_str_{feature}")]) + 1


def features_of(encoder: PipelineModel) -> list[str]:
    """Feature names in order; an indicator belongs to the feature before it."""
    return list(dict.fromkeys(feature_of(s) for s in slots_of(encoder)))


# --- the model ------------------------------------------------------------------------------


@dataclass
class TicketModel:
    """Encoder and boosted trees."""

    encoder: PipelineModel
    booster: Booster
    best_iteration: int = 0

    @property
    def features(self) -> list[str]:
        return features_of(self.encoder)

    def encode(self, df: DataFrame) -> DataFrame:
        return self.encoder.transform(df)

    def score(self, df: DataFrame, name: str = "raw_score") -> DataFrame:
        """Add the prediction and nothing else."""
        scored = self.encode(df).withColumn(name, self.booster.column(F.col("features")))
        return scored.select(*df.columns, name)

    def save(self, path: str) -> None:
        self.encoder.write().overwrite().save(f"{path}/encoder")
        self.booster.save(f"{path}/booster")

    @classmethod
    def load(cls, path: str) -> TicketModel:
        booster = Booster.load(f"{path}/booster")
        return cls(PipelineModel.load(f"{path}/encoder"), booster, len(booster.trees))


def train(
    train_rows: DataFrame,
    features: Sequence[str],
    params: BoostParams = BoostParams(),
    val_rows: DataFrame | None = None,
    target: str = TARGET,
    categorical: Sequence[str] = (),
    row_key: str = "ticket_id",
) -> tuple[TicketModel, list[float]]:
    """Fit encoder and model on the training rows; ``val_rows`` drive early stopping."""
    encoder = fit_encoder(train_rows, features, categorical)
    label = fn.clean_label(target).cast("double").alias("_label")
    encoded = encoder.transform(train_rows).select(row_key, "features", label)
    encoded_val = None
    if val_rows is not None and not val_rows.isEmpty():
        encoded_val = encoder.transform(val_rows).select("features", label)
    slots = slots_of(encoder)
    groups = {i: labels_of(encoder, feature_of(s)) for i, s in enumerate(slots) if s in {f"{CATEGORY}{c}" for c in categorical}}
    with order_stats.scratch(train_rows.sparkSession) as folder:
        booster, used, history = boost(encoded, encoded_val, params, row_key, len(slots), groups, folder)
    return TicketModel(encoder, booster, used), history


# --- importance ----------------------------------------------------------------------------


def importance(model: TicketModel, spark: SparkSession) -> DataFrame:
    """Total gain and number of splits per feature, features without a split included.

    The gain of a split is by how much it lowers the squared error of its training rows.
    """
    # One row per encoded column.
    names = spark.createDataFrame(
        [(i, feature_of(s)) for i, s in enumerate(slots_of(model.encoder))], "slot int, feature string"
    )
    per_slot = model.booster.nodes(spark).filter("slot >= 0").groupBy("slot").agg(
        F.sum("gain").alias("gain"), F.count("*").alias("splits")
    )
    return (
        names.join(per_slot, "slot", "left")
        .groupBy("feature")
        .agg(
            F.coalesce(F.sum("gain"), F.lit(0.0)).alias("gain"),
            F.coalesce(F.sum("splits"), F.lit(0)).alias("split_count"),
        )
    )


def cumulative_share(df: DataFrame, key: str, value: str) -> DataFrame:
    """Share of the total and its running sum, from the largest value down."""
    ordered = df.select(key, value, (-F.col(value)).alias("_down"))
    run = order_stats.running_total(ordered, ["_down", key], value)
    return run.select(
        key,
        value,
        (fn.ratio(F.col(value), F.col("overall")) * 100).alias(f"{value}_pct"),
        (fn.ratio(F.col("running"), F.col("overall")) * 100).alias(f"cumulative_{value}_pct"),
    )


def top_importance(df: DataFrame, n: int = 20, value: str = "gain") -> DataFrame:
    return df.orderBy(F.desc(value), "feature").limit(n)


def permutation_importance(
    model: TicketModel, df: DataFrame, target: str = TARGET, seed: int = 42, key: str = "ticket_id"
) -> DataFrame:
    """Rise of the MAE when one feature's values are shuffled, for each feature.

    Each feature is dealt by a bijection of its own, all of them on one numbering.
    """
    slots = slots_of(model.encoder)
    encoded = model.encode(df).select(key, F.col(target).alias("_label"), *slots)
    features = model.features
    groups = [[s for s in slots if feature_of(s) == name] for name in features]
    rows = permute(order_stats.pin(encoded), groups, seed, key)
    booster = model.booster
    rows = VectorAssembler(inputCols=slots, outputCol="_x").transform(rows)
    rows = rows.withColumn("_base", booster.column(F.col("_x")))
    for i, name in enumerate(features):
        mixed = [f"_swap_{s}" if feature_of(s) == name else s for s in slots]
        rows = VectorAssembler(inputCols=mixed, outputCol=f"_x{i}").transform(rows)
        rows = rows.withColumn(f"_p{i}", booster.column(F.col(f"_x{i}")))
    label = F.col("_label")
    baseline = F.avg(F.abs(F.col("_base") - label))
    entries = [
        F.struct(
            F.lit(name).alias("feature"),
            (F.avg(F.abs(F.col(f"_p{i}") - label)) - baseline).alias("mae_increase"),
        )
        for i, name in enumerate(features)
    ]
    return (
        rows.agg(F.array(*entries).alias("rows"))
        .select(F.inline("rows"))
        .orderBy(F.desc("mae_increase"), "feature")
    )


def train_metrics(
    model: TicketModel, n_train: int, val_rows: DataFrame, top: DataFrame, target: str = TARGET
) -> DataFrame:
    """Validation record of a training run, one row; ``top`` holds the leading gains."""
    label = fn.clean_label(target)
    scored = model.score(val_rows, "_pred").select(F.col("_pred"), label.alias("_label"))
    error = F.col("_pred") - F.col("_label")
    gains = top.agg(
        F.array_sort(
            F.collect_list(F.struct((-F.col("gain")).alias("down"), "feature", "gain"))
        ).alias("g")
    ).select(F.transform("g", lambda g: F.struct(g["feature"].alias("feature"), g["gain"].alias("gain"))))
    return scored.agg(
        F.avg(F.abs(error)).alias("val_mae"),
        F.sqrt(F.avg(error * error)).alias("val_rmse"),
        F.count("*").alias("n_val"),
    ).select(
        "val_mae",
        "val_rmse",
        F.lit(model.best_iteration).cast("bigint").alias("best_iteration"),
        F.lit(len(model.features)).cast("bigint").alias("n_features"),
        F.lit(n_train).cast("bigint").alias("n_train"),
        "n_val",
        F.array(*[F.lit(f) for f in model.features]).alias("features_used"),
        gains.scalar().alias("feature_importance_top20"),
    )


def results_summary(training: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Training record beside the evaluation and policy record; absent counts are 0."""
    left = training.select(
        "val_mae", "val_rmse", "best_iteration", "n_train", "n_val"
    ).limit(1).withColumn("_one", F.lit(1))
    counts = (DELAYED_COUNT, "skip_count", "skip_rejected_count")
    measures = ("mae", "rmse", "correlation", "median_ae", "skip_rate", "pnl_delta", "pnl_delta_pct")
    have = set(evaluation.columns)
    right = evaluation.limit(1).select(
        F.lit(1).alias("_one"),
        *[
            F.coalesce(F.col(c).cast("bigint") if c in have else F.lit(None).cast("bigint"), F.lit(0)).alias(c)
            for c in counts
        ],
        *[(F.col(c) if c in have else F.lit(None)).cast("double").alias(c) for c in measures],
    )
    return left.join(right, "_one", "left").drop("_one")


def feature_analysis(
    df: DataFrame,
    features: Sequence[str],
    params: BoostParams = BoostParams(rounds=200),
    target: str = TARGET,
) -> tuple[TicketModel, DataFrame]:
    """Quick model without validation on a sample; gain, splits and running gain share.

    Declared categoricals are split as categories here.
    """
    declared = [c for c in CATEGORICAL_FEATURES if c in features]
    model, _ = train(df, features, params, None, target, categorical=declared)
    gains = importance(model, df.sparkSession)
    shares = cumulative_share(gains.select("feature", "gain"), "feature", "gain")
    return model, shares.join(gains.select("feature", "split_count"), "feature").select(
        "feature", "gain", "split_count", "gain_pct", "cumulative_gain_pct"
    )
