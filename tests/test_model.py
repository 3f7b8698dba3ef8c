"""Encoding, boosting, importance and the training jobs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlab.config import BoostParams, Settings
from ticketlab.operators import model, order_stats
from ticketlab.plans import jobs
from ticketlab.schema import DEFAULT_FEATURES
from ticketlab.sources import files

QUICK = BoostParams(rounds=5, learning_rate=0.3, max_depth=3, min_leaf=5, checkpoint_every=2, patience=50)


@pytest.fixture(scope="module")
def toy(spark):
    """A target that depends on a number with gaps and on a category."""
    r = np.random.default_rng(3)
    data = []
    for i in range(1500):
        x = None if i % 10 == 0 else float(r.uniform(0, 10))
        kind = str(r.choice(["a", "b", "c"]))
        y = (0.4 if x is None else 0.05 * x) + {"a": 0.0, "b": 0.3, "c": -0.3}[kind]
        data.append((f"t{i}", x, kind, float(r.uniform()), y))
    return order_stats.pin(
        spark.createDataFrame(data, "ticket_id string, x double, kind string, noise double, odds_after_10 double")
    )


def test_encoder(spark, toy):
    enc = model.fit_encoder(toy, ["x", "kind", "noise"])
    assert model.slots_of(enc) == ["_num_x", "_nul_x", "_cat_kind", "_num_noise"]
    assert model.features_of(enc) == ["x", "kind", "noise"]
    unseen = spark.createDataFrame(
        [("1", None, "b", 0.5), ("2", float("inf"), "zzz", 0.5), ("3", float("nan"), None, -5.0)],
        "ticket_id string, x double, kind string, noise double",
    )
    got = [list(r["features"]) for r in enc.transform(unseen).orderBy("ticket_id").collect()]
    s = model.SENTINEL
    # A new string takes the place of the one before it; missing sorts before all letters.
    assert got == [[-s, 1.0, 1.0, 0.5], [s, 0.0, 2.0, 0.5], [-s, 1.0, 0.0, -5.0]]


def test_encoder_refuses_outcomes(toy):
    with pytest.raises(ValueError):
        model.fit_encoder(toy, ["x", "odds_after_10"])


def test_wide_strings_are_cut_in_order(spark, monkeypatch):
    df = spark.createDataFrame([(f"it's {i:04d}", 1.0) for i in range(900)], "name string, odds_after_10 double")
    monkeypatch.setattr(model, "CUTS", 10)
    enc = model.fit_encoder(df, ["name"])
    codes = [r["features"][0] for r in enc.transform(df).orderBy("name").collect()]
    assert codes == sorted(codes) and len(set(codes)) == 10


def test_boosting_learns_and_stops_early(spark, toy):
    parts = toy.withColumn("h", F.pmod(F.xxhash64("ticket_id"), F.lit(4)))
    fitted, history = model.train(
        parts.filter("h > 0"), ["x", "kind", "noise"],
        BoostParams(rounds=12, learning_rate=0.4, max_depth=4, min_leaf=5, checkpoint_every=4), parts.filter("h = 0"),
    )
    assert len(history) == 12 and fitted.best_iteration == history.index(min(history)) + 1
    out = fitted.score(parts.filter("h = 0"))
    assert out.columns == [*parts.columns, "raw_score"]
    mae = out.agg(F.avg(F.abs(F.col("raw_score") - F.col("odds_after_10")))).first()[0]
    assert mae == pytest.approx(min(history), rel=1e-6) and mae < 0.5 * history[0] + 0.05
    gains = {r["feature"]: r for r in model.importance(fitted, spark).collect()}
    assert gains["noise"]["gain"] < gains["kind"]["gain"] and gains["x"]["split_count"] > 0
    rise = {r["feature"]: r["mae_increase"] for r in model.permutation_importance(fitted, out).collect()}
    assert rise["kind"] > rise["noise"] and rise["x"] > rise["noise"]


def test_best_round_walks_in_order():
    errors = [5.0, 4.0, 4.5, 4.4, 4.3, 1.0]
    assert model.best_round(errors, 3) == (2, 5)
    assert model.best_round(errors, 4) == (6, 6)
    assert model.best_round(errors[:3], 3) == (2, 3)
    assert model.best_round([], 3) == (0, 0)


@pytest.mark.parametrize("every", [1, 7, 20])
def test_stopping_does_not_depend_on_checkpoints(toy, every):
    noise = toy.withColumn("odds_after_10", F.rand(1))
    other = noise.withColumn("odds_after_10", F.rand(2))
    params = dict(rounds=25, learning_rate=0.5, min_leaf=5, max_depth=2, patience=3)
    fitted, history = model.train(noise, ["noise"], BoostParams(**params, checkpoint_every=every), other)
    plain, same = model.train(noise, ["noise"], BoostParams(**params, checkpoint_every=3), other)
    assert fitted.best_iteration == plain.best_iteration
    assert history == pytest.approx(same, rel=1e-9)


def test_patience_ends_training(toy):
    noise = toy.withColumn("odds_after_10", F.rand(1))
    _, history = model.train(
        noise, ["noise"], BoostParams(rounds=40, learning_rate=0.5, min_leaf=5, patience=3, checkpoint_every=2),
        noise.withColumn("odds_after_10", F.rand(2)),
    )
    assert len(history) < 40


def test_first_round_is_the_clipped_mean_step(spark):
    """One leaf per tree: each round adds rate * mean(clip(y - score))."""
    values = [0.0, 0.0, 0.0, 10.0]
    df = spark.createDataFrame([(str(i), 1.0, y) for i, y in enumerate(values)], "ticket_id string, x double, odds_after_10 double")
    p = BoostParams(rounds=2, learning_rate=0.5, bagging_fraction=1.0, min_leaf=1, huber_delta=0.9)
    fitted, _ = model.train(df, ["x"], p)
    score = 2.5
    for _ in range(2):
        score += 0.5 * np.mean(np.clip(np.array(values) - score, -0.9, 0.9))
    assert {round(r["raw_score"], 9) for r in fitted.score(df).collect()} == {round(score, 9)}


def test_permute_pairs_every_row_once(toy):
    out = model.permute(toy.select("ticket_id", "noise"), ["noise"], 1)
    assert out.count() == 1500
    assert sorted(r[0] for r in out.select("_swap_noise").collect()) == sorted(r[0] for r in toy.select("noise").collect())


def test_cumulative_share(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 3.0), ("c", 2.0)], "feature string, gain double")
    got = [tuple(r) for r in model.cumulative_share(df, "feature", "gain").orderBy("feature").collect()]
    assert got == [("a", 5.0, 50.0, 50.0), ("b", 3.0, pytest.approx(30.0), pytest.approx(80.0)), ("c", 2.0, pytest.approx(20.0), pytest.approx(100.0))]


def test_save_and_load(tickets, tmp_path):
    from ticketlab.plans.jobs import prepare

    rows = prepare(tickets.withColumn("mean_stake_size", F.lit(100.0)))
    fitted, _ = model.train(rows, DEFAULT_FEATURES, QUICK)
    fitted.save(f"{tmp_path}/m")
    again = model.TicketModel.load(f"{tmp_path}/m")
    assert again.features == list(DEFAULT_FEATURES) and again.best_iteration == 5
    assert again.score(rows).exceptAll(fitted.score(rows)).count() == 0


def test_jobs_end_to_end(spark, tickets, tmp_path):
    files.write_parquet(tickets.withColumn("mean_stake_size", F.lit(100.0)), f"{tmp_path}/data")
    root, settings = f"{tmp_path}/model", Settings(boost=QUICK, max_train_rows=1000)
    trained = jobs.train_job(spark, f"{tmp_path}/data", root, settings).first()
    assert trained["n_train"] == 1000 and trained["n_features"] == len(DEFAULT_FEATURES)
    gains = [g["gain"] for g in trained["feature_importance_top20"]]
    assert gains == sorted(gains, reverse=True)
    before = jobs.evaluate_job(spark, root, settings).first()
    errors = jobs.calibrate_job(spark, root).first()
    assert errors["mae_before"] > 0 and errors["mae_after"] > 0
    assert files.read_report(spark, f"{root}/calibration_pre.csv").count() >= 1
    after = jobs.evaluate_job(spark, root, settings).first()
    assert after["n_total"] == before["n_total"] == files.read_split(spark, f"{root}/splits", "test").count()
    sim = spark.read.parquet(f"{root}/ope/simulation")
    assert {"model_tier", "predicted_clv", "factual_pnl", "counterfactual_pnl"} <= set(sim.columns)
    expected = sim.agg(F.sum(F.col("counterfactual_pnl") - F.col("factual_pnl"))).first()[0]
    assert after["pnl_delta"] == pytest.approx(expected, abs=1e-6)
    tables = jobs.review_job(spark, root)
    shown = spark.read.parquet(f"{root}/ope/review_sample").count()
    assert tables["summary"].first()["n"] == tables["points"].count() == tables["detail"].count() == shown <= 100
    for name in ("histogram", "states", "by_sport"):
        assert (tables[name].count() > 0) == (shown > 0)
    assert files.read_report(spark, f"{root}/ope/importance.csv").count() == len(DEFAULT_FEATURES)
    assert files.read_report(spark, f"{root}/ope/calibration_bins.csv").count() >= 1
    assert spark.read.parquet(f"{root}/ope/scatter").count() == min(10_000, after["n_total"])
    panel = jobs.results_job(spark, root).first()
    assert panel["skip_count"] + panel["pending_count"] == after["n_total"] and panel["val_mae"] == trained["val_mae"]


def test_results_with_absent_counts(spark):
    training = spark.createDataFrame([(0.1, 0.2, 3, 4, 5)], "val_mae double, val_rmse double, best_iteration bigint, n_train bigint, n_val bigint")
    evaluation = spark.createDataFrame([(0.3,)], "mae double")
    row = model.results_summary(training, evaluation).first()
    assert (row["pending_count"], row["skip_count"], row["mae"], row["rmse"]) == (0, 0, 0.3, None)


def test_feature_report(spark, tickets):
    df = tickets.withColumn("mean_stake_size", F.lit(100.0))
    out = jobs.feature_report(
        df, ["stake", "selection_odds", "sport", "stake_ratio", "absent"], 500, settings=Settings(boost=QUICK)
    )
    assert out["coverage"].count() == 4 and out["corr_matrix"].count() == 9
    assert out["importance"].agg(F.sum("gain_pct")).first()[0] == pytest.approx(100.0)
    assert [r["feature_1"] for r in out["high_corr_pairs"].collect()] == ["stake"]
    assert out["permutation_importance"].count() == 4


class Began(Exception):
    pass


@pytest.mark.parametrize("name", ["train_score", "importance", "permutation_importance", "feature_analysis", "calibrate_job", "evaluate_job", "results_summary"])
def test_training_queries_use_the_operators_settings(spark, folder, monkeypatch, name):
    from ticketlab.plans import catalog

    def began(*args):
        raise Began(next(getattr(a, "boost", a) for a in args if isinstance(a, (BoostParams, Settings))))

    rows = spark.createDataFrame([("train",)], "split string")
    for of, what in ((catalog, "featured"), (catalog, "merged"), (catalog, "once"), (catalog.split, "temporal_split"),
                     (catalog.review, "sample_n"), (catalog.order_stats, "pin"), (catalog.files, "write_parquet")):
        monkeypatch.setattr(of, what, lambda *args: rows)
    monkeypatch.setattr(catalog.model, "train", began)
    monkeypatch.setattr(catalog.model, "feature_analysis", began)
    monkeypatch.setattr(catalog.jobs, "train_job", began)
    full = BoostParams(rounds=200) if name == "feature_analysis" else Settings().boost
    for query, params in ((name, full), (f"{name}_4_rounds", catalog.QUICK)):
        with pytest.raises(Began) as seen:
            catalog.QUERIES[query](spark, folder)
        assert seen.value.args == (params,)
