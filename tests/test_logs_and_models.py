"""Files, reports, adapters, resampling and Spark ML."""

import hashlib

import pytest
from pyspark.sql import functions as F

from iotlens.operators import adapters, detect, evaluate, models, scorers, significance, vectors
from iotlens.plans import catalog
from iotlens.schemas import FEATURES
from iotlens.sources import logs
from iotlens.sources.fixture import capture, incoming, packet_events


@pytest.fixture(scope="module")
def ev(spark, small):
    return packet_events(spark, small).drop("payload")


def test_event_log_round_trip(spark, ev, tmp_path):
    path = str(tmp_path / "log")
    logs.write_event_log(ev.limit(200), path)
    (tmp_path / "log" / "extra.txt").write_text('{"ts":\n\n   \nnot json\n{"ts":"x","bytes":"abc","protocol":"http"}\n')
    parsed = logs.read_event_log(spark, path)
    assert logs.good(parsed).count() == 201
    assert logs.bad(parsed).count() == 2
    run = {"run_id": F.lit("r"), "scenario": F.lit("s"), "label": F.lit("benign"), "rep": F.lit(0)}
    assert vectors.dataset_rows(logs.good(parsed).withColumns(run)).count() == 200
    assert logs.read_event_log(spark, str(tmp_path / "none")).count() == 0


def test_feature_log_round_trip(spark, small, tmp_path):
    both = vectors.both_vectors(incoming(packet_events(spark, small)))
    log = detect.evaluate(both.select("*", F.col("behavioral")[0].alias("f00"), F.col("behavioral")[2].alias("f02")))
    logs.write_feature_log(log.limit(50), str(tmp_path / "f"))
    back = logs.good(logs.read_feature_log(spark, str(tmp_path / "f")))
    assert back.count() == 50
    assert back.filter((F.size("legacy") == 33) & (F.size("active") == 33) & F.col("decision.anomaly_score").between(0, 1)).count() == 50
    assert logs.log_scores(back).filter("score is null").isEmpty()


def test_dataset_files(spark, ev, tmp_path):
    rows = vectors.dataset_rows(ev)
    for fmt in ("parquet", "csv"):
        path = str(tmp_path / fmt)
        logs.write_dataset(rows.filter("rep = 0"), path, append=False, fmt=fmt)
        logs.write_dataset(rows.filter("rep > 0"), path, append=True, fmt=fmt)
        back = logs.read_dataset(spark, path, fmt)
        assert back.count() == rows.count()
        assert back.agg(F.sum("f02")).first()[0] == pytest.approx(rows.agg(F.sum("f02")).first()[0])
    rows.drop("f03").write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="f03"):
        logs.read_dataset(spark, str(tmp_path / "bad"))


def test_records_snapshots_reports(spark, ev, tmp_path):
    records = vectors.legacy_vector(ev).select(
        F.lit("t").alias("timestamp"), "protocol", "source_id", F.col("label").alias("attack_label"), F.col("label").alias("attack_family"), *FEATURES
    )
    for _ in range(2):
        logs.append_feature_records(records.limit(5), str(tmp_path / "rec"))
    assert spark.read.option("header", True).csv(str(tmp_path / "rec")).count() == 10
    (tmp_path / "snap.json").write_text('{\n "mqtt_msgs": 4\n}')
    assert tuple(logs.read_snapshot(spark, str(tmp_path / "snap.json")).first()) == (4, 0, 0, 0)
    assert tuple(logs.read_snapshot(spark, str(tmp_path / "absent.json")).first()) == (0, 0, 0, 0)
    logs.write_report({"a": ev.limit(1), "b": ev.limit(2)}, str(tmp_path / "rep"))
    assert spark.read.json(str(tmp_path / "rep" / "b")).count() == 2


def test_adapters(spark, small):
    packets = capture(spark, small)
    events = adapters.decode_all(packets)
    assert events.count() == packets.count()

    class Echo(adapters.ProtocolAdapter):
        name = "echo"

        def decode(self, rows):
            return adapters.REGISTRY["coap"].decode(rows).withColumn("detail", F.lit("echo"))

    registry = {**adapters.REGISTRY, "echo": Echo()}
    both = adapters.decode_all(packets.withColumn("protocol", F.when(F.col("protocol") == "coap", "echo").otherwise("mqtt")), registry)
    assert both.filter("detail = 'echo'").count() == packets.filter("protocol = 'coap'").count()


def test_bootstrap_resembles_resampling(spark):
    import numpy as np

    values = np.round(np.random.default_rng(3).beta(2, 5, 400), 2)
    df = spark.createDataFrame([("a", float(v)) for v in values], "g string, score double")
    ci = significance.bootstrap_ci(df, "score", ["g"], {"mean": significance.weighted_mean("score")}, replicates=2000).first()
    half = 1.96 * values.std() / 20
    assert ci["mean_lo"] == pytest.approx(values.mean() - half, abs=half * 0.15)
    assert ci["mean_hi"] == pytest.approx(values.mean() + half, abs=half * 0.15)


def test_mann_whitney_known_values(spark):
    a, b = [1.0, 2.0, 2.0, 3.0, 5.0, 8.0], [2.0, 4.0, 4.0, 6.0, 7.0, 9.0, 9.5]
    df = spark.createDataFrame([("a", v) for v in a] + [("b", v) for v in b], "g string, v double")
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    got = significance.mann_whitney(df, "v", F.col("g") == "a", F.col("g") == "b").first()
    assert got["statistic"] == pytest.approx(u)
    assert 0.05 < got["p_value"] < 0.3


def test_models_and_agreement(spark, ev, tmp_path):
    rows = vectors.legacy_vector(ev).select("event_id", "run_id", "protocol", "label", *FEATURES)
    quick = {
        "logreg": models.logistic_regression,
        "forest": lambda f, k: [models._assembler(f, "features"), models.RandomForestClassifier(
            labelCol="label_index", numTrees=5, maxDepth=5, weightCol="weight", seed=1)],
    }
    pred = models.experiment(rows, models=["logreg", "forest"], feature_sets=["full"], folds=2, builders=quick)
    table = evaluate.evaluate_splits(pred)
    assert {r["split"] for r in table.collect()} >= {"grouped_cv"}
    fitted = models.fit(rows, "forest", builder=quick["forest"])
    models.save(fitted, str(tmp_path / "m"))
    again = models.load(str(tmp_path / "m"))
    same = evaluate.agreement(models.predict(fitted, rows), models.predict(again, rows)).first()
    assert same["prediction_agreement"] == 1.0 and same["status"] == "PASS"
    assert models.size_bytes(spark, str(tmp_path / "m")) > 1000
    top = models.feature_importance(fitted)
    assert len(top) == 10 and top[0][1] >= top[-1][1]
    majority = rows.groupBy("label").count().agg(F.max("count")).first()[0] / rows.count()
    assert evaluate.metrics(models.predict(fitted, rows)).first()["accuracy"] >= majority
    scored = scorers.ModelScorer(fitted).score(rows.withColumn("bytes", F.lit(1)))
    assert scored.filter(~F.col("model_score").between(0, 1)).isEmpty()


def test_heuristic_scorer(spark, ev):
    rows = vectors.legacy_vector(ev)
    assert scorers.HeuristicScorer().score(rows).filter("model_score is null").isEmpty()


def test_bootstrap_seeds_are_unrelated(spark):
    counts = spark.range(1, 4).select((F.col("id") / 10).alias("v"), F.lit(3).cast("long").alias("n"))

    def draws(seed):
        rows = significance.resampled(counts, "v", 400, seed).collect()
        return {(r["v"], r["replicate"]): r["weight"] for r in rows}

    one, two = draws(42), draws(1042)
    for shift in (-1, 0, 1):
        both = [(w, two[v, k + shift]) for (v, k), w in one.items() if (v, k + shift) in two]
        assert sum(a == b for a, b in both) < 0.5 * len(both)


def test_validation_sample_sizes(spark):
    for n, size in ((0, 0), (300, 300), (1000, 1000), (4000, 1000), (7003, 1400)):
        rows = spark.range(n).withColumnRenamed("id", "event_id")
        got = [r[0] for r in evaluate.validation_sample(rows).collect()]
        assert len(got) == size and len(set(got)) == size
    everything = sorted(range(7003), key=lambda k: (hashlib.md5(f"42:{k}".encode()).hexdigest(), k))
    assert set(got) == set(everything[:1400])


def test_tree_settings_are_those_of_the_survey(spark):
    forest = models.random_forest(FEATURES, 7)[-1]
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getMinInstancesPerNode()) == (250, 30, 2)
    found = {n: models.BUILDERS[n](FEATURES, 7)[-1].getClassifier() for n in ("boosted_trees", "hist_boosting")}
    assert {n: (b.getMaxIter(), b.getStepSize(), b.getMaxDepth(), b.getMaxBins(), b.getSubsamplingRate()) for n, b in found.items()} == {
        "boosted_trees": (140, 0.08, 5, 255, 0.9), "hist_boosting": (180, 0.07, 8, 255, 1.0)}
    assert {"model_boosted_trees", "model_hist_boosting"} <= set(catalog.entries())
