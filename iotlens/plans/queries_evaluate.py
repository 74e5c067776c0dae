"""Queries: statistics and evaluation.

Predictions come from a fixed rule on the event's own columns, so both engines can compute
them; trained models are in ``queries_models``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from iotlens.functions.numeric import round6 as r6
from iotlens.operators import detect, evaluate, significance, vectors
from iotlens.plans import oracle_base as B
from iotlens.plans.queries_vectors import _p_sql
from iotlens.plans.registry import register
from iotlens.schemas import LABELS
from iotlens.sources.fixture import incoming, packet_events

q6 = B.round6


def _round(df, *names):
    return df.withColumns({n: r6(n) for n in names})


def _events(spark, sf):
    return packet_events(spark, sf).drop("payload")


def _scores(spark, sf):
    vec = vectors.behavioral_vector(incoming(_events(spark, sf)), detect.NEEDED_FEATURES)
    return detect.evaluate(vec).select("protocol", F.col("anomaly_score").alias("score"))


# ---- statistics ----------------------------------------------------------------------------

_C, _D = significance._QC, significance._QD
_T = "sqrt(ln(least(u, 1.0 - u)) * -2.0)"
_Z = (
    f"({_T} - ({_C[0]}::DOUBLE + {_T} * {_C[1]}::DOUBLE + {_T} * {_T} * {_C[2]}::DOUBLE) / "
    f"(1.0::DOUBLE + {_T} * {_D[0]}::DOUBLE + {_T} * {_T} * {_D[1]}::DOUBLE + {_T} * {_T} * {_T} * {_D[2]}::DOUBLE))"
)


def _mixed_sql() -> str:
    out = f"SELECT *, CAST(floor(v * 1e9 + 0.5) AS BIGINT) % {significance.FIELD} AS x FROM blocks"
    for turn, c in enumerate(significance.ROUNDS):
        out = f"SELECT * REPLACE ((x + {42 if turn % 2 else 'replicate'} + {c}) % {significance.FIELD} AS x) FROM ({out})"
        out = f"SELECT * REPLACE ((x * x % {significance.FIELD}) * (x * x % {significance.FIELD}) % {significance.FIELD} * x % {significance.FIELD} AS x) FROM ({out})"
    return f"SELECT protocol, v, n, cdf, replicate, (x + 0.5) / {significance.FIELD}.0::DOUBLE AS u FROM ({out})"


def _bootstrap_sql(replicates: int) -> str:
    return (
        B.WITH_SCORED
        + ", counts AS MATERIALIZED (SELECT protocol, anomaly_score AS v, count(*) AS n FROM sc GROUP BY ALL), "
        "cdfs AS (SELECT n, list(c ORDER BY k) AS cdf FROM (SELECT n, k, sum(exp(-CAST(n AS DOUBLE) + k * ln(CAST(n AS DOUBLE)) - lgamma(k + 1))) OVER "
        "(PARTITION BY n ORDER BY k) AS c FROM range(1, 9) a(n), range(0, 61) b(k) WHERE k <= CAST(floor(n + 6 * sqrt(n) + 8) AS BIGINT)) GROUP BY n), "
        f"blocks AS (SELECT protocol, v, c.n, cdf, replicate FROM counts c LEFT JOIN cdfs USING (n) CROSS JOIN range({replicates}) r(replicate)), "
        f"draws AS ({_mixed_sql()}), "
        f"w AS (SELECT protocol, v, replicate, CASE WHEN n <= 8 THEN CAST(len(list_filter(cdf, lambda c: c < u)) AS DOUBLE) "
        f"ELSE greatest(0.0::DOUBLE, floor(n + sqrt(n) * CASE WHEN u < 0.5 THEN -{_Z} ELSE {_Z} END + 0.5)) END AS weight FROM draws), "
        "per AS (SELECT protocol, replicate, sum(weight * v) / sum(weight) AS mean, sum(CASE WHEN v >= 0.75 THEN weight ELSE 0.0 END) / sum(weight) AS flagged FROM w GROUP BY ALL) "
        "SELECT protocol, " + ", ".join(
            f"{q6(f'quantile_cont({c}, {q})')} AS {c}_{s}" for c in ("mean", "flagged") for s, q in (("lo", 0.025), ("hi", 0.975))
        ) + " FROM per GROUP BY protocol"
    )


@register("bootstrap_ci", _bootstrap_sql(significance.REPLICATES))
def bootstrap_ci(spark, sf):
    out = significance.bootstrap_ci(
        _scores(spark, sf), "score", ["protocol"],
        {"mean": significance.weighted_mean("score"), "flagged": significance.weighted_share("score", 0.75)},
        level=0.95,
    )
    return _round(out, "mean_lo", "mean_hi", "flagged_lo", "flagged_hi")


def _sides():
    return F.col("protocol") == "mqtt", F.col("protocol") == "coap"


@register(
    "cohen_d",
    B.WITH_SCORED + f"SELECT {q6('(avg(anomaly_score) FILTER (protocol = ' + chr(39) + 'mqtt' + chr(39) + ') - avg(anomaly_score) FILTER (protocol = ' + chr(39) + 'coap' + chr(39) + ')) / sqrt((var_samp(anomaly_score) FILTER (protocol = ' + chr(39) + 'mqtt' + chr(39) + ') + var_samp(anomaly_score) FILTER (protocol = ' + chr(39) + 'coap' + chr(39) + ')) / 2.0)')} AS cohen_d FROM sc",
)
def cohen_d(spark, sf):
    return _round(significance.cohen_d(_scores(spark, sf), "score", *_sides()), "cohen_d")


@register(
    "mann_whitney",
    B.WITH_SCORED + ", c AS (SELECT anomaly_score AS v, count(*) FILTER (protocol = 'mqtt') AS na, count(*) FILTER (protocol = 'coap') AS nb, CAST(count(*) AS DOUBLE) AS n FROM sc GROUP BY v), "
    "r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c), "
    "s AS (SELECT CAST(sum(na) AS DOUBLE) AS a, CAST(sum(nb) AS DOUBLE) AS b, sum(na * (before + (n + 1) / 2.0)) AS rs, sum(n * n * n - n) AS ties FROM r), "
    "u AS (SELECT *, rs - a * (a + 1) / 2.0 AS u FROM s), "
    "z AS (SELECT u, (greatest(u, a * b - u) - a * b / 2.0 - 0.5) / sqrt(a * b / 12.0 * (a + b + 1 - ties / ((a + b) * (a + b - 1)))) AS z FROM u), "
    f"p AS (SELECT u AS statistic, least(1.0::DOUBLE, CASE WHEN z < 0 THEN 2.0 - {_p_sql('z')} ELSE {_p_sql('z')} END) AS p FROM z) "
    f"SELECT {q6('statistic')} AS statistic, {q6('p')} AS p_value, p < 0.05 AS significant_p005 FROM p",
)
def mann_whitney(spark, sf):
    return _round(significance.mann_whitney(_scores(spark, sf), "score", *_sides()), "statistic", "p_value")


# ---- stand-in predictions ------------------------------------------------------------------

MODELS = ["lightgbm", "random_forest", "mlp", "logreg"]
SETS = ["full", "normalized_plus_pid"]
SPLITS = ["grouped_cv", "cross_mqtt_to_coap", "cross_coap_to_mqtt"]


def _predictions(spark, sf):
    rows = evaluate.with_folds(_events(spark, sf).select("event_id", "run_id", "protocol", "label", "k"))
    runs = F.array(*[
        F.struct(F.lit(fs).alias("feature_set"), F.lit(m).alias("model"), F.lit(s).alias("split"),
                 F.lit(i).alias("mi"), F.lit(j).alias("fi"), F.lit(x).alias("si"))
        for i, m in enumerate(MODELS) for j, fs in enumerate(SETS) for x, s in enumerate(SPLITS)
    ])
    df = rows.select("*", F.inline(runs))
    df = df.filter(
        (F.col("si") == 0) | ((F.col("si") == 1) & (F.col("protocol") == "coap")) | ((F.col("si") == 2) & (F.col("protocol") == "mqtt"))
    )
    draw = (F.col("event_id") * (F.col("mi") * 2 + 7) + F.col("k") * 3 + F.col("mi") * 3 + F.col("fi") * 5 + F.col("si") * 7) % 100
    limit = F.lit(80) - F.col("mi") * 10 - F.col("fi") * 5 - F.when(F.col("si") > 0, 30).otherwise(0)
    other = F.when((F.col("event_id") + F.col("k")) % 2 == 0, "benign").otherwise(F.concat("protocol", F.lit("_protocol_abuse")))
    return df.select(
        "event_id", "feature_set", "model", "split",
        F.when(F.col("si") == 0, F.col("fold")).alias("fold"), "label",
        F.when(draw < limit, F.col("label")).otherwise(other).alias("predicted"),
    )


def _names(values, alias):
    return "(VALUES " + ", ".join(f"({i}, '{v}')" for i, v in enumerate(values)) + f") {alias}"


_FOLDS = (
    ", rl AS (SELECT run_id, label, count(*) AS n FROM ev GROUP BY ALL), "
    "runs AS (SELECT run_id, label, rows FROM (SELECT run_id, label, CAST(sum(n) OVER (PARTITION BY run_id) AS BIGINT) AS rows, "
    "row_number() OVER (PARTITION BY run_id ORDER BY n DESC, label DESC) AS r FROM rl) WHERE r = 1), "
    "placed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY rows DESC, md5(run_id)) - 1 AS place FROM runs), "
    "folds AS (SELECT run_id, label, rows, CAST(CASE WHEN place // 5 % 2 = 0 THEN place % 5 ELSE 4 - place % 5 END AS INTEGER) AS fold FROM placed)"
)
WITH_PRED = (
    B.WITH_EV + _FOLDS
    + ", pred AS MATERIALIZED (SELECT e.event_id, fs.name AS feature_set, m.name AS model, s.name AS split, CASE WHEN s.i = 0 THEN f.fold END AS fold, e.label, "
    "CASE WHEN (event_id * (m.i * 2 + 7) + k * 3 + m.i * 3 + fs.i * 5 + s.i * 7) % 100 < 80 - m.i * 10 - fs.i * 5 - CASE WHEN s.i > 0 THEN 30 ELSE 0 END THEN e.label "
    "WHEN (event_id + k) % 2 = 0 THEN 'benign' ELSE protocol || '_protocol_abuse' END AS predicted "
    f"FROM ev e JOIN folds f USING (run_id), {_names(MODELS, 'm(i, name)')}, {_names(SETS, 'fs(i, name)')}, {_names(SPLITS, 's(i, name)')} "
    "WHERE s.i = 0 OR (s.i = 1 AND protocol = 'coap') OR (s.i = 2 AND protocol = 'mqtt'))"
)


def _metric_ctes(source: str, by: str, prefix: str) -> str:
    """CTEs ``<prefix>_pc`` (per class) and ``<prefix>_m`` (metrics) of a prediction table."""
    return (
        f", {prefix}_cm AS (SELECT {by}, label, predicted, count(*) AS n FROM {source} GROUP BY ALL), "
        f"{prefix}_sides AS (SELECT {by}, label AS l, n AS support, 0 AS guessed, CASE WHEN label = predicted THEN n ELSE 0 END AS hits FROM {prefix}_cm "
        f"UNION ALL SELECT {by}, predicted, 0, n, 0 FROM {prefix}_cm), "
        f"{prefix}_sum AS (SELECT {by}, l AS label, CAST(sum(support) AS BIGINT) AS support, sum(guessed) AS guessed, CAST(sum(hits) AS BIGINT) AS hits FROM {prefix}_sides GROUP BY ALL), "
        f"{prefix}_pc AS (SELECT {by}, label, support, hits, CASE WHEN guessed > 0 THEN CAST(hits AS DOUBLE) / guessed ELSE 0.0::DOUBLE END AS precision, "
        f"CASE WHEN support > 0 THEN CAST(hits AS DOUBLE) / support ELSE 0.0::DOUBLE END AS recall, "
        f"CASE WHEN guessed + support > 0 THEN 2.0::DOUBLE * hits / (guessed + support) ELSE 0.0::DOUBLE END AS f1 FROM {prefix}_sum), "
        f"{prefix}_m AS (SELECT {by}, CAST(sum(hits) AS DOUBLE) / sum(support) AS accuracy, avg(f1) AS f1_macro, sum(f1 * support) / sum(support) AS f1_weighted FROM {prefix}_pc GROUP BY {by})"
    )


_PRED0 = "(SELECT * REPLACE (coalesce(fold, 0) AS fold) FROM pred)"
WITH_RESULTS = (
    WITH_PRED + _metric_ctes(_PRED0, "feature_set, model, split, fold", "x")
    + ", results AS MATERIALIZED (SELECT feature_set, model, split, avg(accuracy) AS accuracy, avg(f1_macro) AS f1_macro, avg(f1_weighted) AS f1_weighted FROM x_m GROUP BY ALL)"
)
_M = evaluate.METRICS


def _results(spark, sf):
    return evaluate.evaluate_splits(_predictions(spark, sf))


def _cv_full(spark, sf, model):
    p = _predictions(spark, sf)
    return p.filter((F.col("split") == "grouped_cv") & (F.col("feature_set") == "full") & (F.col("model") == model))


# ---- evaluation ----------------------------------------------------------------------------


@register(
    "class_weights",
    B.WITH_EV + ", c AS (SELECT label, count(*) AS rows FROM ev GROUP BY label) SELECT label, rows, "
    f"{q6('sum(rows) OVER () / (count(*) OVER () * rows)')} AS weight FROM c",
)
def class_weights(spark, sf):
    return _round(evaluate.class_weights(_events(spark, sf)), "weight")


@register(
    "label_index",
    B.WITH_EV + "SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS label_index FROM (SELECT DISTINCT label FROM ev)",
)
def label_index(spark, sf):
    from iotlens.operators.models import label_indexer

    ev = _events(spark, sf).select("label")
    fitted = label_indexer().fit(ev)
    return fitted.transform(ev.distinct()).select("label", F.col("label_index").cast("long").alias("label_index"))


@register("group_folds", B.WITH_EV + _FOLDS + " SELECT run_id, label, rows, fold FROM folds")
def group_folds(spark, sf):
    return evaluate.group_folds(_events(spark, sf))


@register(
    "cross_splits",
    B.WITH_EV + "SELECT 'cross_mqtt_to_coap' AS split, count(*) FILTER (protocol = 'mqtt') AS train_rows, count(*) FILTER (protocol = 'coap') AS test_rows FROM ev "
    "UNION ALL SELECT 'cross_coap_to_mqtt', count(*) FILTER (protocol = 'coap'), count(*) FILTER (protocol = 'mqtt') FROM ev",
)
def cross_splits(spark, sf):
    parts = []
    for split in evaluate.CROSS_SPLITS:
        train, test = evaluate.cross_split(_events(spark, sf), split)
        tagged = train.select(F.lit(1).alias("t")).unionByName(test.select(F.lit(0).alias("t")))
        parts.append(tagged.agg(F.sum("t").alias("train_rows"), F.count_if(F.col("t") == 0).alias("test_rows")).withColumn("split", F.lit(split)))
    return parts[0].unionByName(parts[1])


@register("confusion", WITH_PRED + " SELECT model, feature_set, split, label, predicted, count(*) AS n FROM pred GROUP BY ALL")
def confusion(spark, sf):
    return evaluate.confusion(_predictions(spark, sf), ["model", "feature_set", "split"])


@register(
    "per_class",
    WITH_PRED + _metric_ctes("pred", "feature_set, model, split", "y") + " SELECT feature_set, model, split, label, "
    + ", ".join(f"{q6(c)} AS {c}" for c in ("precision", "recall", "f1")) + ", support FROM y_pc",
)
def per_class(spark, sf):
    by = ["feature_set", "model", "split"]
    table = evaluate.per_class(evaluate.confusion(_predictions(spark, sf), by), by).drop("hits")
    return _round(table, "precision", "recall", "f1")


@register(
    "overall_metrics",
    WITH_PRED + _metric_ctes("pred", "feature_set, model, split", "y") + " SELECT feature_set, model, split, "
    + ", ".join(f"{q6(c)} AS {c}" for c in _M) + " FROM y_m",
)
def overall_metrics(spark, sf):
    return _round(evaluate.metrics(_predictions(spark, sf), ["feature_set", "model", "split"]), *_M)


@register(
    "fold_metrics",
    WITH_RESULTS + " SELECT feature_set, model, split, fold, " + ", ".join(f"{q6(c)} AS {c}" for c in _M) + " FROM x_m WHERE split = 'grouped_cv'",
)
def fold_metrics(spark, sf):
    p = _predictions(spark, sf).filter(F.col("split") == "grouped_cv")
    return _round(evaluate.metrics(p, ["feature_set", "model", "split", "fold"]), *_M)


@register("results_table", WITH_RESULTS + " SELECT feature_set, model, split, " + ", ".join(f"{q6(c)} AS {c}" for c in _M) + " FROM results")
def results_table(spark, sf):
    return _round(evaluate.ordered_results(_results(spark, sf)), *_M)


@register(
    "run_summary",
    WITH_RESULTS + " SELECT (SELECT count(*) FROM ev) AS dataset_rows, (SELECT count(DISTINCT run_id) FROM ev) AS run_count, model AS best_model, feature_set AS best_feature_set, "
    f"{q6('f1_macro')} AS best_f1_macro FROM results WHERE split = 'grouped_cv' ORDER BY results.f1_macro DESC, model, feature_set LIMIT 1",
)
def run_summary(spark, sf):
    totals = _events(spark, sf).agg(
        F.count(F.lit(1)).alias("dataset_rows"), F.count_distinct("run_id").alias("run_count")
    ).withColumn("_k", F.lit(1))
    best = significance.best_model(_results(spark, sf)).select(
        F.col("model").alias("best_model"), F.col("feature_set").alias("best_feature_set"), r6("f1_macro").alias("best_f1_macro")
    )
    return totals.join(best.withColumn("_k", F.lit(1)), "_k").drop("_k")


_CELLS = [f"{m}_{fs}" for m in ("f1_macro", "f1_weighted", "accuracy") for fs in SETS]


@register(
    "model_comparison",
    WITH_RESULTS + " SELECT model, " + ", ".join(
        f"{q6(f'''coalesce(max({m}) FILTER (feature_set = '{fs}'), 0.0)''')} AS {m}_{fs}" for m in ("f1_macro", "f1_weighted", "accuracy") for fs in SETS
    ) + " FROM results WHERE split = 'grouped_cv' GROUP BY model",
)
def model_comparison(spark, sf):
    return _round(evaluate.comparison_table(_results(spark, sf)), *_CELLS)


def _matrix_sql() -> str:
    def at(m, s):
        return f"round(max({m}) FILTER (split = '{s}'), 4)"

    cols = []
    for m in ("f1_macro", "f1_weighted"):
        cols += [f"{q6(at(m, s))} AS {m}_{s}" for s in SPLITS]
        cols.append(f"{q6(f'{at(m, SPLITS[0])} - least({at(m, SPLITS[1])}, {at(m, SPLITS[2])})')} AS {m}_gap")
    return WITH_RESULTS + " SELECT model, " + ", ".join(cols) + " FROM results WHERE feature_set = 'full' GROUP BY model"


@register("generalization_matrix", _matrix_sql())
def generalization_matrix(spark, sf):
    wide = evaluate.generalization_matrix(_results(spark, sf))
    return _round(wide, *[c for c in wide.columns if c != "model"])


@register(
    "champion_classes",
    WITH_PRED + _metric_ctes("(SELECT * FROM pred WHERE split = 'grouped_cv' AND feature_set = 'full' AND model = 'lightgbm')", "model", "y")
    + ", spine AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{v}')" for i, v in enumerate(LABELS)) + ") s(position, label)) "
    "SELECT position, label, " + ", ".join(f"{q6(f'coalesce({c}, 0.0)')} AS {c}" for c in ("precision", "recall", "f1")) + " FROM spine LEFT JOIN y_pc USING (label)",
)
def champion_classes(spark, sf):
    classes = evaluate.per_class(evaluate.confusion(_cv_full(spark, sf, "lightgbm")))
    return _round(evaluate.champion_classes(spark, classes), "precision", "recall", "f1")


@register(
    "agreement",
    WITH_PRED + ", one AS (SELECT * FROM pred WHERE split = 'grouped_cv' AND feature_set = 'full' AND model = 'lightgbm'), "
    "two AS (SELECT * FROM pred WHERE split = 'grouped_cv' AND feature_set = 'full' AND model = 'random_forest')"
    + _metric_ctes("one", "model", "a") + _metric_ctes("two", "model", "b")
    + ", s AS (SELECT count(*) AS validation_samples, avg(CASE WHEN one.predicted = two.predicted THEN 1.0::DOUBLE ELSE 0.0 END) AS share FROM one JOIN two USING (event_id)) "
    f"SELECT validation_samples, {q6('share')} AS prediction_agreement, {q6('a_m.accuracy')} AS accuracy_original, {q6('b_m.accuracy')} AS accuracy_other, "
    f"{q6('abs(a_m.accuracy - b_m.accuracy)')} AS accuracy_delta, {q6('a_m.f1_macro')} AS f1_macro_original, {q6('b_m.f1_macro')} AS f1_macro_other, "
    f"{q6('abs(a_m.f1_macro - b_m.f1_macro)')} AS f1_macro_delta, CASE WHEN share > 0.99 THEN 'PASS' WHEN share > 0.95 THEN 'WARN' ELSE 'FAIL' END AS status FROM s, a_m, b_m",
)
def agreement(spark, sf):
    out = evaluate.agreement(_cv_full(spark, sf, "lightgbm"), _cv_full(spark, sf, "random_forest"))
    return _round(out, *[c for c in out.columns if c not in ("validation_samples", "status")])


@register(
    "validation_sample",
    B.WITH_EV + "SELECT event_id, label FROM ev QUALIFY row_number() OVER (ORDER BY md5('42:' || event_id), event_id) <= greatest(1000, count(*) OVER () // 5)",
)
def validation_sample(spark, sf):
    return evaluate.validation_sample(_events(spark, sf).select("event_id", "label"))


_SE = "sqrt(f1_macro * (1.0 - f1_macro) / 11209.0)"


@register(
    "f1_interval",
    WITH_RESULTS + f" SELECT feature_set, model, split, {q6('f1_macro')} AS f1_macro, {q6(_SE)} AS f1_macro_se, "
    f"{q6(f'greatest(0.0, f1_macro - 1.96 * {_SE})')} AS f1_macro_ci95_lo, {q6(f'least(1.0, f1_macro + 1.96 * {_SE})')} AS f1_macro_ci95_hi, "
    f"{q6('accuracy')} AS accuracy, {q6('f1_weighted')} AS f1_weighted FROM results",
)
def f1_interval(spark, sf):
    out = significance.f1_interval(_results(spark, sf))
    return _round(out, *_M, "f1_macro_se", "f1_macro_ci95_lo", "f1_macro_ci95_hi")


_SD = "sqrt(c * (1.0 - c) / 11209.0 + o * (1.0 - o) / 11209.0)"


@register(
    "model_ztest",
    WITH_RESULTS + ", t AS (SELECT r.model, b.f1_macro AS c, r.f1_macro AS o FROM results r, results b WHERE r.split = 'grouped_cv' AND r.feature_set = 'full' "
    "AND b.split = 'grouped_cv' AND b.feature_set = 'full' AND b.model = 'lightgbm' AND r.model <> 'lightgbm'), "
    f"z AS (SELECT *, c - o AS d, {_SD} AS sd, (c - o) / {_SD} AS z FROM t) "
    f"SELECT model, {q6('c')} AS champion_f1, {q6('o')} AS other_f1, {q6('d')} AS delta_f1, {q6('sd')} AS se_diff, {q6('z')} AS z_score, {q6(_p_sql('z'))} AS p_value, "
    f"{_p_sql('z')} < 0.05 AS significant_p005 FROM z",
)
def model_ztest(spark, sf):
    out = significance.model_ztest(_results(spark, sf), "lightgbm")
    return _round(out, "champion_f1", "other_f1", "delta_f1", "se_diff", "z_score", "p_value")


_AT = {s: f"max(f1_macro) FILTER (split = '{s}')" for s in SPLITS}


@register(
    "generalization_gap",
    WITH_RESULTS + f", g AS (SELECT feature_set, model, {_AT['grouped_cv']} AS i, {_AT['cross_coap_to_mqtt']} AS cm, {_AT['cross_mqtt_to_coap']} AS mc FROM results GROUP BY ALL) "
    f"SELECT feature_set, model, {q6('i')} AS in_protocol, {q6('cm')} AS cross_coap_to_mqtt, {q6('mc')} AS cross_mqtt_to_coap, {q6('i - cm')} AS gap_coap_to_mqtt, "
    f"{q6('i - mc')} AS gap_mqtt_to_coap, {q6('((i - cm) + (i - mc)) / 2.0')} AS mean_generalization_gap FROM g",
)
def generalization_gap(spark, sf):
    out = significance.generalization_gap(_results(spark, sf))
    return _round(out, *[c for c in out.columns if c not in ("feature_set", "model")])


@register(
    "best_model",
    WITH_RESULTS + f" SELECT feature_set, model, split, {', '.join(f'{q6(c)} AS {c}' for c in _M)} FROM results WHERE split = 'grouped_cv' AND feature_set = 'full' ORDER BY results.f1_macro DESC, model LIMIT 1",
)
def best_model(spark, sf):
    return _round(significance.best_model(_results(spark, sf), feature_set="full"), *_M)


@register(
    "champion",
    WITH_RESULTS + ", c AS (SELECT model, f1_macro, CASE WHEN model = 'lightgbm' THEN 1.4 ELSE 0.2 END::DOUBLE AS p99_ms, CASE WHEN model = 'mlp' THEN 12.0 ELSE 2.0 END::DOUBLE AS size_mb "
    "FROM results WHERE split = 'grouped_cv' AND feature_set = 'full') "
    f"SELECT model, {q6('f1_macro')} AS f1_macro, p99_ms, size_mb, {q6('(SELECT max(f1_macro) FROM c)')} AS best_f1 FROM c "
    "WHERE f1_macro >= (SELECT max(f1_macro) FROM c) - 0.2 AND p99_ms < 1 AND size_mb < 10 ORDER BY c.f1_macro DESC, model LIMIT 1",
)
def champion(spark, sf):
    cv = _results(spark, sf).filter((F.col("split") == "grouped_cv") & (F.col("feature_set") == "full"))
    measured = cv.select(
        "model", "f1_macro",
        F.when(F.col("model") == "lightgbm", 1.4).otherwise(0.2).alias("p99_ms"),
        F.when(F.col("model") == "mlp", 12.0).otherwise(2.0).alias("size_mb"),
    )
    return _round(significance.champion(measured, within=0.2), "f1_macro", "best_f1")
