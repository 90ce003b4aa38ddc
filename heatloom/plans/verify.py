"""Queries: verification against stations and fields, and the reports on models."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatloom.functions import columns as C
from heatloom.operators import clean, heat, report, verify
from heatloom.plans.base import GRID, HOURLY, RUNS, grid, obs, query, runs, table

M = "avg(abs({p} - {o})) AS MAE{s}, sqrt(avg(({p} - {o}) * ({p} - {o}))) AS RMSE{s}, avg({p} - {o}) AS Bias{s}, corr({p}, {o}) AS Corr{s}, count({p} - {o}) AS N{s}"
NAMES = "MAE{s} RMSE{s} Bias{s} Corr{s}"


def measures(p: str, o: str, s: str = "") -> str:
    return M.format(p=p, o=o, s=s)


PAIRS = """pairs AS (SELECT CAST(l_suppkey AS VARCHAR) AS station_id, l_shipdate + to_hours(l_linenumber * 3) AS time, l_quantity AS pred_c, l_quantity * (1 + l_tax - l_discount) AS obs_c, l_extendedprice / 1500 AS ref_c, l_returnflag AS segment, l_linestatus AS model FROM lineitem)"""


def pairs(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("station_id"), (F.col("l_shipdate").cast("timestamp") + F.make_interval(hours=F.col("l_linenumber") * 3)).alias("time"), F.col("l_quantity").alias("pred_c"),
        (F.col("l_quantity") * (1 + F.col("l_tax") - F.col("l_discount"))).alias("obs_c"), (F.col("l_extendedprice") / 1500).alias("ref_c"), F.col("l_returnflag").alias("segment"), F.col("l_linestatus").alias("model"),
    )


@query(f"WITH {PAIRS} SELECT model, segment, {measures('pred_c', 'obs_c')} FROM pairs GROUP BY 1, 2", NAMES.format(s=""))
def verify_segments(spark, d):
    """A8."""
    return verify.verify(pairs(spark, d), "pred_c", "obs_c", ["model", "segment"])


ALL = ", ".join((measures("pred_c", "obs_c", "_model"), measures("ref_c", "obs_c", "_reference"), measures("pred_c", "ref_c", "_model_reference")))


@query(
    f"WITH {PAIRS} SELECT segment, station_id, CAST(grouping(segment, station_id) AS BIGINT) AS level, {ALL} FROM pairs GROUP BY GROUPING SETS ((), (segment), (station_id), (segment, station_id))",
    " ".join(NAMES.format(s=s) for s in ("_model", "_reference", "_model_reference")), 5,
)
def verify_grouping_sets(spark, d):
    """A9."""
    return verify.verify_grouping_sets(pairs(spark, d), "pred_c", "obs_c", "ref_c", [[], ["segment"], ["station_id"], ["segment", "station_id"]])


STATION = HOURLY + ", pred AS (SELECT time, station_id, obs_c * 1.05 - 1 AS pred_c FROM hourly)"


def station_pred(spark, d):
    return heat.hourly_station_mean(obs(spark, d)).select("time", "station_id", (F.col("obs_c") * 1.05 - 1).alias("pred_c"))


@query(f"WITH {STATION} SELECT p.time, p.station_id, p.pred_c, h.obs_c FROM pred p JOIN hourly h USING (time, station_id)", "pred_c obs_c")
def match_obs(spark, d):
    """J2."""
    return verify.match_obs(station_pred(spark, d), heat.hourly_station_mean(obs(spark, d)).select("time", "station_id", "obs_c"))


@query(f"WITH {HOURLY} SELECT h.time, h.station_id, h.n_obs_raw, s.s_name AS name, n.n_name AS comarca FROM hourly h LEFT JOIN supplier s ON CAST(s.s_suppkey AS VARCHAR) = h.station_id LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey")
def attach_station_meta(spark, d):
    """J7."""
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("comarca"))
    meta = table(spark, d, "supplier").join(nation, "s_nationkey", "left").select(F.col("s_suppkey").cast("string").alias("station_id"), F.col("s_name").alias("name"), "comarca")
    return verify.attach_station_meta(heat.hourly_station_mean(obs(spark, d)).select("time", "station_id", "n_obs_raw"), meta)


@query(f"WITH {HOURLY}, hot AS (SELECT DISTINCT time FROM hourly WHERE obs_c > 120) SELECT h.time, h.station_id, t.time IS NOT NULL AS is_heatwave FROM hourly h LEFT JOIN hot t ON t.time = h.time")
def flag_heatwave(spark, d):
    """J8."""
    rows = heat.hourly_station_mean(obs(spark, d))
    return verify.flag_heatwave(rows, rows.where("obs_c > 120")).select("time", "station_id", "is_heatwave")


LAG = STATION + ", p AS (SELECT time, avg(pred_c) AS pred_c FROM pred GROUP BY 1), o AS (SELECT time, avg(obs_c) AS obs_c FROM hourly GROUP BY 1), l AS (SELECT CAST(unnest(range(-3, 4)) AS INT) AS lag_h)"


@query(f"WITH {LAG} SELECT lag_h, {measures('pred_c', 'obs_c')} FROM (SELECT lag_h, pred_c, obs_c FROM p CROSS JOIN l JOIN o ON o.time = p.time + to_hours(lag_h)) GROUP BY 1", NAMES.format(s=""))
def lag_table(spark, d):
    """J10."""
    return verify.lag_table(station_pred(spark, d), heat.hourly_station_mean(obs(spark, d)))


CALIB = PAIRS + ", cal AS (SELECT * FROM pairs WHERE time < TIMESTAMP '2000-01-01'), test AS (SELECT * FROM pairs WHERE time >= TIMESTAMP '2000-01-01')"


@query(f"WITH {CALIB}, b AS (SELECT station_id, avg(pred_c - obs_c) AS bias FROM cal GROUP BY 1) SELECT station_id, {measures('pc', 'obs_c')} FROM (SELECT t.station_id, t.pred_c - coalesce(bias, 0) AS pc, t.obs_c FROM test t LEFT JOIN b USING (station_id)) GROUP BY 1", NAMES.format(s=""))
def bias_correct(spark, d):
    """J13."""
    p = pairs(spark, d)
    return verify.verify(verify.bias_correct(p.where("time >= '2000-01-01'"), p.where("time < '2000-01-01'")), "pred_c", "obs_c", ["station_id"])


@query(f"WITH {CALIB}, b AS (SELECT station_id, hour(time) AS h, avg(pred_c - obs_c) AS bias FROM cal GROUP BY 1, 2) SELECT station_id, {measures('pc', 'obs_c')} FROM (SELECT t.station_id, t.pred_c - coalesce(bias, 0) AS pc, t.obs_c FROM test t LEFT JOIN b ON b.station_id = t.station_id AND b.h = hour(t.time)) GROUP BY 1", NAMES.format(s=""))
def bias_correct_hourly(spark, d):
    p = pairs(spark, d)
    return verify.verify(verify.bias_correct(p.where("time >= '2000-01-01'"), p.where("time < '2000-01-01'"), "station_hour"), "pred_c", "obs_c", ["station_id"])


@query(f"WITH {GRID} SELECT time, avg(abs(pred_c - t_c)) AS mae, sqrt(avg((pred_c - t_c) * (pred_c - t_c))) AS rmse, avg(pred_c) AS pred_mean, stddev_pop(pred_c) AS pred_std, avg(t_c) AS ref_mean, stddev_pop(t_c) AS ref_std FROM grid GROUP BY 1", "mae rmse pred_mean pred_std ref_mean ref_std")
def frame_metrics(spark, d):
    """A20."""
    return verify.frame_metrics(grid(spark, d), ["time"])


PAIR = GRID + ", p AS (SELECT time, pred_c AS a, pred_c * 0.9 + x AS b, t_c AS r FROM grid)"
PAIR_MEANS = ", ".join(f"avg(abs({k} - r)) AS mae_model_{k}, sqrt(avg(({k} - r) * ({k} - r))) AS rmse_model_{k}, avg({k}) AS pred_{k}_mean" for k in "ab")


@query(f"WITH {PAIR} SELECT time, {PAIR_MEANS}, avg(r) AS hr_mean, CAST(hour(time) AS INT) AS hour FROM p GROUP BY 1", "mae_model_a rmse_model_a pred_a_mean mae_model_b rmse_model_b pred_b_mean hr_mean")
def frame_metrics_pair(spark, d):
    """A20, two models against one reference."""
    return verify.frame_metrics_pair(grid(spark, d, C.exact_mean).select("time", F.col("pred_c").alias("pred_a"), (F.col("pred_c") * 0.9 + F.col("x")).alias("pred_b"), "t_c"))


@query(f"WITH {GRID} SELECT avg(abs(pred_c - t_c)) AS mae, sqrt(avg((pred_c - t_c) * (pred_c - t_c))) AS rmse, avg((pred_c - t_c) * (pred_c - t_c)) AS mse FROM grid", "mae rmse mse")
def split_metrics(spark, d):
    """A39."""
    return verify.split_metrics(grid(spark, d))


@query(f"WITH {GRID}, t AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS n FROM (SELECT DISTINCT time FROM grid)) SELECT g.time, y, x, pred_c FROM grid g JOIN t USING (time) WHERE n < 30 AND n % 3 = 0", "pred_c")
def first_n_times(spark, d):
    """T2."""
    return verify.first_n_times(grid(spark, d), 30, 3).select("time", "y", "x", "pred_c")


HALVES = HOURLY + """, a AS (SELECT DISTINCT time FROM hourly WHERE CAST(station_id AS BIGINT) % 7 < 3),
b AS (SELECT DISTINCT time FROM hourly WHERE CAST(station_id AS BIGINT) % 7 >= 3 AND hour(time) <> 5)"""


@query(
    f"""WITH {HALVES} SELECT (SELECT count(*) FROM a JOIN b USING (time)) AS n_common,
(SELECT count(*) FROM a ANTI JOIN b USING (time)) AS hr_dropped, (SELECT count(*) FROM b ANTI JOIN a USING (time)) AS lr_dropped"""
)
def align_times(spark, d):
    """Two networks of stations, of which one reports nothing at five."""
    rows = heat.hourly_station_mean(obs(spark, d))
    first = F.col("station_id").cast("bigint") % 7 < 3
    return verify.align_times(rows.where(first), rows.where(~first & (F.hour("time") != 5)))[2]


AGG = "count(*) AS n, avg(mae) AS mae_mean, avg(rmse) AS rmse_mean, avg(ssim) AS ssim_mean, {s}(mae) AS mae_std, {s}(rmse) AS rmse_std, {s}(ssim) AS ssim_std"
AGG_NAMES = "mae_mean rmse_mean ssim_mean mae_std rmse_std ssim_std"


@query(f"WITH {RUNS} SELECT model, {AGG.format(s='stddev_samp')} FROM raw GROUP BY 1", AGG_NAMES)
def aggregate_models(spark, d):
    """A12 with the sample deviation."""
    return report.aggregate_models(runs(spark, d), ["model"])


@query(f"WITH {RUNS} SELECT model, variant, {AGG.format(s='stddev_pop')} FROM raw GROUP BY 1, 2", AGG_NAMES)
def aggregate_models_pop(spark, d):
    return report.aggregate_models(runs(spark, d), ["model", "variant"], std="pop")


@query(f"WITH {RUNS} SELECT model, CAST(regexp_extract(experiment, '_S([0-9]+)', 1) AS INT) AS seed, count(*) AS n_events, avg(mae) AS mae_mean, avg(rmse) AS rmse_mean, avg(ssim) AS ssim_mean FROM raw WHERE experiment LIKE '%\\_S%' ESCAPE '\\' GROUP BY 1, 2", "mae_mean rmse_mean ssim_mean")
def by_model_seed(spark, d):
    """A13, P11."""
    return report.by_model_seed(runs(spark, d))


DN = ", ".join(f"avg({m}) AS {m}_all, avg(CASE WHEN hour(time) BETWEEN 8 AND 19 THEN {m} END) AS {m}_day, avg(CASE WHEN hour(time) NOT BETWEEN 8 AND 19 THEN {m} END) AS {m}_night" for m in ("mae", "rmse"))


@query(f"WITH {RUNS} SELECT variant, count(*) AS n, {DN} FROM raw GROUP BY 1", "mae_all mae_day mae_night rmse_all rmse_day rmse_night")
def day_night_pivot(spark, d):
    """A16."""
    return report.day_night_pivot(runs(spark, d), ["variant"], ["mae", "rmse"])


LOG = "log AS (SELECT o_orderpriority AS model, CAST(o_custkey % 5 AS INT) AS seed, row_number() OVER (PARTITION BY o_orderpriority, o_custkey % 5 ORDER BY o_orderkey) AS epoch, o_totalprice / 1000 AS loss, round(o_totalprice / 5000) AS val_loss, round(o_totalprice / 9000) AS val_mae, 1.0 / o_orderkey AS lr FROM orders WHERE o_orderkey > 0)"


@query(
    f"""WITH {LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY model, seed ORDER BY val_loss, epoch) AS a, row_number() OVER (PARTITION BY model, seed ORDER BY val_mae, epoch) AS b, row_number() OVER (PARTITION BY model, seed ORDER BY epoch DESC) AS z FROM log)
SELECT model, seed, count(*) AS epochs, min(val_loss) AS best_val_loss, max(CASE WHEN a = 1 THEN epoch END) AS best_val_loss_epoch, min(val_mae) AS best_val_mae, max(CASE WHEN b = 1 THEN epoch END) AS best_val_mae_epoch,
max(CASE WHEN z = 1 THEN loss END) AS last_loss, max(CASE WHEN z = 1 THEN val_loss END) AS last_val_loss, max(CASE WHEN z = 1 THEN lr END) AS last_lr FROM r GROUP BY 1, 2""",
    "best_val_loss best_val_mae last_loss last_val_loss last_lr",
)
def training_summary(spark, d):
    """A17."""
    from pyspark.sql import Window

    o = table(spark, d, "orders").where("o_orderkey > 0")
    seed, price = (F.col("o_custkey") % 5).cast("int"), F.col("o_totalprice")
    epoch = F.row_number().over(Window.partitionBy("o_orderpriority", seed).orderBy("o_orderkey")).cast("bigint")
    log = o.select(F.col("o_orderpriority").alias("model"), seed.alias("seed"), epoch.alias("epoch"), (price / 1000).alias("loss"), F.round(price / 5000).alias("val_loss"), F.round(price / 9000).alias("val_mae"), (1.0 / F.col("o_orderkey")).alias("lr"))
    return report.training_summary(log)


MEANS = RUNS + ", agg AS (SELECT variant, model, avg(mae) AS MAE, avg(rmse) AS RMSE, corr(mae, rmse) AS Corr, avg(ssim) AS ssim FROM raw GROUP BY 1, 2)"


def means(spark, d):
    return runs(spark, d).groupBy("variant", "model").agg(F.avg("mae").alias("MAE"), F.avg("rmse").alias("RMSE"), C.corr("mae", "rmse").alias("Corr"), F.avg("ssim").alias("ssim"))


@query(f"WITH {MEANS} SELECT *, row_number() OVER (PARTITION BY variant ORDER BY RMSE, MAE, Corr DESC, model) AS rank FROM agg", "MAE RMSE Corr ssim")
def rank_narrative(spark, d):
    """W2, in the narrative's order."""
    return report.rank_models(means(spark, d), ["variant"], "narrative")


@query(f"WITH {MEANS} SELECT *, row_number() OVER (PARTITION BY variant ORDER BY MAE, model) AS rank FROM agg", "MAE RMSE Corr ssim")
def rank_ablation(spark, d):
    return report.rank_models(means(spark, d), ["variant"], "ablation")


@query(f"WITH {MEANS} SELECT *, row_number() OVER (PARTITION BY variant ORDER BY Corr DESC, MAE, model) AS rank FROM agg", "MAE RMSE Corr ssim")
def rank_consolidated(spark, d):
    return report.rank_models(means(spark, d), ["variant"], "consolidated")


@query(f"WITH {MEANS}, a AS (SELECT model, row_number() OVER (ORDER BY MAE, model) AS rank_a FROM agg WHERE variant = 'F'), b AS (SELECT model, row_number() OVER (ORDER BY MAE, model) AS rank_b FROM agg WHERE variant = 'O' AND model <> '1-URGENT') SELECT coalesce(a.model, b.model) AS model, rank_a, rank_b, rank_b - rank_a AS delta_rank FROM a FULL JOIN b ON a.model = b.model")
def rank_stability(spark, d):
    """J11."""
    ranked = lambda rows: report.rank_models(rows, ["variant"], "ablation")
    m = means(spark, d)
    return report.rank_stability(ranked(m.where("variant = 'F'")), ranked(m.where("variant = 'O' and model <> '1-URGENT'")), ["model"])


@query(f"WITH {PAIRS}, a AS (SELECT segment, model, {measures('pred_c', 'obs_c')} FROM pairs WHERE time < TIMESTAMP '1999-01-01' GROUP BY 1, 2), b AS (SELECT segment, model, {measures('pred_c', 'obs_c')} FROM pairs WHERE time >= TIMESTAMP '1999-01-01' GROUP BY 1, 2) SELECT b.segment, b.model, b.RMSE - a.RMSE AS delta_RMSE, b.MAE - a.MAE AS delta_MAE, b.Corr - a.Corr AS delta_Corr FROM b JOIN a ON a.segment = b.segment AND a.model = b.model", "delta_RMSE delta_MAE delta_Corr")
def compare_protocols(spark, d):
    """J12."""
    p = pairs(spark, d)
    of = lambda rows: verify.verify(rows, "pred_c", "obs_c", ["segment", "model"])
    return report.compare_protocols(of(p.where("time < '1999-01-01'")), of(p.where("time >= '1999-01-01'"))).select("segment", "model", "delta_RMSE", "delta_MAE", "delta_Corr")


BY_MODEL = RUNS + ", agg AS (SELECT model, avg(mae) AS mae, avg(rmse) AS rmse, avg(ssim) AS ssim FROM raw GROUP BY 1)"


def by_model(spark, d):
    return runs(spark, d).groupBy("model").agg(F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"), F.avg("ssim").alias("ssim"))


@query(f"WITH {BY_MODEL} SELECT a.model, b.mae - a.mae AS delta_mae, b.rmse - a.rmse AS delta_rmse, a.ssim - b.ssim AS delta_ssim FROM agg a, agg b WHERE b.model = '5-LOW'", "delta_mae delta_rmse delta_ssim")
def delta_vs_baseline(spark, d):
    """J14."""
    return report.delta_vs_baseline(by_model(spark, d), "5-LOW").select("model", "delta_mae", "delta_rmse", "delta_ssim")


@query(f"WITH {BY_MODEL}, p(run_a, run_b) AS (VALUES ('1-URGENT', '2-HIGH'), ('3-MEDIUM', '5-LOW')) SELECT run_a, run_b, b.rmse - a.rmse AS delta_rmse, b.mae - a.mae AS delta_mae, b.ssim - a.ssim AS delta_ssim FROM p JOIN agg a ON a.model = run_a JOIN agg b ON b.model = run_b", "delta_rmse delta_mae delta_ssim")
def pair_compare(spark, d):
    """J16."""
    return report.pair_compare(by_model(spark, d), [("1-URGENT", "2-HIGH"), ("3-MEDIUM", "5-LOW")], ["rmse", "mae", "ssim"])


@query(f"WITH {MEANS}, r AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY MAE, model) AS rank FROM agg) SELECT variant, model, MAE, rank, CAST(NULL AS DOUBLE) AS Corr, 'exp2' AS section FROM r WHERE variant = 'F' UNION ALL SELECT variant, model, MAE, CAST(NULL AS BIGINT), Corr, 'cs1' FROM r WHERE variant = 'O'", "MAE Corr")
def consolidate_sections(spark, d):
    """U1, U4."""
    r = report.rank_models(means(spark, d), ["variant"], "ablation")
    return report.consolidate_sections({"exp2": r.where("variant = 'F'").select("variant", "model", "MAE", "rank"), "cs1": r.where("variant = 'O'").select("variant", "model", "MAE", "Corr")})


@query(f"WITH {RUNS} SELECT 'seq_len' AS missing, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_not_finite, false AS passed FROM raw")
def check_artifact(spark, d):
    """A41."""
    return report.check_artifact(runs(spark, d), ["model", "mae", "seq_len"], ["mae", "rmse", "seq_len"], 10)


ROB = "rob AS (SELECT o_orderpriority AS model, CASE o_orderstatus WHEN 'F' THEN 0.1 WHEN 'O' THEN 0.5 ELSE 1.0 END AS eps, o_totalprice / 1e6 AS dev FROM orders), c AS (SELECT model, CAST(eps AS DOUBLE) AS \"epsilon_K\", avg(dev) AS mean_dev, stddev_pop(dev) AS std_dev FROM rob GROUP BY 1, 2)"


@query(f'WITH {ROB} SELECT *, row_number() OVER (PARTITION BY "epsilon_K" ORDER BY mean_dev, model) AS rank FROM c', "mean_dev std_dev")
def robustness_curve(spark, d):
    """A42."""
    status = F.col("o_orderstatus")
    eps = F.when(status == "F", 0.1).when(status == "O", 0.5).otherwise(1.0)
    return report.robustness_curve(table(spark, d, "orders").select(F.col("o_orderpriority").alias("model"), eps.alias("epsilon_K"), (F.col("o_totalprice") / 1e6).alias("mean_abs_dev")))


@query(f"WITH {PAIRS}, m AS (SELECT station_id, avg(CASE WHEN model = 'F' THEN abs(pred_c - obs_c) END) AS \"F\", avg(CASE WHEN model = 'O' THEN abs(pred_c - obs_c) END) AS \"O\" FROM pairs GROUP BY 1) SELECT *, row_number() OVER (ORDER BY \"F\" NULLS LAST, station_id) AS \"order\" FROM m", "F O")
def station_model_matrix(spark, d):
    """A43, with exact means: stations with equal ones are in order of their names."""
    return report.station_model_matrix(verify.verify(pairs(spark, d), "pred_c", "obs_c", ["station_id", "model"], C.exact_mean), ["F", "O"], "F")


@query(f"WITH {RUNS} SELECT model, time, avg(mae) AS mae, avg(rmse) AS rmse FROM raw GROUP BY 1, 2", "mae rmse")
def metric_by_model_time(spark, d):
    """A45."""
    return report.metric_by_model_time(runs(spark, d), ["mae", "rmse"])


@query(f"WITH {RUNS} SELECT time, avg(CASE WHEN model = '1-URGENT' THEN mae END) AS \"1-URGENT\", avg(CASE WHEN model = '5-LOW' THEN mae END) AS \"5-LOW\" FROM raw GROUP BY 1", "1-URGENT 5-LOW")
def metric_pivot(spark, d):
    return report.pivot_by_time(report.metric_by_model_time(runs(spark, d), ["mae"]), "mae", ["1-URGENT", "5-LOW"])


@query(f"WITH {RUNS} SELECT model, variant, mae FROM (SELECT *, CASE WHEN variant = 'P' THEN 'NaN'::DOUBLE ELSE mae END AS m FROM raw) WHERE NOT isnan(m)", "mae")
def finite_metrics(spark, d):
    """P8."""
    rows = runs(spark, d).withColumn("mae", F.when(F.col("variant") == "P", float("nan")).otherwise(F.col("mae")))
    return clean.finite_metrics(rows).select("model", "variant", "mae")


@query("SELECT CASE WHEN lower(trim(e)) = 'convlstm' THEN 'lstm' ELSE lower(trim(e)) END AS model, e || CASE WHEN k % 2 = 0 THEN '_T' || CAST(k % 12 AS VARCHAR) ELSE '' END AS variant, k FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN ' ConvLSTM' ELSE o_orderpriority END AS e, o_orderkey AS k FROM orders)")
def label_model(spark, d):
    """P11."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.when(k % 3 == 0, " ConvLSTM").otherwise(F.col("o_orderpriority")).alias("e"), k.alias("k"))
    return rows.select(C.label_model(F.col("e")).alias("model"), C.label_variant(F.col("e"), F.when(F.col("k") % 2 == 0, F.col("k") % 12)).alias("variant"), "k")
