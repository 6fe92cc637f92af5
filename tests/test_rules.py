"""Hand-derived expectations for rules where both engines could share a mistake."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from rigsense import schema as S
from rigsense.operators import alerts, evaluate, features, kpi, policy, quality, scoring, settings, tables, urls
from rigsense.sources import payloads

NOON = datetime(2026, 4, 7, 12)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


# --- cleaning
def test_codes_stay_text_and_blank_ids_go(spark):
    raw = spark.createDataFrame(
        [("2026-04-07T12:00:00Z", "m-1", '["OVERTEMP","HASH_DROP"]', "3000", 0), ("2026-04-07T12:00:00Z", " ", None, "1", 1),
         ("bad", "m-2", None, "1", 2), ("2026-04-07T12:00:00Z", "m-1", "later copy", "9", 3)],
        "timestamp string, miner_id string, event_codes string, asic_power_w string, pos int")
    row = one(quality.clean_upload(raw, ["pos"]))
    assert row["event_codes"] == '["OVERTEMP","HASH_DROP"]' and row["asic_power_w"] == 3000.0
    assert row["operating_mode"] == "normal" and row["timestamp"] == NOON


def test_missing_stays_missing_when_clamped(spark):
    df = spark.createDataFrame([(None, 3000.0), (100.0, None)], "asic_hashrate_ths double, asic_power_w double")
    rows = quality.clip_ranges(df).collect()
    assert rows[0]["asic_hashrate_ths"] is None and rows[1]["asic_power_w"] is None


def test_te_is_missing_when_cooling_is(spark):
    df = spark.createDataFrame(
        [("eco", 3000.0, None, 100.0, 12.5, 25.0)],
        "operating_mode string, asic_power_w double, cooling_power_w double, asic_hashrate_ths double, asic_voltage_v double, ambient_temperature_c double")
    assert one(kpi.true_efficiency_columns(df))["true_efficiency_te"] is None


def test_fill_goes_forward_then_back_then_median(spark):
    df = spark.createDataFrame(
        [("a", 1, None), ("a", 2, 4.0), ("a", 3, None), ("b", 1, None), ("c", 1, 10.0)], "miner_id string, timestamp int, asic_power_w double")
    got = {(r[0], r[1]): r[2] for r in quality.impute(df, ["asic_power_w"], split=False).collect()}
    assert got == {("a", 1): 4.0, ("a", 2): 4.0, ("a", 3): 4.0, ("b", 1): 4.0, ("c", 1): 10.0}


def test_schema_check(spark):
    df = spark.createDataFrame([(1, 2)], "miner_id int, extra int")
    got = {(r["issue"], r["column"]) for r in quality.schema_check(df).collect()}
    assert ("extra", "extra") in got and ("missing", "timestamp") in got
    with pytest.raises(ValueError):
        quality.require_schema(df)


def test_polled_records_skip_bad_rows(spark):
    body = ('[{"miner_id":"  ","timestamp":"2026-04-07T12:00:00Z"},{"miner_id":"m-20","timestamp":"bad-ts"},'
            '{"miner_id":"m-21","timestamp":"2026-04-07T12:05:00Z","event_codes":"  ","operating_mode":" normal ","read_errors":"5","bad_hash_count":"oops","chip_temp_max":"NaN"}]')
    df = spark.createDataFrame([("mock", body)], "source_name string, body string")
    maps = spark.createDataFrame([("mock", {})], "source_name string, field_mapping map<string,string>")
    row = one(payloads.polled_records(df, maps))
    assert (row["miner_id"], row["operating_mode"], row["event_codes"], row["source"]) == ("m-21", "normal", None, "api:mock")
    assert row["read_errors"] == 5 and row["bad_hash_count"] is None and row["chip_temp_max"] is None


def test_polled_records_send_the_mappings(spark, monkeypatch):
    df = spark.range(40).selectExpr("id", "concat('s', id % 3) AS source_name", """concat('{"miner_id":"a","worker":"b","timestamp":"2024-01-01T00:00:00"}') AS body""")
    maps = spark.createDataFrame([("s0", {"miner_id": "worker"}), ("s1", None)], "source_name string, field_mapping map<string,string>")
    maps = maps.join(spark.range(1), how="cross").select(*maps.columns)  # of no size that Spark knows
    make = lambda: payloads.polled_records(df, maps)
    plan = lambda found: found._jdf.queryExecution().optimizedPlan().toString()
    sent, shuffled = make(), None
    assert "broadcast" in plan(sent)
    monkeypatch.setattr(payloads, "SENT_SOURCES", 1)
    shuffled = make()
    assert "broadcast" not in plan(shuffled)
    assert sorted(sent.select("id", "miner_id").collect()) == sorted(shuffled.select("id", "miner_id").collect())
    assert {(r["id"] % 3, r["miner_id"]) for r in sent.collect()} == {(0, "b"), (1, "a"), (2, "a")}


def test_payload_has_nulls_but_no_nan(spark):
    df = spark.createDataFrame([("m-1", float("nan"))], "miner_id string, asic_voltage_v double")
    text = one(payloads.rows_to_payload(df, {"miner_id": "string", "asic_voltage_v": "double", "read_errors": "int"}))["payload"]
    assert text == '{"miner_id":"m-1","asic_voltage_v":null,"read_errors":null}'


# --- features
def test_snapshot_has_one_row_per_device_and_all_columns(spark):
    df = spark.createDataFrame(
        [("m-1", datetime(2026, 4, 7, 10), 70.0, 90.0), ("m-1", datetime(2026, 4, 7, 10, 10), 72.0, 95.0), ("m-2", datetime(2026, 4, 7, 10), 60.0, 120.0)],
        "miner_id string, timestamp timestamp, asic_temperature_c double, asic_hashrate_ths double")
    rows = {r["miner_id"]: r for r in features.serving_snapshot(df).collect()}
    assert set(rows) == {"m-1", "m-2"} and rows["m-1"]["asic_temperature_c"] == 72.0
    assert rows["m-1"]["temp_delta_10m"] == 2.0 and rows["m-1"]["temp_roll_mean_1h"] == 71.0
    assert set(S.NUMERIC_FEATURES) <= set(rows["m-1"].asDict())


def test_peers_in_the_same_hour_and_mode_deviate(spark):
    df = spark.createDataFrame(
        [("a", datetime(2026, 4, 7, 10), 100.0), ("b", datetime(2026, 4, 7, 10, 30), 50.0), ("c", datetime(2026, 4, 7, 15), 60.0)],
        "miner_id string, timestamp timestamp, asic_hashrate_ths double")
    got = {r["miner_id"]: r["mode_peer_hashrate_dev_pct"] for r in features.peer_features(features.ensure_inputs(df)).collect()}
    assert got["a"] == pytest.approx(100 / 3) and got["b"] == pytest.approx(-100 / 3)
    assert got["c"] == pytest.approx((60 - 70) / 70 * 100)  # alone in its hour: compared with its mode


def test_label_excludes_the_current_row(spark):
    df = spark.createDataFrame([("a", i, i, int(i == 3)) for i in range(6)], "miner_id string, timestamp int, id int, failure_event int")
    got = [r[S.TARGET] for r in features.future_failure_label(df, horizon_hours=1 / 3, split=False).orderBy("id").collect()]
    assert got == [0, 1, 1, 0, 0, 0]


# --- evaluation
SCORES = [(0.9, 1), (0.8, 0), (0.8, 1), (0.6, 1), (0.3, 0), (0.2, 0)]


def test_curves_by_hand(spark):
    df = spark.createDataFrame(SCORES, "risk_score double, failure_within_horizon int")
    # Descending points (tp, fp): (1,0) (2,1) (3,1) (3,2) (3,3)
    area = one(evaluate.areas(df))
    assert area["roc_auc"] == pytest.approx((1 * (1 + 2) / 2 + 3 + 3) / 9)
    pr = [(0, 1.0), (1 / 3, 1.0), (2 / 3, 2 / 3), (1.0, 0.75), (1.0, 0.6), (1.0, 0.5)]
    assert area["pr_auc"] == pytest.approx(sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(pr, pr[1:])))
    best = one(evaluate.optimal_threshold(df))
    assert best["threshold"] == 0.6 and best["f1"] == pytest.approx(6 / 7)
    assert one(evaluate.optimal_threshold(df, shifted=True))["threshold"] == 0.3


def test_one_class_has_no_roc(spark):
    df = spark.createDataFrame([(0.5, 0), (0.7, 0)], "risk_score double, failure_within_horizon int")
    assert one(evaluate.roc_auc(df))["roc_auc"] is None


def test_reported_confusion_reproduces_reported_metrics(spark):
    df = spark.createDataFrame([(1358, 2650, 23124, 1860)], "tp long, fp long, tn long, fn long")
    row = one(evaluate.with_metrics(df))
    assert round(row["precision"], 4) == 0.3388 and round(row["recall"], 4) == 0.4220


def test_bands_differ_between_callers(spark):
    df = spark.createDataFrame([(0.32,), (0.52,), (0.75,)], "s double")
    rows = df.select(scoring.risk_band(F.col("s")), scoring.risk_band(F.col("s"), S.BANDS_WORKER)).collect()
    assert [tuple(r) for r in rows] == [("low", "medium"), ("medium", "high"), ("critical", "critical")]


# --- policy
def _row(spark, **kw):
    base = {"timestamp": datetime(2026, 4, 7, 18), "risk_score": 0.68, "asic_power_w": 3200.0, "asic_hashrate_ths": 110.0,
            "asic_temperature_c": 88.0, "event_codes": ""} | kw
    return spark.createDataFrame([tuple(base.values())], "timestamp timestamp, risk_score double, asic_power_w double, asic_hashrate_ths double, asic_temperature_c double, event_codes string")


def _config(spark, **kw):
    return policy.policy_config(spark.createDataFrame([tuple(kw.values())], ", ".join(f"{k} string" for k in kw)))


def test_curtailment_penalty(spark):
    cfg = _config(spark, energy_price_usd_per_kwh="0.10", energy_price_schedule_json='{"18": 0.25}',
                  curtailment_windows_json='[{"start_hour":17,"end_hour":21}]', policy_timezone="UTC")
    row = one(policy.energy_price(policy.with_config(_row(spark), cfg)))
    assert row["in_curtailment_window"] and row["energy_price"] == pytest.approx(0.5)


def test_zero_length_window_is_dropped(spark):
    cfg = _config(spark, curtailment_windows_json='[{"start_hour":5,"end_hour":5}]')
    assert not one(policy.energy_price(policy.with_config(_row(spark, timestamp=datetime(2026, 4, 7, 5)), cfg)))["in_curtailment_window"]


def test_window_over_midnight_in_local_time(spark):
    cfg = _config(spark, curtailment_windows_json='[{"start_hour":22,"end_hour":2}]', policy_timezone="Europe/Berlin")
    got = [one(policy.energy_price(policy.with_config(_row(spark, timestamp=datetime(2026, 4, 7, h)), cfg)))["in_curtailment_window"]
           for h in (19, 20, 23, 0)]
    assert got == [False, True, True, False]  # 21:00, 22:00, 01:00 and 02:00 local


def test_reward_comes_from_the_hashprice(spark):
    assert one(_config(spark, hashprice_usd_per_ph_day="55"))["reward_per_th_hour_usd"] == pytest.approx(55 / 1000 / 24)


def test_utility_by_hand(spark):
    terms = {r["action"]: r for r in policy.action_table(_row(spark), ["risk_score"]).collect()}
    keep = terms["CONTINUE"]
    revenue = 55 * 1000 / (24 * 3200 / 110) * (3200 / 1e6)
    cost = 3200 / 1e6 * (80 + 8 + 20)
    assert keep["utility_usd"] == pytest.approx(revenue - cost - 0.68 * 300 / 24)
    assert not terms["REBOOT"]["is_allowed"] and terms["DOWNCLOCK"]["is_allowed"]


@pytest.mark.parametrize("kw,action", [
    ({"risk_score": 0.98}, "PULL_FOR_MAINTENANCE"), ({"asic_temperature_c": 103.0}, "PULL_FOR_MAINTENANCE"),
    ({"risk_score": float("nan"), "asic_temperature_c": 60.0}, "CONTINUE"), ({"risk_score": None, "asic_temperature_c": 60.0}, "CONTINUE"),
])
def test_best_action(spark, kw, action):
    assert one(policy.optimized(_row(spark, **kw)))["optimized_action"] == action


def test_optimized_never_loses_to_an_allowed_baseline(spark, sf_dir):
    from rigsense.sources import views

    d = policy.decisions(views.risk(spark, sf_dir))
    table = policy.action_table(views.risk(spark, sf_dir), ["id"]).filter("is_allowed").select("id", F.col("action").alias("baseline_action"))
    bad = d.join(table, ["id", "baseline_action"]).filter("optimized_utility_usd < baseline_utility_usd - 1e-9")
    assert bad.isEmpty()


def test_backtest_shape(spark):
    rows = _row(spark, risk_score=0.81).unionByName(_row(spark, risk_score=0.42, asic_power_w=2100.0))
    got = one(policy.backtest(rows))
    assert got["samples"] == 2 and got["baseline_reboot"] == 1 and got["baseline_watchlist"] == 1
    empty = one(policy.backtest(rows.filter("risk_score < 0")))
    assert empty["samples"] == 0 and empty["passed"] and empty["total_uplift_usd"] == 0.0


def test_policy_needs_no_shuffle(spark, sf_dir):
    from rigsense.sources import views

    plan = policy.optimized(views.risk(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("Subquery")[0]


# --- settings, urls, alerts, tables
def test_settings_rules(spark):
    rows = [("risk_threshold", "2"), ("retrain_days", " 30.9 "), ("policy_optimizer_enabled", "YES"), ("nope", "1"),
            ("curtailment_windows_json", "{}"), ("energy_price_schedule_json", ""), ("smtp_port", "x"), ("opex_usd_per_mwh", "nan")]
    got = {r["key"]: (r["clean_value"], r["error"]) for r in settings.validate_settings(spark.createDataFrame(rows, "key string, value string")).collect()}
    assert got["risk_threshold"][1] == "Value for 'risk_threshold' must be between 0.05 and 0.99"
    assert got["retrain_days"] == ("30", None) and got["policy_optimizer_enabled"] == ("yes", None)
    assert got["nope"][1] == "Unsupported setting key 'nope'" and got["smtp_port"][1] == "Invalid integer for 'smtp_port'"
    assert got["curtailment_windows_json"][1].endswith("must be a JSON array") and got["energy_price_schedule_json"] == ("{}", None)


def test_url_rules(spark):
    cases = {
        "https://api.example.com/x": "", "http://evil.org/": "Source hostname is not in the source allowlist",
        "ftp://api.example.com": "Only http/https source URLs are allowed", "http://localhost/": "Source hostname is blocked; Source hostname is not in the source allowlist",
        "http://169.254.169.254/latest": "Source hostname is not in the source allowlist; Source hostname is a blocked address",
        "http://[::1]:9/": "Source hostname is not in the source allowlist; Source hostname is a blocked address",
        "not a url": "Only http/https source URLs are allowed; Source URL must include a hostname",
        "http://user:pw@API.example.com:81/": "", "http://notexample.com": "Source hostname is not in the source allowlist",
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    got = {r["url"]: "; ".join(r["errors"]) for r in urls.source_url_audit(df, ["*.example.com"]).collect()}
    assert got == cases
    assert "cannot include wildcard" in one(urls.source_url_audit(df.limit(1), ["*"]))["errors"][0]
    assert "disabled" in one(urls.source_url_audit(df.limit(1), []))["errors"][0]


def test_outbox_respects_sent_flags_and_escapes(spark):
    df = spark.createDataFrame(
        [(1, NOON, "m<1>", "critical", 0.9, "<b>&\"'", False, True, False)],
        "id int, created_at timestamp, miner_id string, severity string, risk_score double, message string, resolved boolean, email_sent boolean, telegram_sent boolean")
    row = one(alerts.alert_outbox(df))
    assert row["channel"] == "telegram" and "m&lt;1&gt;" in row["body"] and "&lt;b&gt;&amp;&quot;&#x27;" in row["body"] and "90.00%" in row["body"]


def test_insert_twice_changes_nothing(spark):
    base = spark.createDataFrame([("a", 1, 1.0)], "miner_id string, timestamp int, v double")
    batch = spark.createDataFrame([("a", 1, 9.0), ("b", 1, 2.0)], "miner_id string, timestamp int, v double")
    once = tables.insert_if_absent(base, batch, order=["v"])
    twice = tables.insert_if_absent(once, batch, order=["v"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("a", 1, 1.0), ("b", 1, 2.0)]


def test_retrain_guard_reasons(spark):
    from rigsense.plans.training import retrain_guard

    df = spark.createDataFrame([(f"m-{i % 4}", datetime(2026, 4, 1 + i % 5)) for i in range(40)], "miner_id string, timestamp timestamp")
    reason = lambda **kw: one(retrain_guard(df, NOON, 30, **kw))["reason"]
    assert reason() == "not_enough_rows" and reason(min_rows=10) == "not_enough_miners"
    assert reason(min_rows=10, min_devices=3, min_hours=200.0) == "time_span_too_short" and reason(min_rows=10, min_devices=3) == "ok"


def test_every_form_of_a_local_address_is_blocked(spark):
    from rigsense.operators.urls import source_url_audit

    bad = ["[::ffff:127.0.0.1]", "[::ffff:7f00:1]", "[0:0:0:0:0:ffff:10.0.0.1]", "2130706433", "127.1", "0x7f.0.0.1", "0177.0.0.1", "127.0.0.1.", "10.1.2.3"]
    good = ["8.8.8.8", "[::ffff:8.8.8.8]", "134744072", "example.com", "1.2.3.4.5", "256.1.1.1"]
    hosts = [h.strip("[]") for h in bad + good]
    df = spark.createDataFrame([(f"http://{h}/",) for h in bad + good], "url string")
    got = {r["url"]: r["valid"] for r in source_url_audit(df, hosts).collect()}
    assert [h for h in bad if got[f"http://{h}/"]] == [] and all(got[f"http://{h}/"] for h in good)


def test_zones_and_broken_lists(spark):
    from pyspark.sql import functions as F

    from rigsense.functions.exprs import known_zone
    from rigsense.operators import policy

    zones = spark.createDataFrame([("Europe/Berlin",), ("Mars/Base",), ("ABCD",), ("EST5EDT",)], "z string")
    assert [r[0] for r in zones.select(known_zone(F.col("z"))).collect()] == [True, False, False, True]
    text = spark.createDataFrame([('[{"hour":4,"price":"x"},null,5,{"hour":6,"price":0.5}]', '[7,{"start_hour":1,"end_hour":2}]')], "a string, b string")
    row = text.select(policy.price_schedule(F.col("a")).alias("a"), policy.curtailment_windows(F.col("b")).alias("b")).first()
    assert row["a"] == {4: 0.0, 6: 0.5} and [tuple(w) for w in row["b"]] == [(1, 2)]


def test_narrow_columns_correlate(spark):
    from rigsense.operators.analytics import pair_correlations, tradeoff_points

    df = spark.range(2000).selectExpr("3000 + (id % 7) * 1e-6 AS a", "CAST(id % 7 AS DOUBLE) AS b", "5.1D AS c")
    got = {(r["a"], r["b"]): r["r"] for r in pair_correlations(df, ["a", "b", "c"]).collect()}
    assert abs(got["a", "b"] - 1) < 1e-5 and max(abs(x) for x in got.values() if x is not None) <= 1
    assert got.get(("a", "c")) is None
    with pytest.raises(ValueError):
        tradeoff_points(df, 5001)


def test_nan_is_missing_in_correlations(spark):
    from rigsense.operators.analytics import pair_correlations

    nan, inf = float("nan"), float("inf")
    rows = [(1.0, 2.0, 1.0, nan), (2.0, 4.5, inf, nan), (nan, 9.0, 2.0, nan), (None, 1.0, 3.0, nan), (4.0, 7.0, 5.0, None), (6.0, nan, 1.0, nan)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = {(r["a"], r["b"]): r["r"] for r in pair_correlations(df, ["a", "b", "c", "d"]).collect()}
    assert got["a", "b"] == pytest.approx(np.corrcoef([1, 2, 4], [2, 4.5, 7])[0, 1])
    assert got["a", "a"] == pytest.approx(1) and got["b", "b"] == pytest.approx(1)
    assert all(got.get((x, "c")) is None for x in "abc") and all(got.get((x, "d")) is None for x in "abcd")
