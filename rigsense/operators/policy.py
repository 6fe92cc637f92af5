"""Economic choice of a maintenance action per device, as column expressions.

Settings travel as one struct column ``cfg`` on each row, so the same operators serve one
global configuration (attached as a scalar) and one configuration per site (joined).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigsense import schema as S
from rigsense.functions.exprs import lit_d, ratio, to_number, known_zone
from rigsense.operators.scale import attach_row

# fixed values: policy defaults
HASHPRICE, PENALTY, FAILURE_COST = 55.0, 2.0, 300.0
NUMBERS = {  # setting -> (config field, default, floor)
    "policy_min_uplift_usd_per_miner": ("min_uplift_usd_per_miner", 0.25, None),
    "energy_price_usd_per_kwh": ("energy_price_usd_per_kwh", 0.08, 0.0),
    "hashprice_usd_per_ph_day": ("hashprice_usd_per_ph_day", HASHPRICE, 0.0),
    "opex_usd_per_mwh": ("opex_usd_per_mwh", 8.0, 0.0),
    "capex_usd_per_mwh": ("capex_usd_per_mwh", 20.0, 0.0),
    "curtailment_penalty_multiplier": ("curtailment_penalty_multiplier", PENALTY, 1.0),
    "policy_failure_cost_usd": ("failure_cost_usd", FAILURE_COST, 0.0),
    "policy_horizon_hours": ("horizon_hours", 1.0, 0.25),
    "risk_probability_horizon_hours": ("risk_probability_horizon_hours", 24.0, 1.0),
}
POLICY_SETTINGS = [
    "policy_optimizer_enabled", "automation_require_policy_backtest", *NUMBERS,
    "policy_reward_per_th_hour_usd", "energy_price_schedule_json", "curtailment_windows_json",
    "policy_timezone",
]


def truthy(c: Column, default: bool = False) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin(S.TRUTHY), F.lit(default))


def _hour(text: Column) -> Column:
    return F.trim(text).try_cast("int")


def _elements(text: Column, fields: str) -> Column:
    """The elements of a JSON list, each decoded on its own, so that a bad one loses itself only."""
    return F.transform(F.from_json(text, "array<string>"), lambda e: F.from_json(e, fields))


def price_schedule(text: Column) -> Column:
    """JSON {hour: price} or [{hour, price}] to a map; entries with a bad hour are skipped.

    A price that is no number counts as 0 and negative prices are raised to 0.
    """
    as_map = F.from_json(text, "map<string,string>")
    as_list = _elements(text, "hour string, price string")
    pairs = F.when(
        F.trim(text).startswith("["),
        F.transform(as_list, lambda e: F.struct(
            F.coalesce(to_number(e["hour"]).cast("int"), F.lit(-1)).alias("h"), e["price"].alias("p"))),
    ).otherwise(F.transform(F.map_entries(as_map), lambda e: F.struct(
        F.coalesce(_hour(e["key"]), F.lit(-1)).alias("h"), e["value"].alias("p"))))
    good = F.filter(pairs, lambda e: e["h"].between(0, 23))
    entries = F.transform(good, lambda e: F.struct(
        e["h"].alias("key"), F.greatest(F.coalesce(to_number(e["p"]), lit_d(0.0)), lit_d(0.0)).alias("value")))
    # On a repeated hour the last entry wins.
    last = F.filter(
        F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("value"), i.alias("i"))),
        lambda e: ~F.exists(
            F.slice(entries, e["i"] + F.lit(2), F.greatest(F.size(entries) - e["i"] - F.lit(1), F.lit(0))),
            lambda later: later["key"] == e["key"]),
    )
    clean = F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))
    return F.coalesce(clean, F.expr("cast(map() as map<int,double>)"))


def curtailment_windows(text: Column) -> Column:
    """JSON [{start_hour, end_hour}] to an array; empty and out-of-range windows are dropped."""
    raw = _elements(text, "start_hour string, end_hour string")
    typed = F.transform(raw, lambda w: F.struct(
        F.coalesce(to_number(w["start_hour"]).cast("int"), F.lit(-1)).alias("start_hour"),
        F.coalesce(to_number(w["end_hour"]).cast("int"), F.lit(-1)).alias("end_hour")))
    good = F.filter(typed, lambda w: w["start_hour"].between(0, 23) & w["end_hour"].between(0, 23)
                    & (w["start_hour"] != w["end_hour"]))
    return F.coalesce(good, F.expr("cast(array() as array<struct<start_hour:int,end_hour:int>>)"))


def policy_config(settings: DataFrame) -> DataFrame:
    """Normalize wide settings (one text column per key, any of them absent) row by row."""
    def raw(key: str) -> Column:
        return F.col(key).cast("string") if key in settings.columns else F.lit(None).cast("string")

    fields = {
        "optimizer_enabled": F.when(raw("policy_optimizer_enabled").isNull(), F.lit(True)).otherwise(
            truthy(raw("policy_optimizer_enabled"))),
        "require_backtest": F.when(raw("automation_require_policy_backtest").isNull(), F.lit(True)).otherwise(
            truthy(raw("automation_require_policy_backtest"))),
    }
    for key, (name, default, floor) in NUMBERS.items():
        value = F.coalesce(to_number(raw(key)), lit_d(default))
        fields[name] = value if floor is None else F.greatest(value, lit_d(floor))
    by_price = fields["hashprice_usd_per_ph_day"] / lit_d(1000.0) / lit_d(24.0)
    reward = raw("policy_reward_per_th_hour_usd")
    fields["reward_per_th_hour_usd"] = F.when(
        F.coalesce(F.trim(reward), F.lit("")) == "", by_price
    ).otherwise(F.greatest(F.coalesce(to_number(reward), by_price), lit_d(0.0)))
    fields["energy_price_schedule"] = price_schedule(raw("energy_price_schedule_json"))
    fields["curtailment_windows"] = curtailment_windows(raw("curtailment_windows_json"))
    fields["timezone"] = F.coalesce(F.nullif(F.trim(raw("policy_timezone")), F.lit("")), F.lit("UTC"))
    keep = [c for c in settings.columns if c not in POLICY_SETTINGS]
    return settings.select(*keep, *[v.alias(k) for k, v in fields.items()])


def default_config(df: DataFrame) -> DataFrame:
    """The configuration with every setting at its default, as one row."""
    return policy_config(df.sparkSession.range(1).select(F.lit(None).cast("string").alias("policy_timezone")))


def with_config(df: DataFrame, config: DataFrame | None = None) -> DataFrame:
    """Attach one global configuration row as the struct column ``cfg``."""
    out, row = attach_row(df, default_config(df) if config is None else config)
    return out.withColumn("cfg", row).select(*df.columns, "cfg")


# --------------------------------------------------------------------------- row expressions
def _field(df: DataFrame, name: str, type_: str = "double") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(type_)


INPUTS = ["_score", "_temp", "_power", "_rate", "_overtemp"]
WORK = [*INPUTS, "_risk", "_all_in", "_failure_usd"]


def _clean_inputs(df: DataFrame) -> DataFrame:
    """Cleaned inputs as columns, computed once per row. A missing or undefined score is 0."""
    def number(name: str, default: float, lo: float | None = None, hi: float | None = None) -> Column:
        x = F.coalesce(F.nanvl(_field(df, name).cast("double"), F.lit(None).cast("double")), lit_d(default))
        x = x if hi is None else F.least(x, lit_d(hi))
        return x if lo is None else F.greatest(x, lit_d(lo))

    return df.withColumns({
        "_score": number("risk_score", 0.0, 0.0, 1.0),
        "_temp": number("asic_temperature_c", 75.0),
        "_power": number("asic_power_w", 0.0, 0.0),
        "_rate": number("asic_hashrate_ths", 0.0, 0.0),
        "_overtemp": F.upper(F.coalesce(_field(df, "event_codes", "string"), F.lit(""))).contains("OVERTEMP"),
    })


def energy_price(df: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """Price at the row's local hour, times the penalty inside a curtailment window; an unknown zone counts as UTC."""
    cfg = F.col("cfg")
    at = _field(df, "timestamp", "timestamp")
    if as_of is not None:
        at = F.coalesce(at, F.lit(as_of))
    timed = df.withColumn("local_hour", F.hour(F.from_utc_timestamp(at, F.when(known_zone(cfg["timezone"]), cfg["timezone"]).otherwise("UTC"))))
    hour = F.col("local_hour")
    inside = F.exists(cfg["curtailment_windows"], lambda w: F.when(
        w["start_hour"] < w["end_hour"], (hour >= w["start_hour"]) & (hour < w["end_hour"])
    ).otherwise((hour >= w["start_hour"]) | (hour < w["end_hour"])))
    timed = timed.withColumn("in_curtailment_window", F.coalesce(inside, F.lit(False)))
    base = F.coalesce(F.try_element_at(cfg["energy_price_schedule"], hour), cfg["energy_price_usd_per_kwh"])
    penalty = F.when(F.col("in_curtailment_window"), cfg["curtailment_penalty_multiplier"]).otherwise(lit_d(1.0))
    return timed.withColumn("energy_price", F.greatest(base * penalty, lit_d(0.0)))


def _baseline_columns() -> dict[str, Column]:
    s, hot = F.col("_score"), F.col("_overtemp")
    ladder = [
        ((s >= lit_d(0.85)) | hot, "PULL_FOR_MAINTENANCE", "baseline_critical_risk_or_overtemp"),
        (s >= lit_d(0.75), "REBOOT", "baseline_high_risk"),
        (s >= lit_d(0.60), "DOWNCLOCK", "baseline_medium_high_risk"),
        (s >= lit_d(0.35), "WATCHLIST", "baseline_watchlist"),
    ]
    action, reason = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for test, a, r in ladder:
        action, reason = action.when(test, F.lit(a)), reason.when(test, F.lit(r))
    return {"baseline_action": action.otherwise(F.lit("CONTINUE")), "baseline_reason": reason.otherwise(F.lit("baseline_default"))}


def baseline(df: DataFrame) -> DataFrame:
    """The threshold-only policy."""
    out = _clean_inputs(df).withColumns(_baseline_columns()).drop(*INPUTS)
    return out.withColumn("baseline_automation", F.col("baseline_action").isin("DOWNCLOCK", "REBOOT"))


def _priced(df: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """Everything about a row that does not depend on the action."""
    out = _clean_inputs(energy_price(df if "cfg" in df.columns else with_config(df), as_of))
    cfg, t = F.col("cfg"), F.col("_temp")
    warm = F.when(t >= lit_d(95.0), F.least(F.col("_score") + lit_d(0.08), lit_d(1.0))).otherwise(F.col("_score"))
    out = out.withColumns({
        "_risk": warm,
        "_all_in": F.col("energy_price") * lit_d(1000.0) + cfg["opex_usd_per_mwh"] + cfg["capex_usd_per_mwh"],
        "_failure_usd": cfg["failure_cost_usd"] * F.least(
            lit_d(1.0), cfg["horizon_hours"] / cfg["risk_probability_horizon_hours"]),
    })
    hotter = F.when(t >= lit_d(100.0), F.least(F.col("_risk") + lit_d(0.10), lit_d(1.0))).otherwise(F.col("_risk"))
    return out.withColumn("_risk", hotter)


def utility_parts(action: tuple) -> dict[str, Column]:
    """Money terms of one action over the horizon, on rows from ``_priced``."""
    _, power_x, rate_x, risk_x, cost, downtime = action
    cfg = F.col("cfg")
    hours = F.greatest(cfg["horizon_hours"] - lit_d(downtime), lit_d(0.0))
    rate, power = F.col("_rate") * lit_d(rate_x), F.col("_power") * lit_d(power_x)
    energy = power * hours / lit_d(1_000_000.0)
    hashprice = cfg["hashprice_usd_per_ph_day"]
    eff = F.when(rate > 0, power / rate)
    per_mwh = F.when((eff > 0) & (hashprice > 0), hashprice * lit_d(1000.0) / (lit_d(24.0) * eff))
    revenue = F.coalesce(per_mwh * energy, rate * cfg["reward_per_th_hour_usd"] * hours)
    failure = F.col("_risk") * lit_d(risk_x) * F.col("_failure_usd")
    return {
        "utility_usd": revenue - energy * F.col("_all_in") - failure - lit_d(cost),
        "expected_revenue_usd": revenue,
        "expected_energy_cost_usd": energy * (F.col("energy_price") * lit_d(1000.0)),
        "expected_all_in_cost_usd": energy * F.col("_all_in"),
        "expected_failure_cost_usd": failure,
        "intervention_cost_usd": lit_d(cost),
        "expected_energy_mwh": energy,
        "revenue_usd_per_mwh": per_mwh,
        "all_in_cost_usd_per_mwh": F.col("_all_in"),
        "implied_efficiency_w_per_th": eff,
    }


def allowed(action: str) -> Column:
    """Safety rules on cleaned inputs; the first one that applies decides."""
    s, t, hot = F.col("_score"), F.col("_temp"), F.col("_overtemp")
    passive = action in ("CONTINUE", "WATCHLIST")
    rule = F.when((s >= lit_d(0.97)) | (t >= lit_d(102.0)), F.lit(action == "PULL_FOR_MAINTENANCE"))
    if passive or action == "DOWNCLOCK":
        rule = rule.when(s >= lit_d(0.85), F.lit(False))
    if passive:
        rule = rule.when((s >= lit_d(0.75)) | (t >= lit_d(99.0)) | hot, F.lit(False))
    if action == "REBOOT":
        rule = rule.when((s < lit_d(0.70)) & (t < lit_d(92.0)) & ~hot, F.lit(False))
    if action == "DOWNCLOCK":
        rule = rule.when((s < lit_d(0.55)) & (t < lit_d(90.0)), F.lit(False))
    if action == "PULL_FOR_MAINTENANCE":
        rule = rule.when(s < lit_d(0.25), F.lit(False))
    return rule.otherwise(F.lit(True))


def action_table(df: DataFrame, keys: list[str], as_of: datetime | None = None) -> DataFrame:
    """Every action of every row with its utility terms and whether it is allowed."""
    options = F.array(*[
        F.struct(
            F.lit(a[0]).alias("action"), allowed(a[0]).alias("is_allowed"),
            *[v.alias(k) for k, v in utility_parts(a).items()],
        )
        for a in S.ACTIONS
    ])
    return _priced(df, as_of).select(*keys, "energy_price", "in_curtailment_window", F.inline(options))


def _utilities(priced: DataFrame) -> DataFrame:
    """One utility column and one permission column per action."""
    return priced.withColumns({
        **{f"_u{i}": utility_parts(a)["utility_usd"] for i, a in enumerate(S.ACTIONS)},
        **{f"_ok{i}": allowed(a[0]) for i, a in enumerate(S.ACTIONS)},
    })


def _pick(df: DataFrame) -> DataFrame:
    """The allowed action with the highest utility; on ties the earlier, milder one."""
    n = len(S.ACTIONS)
    best = df.withColumn("_best", F.greatest(*[F.when(F.col(f"_ok{i}"), F.col(f"_u{i}")) for i in range(n)]))
    action = F.when(F.lit(False), F.lit(""))
    for i, a in enumerate(S.ACTIONS):
        action = action.when(F.col(f"_ok{i}") & (F.col(f"_u{i}") == F.col("_best")), F.lit(a[0]))
    out = best.withColumn("optimized_action", action.otherwise(F.lit("CONTINUE")))
    return out.withColumns({
        "optimized_reason": F.concat(F.lit("optimized_max_utility_"), F.lower("optimized_action")),
        "optimized_automation": F.col("optimized_action").isin("DOWNCLOCK", "REBOOT"),
        "expected_utility_usd": F.col("_best"),
    })


_TEMP = [*WORK, "_best", *[f"_{k}{i}" for k in ("u", "ok") for i in range(len(S.ACTIONS))]]


def optimized(df: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """The best allowed action of each row. One projection chain: no join and no shuffle."""
    return _pick(_utilities(_priced(df, as_of))).drop(*_TEMP)


def decisions(df: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """Both policies and the utility of each choice on every row."""
    out = _pick(_utilities(_priced(df, as_of)).withColumns(_baseline_columns()))
    of_baseline = F.when(F.lit(False), lit_d(0.0))
    for i, a in enumerate(S.ACTIONS):
        of_baseline = of_baseline.when(F.col("baseline_action") == a[0], F.col(f"_u{i}"))
    return out.withColumns({
        "baseline_automation": F.col("baseline_action").isin("DOWNCLOCK", "REBOOT"),
        "baseline_utility_usd": of_baseline,
        "optimized_utility_usd": F.coalesce(F.col("_best"), F.col("_u0")),
    }).drop(*_TEMP)


def backtest(df: DataFrame, as_of: datetime | None = None, config: DataFrame | None = None) -> DataFrame:
    """Utility of both policies over all rows, as one row; no rows count as passed."""
    d = decisions(df if "cfg" in df.columns else with_config(df, config), as_of)
    n = F.count(F.lit(1))
    actions = [a[0] for a in S.ACTIONS]
    sums = d.agg(
        n.alias("samples"), F.sum("baseline_utility_usd").alias("b"), F.sum("optimized_utility_usd").alias("o"),
        F.max("cfg.min_uplift_usd_per_miner").alias("need"),
        *[F.count(F.when(F.col(f"{p}_action") == a, F.lit(1))).alias(f"{p}_{a.lower()}")
          for p in ("baseline", "optimized") for a in actions],
        *[F.count(F.when(F.col(f"{p}_automation"), F.lit(1))).alias(f"{p}_auto") for p in ("baseline", "optimized")],
    )
    rows = F.col("samples")

    def rounded(x: Column) -> Column:
        return F.round(F.coalesce(x, lit_d(0.0)), 4)

    uplift = ratio(F.col("o"), rows) - ratio(F.col("b"), rows)
    need = F.coalesce("need", lit_d(0.25))
    return sums.select(
        "samples",
        rounded(ratio(F.col("b"), rows)).alias("baseline_avg_utility_usd"),
        rounded(ratio(F.col("o"), rows)).alias("optimized_avg_utility_usd"),
        rounded(uplift).alias("avg_uplift_usd_per_miner"),
        rounded(F.col("o") - F.col("b")).alias("total_uplift_usd"),
        *[f"{p}_{a.lower()}" for p in ("baseline", "optimized") for a in actions],
        rounded(ratio(F.col("baseline_auto").cast("double"), rows)).alias("baseline_automation_rate"),
        rounded(ratio(F.col("optimized_auto").cast("double"), rows)).alias("optimized_automation_rate"),
        F.round(need, 4).alias("minimum_required_uplift"),
        ((rows == 0) | (uplift >= need)).alias("passed"),
    )
