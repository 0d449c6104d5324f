"""The 14 features of a payload, in single precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelane.config import DIMS, Config
from scorelane.functions import time_expr
from scorelane.functions.math_expr import clamp01, f32

NAMES = [f"v{i}" for i in range(DIMS)]


def _num(x: float) -> Column:
    return F.lit(float(x)).cast("float")


def _over(x: Column, limit: float) -> Column:
    return clamp01(f32(x / _num(limit)))


def risk(mcc: Column, config: Config) -> Column:
    pairs = [y for k, v in config.mcc_risk.items() for y in (F.lit(k), _num(v))]
    found = F.try_element_at(F.create_map(*pairs), mcc) if pairs else F.lit(None).cast("float")
    return F.coalesce(found, _num(config.default_risk))


def feature_columns(p: Column, now: Column, hour: Column, weekday: Column, before: Column, config: Config | None = None) -> list[Column]:
    """Of a validated payload: a null in a required field would count as its limit. now, before: seconds of the request and of the last
    transaction."""
    config = config or Config()
    at, limits = config, config.limits
    tx, customer, merchant, terminal, last = (p[n] for n in ("transaction", "customer", "merchant", "terminal", "last_transaction"))
    minutes = f32(f32(F.greatest(now - before, F.lit(0))) / _num(60))
    ratio = f32(f32(F.try_divide(tx["amount"], customer["avg_amount"])) / _num(limits.amount_vs_avg_ratio))
    out = [
        _over(tx["amount"], limits.max_amount),
        _over(tx["installments"], limits.max_installments),
        F.when(customer["avg_amount"] <= 0, _num(1)).otherwise(clamp01(ratio)),
        f32(hour / _num(23)),
        f32(weekday / _num(6)),
        F.when(last.isNull(), _num(-1)).otherwise(clamp01(f32(minutes / _num(limits.max_minutes)))),
        F.when(last.isNull(), _num(-1)).otherwise(_over(last["km_from_current"], limits.max_km)),
        _over(terminal["km_from_home"], limits.max_km),
        _over(customer["tx_count_24h"], limits.max_tx_count_24h),
        terminal["is_online"].cast("float"),
        terminal["card_present"].cast("float"),
        F.when(F.array_contains(customer["known_merchants"], merchant["id"]), _num(0)).otherwise(_num(1)),
        risk(merchant["mcc"], at),
        _over(merchant["avg_amount"], limits.max_merchant_avg_amount),
    ]
    return [c.alias(n) for c, n in zip(out, NAMES, strict=True)]


def vectorize(valid: DataFrame, payload: str = "payload", config: Config | None = None) -> DataFrame:
    """valid with columns v0 to v13; null where the payload is null. Texts, whether they are timestamps, and days come in steps of their
    own, as each is needed several times and would be worked out as often."""
    p, (at, last) = F.col(payload), ("_at", "_last")
    steps = valid.withColumns({at: p["transaction"]["requested_at"], last: p["last_transaction"]["timestamp"]})
    steps = steps.withColumns({f"{t}_ok": time_expr.valid(F.col(t)) for t in (at, last)})
    steps = steps.withColumns({f"{t}_day": time_expr.day(F.col(t), F.col(f"{t}_ok")) for t in (at, last)})
    now, before = (time_expr.epoch_seconds(F.col(t), F.col(f"{t}_ok"), F.col(f"{t}_day")) for t in (at, last))
    columns = feature_columns(p, now, time_expr.hour(F.col(at), F.col(f"{at}_ok")), F.weekday(f"{at}_day"), before, config)
    out = steps.withColumns({n: F.when(p.isNotNull(), c) for n, c in zip(NAMES, columns, strict=True)})
    return out.drop(*[f"{t}{end}" for t in (at, last) for end in ("", "_ok", "_day")])
