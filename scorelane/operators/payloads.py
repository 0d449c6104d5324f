"""From JSON text to validated payload rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelane.functions import time_expr
from scorelane.schema import PAYLOAD

OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
REQUIRED = [f"{f.name}.{g.name}" for f in PAYLOAD.fields if f.name not in ("id", "last_transaction") for g in f.dataType.fields]
WITH_CORRUPT = T.StructType([*PAYLOAD.fields, T.StructField("_corrupt", T.StringType())])
TEXTS = ["transaction.requested_at", "merchant.id", "merchant.mcc"]


def parse(body: Column) -> Column:
    """The payload struct, with _corrupt set where the text is no JSON object of this shape."""
    return F.from_json(body, WITH_CORRUPT, OPTIONS)


def strict(body: Column, variant: Column | None = None) -> Column:
    """What the lenient parser lets pass though a strict one wouldn't: text after the object, repeated names, and numbers where
    texts belong. variant: try_parse_json(body), where it was worked out before."""
    variant = F.try_parse_json(body) if variant is None else variant
    whole = F.coalesce(body.rlike(r"(?s)^\s*\{.*\}\s*$"), F.lit(False))
    kinds = [F.coalesce(F.schema_of_variant(F.try_variant_get(variant, f"$.{path}", "variant")) == "STRING", F.lit(False)) for path in TEXTS]
    return whole & reduce(lambda a, b: a & b, kinds)


def complete(p: Column) -> Column:
    """All required fields are there, lists hold no null, an optional part is whole, and timestamps are valid."""
    last = p["last_transaction"]
    checks = [p[path.split(".")[0]][path.split(".")[1]].isNotNull() for path in REQUIRED]
    checks += [
        p["_corrupt"].isNull(),
        F.coalesce(F.forall(p["customer"]["known_merchants"], lambda x: x.isNotNull()), F.lit(False)),
        time_expr.valid(p["transaction"]["requested_at"]),
        last.isNull() | (last["timestamp"].isNotNull() & last["km_from_current"].isNotNull() & time_expr.valid(last["timestamp"])),
    ]
    return F.coalesce(p.isNotNull() & reduce(lambda a, b: a & b, checks), F.lit(False))


def validate(requests: DataFrame, body: str = "body", is_strict: bool = True) -> DataFrame:
    """requests with payload (null where rejected) and status (200 or 400). Not strict: numbers for texts, text after the object and
    repeated names pass. Each body is parsed once: a status that is not deterministic keeps a filter on it from being worked out
    below, where it would parse the body again for every field that it asks for."""
    parsed = requests.withColumn("payload", parse(F.col(body)))
    ok = complete(F.col("payload"))
    if is_strict:
        parsed = parsed.withColumn("_variant", F.try_parse_json(F.col(body)))
        ok = ok & strict(F.col(body), F.col("_variant"))
    parsed = parsed.withColumn("status", F.when(ok & (F.monotonically_increasing_id() >= 0), 200).otherwise(400))
    return parsed.drop("_variant").withColumn("payload", F.when(F.col("status") == 200, F.col("payload")))
