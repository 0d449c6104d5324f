"""Explicit schemas: nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "float": T.FloatType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "long": T.LongType(), "int": T.IntegerType(), "strings": T.ArrayType(T.StringType()), "floats": T.ArrayType(T.FloatType())}


def _struct(**fields: str | T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind] if isinstance(kind, str) else kind) for name, kind in fields.items()])


PAYLOAD = _struct(
    id="string",
    transaction=_struct(amount="float", installments="float", requested_at="string"),
    customer=_struct(avg_amount="float", tx_count_24h="float", known_merchants="strings"),
    merchant=_struct(id="string", mcc="string", avg_amount="float"),
    terminal=_struct(is_online="boolean", card_present="boolean", km_from_home="float"),
    last_transaction=_struct(timestamp="string", km_from_current="float"),
)
REFERENCE = _struct(vector="floats", label="string")
TEST_FILE = _struct(
    stats=_struct(total="double", fraud_count="double", fraud_rate="double", legit_count="double", legit_rate="double", edge_case_rate="double"),
    entries=T.ArrayType(_struct(request=PAYLOAD, expected_approved="boolean")),
)
META = _struct(count="long", dims="int", dtype="string", nlist="int", seed="long", iters="int")
