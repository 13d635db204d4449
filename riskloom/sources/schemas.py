"""Declared schemas of the logs."""

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_NUMERIC_CODES = ("device", "log_from", "ip", "city", "result", "type")


def login_schema(codes_as_text: bool = False) -> T.StructType:
    """Login log. The code columns are numbers, or text when `codes_as_text`."""
    code = T.StringType() if codes_as_text else T.LongType()
    kinds = {
        "log_id": T.StringType(),
        "timelong": T.LongType(),
        "timestamp": T.LongType(),
        "id": T.StringType(),
        "is_scan": T.BooleanType(),
        "is_sec": T.BooleanType(),
        "time": T.TimestampNTZType(),
    }
    order = (
        "log_id", "timelong", "device", "log_from", "ip", "city", "result",
        "timestamp", "type", "id", "is_scan", "is_sec", "time",
    )
    return _struct(*((c, code if c in _NUMERIC_CODES else kinds[c]) for c in order))


# `time` stays text here: it carries characters past the seconds.
TRADE = _struct(
    ("rowkey", T.StringType()), ("time", T.StringType()), ("id", T.StringType()), ("is_risk", T.IntegerType())
)
TRADE_TEST = _struct(("rowkey", T.StringType()), ("time", T.StringType()), ("id", T.StringType()))
LINKED_TRADE = T.StructType([*TRADE.fields, T.StructField("login_id", T.StringType(), True)])
LINKED_TRADE_TEST = T.StructType([*TRADE_TEST.fields, T.StructField("login_id", T.StringType(), True)])
SUBMISSION = _struct(("rowkey", T.StringType()), ("is_risk", T.IntegerType()))
