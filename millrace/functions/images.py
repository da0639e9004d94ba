"""Nested change-stream images: typed attributes such as ``{"S": "text"}``, ``{"L": [...]}``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Attribute names of the event image.
RECORD_PATH = "dynamodb.NewImage"
FONT_LISTS = ("adobeFonts", "teamFonts", "personalFonts", "systemFonts", "riskScanFonts")
TEXT_ATTRIBUTES = ("eventName", "userEmail", "mtfid", "timestamp")
PROJECT_ATTRIBUTES = ("projectId", "projectName", "projectType", "assetType")

_TEXT = T.StructType([T.StructField("S", T.StringType())])
_TEXT_LIST = T.StructType([T.StructField("L", T.ArrayType(_TEXT))])


def image_schema() -> T.StructType:
    """Schema of one line of the feed. Attributes that a line lacks come out NULL."""
    image = T.StructType(
        [T.StructField(name, _TEXT) for name in TEXT_ATTRIBUTES + PROJECT_ATTRIBUTES]
        + [T.StructField(name, _TEXT_LIST) for name in FONT_LISTS]
    )
    return T.StructType(
        [
            T.StructField("eventID", T.StringType()),
            T.StructField("dynamodb", T.StructType([T.StructField("NewImage", image)])),
        ]
    )


def text_attribute(record: str, name: str) -> Column:
    return F.col(f"{record}.{name}.S")


def list_union(record: str, names=FONT_LISTS) -> Column:
    """All entries of the named lists as one array of strings; a missing list adds nothing."""
    empty = F.array().cast(T.ArrayType(T.StringType()))
    return F.concat(*[F.coalesce(F.col(f"{record}.{name}.L.S"), empty) for name in names])


def any_list_filled(record: str, names=FONT_LISTS) -> Column:
    filled = [F.coalesce(F.size(F.col(f"{record}.{name}.L")) > 0, F.lit(False)) for name in names]
    return reduce(lambda a, b: a | b, filled)
