"""Raw records of mixed shape in one VARIANT column, brought to the plain columns of ``raw.RAW``.

Interfaces of hosting services give an owner and a licence as text or as an object, and counts and dates by either of two
names. A record is parsed once into a VARIANT; each plain column is then a path into it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import parse_epoch
from ..functions.text import blank_to_null


def _text(v: Column, path: str) -> Column:
    """The text or number at a path; null for an object, an array or nothing."""
    found = F.try_variant_get(v, path, "variant")
    scalar = ~F.schema_of_variant(found).rlike("^(OBJECT|ARRAY|VOID)")
    return blank_to_null(F.when(scalar, F.try_variant_get(v, path, "string")))


def _count(v: Column, *paths: str) -> Column:
    """The first of some counts that is neither missing nor 0; 0 without any."""
    return F.coalesce(*[F.nullif(F.coalesce(F.try_variant_get(v, p, "long"), F.try_variant_get(v, p, "double").cast("long")), F.lit(0)) for p in paths], F.lit(0)).cast("long")


def plain_record(v: Column) -> dict[str, Column]:
    """The plain columns of a VARIANT record.

    Owner: text, or an object's ``login``. Licence: text, or an object's ``spdx_id``, else its ``name``. Stars and forks by the
    names with ``_count`` first. ``pushed_at``, else ``updated_at``. Blank text counts as missing; tags that are no text go.
    """
    topics = F.filter(F.try_variant_get(v, "$.topics", "array<string>"), lambda t: t.isNotNull())
    pushed = F.coalesce(_text(v, "$.pushed_at"), _text(v, "$.updated_at"))
    return {
        "id": F.try_variant_get(v, "$.id", "long"), "name": _text(v, "$.name"), "owner": F.coalesce(_text(v, "$.owner"), _text(v, "$.owner.login")), "description": _text(v, "$.description"),
        "stars": _count(v, "$.stargazers_count", "$.stars"), "forks": _count(v, "$.forks_count", "$.forks"), "language": _text(v, "$.language"),
        "license": F.coalesce(_text(v, "$.license"), _text(v, "$.license.spdx_id"), _text(v, "$.license.name")), "topics": F.coalesce(topics, F.array().cast("array<string>")),
        "pushed_at": pushed, "created_at": _text(v, "$.created_at"), "is_archived": F.try_variant_get(v, "$.is_archived", "boolean"), "pushed_epoch": parse_epoch(pushed),
    }


def from_variants(df: DataFrame, col: str = "record") -> DataFrame:
    """Plain columns of a VARIANT column, or of JSON text (null where it is none), beside all others of the table.

    A column of the table that has a plain column's name is replaced.
    """
    text = df.schema[col].dataType.typeName() == "string"
    df = df.withColumn(col, F.try_parse_json(col)) if text else df
    return df.withColumns(plain_record(F.col(col)))
