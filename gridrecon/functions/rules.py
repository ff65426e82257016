"""The comparison rules shared by all matching operators, as one status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrecon.functions import text

TOLERANCE = 0.001


def quantity_differs(req: Column, est: Column) -> Column:
    """Both blank differ; only the first blank: equal; else by the tolerance. A null is a blank."""
    diff = F.abs(F.coalesce(est, F.lit(0.0)) - F.coalesce(req, F.lit(0.0))) >= TOLERANCE
    return F.when(req.isNull(), est.isNull()).otherwise(diff)


def all_tokens(tokens: Column, name: Column) -> Column:
    return F.forall(tokens, lambda t: F.contains(name, t))


def any_token(tokens: Column, name: Column) -> Column:
    return F.exists(tokens, lambda t: F.contains(name, t))


def named(items: DataFrame) -> DataFrame:
    """items with name, plain (the name from which tokens are made) and unit_norm, made once a row, before any join."""
    items = items.withColumn("plain", text.name(F.col("item_key")))  # used twice, so Catalyst leaves it a column of its own
    return items.withColumns({"name": text.item_name(F.col("item_key"), F.col("plain")), "unit_norm": text.unit(F.col("unit"))})


def prepared(items: DataFrame) -> DataFrame:
    """named() with tokens."""
    return named(items).withColumn("tokens", text.tokens_of(F.col("plain"))).drop("plain")


def pair_status(req_quantity: Column, est_quantity: Column, req_unit: Column, est_unit: Column) -> Column:
    """Status of two rows known to belong together, whatever their names: quantity before unit before OK."""
    return F.when(quantity_differs(req_quantity, est_quantity), "QUANTITY_MISMATCH").when(text.unit(req_unit) != text.unit(est_unit), "UNIT_MISMATCH").otherwise("OK")


def compare(r: str = "r", e: str = "e") -> dict[str, Column]:
    """status, match_confidence, quantity_difference and unit_mismatch of rows r and e (either may be absent: ord null).

    Each side comes from named() and brings ord, quantity, name, plain and unit_norm. Priority: no common token,
    quantity, unit, name. Tokens are made only where the names differ.
    """
    exact = F.col(f"{r}.name") == F.col(f"{e}.name")
    overlap = any_token(text.tokens_of(F.col(f"{r}.plain")), F.col(f"{e}.name"))
    qty = quantity_differs(F.col(f"{r}.quantity"), F.col(f"{e}.quantity"))
    unit = F.col(f"{r}.unit_norm") != F.col(f"{e}.unit_norm")
    status = (
        F.when(F.col(f"{r}.ord").isNull(), "EXTRA")
        .when(F.col(f"{e}.ord").isNull(), "MISSING")
        .when(~exact & ~overlap, "MISSING")
        .when(qty, "QUANTITY_MISMATCH")
        .when(unit, "UNIT_MISMATCH")
        .when(~exact, "NAME_MISMATCH")
        .otherwise("OK")
    )
    diff = F.coalesce(F.col(f"{e}.quantity"), F.lit(0.0)) - F.coalesce(F.col(f"{r}.quantity"), F.lit(0.0))
    return {
        "status": status,
        "match_confidence": F.when(status.isin("OK", "QUANTITY_MISMATCH", "UNIT_MISMATCH") & exact, 1.0).otherwise(0.0),
        "quantity_difference": F.when(status == "QUANTITY_MISMATCH", diff),
        "unit_mismatch": F.when(status.isin("OK", "QUANTITY_MISMATCH", "UNIT_MISMATCH"), unit),
    }
