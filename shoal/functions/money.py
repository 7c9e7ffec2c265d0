"""Money as integer cents inside a computation, DECIMAL(15,2) outside."""

from __future__ import annotations

from pyspark.sql import Column

from shoal.functions.keys import div

PENNIES = 100


def cents_to_decimal(cents: Column) -> Column:
    """``d.cc`` from integer cents, sign kept."""
    return (cents.cast("decimal(20,0)") / PENNIES).cast("decimal(15,2)")


def charged_cents(eprice_cents: Column, discount_pct: Column, tax_pct: Column) -> Column:
    """Discounted, taxed line price with integer truncation at each step (H21):
    ``((e * (100 - d)) / 100) * (100 + t) / 100``."""
    return div(div(eprice_cents * (PENNIES - discount_pct), PENNIES) * (PENNIES + tax_pct), PENNIES)
