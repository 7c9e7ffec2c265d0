"""Key arithmetic of the TPC-H generator as column expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sparse order keys keep the low 3 bits and insert 2 sequence bits.
SPARSE_KEEP = 3
SPARSE_BITS = 2
SUPP_PER_PART = 4
CUST_MORTALITY = 3  # every third customer key places no orders


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def div(a, b) -> Column:
    """Integer quotient of 64-bit numbers (no detour over doubles)."""
    return F.call_function("div", _c(a).cast("long"), _c(b).cast("long"))


def retail_price_cents(p) -> Column:
    """Part retail price in cents from the (1-based) part key."""
    p = _c(p)
    return F.lit(90000) + div(p, 10) % 20001 + (p % 1000) * 100


def retail_price(p) -> Column:
    """Retail price as DECIMAL(15,2) (H13 + H18)."""
    return (retail_price_cents(p).cast("decimal(18,0)") / 100).cast("decimal(15,2)")


def sparse_key(i, seq=0) -> Column:
    """Sparse order key: low bits kept, ``seq`` inserted above them.

    ``((i >> 3) << 2 | seq) << 3 | (i & 7)`` -- 7 stays 7, 8 becomes 32.
    """
    i, seq = _c(i).cast("long"), _c(seq).cast("long")
    low = i.bitwiseAND(F.lit((1 << SPARSE_KEEP) - 1))
    high = F.shiftleft(F.shiftright(i, SPARSE_KEEP), SPARSE_BITS) + seq
    return F.shiftleft(high, SPARSE_KEEP) + low


def dense_key(ok) -> Column:
    """Inverse of ``sparse_key`` (drops the sequence bits)."""
    ok = _c(ok).cast("long")
    low = ok.bitwiseAND(F.lit((1 << SPARSE_KEEP) - 1))
    return F.shiftleft(F.shiftright(ok, SPARSE_KEEP + SPARSE_BITS), SPARSE_KEEP) + low


def sparse_seq(ok) -> Column:
    """Sequence bits of a sparse key (0 for base rows, >= 1 for refresh inserts)."""
    return F.shiftright(_c(ok).cast("long"), SPARSE_KEEP).bitwiseAND(F.lit((1 << SPARSE_BITS) - 1))


def partsupp_bridge(p, s, n_supp) -> Column:
    """1-based supplier key of part ``p``'s slot ``s`` (0..3) among ``n_supp`` suppliers."""
    p, s, n = _c(p).cast("long"), _c(s).cast("long"), _c(n_supp).cast("long")
    return (p + s * (div(n, SUPP_PER_PART) + div(p - 1, n))) % n + 1


def active_customer(k, max_key) -> Column:
    """Move a customer key off multiples of 3: +1, clamp to ``max_key``, else -1."""
    k, m = _c(k).cast("long"), _c(max_key).cast("long")
    up = F.least(k + 1, m)
    return F.when(k % CUST_MORTALITY != 0, k).when(up % CUST_MORTALITY != 0, up).otherwise(up - 1)
