"""Stateless pseudo-random draws: a jump into a long stream, and an integer mixer.

The reference generator advances sequential random streams and skips ahead per row
so that a row does not depend on its chunk. Here too a table is one long stream and
a row owns ``ROW`` consecutive numbers of it; a row's state is the stream's state at
its first number, reached from the row's key alone by repeated squaring (one table
of powers for each hexadecimal digit of the 64-bit key). Any partitioning, and any task
retry, yields the same table.

The stream is a combined multiplicative generator: two lanes modulo two primes
below 2^31, so every product stays below 2^62, whose difference has a period of about
2.3 * 10^18. A draw at a position of a row is one multiplication in either lane by a power
known when the plan is made. ``jump`` and ``draw`` are the column forms, ``jump_sql``
and ``draw_sql`` the same arithmetic as SQL text.

``mix`` hashes a few small keys without a stream: three rounds of exclusive-or
and multiplication modulo 2^31 - 1 for each 30 bits of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.functions.keys import div

DEFAULT_SEED = 19620718

# -- the stream ----------------------------------------------------------------

# The moduli and multipliers of the published combined generator (L'Ecuyer, CACM 31, 1988).
MODULI = (2147483563, 2147483399)
MULTIPLIERS = (40014, 40692)
RANGE = MODULI[0] - 1           # a draw lies in [0, RANGE)
SUBS = 128                      # numbers of one column in a row
ROW = 64 * SUBS                 # numbers of one row
WIDE = 1 << 24                  # ranges above this take two numbers
SECOND = SUBS // 2              # where the second one lies
DIGITS = 16                     # hexadecimal digits of a key

State = tuple                   # the two lanes: columns, or SQL expressions


def position(stream: int, sub: int = 0) -> int:
    """Place of a column's number ``sub`` within a row."""
    if not (0 <= stream < ROW // SUBS and 0 <= sub < SUBS):
        raise ValueError(f"no number {sub} of stream {stream} in a row")
    return stream * SUBS + sub


def power(lane: int, steps: int) -> int:
    return pow(MULTIPLIERS[lane], steps, MODULI[lane])


def start(*salt: int) -> tuple[int, int]:
    """State of the first row of the stream that the seed and ``salt`` choose."""
    h = 0
    for s in (DEFAULT_SEED, *salt):
        h = (h ^ (s & 0xFFFFFFFFFFFFFFFF)) * 0x9E3779B97F4A7C15 % (1 << 64)
        h = (h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 % (1 << 64)
        h ^= h >> 32
    return tuple((h >> (31 * k)) % (m - 1) + 1 for k, m in enumerate(MODULI))


def _jump_table(lane: int, digit: int) -> list[int]:
    """Powers for the values of one hexadecimal digit of the key."""
    return [power(lane, ROW * v * 16 ** digit) for v in range(16)]


def jump(key: Column, *salt: int) -> State:
    """The state of row ``key`` (any 64-bit number, read as unsigned)."""
    out = []
    for lane, h in enumerate(start(*salt)):
        h = F.lit(h).cast("long")
        for d in range(DIGITS):
            digit = F.shiftrightunsigned(key.cast("long"), 4 * d).bitwiseAND(15).cast("int")
            h = h * F.get(F.lit(_jump_table(lane, d)).cast("array<long>"), digit) % MODULI[lane]
        out.append(h)
    return tuple(out)


def jump_sql(key: str, *salt: int) -> State:
    out = []
    for lane, h in enumerate(start(*salt)):
        h = f"{h}::BIGINT"
        for d in range(DIGITS):
            h = f"({h} * ({_jump_table(lane, d)}::BIGINT[])[((({key}) >> {4 * d}) & 15) + 1] % {MODULI[lane]})"
        out.append(h)
    return tuple(out)


def _difference(x, y):
    return (x - y + RANGE) % RANGE


def advance(state: State, n: Column, most: int) -> State:
    """The state ``n`` numbers on, for a column ``n`` in 0..most."""
    return tuple(x * F.get(F.lit([power(k, i) for i in range(most + 1)]).cast("array<long>"), n.cast("int")) % MODULI[k] for k, x in enumerate(state))


def advance_sql(state: State, n: str, most: int) -> State:
    return tuple(f"({x} * ({[power(k, i) for i in range(most + 1)]}::BIGINT[])[{n} + 1] % {MODULI[k]})" for k, x in enumerate(state))


def draw(state: State, at: int) -> Column:
    """The number at position ``at`` of a row, in [0, RANGE)."""
    return _difference(*(x * F.lit(power(k, at)).cast("long") % MODULI[k] for k, x in enumerate(state)))


def draw_sql(state: State, at: int) -> str:
    x, y = (f"({x} * {power(k, at)} % {MODULI[k]})" for k, x in enumerate(state))
    return f"(({x} - {y} + {RANGE}) % {RANGE})"


def wide_draw(state: State, at: int) -> Column:
    """A number below 2^62 of two, for ranges that 31 bits would not fill."""
    return F.shiftleft(draw(state, at), 31) + draw(state, at + SECOND)


# -- the mixer -------------------------------------------------------------------

PRIME = (1 << 31) - 1
ROUNDS = ((0x5BD1E995, 1103515245), (0x27D4EB2F, 1597334677), (0x165667B1, 1812433253))
ROUNDS = tuple((c & PRIME, a) for c, a in ROUNDS)
PART = 30                       # bits of a key that are mixed at once, below the prime
START = 12345


def _round_int(h: int, k: int) -> int:
    h = ((h ^ ROUNDS[0][0]) + k) % PRIME * ROUNDS[0][1] % PRIME
    for c, a in ROUNDS[1:]:
        h = (h ^ c) * a % PRIME
    return h


def _parts(k: int) -> list[int]:
    return [k >> (PART * p) & ((1 << PART) - 1) for p in range(3)]


def _folded(keys: tuple) -> tuple[int, tuple]:
    """The leading integer keys mixed here, and the rest."""
    h = START
    while keys and isinstance(keys[0], int):
        for k in _parts(keys[0]):
            h = _round_int(h, k)
        keys = keys[1:]
    return h, keys


def mix(*keys) -> Column:
    """A draw in [0, 2^31 - 1) for integer keys (numbers or columns)."""
    h, rest = _folded(keys)
    h = F.lit(h).cast("long")
    for key in rest:
        whole = F.lit(key).cast("long") if isinstance(key, int) else key.cast("long")
        for p in range(3):
            k = F.shiftrightunsigned(whole, PART * p).bitwiseAND((1 << PART) - 1)
            h = (h.bitwiseXOR(F.lit(ROUNDS[0][0]).cast("long")) + k) % PRIME * ROUNDS[0][1] % PRIME
            for c, a in ROUNDS[1:]:
                h = h.bitwiseXOR(F.lit(c).cast("long")) * a % PRIME
    return h


def mix_sql(*keys) -> str:
    """The same draw as SQL text (DuckDB); text keys are non-negative integer expressions."""
    h, rest = _folded(keys)
    out = f"{h}::BIGINT"
    for key in rest:
        for p in range(3):
            k = str(_parts(key)[p]) if isinstance(key, int) else f"((({key})::BIGINT >> {PART * p}) & {(1 << PART) - 1})"
            out = f"((xor({out}, {ROUNDS[0][0]}::BIGINT) + {k}) % {PRIME} * {ROUNDS[0][1]} % {PRIME})"
            for c, a in ROUNDS[1:]:
                out = f"(xor({out}, {c}::BIGINT) * {a} % {PRIME})"
    return out


def weighted_pick(df: DataFrame, draw_col: str, dist: DataFrame, total: Column, out: str = "picked",
                  buckets: int = 1024) -> DataFrame:
    """Pick the entry whose cumulative weight window holds the draw.

    ``dist`` has (text, weight, cum) with ``cum`` the running weight sum, ``total``
    the whole weight and ``draw_col`` in [1, total]. The condition ``cum - weight <
    draw <= cum`` is a range join, written as an equi-join: [1, total] is cut into
    ``buckets`` equal ranges, an entry goes to each range that it touches (at most
    entries + buckets rows), a draw to its one range. Plans like any equi-join,
    whatever the length of the list.
    """
    width = F.greatest(F.ceil(total / buckets), F.lit(1)).cast("long")
    entries = (dist.filter("weight > 0").select("text", "weight", "cum")
               .withColumn("_range", F.explode(F.sequence(div(F.col("cum") - F.col("weight"), width), div(F.col("cum") - 1, width)))))
    d = F.col(draw_col)
    joined = (df.withColumn("_range", div(d - 1, width)).join(entries, "_range")
              .filter((d > F.col("cum") - F.col("weight")) & (d <= F.col("cum"))))
    return joined.drop("weight", "cum", "_range").withColumnRenamed("text", out)
