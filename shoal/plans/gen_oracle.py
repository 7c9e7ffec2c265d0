"""DuckDB SQL of the table generator, for the correctness oracle.

The rules of ``shoal.generate.tables`` and ``shoal.functions.text`` over the key
columns of the given tables, with ``draws.jump_sql`` for a row's state (columns r1 and
r2 of a subquery) and ``draws.draw_sql`` for its numbers. Word lists are one-row list
columns, so each is written once.
"""

from __future__ import annotations

from shoal.functions import draws
from shoal.functions import text as X
from shoal.functions.dates import CURRENT_DATE, ORDER_DATE_MAX, START_DATE
from shoal.generate import tables as G
from shoal.generate import vocab
from shoal.generate.tables import S


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strings(values: list[str]) -> str:
    return "[" + ", ".join(map(q, values)) + "]"


ROW = ("r1", "r2")


def state(key: str, *salt: int) -> str:
    """The select items r1, r2."""
    return ", ".join(f"{x} AS {n}" for x, n in zip(draws.jump_sql(key, *salt), ROW, strict=True))


def h(stream: int, sub: int = 0, row: draws.State = ROW) -> str:
    return draws.draw_sql(row, draws.position(stream, sub))


def uniform(lo: int, hi, stream: str, sub: int = 0) -> str:
    """[lo, hi] by a draw of one number (the ranges of the test data are short); ``hi`` may be SQL."""
    return f"({lo} + {h(S[stream], sub)} % ({hi} - {lo} + 1))"


def pick(values: list[str], stream: str) -> str:
    return f"{strings(values)}[{h(S[stream])} % {len(values)} + 1]"


def tagged(tag: str, key: str) -> str:
    return f"{q(tag)} || lpad(CAST({key} AS VARCHAR), 9, '0')"


def phone(nation: str, stream: str) -> str:
    return (f"printf('%02d-%03d-%03d-%04d', CAST({nation} + 10 AS INTEGER), CAST({uniform(100, 999, stream, 1)} AS INTEGER), "
            f"CAST({uniform(100, 999, stream, 2)} AS INTEGER), CAST({uniform(1000, 9999, stream, 3)} AS INTEGER))")


def random_string(column: str) -> str:
    lo, hi = vocab.bounds(column)
    char = f"substr({q(vocab.ALPHANUM)}, CAST({h(S[column], 0, draws.advance_sql(ROW, 'i', X.CHARS))} % 64 + 1 AS INTEGER), 1)"
    return f"array_to_string([{char} FOR i IN generate_series(1, {uniform(lo, hi, column, X.CHARS + 1)})], '')"


def money(cents: str) -> str:
    return f"CAST(CAST(({cents}) AS DECIMAL(18,0)) / 100 AS DECIMAL(15,2))"


# -- comment text: the pool and the windows cut from it -----------------------------

class _Slots:
    """The draw positions of a sentence's words, as in ``text._Slots``."""

    def __init__(self):
        self.n = 0

    def draw(self) -> str:
        self.n += 1
        return draws.draw_sql(ROW, self.n)

    def word(self, part: str) -> str:
        return f"w.w{part}[{self.draw()} % {len(vocab.expand(X._WORDS[part]))} + 1]"

    def choice(self, weighted: list[tuple[str, int]]) -> str:
        r, upto, out = f"({self.draw()} % {sum(w for _, w in weighted)})", 0, "CASE"
        for i, (_, w) in enumerate(weighted[:-1]):
            upto += w
            out += f" WHEN {r} < {upto} THEN {i}"
        return f"{out} ELSE {len(weighted) - 1} END"


def _phrase(slots: _Slots, forms: list[tuple[str, int]]) -> str:
    choice, out = slots.choice(forms), ""
    for i, (form, _) in enumerate(forms):
        words = [slots.word(t[0]) + (f" || {q(t[1:])}" if len(t) > 1 else "") for t in form.split(" ")]
        out += f" WHEN {i} THEN concat_ws(' ', {', '.join(words)})"
    return f"CASE ({choice}){out} END"


def pool_ctes(size: int = X.POOL_BYTES) -> str:
    """``pool`` (c, t): the text pool."""
    slots = _Slots()
    parts = {"G": slots.choice(vocab.GRAMMAR)}
    for name in ("N1", "N2"):
        parts[name] = _phrase(slots, vocab.NOUN_PHRASES)
    parts["V1"] = _phrase(slots, vocab.VERB_PHRASES)
    for name in ("P1", "P2"):
        parts[name] = f"{slots.word('P')} || ' the ' || {_phrase(slots, vocab.NOUN_PHRASES)}"
    parts["T1"] = slots.word("T")
    whole = ""
    for i, (grammar, _) in enumerate(vocab.GRAMMAR):
        used: dict[str, int] = {}
        words, end = [], ""
        for token in grammar.split(" "):
            used[token] = used.get(token, 0) + 1
            if token == "T":
                end = f"p{token}{used[token]}"
            else:
                words.append(f"p{token}{used[token]}")
        whole += f" WHEN {i} THEN concat_ws(' ', {', '.join(words)}) || {end}"
    lists = ", ".join(f"{strings(vocab.expand(words))} AS w{p}" for p, words in X._WORDS.items())
    return f"""w AS (SELECT {lists}),
        places AS MATERIALIZED (SELECT c, j, {state(f"c * {X.POOL_SENTENCES} + j", X.POOL_SALT)}
                   FROM generate_series(0, {chunks(size) - 1}) a(c), generate_series(1, {X.POOL_SENTENCES}) b(j)),
        sentences AS (SELECT c, j, {', '.join(f"{sql} AS p{n}" for n, sql in parts.items())} FROM places, w),
        pool AS (SELECT c, string_agg(CASE pG{whole} END, ' ' ORDER BY j) AS t FROM sentences GROUP BY c)"""


def chunks(size: int) -> int:
    return max(1, -(-size // X.POOL_ROW))


def with_comment(source: str, column: str, size: int = X.POOL_BYTES) -> str:
    """``source`` (a subquery with r1, r2) with its comment column."""
    lo, hi = vocab.bounds(column)
    length = f"least({uniform(lo, hi, column, X.COMMENT_LENGTH)}, length(t))"
    offset = f"{h(S[column], X.COMMENT_OFFSET)} % (length(t) - {length} + 1) + 1"
    return (f"SELECT s.*, substr(t, CAST({offset} AS BIGINT), CAST({length} AS BIGINT)) AS {column} "
            f"FROM ({source}) s JOIN pool ON c = {h(S[column], X.COMMENT_CHUNK)} % {chunks(size)}")


# -- tables --------------------------------------------------------------------------

ROWS = {t: f"(SELECT count(*) FROM {t})" for t in ("supplier", "customer", "part", "orders")}


def retail_cents(p: str) -> str:
    return f"(90000 + ({p}) // 10 % 20001 + ({p}) % 1000 * 100)"


def bridge(p: str, s: str) -> str:
    n = ROWS["supplier"]
    return f"((({p}) + ({s}) * ({n} // 4 + (({p}) - 1) // {n})) % {n} + 1)"


def sparse(k: str, seq: int = 0) -> str:
    return f"(((({k}) >> 3 << 2) + {seq} << 3) + (({k}) & 7))"


def supplier() -> str:
    base = f"""SELECT k AS s_suppkey, r1, r2, {tagged('Supplier#', 'k')} AS s_name, {random_string('s_address')} AS s_address,
        {uniform(0, len(vocab.NATIONS) - 1, 's_nation')} AS s_nationkey, {money(uniform(-99999, 999999, 's_acctbal'))} AS s_acctbal
        FROM (SELECT s_suppkey + 1 AS k, {state('s_suppkey + 1')} FROM supplier) z"""
    comment = "s_comment"
    span = len(vocab.BBB_BASE) + len(vocab.BBB_COMPLAIN)
    noise = f"({h(S['s_bbb'], 3)} % (greatest(length({comment}) - {span}, 0) + 1))"
    offset = f"({h(S['s_bbb'], 4)} % (greatest(length({comment}) - {span} - {noise}, 0) + 1))"
    kind = f"CASE WHEN {uniform(0, 100, 's_bbb', 2)} < {vocab.BBB_COMPLAIN_PCT} THEN {q(vocab.BBB_COMPLAIN)} ELSE {q(vocab.BBB_COMMEND)} END"

    def over(text: str, put: str, size: int, at: str) -> str:
        return f"substr({text}, 1, CAST({at} AS BIGINT)) || {put} || substr({text}, CAST({at} AS BIGINT) + {size + 1})"

    first = over(comment, q(vocab.BBB_BASE), len(vocab.BBB_BASE), offset)
    second = over(f"({first})", f"({kind})", len(vocab.BBB_COMPLAIN), f"({offset} + {len(vocab.BBB_BASE)} + {noise})")
    return f"""WITH {pool_ctes()}
        SELECT s_suppkey, s_name, s_address, CAST(s_nationkey AS BIGINT) AS s_nationkey, {phone('s_nationkey', 's_phone')} AS s_phone,
               CAST(s_acctbal AS DOUBLE) AS s_acctbal,
               CASE WHEN {uniform(1, 10000, 's_bbb', 1)} <= {vocab.BBB_PER_10000} AND length({comment}) >= {span} THEN {second} ELSE {comment} END AS s_comment
        FROM ({with_comment(base, comment)}) x"""


def customer() -> str:
    base = f"""SELECT k AS c_custkey, r1, r2, {tagged('Customer#', 'k')} AS c_name, {random_string('c_address')} AS c_address,
        {uniform(0, len(vocab.NATIONS) - 1, 'c_nation')} AS c_nationkey, {money(uniform(-99999, 999999, 'c_acctbal'))} AS c_acctbal,
        {pick(vocab.SEGMENTS, 'c_segment')} AS c_mktsegment FROM (SELECT c_custkey + 1 AS k, {state('c_custkey + 1')} FROM customer) z"""
    return f"""WITH {pool_ctes()}
        SELECT c_custkey, c_name, c_address, CAST(c_nationkey AS BIGINT) AS c_nationkey, {phone('c_nationkey', 'c_phone')} AS c_phone,
               CAST(c_acctbal AS DOUBLE) AS c_acctbal, c_mktsegment, c_comment FROM ({with_comment(base, 'c_comment')}) x"""


def part() -> str:
    size, n = len(vocab.COLORS), 5
    steps, taken = "", "[]::BIGINT[]"
    for i in range(1, n + 1):
        last = size - n + i
        steps += f""", t{i} AS (SELECT *, CASE WHEN list_contains({taken}, d{i}) THEN {last} ELSE d{i} END AS x{i}
                 FROM (SELECT *, {h(S['p_name'], i)} % {last} + 1 AS d{i} FROM {'keys' if i == 1 else f't{i - 1}'}) y)"""
        taken = "[" + ", ".join(f"x{a}" for a in range(1, i + 1)) + "]"
    names = " || ' ' || ".join(f"colors[x{i}]" for i in range(1, n + 1))
    m = uniform(1, 5, "p_mfgr")
    base = f"""SELECT k AS p_partkey, r1, r2, {names} AS p_name, 'Manufacturer#' || CAST({m} AS VARCHAR) AS p_mfgr,
        'Brand#' || CAST({m} AS VARCHAR) || CAST({uniform(1, 5, 'p_brand')} AS VARCHAR) AS p_brand, {pick(vocab.PART_TYPES, 'p_type')} AS p_type,
        CAST({uniform(1, 50, 'p_size')} AS INTEGER) AS p_size, {pick(vocab.CONTAINERS, 'p_container')} AS p_container,
        {money(retail_cents('k'))} AS p_retailprice FROM t{n}, (SELECT {strings(vocab.COLORS)} AS colors) l"""
    return f"""WITH {pool_ctes()}, keys AS (SELECT p_partkey + 1 AS k, {state('p_partkey + 1')} FROM part){steps}
        SELECT * EXCLUDE (r1, r2) REPLACE (CAST(p_retailprice AS DOUBLE) AS p_retailprice) FROM ({with_comment(base, 'p_comment')}) x"""


def partsupp() -> str:
    base = f"""SELECT p AS ps_partkey, r1, r2, CAST({bridge('p', 's')} AS BIGINT) AS ps_suppkey, CAST({uniform(1, 9999, 'ps_qty')} AS INTEGER) AS ps_availqty,
        {money(uniform(100, 100000, 'ps_cost'))} AS ps_supplycost
        FROM (SELECT *, {state('p * 4 + s')} FROM (SELECT p_partkey + 1 AS p, unnest([0, 1, 2, 3]) AS s FROM part) y) r"""
    return f"""WITH {pool_ctes()}
        SELECT ps_partkey, ps_suppkey, ps_availqty, CAST(ps_supplycost AS DOUBLE) AS ps_supplycost, ps_comment
        FROM ({with_comment(base, 'ps_comment')}) x"""


def order_ctes(keys: str = "SELECT o_orderkey + 1 AS i FROM orders", upd: int = 0) -> str:
    """``heads``: order headers before totals, and ``lines``: every line with its draws."""
    seq = 0 if upd == 0 else 1 + upd // G.UPDATES_PER_SEQUENCE
    days = (ORDER_DATE_MAX - START_DATE).days
    up = f"least(c + 1, {ROWS['customer']})"
    active = f"CASE WHEN c % 3 <> 0 THEN c WHEN {up} % 3 <> 0 THEN {up} ELSE {up} - 1 END"
    clerks = f"greatest({ROWS['orders']} // {G.ORDERS_PER_REFRESH}, 1000)"
    date = lambda d: f"DATE '{d.isoformat()}'"
    receipt = f"(ship + CAST({uniform(1, 30, 'l_receipt')} AS INTEGER))"
    line = ", ".join(f"{x} AS {n}" for x, n in zip(draws.advance_sql(ROW, "n", G.MOST_LINES), ROW, strict=True))
    return f"""heads AS MATERIALIZED (
        SELECT i, r1, r2, {sparse('i', seq)} AS o_orderkey, {active} AS o_custkey,
               {date(START_DATE)} + CAST({uniform(0, days, 'o_date')} AS INTEGER) AS o_orderdate,
               {pick(vocab.PRIORITIES, 'o_prio')} AS o_orderpriority,
               {tagged('Clerk#', f"(1 + {h(S['o_clerk'])} % {clerks})")} AS o_clerk,
               {uniform(1, G.MOST_LINES, 'o_lines')} AS n_lines
        FROM (SELECT *, {uniform(1, ROWS["customer"], "o_cust")} AS c FROM (SELECT i, {state('i', *([upd] if upd else []))} FROM ({keys}) z) x) y),
    drawn AS (SELECT i, r1, r2, o_orderkey, o_orderdate, unnest(generate_series(1, n_lines)) AS n FROM heads),
    placed AS (SELECT * REPLACE ({line}) FROM drawn),
    lines AS (
        SELECT *, {receipt} AS receipt, {retail_cents('p')} * qty AS eprice
        FROM (SELECT *, {uniform(1, ROWS['part'], 'l_part')} AS p, {uniform(1, 50, 'l_qty')} AS qty,
                     {uniform(0, 10, 'l_disc')} AS disc, {uniform(0, 8, 'l_tax')} AS tax,
                     o_orderdate + CAST({uniform(1, 121, 'l_ship')} AS INTEGER) AS ship FROM placed) x)"""


def orders() -> str:
    today = f"DATE '{CURRENT_DATE.isoformat()}'"
    base = f"""SELECT r1, r2, h.o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey,
               CASE WHEN shipped = n_lines THEN 'F' WHEN shipped > 0 THEN 'P' ELSE 'O' END AS o_orderstatus,
               CAST({money('total')} AS DOUBLE) AS o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority, o_clerk, 0 AS o_shippriority
        FROM heads h JOIN (SELECT i, sum((eprice * (100 - disc) // 100) * (100 + tax) // 100) AS total,
                                  count(*) FILTER (WHERE ship <= {today}) AS shipped FROM lines GROUP BY i) t ON h.i = t.i"""
    return f"WITH {pool_ctes()}, {order_ctes()} SELECT * EXCLUDE (r1, r2) FROM ({with_comment(base, 'o_comment')}) x"


def lineitem(size: int = X.POOL_BYTES) -> str:
    today = f"DATE '{CURRENT_DATE.isoformat()}'"
    base = f"""SELECT r1, r2, o_orderkey AS l_orderkey, CAST(p AS BIGINT) AS l_partkey,
        CAST({bridge('p', uniform(0, 3, 'l_supp'))} AS BIGINT) AS l_suppkey, CAST(n AS INTEGER) AS l_linenumber, CAST(qty AS DOUBLE) AS l_quantity,
        CAST({money('eprice')} AS DOUBLE) AS l_extendedprice, CAST({money('disc')} AS DOUBLE) AS l_discount, CAST({money('tax')} AS DOUBLE) AS l_tax,
        CASE WHEN receipt <= {today} THEN {pick(vocab.RETURN_FLAGS, 'l_rflag')} ELSE 'N' END AS l_returnflag,
        CASE WHEN ship <= {today} THEN 'F' ELSE 'O' END AS l_linestatus, CAST(ship AS VARCHAR) AS l_shipdate,
        CAST(o_orderdate + CAST({uniform(30, 90, 'l_commit')} AS INTEGER) AS VARCHAR) AS l_commitdate, CAST(receipt AS VARCHAR) AS l_receiptdate,
        {pick(vocab.INSTRUCTIONS, 'l_instr')} AS l_shipinstruct, {pick(vocab.SHIP_MODES, 'l_mode')} AS l_shipmode FROM lines"""
    return f"WITH {pool_ctes(size)}, {order_ctes()} SELECT * EXCLUDE (r1, r2) FROM ({with_comment(base, 'l_comment', size)}) x"


def comments(size: int) -> str:
    """Order comments from a pool of ``size`` bytes."""
    base = f"SELECT o_orderkey, {state('o_orderkey + 1')} FROM orders"
    return f"WITH {pool_ctes(size)} SELECT o_orderkey, o_comment FROM ({with_comment(base, 'o_comment', size)}) x"


def far_draws(far: int) -> str:
    """Draws of keys that lie ``far`` apart, and their states."""
    one = ", ".join(f"{x} AS a{k}" for k, x in enumerate(draws.jump_sql("k")))
    two = ", ".join(f"{x} AS b{k}" for k, x in enumerate(draws.jump_sql("k + far")))
    near, off = (draws.draw_sql((f"{c}0", f"{c}1"), draws.position(S["o_cust"])) for c in "ab")
    return f"""SELECT k AS key, {near} AS near_draw, {off} AS far_draw
        FROM (SELECT k, {one}, {two} FROM (SELECT o_orderkey AS k, CAST({far} AS BIGINT) AS far FROM orders) x) y"""


def embedded(word: str) -> str:
    """``word`` written over each order's comment at its drawn place."""
    at = f"(({h(S['s_bbb'])} % (greatest(length(c) - {len(word)}, 0) + 1)) + 1)"
    return f"""SELECT o_orderkey, substr(c, 1, CAST({at} AS BIGINT) - 1) || {q(word)} || substr(c, CAST({at} AS BIGINT) + {len(word)}) AS noise
        FROM (SELECT o_orderkey, 'order ' || o_orderkey || ' of ' || o_orderpriority AS c, {state('o_orderkey + 1')} FROM orders) z"""


def refresh() -> str:
    keys = f"SELECT o_orderkey + 1 AS i FROM orders WHERE o_orderkey + 1 <= greatest({ROWS['orders']} // {G.UPDATES_PER_SEQUENCE}, 1)"
    return f"""WITH {order_ctes(keys, 1)}
        SELECT 'insert_orders' AS part, o_orderkey AS key FROM heads
        UNION ALL SELECT 'insert_lineitem', o_orderkey FROM lines
        UNION ALL SELECT 'delete', {sparse('i')} FROM ({keys}) z"""


ORACLE = {"gen_supplier": supplier, "gen_customer": customer, "gen_part": part, "gen_partsupp": partsupp,
          "gen_orders": orders, "gen_lineitem": lineitem, "gen_refresh": refresh}
