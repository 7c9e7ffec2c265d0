"""Query parameters: defaults, random draws, stream order, parameter log (M1-M4, M6).

The reference draws substitution parameters from its value lists with a
sequential random stream. Here a draw is an integer mix of (stream, query,
slot) -- a rule both Spark and DuckDB evaluate identically -- and list-valued
parameters are drawn from the *data's own* value domains (distinct regions,
nations, segments, part types, ship modes, containers, brands, colours), so a
drawn parameter always selects rows. Each domain is a bounded set of distinct
values (TPC-H fixes them: 5 regions, 25 nations, 150 types, ...), so it is
broadcast to the draw.

The published table of 41 stream permutations of the 22 queries is not
reproduced; ``stream_order`` derives each stream's order by the same mixing
rule (stream 0 keeps 1..22).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoal.functions import draws
from shoal.session import cut_lineage
from shoal.generate import vocab

# Default substitution parameters of queries 1-22, in order.
DEFAULTS: dict[int, list[str]] = {
    1: ["90"], 2: ["15", "BRASS", "EUROPE"], 3: ["BUILDING", "1995-03-15"], 4: ["1993-07-01"],
    5: ["ASIA", "1994-01-01"], 6: ["1994-01-01", ".06", "24"], 7: ["FRANCE", "GERMANY"],
    8: ["BRAZIL", "AMERICA", "ECONOMY ANODIZED STEEL"], 9: ["green"], 10: ["1993-10-01"],
    11: ["GERMANY", "0.0001"], 12: ["MAIL", "SHIP", "1994-01-01"], 13: ["special", "requests"],
    14: ["1995-09-01"], 15: ["1996-01-01"],
    16: ["Brand#45", "MEDIUM POLISHED", "49", "14", "23", "45", "19", "3", "36", "9"],
    17: ["Brand#23", "MED BOX"], 18: ["300"], 19: ["Brand#12", "Brand#23", "Brand#34", "1", "10", "20"],
    20: ["forest", "1994-01-01", "CANADA"], 21: ["SAUDI ARABIA"],
    22: ["13", "31", "23", "29", "30", "18", "17"],
}

# Default row limits of the queries that have one.
ROW_LIMITS = {2: 100, 3: 10, 10: 20, 18: 100, 21: 100}

QUERIES = list(range(1, 23))
STREAMS = 41

# Parameter grammar, one entry per (query, slot): (query, n, kind, a, b, domain).
#   int     a + draw mod (b - a + 1)                  year   that int as yyyy-01-01
#   month   1993-01 + (a..b) months, as yyyy-mm-01    day    1995-03-01 + (a..b) days
#   pct     "0.0" + (a..b)                            frac   0.0001 / SF, 10 places
#   pick    a value of ``domain``                     other  a value different from slot n-1
#   last    last word of a picked value               head   picked value less its last word
#   regionof  region of the nation picked in slot n-1
#   perm    the (n-a)-th of a..b ordered by draw (distinct values across slots)
SPEC: list[tuple[int, int, str, int, int, str]] = [
    (1, 1, "int", 60, 120, ""),
    (2, 1, "int", 1, 50, ""), (2, 2, "last", 0, 0, "ptype"), (2, 3, "pick", 0, 0, "region"),
    (3, 1, "pick", 0, 0, "segment"), (3, 2, "day", 0, 30, ""),
    (4, 1, "month", 0, 57, ""),
    (5, 1, "pick", 0, 0, "region"), (5, 2, "year", 1993, 1997, ""),
    (6, 1, "year", 1993, 1997, ""), (6, 2, "pct", 2, 9, ""), (6, 3, "int", 24, 25, ""),
    (7, 1, "pick", 0, 0, "nation"), (7, 2, "other", 0, 0, "nation"),
    (8, 1, "pick", 0, 0, "nation"), (8, 2, "regionof", 0, 0, "nation_region"), (8, 3, "pick", 0, 0, "ptype"),
    (9, 1, "pick", 0, 0, "color"),
    (10, 1, "month", 1, 24, ""),
    (11, 1, "pick", 0, 0, "nation"), (11, 2, "frac", 0, 0, ""),
    (12, 1, "pick", 0, 0, "smode"), (12, 2, "other", 0, 0, "smode"), (12, 3, "year", 1993, 1997, ""),
    (13, 1, "pick", 0, 0, "q13a"), (13, 2, "pick", 0, 0, "q13b"),
    (14, 1, "month", 0, 59, ""),
    (15, 1, "month", 0, 57, ""),
    (16, 1, "pick", 0, 0, "brand"), (16, 2, "head", 0, 0, "ptype"),
    *[(16, n, "perm", 1, 50, "") for n in range(3, 11)],
    (17, 1, "pick", 0, 0, "brand"), (17, 2, "pick", 0, 0, "container"),
    (18, 1, "int", 312, 315, ""),
    (19, 1, "pick", 0, 0, "brand"), (19, 2, "pick", 0, 0, "brand"), (19, 3, "pick", 0, 0, "brand"),
    (19, 4, "int", 1, 10, ""), (19, 5, "int", 10, 20, ""), (19, 6, "int", 20, 30, ""),
    (20, 1, "pick", 0, 0, "color"), (20, 2, "year", 1993, 1997, ""), (20, 3, "pick", 0, 0, "nation"),
    (21, 1, "pick", 0, 0, "nation"),
    *[(22, n, "perm", 10, 34, "") for n in range(1, 8)],
]
PERM_FIRST = {16: 3, 22: 1}  # slot number of the first permutation value


PARAM_STREAM = 1000  # apart from the streams of the generated columns


def mix(stream: Column, query: Column, slot: Column) -> Column:
    """Integer draw for (stream, query, slot): the generator's mixer, the same arithmetic in SQL."""
    return draws.mix(draws.DEFAULT_SEED, PARAM_STREAM, stream, query, slot)


MIX_SQL = draws.mix_sql(draws.DEFAULT_SEED, PARAM_STREAM, "{s}", "{q}", "{k}")


# --------------------------------------------------------------------------- M1
def default_params(spark: SparkSession) -> DataFrame:
    """(query, n, value): the default substitution parameters (M1)."""
    rows = [(q, n, v) for q, vals in DEFAULTS.items() for n, v in enumerate(vals, start=1)]
    return spark.createDataFrame(rows, "query int, n int, value string")


# --------------------------------------------------------------------------- M4
def stream_order(spark: SparkSession, streams: int = STREAMS) -> DataFrame:
    """(stream, pos, query): query order per stream; stream 0 runs 1..22 in order (M4)."""
    s = spark.range(streams).select(F.col("id").alias("stream"))
    q = F.explode(F.sequence(F.lit(1), F.lit(len(QUERIES)))).alias("query")
    rows = s.select("stream", q)
    key = F.when(F.col("stream") == 0, F.col("query")).otherwise(mix(F.col("stream"), F.col("query"), F.lit(0)))
    w = Window.partitionBy("stream").orderBy(key, "query")  # 22 rows per stream
    return rows.select("stream", F.row_number().over(w).alias("pos"), "query")


# --------------------------------------------------------------------------- M2
def domains(t: dict[str, DataFrame]) -> DataFrame:
    """(dom, idx, value, size): distinct values per domain, 0-based index in value order."""
    n, r = t["nation"], t["region"]
    srcs = [
        ("region", r.select(F.col("r_name").alias("value"))),
        ("nation", n.select(F.col("n_name").alias("value"))),
        ("segment", t["customer"].select(F.col("c_mktsegment").alias("value"))),
        ("ptype", t["part"].select(F.col("p_type").alias("value"))),
        ("brand", t["part"].select(F.col("p_brand").alias("value"))),
        ("container", t["part"].select(F.col("p_container").alias("value"))),
        ("color", t["part"].select(F.split("p_name", " ")[0].alias("value"))),
        ("smode", t["lineitem"].select(F.col("l_shipmode").alias("value"))),
    ]
    frames = [df.distinct().withColumn("dom", F.lit(name)) for name, df in srcs]
    spark = n.sparkSession
    fixed = spark.createDataFrame([("q13a", w) for w in vocab.Q13_WORD1] + [("q13b", w) for w in vocab.Q13_WORD2],
                                  "dom string, value string")
    allv = frames[0]
    for f in frames[1:]:
        allv = allv.unionByName(f)
    allv = allv.unionByName(fixed)
    w = Window.partitionBy("dom").orderBy("value")
    indexed = allv.select("dom", "value", (F.row_number().over(w) - 1).alias("idx"),
                          F.count(F.lit(1)).over(Window.partitionBy("dom")).alias("size"))
    # the region of each nation, indexed like the nation domain
    nation_idx = indexed.filter(F.col("dom") == "nation").select("idx", "size", F.col("value").alias("n_name"))
    nr = (nation_idx.join(n.select("n_name", "n_regionkey"), "n_name")
          .join(r.select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey")
          .select(F.lit("nation_region").alias("dom"), F.col("r_name").alias("value"), "idx", "size"))
    return indexed.unionByName(nr)


def draw_params(t: dict[str, DataFrame], streams: int = STREAMS) -> DataFrame:
    """(stream, query, n, value) for every stream and query slot (M2)."""
    import json
    spark = t["nation"].sparkSession
    # the parameter grammar as one JSON literal (folded once by the optimizer)
    spec = F.from_json(F.lit(json.dumps([dict(query=q, n=n, kind=k, a=a, b=b, dom=d)
                                         for q, n, k, a, b, d in SPEC])),
                       "array<struct<query:int,n:int,kind:string,a:int,b:int,dom:string>>")
    rows = (spark.range(streams).select(F.col("id").alias("stream"), F.explode(spec).alias("p"))
            .select("stream", "p.*"))
    s, q, n = F.col("stream"), F.col("query"), F.col("n")
    h = mix(s, q, n)
    h_prev = mix(s, q, n - 1)
    a, b = F.col("a"), F.col("b")
    uni = a + h % (b - a + 1)
    sf = t["supplier"].select(F.count(F.lit(1))).scalar() / 10000
    doms = cut_lineage(domains(t))   # the tables are read once; sizes and values both use it
    sizes = doms.groupBy("dom").agg(F.first("size").alias("size"))
    rows = rows.join(F.broadcast(sizes), "dom", "left")  # one row per domain of the grammar
    size = F.col("size")
    kind = F.col("kind")
    idx = (F.when(kind == "other", (h_prev % size + 1 + h % (size - 1)) % size)
           .when(kind == "regionof", h_prev % size)
           .otherwise(h % size))
    rows = rows.withColumn("idx", idx)
    dom = doms.select("dom", "idx", F.col("value").alias("picked"))
    rows = rows.join(dom, ["dom", "idx"], "left")
    picked = F.col("picked")
    first_perm = F.when(q == 16, F.lit(PERM_FIRST[16])).otherwise(F.lit(PERM_FIRST[22]))
    ranked = F.array_sort(F.transform(F.sequence(a, b), lambda x: F.struct(mix(s, q, x).alias("h"), x.alias("x"))))
    perm = F.element_at(ranked, (n - first_perm + 1).cast("int"))["x"]
    words = F.split(picked, " ")
    value = (F.when(kind == "int", uni.cast("string"))
             .when(kind == "year", F.concat(uni.cast("string"), F.lit("-01-01")))
             .when(kind == "month", F.date_format(F.add_months(F.lit("1993-01-01").cast("date"), uni.cast("int")),
                                                  "yyyy-MM-dd"))
             .when(kind == "day", F.date_format(F.date_add(F.lit("1995-03-01").cast("date"), uni.cast("int")),
                                                "yyyy-MM-dd"))
             .when(kind == "pct", F.concat(F.lit("0.0"), uni.cast("string")))
             .when(kind == "frac", F.format_string("%.10f", F.lit(0.0001) / sf))
             .when(kind == "last", F.element_at(words, -1))
             .when(kind == "head", F.array_join(F.slice(words, 1, F.size(words) - 1), " "))
             .when(kind == "perm", perm.cast("string"))
             .otherwise(picked))
    return rows.select("stream", "query", "n", value.alias("value"))


def draw_params_sql(streams: int = STREAMS) -> str:
    """The same draws in DuckDB SQL over ``<table>_full`` fixture views."""
    spec = ", ".join(f"({q}, {n}, '{k}', {a}, {b}, '{d}')" for q, n, k, a, b, d in SPEC)
    words = ", ".join([f"('q13a', '{w}')" for w in vocab.Q13_WORD1] + [f"('q13b', '{w}')" for w in vocab.Q13_WORD2])
    h = MIX_SQL.format(s="stream", q="query", k="n")
    hp = MIX_SQL.format(s="stream", q="query", k="n - 1")
    hx = MIX_SQL.format(s="stream", q="query", k="x")
    perm_src = ", ".join(f"({q}, {a}, {b}, {PERM_FIRST[q]})" for q, (a, b) in
                         {q: (a, b) for q, n, k, a, b, d in SPEC if k == "perm"}.items())
    return f"""
    , spec(query, n, kind, a, b, dom) AS (VALUES {spec}),
    vals AS (
        SELECT DISTINCT 'region' AS dom, r_name AS value FROM region_full
        UNION SELECT DISTINCT 'nation', n_name FROM nation_full
        UNION SELECT DISTINCT 'segment', c_mktsegment FROM customer_full
        UNION SELECT DISTINCT 'ptype', p_type FROM part_full
        UNION SELECT DISTINCT 'brand', p_brand FROM part_full
        UNION SELECT DISTINCT 'container', p_container FROM part_full
        UNION SELECT DISTINCT 'color', string_split(p_name, ' ')[1] FROM part_full
        UNION SELECT DISTINCT 'smode', l_shipmode FROM lineitem_full
        UNION SELECT * FROM (VALUES {words}) w(dom, value)),
    indexed AS (
        SELECT dom, value, row_number() OVER (PARTITION BY dom ORDER BY value) - 1 AS idx,
               count(*) OVER (PARTITION BY dom) AS size FROM vals),
    doms AS (
        SELECT dom, value, idx, size FROM indexed
        UNION ALL
        SELECT 'nation_region', r.r_name, i.idx, i.size
        FROM indexed i JOIN nation_full n ON i.dom = 'nation' AND i.value = n.n_name
        JOIN region_full r ON n.n_regionkey = r.r_regionkey),
    sizes AS (SELECT dom, max(size) AS size FROM doms GROUP BY dom),
    sf AS (SELECT count(*) / 10000 AS sf FROM supplier_full),
    rows0 AS (SELECT s.stream, spec.* FROM generate_series(0, {streams - 1}) s(stream), spec),
    rows1 AS (
        SELECT r.*, z.size,
               CASE WHEN kind = 'other' THEN ({hp} % z.size + 1 + {h} % (z.size - 1)) % z.size
                    WHEN kind = 'regionof' THEN {hp} % z.size
                    ELSE {h} % z.size END AS idx,
               a + {h} % (b - a + 1) AS uni
        FROM rows0 r LEFT JOIN sizes z ON r.dom = z.dom),
    perm_rank AS (
        SELECT stream, query, first, x, row_number() OVER (PARTITION BY stream, query ORDER BY {hx}, x) AS rk
        FROM (SELECT s.stream, p.query, p.first, unnest(generate_series(p.a, p.b)) AS x
              FROM generate_series(0, {streams - 1}) s(stream), (VALUES {perm_src}) p(query, a, b, first)) c),
    rows2 AS (
        SELECT r.*, d.value AS picked, pr.x AS perm
        FROM rows1 r LEFT JOIN doms d ON r.dom = d.dom AND r.idx = d.idx
        LEFT JOIN perm_rank pr ON r.kind = 'perm' AND pr.stream = r.stream AND pr.query = r.query
                              AND pr.rk = r.n - pr.first + 1)
    SELECT stream, CAST(query AS INTEGER) AS query, CAST(n AS INTEGER) AS n,
           CASE kind
             WHEN 'int' THEN CAST(uni AS VARCHAR)
             WHEN 'year' THEN CAST(uni AS VARCHAR) || '-01-01'
             WHEN 'month' THEN strftime(DATE '1993-01-01' + to_months(CAST(uni AS INTEGER)), '%Y-%m-%d')
             WHEN 'day' THEN strftime(DATE '1995-03-01' + CAST(uni AS INTEGER), '%Y-%m-%d')
             WHEN 'pct' THEN '0.0' || CAST(uni AS VARCHAR)
             WHEN 'frac' THEN printf('%.10f', 0.0001 / (SELECT sf FROM sf))
             WHEN 'last' THEN string_split(picked, ' ')[-1]
             WHEN 'head' THEN array_to_string(string_split(picked, ' ')[1:len(string_split(picked, ' ')) - 1], ' ')
             WHEN 'perm' THEN CAST(perm AS VARCHAR)
             ELSE picked END AS value
    FROM rows2"""


# --------------------------------------------------------------------------- M6
def param_log(params: DataFrame) -> DataFrame:
    """(stream, query, line): the query number, then its values tab-separated, in slot order (M6)."""
    ordered = F.array_sort(F.collect_list(F.struct("n", "value")))  # <= 10 slots per group
    return (params.groupBy("stream", "query")
            .agg(F.concat_ws("\t", F.col("query").cast("string"),
                             F.array_join(F.transform(ordered, lambda x: x["value"]), "\t")).alias("line")))
