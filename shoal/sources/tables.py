"""Table readers and writers.

* pipe-delimited text (``|`` between fields and after the last) with a fixed
  schema, read by Spark's native CSV reader: no Python per row, no inference;
* Parquet (the default at rest), read lazily so Catalyst prunes columns and
  pushes filters into the scan;
* refresh-set files (``orders.tbl.u1``, ``lineitem.tbl.u1``, ``delete.1``, and
  segmented ``.u1.3``), with set and segment numbers taken from the path;
* one output per column (unpivot + partitioned write).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from shoal.sources.schemas import SCHEMAS

EOL = "_eol"  # the trailing empty field after the last "|"

DRIVER_TABLES = ("region nation customer supplier part orders lineitem events documents "
                 "embeddings pages benchmark labels conversations").split()


def _with_eol(schema: StructType) -> StructType:
    return StructType(list(schema.fields) + [StructField(EOL, StringType(), True)])


def read_tbl(spark: SparkSession, path: str, table: str, mode: str = "PERMISSIVE") -> DataFrame:
    """Read a pipe-delimited TPC-H table with its DDL schema (A1-A4).

    Quotes are plain text (``quote=""``) as in a split on ``|``. The format has no
    NULL: an empty text field is the empty text. A number or date that does not
    parse becomes NULL in PERMISSIVE mode; the not-null check counts it.
    """
    schema = SCHEMAS[table]
    return (spark.read.schema(_with_eol(schema))
            .option("sep", "|").option("quote", "").option("escape", "")
            .option("header", "false").option("mode", mode)
            .option("dateFormat", "yyyy-MM-dd")
            .csv(path)
            .drop(EOL)
            .withColumns({f.name: F.coalesce(F.col(f.name), F.lit("")) for f in schema.fields if isinstance(f.dataType, StringType)}))


def write_tbl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write rows as pipe-delimited text with the trailing separator (A5)."""
    cols = [F.col(c).cast("string") if not isinstance(t, StringType) else F.col(c)
            for c, t in ((f.name, f.dataType) for f in df.schema.fields)]
    (df.select(*cols, F.lit(None).cast("string").alias(EOL))
       .write.mode(mode).option("sep", "|").option("quote", "").option("escape", "")
       .option("emptyValue", "").option("nullValue", "").option("dateFormat", "yyyy-MM-dd")
       .csv(path))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver Parquet table (lazy: column pruning and filters reach the scan).

    The folder is listed on every call, so files added or rewritten since are seen.
    """
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, names=DRIVER_TABLES) -> dict[str, DataFrame]:
    """Register each driver table as a temp view of the same name."""
    out = {}
    for name in names:
        df = load(spark, sf_dir, name)
        df.createOrReplaceTempView(name)
        out[name] = df
    return out


_REFRESH_PATH = r"(orders|lineitem)\.tbl\.u(\d+)(?:\.(\d+))?(?:/part-[^/]*)?$"   # a file, or a folder of part files
_DELETE_PATH = r"delete\.(\d+)(?:\.(\d+))?(?:/part-[^/]*)?$"


def _optional_int(text):
    return F.when(text == "", F.lit(None)).otherwise(text).cast("int")


def read_refresh_inserts(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """All insert files of one table in a folder, tagged with set and segment."""
    df = read_tbl(spark, f"{folder.rstrip('/')}/{table}.tbl.u*", table)
    path = F.col("_metadata.file_path")
    return (df.withColumn("refresh_set", F.regexp_extract(path, _REFRESH_PATH, 2).cast("int"))
              .withColumn("segment", _optional_int(F.regexp_extract(path, _REFRESH_PATH, 3))))


def read_refresh_deletes(spark: SparkSession, folder: str) -> DataFrame:
    """Delete-key files ``delete.N[.M]``: one order key per line, ``|``-terminated."""
    schema = StructType([StructField("o_orderkey", LongType(), False),
                         StructField(EOL, StringType(), True)])
    df = (spark.read.schema(schema).option("sep", "|").option("quote", "")
          .csv(f"{folder.rstrip('/')}/delete.*").drop(EOL))
    path = F.col("_metadata.file_path")
    return (df.withColumn("refresh_set", F.regexp_extract(path, _DELETE_PATH, 1).cast("int"))
              .withColumn("segment", _optional_int(F.regexp_extract(path, _DELETE_PATH, 2))))


def write_refresh_set(orders: DataFrame, lineitem: DataFrame, deletes: DataFrame, folder: str, update: int,
                      segments: int = 1) -> None:
    """Write one refresh set as ``orders.tbl.uN``, ``lineitem.tbl.uN`` and ``delete.N``, or with
    ``segments`` > 1 as ``.uN.1`` .. ``.uN.M`` by their ``segment`` column (folders of part files)."""
    folder = folder.rstrip("/")
    for seg in range(1, segments + 1):
        end = f"{update}.{seg}" if segments > 1 else str(update)
        for df, name in ((orders, f"orders.tbl.u{end}"), (lineitem, f"lineitem.tbl.u{end}"), (deletes, f"delete.{end}")):
            part = df.filter(F.col("segment") == seg) if segments > 1 else df
            write_tbl(part.drop("segment"), f"{folder}/{name}")


def write_distributions(dists: DataFrame, path: str) -> None:
    """Value lists (dist, pos, text, weight) as distribution text: ``begin <name>``, ``count|<n>``, a
    ``<text>|<weight>`` line per entry, ``end <name>``; one folder per list."""
    sizes = dists.groupBy("dist").agg(F.count(F.lit(1)).alias("n"))
    name = F.col("dist")
    lines = (dists.select("dist", (F.col("pos") + 1).alias("at"), F.concat("text", F.lit("|"), F.col("weight").cast("string")).alias("value"))
             .unionByName(sizes.select("dist", F.explode(F.array(
                 F.struct(F.lit(0).alias("at"), F.concat(F.lit("begin "), name).alias("value")),
                 F.struct(F.lit(1).alias("at"), F.concat(F.lit("count|"), F.col("n").cast("string")).alias("value")),
                 F.struct((F.col("n") + 2).cast("int").alias("at"), F.concat(F.lit("end "), name).alias("value")))).alias("l")).select("dist", "l.*")))
    # a value list is one bounded column domain
    (lines.repartition("dist").sortWithinPartitions("dist", "at").select("dist", "value")
     .write.mode("overwrite").partitionBy("dist").text(path))


def read_distributions(spark: SparkSession, path: str) -> DataFrame:
    """(dist, pos, text, weight) of distribution files (A11): ``begin``/``end`` lines name a list, a
    ``count|n`` line and comments (``#``) are skipped, other lines are ``text|weight`` in order."""
    from pyspark.sql import Window

    from shoal.sources.runlogs import read_lines
    lines = read_lines(spark, path).filter(~F.col("value").rlike(r"^\s*(#|$)"))
    w = Window.partitionBy("file").orderBy("line_no")           # a file of lists is small
    v = F.col("value")
    inside = lines.withColumn("dist", F.last(F.when(F.lower(v).startswith("begin "), F.trim(F.substring(v, 7, 1 << 20))), True)
                              .over(w.rowsBetween(Window.unboundedPreceding, 0)))
    entry = inside.filter(~F.lower(v).rlike(r"^(begin |end |count\|)") & F.col("dist").isNotNull())
    split = F.regexp_extract(v, r"^(.*)\|([^|]*)$", 2)
    return (entry.withColumn("pos", F.row_number().over(Window.partitionBy("file", "dist").orderBy("line_no")))
            .select("dist", "pos", F.regexp_extract(v, r"^(.*)\|([^|]*)$", 1).alias("text"), split.try_cast("long").alias("weight")))


def unpivot_columns(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (key, column, value): the per-column split of a table.

    Values are cast to text first so that all columns share one type.
    """
    values = [c for c in df.columns if c not in keys]
    as_text = df.select(*keys, *[F.col(c).cast("string").alias(c) for c in values])
    return as_text.unpivot(keys, values, "column", "value")


def write_per_column(df: DataFrame, keys: list[str], path: str) -> None:
    """Write the unpivoted table partitioned by column name (one folder per column)."""
    unpivot_columns(df, keys).write.mode("overwrite").partitionBy("column").parquet(path)
