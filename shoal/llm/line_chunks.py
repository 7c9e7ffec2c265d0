"""Line dedup by content-defined chunks of lines (operator 2), DataFrame functions only.

A text is cut into lines. A rolling hash over each pair of neighbouring lines (of
their md5 hashes, with one salt for either use) marks half of the lines as starts
and half as ends. A chunk runs from a start to the nearest end after it, at most
``MOST`` lines on, so it has two lines at least, and its bounds follow from its own
lines alone: wherever the lines return, whatever stands around them, the chunk
returns. A line of at least ``LONG_LINE`` words is also a chunk of its own.

Marks leave out most short passages. So with ``windows``, as the query and the pipeline
have it, a chunk is also opened at every line with words, to the first line where
``LONG_LINE`` words are reached, and closed at every line with words, from the last
line before it where they are reached. These bounds too follow from the chunk's own lines.
They cover every run of lines of so many words that returns, from its first to its last
line with words, and no shorter run; lines without words go with the line before them.

Of a chunk that occurs more than once in all documents, the occurrence in the
smallest (id, text hash), at the smallest line, stays and the others are removed
from their texts, together with the lines before and after them, up to ``AROUND``
on either side, that also stand before and after the first occurrence (windows are not extended). So a line goes only where
the same line stands at a smaller place; of overlapping repeats (a run of equal
lines) the first lines stay. Hashes only nominate chunks: the chunks' bytes are
compared before any is removed.

Cutting is one narrow pass over the arrays of a row. What is shuffled: one
short row per chunk (counted map-side first, so a chunk in a third of all
documents is one row per task), the texts of repeated chunks, and the documents
that they are taken from.

Defined results: null text stays null; rows with the same id and the same text
are one document stored twice and get the same result; a null id sorts last;
empty lines count as lines; an empty table gives no rows; other columns of the
input pass through, whatever their names, in ``dedup_lines``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.llm.common import drop_path, write_table

LONG_LINE = 50
WORD = r"[^\\x20\\x09-\\x0D]+"          # as a SQL literal
MOST = 16
AROUND = 8


def lines_of(text: str) -> str:
    return f"split({text}, '\\n', -1)"


def line_hashes(text: str) -> str:
    return f"transform({lines_of(text)}, l -> md5(cast(l AS binary)))"


def chunks(text: str, long_line: int = LONG_LINE, most: int = MOST) -> Column:
    """Array of (s, e, h): first and last line and hash of each chunk."""
    long = f"length(l) >= {2 * long_line - 1} AND length(l) - length(replace(l, ' ', '')) >= {long_line - 1}"
    # nested one-element arrays bind a value once: ls the lines, a their hashes, m the marks of ends
    return F.expr(f"""
        element_at(transform(array({lines_of(text)}), ls -> element_at(transform(array({line_hashes(text)}), a ->
          concat(
            element_at(transform(array(transform(a, (x, j) -> j > 0 AND md5(cast(concat('e', a[j - 1], x) AS binary)) < '8')), m ->
              transform(
                filter(
                  transform(
                    filter(sequence(0, size(a) - 1), i -> i + 1 < size(a) AND md5(cast(concat('s', a[i], a[i + 1]) AS binary)) < '8'),
                    i -> struct(i AS s, i + cast(array_position(slice(m, i + 2, {most}), true) AS int) AS e)),
                  c -> c.e > c.s),
                c -> struct(c.s AS s, c.e AS e, xxhash64(slice(a, c.s + 1, c.e - c.s + 1)) AS h))), 1),
            transform(
              filter(transform(ls, (l, i) -> struct({long} AS w, i AS i)), c -> c.w),
              c -> struct(c.i AS s, c.i AS e, xxhash64(a[c.i]) AS h)))), 1)), 1)""")


def short_runs(text: str, long_line: int = LONG_LINE) -> Column:
    """Array of (s, e, x, h): for each line with words the shortest run of ``long_line`` words that it opens or closes,
    x the last of the lines without words that follow the run."""
    # lines until the words are reached, 0 if they are not; a line has a word at least, so long_line of them are enough
    reach = f"aggregate({{x}}, struct(0 AS t, 0 AS k), (r, x) -> IF(r.t >= {long_line}, r, struct(r.t + x AS t, r.k + 1 AS k)), r -> IF(r.t >= {long_line}, r.k, 0))"

    def ends(cut: str) -> str:
        near, far = (reach.format(x=cut.format(n=n)) for n in (min(8, long_line), long_line))
        return f"filter(transform(q.w, (x, j) -> struct(j AS j, coalesce(nullif({near}, 0), {far}) AS k)), c -> c.k > 0)"

    opened = ends("slice(q.w, j + 1, {n})")
    closed = ends("reverse(slice(q.w, greatest(1, j + 2 - {n}), least({n}, j + 1)))")
    # a run is one number, as sets of numbers are hashed: the places of its ends among the lines with words
    return F.expr(f"""
        element_at(transform(array({lines_of(text)}), ls -> element_at(transform(array({line_hashes(text)}), a ->
          element_at(transform(array(filter(transform(ls, (l, i) -> struct(i AS i, regexp_count(l, '{WORD}') AS w)), c -> c.w > 0)), p ->
            element_at(transform(array(struct(p.i AS i, p.w AS w)), q ->
              transform(
                transform(
                  array_union(transform({opened}, c -> c.j * 2147483648L + c.j + c.k - 1), transform({closed}, c -> (c.j - c.k + 1) * 2147483648L + c.j)),
                  c -> struct(q.i[cast(c div 2147483648L AS int)] AS s, cast(c % 2147483648L AS int) AS j)),
                c -> struct(c.s AS s, q.i[c.j] AS e, coalesce(get(q.i, c.j + 1), size(ls)) - 1 AS x, xxhash64('window', slice(a, c.s + 1, q.i[c.j] - c.s + 1)) AS h))), 1)), 1)), 1)), 1)""")


def repeated_spans(docs: DataFrame, long_line: int = LONG_LINE, most: int = MOST, around: int = AROUND, windows: bool = False) -> DataFrame:
    """(k1, k2, spans): per document of (id, text, k1, k2) the line spans (s, e) to remove."""
    form = lambda window, x: lambda c: F.struct(c.s.alias("s"), c.e.alias("e"), c[x].alias("x"), c.h.alias("h"), F.lit(window).alias("window"))
    found = [F.transform(chunks("text", long_line, most), form(False, "e"))]
    if windows:
        found.append(F.transform(short_runs("text", long_line), form(True, "x")))
    meta, meta_path = write_table(docs.filter("text is not null")
                          .select("k1", "k2", F.explode(F.concat(*found)).alias("c"))
                          .select("k1", "k2", "c.*"), "chunks")
    # written before it is joined: a join fed by the aggregate itself could not split a hot chunk's rows
    often, often_path = write_table(meta.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "often", release=True)
    # a document's candidates are bounded by its own chunks
    cand = meta.join(often, "h").groupBy("k1", "k2").agg(F.collect_set(F.struct("s", "e", "x", "h", "window")).alias("cs"))
    once = docs.join(cand, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    texts = once.select("id", "k1", "k2", F.explode(F.expr(
        f"element_at(transform(array(struct({lines_of('text')} AS ls, {line_hashes('text')} AS a)), d -> transform(cs, c -> struct(c.s, c.x, c.h, "
        "array_join(slice(d.ls, c.s + 1, c.e - c.s + 1), '\n') AS bytes, "
        f"reverse(slice(d.a, greatest(1, c.s - {around - 1}), IF(c.window, 0, least({around}, c.s)))) AS pre, "
        f"slice(d.a, c.e + 2, IF(c.window, 0, {around})) AS post))), 1)")).alias("c"))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2", F.col("c.s").alias("s"))
    texts, texts_path = write_table(texts.select("k1", "k2", "c.*", place.alias("place")), "chunktexts", release=True)
    for path in (meta_path, often_path):
        drop_path(docs.sparkSession, path)
    first, first_path = write_table(texts.groupBy("h", "bytes").agg(
        F.min(F.struct("place", F.col("pre").alias("pre0"), F.col("post").alias("post0"))).alias("f"), F.count("*").alias("n"))
        .filter("n > 1").select("h", "bytes", "f.*").withColumnRenamed("place", "first"), "first", release=True)
    same = ("IF(least(size({x}), size({y})) = 0, 0, size(filter(sequence(1, greatest(1, least(size({x}), size({y})))), "
            "k -> slice({x}, 1, k) = slice({y}, 1, k))))")
    spans = (texts.join(first, ["h", "bytes"]).filter("place <> first")
             .select("k1", "k2", F.expr(f"s - {same.format(x='pre', y='pre0')}").alias("s"), F.expr(f"x + {same.format(x='post', y='post0')}").alias("e"))
             .groupBy("k1", "k2").agg(F.collect_set(F.struct("s", "e")).alias("spans")))
    spans, _ = write_table(spans, "spans", release=True)         # the chunks' texts are not moved along with the documents
    for path in (texts_path, first_path):
        drop_path(docs.sparkSession, path)
    return spans


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                long_line: int = LONG_LINE, most: int = MOST, around: int = AROUND, stats: str = "dedup", windows: bool = False) -> DataFrame:
    """``docs`` with repeated chunks taken out of the text, and struct ``stats`` (n_lines, n_removed)."""
    own = "t" + uuid.uuid4().hex[:8]                     # names that can't clash with the input's
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    keys = {"k1": F.xxhash64(id_, text), "k2": F.xxhash64(F.lit("lane"), text, id_)}
    slim = docs.select(id_.alias("id"), text.alias("text"), *(v.alias(k) for k, v in keys.items()))
    spans = repeated_spans(slim, long_line, most, around, windows).select(*(F.col(c).alias(f"{own}_{c}") for c in ("k1", "k2", "spans")))
    wide = docs.withColumns({f"{own}_{k}": v for k, v in keys.items()}).join(spans, [f"{own}_k1", f"{own}_k2"], "left")
    t, s = f"`{text_col}`", f"{own}_spans"
    gone = f"array_distinct(flatten(transform({s}, r -> sequence(r.s, r.e))))"
    wide = wide.withColumn(f"{own}_gone", F.expr(f"IF({s} IS NULL, NULL, {gone})"))
    g = f"{own}_gone"
    rest = (f"IF({g} IS NULL, {t}, element_at(transform(array({lines_of(t)}), ls -> array_join(transform("
            f"array_except(sequence(0, size(ls) - 1), {g}), i -> ls[i]), '\n')), 1))")
    wide = wide.withColumn(f"{own}_stats", F.struct(
        F.expr(f"coalesce(cast(size({lines_of(t)}) AS long), 0L)").alias("n_lines"), F.coalesce(F.size(g).cast("long"), F.lit(0)).alias("n_removed")))
    return wide.select(*(F.expr(rest).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns),
                       F.col(f"{own}_stats").alias(stats))
