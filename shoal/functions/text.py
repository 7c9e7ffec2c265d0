"""Text columns of the generator as column expressions.

Every draw is a number of the row's own part of a random stream (``draws``), at a
place given by the column and a running number, so a row's text depends only on
its key. ``row`` is the row's state. Word lists are constant arrays (folded into one literal by the
optimizer); a weighted list is expanded so a uniform index is a weighted pick.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shoal.functions.draws import WIDE, State, advance, draw, jump, position, wide_draw
from shoal.generate import vocab


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _h(stream: int, row: State | Column, sub: int = 0) -> Column:
    """A number of the row's state; a key in its place is jumped to here."""
    return draw(jump(row) if isinstance(row, Column) else row, position(stream, sub))


def _int(lo: int, hi: int, stream: int, row: State, sub: int = 0) -> Column:
    """Uniform integer in [lo, hi] (I16)."""
    h = _h(stream, row, sub) if hi - lo < WIDE else wide_draw(row, position(stream, sub))
    return F.lit(lo).cast("long") + h % F.lit(hi - lo + 1).cast("long")


_SEP = "\u0001"


def const_array(values: list[str]) -> Column:
    """A constant string array as one literal split once (the optimizer folds it),
    so a long word list costs three plan nodes instead of one per entry."""
    return F.split(F.lit(_SEP.join(values)), _SEP)


def pick(values: list[str], stream: int, row: State, sub: int = 0) -> Column:
    """Uniform pick from a list (weighted lists pass through ``vocab.expand``)."""
    return F.element_at(const_array(values), (_h(stream, row, sub) % len(values) + 1).cast("int"))


def tagged(tag: str, key, width: int = 9) -> Column:
    """``Supplier#000000001``-style names."""
    return F.concat(F.lit(tag), F.lpad(_c(key).cast("string"), width, "0"))


def phone(nationkey, stream: int, row: State) -> Column:
    """``cc-aaa-eee-nnnn`` with ``cc = 10 + nation`` and three random groups."""
    return F.format_string("%02d-%03d-%03d-%04d", (_c(nationkey) + 10).cast("int"),
                           _int(100, 999, stream, row, 1).cast("int"),
                           _int(100, 999, stream, row, 2).cast("int"),
                           _int(1000, 9999, stream, row, 3).cast("int"))


CHARS = 60                      # longest random string that a column's numbers give


def random_string(min_len: int, max_len: int, stream: int, row: State) -> Column:
    """Random alphanumeric string of random length in [min, max]."""
    if max_len > CHARS:
        raise ValueError(f"at most {CHARS} characters")
    n = _int(min_len, max_len, stream, row, CHARS + 1)
    alphabet = const_array(list(vocab.ALPHANUM))
    chars = F.transform(F.sequence(F.lit(1), n.cast("int")),
                        lambda i: F.element_at(alphabet, (_h(stream, advance(row, i, CHARS)) % 64 + 1).cast("int")))
    return F.array_join(chars, "")


def embed(text: Column, word: Column, stream: int, row: State | Column) -> Column:
    """``word`` written over ``text`` at a random position."""
    room = F.greatest(F.length(text) - F.length(word), F.lit(0))
    pos = _h(stream, row) % (room + 1) + 1
    return F.overlay(text, word, pos.cast("int"))


def distinct_picks(values: list[str], n: int, stream: int, row: State, sep: str = " ") -> Column:
    """``n`` different entries of ``values`` joined by ``sep`` (H26), by ``n`` draws: the i-th is one of
    the first size - n + i places, or the last of these if that place is already taken."""
    arr, size, taken = const_array(values), len(values), F.array().cast("array<long>")
    for i in range(1, n + 1):
        last = size - n + i
        at = _h(stream, row, i) % last + 1
        # a one-element array binds what is drawn so far once
        taken = F.element_at(F.transform(F.array(taken), lambda t: F.concat(  # noqa: B023
            t, F.array(F.when(F.array_contains(t, at), F.lit(last).cast("long")).otherwise(at)))), 1)
    return F.array_join(F.transform(taken, lambda k: F.element_at(arr, k.cast("int"))), sep)


# --------------------------------------------------------------------------- comment grammar
_WORDS = {"N": vocab.NOUNS, "V": vocab.VERBS, "J": vocab.ADJECTIVES, "D": vocab.ADVERBS,
          "X": vocab.AUXILIARIES, "P": vocab.PREPOSITIONS, "T": vocab.TERMINATORS}


class _Slots:
    """Hands out a fresh draw position for every word of a sentence."""

    def __init__(self, row: State):
        self.row, self.n = row, 0

    def draw(self) -> Column:
        self.n += 1
        return draw(self.row, self.n)

    def word(self, part: str) -> Column:
        words = vocab.expand(_WORDS[part])
        return F.element_at(const_array(words), (self.draw() % len(words) + 1).cast("int"))

    def choice(self, weighted: list[tuple[str, int]]) -> Column:
        """0-based index of a weighted pick: a draw in [0, total) against the
        running weight thresholds."""
        r = self.draw() % sum(w for _, w in weighted)
        out, upto = None, 0
        for i, (_, w) in enumerate(weighted[:-1]):
            upto += w
            out = F.when(r < upto, F.lit(i)) if out is None else out.when(r < upto, F.lit(i))
        return out.otherwise(F.lit(len(weighted) - 1)) if out is not None else F.lit(0)


def _phrase(slots: _Slots, forms: list[tuple[str, int]]) -> Column:
    """A noun or verb phrase: pick a form, then one word per part of speech in it.

    A part written with a trailing comma (``J,``) keeps the comma after its word.
    """
    choice = slots.choice(forms)
    distinct = [f for f, _ in forms]
    out = None
    for i, form in enumerate(distinct):
        words = []
        for token in form.split(" "):
            w = slots.word(token[0])
            words.append(F.concat(w, F.lit(token[1:])) if len(token) > 1 else w)
        text = F.concat_ws(" ", *words)
        out = F.when(choice == i, text) if out is None else out.when(choice == i, text)
    return out


def sentence_parts(row: State) -> dict[str, Column]:
    """The phrase slots one sentence can use, each drawn once: noun phrases
    N1, N2, verb phrase V1, prepositional phrases P1, P2 (preposition + "the" +
    noun phrase), terminator T1, and the grammar choice G."""
    slots = _Slots(row)
    parts = {"G": slots.choice(vocab.GRAMMAR)}
    for name in ("N1", "N2"):
        parts[name] = _phrase(slots, vocab.NOUN_PHRASES)
    parts["V1"] = _phrase(slots, vocab.VERB_PHRASES)
    for name in ("P1", "P2"):
        parts[name] = F.concat(slots.word("P"), F.lit(" the "), _phrase(slots, vocab.NOUN_PHRASES))
    parts["T1"] = slots.word("T")
    return parts


def sentence_from_parts(cols: dict[str, str]) -> Column:
    """Compose the sentence of the chosen grammar from slot columns: parts
    separated by blanks, the terminator abutting the last word."""
    out = None
    for i, (grammar, _) in enumerate(vocab.GRAMMAR):
        used: dict[str, int] = {}
        words, term = [], None
        for token in grammar.split(" "):
            used[token] = used.get(token, 0) + 1
            col = F.col(cols[f"{token}{used[token]}"])
            if token == "T":
                term = col
            else:
                words.append(col)
        text = F.concat(F.concat_ws(" ", *words), term)
        out = F.when(F.col(cols["G"]) == i, text) if out is None else out.when(F.col(cols["G"]) == i, text)
    return out


# Text pool: chunks of POOL_SENTENCES grammar sentences each (about POOL_ROW bytes a chunk), as many as
# the pool's size asks for.
POOL_SENTENCES = 24
POOL_ROW = 1024
POOL_BYTES = 1 << 20
BROADCAST_CHUNKS = 8192         # a pool of at most so many chunks (8 MiB) is broadcast, a larger one is joined by chunk
POOL_SALT = 997


_POOLS: dict = {}


class Pool:
    """The generator's text pool: ``rows`` (_chunk, _pool, _size) and the number of chunks."""

    def __init__(self, rows, chunks: int, sentences: int):
        self.rows, self.chunks, self.sentences = rows, chunks, sentences


def text_pool(spark, size: int = POOL_BYTES, sentences: int = POOL_SENTENCES) -> Pool:
    """A pool of about ``size`` bytes; the same chunks whatever its size.

    One row per (chunk, sentence) with every phrase slot as a column, the
    sentence composed from them, then the sentences of a chunk joined in order
    (at most ``sentences`` rows a group). The (lazy, deterministic) plan is
    kept per session, so its large expression is built once.
    """
    chunks = max(1, -(-size // POOL_ROW))
    memo = (spark.sparkContext.applicationId, chunks, sentences)
    if memo not in _POOLS:
        # a plan; deterministic, so any task recomputes the same text
        _POOLS[memo] = Pool(_build_pool(spark, chunks, sentences), chunks, sentences)
    return _POOLS[memo]


def _build_pool(spark, chunks: int, sentences: int):
    rows = (spark.range(chunks, numPartitions=max(1, min(chunks // 64, spark.sparkContext.defaultParallelism)))
            .select(F.col("id").alias("_chunk"), F.explode(F.sequence(F.lit(1), F.lit(sentences))).alias("_j")))
    first, second = jump(F.col("_chunk") * sentences + F.col("_j"), POOL_SALT)
    rows = rows.select("_chunk", "_j", first.alias("_r1"), second.alias("_r2"))
    parts_of = sentence_parts((F.col("_r1"), F.col("_r2")))
    rows = rows.select("_chunk", "_j", *[c.alias(f"_s{n}") for n, c in parts_of.items()])
    rows = rows.select("_chunk", "_j", sentence_from_parts({n: f"_s{n}" for n in parts_of}).alias("_sentence"))
    ordered = F.array_sort(F.collect_list(F.struct("_j", "_sentence")))
    pool = rows.groupBy("_chunk").agg(F.array_join(F.transform(ordered, lambda x: x["_sentence"]), " ").alias("_pool"))
    return pool.withColumn("_size", F.length("_pool"))


#: places of a comment's draws among a column's numbers
COMMENT_LENGTH, COMMENT_CHUNK, COMMENT_OFFSET = 100, 108, 116


def add_comment(df, column: str, row: State, stream: int, min_len: int, max_len: int, pool: Pool | None = None):
    """Add ``column``: a window of random length in [min, max] at a random offset
    of a randomly chosen pool chunk (I14).

    A small pool is broadcast (its number of chunks bounds its bytes) and the rows
    don't move; a larger one is a shuffle on both sides by the chunk, of which a task
    holds its share only. Chunks are drawn below the pool's own number of them.
    """
    pool = pool if pool is not None else text_pool(df.sparkSession)
    chunk = _h(stream, row, COMMENT_CHUNK) if pool.chunks < WIDE else wide_draw(row, position(stream, COMMENT_CHUNK - 64))
    want = _int(min_len, max_len, stream, row, COMMENT_LENGTH)
    tagged = df.withColumns({"_chunk": chunk % pool.chunks, "_want": want, "_salt": _h(stream, row, COMMENT_OFFSET)})
    joined = tagged.join(F.broadcast(pool.rows) if pool.chunks <= BROADCAST_CHUNKS else pool.rows.hint("shuffle_hash"), "_chunk")
    length = F.least("_want", "_size")
    offset = F.col("_salt") % (F.col("_size") - length + 1) + 1
    return (joined.withColumn(column, F.substring(F.col("_pool"), offset.cast("int"), length.cast("int")))
            .drop("_chunk", "_want", "_salt", "_pool", "_size"))
