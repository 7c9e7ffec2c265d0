"""Tables with the cases every operator must stand: nulls, empty and long texts, repeats, clashing columns."""

import random
import re

from pyspark.sql import types as T

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANKS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: names that operators use inside, as extra columns of the input
CLASHES = ["id", "th", "h", "node", "root", "part", "c0", "n0", "k1", "spans", "segment", "held_out", "score", "key", "p", "v",
           "quality", "__own_dedup", "__own_th", "__own_id", "__own_hit"]

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                     *(T.StructField(c, T.StringType()) for c in CLASHES)])


def prose(rng: random.Random, n: int, words: int = 400) -> str:
    vocabulary = [f"w{k}" for k in range(words)]
    return " ".join(rng.choice(vocabulary) + (".\n" if rng.random() < 0.1 else "") for _ in range(n))


def awkward_texts(seed: int = 7) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    base = prose(rng, 120)
    rows: list[tuple[int | None, str | None]] = [(k, prose(rng, rng.randint(3, 200))) for k in range(20)]
    rows += [(20, None), (21, ""), (22, " \n\t "), (23, "One two"), (24, "ONE two"), (25, "x" * 3000)]
    rows += [(26, base), (27, base), (28, base + " tail end"), (28, "another text of the same id entirely"), (29, base), (29, base)]
    rows += [(None, "a text without an id at all here"), (None, None), (None, base + " tail end")]
    rows += [(30, "日本語のテキスト と 言葉 naïve café ПРИВЕТ мир"), (31, "tab\x0bvertical\x0cform\x1cunit\x85next nbsp"), (32, "<|endoftext|> ends")]
    rows += [(33, prose(rng, 30000))]
    return rows


def docs(spark, rows=None):
    rows = awkward_texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 3 else None, f"src{(i or 0) % 4}", len(t) if t else None,
                                   *(f"{c}!" for c in CLASHES)) for i, t in rows], DOCS)


def blank_words(text):
    return BLANKS.findall((text or "").translate(LOWER))


def alnum_words(text):
    return ALNUM.findall((text or "").translate(LOWER))
