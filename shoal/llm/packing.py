"""Best-fit packing of documents into fixed-length token sequences (operator 1).

1. Tokenise once: one row per piece (id, place, length, checksum), written to
   the shared folder. A document is its token ids and one end id; only longer
   ones are cut, so that the first piece takes the remainder and the others are
   full. A full piece is a sequence of its own.
2. The other pieces are dealt evenly by row number into cells of at most about
   ``cell`` pieces, so neither a hot id nor a hot source makes a large cell.
   Each cell is packed best-fit decreasing, then improved by local search:
   move, one-for-one and two-for-one exchanges from the emptiest bin into other
   underfull bins. Each exchange raises the sum of squared fills, so the search
   ends; bins that run empty are gone.
3. Bins filled below ``good`` of the length hand their pieces to the next round,
   which deals them anew into as many cells as they need, until one cell packs the
   last of them. A piece alone in its bin that even the shortest piece handed on
   can't join stays there. The rounds end when ``IDLE`` deals in a row save no
   sequence: the bins of the last round that did, which are valid sequences, are
   then final. There are at most ``ROUNDS``.

Defined results: null text is the empty text (one end id); rows with the same
id are separate documents; an empty table gives no rows; other columns of the
input are ignored, whatever their names. A null id stays null.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.common import drop_path, small_batches, write_table

SEQ_LEN = 2048
CELL = 16384
GOOD = 0.97
IDLE = 2
ROUNDS = 64                                       # a round's number has 7 bits of a sequence_id
END_ID = 0


class Encoder:
    """Token ids of a byte-level BPE vocabulary file, as little-endian uint32 bytes.

    Texts in Latin letters go through the faster of the two libraries with the
    ranks read from the same file; texts with other letters or with a special
    token's string go through the file's own library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        spec = json.load(open(path, encoding="utf-8"))
        self.own = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = None
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if (model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                and not pre.get("add_prefix_space") and not spec.get("normalizer")
                and not model.get("dropout") and not model.get("ignore_merges")):
            import tiktoken
            import public_tokenizers
            visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
            hidden = [b for b in range(256) if b not in set(visible)]
            back = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
            ranks = {bytes(back[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
            self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if (self.fast is not None and (text.isascii() or max(text) < "ɐ")
                and not any(s in text for s in self.special)):
            return np.asarray(self.fast.encode_ordinary(text), dtype="<u4")
        return np.asarray(self.own.encode(text, add_special_tokens=False).ids, dtype="<u4")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, seq_len: int = SEQ_LEN, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of at most ``seq_len`` tokens."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for k, text in enumerate(b.column("text")):
                text = text.as_py() or ""
                raw = memoryview(enc.ids(text).tobytes() + end if text else end)
                n = len(raw) // 4
                lo, hi, p = 0, (n - 1) % seq_len + 1, 0
                while lo < n:
                    at.append(k)
                    piece.append(p)
                    start.append(lo)
                    length.append(hi - lo)
                    crc.append(zlib.crc32(raw[4 * lo:4 * hi]))
                    lo, hi, p = hi, hi + seq_len, p + 1
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(cut, PIECES.format(id=rows.schema["doc_id"].dataType.simpleString()))


def best_fit(sizes: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin of each item, free room of each bin)."""
    bins = np.zeros(len(sizes), np.int64)
    free: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(cap + 1)]
    rooms = 0                                     # bit r: some bin has room r
    for k in np.argsort(-sizes, kind="stable"):
        x = int(sizes[k])
        fit = rooms >> x
        if fit:
            room = (fit & -fit).bit_length() - 1 + x
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = cap, len(free)
            free.append(cap)
        bins[k] = b
        free[b] = room - x
        if free[b]:
            by_room[free[b]].append(b)
            rooms |= 1 << free[b]
    return bins, np.array(free, np.int64)


def local_search(sizes: np.ndarray, bins: np.ndarray, free: np.ndarray, cap: int, patience: int = 12) -> None:
    """Empty the least filled bins in place by moves and exchanges that raise squared fill.

    A donor's item x goes to another bin (move), or against one or two smaller
    items there (one-for-one, two-for-one), or two of its items against one:
    always the exchange that leaves the least room. What moves is net load from
    the emptier to the fuller bin, so the sum of squares strictly grows. After
    ``patience`` donors in a row that can't be emptied the search ends.
    """
    n = len(sizes)
    order = np.argsort(bins, kind="stable")
    first = np.flatnonzero(np.r_[True, bins[order][1:] != bins[order][:-1]]) if n else np.zeros(0, int)
    pi, pj = [], []
    for lo, hi in zip(first, np.r_[first[1:], n]):
        items = order[lo:hi]
        if 2 <= len(items) <= 12 and free[bins[items[0]]] > 0:
            a, c = np.triu_indices(len(items), 1)
            pi.append(items[a])
            pj.append(items[c])
    pi = np.concatenate(pi) if pi else np.zeros(0, int)
    pj = np.concatenate(pj) if pj else np.zeros(0, int)
    pair = sizes[pi] + sizes[pj]
    least = -(-int(sizes.sum()) // cap)
    alive, failed, tried = len(free), 0, set()
    while alive > least and failed < patience:
        fill = cap - free
        cand = np.flatnonzero((fill > 0) & (free > 0))
        cand = cand[[b not in tried for b in cand]] if tried else cand
        if not len(cand):
            break
        t = int(cand[np.argmin(fill[cand])])
        while True:
            own = np.flatnonzero(bins == t)
            if not len(own):
                break
            best = None                          # (room left, kind, donor items, partner items)
            room = np.where((free < cap) & (np.arange(len(free)) != t) & (free <= free[t]), free, -1)
            item_room, same = room[bins], bins[pi] == bins[pj]
            pair_room = np.where(same, room[bins[pi]], -1)
            for k in own:
                x = int(sizes[k])
                fits = np.flatnonzero(room >= x)
                if len(fits):
                    b = fits[np.argmin(room[fits])]
                    best = (-1, "move", (k,), (), int(b))
                    break
                for kind, less, left in (("one", sizes, item_room), ("two", pair, pair_room)):
                    gain = x - less
                    ok = np.flatnonzero((gain > 0) & (gain <= left))
                    if len(ok):
                        o = ok[np.argmin(left[ok] - gain[ok])]
                        rest = int(left[o] - gain[o])
                        if best is None or rest < best[0]:
                            with_ = (int(o),) if kind == "one" else (int(pi[o]), int(pj[o]))
                            best = (rest, kind, (k,), with_, int(bins[with_[0]]))
            if best is None and 2 <= len(own) <= 12:
                for a in range(len(own)):
                    for c in range(a + 1, len(own)):
                        gain = int(sizes[own[a]] + sizes[own[c]]) - sizes
                        ok = np.flatnonzero((gain > 0) & (gain <= item_room))
                        if len(ok):
                            o = int(ok[np.argmin(item_room[ok] - gain[ok])])
                            rest = int(item_room[o] - gain[o])
                            if best is None or rest < best[0]:
                                best = (rest, "swap2", (own[a], own[c]), (o,), int(bins[o]))
            if best is None:
                break
            _, _, give, take, b = best
            net = int(sum(sizes[k] for k in give) - sum(sizes[k] for k in take))
            for k in give:
                bins[k] = b
            for k in take:
                bins[k] = t
            free[b] -= net
            free[t] += net
            tried.clear()                        # what was stuck before may move now
        if free[t] == cap:
            alive -= 1
            failed = 0
        else:
            failed += 1
            tried.add(t)


def _cell_packer(base: list[str], seq_len: int, level: int, good: float):
    """The function that packs one cell: best fit, local search, numbers and places."""

    def fill(cell: pa.Table) -> pa.Table:
        num = [cell.column(c).to_numpy() for c in ("ids_crc32", "start", "length")]
        cell = cell.take(pa.array(np.lexsort((num[0], num[1], -num[2]))))
        sizes = cell.column("length").to_numpy().astype(np.int64)
        bins, free = best_fit(sizes, seq_len)
        local_search(sizes, bins, free, seq_len)
        weak = (seq_len - free[bins]) < good * seq_len
        alone = np.bincount(bins)[bins] == 1
        used = np.unique(bins, return_inverse=True)[1]
        order = np.argsort(used, kind="stable")
        sizes, used = sizes[order], used[order]
        end = np.cumsum(sizes)
        begin = np.r_[True, used[1:] != used[:-1]]
        offset = end - sizes - np.maximum.accumulate(np.where(begin, end - sizes, 0))
        number = (level << 56) + (int(cell.column("_cell")[0].as_py()) << 20) + used.astype(np.int64)
        return pa.table([*(cell.column(c).take(pa.array(order)) for c in base), pa.array(number), pa.array(offset),
                         pa.array(weak[order]), pa.array(alone[order])], [*base, "sequence_id", "offset", "_open", "_alone"])

    return fill


def pack(table: DataFrame, n: int, seq_len: int = SEQ_LEN, cell: int = CELL, good: float = GOOD) -> DataFrame:
    """Add sequence_id and offset to a written table of ``n`` pieces (see the module text)."""
    spark = table.sparkSession
    base = table.columns
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    full = (table.filter(F.col("length") >= seq_len)
            .withColumn("sequence_id", -F.monotonically_increasing_id() - 1).withColumn("offset", F.lit(0).cast("long")))
    rest = table.filter(F.col("length") < seq_len)
    out, level, left = [full], 0, n
    held, held_bins, idle = None, 0, 0            # weak bins of the last round that saved any, rounds since then

    while True:
        cells = max(1, -(-left // cell))
        last = cells == 1 or level == ROUNDS - 1
        dealt = rest.withColumn("_cell", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(level)), F.lit(cells)))

        done, path = write_table(dealt.groupBy("_cell").applyInArrow(
            _cell_packer(base, seq_len, level, 0.0 if last else good),
            f"{kind}, sequence_id long, offset long, _open boolean, _alone boolean"), "packed")
        if held is not None and done.filter("offset = 0").count() >= held_bins:
            drop_path(spark, path)
            idle += 1
            if last or idle == IDLE:
                out.append(held)
                break
            level += 1
            continue
        idle = 0
        out.append(done.filter("not _open").drop("_open", "_alone"))
        if last:
            break
        least = done.filter("_open").agg(F.min("length")).first()[0]
        if least is None:
            break
        stuck = F.col("_alone") & (F.col("length") > seq_len - least)
        out.append(done.filter(F.col("_open") & stuck).drop("_open", "_alone"))
        held = done.filter(F.col("_open") & ~stuck).drop("_open", "_alone")
        left, held_bins = held.agg(F.count("*"), F.count_if(F.col("offset") == 0)).first()
        if not left:
            break
        rest = held.select(*base)
        level += 1
    packed = out[0]
    for part in out[1:]:
        packed = packed.unionByName(part)
    return packed


def best_fit_pack(docs: DataFrame, tokenizer: str, seq_len: int = SEQ_LEN, cell: int = CELL,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack whole documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    table, _ = write_table(pieces(docs, tokenizer, seq_len, id_col=id_col, text_col=text_col), "pieces")
    return pack(table, table.filter(F.col("length") < seq_len).count(), seq_len, cell)
