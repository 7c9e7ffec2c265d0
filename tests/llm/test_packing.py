import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from shoal.llm import packing
from shoal.llm.packing import best_fit, best_fit_pack, encoder, local_search, pack
from shoal.llm.queries import tokenizer_path
from .helpers import awkward_texts, docs


def test_pieces_and_places(spark):
    from tokenizers import Tokenizer
    own = Tokenizer.from_file(tokenizer_path())
    rows = best_fit_pack(docs(spark), tokenizer_path(), seq_len=256, cell=32).collect()
    want = Counter()
    for i, t in awkward_texts():
        ids = np.array(own.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        n, lo, hi, p = len(ids), 0, (len(ids) - 1) % 256 + 1, 0
        while lo < n:
            want[(i, p, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes()))] += 1
            lo, hi, p = hi, hi + 256, p + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for ps in places.values():
        at = 0
        for offset, length in sorted(ps):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r.length for r in rows)
    assert len(places) <= -(-total // 256) * 1.03 + 1


def test_encoder_matches_library():
    from tokenizers import Tokenizer
    own, enc = Tokenizer.from_file(tokenizer_path()), encoder(tokenizer_path())
    for _, t in awkward_texts():
        assert enc.ids(t or "").tolist() == own.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(5))
def test_local_search_keeps_bins_and_empties_some(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 100, 300)
    bins, free = best_fit(sizes, 100)
    before = len(free)
    squares = ((100 - free) ** 2).sum()
    local_search(sizes, bins, free, 100)
    fill = np.bincount(bins, sizes, len(free)).astype(int)
    assert (fill == 100 - free).all() and fill.max() <= 100
    assert (fill > 0).sum() <= before and (fill ** 2).sum() >= squares


def test_exchanges_empty_a_bin():
    # no item of 3+2 can empty its bin by moves alone: 6 | 5+4 | 3+2 to 6+4 | 5+3+2
    sizes = np.array([6, 5, 4, 3, 2])
    bins, free = np.array([0, 1, 1, 2, 2]), np.array([4, 1, 5])
    local_search(sizes, bins, free, 10)
    assert (free < 10).sum() == 2


def test_empty_table(spark):
    assert best_fit_pack(docs(spark, []), tokenizer_path()).count() == 0


@pytest.mark.parametrize("lengths, sequences", [
    ([60] * 40, 40),                                    # each alone: no other piece can join it
    ([60] * 40 + [1] * 5, 40),                          # the short ones keep joining, no round saves a sequence
    ([60] * 20 + [40] * 20, 20),                        # pairs that only meet when their cells do
])
def test_pieces_that_never_fill_a_sequence_end_the_rounds(spark, monkeypatch, lengths, sequences):
    rounds = []

    def write(df, tag, release=False):
        rounds.append(tag)
        return packing_write(df, tag, release)

    packing_write = packing.write_table
    monkeypatch.setattr(packing, "write_table", write)
    table, _ = packing_write(spark.createDataFrame([(k, 0, 0, x, k) for k, x in enumerate(lengths)],
                                                   "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    rows = pack(table, len(lengths), 100, 8).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == list(enumerate(lengths))
    fill = Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 100 and len(fill) == sequences
    assert len(rounds) <= 12
