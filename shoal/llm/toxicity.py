"""Toxicity by weak supervision (operator 3).

Voters look at a text and vote toxic, clean, or abstain: lexicons by theme,
lexicons mined from labelled training rows, and patterns (an insult near "you",
many insults, masked spellings, shouting, or at most one lexicon word and that not in
a theme and mined too). A
generative label model explains the votes of all training documents by a hidden
class: each voter's accuracy, and the correlations of voters as a tree of
dependences given the class (each voter may lean on one other), fitted by EM on
the counts of vote patterns. Its posteriors are the labels of a linear
classifier on words and votes, and that scores every text.

Labels serve to mine lexicons and the class prior, on at most ``SAMPLE`` labelled rows;
label model counts and scores cover all documents. Vote patterns are at most
2^12, so counting them is one short row per pattern and task.

Defined results: null text is the empty text; texts without words get the score
of a text in which no voter and no word speaks; rows with equal ids are scored
each; duplicate labels of an id count as toxic if one does; null labels and
labels without a document are ignored; without labelled rows the lexicons and a
prior of ``PRIOR`` remain; very long texts are scored whole; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.common import WORD_ALNUM, bounded_rows, hash_words, row_chunks, small_batches, text_buffer
from shoal.llm.linear import fit_logistic, per_row, sigmoid

SAMPLE = 8000
PRIOR = 0.1
MINED = 256
WORDS = 320

#: Themes of common English insults.
LEXICONS = {
    "intellect": "idiot idiots idiotic stupid stupidity moron morons moronic dumb dumbass imbecile fool foolish retard retarded brainless halfwit dimwit",
    "worth": "worthless loser losers pathetic useless failure nobody garbage trash trashy rubbish scum scumbag filth vermin pig pigs",
    "ridicule": "clown clowns joke laughable ridiculous freak freaks weirdo creep creeps coward cowards liar liars fraud",
    "disgust": "disgusting disgust gross vile sick sickening nasty filthy ugly hideous repulsive revolting hate hateful despise",
    "profanity": "damn hell crap shit shitty bullshit bitch bitches bastard bastards asshole fuck fucking fucker cunt dick whore slut",
}
ADDRESS = "you your youre u ur yourself"
MASKS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

VOTERS = [*LEXICONS, "mined_a", "mined_b", "many", "addressed", "masked", "shouting", "few"]
CLEAN_VOTER = len(VOTERS) - 1


@lru_cache(maxsize=None)
def _hashes(words: str) -> np.ndarray:
    data = words.encode()
    buf = np.frombuffer(data, np.uint8)
    return np.sort(hash_words(buf, np.array([0, len(buf)]), 0, 1, WORD_ALNUM)[0])


def _isin(h: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_) or not len(h):
        return np.zeros(len(h), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, h), len(sorted_) - 1)] == h


_MASK = np.arange(256, dtype=np.uint8)
for _k, _v in MASKS.items():
    _MASK[ord(_k)] = ord(_v)
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_MASK_WORD = WORD_ALNUM.copy()
_MASK_WORD[[ord(k) for k in MASKS if not k.isdigit()]] = True


def votes(data: np.ndarray, offsets: np.ndarray, i: int, j: int, mined: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, voters) booleans: who votes (the last voter votes clean, the others toxic); and word hashes with their rows."""
    h, first, _, _ = hash_words(data, offsets, i, j, WORD_ALNUM)
    n = j - i
    doc = np.repeat(np.arange(n), np.diff(first))
    out = np.zeros((n, len(VOTERS)), bool)
    insult = np.zeros(len(h), bool)
    for k, words in enumerate(LEXICONS.values()):
        hit = _isin(h, _hashes(words))
        insult |= hit
        out[:, k] = per_row(hit, first) > 0
    at = len(LEXICONS)
    themed, agreed = insult.copy(), np.zeros(len(h), bool)
    for k, words in enumerate(mined):
        hit = _isin(h, words)
        insult |= hit
        agreed |= hit & themed
        out[:, at + k] = per_row(hit, first) > 0
    at += 2
    order = np.lexsort((h[insult], doc[insult]))
    hd, hh = doc[insult][order], h[insult][order]
    new = np.r_[True, (hd[1:] != hd[:-1]) | (hh[1:] != hh[:-1])] if len(hd) else np.zeros(0, bool)
    distinct = np.bincount(hd[new], minlength=n)
    out[:, at] = distinct >= 3
    you = _isin(h, _hashes(ADDRESS))
    near = np.zeros(len(h), bool)
    for back in (1, 2, 3):
        if len(h) > back:
            near[back:] |= insult[back:] & you[:-back] & (doc[back:] == doc[:-back])
            near[:-back] |= insult[:-back] & you[back:] & (doc[back:] == doc[:-back])
    out[:, at + 1] = per_row(near, first) > 0
    base, end = int(offsets[i]), int(offsets[j])
    raw, rel = data[base:end], offsets[i:j + 1] - base
    if (_MASK[raw] != raw).any():
        mh, mf, _, _ = hash_words(_MASK[raw], rel, 0, n, _MASK_WORD)
        lexicon = _hashes(" ".join(LEXICONS.values()))
        out[:, at + 2] = per_row(_isin(mh, lexicon), mf) > per_row(_isin(h, lexicon), first)
    upper, letters, bangs = (per_row(m, rel) for m in (_UPPER[raw], _LETTER[raw], raw == 0x21))
    out[:, at + 3] = (letters > 20) & (2 * upper > letters) & (bangs > 2)
    out[:, CLEAN_VOTER] = (distinct < 2) & (per_row(agreed, first) == 0) & ~out[:, at + 1:at + 3].any(axis=1)
    return out, h, doc


def _pattern(v: np.ndarray) -> np.ndarray:
    return v @ (1 << np.arange(len(VOTERS)))


class LabelModel:
    """Hidden class with tree-dependent voters, by EM on pattern counts."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, prior: float, rounds: int = 60):
        self.votes = ((patterns[:, None] >> np.arange(len(VOTERS))) & 1).astype(int)
        self.index = {int(p): k for k, p in enumerate(patterns)}
        n = counts.astype(float)
        said = self.votes[:, :CLEAN_VOTER].sum(axis=1)
        post = np.where(said > 1, 0.9, np.where(said == 1, 0.3, 0.02))
        self.parent = [-1] * len(VOTERS)
        self.prior = prior
        for step in range(rounds):
            if step == rounds // 3:
                self.parent = self._tree(post, n)
            self._maximise(post, n, prior)
            new = sigmoid(self._log_odds())
            if step > rounds // 3 and np.abs(new - post).max() < 1e-6:
                break
            post = new
        self.posterior = post
        self.accuracy = [float((n * np.where(self.votes[:, j] == 1, post if j != CLEAN_VOTER else 1 - post, 0)).sum()
                               / max(1e-9, (n * self.votes[:, j]).sum())) for j in range(len(VOTERS))]

    def _maximise(self, post: np.ndarray, n: np.ndarray, prior: float) -> None:
        """Tables P(vote | parent's vote, class) with half a count of smoothing; the prior leans on the labels' share."""
        pseudo = 100.0
        self.prior = float(((n * post).sum() + pseudo * prior) / (n.sum() + pseudo))
        self.table = np.zeros((len(VOTERS), 2, 2, 2))              # voter, parent's vote, class, vote
        for j, p in enumerate(self.parent):
            up = self.votes[:, p] if p >= 0 else np.zeros(len(n), int)
            for y, w in ((1, n * post), (0, n * (1 - post))):
                for u in (0, 1):
                    for v in (0, 1):
                        self.table[j, u, y, v] = w[(up == u) & (self.votes[:, j] == v)].sum() + 0.5
            self.table[j] /= self.table[j].sum(axis=2, keepdims=True)

    def _log_odds(self) -> np.ndarray:
        out = np.full(len(self.votes), np.log(self.prior / (1 - self.prior)))
        for j, p in enumerate(self.parent):
            up = self.votes[:, p] if p >= 0 else np.zeros(len(out), int)
            out += np.log(self.table[j, up, 1, self.votes[:, j]]) - np.log(self.table[j, up, 0, self.votes[:, j]])
        return out

    def _tree(self, post: np.ndarray, n: np.ndarray, least: float = 1e-3) -> list[int]:
        """Chow-Liu forest: strongest mutual information of two voters given the class, above ``least``."""
        m = len(VOTERS)
        edges = []
        for a in range(m):
            for b in range(a):
                info = 0.0
                for w in (n * post, n * (1 - post)):
                    joint = np.array([[w[(self.votes[:, a] == x) & (self.votes[:, b] == z)].sum() for z in (0, 1)] for x in (0, 1)]) + 1e-9
                    joint /= n.sum() + 1e-9
                    flat = joint.sum(axis=1, keepdims=True) @ joint.sum(axis=0, keepdims=True) / joint.sum()
                    info += float((joint * np.log(joint / flat)).sum())
                edges.append((info, a, b))
        near: list[list[int]] = [[] for _ in range(m)]
        group = list(range(m))
        for info, a, b in sorted(edges, reverse=True):
            if info >= least and group[a] != group[b]:
                near[a].append(b)
                near[b].append(a)
                group = [group[a] if g == group[b] else g for g in group]
        parent, seen = [-1] * m, set()
        for root in range(m):
            stack = [root] if root not in seen else []
            while stack:
                x = stack.pop()
                seen.add(x)
                for z in near[x]:
                    if z not in seen:
                        parent[z] = x
                        stack.append(z)
        return parent

    def label(self, patterns: np.ndarray) -> np.ndarray:
        """Posterior by pattern; a pattern that no training document had is labelled by the tables too."""
        fresh = [int(p) for p in np.unique(patterns) if int(p) not in self.index]
        if fresh:
            kept = self.votes
            self.votes = ((np.array(fresh)[:, None] >> np.arange(len(VOTERS))) & 1).astype(int)
            extra = dict(zip(fresh, sigmoid(self._log_odds())))
            self.votes = kept
        return np.array([self.posterior[self.index[int(p)]] if int(p) in self.index else extra[int(p)] for p in patterns])


def _sample(docs: DataFrame, labels: DataFrame, train: "F.Column", id_col: str, label_col: str, sample: int,
            mined: tuple) -> tuple[list, np.ndarray, np.ndarray]:
    """(distinct word hashes of each, labels, vote patterns) of at most ``sample`` labelled training documents, rows as well as ids."""
    chosen = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
              .groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample))
    rows = bounded_rows(docs.filter(train).join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("id", "y", "text"), sample)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_buffer(b.column("text"))
            out, pattern = [], []
            for i, j in row_chunks(offsets):
                v, h, doc = votes(data, offsets, i, j, mined)
                cuts = np.searchsorted(doc, np.arange(j - i + 1))
                out += [np.unique(h[a:z]).view(np.int64) for a, z in zip(cuts[:-1], cuts[1:])]
                pattern += _pattern(v).tolist()
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(pattern, pa.int64()), pa.array(out, pa.list_(pa.int64())), b.column("row")], ["y", "p", "h", "row"])

    got = rows.mapInArrow(words, "y int, p long, h array<long>, row long").toArrow().sort_by("row")     # not the order of arrival
    got = got.combine_chunks()
    sets = [np.asarray(x.values.to_numpy(zero_copy_only=False), np.int64).view(np.uint64) for x in got.column("h")]
    return sets, got.column("y").to_numpy().astype(int), got.column("p").to_numpy().astype(np.int64)


def _association(sets: list, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, z score of the difference of shares, documents with the word, of them weight in the class)."""
    if not sets or not sum(map(len, sets)):
        z = np.zeros(0)
        return np.zeros(0, np.uint64), z, z, z
    flat = np.concatenate(sets)
    w = np.repeat(y.astype(float), [len(s) for s in sets])
    words, at = np.unique(flat, return_inverse=True)
    n, n1 = np.bincount(at).astype(float), np.bincount(at, w)
    total, total1 = float(len(y)), float(y.sum())
    a, b = n1 / max(1.0, total1), (n - n1) / max(1.0, total - total1)
    p = n / total
    se = np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / max(1.0, total1) + 1 / max(1.0, total - total1)))
    return words, (a - b) / se, n, n1


class Scorer:
    """The fitted linear classifier: what a task needs to score texts."""

    def __init__(self, mined: tuple, words: np.ndarray, weights: np.ndarray):
        order = np.argsort(words)
        self.mined, self.words = mined, words[order]
        self.word_weights, self.vote_weights, self.bias = weights[:len(words)][order], weights[len(words):-1], float(weights[-1])

    def scores(self, data: np.ndarray, offsets: np.ndarray, i: int, j: int) -> np.ndarray:
        v, h, doc = votes(data, offsets, i, j, self.mined)
        z = v @ self.vote_weights + self.bias
        hit = _isin(h, self.words)
        if hit.any():
            k = np.searchsorted(self.words, h[hit])
            pair = np.unique(doc[hit].astype(np.int64) * len(self.words) + k)
            np.add.at(z, pair // len(self.words), self.word_weights[pair % len(self.words)])
        return sigmoid(z)


def fit(docs: DataFrame, labels: DataFrame, train: "F.Column", id_col: str = "doc_id", label_col: str = "toxic",
        sample: int = SAMPLE) -> tuple[Scorer, LabelModel]:
    """``docs`` (doc_id, text): learn from rows where ``train`` holds."""
    small_batches(docs.sparkSession)
    nothing = (np.zeros(0, np.uint64),) * 2
    sets, y, _ = _sample(docs, labels, train, id_col, label_col, sample, nothing)
    prior = float(np.clip(y.mean(), 0.005, 0.5)) if len(y) and 0 < y.sum() < len(y) else PRIOR
    words, z, n, n1 = _association(sets, y)
    strong = np.flatnonzero((z > 5) & (n1 >= 5) & (n1 >= 0.7 * n))
    strong = strong[np.argsort(-z[strong], kind="stable")][:MINED]
    mined = tuple(np.sort(words[strong[k::2]]) for k in (0, 1))

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_buffer(b.column("text"))
            got = [_pattern(votes(data, offsets, i, j, mined)[0]) for i, j in row_chunks(offsets)]
            if got:
                p, c = np.unique(np.concatenate(got), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int64)), pa.array(c.astype(np.int64))], ["p", "c"])

    table = docs.filter(train).select("text").mapInArrow(patterns, "p long, c long").groupBy("p").agg(F.sum("c").alias("c")).toArrow()
    p, c = table.column("p").to_numpy(), table.column("c").to_numpy()
    order = np.argsort(p)
    model = LabelModel(p[order].astype(np.int64), c[order], prior) if len(p) else LabelModel(np.array([1 << CLEAN_VOTER]), np.array([1]), prior)

    # the classifier's rows: the sample's words and votes, with posterior labels; every pattern seen, without words
    sets, _, pattern = _sample(docs, labels, train, id_col, label_col, sample, mined)
    target = model.label(pattern)
    known, zt, nt, _ = _association(sets, target)
    top = np.flatnonzero((np.abs(zt) > 4.5) & (nt >= 5))
    top = np.sort(known[top[np.argsort(-np.abs(zt[top]), kind="stable")][:WORDS]])
    x = np.zeros((len(sets) + len(p), len(top)))
    for k, s in enumerate(sets):
        x[k, np.searchsorted(top, s[_isin(s, top)])] = 1
    v = ((np.r_[pattern, p[order]].astype(np.int64)[:, None] >> np.arange(len(VOTERS))) & 1).astype(float)
    target = np.r_[target, model.label(p[order].astype(np.int64))]
    if not len(v):
        v, x, target = np.zeros((1, len(VOTERS))), np.zeros((1, len(top))), np.array([prior])
    return Scorer(mined, top, fit_logistic(np.hstack([x, v]), target, l2=2.0)), model


def score(docs: DataFrame, labels: DataFrame, held_out: "F.Column", id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. ``held_out``: a condition on ``doc_id``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = F.coalesce(held_out, F.lit(False))
    scorer, _ = fit(rows, labels, ~held, id_col, label_col, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_buffer(b.column("text"))
            s = [scorer.scores(data, offsets, i, j) for i, j in row_chunks(offsets)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(np.concatenate(s) if s else np.zeros(0))],
                                             ["doc_id", "held_out", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return (rows.select("doc_id", held.alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
