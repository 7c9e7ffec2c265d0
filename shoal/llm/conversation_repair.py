"""Conversation structure repair (operator 12): Knuth's lightest derivations over an agenda.

A conversation's rows, by turn, must become an optional system turn followed by
user and assistant turns in alternation. A row is kept (cost 0), given the role user or
assistant (1) or deleted (2); turns without text are inserted (5). Blank and
duplicate rows must go; a truncated row that stays costs 5 more. The cheapest repair
is wanted, of equally cheap ones that with the least audit, the string of its edits' initials.

Deductions of a weighted hypergraph:

* ``edit(i, e)``: row i emits e (s, u, a or nothing); axioms weigh its edits
* ``rest(i, p) <- edit(i, e), rest(i + 1, q)`` where the emission e leads from state p to q
* ``rest(i, p) <- rest(i, q)`` by an insertion that leads from p to q

A value is (cost, audit); a rule adds costs and joins audits from the left. Items leave the
agenda by (cost, rows derived, audit). Every rule raises that key above those of its
antecedents and keeps their order, so it is a superior function and an item's first
exit is its lightest derivation; the search ends when the goal items have left.
(Audit order alone would not do: a free Keep in front can lessen an audit.)

The rows are put in order once, by a range sort over (conversation, turn, role,
text) whose partitions number them; so one conversation may span many partitions.
Runs of at most ``BLOCK`` rows of a conversation are solved apart, in any task, for each pair of states
before and after the run: insertions go before a row, so of two audits of a run neither
is a prefix of the other, and their order survives what follows. The runs of a conversation are then
chained from its end (four costs and ranks, a few bytes kept per run), and each run's rows
edited in any task. Only ``digest``, whose SHA-256 and audit are of the whole conversation,
streams a conversation's repaired rows through one task, holding one batch.

Defined results: null role and text read as one space; null turns come first; rows of
one turn come by role, then text; equal rows are repeats, of which the first stays;
rows of a null id are one conversation; blanks are U+0020 and U+0009 to U+000D; a role
whose initial is not s, u or a can't be kept; very long texts pass through whole; other
columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.llm.common import drop_path, small_batches, write_table

BLOCK = 128
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: states: nothing yet; after a system turn; after a user turn; after an assistant turn
STATES = "SBAU"
STEP = {("S", "s"): "B", ("S", "u"): "A", ("B", "u"): "A", ("A", "a"): "U", ("U", "u"): "A", **{(p, ""): p for p in STATES}}
ENDS = "SU"
BACK = {q: [(p, e) for (p, e), to in STEP.items() if to == q] for q in STATES}
ROLE = {"u": "user", "a": "assistant"}


# -- the agenda ------------------------------------------------------------------


def edits_of(code: str) -> dict[str, tuple[int, str]]:
    """Emissions of a row and the lightest edit for each: lower case sound, upper case truncated, d must go."""
    found = {"": (DELETE, "D")}
    if code != "d":
        extra, own = TRUNCATED * code.isupper(), code.lower()
        found |= {e: (REROLE + extra, "R") for e in "ua"}
        if own in "sua":
            found[own] = (extra, "K")
    return found


def lightest(codes: str, end: str, goals: str) -> dict[str, tuple[int, str]]:
    """Lightest derivation (cost, audit) of rest(0, p) for the states p of ``goals``, where the run must end in state ``end``."""
    n = len(codes)
    edit: dict[tuple[int, str], tuple[int, str]] = {}
    rest: dict[tuple[int, str], tuple[int, str]] = {}
    # (cost, rows derived, audit, row, state or emission, is an edit)
    agenda = [(0, 0, "", n, end, False)]
    agenda += [(c, 0, a, i, e, True) for i, code in enumerate(codes) for e, (c, a) in edits_of(code).items()]
    heapq.heapify(agenda)
    wanted = set(goals)
    while agenda and wanted:
        cost, rows, audit, i, x, is_edit = heapq.heappop(agenda)
        done = edit if is_edit else rest
        if (i, x) in done:
            continue
        done[i, x] = cost, audit
        if is_edit:
            for p in STATES:
                after = rest.get((i + 1, STEP.get((p, x), "")))
                if after and (i, p) not in rest:
                    heapq.heappush(agenda, (cost + after[0], n - i, audit + after[1], i, p, False))
            continue
        if i == 0:
            wanted.discard(x)
        for p, e in BACK[x]:
            if e in ROLE and i < n and (i, p) not in rest:      # an insertion before row i
                heapq.heappush(agenda, (cost + INSERT, rows, "I" + audit, i, p, False))
            before = edit.get((i - 1, e))
            if before and (i - 1, p) not in rest:
                heapq.heappush(agenda, (before[0] + cost, rows + 1, before[1] + audit, i - 1, p, False))
    return {p: rest[0, p] for p in goals if (0, p) in rest}


@lru_cache(maxsize=4096)
def run_matrix(codes: str) -> tuple[tuple[str, str, int, str], ...]:
    """(state before, state after, cost, audit) of a run of rows."""
    return tuple((p, q, c, a) for q in STATES for p, (c, a) in sorted(lightest(codes, q, STATES).items()))


#: insertions after the last row, by the state there
TAILS = {"S": (0, ""), "U": (0, ""), "A": (INSERT, "I"), "B": (2 * INSERT, "II")}


# -- rows in order, faults ---------------------------------------------------------


def _has_words(text: Column) -> Column:
    return F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]"))


def ordered_rows(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text, id, run): ids in the order of the rows, runs of at most ``BLOCK`` rows of a conversation."""
    rows = conversations.select(F.col(f"`{id_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"),
                                *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))))
    rows = (rows.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv", "turn", "role", "text")
            .withColumn("id", F.monotonically_increasing_id()).withColumn("run", F.expr(f"id div {BLOCK}")))
    return write_table(rows, "turns", release=True)[0]


def coded(rows: DataFrame) -> DataFrame:
    """(conv, run, id, code): one letter per row, see ``edits_of``."""
    same = F.sha2(F.concat(F.col("conv").isNull().cast("string"), F.lit("|"), F.coalesce(F.col("conv").cast("string"), F.lit("")), F.lit("|"),
                           F.length("role").cast("string"), F.lit("|"), "role", "text"), 256)
    slim = rows.select("conv", "run", "id", same.alias("same"), F.substring("role", 1, 1).alias("initial"), _has_words(F.col("text")).alias("words"),
                       F.regexp_like("text", F.lit(r"[.!?][\x20\x09-\x0D]*\z")).alias("closed"))
    # first places of repeated rows only: counted map-side, a hot row is one row per task
    first = slim.groupBy("same").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("same", "first")
    first, _ = write_table(first, "repeats", release=True)
    own = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    code = F.when(~F.col("words") | (F.col("id") > F.coalesce("first", "id")), "d").when(F.col("closed"), own).otherwise(F.upper(own))
    return slim.join(first, "same", "left").select("conv", "run", "id", code.alias("code"))


# -- runs and chains ----------------------------------------------------------------

_CELL = pa.struct([("p", pa.string()), ("q", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])


def solve_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``cells``, the lightest repairs of each run between each pair of states."""
    for b in batches:
        cells = [[dict(zip(("p", "q", "cost", "audit"), c, strict=True)) for c in run_matrix(codes)] for codes in b.column("codes").to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.list_(_CELL))], names=[*b.schema.names, "cells"])


class _Chain:
    """The runs of one conversation, from its last to its first."""

    def __init__(self):
        self.cost = {q: c for q, (c, _) in TAILS.items()}
        order = sorted({a for _, a in TAILS.values()})
        self.rank = {q: order.index(a) for q, (_, a) in TAILS.items()}      # place of what follows among the states' audits
        self.runs: list[tuple[int, str, dict]] = []

    def add(self, run: int, codes: str, cells: list[dict]) -> None:
        best: dict[str, tuple[int, str, int, str]] = {}
        for c in cells:
            if c["q"] in self.cost:
                key = (c["cost"] + self.cost[c["q"]], c["audit"], self.rank[c["q"]], c["q"])
                best[c["p"]] = min(best.get(c["p"], key), key)
        order = sorted({k[1:3] for k in best.values()})
        self.cost, self.rank = {p: k[0] for p, k in best.items()}, {p: order.index(k[1:3]) for p, k in best.items()}
        self.runs.append((run, codes, {p: k[3] for p, k in best.items()}))

    def path(self) -> Iterator[tuple[int, str, str, str, str]]:
        """(run, codes, state before, state after, tail) from the first run to the last."""
        p = "S"
        for k, (run, codes, to) in enumerate(reversed(self.runs)):
            yield run, codes, p, to[p], TAILS[to[p]][1] if k + 1 == len(self.runs) else ""
            p = to[p]


def chain_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by conversation, the last first, to one row per run: its start state and its audit."""

    def out(conv, chain):
        found = list(chain.path())
        audits = [next(a for p, q, _, a in run_matrix(codes) if (p, q) == (s, e)) + tail for _, codes, s, e, tail in found]
        return pa.RecordBatch.from_arrays([pa.array([conv] * len(found), kind), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found]),
                                           pa.array([f[2] for f in found]), pa.array(audits)], names=["conv", "run", "codes", "state", "audit"])

    held, kind = None, None
    for b in batches:
        kind = b.schema.field("conv").type
        for r in b.to_pylist():
            if held is None or held[0] != r["conv"]:
                if held is not None:
                    yield out(*held)
                held = r["conv"], _Chain()
            held[1].add(r["run"], r["codes"], r["cells"])
    if held is not None:
        yield out(*held)


def edit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (conv, run, id), each run's decision (null id) before them, to edited rows."""
    audit, codes, state, k, row, left = "", "", "S", 0, 0, 0
    for b in batches:
        got = {n: [] for n in ("conv", "run", "pos", "turn", "role", "text", "code", "edit", "new_role", "new_text")}

        def add(r, letter, new_role, new_text, code):
            for n, v in (("conv", r["conv"]), ("run", r["run"]), ("pos", k), ("turn", r["turn"]), ("role", r["role"]), ("text", r["text"]),
                         ("code", code), ("edit", letter), ("new_role", new_role), ("new_text", new_text)):
                got[n].append(v)

        def insert(r):
            nonlocal state, k
            e = "a" if state == "A" else "u"
            add({**r, "turn": None, "role": None, "text": None}, "I", ROLE[e], "", None)
            state, k = STEP[state, e], k + 1

        for r in b.to_pylist():
            if r["id"] is None:
                audit, codes, state, k, row, left = r["audit"], r["codes"], r["state"], 0, 0, len(r["codes"])
                continue
            while audit[k] == "I":
                insert(r)
            letter, code = audit[k], codes[row]
            row, left = row + 1, left - 1
            e = "" if letter == "D" else code.lower() if letter == "K" else "a" if state == "A" else "u"
            add(r, letter, None if letter == "D" else r["role"] if letter == "K" else ROLE[e], None if letter == "D" else r["text"], code)
            state, k = STEP[state, e], k + 1
            while not left and k < len(audit):
                insert(r)
        types = [b.schema.field("conv").type, pa.int64(), pa.int64(), b.schema.field("turn").type, *[pa.string()] * 6]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(got.values(), types, strict=True)], names=list(got))


def repair(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Every row and every insertion with its edit: (conv, run, pos, turn, role, text, fault, edit, new_role, new_text).

    (run, pos) is the order within a conversation; ``edit`` is K, R, D or I; deleted rows have
    no new role and text, inserted ones no old.
    """
    small_batches(conversations.sparkSession)
    rows = ordered_rows(conversations, id_col, turn_col, role_col, text_col)
    conv, turn = rows.schema["conv"].dataType.simpleString(), rows.schema["turn"].dataType.simpleString()
    runs = coded(rows).groupBy("conv", "run").agg(F.sort_array(F.collect_list(F.struct("id", "code"))).alias("c"))
    runs = runs.select("conv", "run", F.expr("array_join(transform(c, x -> x.code), '')").alias("codes"))
    solved, solved_path = write_table(runs.mapInArrow(solve_runs, f"conv {conv}, run long, codes string, cells array<struct<p string, q string, cost long, audit string>>"),
                                      "runs", release=True)
    paths, _ = write_table(solved.repartition("conv").sortWithinPartitions("conv", F.desc("run"))
                           .mapInArrow(chain_runs, f"conv {conv}, run long, codes string, state string, audit string"), "paths", release=True)
    drop_path(conversations.sparkSession, solved_path)
    none = {"turn": turn, "role": "string", "text": "string", "id": "long"}
    decisions = paths.select("conv", "run", *(F.lit(None).cast(t).alias(n) for n, t in none.items()), "codes", "state", "audit")
    both = rows.select("conv", "run", *none, *(F.lit(None).cast("string").alias(n) for n in ("codes", "state", "audit"))).unionByName(decisions)
    edited = (both.repartition("conv", "run").sortWithinPartitions("conv", "run", "id")
              .mapInArrow(edit_rows, f"conv {conv}, run long, pos long, turn {turn}, role string, text string, code string, edit string, new_role string, new_text string"))
    fault = F.expr(r"CASE WHEN code IS NULL THEN NULL WHEN code = 'd' THEN IF(regexp_like(text, '[^\\x20\\x09-\\x0D]'), 'duplicate', 'blank') WHEN code = upper(code) THEN 'truncated' END")
    return edited.select("conv", "run", "pos", "turn", "role", "text", fault.alias("fault"), "edit", "new_role", "new_text")


# -- digests ------------------------------------------------------------------------

_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Digest:
    def __init__(self):
        self.n = dict.fromkeys(_COUNTS, 0)
        self.sha, self.empty, self.audit = hashlib.sha256(), True, []
        self.before = self.turn = self.low = None
        self.turns = 0

    def add(self, turn, role, fault, edit, new_role, new_text) -> None:
        self.audit.append(edit)
        self.n["cost"] += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + TRUNCATED * (fault == "truncated" and edit != "D")
        if fault:
            self.n[fault] += 1
        if edit != "I":
            if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
                self.n["illegal"] += 1
            self.before = role[:1]
            if turn is not None and turn != self.turn:
                self.low, self.turn, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if edit != "D":
            self.sha.update(b"" if self.empty else b"\n")
            self.sha.update(f"{new_role}:{new_text}".encode())
            self.empty = False

    def row(self) -> list:
        self.n["gaps"] = int(self.turn - self.low) + 1 - self.turns if self.turns else 0
        return [*self.n.values(), "".join(self.audit), self.sha.hexdigest()]


def digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for b in batches:
        kind, done = b.schema.field("conv").type, []
        cols = [b.column(c).to_pylist() for c in ("conv", "turn", "role", "fault", "edit", "new_role", "new_text")]
        for conv, *rest in zip(*cols, strict=True):
            if held is None or held[0] != conv:
                if held is not None:
                    done.append([held[0], *held[1].row()])
                held = conv, _Digest()
            held[1].add(*rest)
        if done:
            yield _digests(done, kind)
    if held is not None:
        yield _digests([[held[0], *held[1].row()]], kind)


def _digests(rows: list, kind) -> pa.RecordBatch:
    types = [kind, *[pa.int64()] * len(_COUNTS), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["conv", *_COUNTS, "audit", "repaired_sha256"])


def digest(repaired: DataFrame) -> DataFrame:
    """One row per conversation of ``repair``'s rows: counts of faults, cost, audit and SHA-256 of the repaired turns."""
    kind = repaired.schema["conv"].dataType.simpleString()
    return (repaired.select("conv", "run", "pos", F.col("turn").cast("long").alias("turn"), "role", "fault", "edit", "new_role", "new_text")
            .repartition("conv").sortWithinPartitions("conv", "run", "pos")
            .mapInArrow(digest_rows, f"conv {kind}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"))


# -- damage for the query -------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) with faults put in by crc32 of ``conv_id:turn`` modulo 20 (0 to 4: dropped, emptied, unpunctuated, repeated, made user)."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    return (conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
            .select("conv_id", "turn", F.expr("IF(kind = 4, 'user', role)").alias("role"),
                    F.expr("CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '') ELSE text END").alias("text"),
                    F.explode(F.expr("array_repeat(0, IF(kind = 3, 2, 1))")).alias("copy")).drop("copy"))


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Every conversation of the input: what its damaged rows hold and how they are repaired."""
    found = digest(repair(damaged(conversations)))
    ids = conversations.select("conv_id").distinct()
    nothing = {**dict.fromkeys(_COUNTS, F.lit(0).cast("long")), "audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    return (ids.join(found, ids["conv_id"].eqNullSafe(found["conv"]), "left")
            .select("conv_id", *(F.coalesce(F.col(c), v).alias(c) for c, v in nothing.items())))
