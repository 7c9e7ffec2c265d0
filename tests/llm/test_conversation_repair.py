"""Conversation repair against exhaustive search and a plain repair in Python."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import types as T

from shoal.llm import conversation_repair as C
from tests.llm.helpers import CLASHES

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                       *(T.StructField(c, T.StringType()) for c in ("role", "text", *CLASHES))])
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def every_repair(codes):
    """All audits with at most three insertions: (cost, audit) of those whose roles fit."""
    found = []
    n = len(codes)
    for length in range(n, n + 4):
        for audit in itertools.product("DIKR", repeat=length):
            if length - audit.count("I") != n:
                continue
            states, row = {("", 0)}, 0                       # (initials, cost)
            for x in audit:
                if x == "I":
                    states = {(o + e, c + 5) for o, c in states for e in "ua"}
                    continue
                code, row = codes[row], row + 1
                if x == "D":
                    states = {(o, c + 2) for o, c in states}
                elif code == "d":
                    states = set()
                elif x == "K":
                    states = {(o + code.lower(), c + 5 * code.isupper()) for o, c in states}
                else:
                    states = {(o + e, c + 1 + 5 * code.isupper()) for o, c in states for e in "ua"}
                states = {(o, c) for o, c in states if re.fullmatch("s?(ua)*u?", o)}
            found += [(c, "".join(audit)) for o, c in states if re.fullmatch("(s?(ua)+)?", o)]
    return min(found)


@pytest.mark.parametrize("codes", ["", "d", "s", "ua", "au", "aau", "suua", "UA", "xUd", "ss", "uUa", "Sax", "uad", "auau", "Aua", "aaS"])
def test_agenda_finds_the_lightest_of_all_repairs(codes):
    chain = C._Chain()
    if codes:
        chain.add(0, codes, [dict(zip(("p", "q", "cost", "audit"), c, strict=True)) for c in C.run_matrix(codes)])
        (_, _, s, e, tail), = chain.path()
        audit = next(a for p, q, _, a in C.run_matrix(codes) if (p, q) == (s, e)) + tail
        assert (chain.cost["S"], audit) == every_repair(codes)
    else:
        assert every_repair(codes) == (0, "")


def plain(codes):
    """(cost, audit) by a recursion from the front over whole suffixes."""
    @lru_cache(maxsize=None)
    def best(i, p, inserted):
        out = [(0, "")] if i == len(codes) and p in "SU" else []
        for e in "ua" if inserted < 2 else "":
            if (p, e) in C.STEP:
                c, a = best(i, C.STEP[p, e], inserted + 1)
                out.append((c + 5, "I" + a))
        if i < len(codes):
            code = codes[i]
            c, a = best(i + 1, p, 0)
            out.append((c + 2, "D" + a))
            for e in "sua" if code != "d" else "":
                if (p, e) in C.STEP and (e == code.lower() or e != "s"):
                    c, a = best(i + 1, C.STEP[p, e], 0)
                    out.append((c + 5 * code.isupper() + (e != code.lower()), ("K" if e == code.lower() else "R") + a))
        return min(out, default=(10**9, ""))
    for i in reversed(range(len(codes))):               # from the end, so that the recursion stays shallow
        for p in C.STATES:
            best(i, p, 0)
    return best(0, "S", 0)


def test_chained_runs_equal_one_run():
    rng = random.Random(5)
    for _ in range(60):
        codes = "".join(rng.choice("uauauaUAsxSd") for _ in range(rng.randint(1, 40)))
        size = rng.choice([1, 2, 3, 7])
        chain = C._Chain()
        runs = [codes[k:k + size] for k in range(0, len(codes), size)]
        for k in reversed(range(len(runs))):
            chain.add(k, runs[k], [dict(zip(("p", "q", "cost", "audit"), c, strict=True)) for c in C.run_matrix(runs[k])])
        audit = "".join(next(a for p, q, _, a in C.run_matrix(c) if (p, q) == (s, e)) + tail for _, c, s, e, tail in chain.path())
        assert (chain.cost["S"], audit) == plain(codes)


def expected(rows):
    """The contract, conversation by conversation."""
    out, convs = {}, defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        convs[conv] += [] if kind == 0 else [(turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)] * (1 + (kind == 3))
    for conv, got in convs.items():
        got.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, codes, n = set(), "", dict.fromkeys(C._COUNTS, 0)
        for turn, role, text in got:
            fault = "blank" if not BLANK.search(text) else "duplicate" if (role, text) in seen else "truncated" if BLANK.findall(text)[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            own = role[:1] if role[:1] in ("s", "u", "a") else "x"
            codes += "d" if fault in ("blank", "duplicate") else own.upper() if fault else own
        turns = [t for t, _, _ in got if t is not None]
        n["gaps"] = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        n["illegal"] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(got, got[1:], strict=False))
        n["cost"], audit = plain(codes)
        state, left, lines = "S", iter(got), []
        for x in audit:
            _, role, text = (None, None, "") if x == "I" else next(left)
            if x != "D":
                e = role[:1] if x == "K" else "a" if state == "A" else "u"
                lines.append(f"{role if x == 'K' else C.ROLE[e]}:{text}")
                state = C.STEP[state, e]
        out[conv] = (*n.values(), audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(seed=11):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["system", "user", "assistant"]) if turn == 0 or rng.random() < 0.2 else ("user", "assistant")[turn % 2]
            text = rng.choice(["Ok.", "Yes!", " \t", "", None, f"Word {turn}.", f"No end {turn}", "naïve — fin?\n", "日本。"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), rng.choice([role, role, role, "tool", None, ""]), text))
    rows += [(7, 1, "user", "Ok."), (7, 1, "user", "Ok."), (8, None, None, None), (60, 5, "user", "x" * 200_000 + ".")]
    rows += [(99, k, rng.choice(["user", "assistant"]), rng.choice([f"Turn {k}.", "Again.", f"cut {k}"])) for k in range(700)]      # several runs
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, *(f"{c}!" for c in CLASHES)) for r in rows], SCHEMA)


@pytest.mark.parametrize("block", [128, 3])
def test_equals_plain_repair(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    rows = conversations()
    got = C.repair_damaged(table(spark, rows).repartition(4))
    assert got.columns == ["conv_id", *C._COUNTS, "audit", "repaired_sha256"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len({r[0] for r in rows})
    want = expected(rows)
    assert {r[0]: r[1:] for r in got} == want


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Hi!"), (1, 3, "user", "Hi!"), (1, 4, "assistant", "Well")]
    got = sorted((r.run, r.pos, r.edit, r.fault, r.new_role, r.new_text) for r in C.repair(table(spark, rows)).collect())
    assert [g[2:] for g in got] == [("K", None, "system", "Be kind."), ("R", None, "user", "Hello."), ("R", None, "assistant", "Hi!"),
                                    ("D", "duplicate", None, None), ("D", "truncated", None, None)]


def test_empty_table(spark):
    assert C.repair_damaged(table(spark, [])).collect() == []
