import random

from shoal.llm.chat_snapshots import collapse

SCHEMA = "conv_id long, turn long, role string, text string, n long, block string, total string, segment string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "b", "t", "s") for r in rows], SCHEMA)


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, set()).add((t is not None, t or 0, r is not None, r or "", x is not None, x or ""))
    seqs = {c: tuple(sorted(s)) for c, s in convs.items()}
    out = {}
    for c, s in seqs.items():
        longer = any(len(z) > len(s) and z[:len(s)] == s and z[len(s)][:2] != s[-1][:2] for z in seqs.values())
        if not longer and c == min(d for d, z in seqs.items() if z == s):
            out[c] = (len(s), sum(z == s for z in seqs.values()), "".join(f"<|{k[3]}|>\n{k[5]}<|end|>\n" for k in s))
    return out


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows, c = [], 0
    for _ in range(25):
        full = [(t, "user" if t % 2 == 0 else "assistant", f"say {rng.randrange(3)}") for t in range(rng.randint(1, 6))]
        for _ in range(rng.randint(1, 4)):
            rows += [(c, *x) for x in full[:rng.randint(1, len(full))]]
            c += 1
    rows += [(c, 0, "user", None), (c, 0, "user", ""), (c, None, "system", "x"), (c + 1, None, None, None), (c + 2, 0, "user", "say 1"),
             (c + 2, 0, "user", "say 1"), (None, 0, "user", "nobody"), (c + 3, 0, "user", "long " * 50000), (c + 3, 5, "user", "gap")]
    got = {r.conv_id: (r.n_turns, r.n_same, r.rendered) for r in collapse(table(spark, rows)).collect()}
    assert got == brute(rows)


def test_long_conversation_in_blocks(spark):
    full = [(1, t, "user", f"turn {t}") for t in range(50)]
    rows = full + [(2, *x[1:]) for x in full[:33]] + [(3, *x[1:]) for x in full[:8]] + [(4, *x[1:]) for x in full[:9]] + [(4, 9, "user", "differs")]
    got = collapse(table(spark, rows), block=8).collect()
    assert {(r.conv_id, r.n_turns) for r in got} == {(1, 50), (4, 10)}
    whole = sorted((r.segment, r.rendered) for r in got if r.conv_id == 1)
    assert "".join(x for _, x in whole) == "".join(f"<|user|>\nturn {t}<|end|>\n" for t in range(50)) and len(whole) == 7


def test_empty_table_and_no_python(spark):
    out = collapse(table(spark, []))
    assert out.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
