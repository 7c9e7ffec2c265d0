import hashlib
import random
from collections import defaultdict

from corpus_pipeline import line_dedup
from shoal.llm.line_chunks import dedup_lines
from .helpers import CLASHES, awkward_texts, docs


def chunks(text):
    lines = text.split("\n")
    md5 = [hashlib.md5(x.encode()).hexdigest() for x in lines]

    def mark(salt, i):
        return 0 <= i < len(lines) - 1 and hashlib.md5((salt + md5[i] + md5[i + 1]).encode()).hexdigest() < "8"

    out = [(i, i) for i, x in enumerate(lines) if len(x) >= 99 and x.count(" ") >= 49]
    for i in range(len(lines)):
        if mark("s", i):
            out += [(i, e) for e in range(i + 1, min(i + 17, len(lines))) if mark("e", e - 1)][:1]
    return lines, out


def brute(rows):
    """(id, text) -> (text left, lines removed), for rows with unique ids."""
    cut = {i: chunks(t) for i, t in rows}
    places = defaultdict(list)
    for i, (lines, cs) in cut.items():
        for s, e in cs:
            places["\n".join(lines[s:e + 1])].append((i, s, e))
    out = {}
    for i, (lines, cs) in cut.items():
        gone = set()
        for s, e in cs:
            i0, s0, e0 = min(places["\n".join(lines[s:e + 1])])
            if (i0, s0) == (i, s):
                continue
            first, a, z = cut[i0][0], 0, 0
            while a < 8 and s > a and s0 > a and lines[s - a - 1] == first[s0 - a - 1]:
                a += 1
            while z < 8 and e + z + 1 < len(lines) and e0 + z + 1 < len(first) and lines[e + z + 1] == first[e0 + z + 1]:
                z += 1
            gone |= set(range(s - a, e + z + 1))
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone)
    return out


def test_repeated_passages_go_from_all_but_the_first(spark):
    passage = "\n".join(f"shared line number {k} of the passage" for k in range(12))
    long_line = " ".join(f"word{k}" for k in range(60))
    rows = [(k, f"own start {k}\nsecond {k}\n{passage}\nown end {k}") for k in range(6)]
    rows += [(10 + k, f"head {k}\n{long_line}\ntail {k}") for k in range(3)]
    rows += [(20, "a\nb\n" * 30), (21, "x\n" * 40), (22, "\n" * 5), (23, passage)]
    got = {r.doc_id: r for r in dedup_lines(docs(spark, rows)).collect()}
    for i, (text, n) in brute(rows).items():
        assert (got[i].text, got[i].dedup.n_removed) == (text, n), i
        assert got[i].dedup.n_lines == rows[[r[0] for r in rows].index(i)][1].count("\n") + 1
    for k in range(12):                                    # the whole passage, its first and last lines too
        assert sum(f"shared line number {k} " in r.text for r in got.values()) == 1
    assert sum(long_line in r.text for r in got.values()) == 1
    assert all(f"own start {k}" in got[k].text and f"own end {k}" in got[k].text for k in range(6))


def test_random_documents_against_brute_force(spark):
    rng = random.Random(8)
    pool = [f"line {k}" for k in range(60)]
    shared = [rng.sample(pool, rng.randint(2, 9)) for _ in range(6)]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(rng.randint(1, 5)):
            lines += rng.choice(shared) if rng.random() < 0.4 else [f"own {i} {rng.random()}" for _ in range(rng.randint(1, 4))]
        rows.append((i, "\n".join(lines)))
    got = {r.doc_id: (r.text, r.dedup.n_removed) for r in dedup_lines(docs(spark, rows)).collect()}
    assert got == brute(rows)
    kept = {x for t, _ in got.values() for x in t.split("\n")}
    assert kept >= {x for _, t in rows for x in t.split("\n")}       # no line is lost altogether


def test_awkward_rows(spark):
    rows = awkward_texts()
    out = dedup_lines(docs(spark))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", *CLASHES, "dedup"]
    got = out.collect()
    assert len(got) == len(rows)
    assert [r.text for r in got if r.doc_id == 20] == [None]
    assert [r.text for r in got if r.doc_id == 21] == [""]
    assert len({r.text for r in got if r.doc_id == 29}) == 1          # one document stored twice
    assert {r.text for r in got if r.doc_id == 26} == {dict((i, t) for i, t in rows if i == 26)[26]}
    assert all(r.id == "id!" for r in got)


def test_empty_table(spark):
    assert dedup_lines(docs(spark, [])).count() == 0


def test_no_python_on_the_main_path(spark):
    plan = dedup_lines(docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def all_repeated_runs(rows, least=50):
    """(id, line): lines of every run of lines, of ``least`` words or more, that also stands at a smaller place."""
    cut = [(i, t.split("\n")) for i, t in sorted(rows)]
    gone = set()
    for b, (i, lines) in enumerate(cut):
        for a in range(b + 1):
            other = cut[a][1]
            for s in range(len(lines)):
                for s0 in range(len(other) if a < b else s):
                    n = 0
                    while s + n < len(lines) and s0 + n < len(other) and lines[s + n] == other[s0 + n]:
                        n += 1
                    run = lines[s:s + n]
                    while run and not run[-1].split():
                        run.pop()
                    if run and run[0].split() and sum(len(x.split()) for x in run) >= least:
                        gone |= {(i, s + k) for k in range(len(run))}
    return gone


def test_every_repeated_short_passage_goes(spark):
    rng = random.Random(3)
    rows, planted = [], []
    for lines in (2, 3, 4, 5):
        for k in range(12):
            name = f"p{lines}x{k}"
            words = 60 // lines + 1
            planted.append([" ".join(f"{name}w{rng.random():.6f}" for _ in range(words)) for _ in range(lines)])
    for k, passage in enumerate(planted):
        blank = [*passage[:1], "", *passage[1:]] if k % 4 == 0 else passage
        for copy in range(2):
            rows.append((100 * copy + k, "\n".join([f"own head {k} {copy}", *blank, f"own tail {k} {copy}"])))
    small = [f"few words {k}" for k in range(3)]              # a run of 9 words is none of these
    rows += [(300, "\n".join(["first", *small])), (301, "\n".join(["second", *small]))]
    rows += [(400, "\n".join(f"run of short lines {k % 7}" for k in range(40)))]
    got = {r.doc_id: r for r in dedup_lines(docs(spark, rows), windows=True).collect()}
    want = all_repeated_runs(rows)
    marks = brute(rows)
    for i, text in rows:
        kept = "\n".join(x for k, x in enumerate(text.split("\n")) if (i, k) not in want)
        if i < 200:
            assert got[i].text == kept, i
        assert len(got[i].text) <= min(len(kept), len(marks[i][0])), i
    for k, passage in enumerate(planted):
        assert all(x not in got[100 + k].text and x in got[k].text for x in passage)
    assert got[301].text == marks[301][0]
    stage = {r.doc_id: r.text for r in line_dedup(spark, docs(spark, rows), "").collect()}
    assert all(stage.get(i, "") == r.text for i, r in got.items())
