"""Personal data: fixed forms against regular expressions, the bootstrapped rest against a plain scoring with strings."""

import bisect
import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from shoal.llm import pii_bootstrap as P
from tests.llm import helpers

FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
MARKS = re.compile(r"[0-9A-Za-z@_][0-9A-Za-z@_.%+/#-]*")
WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def fits(kind, text):
    digits = re.sub(r"[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in FORMS.items() for m in re.finditer(p, text) if fits(k, m[0])]


def as_text(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (P.KINDS.index(x[0]), x[1])))


def plain(texts, rounds=P.ROUNDS, support=P.SUPPORT, confident=P.CONFIDENT):
    """Added spans per text, with words as patterns and dictionaries as tables."""
    occ, totals = [], defaultdict(int)
    for d, text in enumerate(texts):
        taken = base(text)
        spans = [(k, s, e) for k, s, e in taken]
        for t in re.finditer(r"[^\x20\x09-\x0D]+", text):
            if re.search("[0-9@_]", t[0]):
                for m in MARKS.finditer(text, t.start(), t.end()):
                    p = m[0].rstrip(".%+/#-@")
                    x, y = m.start(), m.start() + len(p)
                    if any(s < y and e > x for _, s, e in taken):
                        continue
                    if "@" in p or "_" in p.strip("_") or (len(p) >= 4 and re.search("[0-9]", p)):
                        spans.append((None, x, y))
        norm = [(re.sub("[0-9]", "0", w[0].translate(helpers.LOWER)), w.start(), w.end()) for w in WORD.finditer(text)]
        only, begins, ends = ([w[k] for w in norm] for k in range(3))
        for w in only:
            totals["L", w] += 1
        for a, b in zip(only, only[1:], strict=False):
            totals["LL", a, b] += 1
            totals["RR", a, b] += 1
        for k, s, e in spans:
            i, j = bisect.bisect_right(ends, s), bisect.bisect_left(begins, e)
            pats = [("L", only[i - 1])] if i else []
            pats += [("LL", *only[i - 2:i])] if i > 1 else []
            pats += [("RR", *only[j:j + 2])] if j + 1 < len(only) else []
            own = text[s:e] if k in ("card", "phone") else text[s:e].lower()
            occ.append((d, k, s, e, re.sub("[^0-9]", "", own) if k in ("card", "phone") else own, pats))
    seen = defaultdict(int)
    for _, k, _, _, x, _ in occ:
        seen[x] += k is None
    belief, confs = {}, {}
    for _ in range(rounds):
        sup, mass, found, unknown = defaultdict(dict), defaultdict(float), defaultdict(float), defaultdict(int)
        for _, k, _, _, x, pats in occ:
            for kind, b in [(k, 1.0)] if k else list(belief.get(x, {}).items()):
                for p in pats:
                    sup[p, kind][x, k is None] = b
                    mass[p, kind] += b
                    found[p, kind] += b * (k is None)
            for p in pats if k is None else ():
                unknown[p] += 1
        confs = {}
        for (p, kind), m in mass.items():
            conf = min(1.0, m / (totals[p] - unknown[p] + found[p, kind] + P.UNKNOWN * (unknown[p] - found[p, kind])))
            if sum(sup[p, kind].values()) >= support and conf >= confident:
                confs[p, kind] = conf
        weight = defaultdict(lambda: defaultdict(float))
        for _, k, _, _, x, pats in occ:
            hits = [(c, -P.KINDS.index(kind), kind) for p in pats for kind in P.KINDS if (c := confs.get((p, kind)))] if k is None else []
            if hits:
                weight[x][max(hits)[2]] += max(hits)[0]
        belief = {x: {kind: min(1.0, w / seen[x]) for kind, w in ws.items()} for x, ws in weight.items()}
    out = defaultdict(list)
    for d, k, s, e, x, pats in occ:
        if k is None:
            hits = [(c, -P.KINDS.index(kind), kind) for p in pats for kind in P.KINDS if (c := confs.get((p, kind)))]
            hits += [(b, -P.KINDS.index(kind), kind) for kind, b in belief.get(x, {}).items() if b >= P.BELIEVED]
            if hits:
                out[d].append((max(hits)[2], s, e))
    return out


def texts(seed=2):
    rng = random.Random(seed)
    out = [t for _, t in helpers.awkward_texts()]
    word = lambda: rng.choice("alpha beta gamma delta été straße 12 v2 3000 x_y".split())
    for k in range(40):
        a, b = " ".join(word() for _ in range(rng.randint(0, 9))), " ".join(word() for _ in range(rng.randint(0, 9)))
        number = f"{rng.randint(100, 999)}-{rng.randint(1000, 9999)}"
        out.append(rng.choice([f"{a} Write to me at user{k}@mail.example.com today please {b}", f"{a} Write to me at user{k}@intranet today please {b}",
                               f"{a} call mobile +4930{rng.randint(10**6, 10**7 - 1)} now {b}", f"{a} call mobile 0{number} now {b}",
                               f"{a} host address {rng.randint(1, 255)}.{k}.0.1, {b}", f"{a} nothing here {b}", f"badge {k}{number}x is held {a}"]))
    out += ["ref of user5@intranet again", "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111222, 1.2.3.4.5.6.7.8 999.1.1.1 01.002.0003.4",
            "a@b.c_d@e.f..g@@h.i x@y +1 (017) 555-7713. +12 +1--- 2 ++49 30 1234567 (", "éé user@exämple.com ü.b@c.de-", "1" * 60 + " " + "12 " * 30 + "@" * 40 + "+" * 40,
            "9" * 5000 + "." + "x" * 5000 + "@" + "y" * 5000 + ".z", None, "", "+49", "@", "1"]
    return out


def test_fixed_forms_equal_regular_expressions():
    rng = random.Random(9)
    cases = [t or "" for t in texts()] + ["".join(rng.choice("0123456789.. --@+()a é\n") for _ in range(rng.randint(1, 80))) for _ in range(3000)]
    data = [c.encode() for c in cases]
    rel = np.concatenate(([0], np.cumsum([len(d) for d in data])))
    got = defaultdict(list)
    for k, s, e in P.base_spans(np.frombuffer(b"".join(data), np.uint8), rel):
        r = int(np.searchsorted(rel, s, "right")) - 1
        at = lambda x: len(data[r][:x - rel[r]].decode())  # noqa: E731,B023
        got[r].append((P.KINDS[k], at(s), at(e)))
    for r, text in enumerate(cases):
        assert sorted(got[r]) == sorted(base(text)), text


@pytest.mark.parametrize("bits", [P.FILTER_BITS, 64])
def test_equals_plain_bootstrapping(spark, bits):
    rows = [(k if k % 7 else None, t) for k, t in enumerate(texts())]
    rows += rows[30:34]
    added = plain([t or "" for _, t in rows])
    assert sum(len(v) for v in added.values()) > 5
    want = sorted((str(d), *(sum(k == n for k, _, _ in base(t or "")) for n in P.KINDS), hashlib.sha256(as_text(base(t or "")).encode()).hexdigest(),
                   as_text(base(t or "") + added[r])) for r, (d, t) in enumerate(rows))
    got = P.report(helpers.docs(spark, rows).repartition(3), filter_size=bits)
    assert got.columns == ["doc_id", *(f"n_{k}" for k in P.KINDS), "base_sha256", "spans"]
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == want


def test_contexts_find_unseen_identifiers(spark):
    rows = [(k, f"Dear all, reach me at person{k}@mail.example.org or come by.") for k in range(6)]
    rows += [(10, "You may reach me at jane_doe.intern or come by."), (11, "Here jane_doe.intern was seen."), (12, "A clean text with version 3.2.1 of 2024.")]
    got = {r.doc_id: r.spans for r in P.report(helpers.docs(spark, rows)).collect()}
    assert got[10] == "email:20:35" and got[11] == "email:5:20" and got[12] == ""
    assert all(got[k] == "email:22:46" for k in range(6))


def test_empty_table(spark):
    assert P.report(helpers.docs(spark, [])).collect() == []
