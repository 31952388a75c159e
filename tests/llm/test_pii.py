"""Personal data: base spans against plain expressions, added spans, and the two fits."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from llm.samples import TEXTS, documents, empty

from sparkguard.llm import pii, queries

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def fine(kind, value):
    digits = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(sum(divmod(2 * d, 10)) if k % 2 else d for k, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in p.finditer(text or "") if fine(k, m.group())]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def check(rows, out):
    """Every row's base spans, and that all spans hold them."""
    want = sorted((str(i), joined(base(t))) for i, t in rows)
    got = sorted(((r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in out), key=repr)
    plain = sorted(((i, hashlib.sha256(joined(base(t)).encode()).hexdigest(), *[sum(k == x for x, _, _ in base(t)) for k in PLAIN]) for i, t in rows), key=repr)
    assert got == plain
    all_spans = sorted((str(r.doc_id), r.spans) for r in out)
    assert [i for i, _ in all_spans] == [i for i, _ in want]
    by_id = {}
    for i, s in want:
        by_id.setdefault(i, []).append(s)
    for i, s in all_spans:
        if len(by_id[i]) == 1:
            assert set(filter(None, by_id[i][0].split(","))) <= set(s.split(","))
    return {i: s for i, s in all_spans}


def digests(spark, texts):
    rows = list(enumerate(texts))
    return check(rows, pii.digests(documents(spark, [(i, t, "a") for i, t in rows])).collect())


def card(seed, n=16):
    """Digits that pass their check."""
    rng = random.Random(seed)
    head = "4" + "".join(rng.choice("0123456789") for _ in range(n - 2))
    return next(head + d for d in "0123456789" if fine("card", head + d))


@pytest.mark.parametrize("seed", range(3))
def test_base_spans_of_random_texts(spark, seed):
    """Strings of the letters that the expressions know, so that matches touch, overlap and fail in every way."""
    rng = random.Random(seed)
    parts = ["@", ".", "-", " ", "+", "1", "22", "255", "256", "a", "b.c", "_", "%", "(", ")", "x@y.z", "1.2.3.4", card(1), card(2)[:9], "+1 (234) 555-7890", "é", "\U0001f600", "\n", "12345678901234567890"]
    digests(spark, ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(400)])


def test_edges(spark):
    digests(
        spark,
        [
            None, "", "a@b.c_d@e.f", "a@b.c@d.e", "..@a.b", "a@b", "a@b..c", "x a.b@c.d.", "1.2.3.4.5.6.7.8", "1.2.3.4.5", "256.1.1.1 1.2.3.255", "0001.000.00.0255",
            card(3), f"{card(3)} {card(4)}", f"{card(3)}-1", f"5 {card(3)}", f"a{card(5)}b", f"{card(5)}\n{card(6)}", f"{card(5)}  {card(6)}", card(7, 13), card(8, 19), "0" * 16,
            "4-" * 20, "+1 (234) 555-7890", "+1+1 234567890", "+49 (0) 30 1234567 ", "+12345678", "+1 2 3 4 5 6 7 8 9.", "+1 234 567 890 - ", "+ 1234567890", "é+4912345678901é",
            "\U0001f600 mail a@b.cd \U0001f600 10.0.0.1", "a" * 2000, "1" * 2000, "1." * 1000, "+1 " * 900, "a@b" + ".c" * 900, "a@" * 900, "(" * 900,
        ],
    )


def test_long_runs_take_linear_time(spark):
    """Runs for which plain expressions try every start."""
    texts = ["a" * 2_000_000, "1" * 2_000_000, "1." * 1_000_000, "a.b-" * 500_000, "1-" * 1_000_000, "a@b" + ".c" * 1_000_000, "a@" * 1_000_000, "(" * 2_000_000]
    out = pii.digests(documents(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()
    ends = {r.doc_id: [len(r.spans.split(",")), r.spans.split(",")[-1]] for r in out if r.spans}
    assert ends == {2: [250_000, "ip:1999992:1999999"], 5: [1, "email:0:2000003"]}


def test_awkward_rows(spark):
    out = pii.digests(documents(spark)).collect()
    check([(i, t) for i, t, _ in TEXTS], out)
    twice = pii.digests(documents(spark, [(1, "a@b.cd", "a"), (1, "a@b.cd", "a"), (None, "a@b.cd", "a")])).collect()
    assert [r.spans for r in twice] == ["email:0:6"] * 3
    assert pii.digests(empty(spark)).count() == 0


def test_added_spans(spark):
    """Spelled-out addresses and other forms are found among their kind; numbers that fail their checks are not."""
    rng = random.Random(1)
    texts = [f"write an email to user{k}@mail{k % 9}.example.com or call +1 (234) 555-{k:04d} please, card {card(k)} at 10.1.{k % 255}.7 host" for k in range(60)]
    texts += [f"nothing here {rng.randint(10**15, 10**16 - 1)} and 300.1.2.3 or 1.2.3" for _ in range(60)]
    extra = ["contact jane (at) example (dot) com now", "call 234-555-7890 today", f"credit card {'.'.join(card(77)[k : k + 4] for k in range(0, 16, 4))} it is"]
    extra += ["host 2001:0db8:0000:0000:0000:ff00:0042:8329 is up"]
    got = digests(spark, texts + extra)
    assert [got[str(120 + k)].split(":")[0] for k in range(4)] == ["email", "phone", "card", "ip"]
    clean = digests(spark, texts[60:])
    assert all(s == joined(base(t)) for s, t in zip([clean[str(k)] for k in range(60)], texts[60:], strict=True))


def test_fits_learn_from_votes():
    """Labelers that agree get high reliabilities; one that votes at random gets low ones."""
    rng = random.Random(2)
    counts = {}
    for _ in range(4000):
        y = rng.random() < 0.3
        good = 1 if (rng.random() < 0.9) == y else -1
        fair = 1 if (rng.random() < 0.8) == y else -1
        key = (0, True, True, rng.choice([1, -1]), good, fair, good if rng.random() < 0.5 else 0)
        counts[key] = counts.get(key, 0) + 1
    rows = [dict(zip(["kind", "base", "passes", *pii.LABELERS, "n"], [*k, n], strict=True)) for k, n in counts.items()]
    share, tables = pii.reliabilities(rows)[0]
    by = dict(zip(pii.LABELERS, tables, strict=True))
    assert share == pytest.approx(0.3, abs=0.08)
    assert by["gazetteer"][1, 1] > 0.75 > by["shape"][1, 1]
    assert pii.posterior({"passes": False, **dict.fromkeys(pii.LABELERS, 1)}, share, tables) == 0
    weights = pii.classifier(rows, {0: (share, tables)})
    assert weights["gazetteer 1"] > abs(weights["shape 1"])


def test_no_python_in_the_plan(spark):
    plan = pii.digests(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


def test_the_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(rows, queries.op13_pii(spark, sf).collect())
