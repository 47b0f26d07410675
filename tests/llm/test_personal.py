"""Personal data against the plain patterns, and planted spans that these miss."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from callscope.llm import entry, personal

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def digits(s):
    return "".join(c for c in s if c in "0123456789")


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits(s)))) % 10 == 0


TESTS = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 13 <= len(digits(s)) <= 19 and luhn(s), "phone": lambda s: 9 <= len(digits(s)) <= 15}


def base_of(text):
    return {k: [(m.start(), m.end(), m[0]) for m in re.finditer(p, text or "") if TESTS[k](m[0])] for k, p in PLAIN.items()}


def held(row, more=""):
    return {k: [(s["start"], s["end"], s["value"]) for s in row[more + k]] for k in PLAIN}


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def card(rng, start="4", n=16):
    body = start + "".join(rng.choice("0123456789") for _ in range(n - len(start) - 1))
    return next(body + c for c in "0123456789" if luhn(body + c))


def test_base_spans_against_plain_patterns(spark):
    """Possessive runs find what the plain patterns do, in odd neighbourhoods too."""
    rng = random.Random(4)
    parts = ["a@b.c", "@", ".", "_", "x.y", "1.2.3.4", "0255", "256", "+", "+49 ", "(30)", "-", " ", "4111111111111111", "é", "😀", "b-", "%", "5", "12", "\n", "1.2.3.4.5.6.7.8", "a@b", "c.d@", "4111 1111 1111 1111", "+1 (555) 555-0100", "ab"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.choice([2, 6, 12]))) for _ in range(1500)]
    texts += ["", None, "+1" + "(" * 3000, "a" * 50_000 + "@", "1" * 40_000, "1." * 20_000, "x@" * 9000, "12 " * 3000, "a@b.c_d@e.f", "😀 a@b.c 😀 1.2.3.4"]
    got = {r["key"]: held(r) for r in personal.found_in(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i] == base_of(t), t[:100] if t else t


def test_many_spans_in_one_text(spark):
    text = " ".join(f"user{k}@host{k % 7}.org and {k % 256}.0.0.1" for k in range(4000))
    assert held(personal.found_in(frame(spark, [text])).first()) == base_of(text)


@pytest.fixture(scope="module")
def planted(spark):
    """Spans that the patterns join with others or can't read, and look-alikes that aren't personal."""
    rng = random.Random(11)
    want, texts = {}, []
    for _ in range(400):
        ip = ".".join(str(rng.randint(11, 250)) for _ in range(4))
        local, host = rng.choice(["ann.lee", "bob7", "c_d"]), rng.choice(["mail", "firm-x"])
        number = card(rng)
        phone = f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
        shape = rng.randrange(9)
        line, spans = {
            0: (f"{number} {ip}", [("card", number)]),
            1: (f"call {phone} {number} now", [("phone", phone), ("card", number)]),
            2: (f"write {local} [at] {host} [dot] com soon", [("email", f"{local} [at] {host} [dot] com")]),
            3: (f"host {ip.replace('.', '[.]')} answered", [("ip", ip.replace(".", "[.]"))]),
            4: (f"{local}@{host}.org from {ip} or {phone}, {number}.", []),
            5: (f'token = "{rng.getrandbits(160):040x}"', []),
            6: (f"serial {rng.randint(10**15, 4 * 10**15 - 1)} of order 2020-11-{rng.randint(10, 28)}", []),
            7: (f"version {rng.randint(300, 900)}.{rng.randint(0, 9)}.0.1 has 12 34 56 rows", []),
            8: ("plain words, nothing else at all", []),
        }[shape]
        line = rng.choice(["So it was. ", "Des mots çà. ", ""]) + line
        texts.append(line)
        want[len(texts) - 1] = {(k, line.index(v), line.index(v) + len(v)) for k, v in spans}
    rows = personal.find(frame(spark, texts)).collect()
    return texts, want, rows


def test_planted_spans_are_added(planted):
    texts, want, rows = planted
    got = {r["key"]: {(k, s[0], s[1]) for k, v in held(r, "more_").items() for s in v} for r in rows}
    asked, found = sum(map(len, want.values())), sum(len(want[i] & got[i]) for i in want)
    wrong = [(texts[i], sorted(got[i] - want[i])) for i in want if got[i] - want[i] and not all(luhn(texts[i][s:e]) for k, s, e in got[i] - want[i])]
    assert asked > 100 and found >= 0.95 * asked
    assert len(wrong) <= 0.02 * len(texts), wrong[:5]
    for r in rows:
        assert held(r) == base_of(texts[r["key"]])


def test_reliabilities_find_the_guessing_labeler(spark):
    """A labeler that votes at random weighs less than those that agree with each other and the seeds."""
    rng = random.Random(2)
    rows = []
    for i in range(4000):
        true = rng.random() < 0.4
        votes = [int(true if rng.random() < a else not true) for a in (0.9, 0.95, 0.85)] + [2, 2, rng.randrange(2)]
        rows.append(("email", true and i % 3 == 0, votes))
    patterns = spark.createDataFrame(rows, "kind string, seed boolean, votes array<int>").groupBy("kind", "seed", "votes").agg(F.count(F.lit(1)).alias("n"))
    w = personal.reliabilities(patterns)["email"].weights
    assert w[0][1] - w[0][0] > 3 and w[1][1] - w[1][0] > 3 and w[2][1] - w[2][0] > 2
    assert w[5][1] - w[5][0] < 1.6  # the least that it may weigh


def test_query_on_supplied_documents(spark, sf_dir, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = entry.op12_pii(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = base_of(texts[r["doc_id"]])
        told = [f"{k}:{s}:{e}" for k in PLAIN for s, e, _ in base[k]]
        assert [r[f"n_{k}"] for k in PLAIN] == [len(base[k]) for k in PLAIN]
        assert r["base_sha256"] == hashlib.sha256(",".join(told).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(told) <= set(spans) and len(spans) == len(told) + r["n_added"]
        order = [(list(PLAIN).index(k), int(s)) for k, s, _ in (x.split(":") for x in spans)]
        assert order == sorted(order)


def test_odd_rows(spark, odd_docs, no_docs):
    texts = sorted((r["doc_id"] is None, r["doc_id"], str(base_of(r["text"]))) for r in odd_docs.collect() if r["doc_id"] is not None)
    rows = personal.find(odd_docs).collect()
    assert sorted((False, r["key"], str(held(r))) for r in rows if r["key"] is not None) == texts
    assert sum(r["key"] is None for r in rows) == 1
    assert personal.find(no_docs).collect() == []
    alone = personal.find(frame(spark, ["mail a@b.org"])).first()  # nothing to learn from
    assert held(alone)["email"] == [(5, 12, "a@b.org")] and alone["more_email"] == []


def test_native(spark, docs):
    """No Python worker in the plan."""
    plan = personal.found_in(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
