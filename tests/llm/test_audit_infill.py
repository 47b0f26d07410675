"""Filter audit and fill-in-the-middle against brute force."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from callscope.llm import audit, infill

SPACES = "\x20\x09-\x0d"
LABELS = "doc_id long, quality int, toxic int"


def own_failures(text):
    words = re.findall(f"[^{SPACES}]+", text)
    fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
    return {x for x, f in fails.items() if f}


def plain_audit(rows, labels):
    """Rows (id, text, source) through every order, one filter after the other."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out = {}
    fails = [own_failures(t or "") | ({"E"} if i is not None and first[t or ""] < i else set()) for i, t, _ in rows]
    for part in {s or "" for *_, s in rows}:
        mine = [(r, f) for r, f in zip(rows, fails, strict=True) if (r[2] or "") == part]
        removed_of = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, x in enumerate(order, 1):
                gone, left = [r for r in left if x in r[1]], [r for r in left if x not in r[1]]
                removed_of[x] += len(gone)
                out[part, order, step] = [x, len(left), len(gone), sum(x in f for _, f in mine) - len(gone), sum(f == {x} for _, f in mine), sum(r[0] in good for r, _ in gone), sum(r[0] in toxic for r, _ in gone)]
        for key in [k for k in out if k[0] == part]:
            out[key].append(removed_of[out[key][0]])
    return {k: tuple(v[1:]) for k, v in out.items()}


def rows_of(df):
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in df.collect()}


def test_audit_against_every_order(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["aa", "Bb", "CC", "d#", "e", f"w{k}"]) for k in range(rng.choice([3, 60, 80]))) for _ in range(25)] + ["", None, "A", "x " * 60]
    rows = [(i, rng.choice(texts), rng.choice(["s", "t", None, ""])) for i in range(150)]
    rows += [(3, rows[3][1], "s"), (3, rows[3][1], rows[3][2]), (None, texts[0], "s"), (None, None, "only"), (149, texts[0], None), (3, texts[1], "t")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 150, 2)] + [(4, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "x", 1, True) for r in rows], "doc_id long, text string, source string, id string, mask int, good boolean")
    got = rows_of(audit.audit(docs.repartition(5), spark.createDataFrame(labels, LABELS)))
    assert got == plain_audit(rows, labels)
    assert len(got) == 3 * 600 + 600  # s, t, the empty string (null too) and one part of a single row


def test_parity_sums_invert(spark):
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 10**12, 32).tolist()
    cells = spark.createDataFrame([("p", m % 2 == 0, m % 3 == 0, m, n) for m, n in enumerate(counts)], "part string, good boolean, toxic boolean, mask int, n long")
    r = audit.parity_sums(cells).select(*[audit.inverted(audit.F.col(c)).alias(c) for c in ("every", "good", "toxic")]).first()
    assert r["every"] == counts
    assert r["good"] == [n if m % 2 == 0 else 0 for m, n in enumerate(counts)]
    assert r["toxic"] == [n if m % 3 == 0 else 0 for m, n in enumerate(counts)]


def test_audit_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (4, 0, 1)], LABELS)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in odd_docs.collect()]
    assert rows_of(audit.audit(odd_docs, labels)) == plain_audit(rows, [(1, 1, 0), (4, 0, 1)])
    assert audit.audit(no_docs, labels).count() == 0
    assert audit.audit(odd_docs, labels.limit(0)).agg({"good_lost": "max"}).first()[0] == 0


def test_rank_and_select_against_loops():
    rng = np.random.default_rng(1)
    for size, share in ((1, 1.0), (7, 0.5), (512, 0.1), (513, 0.9), (40_000, 0.02), (40_000, 0.7), (9000, 0.0)):
        bits = rng.random(size) < share
        v = infill.Bits(bits)
        at = np.arange(size + 1)
        assert (v.rank(at) == np.concatenate([[0], np.cumsum(bits)])).all()
        where = np.flatnonzero(bits)
        assert (v.select(np.arange(1, len(where) + 1)) == where).all()


def plain_infill(key, text):
    tokens = re.findall(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+", text)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def infilled(docs, **more):
    out = infill.transform(docs, **more)
    return out.select("*", infill.restored(out["output"], out["form"]).alias("back")).collect()


@pytest.mark.parametrize("most_bytes", [1, 2000, 8_000_000])
def test_infill_against_the_pattern(spark, most_bytes):
    rng = random.Random(9)
    parts = ["word", " ", "\n", "\t ", "é", "日本", "　", "\x85", " ", "😀", "<", "S>", ">", "<P", "\x0b", "\x0c\r", "\x1c"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.choice([1, 2, 5, 40]))) for _ in range(400)] + ["", None, " ", "\n\n", "a<S>b c d", "<M>", " x", "x ", "a " * 5000]
    rows = list(enumerate(texts)) + [(None, "no id here at all"), (7, texts[7])]
    got = infilled(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), most_bytes=most_bytes)
    assert Counter((r["key"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in got) == Counter((k, *plain_infill(k, t or ""), t or "") for k, t in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_infill_of_odd_rows(odd_docs, no_docs):
    got = Counter((r["key"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in infilled(odd_docs))
    assert got == Counter((r["doc_id"], *plain_infill(r["doc_id"], r["text"] or "")) for r in odd_docs.collect())
    assert infilled(no_docs) == []


def test_shares_of_forms(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'one two three four' AS text")
    n = Counter(r["form"] for r in infill.transform(docs, infill=90, spm=25).collect())
    assert abs(n["plain"] - 400) < 80 and abs(n["spm"] - 900) < 120
