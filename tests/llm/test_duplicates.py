"""Near-duplicates and line dedup against brute force."""

import random
import re

import pytest

from callscope.llm import linededup, neardup


def roots(n_or_ids, links):
    parent = {x: x for x in n_or_ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def shingle_set(text, k):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, k, percent):
    sets = {i: shingle_set(t, k) for i, t in rows if i is not None}
    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    common = {}
    for i, s in sets.items():
        for x in s:
            for j in where[x]:
                if j > i:
                    common[i, j] = common.get((i, j), 0) + 1
    links = [p for p, n in common.items() if 100 * n >= percent * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    return sets, roots(sets, links)


def same_as_brute(docs, k, percent):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    sets, root = brute(rows, k, percent)
    got = [r for r in neardup.classes_of(docs, shingle_words=k, similarity=percent / 100).collect() if r["doc_id"] is not None]
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(s), root[i], root[i] == i) for i, s in sets.items()}


def test_documents(docs):
    same_as_brute(docs, 3, 85)


def test_odd_rows(odd_docs):
    same_as_brute(odd_docs, 3, 85)
    assert neardup.drop_near_duplicates(odd_docs).columns == odd_docs.columns


def test_empty(no_docs):
    assert neardup.classes_of(no_docs, shingle_words=3, similarity=0.85).isEmpty()


def test_a_large_group_of_near_copies(spark):
    r = random.Random(3)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(600):  # texts at every distance, and chains of small changes
        words = base.copy()
        for _ in range(i % 9):
            words[r.randrange(120)] = f"x{r.randrange(10_000)}"
        rows.append((i, " ".join(words)))
    same_as_brute(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(4000, 4900)]
    want = roots({x for p in links if p[0] != p[1] for x in p}, links_without_loops := [p for p in links if p[0] != p[1]])
    got = {x["id"]: x["component"] for x in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want and links_without_loops


def test_what_grows_with_the_input_is_not_broadcast(spark, docs, monkeypatch):
    name, allowed, write = "spark.sql.autoBroadcastJoinThreshold", [], neardup.materialize
    limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold

    def seen(df, label):
        allowed.append(limit())
        return write(df, label)

    monkeypatch.setattr(neardup, "materialize", seen)
    before = spark.conf.get(name)
    spark.conf.set(name, "10m")
    try:
        out = neardup.drop_near_duplicates(docs)
        assert limit() == 10 * 1024 * 1024
        out.count()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    assert len(allowed) > 5 and max(allowed) <= 256 * 1024
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("similarity", [0.8, 0.85])
def test_pigeonhole_finds_all_signatures_within_the_distance(similarity):
    import numpy as np

    scheme, rng = neardup.Scheme(similarity), np.random.default_rng(5)
    a = rng.integers(0, 1 << 16, (200, 64)).astype("<u2")
    b = a.copy()
    for row in range(200):
        b[row, rng.choice(64, row % (scheme.most + 1), replace=False)] ^= 1
    assert (scheme.keys(a) == scheme.keys(b)).any(1).all()


def sentence(r, n=12):
    return " ".join(f"w{r.randrange(5000)}" for _ in range(n)) + "."


def test_repeated_passages_go_and_the_rest_stays(spark):
    r = random.Random(9)
    passage = " ".join(sentence(r) for _ in range(6))
    own = {i: [sentence(r) for _ in range(4)] for i in range(8)}
    rows = [(i, " ".join([*s[:2], passage, *s[2:]]) if i % 2 else " ".join(s), "en", "web", 0) for i, s in own.items()]
    out = {x["doc_id"]: x["text"] for x in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert sum(passage in t for t in out.values()) == 1 and passage in out[1]
    for i, s in own.items():
        assert all(x in out[i] for x in s)
    assert all(passage.split(".")[0] not in out[i] for i in (3, 5, 7))


def test_no_long_passage_stands_twice_in_documents(docs):
    """Brute force over whole texts: runs of line shingles of the guaranteed length stand once; texts only lose lines."""
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    after = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs).collect()}
    assert before.keys() == after.keys()
    seen_runs = {}
    for i, t in sorted(after.items()):
        parts = [p.strip() for p in linededup.lines(t or "") if p.strip()]
        for a in range(len(parts)):
            n, b = 0, a
            while b < len(parts) and n < linededup.GUARANTEE + linededup.SHINGLE:
                n += parts[b].count(" ") + 1
                b += 1
            if n >= linededup.GUARANTEE + linededup.SHINGLE:
                run = tuple(parts[a:b])
                # joined lines of a document may newly meet; a run that stood twice before must not stand twice now
                if run in seen_runs and all(" ".join(run) in " ".join((before[j] or "").split()) for j in (i, seen_runs[run])):
                    raise AssertionError(run)
                seen_runs[run] = i
    words_before = {w for t in before.values() for w in (t or "").split()}
    assert {w for t in after.values() for w in (t or "").split()} <= words_before


def test_line_dedup_of_odd_rows(odd_docs, no_docs):
    out = linededup.dedup_lines(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[2] is None and texts[3] == "" and len(texts[4]) > 100_000
    assert linededup.dedup_lines(no_docs).isEmpty()


def words(r, n):
    return [f"w{r.randrange(5000)}" for _ in range(n)]


def deduped(spark, texts):
    rows = [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)]
    return {x["doc_id"]: x["text"] for x in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}


def test_passages_within_sentences_go(spark):
    """Passages of 51 words, with stops of their own, begin and end amid sentences of each document, or of one document."""
    r = random.Random(4)
    passages = []
    for k in range(12):
        p = words(r, 51)
        for at in ((), (25,), (7, 30), (45,))[k % 4]:
            p[at] += "."
        passages.append(" ".join(p))
    own = [(" ".join([*words(r, 11 + i % 9), f"left{i}"]), " ".join([f"right{i}", *words(r, 14), "end."])) for i in range(36)]
    texts = [f"{a} {passages[i % 12]} {b}" for i, (a, b) in enumerate(own)]
    inside = words(r, 60)
    texts.append(" ".join(["once", *inside, "over. Then", *inside, "again."]))
    out = deduped(spark, texts)
    for i, (a, b) in enumerate(own):
        assert out[i] == (texts[i] if i < 12 else f"{a} {b}")
    assert out[36] == " ".join(["once", *inside, "over. Then again."])


@pytest.mark.parametrize("sep", ["\n", "\t", " \r\n\t"])
def test_menus_and_tab_separated_lines_go_whole(spark, sep):
    """Lines of one word each, and few lines of words parted by tabs: all words of each later copy go."""
    r = random.Random(5)
    runs = [words(r, 51 + k) for k in range(10)]
    own = [(" ".join([*words(r, 40), f"left{i}."]), " ".join([f"right{i}", *words(r, 40), "end."])) for i in range(30)]
    out = deduped(spark, [f"{a}\n{sep.join(runs[i % 10])}\n{b}" for i, (a, b) in enumerate(own)])
    for i, (a, b) in enumerate(own):
        assert out[i] == (f"{a}\n{sep.join(runs[i % 10])}\n{b}" if i < 10 else f"{a}\n{b}")
