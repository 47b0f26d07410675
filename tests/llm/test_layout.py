"""Packing, sharding, mixing and search against brute force."""

import zlib

import numpy as np
import oracle
from pyspark.sql import functions as F

from callscope.llm import entry, mixing, packing, search, sharding


def packs_well(rows, width=1024):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= width
    return len(bins)


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    rows = packing.pack(docs).collect()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k, r in enumerate(sorted(got[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    least = -(-sum(r["length"] for r in rows) // 1024)
    assert packs_well(rows) <= 1.02 * least + 8


def test_packing_closes_the_fullest_bin_first():
    p = packing.Packer(10, 2)
    assert [p.put(n) for n in (6, 7, 8, 4, 2)] == [(0, 0), (1, 0), (2, 0), (0, 6), (2, 8)]
    assert p.closed == 1


def test_packing_against_a_plain_search():
    """The bitset chooses as a search through all open bins does, closings included."""
    rng = np.random.default_rng(8)
    p, bins, made = packing.Packer(64, 7), {}, 0
    for n in rng.integers(1, 65, 4000).tolist():
        got_bin, got_at = p.put(n)
        room = min((free for free in bins.values() if free >= n), default=None)
        if room is None:
            if len(bins) == 7:
                least = min(bins.values())
                bins.pop(next(b for b, free in bins.items() if free == least and b not in sum(p.free, [])))
            bins[made], room, made = 64, 64, made + 1
        assert bins[got_bin] == room and got_at == 64 - room
        bins[got_bin] -= n
        if not bins[got_bin]:
            del bins[got_bin]
        assert sorted(x for x in bins.values()) == sorted(free for free, some in enumerate(p.free) for _ in some)
    assert p.closed > 100


def test_ids_are_those_of_the_tokenizer():
    """The faster encoder gives the ids of ``tokenizers`` on texts of odd characters."""
    import random

    from tokenizers import Tokenizer

    slow, fast, r = Tokenizer.from_file(packing.tokenizer_path()), packing.encoder(packing.tokenizer_path()), random.Random(7)
    odd = [*"aZ09 \t\n\r'!-_#\u00a0\u00e9\u00df\u0301\u200d\u3000\u4e2d\u0639\U0001f600\x00\x0b\x85", "'s", "'ll", "  ", "<|endoftext|>", "the", "\r\n"]
    for _ in range(2000):
        t = "".join(r.choice(odd) for _ in range(r.randrange(30)))
        assert fast(t).tolist() == slow.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing_odd_rows(odd_docs, no_docs):
    rows = packing.pack(odd_docs).collect()
    assert packs_well(rows) and {r["doc_id"] for r in rows} == {1, 2, 3, 4, 5, None, 7, 8}
    assert [r["length"] for r in rows if r["doc_id"] in (2, 3)] == [1, 1]
    assert packing.pack(no_docs).isEmpty()


def test_special_token_text(spark):
    df = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")
    assert packing.pack(df).count() == 1


def test_sharding(spark, sf_dir, docs):
    rows = entry.op8_kd_sharding(spark, sf_dir).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert len(rows) == docs.count()
    sizes, slots = {}, {}
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]])
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(sizes) == list(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(len(t) for t in texts.values()) + 1
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(largest, sum(sizes.values()) / 16 / sharding.PARTS)
    copies = {}
    for r in rows:
        copies.setdefault(texts[r["doc_id"]], []).append(r)
    assert all(len({r["shard"] for r in c}) == 1 for c in copies.values() if sum(r["size"] for r in c) < sum(sizes.values()) / 16 / sharding.PARTS and len(c) < len(rows) / 16)


def test_copies_share_a_shard_and_any_number_of_shards_comes_out(spark):
    r = np.random.default_rng(6)
    rows = []
    for i in range(900):
        text = "copy " * 20 if i % 3 == 0 else f"text {i // 7} " * int(r.integers(1, 9))  # a third of all rows hold one text
        rows.append((i, text, ["en", "de", None][i % 3], f"s{r.integers(5)}", int(r.integers(1000))))
    rows += [(5, "again", "en", "s", 1)] * 3 + [(None, None, None, None, None), (None, "", "en", "s0", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    total = sum(len(t or "") + 1 for _, t, *_ in rows)
    for n in (1, 3, 10):
        got = sharding.kd_shards(df, n_shards=n).collect()
        sizes, where = {}, {}
        for x in got:
            sizes[x["shard"]] = sizes.get(x["shard"], 0) + x["size"]
            where.setdefault((x["text_crc32"], x["size"]), set()).add(x["shard"])
        assert len(got) == len(rows) and sorted(sizes) == list(range(n))
        assert sum(len(s) > 1 for s in where.values()) <= 1  # only the hot text is dealt
        assert max(abs(s - total / n) for s in sizes.values()) <= max(1500, total / n / 4)
    assert len({x["shard"] for x in sharding.kd_shards(df, target_bytes=total // 5).collect()}) in (5, 6)


def test_sharding_odd_rows(odd_docs, no_docs):
    assert sharding.kd_shards(odd_docs, n_shards=4).count() == odd_docs.count()
    assert sharding.kd_shards(no_docs).isEmpty()


def marginal(cells, d, value):
    m = cells.groupby(d, dropna=False)[value].sum()
    return m / m.sum()


def plain_raking(cells, keep, masses, rounds):
    """Drawn tokens by long bounded raking; the goals of groups by filling them one after the other."""
    tokens = cells["tokens"].to_numpy(float)
    drawn = keep * tokens
    on, goal = {}, {}
    for d, mass in masses.items():
        keys = [str(x) for x in cells[d]]
        on[d] = {g: np.array([k == g for k in keys]) for g in sorted(set(keys))}
        held = {g: tokens[m].sum() for g, m in on[d].items()}
        left, full = dict(zip(map(str, mass.index), mass, strict=True)), set()
        while True:
            factor = (keep * tokens.sum() - sum(held[g] for g in full)) / sum(left[g] for g in left if g not in full)
            over = {g for g in left if g not in full and factor * left[g] > held[g] * (1 + 1e-12)}
            if not over:
                break
            full |= over
        goal[d] = {g: held[g] if g in full else factor * left[g] for g in left}
    for _ in range(rounds):
        for d in masses:
            for g, m in on[d].items():
                whole = m & (drawn >= tokens)
                free = m & ~whole
                if drawn[m].sum() > goal[d][g]:
                    drawn[m] *= goal[d][g] / drawn[m].sum()
                elif free.any():
                    drawn[free] *= (goal[d][g] - drawn[whole].sum()) / drawn[free].sum()
            drawn = np.clip(drawn, mixing.LEAST * keep * tokens, tokens)
    return drawn, on, goal


def test_mixing_matches_targets(docs):
    """With flat targets, groups that hold too little, and one of a single tiny document, the volume is met and so are all goals."""
    tiny = docs.limit(1).selectExpr("-1L AS doc_id", "'ab' AS text", "'rare' AS lang", "'rare' AS source", "2L AS n_chars")
    more = docs.unionByName(tiny)
    for keep, alphas in ((0.3, mixing.ALPHAS), (0.7, mixing.ALPHAS)):
        cells = mixing.calibrated(more, keep=keep, alphas=alphas, tolerance=1e-6).toPandas()
        masses = {d: cells.groupby(d, dropna=False)["tokens"].sum() ** alphas[d] for d in mixing.DIMENSIONS}
        drawn, on, goal = plain_raking(cells, keep, masses, 3000)
        assert np.allclose(cells["probability"] * cells["tokens"], drawn, atol=1e-3 * cells["tokens"].max())
        assert cells["probability"].between(0, 1).all() and cells["probability"].min() > 0
        assert abs((cells["probability"] * cells["tokens"]).sum() / cells["tokens"].sum() - keep) < 1e-3
        for d in masses:
            for g, m in on[d].items():
                assert abs((cells["probability"] * cells["tokens"])[m].sum() - goal[d][g]) < 1e-3 * keep * cells["tokens"].sum()
    assert cells[cells["lang"] == "rare"]["probability"].min() > 0.99999


def test_mixing_to_goals_that_contradict_each_other(spark):
    """A source in one language only, asked for more than that language: bounds hold and the volume is met."""
    rows = [(i, "x" * 400, "en" if i % 4 else "de", "a" if i % 4 else "b") for i in range(200)]
    cells = mixing.calibrated(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), keep=0.5, targets={"source": {"a": 0.6, "b": 0.4}, "lang": {"en": 0.9, "de": 0.1}}, most_rounds=20).toPandas()
    assert cells["probability"].between(mixing.LEAST * 0.5, 1).all()
    assert abs((cells["probability"] * cells["tokens"]).sum() - 0.5 * cells["tokens"].sum()) < 1e-6 * cells["tokens"].sum()


def test_mixing_tells_what_it_reaches(spark):
    rows = [(i, "x" * 400, "en", "big") for i in range(99)] + [(99, "x" * 400, "en", "small")]
    cells = mixing.calibrated(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), keep=0.5, targets={"source": {"big": 0.5, "small": 0.5}})
    got = {(r["dimension"], r["group"]): (round(r["target"], 6), round(r["reached"], 6)) for r in mixing.reached(cells).collect()}
    assert got["source", "small"] == (0.5, 0.02) and got["source", "big"] == (0.5, 0.98) and got["lang", "en"] == (1.0, 1.0)


def test_mixing_to_given_targets(spark):
    """A source with a third of all rows, one too rare for its target; brute force by long raking in numpy."""
    rng = np.random.default_rng(1)
    rows = [(i, "x" * int(n), "en" if rng.random() < 0.6 else "de", "hot" if i % 3 == 0 else f"s{i % 7}") for i, n in enumerate(rng.integers(100, 3000, 3000))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"lang": {"en": 0.5, "de": 0.5}, "source": {"hot": 0.1}}
    cells = mixing.calibrated(df, keep=0.5, targets=targets).toPandas()
    share = marginal(cells, "source", "tokens")
    want = share.copy()
    want["hot"] = 0.1
    want /= want.sum()
    w = cells["tokens"].to_numpy(float)
    goals = {"source": want, "lang": {"en": 0.5, "de": 0.5}, "topic": marginal(cells, "topic", "tokens")}
    for _ in range(500):
        for d, goal in goals.items():
            for g, x in dict(goal).items():
                on = (cells[d] == g).to_numpy()
                w[on] *= x / (w[on].sum() / w.sum())
    assert np.allclose(cells["weight"], w / w.sum(), atol=1e-7)
    kept = mixing.mix(df, keep=0.5, targets=targets).toPandas()
    kept["tokens"] = kept["text"].str.len() / 4
    assert abs(marginal(kept, "lang", "tokens")["en"] - 0.5) < 0.05 and abs(marginal(kept, "source", "tokens")["hot"] - want["hot"]) < 0.03


def test_mixing_odd_rows(odd_docs, no_docs):
    out = mixing.mix(odd_docs, keep=1.0)
    assert [c for c in out.columns if not c.startswith(mixing.P)] == odd_docs.columns
    assert mixing.mix(no_docs).isEmpty()


def test_queries_with_sql(spark, sf_dir):
    con = oracle.connection(sf_dir)
    for name, sql in entry.oracle_sql().items():
        assert oracle.difference(con, entry.queries()[name](spark, sf_dir), sql) == "", name


def test_search_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 1, 6).tolist()) for i in range(300)]
    rows += [(300, None), (350, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (400, [float("nan")] * 6), (450, rows[3][1]), (500, [1.0, 2.0]), (None, [0.0] * 6), (550, []), (600, rows[3][1]), (650, [float("inf")] * 6), (50, rows[50][1]), (100, rows[7][1]), (7, rows[7][1])]  # repeated queries and a repeated candidate
    good = [(i, np.floor(np.array(v) * 256)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    want = []
    for q, x in good:
        if q % 50 == 0:
            best = sorted((-int(x @ y), i) for i, y in good if i != q and len(y) == len(x))[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    for pages in ({}, {"page_rows": 16, "group_pages": 4, "n_pivots": 7, "fan": 3, "block": 2}):
        assert sorted(map(tuple, search.top_k(df, **pages).collect())) == sorted(want)
    assert search.top_k(df.limit(0)).isEmpty()
