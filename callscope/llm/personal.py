"""Personal data in texts (operator 12) by weak supervision, with DataFrame functions only.

*Base* spans are those of four patterns (``BASE``), leftmost and not overlapping within a kind, that pass the kind's test. They always
stay. What the patterns swallow or miss (a card number that the pattern joins with an address beside it, ``name [at] host [dot] org``) is looked
for among *candidates*: matches that pass once other kinds' spans are out of the way, and looser, shorter shapes in what is left of the text. Six labelers vote on each candidate, for, against or
not at all: the pattern's strict form, a check (checksum, range, length), a gazetteer (issuers, dial codes, endings of domains, reserved addresses), words before
that speak for the kind, words that speak against it, and what touches the candidate.

Expectation-maximisation over the counts of the vote patterns of all base spans and candidates (at most ``3 ** 6`` a kind, however many there are)
estimates how often each labeler votes what on personal and on other spans, and so the probability of each pattern. Base spans are personal throughout;
no labeler is taken for worse than chance, a failed check weighs at least ``LEAST``, and of candidates no more than half are taken to be personal, since votes
alone can't tell which of two classes is which. A logistic
regression of the candidate's shape, neighbours and votes is trained on a bounded sample of candidates (``per_kind`` of each kind, drawn by a hash), weighted by
these probabilities; it gives the final score of every candidate, and those from ``threshold`` on become spans.

Texts are read once; spans and candidates, which are small, are written to the shared folder and all else reads them. Nothing is
shuffled but vote counts and the sample. Positions count code points; a span's end is exclusive.

Defined results: a null or empty text has no spans; a null id stays; repeated rows have the same spans each; a text of any length is taken whole; without candidates
there is nothing to learn and only base spans are given; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import materialize

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
LABEL = "[A-Za-z0-9-]"
# The patterns of the contract. Runs are possessive and begin where a run of their characters does, or where the last match ended: the same
# matches, in time that grows with the text alone.
BASE = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OPEN, _CLOSE = r"\x20?[\[({]\x20?", r"\x20?[\])}]\x20?"
_AT = rf"(?:[@＠]|{_OPEN}(?:at|AT|@){_CLOSE})"
_DOT = rf"(?:\.|{_OPEN}(?:dot|DOT|\.){_CLOSE})"
LOOSE = {
    "email": rf"(?<!{LOCAL}){LOCAL}++(?:{_AT}{LABEL}++(?:{_DOT}{LABEL}++)++|\x20(?:at|AT)\x20{LABEL}++(?:\x20(?:dot|DOT)\x20{LABEL}++)++)",
    "ip": rf"(?<![0-9.])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20.-][0-9]{4}){3}|[0-9]{4}[\x20.-][0-9]{6}[\x20.-][0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}|[0-9]{2,4}(?:[\x20.-][0-9]{2,4}){2,4})(?![0-9])",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
MAY = {"email": r"[@＠]|(?:at|AT)\x20?[\])}]|\x20(?:at|AT)\x20", "ip": r"[0-9]{1,3}[\x20\[({.]", "card": "[0-9]{4}", "phone": "[0-9]{2}"}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

# Gazetteers and context words.
ENDINGS = "com|org|net|edu|gov|mil|int|info|biz|io|eu|co|uk|de|fr|es|it|nl|at|ch|be|pt|pl|se|no|dk|fi|cz|us|ca|mx|br|ar|cl|in|cn|jp|kr|au|nz|ru|za"
ISSUERS = "4[0-9]{12}|4[0-9]{15}|4[0-9]{18}|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12}|35[0-9]{14}|3[068][0-9]{12}"
DIAL_CODES = "1|7|20|27|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1-8]|35[0-9]|38[0-9]|42[01]|97[1-9]"
RESERVED = r"^0*(?:0|127|22[4-9]|2[3-5][0-9])\D|^(?:0*[0-9]\D+){3}0*[0-9]$"
FOR = {
    "email": "mail|contact|kontakt|correo|courriel|write to|schreib|reach|address",
    "ip": r"\bip\b|host|server|addr|ping|gateway|client|login from",
    "card": "card|visa|master|amex|credit|karte|carte|tarjeta|pay",
    "phone": "phone|tel|call|fax|mobil|handy|whatsapp|sms|llam|appel|ruf",
}
AGAINST = {
    "email": "token|password|import|secret|decorator|version",
    "ip": "version|release|chapter|section|build|v$|ver[.]?$",
    "card": "token|password|secret|sha|hash|serial|isbn|order|invoice|tracking|uuid|key",
    "phone": "token|password|secret|sha|hash|isbn|order|invoice|version|date|serial|page|id",
}
LABELERS = ("form", "check", "gazetteer", "words_for", "words_against", "touching")
AGAINST_IT, FOR_IT, SILENT = 0, 1, 2
FILLER = "\u0001"
BEFORE, AFTER = 24, 8
WIDTH = 2048


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often a lambda in it asks for the value."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(x: Column) -> Column:
    """Sum of the values before each value of a short array."""
    return F.slice(F.aggregate(x, F.array(F.lit(0)), lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v))), 1, F.size(x))


def running(x: Column, block: int = 256) -> Column:
    """Sum of the values before each value: within blocks, then over them, so that long arrays aren't copied for each value."""
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(x) - 1) / block)).cast("int")), lambda b: F.slice(x, b * block + 1, block))
    total = lambda y: F.aggregate(y, F.lit(0), lambda a, v: a + v)
    return let(blocks, lambda bs: F.flatten(F.zip_with(F.transform(bs, _running), _running(F.transform(bs, total)), lambda inner, before: F.transform(inner, lambda v: v + before))))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def valid(kind: str, s: Column) -> Column:
    """Whether a match of the kind's base pattern passes its test."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return s.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    n = F.length(digits(s))
    return n.between(9, 15) if kind == "phone" else n.between(13, 19) & F.call_function("luhn_check", digits(s))


def test_of(kind: str) -> Callable[[Column], Column]:
    return lambda s: valid(kind, s)


def pieces(text: Column, pattern: str, needs: str) -> Column:
    """``gaps`` and ``found``: what stands between the matches of a pattern, and the matches."""
    found = F.when(text.rlike(needs), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return let(found, lambda f: F.struct(F.when(F.size(f) > 0, F.split(text, pattern, -1)).otherwise(F.array(text)).alias("gaps"), f.alias("found")))


def spans(p: Column) -> Column:
    """Matches with their places and what stands beside them."""

    def of(gaps: Column, found: Column) -> Column:
        lengths = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, f: F.length(g) + F.length(f))

        def at(before: Column) -> Column:
            def one(f: Column, i: Column) -> Column:
                gap = F.get(gaps, i)
                start = F.get(before, i) + F.length(gap)
                return F.struct(start.alias("start"), (start + F.length(f)).alias("end"), f.alias("value"), F.right(gap, F.lit(BEFORE)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(AFTER)).alias("after"))

            return F.transform(found, one)

        return let(let(lengths, lambda x: running(x)), at)

    return F.when(F.size(p["found"]) > 0, of(p["gaps"], p["found"])).otherwise(F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>"))


def kept(found: Column, test: Callable[[Column], Column]) -> Column:
    return F.filter(found, lambda s: test(s["value"]))


def blanked(p: Column, test: Callable[[Column], Column]) -> Column:
    """The text with a filler in place of each match that passes the test."""
    held = F.transform(p["found"], lambda f: F.when(test(f), F.repeat(F.lit(FILLER), F.length(f))).otherwise(f))
    return F.when(F.size(p["found"]) == 0, F.get(p["gaps"], F.lit(0))).otherwise(F.array_join(F.zip_with(p["gaps"], F.concat(held, F.array(F.lit(""))), lambda g, f: F.concat(g, f)), ""))


def not_among(found: Column, known: Column) -> Column:
    """The spans of ``found`` that begin where none of ``known`` does; nothing is searched where both begin alike, as they mostly do."""
    starts = lambda x: F.transform(x, lambda s: s["start"])
    return F.when(starts(found) == starts(known), F.slice(found, 1, 0)).otherwise(let(starts(known), lambda k: F.filter(found, lambda s: ~F.array_contains(k, s["start"]))))


def found_in(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, the base spans of each kind and its candidates, one row a document."""
    out = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("left", F.col("text"))
    for k in KINDS:
        out = out.withColumn("p", pieces(F.col("text"), BASE[k], NEEDS[k])).withColumn(k, kept(spans(F.col("p")), test_of(k)))
        # what only passes once spans of the kinds before are out of the way is a candidate
        out = out.withColumn("p", pieces(F.col("left"), BASE[k], NEEDS[k])).withColumn("alone", kept(spans(F.col("p")), test_of(k)))
        out = out.withColumn(f"freed_{k}", not_among(F.col("alone"), F.col(k))).withColumn("left", blanked(F.col("p"), test_of(k)))
    for k in KINDS:
        out = out.withColumn("p", pieces(F.col("left"), LOOSE[k], MAY[k])).withColumn(f"more_{k}", F.concat(f"freed_{k}", spans(F.col("p")))).withColumn("left", blanked(F.col("p"), lambda f: F.lit(True)))
    return out.select("key", *KINDS, *[f"more_{k}" for k in KINDS])


def votes(kind: str, s: Column) -> Column:
    """What each labeler says of a candidate, in the order of ``LABELERS``."""
    value, before, after = s["value"], F.lower(s["before"]), s["after"]
    plain = F.regexp_replace(F.regexp_replace(value, rf"{_AT}|\x20(?:at|AT)\x20", "@"), rf"{_DOT}|\x20(?:dot|DOT)\x20", ".")
    yes_no = lambda c: F.when(c, FOR_IT).otherwise(AGAINST_IT)
    if_so = lambda c, vote: F.when(c, vote).otherwise(SILENT)
    d = digits(value)
    own = {
        "email": (yes_no(plain.rlike(rf"^{LOCAL}+@{LABEL}+(\.{LABEL}+)+$")), yes_no(plain.rlike(r"^(?=[^@]{1,64}@)[^@]*[A-Za-z][^@]*@") & ~plain.rlike(r"\.\.|^[.-]|@-|-\.")), yes_no(F.lower(plain).rlike(rf"\.(?:{ENDINGS})$"))),
        "ip": (yes_no(plain.rlike(r"^[0-9]+(\.[0-9]+){3}$")), yes_no(plain.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")), if_so(plain.rlike(RESERVED), AGAINST_IT)),
        "card": (yes_no(value.rlike(r"^[0-9]+$|^[0-9]{4}([\x20-])(?:[0-9]{4}\1){2}[0-9]{4}$|^[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{5}$")), yes_no(F.call_function("luhn_check", d)), yes_no(d.rlike(rf"^(?:{ISSUERS})$"))),
        "phone": (yes_no(value.rlike(r"^\+|\(")), yes_no(F.length(d).between(9, 15)), F.when(value.rlike(rf"^\+(?:{DIAL_CODES})(?:[\x20.(-]|[0-9]{{6}})"), FOR_IT).when(value.startswith("+"), AGAINST_IT).otherwise(SILENT)),
    }[kind]
    touching = before.rlike(r"[\p{L}\p{N}_=/\"'-]$") | after.rlike(r"^[\p{L}\p{N}_=/\"'-]")
    return F.array(*own, if_so(before.rlike(FOR[kind]), FOR_IT), if_so(before.rlike(AGAINST[kind]), AGAINST_IT), yes_no(~touching)).cast("array<int>")


def features(kind: str, s: Column) -> Column:
    """Numbers below ``WIDTH`` that stand for a candidate's shape, its neighbours and its votes."""
    shape = F.regexp_replace(F.regexp_replace(s["value"], r"[\p{L}]+", "a"), "[0-9]", "9")
    word = F.regexp_extract(F.lower(s["before"]), r"([\p{L}]+)[^\p{L}]*$", 1)
    said = let(votes(kind, s), lambda vs: F.concat(F.transform(vs, lambda v, i: F.concat(F.lit("vote"), i.cast("string"), F.lit("="), v.cast("string"))), F.array(F.concat(F.lit("votes="), F.array_join(vs, "")))))
    names = F.concat(
        F.array(F.concat(F.lit("shape="), F.when(F.length(shape) <= 40, shape).otherwise("long")), F.concat(F.lit("word="), word), F.concat(F.lit("last="), F.regexp_replace(F.right(s["before"], F.lit(1)), r"[\p{L}]", "a")), F.concat(F.lit("next="), F.regexp_replace(F.left(s["after"], F.lit(1)), r"[\p{L}]", "a")), F.concat(F.lit("digits="), F.length(digits(s["value"])).cast("string"))),
        said,
    )
    return F.array_distinct(F.transform(names, lambda n: F.pmod(F.xxhash64(F.lit(kind), n), F.lit(WIDTH)).cast("int")))


#: Pseudo-counts that the estimates start from and are smoothed by: labelers are right four times of five when they speak.
PRIOR = {"yes": (2.0, 8.0, 5.0), "no": (8.0, 2.0, 5.0)}
#: Log-odds that a labeler's vote for and against weighs at least, and that any vote weighs at most.
LEAST = {"form": (0.2, 0.2), "check": (0.5, 4.0), "gazetteer": (0.5, 0.5), "words_for": (0.5, 0.0), "words_against": (0.0, 0.5), "touching": (0.2, 1.0)}
MOST = 6.0


class Reliabilities:
    """Share of personal spans and each labeler's votes on them and on others, of one kind."""

    def __init__(self, share: float, yes: list[list[float]], no: list[list[float]]) -> None:
        self.offset = log(min(share, 0.5) / (1 - min(share, 0.5)))
        self.weights = []
        for (least_for, least_against), y, n in zip(LEAST.values(), yes, no, strict=True):
            against, for_it, silent = (log((a / sum(y)) / (b / sum(n))) for a, b in zip(y, n, strict=True))
            self.weights.append((max(-MOST, min(against, -least_against)), min(MOST, max(for_it, least_for)), max(-0.3, min(0.3, silent))))


def posterior(by_kind: dict[str, Reliabilities]) -> Column:
    """Probability that a span of vote pattern ``kind, votes`` is personal; 1 for a ``seed``."""
    odds = F.lit(0.0)
    for k, r in by_kind.items():
        said = [F.element_at(F.array(*map(F.lit, w)), F.element_at("votes", j + 1) + 1) for j, w in enumerate(r.weights)]
        odds = F.when(F.col("kind") == k, sum(said, F.lit(r.offset))).otherwise(odds)
    return F.when(F.col("seed"), 1.0).otherwise(1 / (1 + F.exp(-odds)))


def reliabilities(patterns: DataFrame, rounds: int = 30, tolerance: float = 1e-3) -> dict[str, Reliabilities]:
    """What the votes are worth, by kind, by expectation-maximisation.

    ``patterns`` holds ``kind, seed, votes, n``, at most twice ``3 ** 6`` rows a kind; a round is one job over them.
    """
    start = Reliabilities(0.5, [list(PRIOR["yes"])] * len(LABELERS), [list(PRIOR["no"])] * len(LABELERS))
    by_kind, last = dict.fromkeys(KINDS, start), 0.0
    n, p = F.col("n"), F.col("p")
    free = n * (~F.col("seed")).cast("int")
    votes_of = {(s, j, v): F.sum(n * q * (F.element_at("votes", j + 1) == v).cast("int")) for s, q in (("yes", p), ("no", 1 - p)) for j in range(len(LABELERS)) for v in range(3)}
    for _ in range(rounds):
        rows = patterns.withColumn("p", posterior(by_kind)).groupBy("kind").agg(F.sum(free).alias("n"), F.sum(free * p).alias("yes"), *[c.alias(f"{s}{j}{v}") for (s, j, v), c in votes_of.items()]).collect()
        for r in rows:
            counted = {s: [[r[f"{s}{j}{v}"] + PRIOR[s][v] for v in range(3)] for j in range(len(LABELERS))] for s in PRIOR}
            by_kind[r["kind"]] = Reliabilities((r["yes"] + 5) / (r["n"] + 10), counted["yes"], counted["no"])
        personal = sum(r["yes"] / max(1, r["n"]) for r in rows)
        if abs(personal - last) < tolerance:
            break
        last = personal
    return by_kind


def candidates(found: DataFrame) -> DataFrame:
    """``kind, seed, votes, features`` of every base span (a seed) and candidate."""

    def told(k: str, of: str, seed: bool) -> Column:
        return F.transform(of, lambda s: F.struct(F.lit(k).alias("kind"), F.lit(seed).alias("seed"), votes(k, s).alias("votes"), features(k, s).alias("features")))

    every = F.concat(*[told(k, k, True) for k in KINDS], *[told(k, f"more_{k}", False) for k in KINDS])
    return found.select(F.explode(every).alias("c")).select("c.*")


def fitted(found: DataFrame, per_kind: int = 5000) -> tuple[list[float], float] | None:
    """Weights and offset of the final classifier; ``None`` without candidates.

    The vote counts are of all spans. The regression is fitted to at most ``per_kind`` spans of each kind with different features or votes, drawn by
    a hash; each stands once for and once against, with the weights that its votes give it.
    """
    every = materialize(candidates(found).groupBy("kind", "seed", "votes", "features").agg(F.count(F.lit(1)).alias("n")), "personal-candidates")
    patterns = materialize(every.groupBy("kind", "seed", "votes").agg(F.sum("n").alias("n")).coalesce(1), "personal-votes")
    if patterns.where(~F.col("seed")).isEmpty():
        return None
    by_kind = reliabilities(patterns)
    drawn = [every.where(F.col("kind") == k).orderBy(F.xxhash64("votes", "features"), "features", "seed").limit(per_kind) for k in KINDS]
    rows = drawn[0].unionByName(drawn[1]).unionByName(drawn[2]).unionByName(drawn[3]).withColumn("p", posterior(by_kind))
    sides = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("p").alias("share")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("share"))))
    rows = rows.select(F.transform("features", lambda f: f.cast("string")).alias("words"), F.col("n").cast("double").alias("times"), sides.alias("side")).select("words", "side.label", (F.col("times") * F.col("side.share")).alias("weight"))
    vectors = CountVectorizerModel.from_vocabulary([str(i) for i in range(WIDTH)], inputCol="words", outputCol="features", minTF=1).transform(rows)
    model = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=1e-4, maxIter=100, standardization=False, aggregationDepth=2).fit(vectors)
    return [float(w) for w in model.coefficients], float(model.intercept)


def score(kind: str, s: Column, model: tuple[list[float], float]) -> Column:
    weights = F.split(F.lit(",".join(f"{w:.6g}" for w in model[0])), ",").cast("array<double>")  # folded to one literal
    z = F.aggregate(features(kind, s), F.lit(model[1]), lambda a, f: a + F.element_at(weights, f + 1))
    return 1 / (1 + F.exp(-z))


def find(docs: DataFrame, *, text: str = "text", key: str = "doc_id", threshold: float = 0.6, per_kind: int = 5000) -> DataFrame:
    """``key`` and, for each kind, its base spans and the spans found besides, as arrays of (start, end, value, probability)."""
    found = materialize(found_in(docs, text, key), "personal-found")
    model = fitted(found, per_kind)
    shape = "array<struct<start:int,end:int,value:string,probability:double>>"
    out = [F.transform(k, lambda s: F.struct(s["start"], s["end"], s["value"], F.lit(1.0).alias("probability"))).cast(shape).alias(k) for k in KINDS]

    def more(k: str) -> Column:
        if not model:
            return F.array().cast(shape).alias(f"more_{k}")
        scored = F.transform(f"more_{k}", lambda s: F.struct(s["start"], s["end"], s["value"], score(k, s, model).alias("probability")))
        return F.filter(scored, lambda s: s["probability"] >= threshold).cast(shape).alias(f"more_{k}")

    return found.select("key", *out, *map(more, KINDS))


def written_spans(more: bool) -> Column:
    """``kind:start:end`` of all base spans, or of all spans, by kind and start, joined by commas."""

    def one(k: str) -> Column:
        held = F.array_sort(F.concat(k, f"more_{k}")) if more else F.col(k)
        return F.transform(held, lambda s: F.concat_ws(":", F.lit(k), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.concat(*map(one, KINDS)), ",")
