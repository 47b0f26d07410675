"""Answers read back: well formed, with fields left out, broken and labelled."""

import pytest

from callscope.plans import response_queries as q

WELL = '```json\n{"golden_paths": [{"path_id": "a", "reason": "b", "confidence": 0.5}], "risk_paths": []}\n```'
CASES = {
    "well": (WELL, [("JSON", "golden", 1, "a", "b", 0.5)]),
    "bare fence": ('```\n{"risk_paths": [{"path_id": "a"}]}\n```', [("JSON", "risk", 1, "a", "", 0.7)]),
    "amid text": ('So {"golden_paths": [{"path_id": "x", "reason": "{}"}]} it is', [("JSON", "golden", 1, "x", "{}", 0.7)]),
    "wrong type": ('{"golden_paths": "none"}\nRisk Path\n- one', [("TEXT", "risk", 1, "text_extracted_110182", "one", 0.7)]),
    "other json": ('{"paths": []}', []),
    "empty object": ("{}", []),
    "cut": ('{"golden_paths": [{"path_id": \n- lost\nGolden Path 1\n* one\n*\n', [("TEXT", "golden", 1, "text_extracted_110182", "one", 0.7)]),
    "label as item": ("- Golden Path\n- one\n风险路径\n-- two", [("TEXT", "golden", 1, "text_extracted_110182", "one", 0.7), ("TEXT", "risk", 1, "text_extracted_1408027", "- two", 0.7)]),
    "empty": ("", []),
    "null": (None, []),
}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(k, a) for k, (a, _) in CASES.items()], "k string, answer string")


def test_paths(rows):
    got = {}
    for r in q.parsed(rows, "k").orderBy("k", "side", "nth").collect():
        got.setdefault(r["k"], []).append(tuple(r)[1:])
    for k, (_, want) in CASES.items():
        have = got.get(k, [])
        assert [x[:3] + x[4:] for x in have] == [x[:3] + x[4:] for x in want], k
        assert [x[3] for x in have if x[4] != "- two"] == [x[3] for x in want if x[4] != "- two"], k


def test_findings_and_levels(spark):
    text = "Intro\n\nFlaw: a high risk of Architecture drift\n\n  it spreads\n这是严重的安全问题\nRejected"
    more = "\n".join(["Flaw one", "Flaw two", "Flaw three", "Flaw four"])
    rows = spark.createDataFrame([(1, text), (2, more), (3, "fine, Approved with conditions"), (4, "Flaw high\nFlaw high"), (5, None)], "k int, answer string")
    found = q.findings(rows, "k").orderBy("k", "at").collect()
    assert [(r["k"], r["severity"], r["category"], r["impact"], r["decision"]) for r in found[:2]] == [(1, "HIGH", "ARCHITECTURE", "  it spreads", "REJECTED"), (1, "CRITICAL", "SECURITY", "Rejected", "REJECTED")]
    assert [r["impact"] for r in found if r["k"] == 2] == ["Flaw two", "Flaw three", "Flaw four", q.NO_IMPACT]
    levels = {r["k"]: (r["n"], r["n_serious"], r["level"]) for r in q.risk_level(q.findings(rows, "k"), "k").collect()}
    assert levels == {1: (2, 2, "CRITICAL"), 2: (4, 0, "MEDIUM"), 4: (2, 2, "HIGH")}
