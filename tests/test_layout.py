"""Boxes by grid cells against every pair, and rates of how files were read."""

import random

from caseloom.operators import blocks, corpus_quality

BOXES = "version_id long, page_number long, block_num long, x0 double, y0 double, x1 double, y1 double"


def share(b, t):
    if None in b or None in t:
        return 0.0
    area = (b[2] - b[0]) * (b[3] - b[1])
    return max(0.0, min(b[2], t[2]) - max(b[0], t[0])) * max(0.0, min(b[3], t[3]) - max(b[1], t[1])) / area if area > 0 else 0.0


def test_grid_equals_all_pairs(spark):
    rnd = random.Random(6)

    def box(wide):
        x, y = rnd.randint(-3, 30) * 10.0, rnd.randint(-3, 30) * 10.0
        return (x, y, x + rnd.randint(0, wide) * 10, y + rnd.randint(0, wide) * 10)

    rows = [(rnd.randint(0, 2), rnd.randint(0, 1), i, *(box(12) if i % 15 else (None, 1.0, 2.0, 3.0) if i % 2 else (50.0, 50.0, 10.0, 10.0))) for i in range(200)]
    tables = [(rnd.randint(0, 2), rnd.randint(0, 1), i, *(box(25) if i % 9 else (None, None, None, None))) for i in range(30)]
    tables += tables[:3]
    want = sorted(r[2] for r in rows if not any(t[:2] == r[:2] and share(r[3:], t[3:]) >= 0.55 for t in tables))
    b, t = spark.createDataFrame(rows, BOXES), spark.createDataFrame(tables, BOXES)
    for cell in (7.0, 50.0, 1000.0):
        assert sorted(r.block_num for r in blocks.outside_tables(b, t, cell=cell).collect()) == want
    assert blocks.outside_tables(b, t.limit(0)).count() == 200 and blocks.outside_tables(b.limit(0), t).count() == 0


def test_rates_and_gates(spark):
    pages = "array<struct<method:string,confidence:double>>"
    schema = f"id long, g string, status string, text string, fragments array<string>, table array<array<string>>, expected_table array<array<string>>, pages {pages}"
    rows = [
        (1, "a", "ready", "Straße und Ort", ["STRASSE", "ort"], [["x", "y"], ["x", ""]], [["x"], ["x"], ["y"]], [("text", 0.5), ("none", 0.9)]),
        (2, "a", "partial", None, ["gone"], [["x"]], [["x", "x"]], [("ocr", 1.0)]),  # the cell is expected twice
        (3, "a", "failed", "", None, None, None, None),
        (4, "b", "ready", "ok", ["ok"], None, [["z"]], [("text", 1.5), ("text", None)]),
        (5, None, "ready", "", [], None, None, []),
    ]
    got = {r.g: r for r in corpus_quality.evaluated(spark.createDataFrame(rows, schema), "g").collect()}
    a, b = got["a"], got["b"]
    assert (a.documents, a.successful_documents, a.parse_success_rate, a.expected_fragment_recall, a.structured_table_recall, a.page_diagnostic_coverage) == (3, 2, 0.6667, 0.6667, 0.5, 0.6667)
    assert (b.parse_success_rate, b.expected_fragment_recall, b.structured_table_recall, b.page_diagnostic_coverage, b.failures) == (1.0, 1.0, 0.0, 0.0, "structured_table_recall,page_diagnostic_coverage")
    assert got[None].failures == "expected_fragment_recall,structured_table_recall,page_diagnostic_coverage"
    cells = {r.id: (r.expected_cells, r.found_cells) for r in corpus_quality.table_recall(spark.createDataFrame(rows, schema)).collect()}
    assert cells == {1: (3, 3), 2: (2, 1), 4: (1, 0)}
