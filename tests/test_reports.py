"""Parsers of external tools' reports on small reports of each form."""

import pytest

from corpuslens.operators import payloads
from corpuslens.sources import reports

GNU = "src/a.c:12: unused variable\nsrc/b.c:7:3: missing ;\nno match here\nbad:x: y"
FLAT = '[{"file":"a.py","line":3,"message":"m1"},{"filename":"b.py","row":9,"text":"m2"},{"path":"c.py","reason":"m3"},{"line":1,"message":"lost"},{"file":"d.py","line":"x","message":"bad line"}]'
ESLINT = '[{"filePath":"a.ts","messages":[{"line":1,"message":"x"},{"line":5,"message":"y"}]},{"filePath":"b.ts","messages":[]}]'
GOLANG = '{"Issues":[{"Text":"err","Pos":{"Filename":"m.go","Line":4}},{"Text":"","Pos":{"Filename":"n.go","Line":1}}]}'
RUBOCOP = '{"files":[{"path":"a.rb","offenses":[{"message":"long","location":{"line":2}},{"message":"wide","location":{"line":8}}]},{"path":"b.rb","offenses":[]}]}'
CARGO = '{"reason":"compiler-message","message":{"rendered":"warning: x\\n --> a.rs","spans":[{"file_name":"a.rs","line_start":6},{"file_name":"z.rs","line_start":1}]}}\nnot json\n{"reason":"build-finished"}\n{"reason":"compiler-message","message":{"message":"plain","spans":[{"file_name":"b.rs","line_start":2}]}}'
CREDO = '{"issues":[{"filename":"a.ex","line_no":3,"message":"m","category":"design","check":"C1"},{"filename":"b.ex","line_no":1,"message":"n"}]}'
PHPSTAN = '{"files":{"a.php":{"messages":[{"message":"p","line":42}]},"b.php":{"messages":[{"message":"q","line":1},{"message":"r","line":2}]}}}'
NEXT = 'info\n[{"filePath":"a.tsx","messages":[{"line":0,"message":"l1"},{"line":4,"message":"l2"}]},{"filePath":"b.tsx","messages":[]}]\ndone'

EXPECTED = {
    "gnu": (GNU, [("src/a.c", 12, "unused variable"), ("src/b.c", 7, "missing ;")]),
    "json": (FLAT, [("a.py", 3, "m1"), ("b.py", 9, "m2"), ("c.py", 0, "m3")]),
    "eslint": (ESLINT, [("a.ts", 1, "x"), ("a.ts", 5, "y")]),
    "golangci": (GOLANG, [("m.go", 4, "err")]),
    "rubocop": (RUBOCOP, [("a.rb", 2, "long"), ("a.rb", 8, "wide")]),
    "cargo": (CARGO, [("a.rs", 6, "warning: x"), ("b.rs", 2, "plain")]),
    "credo": (CREDO, [("a.ex", 3, "[design] m (C1)"), ("b.ex", 1, "n")]),
    "phpstan": (PHPSTAN, [("a.php", 42, "p"), ("b.php", 1, "q"), ("b.php", 2, "r")]),
    "next_lint": (NEXT, [("a.tsx", 1, "next lint: l1 (2 issue(s) in file)")]),
}


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_report(spark, name):
    raw, rows = EXPECTED[name]
    assert sorted(map(tuple, reports.PARSERS[name](spark.createDataFrame([(raw,), ("",), (None,), ("{",)], "raw string")).collect())) == rows


def test_steps(spark):
    text = "1. First step\n   more of it\n2) Second\n\nintro\n10. Last"
    found = payloads.steps(spark.createDataFrame([(1, text)], "doc_id int, text string")).select("number", "title", "n_lines")
    assert sorted(map(tuple, found.collect())) == [(1, "First step", 2), (2, "Second", 2), (10, "Last", 1)]
