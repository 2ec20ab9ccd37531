"""Rules over files: what is shuffled and held by a task must not grow faster than the input."""

import hashlib

from corpuslens.operators import blocks, code_rules


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_hits_of_files_are_dealt_by_path(spark, monkeypatch):
    """Repeated paths count once, and the tasks follow the number of files."""
    monkeypatch.setattr(code_rules, "FILES_A_TASK", 10)
    rows = [(f"a{i}.py", "python", "eval(x)\neval(y)\n") for i in range(60)] + [("a1.py", "python", "eval(z)\nexcept:\n"), ("n.py", None, "eval(x)\n"), ("c.css", "css", "eval(x)\n"), ("d.py", "python", None)]
    found = code_rules.smell_counts(spark.createDataFrame(rows, "path string, lang string, text string"))
    assert {tuple(r) for r in found.collect()} == {("eval_call", 121, 60), ("bare_except", 1, 1)}
    assert "hashpartitioning(path#" in _plan(found) and ", 7), REPARTITION_BY_NUM" in _plan(found)


def test_rules_are_not_interpreted(spark):
    files = spark.createDataFrame([("a.py", "python", "x = eval(y)\n# eval(z)\nfrom a import *\n"), ("b.ts", "typescript", "eval(y)\nlet a: any; // @ts-ignore\n")], "path string, lang string, text string")
    found = code_rules.rule_hits(files)
    assert sorted(map(tuple, found.collect())) == [("a.py", 1, "eval_call"), ("a.py", 3, "star_import"), ("b.ts", 2, "any_type"), ("b.ts", 2, "ts_ignore")]
    assert "lambda" not in _optimized(found)


def test_words_are_combined_before_they_meet_enums(spark):
    enum = "from enum import Enum\nclass {}(Enum):\n    A = 1\n"
    rows = [("a.py", "python", enum.format("Used")), ("b.py", "python", enum.format("Alone") + "Alone Alone\n"), ("c.ts", "typescript", "Used.A Enum class")]
    rows += [("d.py", "python", enum.format("Twice")), ("d.py", "python", "Twice.A\n"), ("e.py", "python", None)]
    found = code_rules.unused_enums(spark.createDataFrame(rows, "path string, lang string, text string"))
    assert {tuple(r) for r in found.collect()} == {("b.py", "Alone"), ("d.py", "Twice")}
    assert "partial_min" in _plan(found)


def test_bodies_are_made_once(spark):
    files = spark.createDataFrame([("a.py", "def f(a):\n    x = 1  # note\n    return x\n\ndef g():\n    pass\n"), ("b.py", None)], "path string, text string")
    found = blocks.unit_digests(blocks.indent_units(files))
    body = "def f(a):\nx = 1\nreturn x"
    assert [tuple(r) for r in found.collect()] == [("a.py", "f", 1, 3, hashlib.md5(body.encode()).hexdigest())]
    assert _optimized(found).count("log(ger|ging)") == 1
