"""Blocks of source text against loops over random texts."""

import random
import re

from pyspark.sql import functions as F

from corpuslens.operators import blocks
from corpuslens.operators import code_rules as code


def _files(spark, texts):
    return spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "path string, text string")


def _units(text):
    out, stack, last = [], [], 0
    for no, line in enumerate((text or "").split("\n"), 1):
        if not line.strip(" "):
            continue
        indent = len(line) - len(line.lstrip(" "))
        while stack and stack[-1][3] >= indent:
            name, parent, start, _ = stack.pop()
            out.append((name, parent, start, last))
        head = re.search(blocks.HEADER, line)
        if head:
            stack.append((head[1], stack[-1][0] if stack else None, no, indent))
        last = no
    return sorted(out + [(n, p, s, last) for n, p, s, _ in stack], key=repr)


def test_units_equal_a_loop(spark):
    rng, texts = random.Random(3), [None, "", "def a():", "x\n\n", "  def odd(x):\n y\n"]
    for _ in range(60):
        lines = []
        for i in range(rng.randint(1, 40)):
            line = rng.choice([f"def f{i}(a):", f"async def g{i}():", "x = 1", "", "   ", "return y"])
            lines.append(" " * rng.choice([0, 2, 4, 4, 8]) + line)
        texts.append("\n".join(lines))
    found = {}
    for r in blocks.indent_units(_files(spark, texts)).collect():
        found.setdefault(r.path, []).append((r.name, r.parent, r.start_line, r.end_line))
        assert r.text.split("\n")[0].lstrip().startswith(("def", "async"))
    assert {p: sorted(u, key=repr) for p, u in found.items()} == {f"f{i}": u for i, t in enumerate(texts) if (u := _units(t))}


def _held(lines, acquire):
    state = "none"
    for line in lines:
        if re.search(acquire, line):
            state = "held" if state == "none" else state
        elif re.search(r"\bdrop\(", line):
            state = "none" if state == "held" else state
        elif ".await" in line and state == "held":
            state = "violated"
    return state == "violated"


def test_async_locks_equal_a_loop(spark):
    rng, texts, expected = random.Random(5), [], set()
    std, waiting = r"let\s+(?:mut\s+)?\w+\s*=.*\.lock\(\)\.unwrap\(", r"let\s+(?:mut\s+)?\w+\s*=.*\.lock\(\)\.await"
    for i in range(150):
        lines = rng.choices(["let g = m.lock().unwrap();", "let mut h = m.lock().await;", "drop(g);", "tick().await;", "x();", "m.lock().unwrap().push(1);"], [1, 1, 1, 1, 4, 1], k=rng.randint(0, 9))
        texts.append("async fn run() {\n" + "\n".join(lines) + "\n}\nfn other() { m.lock().unwrap(); }")
        kind = "std_guard" if _held(lines, std) else "async_guard" if _held(lines, waiting) else "blocking_lock" if any("unwrap" in x for x in lines) else None
        if kind:
            expected.add((f"f{i}", "run", kind))
    assert {tuple(r) for r in blocks.async_locks(blocks.brace_blocks(_files(spark, texts))).collect()} == expected


def test_braces_equal_a_loop(spark):
    rng, texts = random.Random(6), [None, "", "}", "{", "a {b} c", "}{"]
    texts += ["".join(rng.choices("{}ab\n", [2, 2, 1, 1, 1], k=rng.randint(1, 60))) for _ in range(80)]
    found = {(r.path, r.line, r.depth, r.own) for r in blocks.brace_blocks(_files(spark, texts)).where("depth > 0").collect()}
    expected = set()
    for i, text in enumerate(texts):
        open_, depth = [], 0
        if text is None or _dips(text):
            found = {r for r in found if r[0] != f"f{i}"}  # a file that closes more than it opened has no defined blocks
            continue
        for k, c in enumerate(text):
            if open_:
                open_[-1][2].append(c)
            if c == "{":
                depth += 1
                open_.append((text[: k + 1].count("\n") + 1, depth, []))
            elif c == "}" and open_:
                line, d, own = open_.pop()
                depth -= 1
                expected.add((f"f{i}", line, d, "".join(own)))
        expected |= {(f"f{i}", line, d, "".join(own) if own else None) for line, d, own in open_}
    assert {(p, n, d, o or None) for p, n, d, o in found} == {(p, n, d, o or None) for p, n, d, o in expected}


def _dips(text):
    depth = 0
    for c in text:
        depth += (c == "{") - (c == "}")
        if depth < 0:
            return True
    return False


def test_cohesion_equals_union_find(spark):
    rng, units, calls = random.Random(9), [], []
    for f in range(30):
        n = rng.randint(8, 25)
        names = [f"{rng.choice('abcdef')}_{i}" for i in range(n)]
        units += [(f"f{f}", x) for x in names]
        calls += [(f"f{f}", *rng.sample(names, 2)) for _ in range(rng.randint(0, n))]
    imports = [(p, n, rng.choice(["os", "re", "io", "sys", "abc"])) for p, n in units for _ in range(2)]
    expected = set()
    for f in {p for p, _ in units}:
        names = [n for p, n in units if p == f]
        root = {n: n for n in names}
        for p, a, b in calls:
            if p == f and root[a] != root[b]:
                root = {n: root[a] if r == root[b] else r for n, r in root.items()}
        sizes = [sum(r == x for r in root.values()) for x in set(root.values())]
        some, families = sum(s >= max(2, len(names) // 10) for s in sizes), len({n.split("_")[0] for n in names})
        sets = len({frozenset(r for p, m, r in imports if p == f and m == n) for n in names})
        if len(names) >= 10 and ((len(sizes) >= 3 and max(sizes) <= len(names) // 2) or (some >= 3 and (families >= 5 or sets >= 4))):
            expected.add((f, len(names), len(sizes), max(sizes), families, sets))
    frames = spark.createDataFrame(units, "path string, name string"), spark.createDataFrame(calls, "path string, src string, dst string"), spark.createDataFrame(imports, "path string, name string, root string")
    assert {tuple(r) for r in blocks.cohesion(*frames).collect()} == expected and expected


def test_bodies(spark):
    """Bodies without docstrings, comments and logging; C-style comments, but not what looks like one in a string."""
    bodies = [(1, 'def f():\n    """Doc\n    string."""\n    # note\n    x = 1  # one\n\n    print(x)\n    logger.info(x)\n    return x'), (2, "a = '// no'; // yes\n/* block\n more */ b = 2")]
    rows = spark.createDataFrame(bodies, "id int, text string")
    found = rows.select(code.normalised_body(F.col("text")), code.without_comments(F.col("text"))).collect()
    assert found[0][0] == "def f():\n    x = 1\n    return x" and found[1][1] == "a = '// no'; \n b = 2"
