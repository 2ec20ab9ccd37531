"""Directory rules, dynamic imports and source-text folds against plain loops."""

import random
import re

from corpuslens.operators import boards, code_rules


def _nesting(text):
    depth, stack, deepest = 0, [], []
    for line in text.split("\n"):
        for m in re.finditer(r"<(\w+Provider)\b(?!.*/>)", line):
            stack.append(m[1])
            if len(stack) > len(deepest):
                deepest = list(stack)
        for m in re.finditer(r"</(\w+Provider)\s*>", line):
            if stack and stack[-1] == m[1]:
                stack.pop()
    return deepest


def test_context_nesting_equals_a_loop(spark):
    rng = random.Random(4)
    parts = ["<AProvider>", "<BProvider x>", "<CProvider />", "</AProvider>", "</BProvider >", "text", "<AProvider><BProvider>", "</BProvider></AProvider>"]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(80)] + [None, "", "no"]
    rows = [(str(i), "typescript", t) for i, t in enumerate(texts)]
    found = {r.path: r.names for r in code_rules.context_nesting(spark.createDataFrame(rows, "path string, lang string, text string"), 2).collect()}
    expected = {p: ",".join(_nesting(t)) for p, _, t in rows if t and len(_nesting(t)) > 2}
    assert expected and found == expected


def test_dynamic_imports_equal_the_five_tests(spark):
    rng = random.Random(5)
    name = lambda: "/".join(rng.choice("abc") * rng.randint(1, 2) for _ in range(rng.randint(1, 3)))
    files = sorted({name() + rng.choice([".py", ".ts", "", ".d.ts"]) for _ in range(60)})
    targets = sorted({rng.choice(["./", "../", "", "x/"]) + name() + rng.choice(["", ".py", ".ts"]) for _ in range(12)})

    def hit(path):
        base = path.rsplit("/", 1)[-1]
        cut = base.rsplit(".", 1)[0] if "." in base[1:] else base
        bare = path[: len(path) - len(base)] + cut
        for t in targets:
            r = t.lstrip("./")
            if r and (r in (bare, path) or bare.endswith(r) or r == cut or r.endswith("/" + cut) or r.endswith("/" + base)):
                return True
        return False

    made = boards.dynamically_imported(spark.createDataFrame([(f,) for f in files], "path string"), spark.createDataFrame([(t,) for t in targets], "target string"))
    assert {r.path for r in made.collect()} == {f for f in files if hit(f)} != set(files)


def test_directories_of_nothing(spark):
    none = boards.child_dirs(spark.createDataFrame([], "path string"))
    assert none.count() == boards.fragmented_dirs(none).count() == boards.thin_wrappers(none, ["x"]).count() == 0
