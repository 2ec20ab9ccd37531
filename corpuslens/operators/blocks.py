"""Blocks of source text without a syntax tree: units by indentation, blocks by braces, and rules on both.

All steps are columns and windows. Indentation is folded over a file's lines with a stack; braces are matched by the
running depth, as a brace closes the last one opened at its depth. Braces in strings and comments count like any
others: strip comments first where that matters. Null texts have no lines; an unclosed block ends with its file.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.operators.code_rules import normalised_body
from corpuslens.sources.tables import unsized

HEADER = r"^\s*(?:async\s+)?def\s+(\w+)"
UNIT = "array<struct<name:string,parent:string,start:int,end:int,indent:int>>"
#: Lines of a bin when lines are met with the units that hold them.
BIN = 64


def indent_units(files: DataFrame, header: str = HEADER) -> DataFrame:
    """path, name, parent, start_line, end_line, indent and text of the units of files(path, text).

    A unit runs from its header to the last line that is not blank before one that is indented no further. ``parent``
    is the unit around it. The fold keeps the open units as a stack and the finished ones as a list.
    """
    lines = F.split("text", "\n")
    # null text: no lines
    numbered = F.transform(lines, lambda x, i: F.struct(
        (i + 1).alias("no"), (F.length(x) - F.length(F.ltrim(x))).alias("indent"), (F.trim(x) == "").alias("blank"),
        F.regexp_extract(x, header, 1).alias("name"),
    ))
    empty = F.array().cast(UNIT)
    start = F.struct(empty.alias("open"), empty.alias("done"), F.lit(0).alias("last"))

    def step(acc: Column, line: Column) -> Column:
        stays = F.filter(acc["open"], lambda u: u["indent"] < line["indent"])
        closed = F.filter(acc["open"], lambda u: u["indent"] >= line["indent"])
        ended = F.transform(closed, lambda u: u.withField("end", acc["last"]))
        unit = F.struct(line["name"].alias("name"), F.try_element_at(stays, F.lit(-1))["name"].alias("parent"), line["no"].alias("start"), F.lit(0).alias("end"), line["indent"].alias("indent"))
        opened = F.when(line["name"] != "", F.concat(stays, F.array(unit).cast(UNIT))).otherwise(stays)
        moved = F.struct(opened.alias("open"), F.concat(acc["done"], ended).alias("done"), line["no"].alias("last"))
        return F.when(line["blank"], acc).otherwise(moved)

    units = F.aggregate(numbered, start, step, lambda acc: F.concat(acc["done"], F.transform(acc["open"], lambda u: u.withField("end", acc["last"]))))
    found = files.select("path", lines.alias("lines"), F.explode(units).alias("u"))
    text = F.array_join(F.slice("lines", F.col("u.start"), F.col("u.end") - F.col("u.start") + 1), "\n")
    return found.select("path", "u.name", "u.parent", F.col("u.start").alias("start_line"), F.col("u.end").alias("end_line"), "u.indent", text.alias("text"))


def unit_digests(units: DataFrame, least_lines: int = 3) -> DataFrame:
    """path, name, start_line, n_lines and digest of the units whose normalised body has at least so many lines."""
    body = F.transform(F.split(normalised_body(F.col("text")), "\n"), lambda x: F.trim(x))
    # kept as a list of one or none: a filter on the body would be pushed below it and make every body twice
    kept = units.select("path", "name", "start_line", F.explode(F.filter(F.array(body), lambda x: F.size(x) >= least_lines)).alias("body"))
    return kept.select("path", "name", "start_line", F.size("body").alias("n_lines"), F.md5(F.array_join("body", "\n").cast("binary")).alias("digest"))


def mutated_globals(files: DataFrame, units: DataFrame) -> DataFrame:
    """path, name, unit, n: module-level lists, dicts and sets that lines of a unit change, by the innermost unit.

    Lines meet the units that hold them by bins of lines, so a long unit is many keys and not one.
    """
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("path", (F.col("pos") + 1).alias("no"), "line")
    made = r"^(\w+)\s*(?::[^=]+)?=\s*(?:\[|\{|(?:list|dict|set|defaultdict)\()"
    names = lines.where(F.col("line").rlike(made)).select("path", F.regexp_extract("line", made, 1).alias("name")).distinct()
    change = r"^\s+(\w+)(?:\.(?:append|add|update|extend|insert|pop|remove|clear|setdefault)\(|\[[^\]]*\]\s*=[^=])"
    changed = lines.where(F.col("line").rlike(change)).select("path", "no", F.regexp_extract("line", change, 1).alias("name")).join(unsized(names), ["path", "name"])
    binned = units.select("path", F.col("name").alias("unit"), "start_line", "end_line", F.explode(F.sequence(F.floor(F.col("start_line") / BIN), F.floor(F.col("end_line") / BIN))).alias("bin"))
    met = changed.withColumn("bin", F.floor(F.col("no") / BIN)).join(unsized(binned), ["path", "bin"]).where("no > start_line AND no <= end_line")
    inner = met.groupBy("path", "name", "no").agg(F.max_by("unit", "start_line").alias("unit"))
    return inner.groupBy("path", "name", "unit").agg(F.count(F.lit(1)).alias("n"))


def unit_calls(units: DataFrame) -> DataFrame:
    """path, src, dst: calls between the top-level units of a file, by name."""
    top = units.where("parent IS NULL")
    words = top.select("path", F.col("name").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\w+)\("), 1))).alias("dst"))
    return words.where("src <> dst").join(unsized(top.select("path", F.col("name").alias("dst")).distinct()), ["path", "dst"], "left_semi").select("path", "src", "dst")


def cohesion(units: DataFrame, calls: DataFrame, imports: DataFrame, least: int = 10) -> DataFrame:
    """path, n_units, n_components, largest, n_families, n_imports of files that fall into unrelated parts.

    units(path, name), calls(path, src, dst), imports(path, name, root): what a unit uses of the file's imports. Parts
    are components of calls. A file is listed if no part holds more than half of at least three, or if three parts are of
    some size and there are five families of names or four sets of imports. Calls stay within a file, so one shuffle by
    file brings all rows of one together, whose names a task holds one file at a time.
    """
    none = F.lit(None).cast("string")
    rows = units.select("path", F.lit(0).alias("kind"), F.col("name").alias("a"), none.alias("b"))
    rows = rows.union(calls.select("path", F.lit(1), "src", "dst")).union(imports.select("path", F.lit(2), "name", "root"))

    def run(batches):
        path, held = None, []
        for batch in batches:
            out = []
            for p, *row in zip(*(batch.column(c).to_pylist() for c in ("path", "kind", "a", "b"))):
                if p != path:
                    out += _unrelated_parts(path, held, least)
                    path, held = p, []
                held.append(row)
            yield _cohesion_rows(out)
        yield _cohesion_rows(_unrelated_parts(path, held, least))

    return rows.where("path IS NOT NULL").repartition("path").sortWithinPartitions("path").mapInArrow(run, COHESION)


COHESION = "path string, n_units long, n_components long, largest long, n_families long, n_imports long"


def _cohesion_rows(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in COHESION.split(", ")]
    kinds = [pa.string(), *[pa.int64()] * (len(names) - 1)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * len(names), kinds)], names=names)


def _unrelated_parts(path: str | None, rows: list, least: int) -> list[tuple]:
    """The row of ``cohesion`` of a file's rows (kind, a, b), or none."""
    units = {a for kind, a, _ in rows if kind == 0}
    if len(units) < max(1, least):
        return []
    root: dict = {}

    def top(name):
        while root.setdefault(name, name) != name:
            root[name] = name = root[root[name]]
        return name

    uses: dict = {}
    for kind, a, b in rows:
        if kind == 1:
            root[top(a)] = top(b)
        elif kind == 2:
            uses.setdefault(a, set()).update(() if b is None else (b,))
    sizes = Counter(map(top, units)).values()
    significant = sum(size >= max(2, len(units) // 10) for size in sizes)
    families, imports = len({name.split("_")[0] for name in units if name is not None}), len(set(map(frozenset, uses.values())))
    split = len(sizes) >= 3 and max(sizes) <= len(units) // 2
    mixed = significant >= 3 and (families >= 5 or imports >= 4)
    return [(path, len(units), len(sizes), max(sizes), families, imports)] if split or mixed else []


def brace_blocks(files: DataFrame) -> DataFrame:
    """path, block, parent, depth, head, line, own, outer of the blocks in braces of files(path, text).

    block: number of the opening brace in the file, parent: that of the block around it (null: none), head: the text
    between the brace before and this one, line: that of the opening brace, own: the text inside without that of inner
    blocks (but with their heads), outer: the head of the parent. Pieces are shuffled by file once; every window and
    group after it holds within a file, so nothing is joined.
    """
    order = Window.partitionBy("path").orderBy("k")
    pieces = files.select("path", F.posexplode(F.split("text", r"(?<=[{}])")).alias("k", "piece"))
    last = F.right("piece", F.lit(1))
    step = F.when(last == "{", 1).when(last == "}", -1).otherwise(0)
    lines = F.size(F.split("piece", "\n")) - 1
    placed = pieces.withColumns({"step": step, "after": F.sum(step).over(order), "line": F.sum(lines).over(order) + 1})
    # a piece lies in the block that was last opened at the depth before its brace; an opening one is a mark at the depth after it
    marks = F.array((F.col("after") - F.col("step")).alias("level"), F.when(F.col("step") == 1, F.col("after")))
    each = placed.select("*", F.posexplode(F.filter(marks, lambda level: level.isNotNull())).alias("mark", "level"))
    opened = F.when(F.col("mark") == 1, F.struct(F.col("k").alias("k"), F.col("piece").alias("head")))
    around = F.last(opened, ignorenulls=True).over(Window.partitionBy("path", "level").orderBy("k"))
    owned = each.withColumn("around", around).where("mark = 0")
    inside = F.struct(F.col("around.k").alias("block"), F.struct("k", "piece").alias("part"), F.lit(None).cast(OPENED).alias("opened"))
    head = F.struct(F.col("around.k").alias("parent"), F.col("after").cast("int").alias("depth"), F.col("piece").alias("head"), F.col("line").cast("int").alias("line"), F.col("around.head").alias("outer"))
    opens = F.struct(F.col("k").alias("block"), F.lit(None).cast("struct<k:int,piece:string>").alias("part"), head.cast(OPENED).alias("opened"))
    both = F.array(F.when(F.col("around").isNotNull(), inside), F.when(F.col("step") == 1, opens))
    rows = owned.select("path", F.explode(F.filter(both, lambda r: r.isNotNull())).alias("r")).select("path", "r.*")
    parts = F.sort_array(F.collect_list("part"))
    found = rows.groupBy("path", "block").agg(F.first("opened", ignorenulls=True).alias("o"), parts.alias("parts"))
    own = F.when(F.size("parts") > 0, F.array_join(F.transform("parts", lambda x: x["piece"]), ""))
    return found.select("path", "block", "o.parent", "o.depth", "o.head", "o.line", own.alias("own"), "o.outer")


OPENED = "struct<parent:int,depth:int,head:string,line:int,outer:string>"


def _with_parent(blocks: DataFrame) -> DataFrame:
    return blocks.where("parent IS NOT NULL")


def _named(pattern: str, column: str = "head") -> Column:
    return F.regexp_extract(column, pattern, 1)


def prop_bloat(blocks: DataFrame, most: int = 14) -> DataFrame:
    """path, name, line, n: interfaces of properties with more than so many."""
    rows = blocks.withColumn("name", _named(r"interface\s+(\w*Props)\b[^{}]*\{$")).where("name <> ''")
    return rows.select("path", "name", "line", F.regexp_count("own", F.lit(r"(?m)^\s*\w+\??\s*:")).alias("n")).where(F.col("n") > most)


HOOK = r"(?:function|const)\s+(use[A-Z]\w*)[^{}]*\{$"


def hook_return_bloat(blocks: DataFrame, most: int = 12) -> DataFrame:
    """path, name, n: hooks that return an object of more than so many fields."""
    rows = _with_parent(blocks.withColumn("name", F.lit(""))).withColumn("name", _named(HOOK, "outer")).where("name <> ''").where(F.col("head").rlike(r"return\s*\(?\s*\{$"))
    fields = F.filter(F.split(F.regexp_replace("own", r"\}$", ""), ","), lambda x: F.trim(x) != "")
    return rows.select("path", "name", F.size(fields).alias("n")).where(F.col("n") > most)


def boolean_states(blocks: DataFrame, least: int = 3) -> DataFrame:
    """path, name, n: functions with at least so many boolean states."""
    rows = blocks.withColumn("name", _named(r"(?:function|const)\s+(\w+)[^{}]*\{$")).where("name <> ''")
    return rows.select("path", "name", F.regexp_count("own", F.lit(r"useState(?:<boolean>)?\(\s*(?:true|false)\s*\)")).alias("n")).where(F.col("n") >= least)


def drop_hazards(blocks: DataFrame) -> DataFrame:
    """path, name, kind: destructors that panic ('panic') or unwrap ('unwrap')."""
    rows = _with_parent(blocks).withColumn("name", _named(r"impl[^{}]*\bDrop\s+for\s+(\w+)", "outer")).where("name <> ''").where(F.col("head").rlike(r"fn\s+drop\b"))
    kinds = F.array(F.when(F.col("own").rlike(r"panic!\s*\("), "panic"), F.when(F.col("own").rlike(r"\.(?:unwrap|expect)\s*\("), "unwrap"))
    return rows.select("path", "name", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"))


def open_types(blocks: DataFrame, fields: int = 2, variants: int = 5) -> DataFrame:
    """path, name, kind, n: public structs with public fields and enums with variants, as many, that are not marked open."""
    rows = blocks.where(~F.col("head").contains("non_exhaustive")).select("path", "own", _named(r"pub\s+(struct|enum)\s+\w+[^{}]*\{$").alias("kind"), _named(r"pub\s+(?:struct|enum)\s+(\w+)[^{}]*\{$").alias("name")).where("name <> ''")
    n = F.when(F.col("kind") == "struct", F.regexp_count("own", F.lit(r"(?m)^\s*pub\s+\w+\s*:"))).otherwise(F.regexp_count("own", F.lit(r"(?m)^\s*[A-Z]\w*")))
    return rows.select("path", "name", "kind", n.alias("n")).where(F.col("n") >= F.when(F.col("kind") == "struct", fields).otherwise(variants))


#: What a line does to a guard, as the next state for each of none, held and violated.
KEEP, ACQUIRE, RELEASE, AWAIT = [1, 2, 3], [2, 2, 3], [1, 1, 3], [1, 3, 3]


def _crossed(lines: Column, acquire: str) -> Column:
    """Is a guard that a line acquires held where a later line awaits? Lines are maps of states, and maps of parts of a
    function compose to that of the whole in any grouping."""
    as_map = lambda v: F.array(*map(F.lit, v))

    def line_map(x: Column) -> Column:
        return F.when(x.rlike(acquire), as_map(ACQUIRE)).when(x.rlike(r"\bdrop\("), as_map(RELEASE)).when(x.contains(".await"), as_map(AWAIT)).otherwise(as_map(KEEP))

    whole = F.aggregate(F.transform(lines, line_map), as_map(KEEP), lambda f, g: F.transform(f, lambda state: F.element_at(g, state)))
    return F.element_at(whole, F.lit(1)) == 3


def async_locks(blocks: DataFrame) -> DataFrame:
    """path, name, kind of async functions: a std guard held across an await, else an async one, else a blocking lock."""
    lines = F.split("own", "\n")
    std, waiting = r"let\s+(?:mut\s+)?\w+\s*=.*\.(?:lock|read|write)\(\)\.(?:unwrap|expect)\(", r"let\s+(?:mut\s+)?\w+\s*=.*\.(?:lock|read|write)\(\)\.await"
    kind = F.when(_crossed(lines, std), "std_guard").when(_crossed(lines, waiting), "async_guard").when(F.col("own").rlike(r"\.(?:lock|read|write)\(\)\.(?:unwrap|expect)\("), "blocking_lock")
    rows = blocks.withColumn("name", _named(r"async\s+fn\s+(\w+)")).where("name <> ''")
    return rows.select("path", "name", kind.alias("kind")).where("kind IS NOT NULL")
