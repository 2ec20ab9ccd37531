"""Reports of external tools as tables of (file, line, message). Input: one column ``raw`` with the output.

JSON is read with declared schemas; what does not parse gives no rows. Rows without file, message or line
number are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _kept(rows: DataFrame, file: Column, line: Column, message: Column) -> DataFrame:
    out = rows.select(file.alias("file"), F.coalesce(line.try_cast("int"), F.lit(None).cast("int")).alias("line"), message.alias("message"))
    return out.where("file <> '' AND message <> '' AND line IS NOT NULL")


def _lines(raw: DataFrame) -> DataFrame:
    return raw.select(F.explode(F.split("raw", "\n")).alias("l"))


def gnu(raw: DataFrame) -> DataFrame:
    """file:line: message, a column number allowed."""
    p = r"^(.+?):([0-9]+)(:[0-9]+)?:\s*(.+)$"
    part = lambda i: F.trim(F.regexp_extract("l", p, i))
    return _kept(_lines(raw).where(F.col("l").rlike(p)), part(1), part(2), part(4))


def flat_json(raw: DataFrame) -> DataFrame:
    """An array of objects; file, line and message go by several names."""
    item = "array<struct<file:string,filename:string,path:string,line:string,line_no:string,row:string,message:string,text:string,reason:string>>"
    rows = raw.select(F.explode(F.from_json("raw", item)).alias("x"))
    first = lambda *names: F.coalesce(*[F.when(F.col(f"x.{n}") != "", F.col(f"x.{n}")) for n in names])
    return _kept(rows, first("file", "filename", "path"), F.coalesce(first("line", "line_no", "row"), F.lit("0")), first("message", "text", "reason"))


def eslint(raw: DataFrame) -> DataFrame:
    files = raw.select(F.explode(F.from_json("raw", "array<struct<filePath:string,messages:array<struct<line:string,message:string>>>>")).alias("f"))
    rows = files.select(F.col("f.filePath").alias("path"), F.explode("f.messages").alias("m"))
    return _kept(rows, F.col("path"), F.coalesce("m.line", F.lit("0")), F.col("m.message"))


def golangci(raw: DataFrame) -> DataFrame:
    rows = raw.select(F.explode(F.from_json("raw", "struct<Issues:array<struct<Text:string,Pos:struct<Filename:string,Line:string>>>>")["Issues"]).alias("i"))
    return _kept(rows, F.col("i.Pos.Filename"), F.coalesce("i.Pos.Line", F.lit("0")), F.col("i.Text"))


def rubocop(raw: DataFrame) -> DataFrame:
    files = raw.select(F.explode(F.from_json("raw", "struct<files:array<struct<path:string,offenses:array<struct<message:string,location:struct<line:string>>>>>>")["files"]).alias("f"))
    rows = files.select(F.col("f.path").alias("path"), F.explode("f.offenses").alias("o"))
    return _kept(rows, F.col("path"), F.coalesce("o.location.line", F.lit("0")), F.col("o.message"))


def cargo(raw: DataFrame) -> DataFrame:
    """JSON lines of compiler messages: the first span and the first line of the rendering."""
    kind = "struct<reason:string,message:struct<rendered:string,message:string,spans:array<struct<file_name:string,line_start:string>>>>"
    rows = _lines(raw).select(F.from_json("l", kind).alias("x")).where("x.reason = 'compiler-message' AND size(x.message.spans) > 0")
    span = F.col("x.message.spans")[0]
    text = F.coalesce(F.when(F.col("x.message.rendered") != "", F.col("x.message.rendered")), "x.message.message")
    return _kept(rows, span["file_name"], F.coalesce(span["line_start"], F.lit("0")), F.trim(F.split(text, "\n")[0]))


def credo(raw: DataFrame) -> DataFrame:
    """Issues with category before and check after the message."""
    rows = raw.select(F.explode(F.from_json("raw", "struct<issues:array<struct<filename:string,line_no:string,message:string,category:string,check:string>>>")["issues"]).alias("i"))
    message = F.when((F.coalesce("i.category", F.lit("")) != "") & (F.col("i.message") != ""), F.concat(F.lit("["), "i.category", F.lit("] "), "i.message")).otherwise(F.col("i.message"))
    message = F.when(F.coalesce("i.check", F.lit("")) != "", F.concat(message, F.lit(" ("), "i.check", F.lit(")"))).otherwise(message)
    return _kept(rows, F.col("i.filename"), F.coalesce("i.line_no", F.lit("0")), message)


def phpstan(raw: DataFrame) -> DataFrame:
    """A map from paths to messages."""
    files = raw.select(F.explode(F.from_json("raw", "struct<files:map<string,struct<messages:array<struct<line:string,message:string>>>>>")["files"]).alias("path", "f"))
    rows = files.select("path", F.explode("f.messages").alias("m"))
    return _kept(rows, F.col("path"), F.coalesce("m.line", F.lit("0")), F.col("m.message"))


def next_lint(raw: DataFrame) -> DataFrame:
    """One row a file: its first message and how many there are; text around the JSON array is dropped."""
    array = F.regexp_extract("raw", r"(?s)(\[.*\])", 1)
    files = raw.select(F.explode(F.from_json(array, "array<struct<filePath:string,messages:array<struct<line:string,message:string>>>>")).alias("f")).where("size(f.messages) > 0")
    first = F.col("f.messages")[0]
    line = F.greatest(F.coalesce(first["line"].try_cast("int"), F.lit(1)), F.lit(1))
    message = F.concat(F.lit("next lint: "), F.coalesce(first["message"], F.lit("Lint issue")), F.lit(" ("), F.size("f.messages").cast("string"), F.lit(" issue(s) in file)"))
    return _kept(files, F.col("f.filePath"), line, message)


PARSERS = {"gnu": gnu, "json": flat_json, "eslint": eslint, "golangci": golangci, "rubocop": rubocop, "cargo": cargo, "credo": credo, "phpstan": phpstan, "next_lint": next_lint}
