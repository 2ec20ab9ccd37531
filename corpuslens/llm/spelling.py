"""Spelling variant grouping: words that differ by one code point, found by Aho-Corasick automata over word halves.

A word of m code points is cut into two segments. One edit leaves one of them whole, so a near word has the first
segment at its start or the second one at its end, and its length differs by at most one. The segments of all words
are dealt to automaton shards by their hash, and each word is sent to the shards of those of its beginnings and ends
that can be a segment. A shard scans its words with its automaton, takes the places that fit (offset 0 or the end,
compatible lengths) and verifies that the distance is exactly one.

A segment that very many words share would make all pairs of them in one shard. Such segments are refined: the other
half of the words is cut again, so that a word is filed under two longer known parts around a smaller window, again
until few words share a part or the window is one code point (where at most an alphabet of words differ). Every near
pair stays in one of the windows, so nothing is lost and no group grows with the data.

Words are counted in Spark expressions with a partial sum before the shuffle, so a very frequent word is one row a
task. Null and empty texts have no words; equal rows count each; doc_id is part of the typo rule (null: the empty
text). Words of any length are handled. An empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import drop_held, small_batches, stored

LETTERS = "[A-Za-zÀ-ÿ]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TYPO = 31
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: Words filed under one part above which it is refined, and words sent to it above which it is, in multiples.
MOST_HOLDERS, MOST_SCANS = 64, 16
#: Rows of a shard; their number follows from the number of rows.
SHARD_ROWS = 200_000
PAIRS = "word string, near string, near_n long"


def corpus_words(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """word of each run of letters in docs(doc_id, text) with the planted slips, of at least so many code points."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.split("text", f"[^{LETTERS[1:-2]}]+")).alias("run"))
    low = runs.where(F.length("run") >= least_length).select("id", F.translate("run", CAPITALS, SMALL).alias("run"))
    hashed = low.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % TYPO == 0, slipped).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= least_length)


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n of the words of docs with at least so many occurrences."""
    return corpus_words(docs, least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _filed(words: DataFrame) -> DataFrame:
    """Rows of both kinds for the two halves: a word under its own windows (hold) and under those of words that are one
    code point shorter or longer. Words of equal length meet at their own windows.

    m: length of the word that holds the window, a and t: code points known before and after the window.
    """
    size = F.length("word")
    each = words.select("word", "n", F.explode(F.array(size - 1, size, size + 1)).alias("m")).withColumn("hold", F.col("m") == size)
    half = F.floor(F.col("m") / 2).cast("int")
    sides = F.array(
        F.struct(half.alias("a"), F.lit(0).alias("t")),
        F.struct(F.lit(0).alias("a"), (F.col("m") - half).cast("int").alias("t")),
    )
    return each.withColumn("side", F.explode(sides)).select("word", "n", "hold", "m", "side.a", "side.t")


def _keyed(filed: DataFrame) -> DataFrame:
    """filed with a hash of the window and of the known parts, the word's first and last code points.

    Words meet by the hash; whether the parts are equal is what the automaton says.
    """
    head, tail = F.substring("word", F.lit(1), F.col("a")), F.substring("word", F.length("word") - F.col("t") + 1, F.col("t"))
    return filed.withColumn("part", F.xxhash64("m", "a", "t", head, tail))


def _refined(filed: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The rows that stay as they are, and those of parts that too many words have, with half the window each.

    Parts that no word holds, or that one word has alone, cannot match; the rows under them go.
    """
    counts = filed.groupBy("part").agg(
        F.count_if("hold").alias("holders"), F.count(F.lit(1)).alias("filed"), F.min("word").alias("low"), F.max("word").alias("high")
    )
    placed = filed.join(counts.where("holders > 0 AND low < high").drop("low", "high"), "part")
    window = F.col("m") - F.col("a") - F.col("t")
    again = ((F.col("holders") > most) | (F.col("filed") > most * MOST_SCANS)) & (window > 1)
    settled = placed.where(~again).drop("holders", "filed")
    half = F.floor(window / 2).cast("int")
    windows = F.array(
        F.struct((F.col("a") + half).alias("a"), F.col("t").alias("t")),
        F.struct(F.col("a").alias("a"), (F.col("t") + window - half).cast("int").alias("t")),
    )
    split = placed.where(again).select("word", "n", "hold", "m", F.explode(windows).alias("w")).select("word", "n", "hold", "m", "w.a", "w.t")
    return settled, split


def one_apart(a: str, b: str) -> bool:
    """Do the words differ by exactly one inserted, deleted or replaced code point?"""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = 0
    while at < len(a) and a[at] == b[at]:
        at += 1
    return a[at:] == b[at + 1 :] if len(a) < len(b) else a[at + 1 :] == b[at + 1 :]


def _scan_shards(batches):
    """Near pairs of one shard: its automaton holds the known parts of its holders; its scan words run through it."""
    import ahocorasick

    drop_held()
    automaton, holders, scans = ahocorasick.Automaton(), {}, {}
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("word", "n", "hold", "m", "a", "t")]
        for word, n, hold, m, a, t in zip(*columns):
            if hold:
                holders.setdefault((m, a, t, word[:a], word[len(word) - t :]), []).append((word, n))
            scans.setdefault(word, set()).add((m, a, t))
    at_start, at_end = {}, {}  # lengths of the windows' parts by segment
    for m, a, t, head, tail in holders:
        for segment, place in ((head, at_start), (tail, at_end)):
            if segment:
                place.setdefault(segment, set()).add((m, a, t))
                automaton.add_word(segment, segment)
    automaton.make_automaton()
    out = []
    for word, windows in scans.items():
        fits: dict[tuple, int] = {}
        for end, segment in automaton.iter(word):
            if end + 1 == len(segment):
                for w in windows & at_start.get(segment, set()):
                    fits[w] = fits.get(w, 0) | 1
            if end + 1 == len(word):
                for w in windows & at_end.get(segment, set()):
                    fits[w] = fits.get(w, 0) | 2
        found = set()
        for (m, a, t), sides in fits.items():
            if sides != (1 if a else 0) | (2 if t else 0) or a + t > len(word):
                continue
            for other, n in holders.get((m, a, t, word[:a], word[len(word) - t :]), ()):
                if other not in found and one_apart(word, other):
                    found.add(other)
                    out.append((word, other, n))
        if len(out) > 20_000:
            yield _pairs(out)
            out = []
    yield _pairs(out)


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64()]
    columns = list(zip(*rows)) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["word", "near", "near_n"])


def near_words(words: DataFrame, most_holders: int = MOST_HOLDERS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """word, near, near_n: each word of words(word, n) with every word one code point away; words are distinct."""
    rest, settled = stored(_keyed(_filed(words)), "filed"), []
    while True:
        done, split = _refined(rest, most_holders)
        settled.append(stored(done, "settled"))
        rest = stored(_keyed(split), "filed")
        if rest.isEmpty():
            break
    rows = settled[0]
    for more in settled[1:]:
        rows = rows.unionByName(more)
    shards = max(1, -(-rows.count() // shard_rows))
    spread = max(shards, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(spread, "part").select("word", "n", "hold", "m", "a", "t")
    # a pair can meet in two windows (a letter beside its like may stand for either place)
    return dealt.mapInArrow(_scan_shards, PAIRS).distinct()


def forms(words: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form and form_n: the near word of largest n (smallest of equals) if it has ratio times n."""
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct(-F.col("near_n"), "near")).alias("b"))
    largest, near = -F.col("b").getField("col1"), F.col("b").getField("near")
    joined = words.join(best, "word", "left").withColumn("ok", largest >= F.col("n") * ratio)
    return joined.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("ok"), near).alias("form"),
        F.when(F.col("ok"), largest).cast("long").alias("form_n"),
    )


def roots(table: DataFrame) -> DataFrame:
    """table(word, form, ...) with root: forms followed to the last one, by pointers that double their reach a round.

    The count of a form is larger than that of its word, so there is no cycle; the rounds are the logarithm of the chain.
    """
    links = stored(table.where("form is not null").select("word", F.col("form").alias("to")), "forms")
    while True:
        ahead = links.select(F.col("word").alias("to"), F.col("to").alias("next"))
        now = stored(links.join(ahead, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "forms")
        links = now.select("word", "to")
        if now.where("moved").isEmpty():
            break
    return table.join(links.withColumnRenamed("to", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of all words of docs(doc_id, text)."""
    words = stored(vocabulary(docs), "vocabulary")
    made = stored(forms(words, near_words(words)), "variants")
    return roots(made).select("word", "form", "root", "n", "n_near", "form_n")
