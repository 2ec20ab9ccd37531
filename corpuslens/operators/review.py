"""Reviews: merging batch scores, identities and groups of issues, coverage, priorities, schema drift."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.operators import overlap
from corpuslens.operators.graph import checkpointed, connected_components, freed
from corpuslens.operators.overlap import Share
from corpuslens.sources.tables import unsized


def weighted_floor(scores: DataFrame, percent: int = 10) -> DataFrame:
    """dimension and floor: weighted mean of the lowest scores that hold the percentage of all weight.

    scores has dimension, score and an integer weight. Rows are added up by score first, so a window sees one
    row a distinct score, not one a review.
    """
    by_score = scores.groupBy("dimension", "score").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("dimension")
    upto = F.sum("w").over(by.orderBy("score").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    run = by_score.withColumns({"before": upto - F.col("w"), "total": F.sum("w").over(by)})
    low = run.where(F.col("before") * 100 < F.col("total") * percent)
    return low.groupBy("dimension").agg((F.sum(F.col("score") * F.col("w")) / F.sum("w")).alias("floor"))


def batch_scores(scores: DataFrame) -> DataFrame:
    """dimension, mean, floor and merged (0.7 mean + 0.3 floor, within 0..100)."""
    mean = scores.groupBy("dimension").agg((F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("mean"))
    both = mean.join(weighted_floor(scores), "dimension")
    return both.withColumn("merged", F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("mean") * 0.7 + F.col("floor") * 0.3)))


def identity(issues: DataFrame) -> DataFrame:
    """issues with key: dimension::identifier, else the dimension and its summary's first eight sorted words."""
    words = F.array_join(F.slice(T.word_set(F.col("summary")), 1, 8), ",")
    return issues.withColumn("key", F.when(F.coalesce("identifier", F.lit("")) != "", F.concat_ws("::", "dimension", "identifier")).otherwise(F.concat_ws("::", "dimension", words)))


def linked_sets(texts: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of texts (distinct words with a blank between) that join what all pairs of a Jaccard of ``least`` or
    more would: each text that is reached is held against those that are not yet, by the texts of its words."""
    lists = pc.split_pattern(pa.array(texts, pa.string()), " ")
    offsets, code = lists.offsets.to_numpy(), lists.values.dictionary_encode().indices.to_numpy()
    n = np.diff(offsets)
    holders = np.repeat(np.arange(len(n)), n)[np.argsort(code, kind="stable")]
    begin = np.append(0, np.cumsum(np.bincount(code)))
    left, out = np.ones(len(n), bool), []
    for start in range(len(n)):
        if not left[start]:
            continue
        left[start], reached = False, [start]
        while reached and left.any():
            at = reached.pop()
            common = np.bincount(np.concatenate([holders[begin[c] : begin[c + 1]] for c in code[offsets[at] : offsets[at + 1]]]), minlength=len(n))
            found = np.flatnonzero(left & (common / (n[at] + n - common) >= least))
            left[found] = False
            out.append(np.stack([np.full(len(found), start), found]))
            reached += found.tolist()
    return tuple(np.concatenate(out, axis=1)) if out else (np.zeros(0, np.int64),) * 2


def _block_links(sets: DataFrame, made: DataFrame, share: Share, least: float) -> DataFrame:
    """a, b: links that join all similar sets(key, dimension, words) of each block of a word."""
    first = F.col("n") - share.least_column(F.col("n")) + 1
    each = F.explode(F.arrays_zip(F.slice("tokens", F.lit(1), first).alias("t"), F.slice("blocks", F.lit(1), first).alias("b")))
    filed = made.select("key", each.alias("e")).select("key", F.col("e.t").alias("token"), F.col("e.b").alias("b"))
    block = F.when(F.col("b") > 1, F.pmod(F.xxhash64("token", "key"), "b")).otherwise(0).cast("int")
    dealt = filed.select("key", "token", block.alias("block")).join(unsized(sets), "key")

    def run(batches):
        for token, block, dimension, key, words in overlap.groups(batches, ["token", "block", "dimension"], ["key", "words"]):
            starts, sizes = overlap.cuts(token, block, dimension)
            some = [(at, *linked_sets(words[at : at + size], least)) for at, size in zip(starts.tolist(), sizes.tolist()) if size > 1]
            a, b = (np.concatenate([key[:0], *[key[x[0] + x[k]] for x in some]]) for k in (1, 2))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    ordered = dealt.repartition("token", "block", "dimension").sortWithinPartitions("token", "block", "dimension")
    return ordered.select("token", "block", "dimension", "key", "words").mapInArrow(run, "a long, b long")


def similar_links(issues: DataFrame, least: float = 0.45, block: int = overlap.BLOCK) -> DataFrame:
    """a, b: links that join the issues(issue_id, dimension, summary) of a dimension whose word sets are at least so similar,
    as all such pairs would; far fewer than these in large groups.

    At a Jaccard of ``least`` two sets of n and m words share one of the rarest n - ceil(least * n) + 1 words of each (prefix
    filter). The sets of a word are joined in blocks of bounded size, within a task and without a row a pair. Where a
    word has several blocks, pairs that all these links leave in different groups are looked for and verified.
    """
    sets = issues.select(F.col("issue_id").alias("key"), "dimension", F.array_join(T.word_set(F.col("summary")), " ").alias("words")).where("words <> ''")
    part = Fraction(str(least))
    share, paths = Share(part.numerator, part.numerator + part.denominator), []
    tokens = sets.select("key", F.explode(F.split("words", " ")).alias("word"), "dimension").select("key", F.xxhash64("dimension", "word").alias("token"))
    made = checkpointed(overlap.sets_of(overlap.rarest_first(tokens, block), share), paths)
    links = checkpointed(_block_links(sets, made, share, least).distinct())
    each = F.posexplode(F.arrays_zip("tokens", "blocks"))
    places = made.select("key", "n", each.alias("place", "e")).where(F.col("place") <= F.col("n") - share.least_column(F.col("n")))
    many = places.where("e.blocks > 1").select(F.col("e.tokens").alias("token"), "key", "n", "place")
    for nearest_only in (True, False):
        if many.isEmpty():
            break
        roots = checkpointed(connected_components(links), paths)
        pairs = checkpointed(overlap.remaining(many, made, share, roots, block, nearest_only=nearest_only), paths)
        u, v = (sets.select(F.col("key").alias(k), F.col("dimension").alias(f"d{k}"), F.split("words", " ").alias(f"w{k}")) for k in "uv")
        alike = pairs.join(unsized(u), "u").join(unsized(v), "v").where((F.col("du") == F.col("dv")) & (T.jaccard(F.col("wu"), F.col("wv")) >= least))
        links = links.union(checkpointed(alike.select(F.col("u").alias("a"), F.col("v").alias("b"))))
    freed(issues.sparkSession, paths)
    return links


def merged_groups(issues: DataFrame, least: float = 0.45) -> DataFrame:
    """issue_id and root of transitive groups of similar issues.

    Issues of a dimension with the same words are one class, whose smallest issue stands for it: only these meet, and
    the others have their class's root. Issues without words are groups of their own.
    """
    words = F.array_join(T.word_set(F.col("summary")), " ")
    keyed = issues.select("issue_id", "dimension", words.alias("words"))
    first = checkpointed(keyed.where("words <> ''").groupBy("dimension", "words").agg(F.min("issue_id").alias("first")))
    found = connected_components(similar_links(first.select(F.col("first").alias("issue_id"), "dimension", F.col("words").alias("summary")), least))
    roots = first.join(unsized(found), F.col("first") == F.col("node"), "left").select("dimension", "words", F.coalesce("root", "first").alias("root"))
    return keyed.join(unsized(roots), ["dimension", "words"], "left").select("issue_id", F.coalesce("root", "issue_id").alias("root"))


def staleness(files: DataFrame, cache: DataFrame, now: str, most_days: int) -> DataFrame:
    """path and state of each file against the review cache: unreviewed, changed, stale or fresh."""
    j = files.join(cache, "path", "left")
    days = T.elapsed_days(F.col("reviewed_at"), F.lit(now).cast("timestamp"))
    state = F.when(F.col("reviewed_at").isNull(), "unreviewed").when(F.col("digest") != F.col("seen_digest"), "changed").when(days > most_days, "stale").otherwise("fresh")
    return j.select("path", state.alias("state"))


def priority(files: DataFrame) -> DataFrame:
    """files(loc, importers, n_open, n_set_aside, low_value, complexity) with a review priority; small files get -1."""
    score = F.col("importers") * F.when(F.col("low_value"), 2).otherwise(10) + F.col("n_open") * 5 + F.col("n_set_aside") * 15 + F.when(F.col("complexity") > 100, 20).otherwise(0) + F.floor(F.col("loc") / 50)
    return files.withColumn("priority", F.when(F.col("loc") < 20, F.lit(-1).cast("long")).when(F.col("low_value"), F.floor(score / 3)).otherwise(score))


def coverage_class(files: DataFrame, direct: DataFrame, reached: DataFrame) -> DataFrame:
    """path, loc and kind: direct, transitive or untested, for files(path, loc)."""
    j = files.join(direct.select("path", F.lit(True).alias("d")).distinct(), "path", "left").join(reached.select("path", F.lit(True).alias("r")).distinct(), "path", "left")
    return j.select("path", "loc", F.when(F.col("d"), "direct").when(F.col("r"), "transitive").otherwise("untested").alias("kind"))


def coverage_potential(files: DataFrame) -> DataFrame:
    """potential: sum over files of at least ten lines of the root of their lines, at most 50 each, to the nearest."""
    return files.where("loc >= 10").agg(F.round(F.sum(F.least(F.sqrt("loc"), F.lit(50.0)))).cast("long").alias("potential"))


def worst_quality(tests: DataFrame) -> DataFrame:
    """path, test, quality: the worst test of each path (ties by name), unless some test of it is adequate."""
    rank = F.when(F.col("quality") == "assertion_free", 3).when(F.col("quality") == "placeholder", 2).when(F.col("quality") == "smoke", 1).otherwise(0)
    by = Window.partitionBy("path")
    pick = tests.withColumns({"rank": rank, "adequate": F.max((F.col("quality") == "adequate").cast("int")).over(by), "place": F.row_number().over(by.orderBy(F.desc(rank), "test"))})
    return pick.where("place = 1 AND adequate = 0 AND rank > 0").select("path", "test", "quality")


def outlier_keys(rows: DataFrame, percent: int = 30, least: int = 3) -> DataFrame:
    """cluster, key, n, size, nearest: keys in under so much of a cluster of at least three, with the closest common key."""
    size = rows.groupBy("cluster").agg(F.count_distinct("row").alias("size")).where(F.col("size") >= least)
    used = rows.groupBy("cluster", "key").agg(F.count_distinct("row").alias("n")).join(size, "cluster")
    odd = used.where(F.col("n") * 100 < F.col("size") * percent)
    common = used.where(F.col("n") * 100 >= F.col("size") * percent).select("cluster", F.col("key").alias("near"))
    both = odd.join(common, "cluster", "left").withColumn("d", F.levenshtein("key", "near"))
    best = F.min(F.struct("d", "near"))
    return both.groupBy("cluster", "key", "n", "size").agg(best.alias("b")).select("cluster", "key", "n", "size", F.when(F.col("b.d") <= 2, F.col("b.near")).alias("nearest"))


def auto_resolved(findings: DataFrame, imported: DataFrame, holistic: list[str], dimensions: list[str], full_sweep: bool, now: str | None = None) -> DataFrame:
    """findings that an import resolves: open ones of the holistic detectors whose id it does not hold, with their new
    status (and time). Without a full sweep only those of the dimensions that the import covers are resolved."""
    covered = holistic if full_sweep else [d for d in holistic if d in dimensions]
    rows = findings.where((F.col("status") == "open") & F.col("detector").isin(covered)).join(imported.select("finding_id"), "finding_id", "left_anti")
    return rows.withColumns({"status": F.lit("auto_resolved"), "resolved_at": F.lit(now).cast("timestamp")})
