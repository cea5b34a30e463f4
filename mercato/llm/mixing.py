"""Mixing overlapping sources to target weights (operator 7).

1. Targets: sources in code point order weigh 1, 2, 3, 1, ...; they share all
   words by weight, capped at ``max_repeats`` times a source's own words, and
   what is over is shared again (``targets``).
2. Documents are aggregated by membership pattern, the set of sources that
   claim them.
3. Min-cost flow: a pattern offers its words once for free and again at rising
   (convex) cost; its words flow to the quotas of its sources.  Sources that
   share no pattern are independent, so each connected group of sources is
   one small flow problem, solved in a task of its own (``route``).
4. A pattern that is to give r words more than whole passes over its documents
   takes them in seeded order up to r words.  Running sums come from sums over
   narrow ranges of the order; only the one range that is cut is sorted.

Defined cases: null text has size 0; a null source is one source that comes
last; a document of no source is never taken; null ids and repeated rows are
rows like others, ordered by their text's hash; if all sizes are 0 so are all
targets; only the id, text and source columns are read.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.llm.common import stored
from mercato.llm.linededup import text_hash
from mercato.llm.simhash import components

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of the seeded order that are summed together, on average.
RANGE_ROWS = 1_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3),
            max_repeats: int = 3) -> DataFrame:
    """(source, number, source_size, target) from (source, source_size).

    The cap binds where ``level * weight`` exceeds it; the level rises until
    the words left over by capped sources are all shared."""
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row for each source
    cycle = F.array(*(F.lit(w) for w in weights))
    rows = stored(sources.withColumn("number", F.row_number().over(order) - 1)
                  .withColumn("weight", F.get(cycle, F.pmod(F.col("number"), F.lit(len(weights))))),
                  "sources")
    cap = F.col("source_size") * max_repeats
    level, total = 0.0, rows.agg(F.sum("source_size")).first()[0] or 0
    while True:
        full = cap < F.col("weight") * F.lit(level)
        held, weight = rows.agg(F.sum(F.when(full, cap).otherwise(0)),
                                F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        new = (total - held) / weight if weight else level
        if new <= level:
            break
        level = new
    return rows.select("source", "number", "source_size", F.least(
        F.col("weight") * F.lit(level), cap.cast("double")).alias("target"))


def min_cost_flow(patterns: list[tuple[list[int], int]], quotas: dict[int, int],
                  max_repeats: int) -> dict[tuple[int, int], int]:
    """Words pattern i gives to source s: as much as quotas allow, at the least
    total cost, where the k-th pass over a pattern costs k - 1 a word.

    Successive shortest paths: sources with room left pull words over the
    residual graph; a path may take words back from another source."""
    tokens = [t for _, t in patterns]
    given: dict[tuple[int, int], int] = {}
    used = [0] * len(patterns)
    members: dict[int, list[int]] = {}
    for i, (own, _) in enumerate(patterns):
        for s in own:
            members.setdefault(s, []).append(i)
    left = {s: q for s, q in quotas.items() if q > 0}
    while left:
        # Dijkstra from the sources with room, over patterns, to the cheapest spare pass
        best: dict[tuple[str, int], int] = {}
        came: dict[tuple[str, int], tuple[str, int] | None] = {}
        heap = [(0, ("s", s), None) for s in sorted(left)]
        goal = None
        while heap:
            cost, node, prev = heapq.heappop(heap)
            if node in best:
                continue
            best[node], came[node] = cost, prev
            kind, k = node
            if kind == "end":
                goal = node
                break
            if kind == "s":
                for i in members.get(k, []):
                    heapq.heappush(heap, (cost, ("p", i), node))
            else:
                if tokens[k] and used[k] < max_repeats * tokens[k]:
                    heapq.heappush(heap, (cost + used[k] // tokens[k], ("end", k), node))
                for s in patterns[k][0]:
                    if given.get((k, s), 0) > 0:
                        heapq.heappush(heap, (cost, ("s", s), node))
        if goal is None:
            return given
        path = [goal]
        while came[path[-1]] is not None:
            path.append(came[path[-1]])
        last = goal[1]
        first = path[-1][1]
        amount = min(left[first], tokens[last] * (used[last] // tokens[last] + 1) - used[last])
        hops = path[1:]  # pattern, source, pattern, ..., source
        for j in range(1, len(hops) - 1, 2):  # source that gives up words of the pattern after it
            amount = min(amount, given[(hops[j + 1][1], hops[j][1])])
        for j in range(0, len(hops), 2):
            pattern, source = hops[j][1], hops[j + 1][1]
            given[(pattern, source)] = given.get((pattern, source), 0) + amount
            if j:
                given[(pattern, hops[j - 1][1])] -= amount
        used[last] += amount
        left[first] -= amount
        if not left[first]:
            del left[first]
    return given


def route(patterns: DataFrame, sources: DataFrame, max_repeats: int = 3) -> DataFrame:
    """(pattern, words) for patterns (pattern array<int>, tokens) and sources
    (number, target): the words taken of each pattern."""
    several = stored(patterns.where(F.size("pattern") > 1)
                     .select(F.explode("pattern").alias("a"), F.array_min("pattern").alias("b"))
                     .where("a != b").select(F.col("a").cast("long"), F.col("b").cast("long"))
                     .distinct(), "overlaps")
    named = sources.withColumn("group", F.col("number").cast("long"))
    if several.limit(1).count():
        stars = components(several, "source-groups")
        named = (sources.join(stars, sources.number == stars.a, "left")
                 .withColumn("group", F.coalesce("b", F.col("number").cast("long"))).drop("a", "b"))
    groups = named.select("number", "group")
    own = stored(patterns.withColumn("number", F.array_min("pattern")).join(groups, "number")
                 .select("group", "pattern", "tokens"), "flow-input")

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = sorted((sorted(int(x) for x in p), int(t))
                      for p, t in zip(left["pattern"], left["tokens"]))
        quotas = {int(n): int(round(t)) for n, t in zip(right["number"], right["target"])}
        given = min_cost_flow(rows, quotas, max_repeats)
        words = [0] * len(rows)
        for (i, _), n in given.items():
            words[i] += n
        return pd.DataFrame({"pattern": [p for p, _ in rows], "words": words})

    return (own.groupBy("group").cogroup(named.select("group", "number", "target").groupBy("group"))
            .applyInPandas(solve, "pattern array<int>, words long"))


def select_documents(docs: DataFrame, words: DataFrame, seed: int = 7) -> DataFrame:
    """``docs`` (with pattern, id, th, size) and the words taken of each:
    whole passes, then documents in seeded order until the words are met."""
    rows = docs.withColumn("h", F.xxhash64(F.lit(seed), "id", "th"))
    n = max(1, math.ceil(docs.count() / RANGE_ROWS))
    place = (F.shiftrightunsigned("h", 11).cast("double") / F.lit(float(1 << 53)) * n).cast("long")
    rows = rows.withColumn("range", place)
    upto = Window.partitionBy("pattern").orderBy("range")
    sums = (rows.groupBy("pattern", "range").agg(F.sum("size").alias("words"))
            .withColumn("end", F.sum("words").over(upto)))
    tokens = rows.groupBy("pattern").agg(F.sum("size").alias("tokens"))
    plan = (tokens.join(words.select("pattern", F.col("words").alias("want")), "pattern")
            .select("pattern", F.when(F.col("tokens") > 0, F.floor(F.col("want") / F.col("tokens")))
                    .otherwise(0).alias("passes"),
                    F.when(F.col("tokens") > 0, F.col("want") % F.col("tokens")).otherwise(0)
                    .alias("rest")))
    cut = (sums.join(plan, "pattern").where("end >= rest AND rest > 0").groupBy("pattern")
           .agg(F.min(F.struct("end", "range", "words")).alias("x"))
           .select("pattern", F.col("x.range").alias("cut"),
                   (F.col("x.end") - F.col("x.words")).alias("before")))
    plan = stored(plan.join(cut, "pattern", "left"), "mix-plan")
    marked = stored(rows.join(plan, "pattern", "left"), "mix-marked")
    within = (Window.partitionBy("pattern").orderBy("h", "id", "th", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    passes = F.coalesce(F.col("passes"), F.lit(0)) * F.col("size")
    whole = marked.where("cut IS NULL OR range != cut").withColumn(
        "taken", passes + F.when(F.col("range") < F.col("cut"), F.col("size")).otherwise(0))
    at_cut = (marked.where("range = cut")
              .withColumn("sofar", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
              .withColumn("taken", passes + F.greatest(F.lit(0), F.least(
                  F.col("size"), F.col("rest") - F.col("sofar"))))
              .drop("sofar"))
    return whole.unionByName(at_cut)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        sources: Column | str = "source", weights: tuple[int, ...] = (1, 2, 3),
        max_repeats: int = 3, seed: int = 7) -> DataFrame:
    """(doc_id, th, size, sources, taken, and for documents of one source:
    source, source_size, target) for each row.  ``sources`` is a column with
    one source, or an array of the sources that claim the document.  ``taken``
    counts repeats; of each pattern one document at most is taken in part."""
    column = F.col(sources) if isinstance(sources, str) else sources
    rows = docs.select(F.col(id_col).cast("long").alias("id"),
                       F.col(text_col).cast("string").alias("text"), column.alias("claimed"))
    claimed = F.col("claimed") if rows.schema["claimed"].dataType.typeName() == "array" \
        else F.array("claimed")
    sized = stored(rows.select("id", text_hash(F.col("text")).alias("th"),
                               word_count(F.col("text")).alias("size"),
                               F.array_distinct(claimed).alias("sources")), "mix-sizes")
    by_set = stored(sized.groupBy("sources").agg(F.sum("size").alias("tokens")), "mix-patterns")
    member = by_set.select("tokens", F.explode("sources").alias("source"))
    goal = stored(targets(member.groupBy("source").agg(F.sum("tokens").alias("source_size")),
                          weights, max_repeats), "mix-targets")
    flat = by_set.select("sources", "tokens", F.explode("sources").alias("source"))
    numbered = (flat.join(goal.select("source", "number"), flat.source.eqNullSafe(goal.source))
                .groupBy("sources", "tokens")
                .agg(F.array_sort(F.collect_list("number")).alias("pattern")))
    patterns = stored(numbered, "mix-numbered")
    words = stored(route(patterns.select("pattern", "tokens"), goal, max_repeats), "mix-words")
    # a null inside an array does not join: compare the sets as text
    key = lambda c: F.to_json(F.struct(F.col(c).alias("s")), {"ignoreNullFields": "false"})
    with_pattern = (sized.withColumn("k", key("sources"))
                    .join(patterns.select(key("sources").alias("k"), "pattern"), "k", "left")
                    .drop("k"))
    chosen = select_documents(with_pattern, words, seed)
    one = F.when(F.size("pattern") == 1, F.get("pattern", F.lit(0)))
    return (chosen.withColumn("number", one)
            .join(goal.withColumnRenamed("source", "name"), "number", "left")
            .select(F.col("id").alias("doc_id"), "th", "size", "sources", "source_size", "target",
                    "taken"))


def copies(mixed: DataFrame) -> DataFrame:
    """(doc_id, th, copies): how often a document stands in the mix; the one
    taken in part counts if at least half of it is taken."""
    n = F.floor(F.col("taken") / F.col("size") + 0.5)
    return (mixed.withColumn("copies", F.when(F.col("size") > 0, n).otherwise(1))
            .groupBy("doc_id", "th").agg(F.sum("copies").cast("int").alias("copies")))
