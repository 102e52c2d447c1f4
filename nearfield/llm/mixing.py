"""Mixing sources to target weights, by min-cost flow over membership patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.llm.proportions import uniform
from nearfield.llm.tokens import token_counts
from nearfield.sources.tables import materialise, table

#: Different sets of listed sources that documents belong to, and listed sources; as many rows reach the driver.
MAX_PATTERNS = 200_000
BANDS = 1024


def min_cost_flow(supply: list[float], members: list[list[int]], quota: list[float], repeats: list[int]) -> list[dict[int, float]]:
    """Tokens each pattern gives each source: as much of the quotas as can be met, at least repetition.

    Pattern ``p`` offers ``supply[p]`` tokens at each repetition; the r-th costs r a
    token, which is convex, so all are used once before any is used twice. To source
    ``s`` it gives at most ``repeats[s]`` times its tokens. Moving tokens between
    sources costs nothing, so a path costs what its pattern's repetition does: successive
    cheapest paths are one maximal flow after another, each with one repetition more.
    Paths of a flow are taken along shortest layers, all of a layering at once, and a
    pattern serves its smaller quotas first.
    """
    eps = 1e-9 * max(1.0, sum(quota))
    flow: list[dict[int, float]] = [{s: 0.0 for s in sorted(m, key=lambda s: (quota[s], s)) if repeats[s] > 0} for m in members]
    most = [max((repeats[s] for s in f), default=0) for f in flow]
    owners: list[list[int]] = [[] for _ in quota]
    for p, to in enumerate(flow):
        for s in to:
            owners[s].append(p)
    used, need = [0.0] * len(supply), list(map(float, quota))

    def layered(left: list[float]) -> tuple[dict[int, int], dict[int, int]] | None:
        """Layers of patterns and sources that can be reached, up to the first with a source in need."""
        at_p = {p: 0 for p, x in enumerate(left) if x > eps}
        at_s: dict[int, int] = {}
        front, depth = list(at_p), 0
        while front:
            sources = []
            for p in front:
                for s, x in flow[p].items():
                    if s not in at_s and repeats[s] * supply[p] - x > eps:
                        at_s[s] = depth
                        sources.append(s)
            if any(need[s] > eps for s in sources):
                return at_p, at_s
            depth, front = depth + 1, []
            for s in sources:
                for p in owners[s]:
                    if p not in at_p and flow[p][s] > eps:
                        at_p[p] = depth
                        front.append(p)
        return None

    def push(start: int, left: list[float], at_p: dict[int, int], at_s: dict[int, int], todo: dict) -> bool:
        """One path from pattern ``start`` along the layers; what leads nowhere is not tried again."""
        path: list[tuple[int, int]] = []
        p = start
        while True:
            edges = todo.setdefault(p, list(flow[p])[::-1])
            while edges and not (at_s.get(edges[-1]) == at_p[p] and repeats[edges[-1]] * supply[p] - flow[p][edges[-1]] > eps):
                edges.pop()
            if not edges:
                if not path:
                    return False
                p, s = path.pop()
                todo["s", s].pop()
                continue
            s = edges[-1]
            path.append((p, s))
            if need[s] > eps:
                break
            back = todo.setdefault(("s", s), list(owners[s]))
            while back and not (at_p.get(back[-1]) == at_s[s] + 1 and flow[back[-1]][s] > eps):
                back.pop()
            if back:
                p = back[-1]
            else:
                path.pop()
                edges.pop()
        amount = min(left[start], need[path[-1][1]])
        for k, (p, s) in enumerate(path):
            amount = min(amount, repeats[s] * supply[p] - flow[p][s])
            if k + 1 < len(path):
                amount = min(amount, flow[path[k + 1][0]][s])
        for k, (p, s) in enumerate(path):
            flow[p][s] += amount
            if k + 1 < len(path):
                flow[path[k + 1][0]][s] -= amount
        left[start] -= amount
        used[start] += amount
        need[path[-1][1]] -= amount
        return True

    for repetition in range(1, max(most, default=0) + 1):
        left = [min(repetition, m) * x - u for m, x, u in zip(most, supply, used)]
        while any(x > eps for x in need) and (layers := layered(left)):
            todo: dict = {}
            for p in [p for p, depth in layers[0].items() if depth == 0]:
                while left[p] > eps and push(p, left, *layers, todo):
                    pass
    return flow


def mixture(spark: SparkSession, docs: DataFrame, key: str, sources: str, size: str, targets: DataFrame, seed: int = 29) -> tuple[DataFrame, DataFrame]:
    """``(uses, report)``: ``key, source, uses, size`` and, per target source, what was reached.

    ``sources`` is an array column: all sources a document belongs to. Documents are
    added up by their set of those that are listed, flow decides what each set gives each source, and
    documents are taken in a seeded order along a tape of their sizes, repeated as often
    as needed; a source takes one stretch of its sets' tapes, so a document serves it at
    most ``max_repeats`` times and the amount is met within one document a set. Places
    on the tape come from sums over ``BANDS`` bands a set and within a band, so a source
    with any share of the rows is never summed in one task.

    ``target`` is the share times the size of all documents, each once, those of null or
    unlisted sources too. A null share is 0, a null ``max_repeats`` 1; documents of null
    or negative size count 0 and are not used; null keys are not used; a repeated
    source in ``targets`` takes its largest figures. ``reached_share`` is of the target
    total, ``mixture_share`` of what was drawn.
    """
    wish = targets.where("source IS NOT NULL").groupBy("source").agg(F.coalesce(F.max("target_share"), F.lit(0.0)).alias("share"), F.coalesce(F.max("max_repeats"), F.lit(1)).alias("repeats"))
    goals = wish.orderBy("source").limit(MAX_PATTERNS + 1).collect()
    if len(goals) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} sources")
    listed = F.array(*(F.lit(g["source"]) for g in goals)).cast("array<string>")
    own = F.array_sort(F.array_intersect(F.coalesce(F.col(sources), F.array().cast("array<string>")), listed))
    rows = docs.select(F.col(key).alias("key"), own.alias("set"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("size"))
    rows = materialise(spark, rows, "sizes")
    sums = rows.groupBy("set").agg(F.sum("size").alias("n"), F.sum(F.when(F.col("key").isNotNull(), F.col("size")).otherwise(0)).alias("usable")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} sets of sources")
    total = sum(r["n"] for r in sums)
    index = {g["source"]: k for k, g in enumerate(goals)}
    quota = [g["share"] * total for g in goals]
    members = [[index[s] for s in r["set"] if s in index] for r in sums]
    flow = min_cost_flow([float(r["usable"]) for r in sums], members, quota, [int(g["repeats"]) for g in goals])
    met = [sum(f.get(k, 0.0) for f in flow) for k in range(len(goals))]
    stretches = []
    for r, given in zip(sums, flow):
        start = 0.0
        for k, amount in given.items():
            if amount > 0:
                stretches.append((r["set"], goals[k]["source"], float(r["usable"]), start, start + amount))
                start += amount
    tape = F.broadcast(spark.createDataFrame(stretches, "set array<string>, source string, round double, low double, high double"))  # within MAX_PATTERNS x sources
    drawn = rows.where("size > 0 AND key IS NOT NULL").withColumn("u", uniform(F.col("key"), seed=seed)).withColumn("band", F.floor(F.col("u") * BANDS))
    bands = drawn.groupBy("set", "band").agg(F.sum("size").alias("n")).withColumn("below", F.sum("n").over(Window.partitionBy("set").orderBy("band")) - F.col("n")).select("set", "band", "below")
    inner = F.sum("size").over(Window.partitionBy("set", "band").orderBy("u", "key").rowsBetween(Window.unboundedPreceding, -1))
    placed = drawn.withColumn("inner", F.coalesce(inner, F.lit(0))).join(bands, ["set", "band"]).withColumn("at", F.col("below") + F.col("inner"))

    def rounds(bound: str):
        return F.greatest(F.ceil((F.col(bound) - F.col("at")) / F.col("round")), F.lit(0))

    uses = placed.join(tape, "set").withColumn("uses", (rounds("high") - rounds("low")).cast("int")).where("uses > 0").select(F.col("key").alias(key), "source", "uses", F.col("size").alias(size))
    lines = [(g["source"], float(g["share"]), int(g["repeats"]), float(quota[k]), float(met[k]), bool(met[k] < quota[k] - 1e-9 * max(1.0, total))) for k, g in enumerate(goals)]
    plan = spark.createDataFrame(lines, "source string, target_share double, max_repeats int, target double, planned double, short boolean")
    got = uses.groupBy("source").agg(F.sum(F.col("uses") * F.col(size)).alias("reached"), F.sum("uses").alias("uses"), F.max("uses").alias("most_uses"))
    share = F.coalesce(F.col("reached"), F.lit(0)) / F.lit(float(max(total, 1)))
    whole = F.sum(F.coalesce("reached", F.lit(0))).over(Window.partitionBy(F.lit(0)))  # a row a source
    mixed = F.coalesce(F.coalesce("reached", F.lit(0)) / F.when(whole > 0, whole), F.lit(0.0))
    report = plan.join(got, "source", "left").select("source", "target_share", "max_repeats", F.round("target", 3).alias("target"), F.coalesce("reached", F.lit(0)).alias("reached"), F.round(share, 6).alias("reached_share"), F.round(mixed, 6).alias("mixture_share"), F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), "short")
    return uses, report


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sizes = token_counts(table(spark, sf_dir, "documents"), "text", ["doc_id", "source"]).withColumn("sources", F.array("source"))
    return mixture(spark, sizes, "doc_id", "sources", "n_tokens", table(spark, sf_dir, "source_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that stay short of their target, by the flow and by the documents drawn.

    A source takes one stretch of each set's tape, so what is drawn is within one document
    a set of what the flow planned; a source drawn beyond its target is not short.
    """
    report = _mixed(spark, sf_dir)[1]
    return report.where(F.col("short") & (F.col("reached") <= F.col("target"))).select("source")


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


def p9_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a mixture in which a document counts for its source and for its collection.

    Sources have half of their target shares; the other half goes to all collections in
    equal parts, each document used at most three times.
    """
    docs = table(spark, sf_dir, "documents")
    sizes = token_counts(docs, "text", ["doc_id", "source", "repo"])
    sizes = sizes.withColumn("sources", F.array(F.concat(F.lit("source "), "source"), F.concat(F.lit("repo "), "repo")))
    named = table(spark, sf_dir, "source_targets").select(F.concat(F.lit("source "), "source").alias("source"), (F.col("target_share") / 2).alias("target_share"), "max_repeats")
    repos = docs.where("repo IS NOT NULL").select("repo").distinct()
    each = F.lit(0.5) / F.count("*").over(Window.partitionBy(F.lit(0)))  # a row a collection
    return mixture(spark, sizes, "doc_id", "sources", "n_tokens", named.unionByName(repos.select(F.concat(F.lit("repo "), "repo").alias("source"), each.alias("target_share"), F.lit(3).alias("max_repeats"))))[1]


QUERIES = {"p9_found": p9_found, "p9_mixture": p9_mixture, "p9_report": p9_report, "p9_overlap": p9_overlap}
# Characters stand for tokens: which sources are short is the same by both.
SQL = {
    "p9_found": """
WITH own AS (SELECT source, sum(length(text)) AS n FROM documents GROUP BY source)
SELECT t.source FROM source_targets t LEFT JOIN own o ON o.source = t.source
WHERE coalesce(o.n, 0) * t.max_repeats < t.target_share * (SELECT sum(length(text)) FROM documents)""",
}
