"""Mixing overlapping sources to target weights by min-cost flow.

Documents are first aggregated by membership pattern, the set of sources that hold them. A small
network then routes each pattern's words to its sources' quotas: a first pass over a pattern is
free, each repetition costs more than the one before, so the cheapest flow repeats as little as the
quotas allow. Up to MOST_PATTERNS patterns go through the network, a row each on the driver. Beyond
that only patterns of several sources do, and the sources in them: a source that overlaps no other
needs none, as its flow is its quota, the same that the network finds. Quotas are found in Spark,
whatever the number of sources.

Within a pattern, documents stand in a line by a seeded hash, each as long as its words, and the
flow takes a stretch of the line, once around or more. A document's place in the line is its
bucket's offset plus its place in the bucket: the hash's first 16 bits make the buckets, whose
offsets are summed in two levels of 8 bits, so no task sees more than 1/65536 of a pattern's
documents or 256 of its sums.

A null or empty text has size 0 and takes part without weight. Null is a source of its own. A
document without sources is never taken. Equal rows stand next to each other. Runs agree, since
nothing but rows and the seed decides.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkreef.llm.common import boxed, checkpointed, text_hash

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_REPEATS = 2
SEED = 17
#: With more patterns of several sources the mix is refused: their network would outgrow the driver.
MOST_PATTERNS = 5_000

#: A pattern's documents are lined up in 2 ** BUCKET_BITS buckets, these in 2 ** HALL_BITS halls.
BUCKET_BITS = 16
HALL_BITS = 8


def word_count(text_col: str = "text"):
    """The number of words, runs of anything but ASCII blanks; null has none."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_weights(sources: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """``sources`` (source, ...) with weight: they go round in code point order, null last.

    Sources are sorted by ranges, and each range's first place is what the ranges before it hold, so
    no task sees them all; the driver gets a count for each range.
    """
    ranged = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id())
    ranged = checkpointed(ranged)
    place, starts = 0, []
    for r in sorted(ranged.groupBy("range").count().collect()):
        starts += [F.lit(r["range"]), F.lit(place)]
        place += r["count"]
    if not starts:
        return sources.withColumn("weight", F.lit(0.0))
    own = F.row_number().over(W.partitionBy("range").orderBy(F.col("source").asc_nulls_last())) - 1
    at = own + F.create_map(*starts)[F.col("range")]
    return ranged.withColumn("weight", F.array(*map(F.lit, map(float, weights)))[(at % len(weights)).cast("int")]).drop("range")


def source_targets(
    sources: DataFrame, total: int | None = None, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS
) -> DataFrame:
    """``sources`` (source, size) with target: ``share`` of ``total`` together, by weight, none above
    ``most`` times its source.

    ``total`` is what all documents hold, by default all sizes together; it is less than these where
    sources overlap. What a source can't take is reshared by weight among the others: each round
    finds the words a unit of weight gets with the sources full so far, until no more are full.
    """
    weighed = checkpointed(source_weights(sources.select("source", "size"), weights).withColumn("full", F.col("size") * float(most)))
    level, full = 0.0, -1
    while True:
        above = F.col("full") < F.col("weight") * level
        r = weighed.agg(
            F.sum("size").alias("size"),
            F.sum(F.when(above, F.col("full")).otherwise(0.0)).alias("taken"),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("weight"),
            F.sum(above.cast("long")).alias("n"),
        ).first()
        if not r["weight"] or r["n"] == full:
            break
        full, level = r["n"], (share * (r["size"] if total is None else total) - r["taken"]) / r["weight"]
    return weighed.withColumn("target", F.least("full", F.col("weight") * level)).drop("full", "weight")


class Network:
    """A directed network with capacities and costs; cheapest paths first until none is left."""

    def __init__(self):
        self.out: list[list[int]] = []
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def node(self) -> int:
        self.out.append([])
        return len(self.out) - 1

    def edge(self, a: int, b: int, room: int, cost: int = 0) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def flow(self, edge: int) -> int:
        return self.room[edge ^ 1]

    def _distances(self, start: int, worth: list[int]) -> list[int | None]:
        """How far each node is, by costs that ``worth`` has made no less than zero."""
        far: list[int | None] = [None] * len(self.out)
        heap, far[start] = [(0, start)], 0
        while heap:
            at, a = heapq.heappop(heap)
            if at > far[a]:
                continue
            for e in self.out[a]:
                b = self.to[e]
                if self.room[e]:
                    new = at + self.cost[e] + worth[a] - worth[b]
                    if far[b] is None or new < far[b]:
                        far[b] = new
                        heapq.heappush(heap, (new, b))
        return far

    def _levels(self, start: int, worth: list[int]) -> list[int]:
        level = [-1] * len(self.out)
        level[start], front = 0, [start]
        for a in front:
            for e in self.out[a]:
                b = self.to[e]
                if self.room[e] and level[b] < 0 and self.cost[e] + worth[a] == worth[b]:
                    level[b] = level[a] + 1
                    front.append(b)
        return level

    def _fill(self, start: int, end: int, worth: list[int]) -> bool:
        """Flow along all cheapest paths with as few edges as any, until one of each is full; False if there is none."""
        level = self._levels(start, worth)
        if level[end] < 0:
            return False
        left = [iter(edges) for edges in self.out]
        path: list[int] = []
        at = start
        while True:
            if at == end:
                amount = min(self.room[e] for e in path)
                for e in path:
                    self.room[e] -= amount
                    self.room[e ^ 1] += amount
                full = next(i for i, e in enumerate(path) if not self.room[e])
                at = self.to[path[full] ^ 1]
                del path[full:]
                continue
            for e in left[at]:
                b = self.to[e]
                if self.room[e] and level[b] == level[at] + 1 and self.cost[e] + worth[at] == worth[b]:
                    path.append(e)
                    at = b
                    break
            else:
                level[at] = -1
                if not path:
                    return True
                at = self.to[path.pop() ^ 1]

    def run(self, start: int, end: int) -> None:
        """Distances by cost, then as much flow as all paths of the least cost take together, and again.

        A round raises the least cost, which is a small whole number, so rounds are few.
        """
        worth = [0] * len(self.out)
        while (far := self._distances(start, worth))[end] is not None:
            most = max(x for x in far if x is not None)
            worth = [w + (most if x is None else x) for w, x in zip(worth, far, strict=True)]
            while self._fill(start, end, worth):
                pass


def route(
    patterns: dict[tuple[str | None, ...], int], targets: dict[str | None, float], most: int = MOST_REPEATS
) -> dict[tuple[str | None, ...], dict[str | None, int]]:
    """Words that each pattern gives to each of its sources.

    Patterns that share no source, even over others, have networks of their own.
    """
    group: dict[str | None, set] = {}
    for pattern in patterns:
        joined = {pattern}.union(*(group.get(s, ()) for s in pattern))
        for s in {s for p in joined for s in p}:
            group[s] = joined
    routed = {p: {} for p in patterns}
    for members in {id(g): g for g in group.values()}.values():
        net = Network()
        start, end = net.node(), net.node()
        order = sorted(members, key=lambda p: [(s is None, s or "") for s in p])
        quota = {}
        for s in sorted({s for p in order for s in p}, key=lambda s: (s is None, s or "")):
            quota[s] = net.node()
            net.edge(quota[s], end, round(targets[s]))
        edges = {}
        for p in order:
            node = net.node()
            for repeat in range(most):
                net.edge(start, node, patterns[p], repeat)
            for s in p:
                edges[p, s] = net.edge(node, quota[s], most * patterns[p])
        net.run(start, end)
        for (p, s), e in edges.items():
            routed[p][s] = net.flow(e)
    return routed


def flows(totals: DataFrame, weights: Sequence[float], share: float, most: int, most_patterns: int) -> DataFrame:
    """(pattern, pattern_size, flow, parts, quotas) for each of ``totals`` (pattern, sources, size):
    the words to take in all and for each source, and the sources' sizes and targets."""
    spark = totals.sparkSession
    held = totals.where(F.size("sources") > 0)
    by_source = held.select(F.explode("sources").alias("source"), "size").groupBy("source").agg(F.sum("size").alias("size"))
    total = held.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    targets = source_targets(by_source, total, weights, share, most)
    targets = checkpointed(targets.withColumn("pattern", F.to_json(F.array("source").alias("sources"))))
    quota = F.struct("source", F.col("source_size").alias("size"), "target")
    flow = F.least(F.bround("target").cast("long"), F.col("size") * most)
    singles = totals.join(targets.withColumnRenamed("size", "source_size"), "pattern").select(
        "pattern", "source", "source_size", "target", F.col("size").alias("pattern_size"), flow.alias("flow"),
        F.array(F.struct("source", flow.alias("words"))).alias("parts"), F.array(quota).alias("quotas"),
    )
    names = ["pattern", "pattern_size", "flow", "parts", "quotas"]
    shape = (
        "pattern string, pattern_size long, flow long, parts array<struct<source:string,words:long>>,"
        "quotas array<struct<source:string,size:long,target:double>>"
    )
    nothing = totals.where(F.size("sources") == 0).select(
        "pattern", F.col("size").alias("pattern_size"), F.lit(0).cast("long").alias("flow"),
        F.array().cast("array<struct<source:string,words:long>>").alias("parts"),
        F.array().cast("array<struct<source:string,size:long,target:double>>").alias("quotas"),
    )
    several = held.limit(most_patterns + 1).collect()
    if len(several) > most_patterns:  # sources that overlap no other stay in Spark
        several = held.where(F.size("sources") > 1).limit(most_patterns + 1).collect()
    if not several:
        return singles.select(*names).union(nothing)
    if len(several) > most_patterns:
        raise ValueError(f"over {most_patterns} patterns of several sources: the network would outgrow the driver")
    # The sources in them, each with the pattern of its own documents if it has any.
    involved = spark.createDataFrame([(s,) for s in {s for r in several for s in r["sources"]}], "source string")
    involved = involved.select(F.to_json(F.array("source").alias("sources")).alias("pattern"))
    quotas = {r["source"]: (r["size"], r["target"]) for r in targets.join(involved, "pattern", "left_semi").collect()}
    alone = singles.join(involved, "pattern", "left_semi").select("pattern", "source", "pattern_size").collect()
    patterns = {tuple(r["sources"]): (r["pattern"], r["size"]) for r in several}
    patterns |= {(r["source"],): (r["pattern"], r["pattern_size"]) for r in alone}
    routed = route({p: n for p, (_, n) in patterns.items()}, {s: t for s, (_, t) in quotas.items()}, most)
    plan = []
    for p, (name, size) in patterns.items():
        parts = list(routed[p].items())
        plan.append((name, size, sum(n for _, n in parts), parts, [(s, *quotas[s]) for s in p]))
    return singles.join(involved, "pattern", "left_anti").select(*names).union(nothing).union(spark.createDataFrame(plan, shape))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    sources_col: str = "sources",
    text_col: str = "text",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST_REPEATS,
    seed: int = SEED,
    most_patterns: int = MOST_PATTERNS,
) -> DataFrame:
    """(id, rid, sources, size, quotas, taken, repeats, routes) for each row of ``docs``.

    ``sources_col`` is an array of the sources that hold a document; rid is its text's hash;
    ``quotas`` are its sources with their sizes and targets; ``routes`` names, for each time the document is taken, the source it is taken for.
    """
    sized = docs.select(
        F.col(id_col).alias("id"),
        text_hash(text_col).alias("rid"),
        F.sort_array(F.array_distinct(F.coalesce(sources_col, F.array().cast("array<string>")))).alias("sources"),
        word_count(text_col).alias("size"),
    )
    line = F.xxhash64(F.lit(seed), "id", "rid")
    sized = checkpointed(
        sized.withColumn("pattern", F.to_json("sources"))
        .withColumn("line", line)
        .withColumn("bucket", F.shiftrightunsigned("line", 64 - BUCKET_BITS))
    )
    totals = checkpointed(sized.groupBy("pattern").agg(F.first("sources").alias("sources"), F.sum("size").alias("size")))
    planned = flows(totals, weights, share, most, most_patterns)

    hall = F.shiftright("bucket", BUCKET_BITS - HALL_BITS)
    buckets = sized.groupBy("pattern", "bucket").agg(F.sum("size").alias("held")).withColumn("hall", hall)
    before_hall = F.sum("held").over(W.partitionBy("pattern").orderBy("hall").rowsBetween(W.unboundedPreceding, -1))
    halls = buckets.groupBy("pattern", "hall").agg(F.sum("held").alias("held")).select("pattern", "hall", before_hall.alias("begin"))
    in_hall = F.sum("held").over(W.partitionBy("pattern", "hall").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    offset = F.coalesce("begin", F.lit(0)) + F.coalesce("inside", F.lit(0))
    offsets = buckets.select("pattern", "hall", "bucket", in_hall.alias("inside")).join(halls, ["pattern", "hall"])
    # Plans join buckets, not documents, so that a hot pattern's rows never meet in one task.
    offsets = offsets.select("pattern", "bucket", offset.alias("offset")).join(planned, "pattern")
    in_bucket = W.partitionBy("pattern", "bucket").orderBy("line", "id", "rid", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = (
        sized.withColumn("before", F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
        .join(offsets, ["pattern", "bucket"])
        .withColumn("middle", F.col("offset") + F.col("before") + F.col("size") / 2)
    )
    # A document is taken on a round if its middle lies on the stretch that the flow takes.
    turns = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda turn: turn * F.col("pattern_size") + F.col("middle")),
        lambda at: (at < F.col("flow")) & (F.col("size") > 0),
    )
    ends = F.aggregate(
        "parts",
        F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<struct<source:string,end:double>>").alias("ends")),
        lambda a, p: F.struct(
            (a["end"] + p["words"]).alias("end"),
            F.concat(
                a["ends"], F.array(F.struct(p["source"].alias("source"), (a["end"] + p["words"]).cast("double").alias("end")))
            ).alias("ends"),
        ),
        lambda a: a["ends"],
    )
    return (
        placed.withColumn("turns", turns)
        .withColumn("ends", ends)
        .withColumn(
            "routes", F.transform("turns", lambda at: F.get(F.filter("ends", lambda e: at < e["end"]), F.lit(0))["source"])
        )
        .select(
            F.col("id").alias(id_col),
            "rid",
            "sources",
            "size",
            "quotas",
            (F.size("turns") * F.col("size")).alias("taken"),
            F.size("turns").alias("repeats"),
            "routes",
        )
    )


def mix_report(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST_REPEATS,
    seed: int = SEED,
) -> DataFrame:
    """(id, size, source_size, target, taken) where each document has one source."""
    single = docs.select(id_col, text_col, F.array(source_col).alias("sources"))
    mixed = mix_sources(single, id_col, "sources", text_col, weights, share, most, seed)
    quota = F.get("quotas", F.lit(0))
    return mixed.select(id_col, "size", quota["size"].alias("source_size"), quota["target"].alias("target"), "taken")


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST_REPEATS,
    seed: int = SEED,
) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its columns.

    Rows that share an id and a text are taken alike, as often as the luckiest of them.
    """
    single = docs.select(id_col, text_col, F.array(source_col).alias("sources"))
    taken = mix_sources(single, id_col, "sources", text_col, weights, share, most, seed)
    repeats = taken.groupBy(F.col(id_col).alias("doc"), "rid").agg(F.max("repeats").alias("n")).where("n > 0")
    own = boxed(docs, own_doc=F.col(id_col), own_rid=text_hash(text_col))
    rows = own.join(repeats, F.col("own_doc").eqNullSafe(F.col("doc")) & (F.col("own_rid") == F.col("rid")))
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")
