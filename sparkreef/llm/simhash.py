"""SimHash near-dedup with pivot distance tables.

A fingerprint's pivot table holds its Hamming distances to many reference fingerprints, kept per
block of bits: the distances over the blocks add up to those over the whole. Two fingerprints that
differ in ``radius`` bits at most agree in all blocks but ``radius``, and there their partial
distances to every pivot are equal, so each choice of blocks to agree in gives a key, the vector
of partial distances over them, that both share. Pairs under a key are discarded by the largest
difference of a coordinate of the full table (by the triangle inequality it can't exceed the
distance) and the survivors are verified bit by bit.

Equal fingerprints are one node. A key leaves ``radius`` blocks free, so its bucket has
2 ** (free bits) members at most whatever the corpus holds (65,536 for the defaults), and a bucket
gives links that span its groups, not its pairs. Nothing is capped.

A null or empty text has no shingles and the fingerprint zero, and is linked like any other. Null
ids pass through; as a component's id they count only where it has no other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkreef.llm.common import boxed, checkpointed, text_hash, whole_runs
from sparkreef.llm.components import components

SEED = 42
WORDS = 3
RADIUS = 2
#: Blocks that 64 bits are cut into for a radius of 2.
BLOCKS = 8
PIVOTS = 24

_LANES = np.uint64(0x0101010101010101)
#: Stands for a null id: it sorts last.
_LAST = (1 << 63) - 1


def shingles(text: str | None, words: int) -> list[bytes]:
    """Runs of so many words, lower-cased (A-Z) and joined by spaces; fewer words make one run."""
    found = (text or "").encode().lower().split()
    if not found:
        return []
    return [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    runs = shingles(text, words)
    return np.fromiter((digest(x, SEED) for x in runs), np.uint64, len(runs))


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes, as an unsigned number."""
    counts = np.zeros((8, 8), np.int64)  # bit of a byte, byte
    for at in range(0, len(hashes), 255):
        part = hashes[at : at + 255]
        for bit in range(8):
            lane_sums = ((part >> np.uint64(bit)) & _LANES).sum(dtype=np.uint64)
            counts[bit] += np.frombuffer(np.uint64(lane_sums).tobytes(), np.uint8)
    bits = (2 * counts > len(hashes)).T.reshape(64)  # least first
    return int(np.packbits(bits, bitorder="little").view("<u8")[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, fp) for each row: the fingerprint's 64 bits as a long."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [majority(shingle_hashes(text, words)) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(marks, np.uint64).view(np.int64))], ["id", "fp"]
            )

    id_type = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(mark, f"id {id_type}, fp long").withColumnRenamed("id", id_col)


def pivots(n: int) -> np.ndarray:
    """Reference fingerprints: hashes of 1, 2 and so on."""
    return np.array([xxhash.xxh64_intdigest(str(i), SEED) for i in range(1, n + 1)], np.uint64)


def block_masks(blocks: int) -> np.ndarray:
    """Runs of bits of nearly equal length that make up all 64."""
    cuts = np.linspace(0, 64, blocks + 1).astype(int)
    return np.array([(1 << int(b)) - (1 << int(a)) for a, b in zip(cuts, cuts[1:], strict=False)], np.uint64)


def pivot_table(fps: np.ndarray, refs: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """(fingerprint, block, pivot): distances over each block."""
    return np.bitwise_count((fps[:, None, None] ^ refs[None, None, :]) & masks[None, :, None]).astype(np.uint8)


def vector_hash(vectors: np.ndarray) -> np.ndarray:
    """One uint64 for each row of small numbers; equal rows have equal ones."""
    out = np.full(len(vectors), 0x9E3779B97F4A7C15, np.uint64)
    for column in vectors.T:
        out = (out ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out


def _keys(batches: Iterator[pa.RecordBatch], radius: int, blocks: int, n_pivots: int) -> Iterator[pa.RecordBatch]:
    refs, masks = pivots(n_pivots), block_masks(blocks)
    choices = list(combinations(range(blocks), blocks - radius))
    for batch in batches:
        fps = batch.column(0).to_numpy().view(np.uint64)
        table = pivot_table(fps, refs, masks)
        per_block = np.stack([vector_hash(table[:, b, :]) for b in range(blocks)], 1)
        for number, chosen in enumerate(choices):
            key = vector_hash(np.column_stack([per_block[:, list(chosen)], np.full(len(fps), number, np.uint64)]))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0)], ["key", "fp"])


class Forest:
    """Groups of the members of a batch, smallest member first."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            if len(a):
                np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
                while (self.root[self.root] != self.root).any():
                    self.root = self.root[self.root]


def bucket_links(keys: np.ndarray, fps: np.ndarray, refs: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the groups within each run of equal keys."""
    full = np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)
    groups = Forest(len(fps))
    left = np.flatnonzero(keys[1:] == keys[:-1])
    step = 1
    while len(left):
        right = left + step
        open_ = groups.root[left] != groups.root[right]
        a, b = left[open_], right[open_]
        near = np.abs(full[a] - full[b]).max(1, initial=0) <= radius
        a, b = a[near], b[near]
        close = np.bitwise_count(fps[a] ^ fps[b]) <= radius
        groups.join(a[close], b[close])
        step += 1
        left = left[left + step < len(keys)]
        left = left[keys[left + step] == keys[left]]
    linked = np.flatnonzero(groups.root != np.arange(len(fps)))
    return fps[groups.root[linked]], fps[linked]


def _links(batches: Iterator[pa.RecordBatch], radius: int, n_pivots: int) -> Iterator[pa.RecordBatch]:
    """Links within keys, of (key, fp) sorted by key. The last key of a batch waits for the next."""
    refs = pivots(n_pivots)
    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def found(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        twin = np.zeros(len(keys), bool)
        same = keys[1:] == keys[:-1]
        twin[1:] |= same
        twin[:-1] |= same
        a, b = bucket_links(keys[twin], fps[twin], refs, radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy()])
        fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
        if len(keys):
            whole = int(np.searchsorted(keys, keys[-1]))
            if whole:
                yield found(keys[:whole], fps[:whole])
                keys, fps = keys[whole:], fps[whole:]
    if len(keys):
        yield found(keys, fps)


def linked_fingerprints(
    fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, n_pivots: int = PIVOTS
) -> DataFrame:
    """(a, b): links that span the components of distinct fingerprints (column fp) at ``radius`` bits."""
    keyed = fps.mapInArrow(lambda batches: _keys(batches, radius, blocks, n_pivots), "key long, fp long")
    dealt = keyed.repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(lambda batches: _links(batches, radius, n_pivots), "a long, b long")


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    radius: int = RADIUS,
    blocks: int = BLOCKS,
    n_pivots: int = PIVOTS,
) -> DataFrame:
    """(id, fp, component_id) for each row; component_id is the smallest id that links reach."""
    marked = checkpointed(fingerprints(docs, id_col, text_col, words))
    distinct = checkpointed(marked.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = components(linked_fingerprints(distinct.select("fp"), radius, blocks, n_pivots))
    rooted = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(id_col, "fp", "component_id")


#: Near copies: runs of five words, this share of them in common.
COPY_WORDS = 5
SIMILARITY = 0.8
#: Shingles are counted by so many first bits of their hashes.
COUNT_BITS = 20
#: The counts travel in so many parts.
COUNT_PARTS = 64


def set_name(hashes: np.ndarray) -> int:
    """64 bits that stand for a set of hashes, in order."""
    return int.from_bytes(xxhash.xxh3_128_digest(hashes.tobytes())[:8], "little", signed=True)


def shingle_sets(docs: DataFrame, text_col: str, words: int) -> DataFrame:
    """(node, hashes): each shingle set by its name, the hashes in order, eight bytes each."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            nodes, sets = [], []
            for text in batch.column(0).to_pylist():
                hashes = np.unique(shingle_hashes(text, words))
                node = set_name(hashes)
                if node not in seen:
                    seen.add(node)
                    nodes.append(node)
                    sets.append(hashes.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "hashes"])

    return docs.select(text_col).mapInArrow(told, "node long, hashes binary").dropDuplicates(["node"])


def alike_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets (node, hashes) have at least this Jaccard similarity."""

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (one, two))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    told = pairs.join(sets.withColumnsRenamed({"node": "a", "hashes": "of_a"}), "a")
    told = told.join(sets.withColumnsRenamed({"node": "b", "hashes": "of_b"}), "b")
    return told.select("a", "b", "of_a", "of_b").mapInArrow(verified, "a long, b long")


def common_shingles(parts: DataFrame) -> np.ndarray:
    """How often hashes with each of the first COUNT_BITS bits occur, of (part, counts).

    The driver gets COUNT_PARTS rows, 8 MB in all, whatever the corpus holds.
    """

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(zlib.decompress(counts), np.uint32).astype(np.int64)
        packed = [zlib.compress(x.tobytes(), 1) for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(packed, pa.binary())], ["part", "counts"])

    told = parts.repartition("part").mapInArrow(added, "part int, counts binary").collect()
    table = np.zeros((COUNT_PARTS, (1 << COUNT_BITS) // COUNT_PARTS), np.int64)
    for r in told:
        table[r["part"]] = np.frombuffer(zlib.decompress(bytes(r["counts"])), np.int64)
    return table.reshape(-1)


def may_reach(size_a: np.ndarray, at_a: np.ndarray, size_b: np.ndarray, at_b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets whose first common element stands at these places may be ``similarity`` alike.

    Of elements that aren't the first common one the answer means nothing, but no pair rests on them.
    """
    small, large = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    most = np.minimum(size_a - at_a, size_b - at_b)
    return (small >= similarity * large - 1e-6) & (most >= similarity / (1 + similarity) * (size_a + size_b) - 1e-6)


def _pairs(one: np.ndarray, two: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.column_stack([np.minimum(one, two), np.maximum(one, two)]), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _met_first(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Of (token, at, size, node) in order, each node with its token's first one and the one before it."""
    for token, at, size, node in whole_runs(batches):
        fresh = np.concatenate([[True], token[1:] != token[:-1]])
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(token)), 0))
        rest = np.flatnonzero(~fresh)
        one, two = np.concatenate([first[rest], rest - 1]), np.concatenate([rest, rest])
        near = may_reach(size[one], at[one], size[two], at[two], similarity)
        yield _pairs(node[one[near]], node[two[near]])


def _met_all(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Of (token, at, size, node, root) sorted by token, all pairs of a token that no links connect yet."""
    for token, at, size, node, root in whole_runs(batches):
        left = np.flatnonzero(token[1:] == token[:-1])
        step, found, held = 1, [], 0
        while len(left):
            right = left + step
            near = root[left] != root[right]
            one, two = left[near], right[near]
            near = may_reach(size[one], at[one], size[two], at[two], similarity)
            found.append((node[one[near]], node[two[near]]))
            held += len(found[-1][0])
            if held > 200_000:
                yield _pairs(*(np.concatenate(x) for x in zip(*found, strict=True)))
                found, held = [], 0
            step += 1
            left = left[left + step < len(token)]
            left = left[token[left + step] == token[left]]
        if held:
            yield _pairs(*(np.concatenate(x) for x in zip(*found, strict=True)))


def fingerprint_pairs(marked: DataFrame) -> DataFrame:
    """(a, b): candidates by SimHash, of (node, fp): a fingerprint's sets with its least one, and the least ones
    of fingerprints that ``linked_fingerprints`` links by their pivot tables."""
    least = checkpointed(marked.groupBy("fp").agg(F.min("node").alias("least")))
    own = marked.join(least, "fp").select(F.col("least").alias("a"), F.col("node").alias("b"))
    ends = [least.select(F.col("fp").alias(end), F.col("least").alias(f"of_{end}")) for end in ("a", "b")]
    links = linked_fingerprints(least.select("fp")).join(ends[0], "a").join(ends[1], "b")
    pairs = own.union(links.select("of_a", "of_b")).where("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = COPY_WORDS,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """(id, rid, component_id) for each row: documents whose shingle sets are ``similarity`` alike.

    All null ids count as one, the largest long there is; texts tell rows under one id apart.

    A node is a distinct shingle set, named after its hash whatever ids hold it, and component_id
    is the least name of a component's nodes; it is no id.

    Sets whose SimHash fingerprints the pivot tables link are candidates first. Pairs that are alike may
    differ in more bits than such a search can take, so one by prefixes follows for the rest: with all
    sets in one order, rare shingles first, two sets that are alike have one in common among the
    first ``(1 - similarity)`` of each, so that no pair is missed. Hot shingles come last, so sets
    that share no more than a template seldom meet. Under a shingle, each set first meets the most
    typical one (that with the fewest rarer shingles) and the one before it; then all pairs that
    are not connected yet meet. Pairs are verified on their whole sets.
    """
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc"),
        text_hash(text_col).alias("rid"),
        F.col(text_col).alias("text"),
    )

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "rid", "node", "fp", "part", "counts"]
        total = None
        for batch in batches:
            runs = [shingle_hashes(text, words) for text in batch.column(2).to_pylist()]
            fps = pa.array(np.array([majority(x) for x in runs], np.uint64).view(np.int64))
            sets = [np.unique(x) for x in runs]
            n = len(sets)
            if n:
                firsts = (np.concatenate(sets) >> np.uint64(64 - COUNT_BITS)).astype(np.int64)
                total = np.bincount(firsts, minlength=1 << COUNT_BITS) + (0 if total is None else total)
            nodes = pa.array([set_name(x) for x in sets], pa.int64())
            none = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), nodes, fps, *none], names)
        if total is not None:
            packed = [zlib.compress(x.astype(np.uint32).tobytes(), 1) for x in total.reshape(COUNT_PARTS, -1)]
            none = [pa.nulls(COUNT_PARTS, pa.int64())] * 4
            parts = [pa.array(np.arange(COUNT_PARTS), pa.int32()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, *parts], names)

    told = checkpointed(rows.mapInArrow(mark, "doc long, rid long, node long, fp long, part int, counts binary"))
    marked = told.where("part is null").select("doc", "rid", "node")
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(told.where("part is not null").select("part", "counts")))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # equal sets of a task go out once
        for batch in batches:
            tokens, sizes, nodes = [], [], []
            for text in batch.column(0).to_pylist():
                hashes = np.unique(shingle_hashes(text, words))
                node = set_name(hashes)
                if node in seen or not len(hashes):
                    continue
                seen.add(node)
                order = np.lexsort([hashes, common.value[hashes >> np.uint64(64 - COUNT_BITS)]])
                tokens.append(hashes[order[: len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-6)) + 1]])
                sizes.append(len(hashes))
                nodes.append(node)
            held = [len(x) for x in tokens]
            columns = [
                np.concatenate([*tokens, np.zeros(0, np.uint64)]).view(np.int64),
                np.concatenate([*(np.arange(n, dtype=np.int32) for n in held), np.zeros(0, np.int32)]),
                np.repeat(np.array(sizes, np.int32), held),
                np.repeat(np.array(nodes, np.int64), held),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "at", "size", "node"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in whole_runs(batches):
            token, node = columns[0], columns[3]
            same = token[1:] == token[:-1]
            own = np.concatenate([[True], ~(same & (node[1:] == node[:-1]))])
            columns = [c[own] for c in columns]
            same = columns[0][1:] == columns[0][:-1]
            twin = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(columns[0]) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(c[twin]) for c in columns], ["token", "at", "size", "node"])

    shape = "token long, at int, size int, node long"
    dealt = docs.select(text_col).mapInArrow(prefixes, shape).repartition("token").sortWithinPartitions("token", "at", "node")
    met = checkpointed(dealt.mapInArrow(shared, shape))
    first = met.mapInArrow(lambda x: _met_first(x, similarity), "a long, b long")
    pairs = checkpointed(first.union(fingerprint_pairs(told.where("part is null").select("node", "fp"))).distinct())
    sets = shingle_sets(docs, text_col, words)

    def verified(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        return alike_pairs(pairs, checkpointed(sets.join(ends, "node")), similarity)

    links = checkpointed(verified(pairs))
    roots = components(links)
    rooted = met.join(roots, "node", "left").select("token", "at", "size", "node", F.coalesce("root", "node").alias("root"))
    split = rooted.groupBy("token").agg((F.min("root") < F.max("root")).alias("split")).where("split").select("token")
    rooted = rooted.join(split, "token").repartition("token").sortWithinPartitions("token")
    rest = rooted.mapInArrow(lambda x: _met_all(x, similarity), "a long, b long").distinct()
    rest = checkpointed(rest.join(pairs, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        links = links.union(verified(rest))
        roots = components(links)
    named = marked.join(roots, "node", "left")
    return named.select(F.col("doc").alias(id_col), "rid", F.coalesce("root", "node").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with its columns, one row of each group of near copies: that of the smallest id.

    Of rows that share even the id, the one with the smallest text hash stays, once.
    """
    groups = near_copies(docs, id_col, text_col, **options)
    stays = groups.groupBy("component_id").agg(F.min(F.struct(F.col(id_col).alias("doc"), "rid")).alias("stays")).select("stays.*")
    rows = groups.groupBy(F.col(id_col).alias("doc"), "rid").agg(F.count("*").alias("n"))
    stays = checkpointed(stays.join(rows, ["doc", "rid"]))
    own = boxed(docs, doc=F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)), rid=text_hash(text_col))
    kept = own.join(stays.where("n = 1"), ["doc", "rid"]).select("row.*")
    repeated = stays.where("n > 1")
    if repeated.isEmpty():
        return kept
    once = own.join(repeated, ["doc", "rid"]).dropDuplicates(["doc", "rid"]).select("row.*")
    return kept.union(once)
