"""Similarity join of documents by the Jaccard similarity of their word n-gram sets.

Signatures of `TREES` x `LEVELS` MinHash bytes form an LSH forest: in each tree a document is a
sorted key of LEVELS bytes, so documents with a common prefix are under one node of the trie. The
join starts at whole keys and shortens the matched prefix by whole bytes. At each depth every
document first joins a leader under a common trie node, which gathers large groups of near copies at
a cost in proportion to them; then the pairs still open (of different classes under one trie node)
are compared by their signatures, in blocks. What is found tells how many near pairs share only
shorter prefixes, and prefixes are shortened to the depth at which that reaches the target, where
it is measured again; where too few are found to measure it, to the depth at which the recall expected of
pairs at the threshold does. Inside
the classes of candidates all pairs are then verified on their whole n-gram sets, in blocks that
pass on sums and as few links as join a class, never pairs. The result is one row per document with
its class, the connected component of verified links, and its number of links.

Signatures rule a pair out if they fall `MARGIN` standard errors short of the threshold (2 in 10000
of pairs right at the threshold); the README has the recall measured against brute force.

Defined cases: null and blank texts have no n-grams and stay alone; a text of fewer than N words
is one n-gram; rows with equal sets are one node with copies, and each copy counts as a link; rows
are told apart by their sets only, so rows that repeat a doc_id or have none are documents of their
own; a class is named by its least doc_id (null if it has none), ties between rows of that id change
nothing; a similarity right at the threshold is a link; long texts count whole; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import collections

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.llm.common import Bloom, Words, buckets, mix, pieces, rolling, text_bytes, window_hashes
from lexmill.session import free, stash

N, THRESHOLD, RECALL = 5, 0.8, 0.999
TREES, LEVELS = 20, 8
BLOCK = 1024  # members of a group compared at once
GRAMS = 1 << 19  # n-grams of a block of a class
FEW = 1 << 18  # links that one task joins: 4 MiB, whatever the number of links
BAND = 0.05  # the recall measured is that of pairs at most this far above the threshold
PAIRS = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("equal", pa.int64()), ("pairs", pa.float64())])
MARGIN = 3.5  # standard errors a signature's estimate may fall short of the threshold

_RNG = np.random.default_rng(20240101)
XORS = _RNG.integers(0, 1 << 32, TREES * LEVELS, np.uint64).astype(np.uint32)
ODDS = _RNG.integers(0, 1 << 32, TREES * LEVELS, np.uint64).astype(np.uint32) | np.uint32(1)


def expected_recall(depth: int, similarity=THRESHOLD, trees: int = TREES):
    """Share of pairs of a similarity that have a common prefix of `depth` levels in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def shingles(column: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n-grams (with repeats) of each row's words, and bounds of rows."""
    words = Words(*text_bytes(column))
    starts, ends, bounds = rolling(words.firsts, n, short=True)
    return window_hashes(words.hashes(), starts, ends), bounds


def tree_keys(s: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Keys of each row in each tree, LEVELS bytes from the most significant one down; rows
    without n-grams have keys of zeros."""
    rows = np.flatnonzero(np.diff(bounds) > 0)
    out = np.zeros((len(bounds) - 1, TREES), np.uint64)
    if not len(rows):
        return out
    x, heads = (s >> np.uint64(32)).astype(np.uint32), bounds[:-1][rows]
    for tree in range(TREES):
        key = np.zeros(len(rows), np.uint64)
        for level in range(LEVELS):
            i = tree * LEVELS + level
            least = np.minimum.reduceat((x ^ XORS[i]) * ODDS[i], heads)
            key = (key << np.uint64(8)) | (mix(least.astype(np.uint64) + np.uint64(i << 32)) >> np.uint64(56))
        out[rows, tree] = key
    return out


def facts_of(s: np.ndarray) -> tuple[int, int, int]:
    """Size and 128 bits of a set of sorted distinct hashes: what sets are told apart by."""
    if not len(s):
        return 0, 0, 0
    return len(s), int(np.add.reduce(mix(s)).view(np.int64)), int(np.bitwise_xor.reduce(mix(s + np.uint64(0xA0761D6478BD642F))).view(np.int64))


def signatures(docs: DataFrame, n: int = N) -> DataFrame:
    """(id, p, q, size, a, b, keys) of docs(id, text, p, q): number of distinct n-grams, 128 bits of
    the set, and tree keys."""

    def run(batches):
        for batch in pieces(batches):
            s, bounds = shingles(batch.column(1), n)
            size, a, b = zip(*(facts_of(np.unique(s[lo:hi])) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)), strict=True)
            keys = tree_keys(s, bounds).view(np.int64)
            listed = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), TREES).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *(pa.array(x, pa.int64()) for x in (size, a, b)), listed], ["id", "p", "q", "size", "a", "b", "keys"])

    return docs.mapInArrow(run, "id long, p long, q long, size long, a long, b long, keys array<long>")


def sets_of(docs: DataFrame, nodes: DataFrame, n: int = N) -> DataFrame:
    """(id, grams binary): sorted distinct n-gram hashes of nodes(id, p, a, b, size), found in a row
    of docs(id, text, p, q) with that p. Only rows of such a p are cut into n-grams: a Bloom filter
    tells them while it isn't too full to tell (rows let through wrongly drop out of the join, which
    goes by the whole identity of the set), beyond that a semi-join by p."""
    rows = docs.select("text", "p")
    if nodes.count() > Bloom.BITS // 8:
        held, rows = None, rows.join(nodes.select("p").distinct(), "p", "left_semi").select("text", "p")
    else:
        held = docs.sparkSession.sparkContext.broadcast(Bloom.build(nodes, "p"))

    def run(batches):
        for batch in pieces(batches):
            if held is not None:
                batch = batch.filter(pa.array(Bloom.might_hold(held.value, batch.column(1).to_numpy())))
            if not batch.num_rows:
                continue
            s, bounds = shingles(batch.column(0), n)
            sets = [np.unique(s[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            size, a, b = zip(*map(facts_of, sets), strict=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (a, b, size)), pa.array([x.tobytes() for x in sets], pa.binary())], ["a", "b", "size", "grams"])

    found = rows.mapInArrow(run, "a long, b long, size long, grams binary").groupBy("a", "b", "size").agg(F.min("grams").alias("grams"))
    return found.join(nodes.select("id", "a", "b", "size"), ["a", "b", "size"]).select("id", "grams")


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of links (u, v), in order, and the least one that each is joined to."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, label = at[: len(u)], at[len(u) :], np.arange(len(ids))
    while len(apart := np.flatnonzero(label[a] != label[b])):
        x, y = label[a[apart]], label[b[apart]]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return ids, ids[label]


def components(links: DataFrame, most: int = 100, n: int | None = None) -> DataFrame:
    """(id, class) of the nodes of n stashed links(u, v), class being the least id of the component.
    Up to FEW links are joined by one task, without jobs of their own, as plans of rounds take far more of
    the driver's memory. Of more, large and small stars alternate until nothing changes (an error if that
    takes more than `most` rounds, far beyond the logarithm of any size); minima are combined before each
    shuffle, and edges of a hot node are joined to its minimum by a join that Spark may split."""
    if (links.count() if n is None else n) <= FEW:

        def run(batches):
            if held := list(batches):
                u, v = (np.concatenate([batch.column(k).to_numpy() for batch in held]) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in least_reached(u, v)], ["id", "class"])

        return links.select("u", "v").where("u <> v").coalesce(1).mapInArrow(run, "id long, class long")
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges, before = stash(edges, "edges"), None
    for _ in range(most):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = stash(small, "edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before or not now["n"]:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("class")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("class"))).distinct()


def merged(nodes: DataFrame, links: DataFrame, n: int | None = None) -> DataFrame:
    """nodes with the classes that n links(u, v) between classes join made one."""
    renamed = components(links, n=n).select(F.col("id").alias("class"), F.col("class").alias("to"))
    return nodes.join(renamed, "class", "left").select("id", "keys", F.coalesce("to", "class").alias("class"))


def least_equal(threshold: float) -> float:
    """The number of equal signature bytes below which a pair is ruled out."""
    width = TREES * LEVELS
    return width * threshold - MARGIN * (width * threshold * (1 - threshold)) ** 0.5


def measured(pairs: dict[int, float], at: int, threshold: float = THRESHOLD, recall: float = RECALL, depth: int | None = None) -> float:
    """Recall of matches down to `depth` (by default `at`), of the pairs hardest to find: those at most
    BAND above the threshold. `pairs` has the number found by equal signature bytes with prefixes of
    `at` bytes; as each is found with the probability expected_recall(), it stands for so many that
    share only shorter prefixes. Fewer pairs than 1 / (1 - recall) are no evidence: then recall is that
    expected of pairs at the threshold, as it is where that is more than what was measured."""
    depth, width = at if depth is None else depth, TREES * LEVELS
    band = [(n / expected_recall(at, equal / width), equal / width) for equal, n in pairs.items() if threshold <= equal / width <= threshold + BAND]
    found, least = sum(n for equal, n in pairs.items() if threshold <= equal / width <= threshold + BAND), expected_recall(depth, threshold)
    if found * (1 - recall) < 1:
        return least
    return max(least, sum(n * expected_recall(depth, similarity) for n, similarity in band) / sum(n for n, _ in band))


def _grouped(nodes: DataFrame, depth: int) -> DataFrame:
    """(g, id, class): a row per tree, g being the trie node of `depth` levels that the key is under."""
    prefix = F.shiftrightunsigned("key", 8 * (LEVELS - depth))
    return nodes.select("id", "class", F.posexplode("keys").alias("tree", "key")).select(F.xxhash64("tree", prefix).alias("g"), "id", "class")


def leaders(nodes: DataFrame, depth: int = LEVELS, threshold: float = THRESHOLD) -> DataFrame:
    """(u, v, equal, pairs): the classes of nodes and of the leader (least id under a trie node, of
    another class) that each meets in most trees, if their signatures don't rule the threshold out;
    how many signature bytes are equal, in one pair. One row a node at most, so that large groups of
    near copies become a class at a cost in proportion."""
    rows = _grouped(nodes, depth)
    groups = rows.groupBy("g").agg(F.min("id").alias("u"), F.min_by("class", "id").alias("of"), F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi")
    met = rows.join(groups, "g").where("class <> of").groupBy("id", "u", "class", "of").agg(F.count("*").alias("n"))
    best = met.groupBy("id").agg(F.max_by(F.struct("u", "class", "of"), F.struct("n", -F.col("u"))).alias("best")).select(F.col("id").alias("v"), "best.*")
    pairs = best.join(nodes.select(F.col("id").alias("v"), F.col("keys").alias("kv")), "v").join(nodes.select(F.col("id").alias("u"), F.col("keys").alias("ku")), "u").select("class", "of", "kv", "ku")
    least = least_equal(threshold)

    def run(batches):
        for batch in batches:
            left, right = (batch.column(k).flatten().to_numpy().view(np.uint8).reshape(batch.num_rows, TREES * LEVELS) for k in (2, 3))
            equal = (left == right).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(equal), pa.array(np.ones(len(equal)))], PAIRS.names).filter(pa.array(equal >= least))

    return pairs.mapInArrow(run, "u long, v long, equal long, pairs double")


def _dealt(rows: DataFrame, groups: DataFrame, by: str, *columns: str, star: bool = False) -> DataFrame:
    """rows(by, id, class, ...) in pairs (i, j) of blocks of each of groups(by, major, small, large):
    the members of class `major` fall into `large` blocks, all others into `small` ones, and all
    blocks meet but two of the major class. Each row goes once to every pair with its block (own).
    With star, blocks meet themselves and the first one alone: pairs in proportion to blocks."""
    held = rows.join(groups, by).withColumn("inner", F.coalesce(F.col("class") == F.col("major"), F.lit(False)))
    own = F.when(F.col("inner"), F.col("small") + F.pmod(F.xxhash64("id"), F.col("large"))).otherwise(F.pmod(F.xxhash64("id"), F.col("small"))).cast("int")
    last = (F.when(F.col("inner"), F.col("small")).otherwise(F.col("small") + F.col("large")) - 1).cast("int")
    others = F.sequence(F.lit(0), last)
    if star:
        others = F.when(F.col("own") == 0, others).otherwise(F.array_distinct(F.array(F.lit(0), F.col("own"))))
    held = held.withColumn("own", own).withColumn("other", F.explode(others))
    return held.select(by, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", *columns)


def _by_block(batches, width: int):
    """Column lists of the rows of each (group, i, j) in batches sorted by them; `width` leading
    columns become arrays and the last one a list of values."""
    held, last = None, None
    for batch in batches:
        head = [batch.column(k).to_numpy() for k in range(3)]
        change = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in head])) + 1 if batch.num_rows else []
        for lo, hi in zip([0, *change], [*change, batch.num_rows], strict=True):
            if lo == hi:
                continue
            key = tuple(x[lo] for x in head)
            if key != last:
                if held is not None:
                    yield last, [np.concatenate(x) for x in held[:-1]], held[-1]
                held, last = [[] for _ in range(width + 1)], key
            for k in range(width):
                held[k].append(batch.column(3 + k).to_numpy()[lo:hi])
            held[width].extend(batch.column(3 + width).slice(lo, hi - lo))
    if held is not None:
        yield last, [np.concatenate(x) for x in held[:-1]], held[-1]


def across(nodes: DataFrame, depth: int, threshold: float = THRESHOLD) -> DataFrame:
    """Compares the signatures of all nodes of different classes under one trie node of `depth`
    levels, in pairs of blocks of about BLOCK members, so that no task holds more than two of them.
    A pair of blocks passes on (u, v, null, 0), classes with members near enough, as few as join them
    all (not pairs of nodes), and the number of near pairs by equal bytes (null, null, equal, pairs)."""
    rows = _grouped(nodes, depth)
    of = rows.groupBy("g", "class").agg(F.count("*").alias("n")).groupBy("g").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("class", "n").alias("major"), F.count("*").alias("classes")).where("classes > 1")
    blocks = of.select("g", "major", F.ceil((F.col("n") - F.col("most")) / BLOCK).alias("small"), F.ceil(F.col("most") / BLOCK).alias("large"))
    members = rows.join(blocks.select("g"), "g", "left_semi").join(nodes.select("id", "keys"), "id")
    dealt = _dealt(members, blocks, "g", "class", "keys").repartition(buckets(nodes.sparkSession), "g", "i", "j").sortWithinPartitions("g", "i", "j")
    least, shift = least_equal(threshold), np.uint64(8 * (LEVELS - depth))

    def compare(key, own, label, keys):
        own_class = label.copy()
        signature = keys.view(np.uint8).reshape(len(label), -1)
        prefix = keys >> shift
        left, right = np.flatnonzero(own == key[1]), np.flatnonzero(own == key[2])
        edges, met = [], np.zeros(TREES * LEVELS + 1)
        for at in left:
            rest = right[label[right] != label[at]]
            if not len(rest):
                continue
            equal = (signature[rest] == signature[at]).sum(axis=1)
            near = rest[equal >= least]
            if len(near):
                np.add.at(met, equal[equal >= least], 1 / np.maximum(1, (prefix[near] == prefix[at]).sum(axis=1)))  # they meet in so many trees
                labels, first = np.unique(label[near], return_index=True)
                edges += [(own_class[at], own_class[x]) for x in near[first]]
                label[np.isin(label, labels)] = label[at]
        rows = [(u, v, None, 0.0) for u, v in edges] + [(None, None, int(k), met[k]) for k in np.flatnonzero(met)]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], PAIRS.types[k]) for k in range(4)], schema=PAIRS)

    def run(batches):
        for key, (own, label), keys in _by_block(batches, 2):
            yield compare(key, own, label, np.array([x.as_py() for x in keys], np.int64).view(np.uint64))

    return dealt.mapInArrow(run, "u long, v long, equal long, pairs double")


def similar(left: np.ndarray, right: np.ndarray | None, bounds: np.ndarray, columns: np.ndarray, copies: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Of the pairs of `left` with `right` (of `left` with itself if right is None): by set, the
    copies of the sets at or above the threshold, and as few such pairs as join all that are joined.
    Set i is columns[bounds[i]:bounds[i + 1]]; left and right are runs of sets by ascending size."""
    found, label, joins = np.zeros(len(copies), np.int64), np.arange(len(copies)), []
    sizes = np.diff(bounds)
    mark = np.zeros(int(columns.max()) + 1, bool)
    others = left if right is None else right
    for k, at in enumerate(left):
        lo = k + 1 if right is None else int(np.searchsorted(sizes[others], sizes[at] * threshold - 1))
        hi = int(np.searchsorted(sizes[others], sizes[at] / threshold + 1, "right"))
        if lo >= hi:
            continue
        rest = others[lo:hi]
        own = columns[bounds[at] : bounds[at + 1]]
        mark[own] = True
        first = bounds[rest[0]]
        shared = np.add.reduceat(mark[columns[first : bounds[rest[-1] + 1]]], bounds[rest] - first, dtype=np.int64)
        mark[own] = False
        near = rest[shared / (sizes[at] + sizes[rest] - shared) >= threshold]
        found[at] += copies[near].sum()
        found[near] += copies[at]
        labels, first = np.unique(label[near], return_index=True)
        if len(fresh := near[first[labels != label[at]]]):
            joins += [(at, x) for x in fresh]
            label[np.isin(label, labels)] = label[at]
    return found, joins


def within(members: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Exact verification: all pairs of members(id, class, size, copies) of a class are compared on
    their sets, in pairs of blocks bounded by members and n-grams. A pair of blocks passes on a row
    (u, null, links) a member, links being the rows of others at or above the threshold, and as few
    verified links (u, v, 0) as join all that are joined: rows in proportion, not pairs."""
    held = members.join(sets, "id").withColumnRenamed("class", "of").withColumn("class", F.lit(0))
    return _verified(held, _blocks(members), threshold)


def _blocks(members: DataFrame) -> DataFrame:
    total = members.groupBy("class").agg(F.count("*").alias("n"), F.sum("size").alias("all")).where("n > 1")
    return total.select(F.col("class").alias("of"), F.lit(None).cast("long").alias("major"), F.ceil(F.greatest(F.col("n") / BLOCK, F.col("all") / GRAMS)).alias("small"), F.lit(0).alias("large"))


def _verified(held: DataFrame, blocks: DataFrame, threshold: float, star: bool = False) -> DataFrame:
    """(u, v, links), as of within, of held(of, class, id, size, copies, grams) in pairs of blocks."""
    dealt = _dealt(held, blocks, "of", "size", "id", "copies", "grams", star=star)
    dealt = dealt.repartition(buckets(held.sparkSession), "of", "i", "j").sortWithinPartitions("of", "i", "j", "own", "size")

    def run(batches):
        for key, (own, _, ids, copies), grams in _by_block(batches, 4):
            held = [np.frombuffer(x.as_buffer(), np.uint64) for x in grams]
            _, columns = np.unique(np.concatenate(held), return_inverse=True)
            left, right = np.flatnonzero(own == key[1]), np.flatnonzero(own == key[2])
            found, joins = np.zeros(len(ids), np.int64), []
            if len(left) and len(right):
                found, joins = similar(left, None if key[1] == key[2] else right, np.cumsum([0, *map(len, held)]), columns, copies, threshold)
            u = [*ids, *(ids[a] for a, _ in joins)]
            v = [*[None] * len(ids), *(ids[b] for _, b in joins)]
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array([*found, *[0] * len(joins)], pa.int64())], ["u", "v", "links"])

    return dealt.mapInArrow(run, "u long, v long, links long")


def joining(members: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Verified links (u, v) that join all members of a class that verified links join, without
    comparing all pairs: blocks are compared with themselves and with one block of their class, and
    then what that leaves outside the largest component of a class with everything else in it. A
    class of near copies, all like one another, costs in proportion to its members."""
    sets = stash(sets, "sets")
    held = members.join(sets, "id").withColumnRenamed("class", "of").withColumn("class", F.lit(0))
    first = stash(_verified(held, _blocks(members), threshold, star=True).where("v is not null").select("u", "v"), "joins")
    classes = components(first).withColumnRenamed("class", "part")
    parted = stash(members.join(classes, "id", "left").withColumn("part", F.coalesce("part", "id")), "parted")
    parts = parted.groupBy("class", "part").agg(F.count("*").alias("n"), F.sum("size").alias("all"))
    total = parts.groupBy("class").agg(F.max_by("part", F.struct("n", "part")).alias("major"), F.max(F.struct("n", "part", "all")).alias("most"), F.sum("n").alias("n"), F.sum("all").alias("all"), F.count("*").alias("parts")).where("parts > 1")
    size = lambda n, grams: F.ceil(F.greatest(n / BLOCK, grams / GRAMS))
    blocks = total.select(F.col("class").alias("of"), "major", size(F.col("n") - F.col("most.n"), F.col("all") - F.col("most.all")).alias("small"), size(F.col("most.n"), F.col("most.all")).alias("large"))
    rest = parted.join(sets, "id").withColumnsRenamed({"class": "of", "part": "class"})
    return first.union(_verified(rest, blocks, threshold).where("v is not null").select("u", "v"))


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text, p, q): p and q are 128 bits of key and text."""
    id, told = F.col(key).cast("long"), F.coalesce(F.col(text), F.lit(""))
    return docs.select(id.alias("id"), told.alias("text"), *_picks(id, told))


def _picks(id, text) -> list:
    return [F.xxhash64(F.lit(seed), id.isNull(), id, text).alias(name) for seed, name in enumerate("pq")]


def candidates(nodes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, list[tuple[int, float]]]:
    """nodes(id, keys, class): classes are what signatures join under common prefixes, which shorten
    from whole keys on as far as what is measured asks for, until the recall reaches the target; also the
    depths and recalls.
    At each depth nodes join leaders first, which closes large groups cheaply, then open pairs are
    compared."""
    typed, told, pairs, depth = nodes.withColumn("class", F.col("id")), [], collections.Counter(), LEVELS
    while True:
        for step in (leaders, across):
            links = stash(step(typed, depth, threshold), "open")
            counts = {r["equal"]: r for r in links.groupBy("equal").agg(F.sum("pairs").alias("pairs"), F.count("u").alias("links")).collect()}  # at most one row a byte count
            pairs.update({equal: r["pairs"] for equal, r in counts.items() if equal is not None})
            if n := sum(r["links"] for r in counts.values()):
                typed = stash(merged(typed, links.where("u is not null").select("u", "v"), n), "typed")
        told.append((depth, measured(pairs, depth, threshold, recall)))
        if told[-1][1] >= recall:
            return typed, told
        if depth == 1:
            raise RuntimeError(f"recall {told[-1][1]:.4f} at the shortest prefix is short of {recall}")
        depth = next((d for d in range(depth - 1, 1, -1) if measured(pairs, depth, threshold, recall, d) >= recall), 1)


def classified(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, count: bool = True) -> tuple[DataFrame, DataFrame]:
    """Signatures of the rows of docs, and the nodes (id, a, b, size, copies, first, class, links):
    each distinct set, with its least row, its class, and the rows of other sets linked to it. Without
    count, links are null and only as many pairs are compared as it takes to tell the classes."""
    rows = _rows(docs, key, text)
    signed = stash(signatures(rows, n), "signatures")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "p", "q")).alias("first")
    groups = signed.where("size > 0").groupBy("a", "b", "size").agg(first, F.count("*").alias("copies"), F.min("keys").alias("keys"))
    groups = stash(groups.withColumn("id", F.monotonically_increasing_id()), "groups")
    typed, _ = candidates(groups.select("id", "keys"), threshold, recall)
    several = typed.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class")
    members = typed.select("id", "class").join(several, "class").join(groups.select("id", "size", "copies", F.col("first.p").alias("p"), "a", "b"), "id")
    members = stash(members, "members")
    told, sets = members.select("id", "class", "size", "copies"), sets_of(rows, members, n)
    if not count:
        classes = components(stash(joining(told, sets, threshold), "links"))
        nodes = groups.drop("keys").join(classes, "id", "left").withColumns({"class": F.coalesce("class", "id"), "links": F.lit(None).cast("long")})
        return signed, stash(nodes, "nodes")
    exact = stash(within(told, sets, threshold), "links")
    links = exact.where("v is null").groupBy("u").agg(F.sum("links").alias("links")).withColumnRenamed("u", "id")
    classes = components(exact.where("v is not null").select("u", "v"))
    nodes = groups.drop("keys").join(classes, "id", "left").join(links, "id", "left")
    return signed, stash(nodes.withColumns({"class": F.coalesce("class", "id"), "links": F.coalesce("links", F.lit(0))}), "nodes")


def join_similar(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of docs: key, class_id (the least key of its class) and n_links (other rows
    whose n-gram sets have at least the threshold's similarity with its own)."""
    signed, nodes = classified(docs, key, text, n, threshold, recall)
    names = nodes.groupBy("class").agg(F.min("first.id").alias("name"))
    told = nodes.join(names, "class").select("a", "b", "size", "name", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    out = signed.select("id", "a", "b", "size").join(told, ["a", "b", "size"], "left")
    alone = F.col("size") == 0
    return out.select(F.col("id").alias(key), F.when(alone, F.col("id")).otherwise(F.col("name")).alias("class_id"), F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Pipeline stage: the row of least key (rows without one last) of each class, with the columns
    of docs. A row is dropped only if a kept row is in its class; rows without n-grams all stay."""
    _, nodes = classified(docs, key, text, **options, count=False)
    p, q = free(docs, "p", "q")
    kept = nodes.groupBy("class").agg(F.min("first").alias("first")).select(F.col("first.p").alias(p), F.col("first.q").alias(q))
    told = F.coalesce(F.col(text), F.lit(""))
    marked = docs.withColumns(dict(zip((p, q), _picks(F.col(key).cast("long"), told), strict=True)))
    some = told.rlike(r"[^\x20\x09-\x0D]")
    one = marked.where(some).join(kept, [p, q], "left_semi").dropDuplicates([p, q])
    return one.unionByName(marked.where(~some)).select(*docs.columns)


def op3(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return join_similar(docs)


#: Brute force: pairs of distinct sets that share an n-gram, their exact similarity, and classes as
#: the least document reached over links.
ORACLE = rf"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) >= {N} THEN list_transform(range(len(ws) - {N - 1}), lambda i: array_to_string(ws[i + 1:i + {N}], ' ')) ELSE [array_to_string(ws, ' ')] END)) AS grams FROM d WHERE len(ws) > 0),
n AS (SELECT grams, min(doc_id) AS id, count(*) AS copies, len(grams) AS size FROM s GROUP BY 1), g AS (SELECT id, unnest(grams) AS gram FROM n),
c AS (SELECT a.id AS u, b.id AS v, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.id <> b.id GROUP BY 1, 2),
l AS (SELECT u, v, y.copies AS copies FROM c JOIN n x ON x.id = u JOIN n y ON y.id = v WHERE shared / (x.size + y.size - shared) >= {THRESHOLD}),
r AS (SELECT id, id AS class FROM n UNION SELECT l.v, r.class FROM r JOIN l ON l.u = r.id),
k AS (SELECT id, min(class) AS class_id FROM r GROUP BY 1), t AS (SELECT u AS id, sum(copies) AS n FROM l GROUP BY 1),
o AS (SELECT s.doc_id, k.class_id, coalesce(t.n, 0) + n.copies - 1 AS n_links FROM s JOIN n USING (grams) JOIN k USING (id) LEFT JOIN t USING (id))
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links FROM documents LEFT JOIN o USING (doc_id)"""
