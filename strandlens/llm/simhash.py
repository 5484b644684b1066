"""SimHash near-duplicate groups: fingerprints, BK-trees of shards, connected components.

A text is lower-cased in A-Z and cut into words `[^\\x20\\x09-\\x0D]+`; its shingles are `size` words joined by a space
(fewer words: the whole sequence). A fingerprint bit is 1 if it is set in over half of the shingles' XXH64 (seed 42);
no word gives fingerprint zero, linked like any other. near_duplicate_groups(): fingerprints that differ in `radius` bits or fewer are linked and
a component is named by its smallest doc_id.

The 64 bits are cut into radius + AGREE blocks: two fingerprints within the radius agree in AGREE of them at least. Distinct
fingerprints are dealt to a shard for each choice of AGREE blocks, so that one shard holds both; with a radius of 3 these
are 10 shards of 24 to 26 bits each, few members in each up to some 10**10 fingerprints. Each shard's members form
a BK-tree (children keyed by the Hamming distance to their parent) and each member follows only edges within the radius.
Shards stay where Spark deals them; they are not broadcast, as their size isn't bounded. A shard of more than MAX_MEMBERS
is cut into chunks and each pair of chunks is a tree and a set of queries of its own, so that no link is lost and no task
grows. A task goes through its trees in order and holds about HELD members at a time. Of the links found, it passes on
a spanning forest only.

Null texts count as empty. Rows with null doc_id get a fingerprint and the component of their group (null if no row
there has an id). Repeated rows each give a row. An empty table gives no rows. Other columns of the input are left out, so
none can clash. Ties don't arise: a component's name is the smallest doc_id. drop_near_copies() keeps all columns as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from strandlens.llm import text as tx
from strandlens.llm.components import components
from strandlens.llm.store import keep, table

SHINGLE, SEED, RADIUS, AGREE = 3, 42, 3, 2
MAX_MEMBERS, HELD = 8192, 1 << 19
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: For each byte, its bits from the highest as eight bytes of 0 or 1, in one word.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64)[:, 0]
POPULATION = np.unpackbits(np.arange(1 << 16, dtype=">u2").view(np.uint8).reshape(-1, 2), axis=1).sum(axis=1).astype(np.uint8)


def shingles(text: bytes, size: int = SHINGLE) -> list[bytes]:
    words = text.translate(LOWER).split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(islice(words, k, None) for k in range(size)))))


def fingerprint_bytes(texts: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Each text's fingerprint as eight bytes, the highest first."""
    digest = xxhash.xxh64_digest
    counts, parts = np.zeros(len(texts), np.int64), []
    for i, text in enumerate(texts):
        own = shingles(text, size)
        counts[i] = len(own)
        parts.append(b"".join(map(digest, own, repeat(SEED))))
    rows = LANES[np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 8)]
    out = np.zeros((len(texts), 8), np.uint8)
    full = np.flatnonzero(counts)
    if len(full):
        starts = (np.cumsum(counts) - counts)[full]
        # lanes hold up to 255, so each text is summed in runs of that many shingles first
        runs = -(-counts[full] // 255)
        first = np.cumsum(runs) - runs
        begin = np.repeat(starts, runs) + 255 * (np.arange(int(runs.sum())) - np.repeat(first, runs))
        lanes = np.add.reduceat(rows, begin, axis=0).view(np.uint8).astype(np.int64)
        ones = np.add.reduceat(lanes, first, axis=0)
        out[full] = np.packbits(2 * ones > counts[full, None], axis=1)
    return out


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text", size: int = SHINGLE) -> DataFrame:
    """`keys` of `docs` with fp (the fingerprint as a signed long), one row for each of `docs`."""

    def make(batches):
        for part in tx.steps(batches, "__text"):
            found = fingerprint_bytes(tx.blobs(part.column("__text")), size)
            yield pa.record_batch([*(part.column(k) for k in keys), pa.array(found.view(">u8")[:, 0].astype(np.uint64).view(np.int64))], names=[*keys, "fp"])

    part = docs.select(*keys, F.col(text).cast("string").alias("__text"))
    return part.mapInArrow(make, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keys).schema) + "fp long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    halves = (a ^ b).view(np.uint16).reshape(len(a), 4)
    return POPULATION[halves].sum(axis=1, dtype=np.int64)


class BKForest:
    """BK-trees of many shards at once, built and searched level by level.

    `tree` names each member's tree. Level by level the first member of each subset becomes a node, and the others
    go to its children by their distance to it.
    """

    def __init__(self, tree: np.ndarray, value: np.ndarray):
        order = np.argsort(tree, kind="stable")
        members, subset = order, tree[order]
        self.roots, first = np.unique(subset, return_index=True)
        self.value, self.member = [], []
        self.edges: list[np.ndarray] = []  # of each level but the first: node above * 128 + distance, ascending
        subset = np.searchsorted(self.roots, subset)
        while len(members):
            head = np.concatenate([[True], subset[1:] != subset[:-1]])
            node = np.cumsum(head) - 1
            pivots = members[head]
            self.value.append(value[pivots])
            self.member.append(pivots)
            rest = ~head
            up, members = node[rest], members[rest]
            edge = up * 128 + distance(value[members], value[pivots][up])
            order = np.argsort(edge, kind="stable")
            members, subset = members[order], edge[order]
            self.edges.append(np.unique(subset))

    def search(self, tree: np.ndarray, value: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, member) within the radius; query i looks in tree[i]."""
        query, node = np.arange(len(tree)), np.searchsorted(self.roots, tree)
        hits: list = []
        for level in range(len(self.value)):
            away = distance(value[query], self.value[level][node])
            near = away <= radius
            hits.append((query[near], self.member[level][node[near]]))
            edges = self.edges[level]
            low = np.searchsorted(edges, node * 128 + np.maximum(away - radius, 0), "left")
            high = np.searchsorted(edges, node * 128 + away + radius, "right")
            many = high - low
            query = np.repeat(query, many)
            node = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
            if not len(query):
                break
        return np.concatenate([x for x, _ in hits]), np.concatenate([x for _, x in hits])


def forest_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def shard_links(fps: np.ndarray, tree: np.ndarray, role: np.ndarray, radius: int = RADIUS, most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Links a < b of a spanning forest. role: 1 member of its tree, 2 query, 3 both. Searched in blocks of bounded pairs."""
    values, index = np.unique(fps, return_inverse=True)
    held, asked = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
    if not len(held) or not len(asked):
        return values[:0], values[:0]
    forest = BKForest(tree[held], fps[held])
    asked = asked[np.isin(tree[asked], forest.roots)]
    sizes = np.bincount(np.searchsorted(forest.roots, tree[held]))
    cost = np.cumsum(sizes[np.searchsorted(forest.roots, tree[asked])])
    label = np.arange(len(values))
    start = 0
    while start < len(asked):
        base = cost[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(cost, base + most, "right")))
        part = asked[start:stop]
        q, m = forest.search(tree[part], fps[part], radius)
        a, b = index[part[q]], index[held[m]]
        other = a != b
        near = forest_of(len(values), np.concatenate([np.arange(len(values)), a[other]]), np.concatenate([label, b[other]]))
        label, start = near, stop
    apart = np.flatnonzero(label != np.arange(len(values)))
    return values[label[apart]], values[apart]


def shards(radius: int, agree: int = AGREE) -> list[F.Column]:
    """The shards of column fp: for each choice of `agree` of radius + agree blocks, their bits below the choice's number."""
    edges = [64 * i // (radius + agree) for i in range(radius + agree + 1)]
    out = []
    for number, chosen in enumerate(combinations(range(radius + agree), agree)):
        mask = sum(((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in chosen)
        out.append(F.xxhash64(F.lit(number), F.col("fp").bitwiseAND(F.lit(mask - (mask >> 63 << 64)))))
    return out


def whole_trees(batches) -> Iterator[pa.Table]:
    """Members of whole trees, about HELD of them at a time, from batches in order of their trees."""
    parts, n = [], 0
    for batch in batches:
        parts.append(batch)
        n += batch.num_rows
        if n >= HELD:
            held = pa.Table.from_batches(parts).combine_chunks()
            tree = held.column("tree").to_numpy()
            cut = int(np.searchsorted(tree, tree[-1], "left"))  # the last tree may go on
            if cut:
                yield held.slice(0, cut)
                parts, n = held.slice(cut).to_batches(), held.num_rows - cut
    if n:
        yield pa.Table.from_batches(parts).combine_chunks()


def links(distinct: DataFrame, radius: int = RADIUS, max_members: int = MAX_MEMBERS) -> DataFrame:
    """Columns a, b: links that connect what links of `radius` bits or fewer connect, among distinct values of column fp."""
    dealt = distinct.select("fp", F.explode(F.array(*shards(radius))).alias("shard"))
    # few: only shards that a task shouldn't take whole
    hot = dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > max_members)
    dealt = dealt.join(hot, "shard", "left")
    chunks = F.ceil(F.coalesce("members", F.lit(1)) / F.lit(max_members)).cast("int")
    own = F.pmod(F.xxhash64("fp", "shard"), chunks).cast("int")
    dealt = dealt.select("fp", "shard", own.alias("own"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
    # chunk pair (i, j), i <= j: chunk i is the tree, chunk j asks
    dealt = dealt.select("fp", F.when(F.col("own") + F.col("other") == 0, F.col("shard")).otherwise(F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other"))).alias("tree"),
                         F.when(F.col("own") == F.col("other"), 3).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("role"))

    def find(batches):
        for held in whole_trees(batches):
            fps, tree, role = (held.column(k).to_numpy() for k in ("fp", "tree", "role"))
            # most trees are one member, which has no partner
            alone = np.concatenate([[True], tree[1:] != tree[:-1]]) & np.concatenate([tree[1:] != tree[:-1], [True]])
            fps, tree, role = (np.ascontiguousarray(x[~alone]) for x in (fps, tree, role))
            a, b = shard_links(fps, tree, role, radius)
            for i in range(0, len(a), 100_000):
                yield pa.record_batch([pa.array(a[i : i + 100_000]), pa.array(b[i : i + 100_000])], names=["a", "b"])

    return dealt.repartition("tree").sortWithinPartitions("tree").mapInArrow(find, "a long, b long")


def group_roots(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Columns fp, root for the distinct fingerprints of `marked`: root is one fingerprint of the component."""
    distinct = keep(marked.select("fp").distinct(), "simhash-distinct")
    found = links(distinct, radius)
    return distinct.join(components(found).withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicate_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """Columns doc_id, fingerprint, component_id, one row for each of `docs`."""
    marked = keep(fingerprints(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), ["doc_id"], "text", size), "simhash")
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = least.join(group_roots(marked, radius), "fp")
    best = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(best, "root").select(F.col("fp").alias("of_fp"), "component_id")
    # of_fp has each fingerprint once; a fingerprint with many rows, such as that of empty texts, is split by AQE
    return marked.join(of, F.col("fp") == F.col("of_fp")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Of drop_near_copies(): words of a shingle, similarity of shingle sets, bits within which pairs are looked at, bins of
#: least shingle hashes, and rows that are broadcast at most (more are joined by a shuffle, with the same result).
COPY_SHINGLE, SIMILARITY, COPY_RADIUS, BINS, BROADCAST_ROWS = 5, 0.8, 20, 8, 1 << 20
#: Partners of each class that the first round compares, besides a spanning forest of least distance; and members of one tree in
#: the second round, which compares what the first has left apart.
NEAREST, CHUNK = 2, 4096


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    """The least hash of each of BINS equal ranges that has one: sets of similarity J share each with a chance of about J."""
    own = np.unique(hashes)
    bins = own >> np.uint64(64 - BINS.bit_length() + 1)
    return own[np.concatenate([np.ones(min(1, len(own)), bool), bins[1:] != bins[:-1]])]


def spanning(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which of the links a-b among n nodes form a spanning forest of least weight; ties go to the earlier link."""
    order = np.argsort(weight, kind="stable")
    label, chosen, at = np.arange(n), [], order
    while True:
        la, lb = label[a[at]], label[b[at]]
        apart = la != lb
        at, la, lb = at[apart], la[apart], lb[apart]
        if not len(at):
            return np.sort(np.concatenate([np.zeros(0, np.int64), *chosen]))
        # each component's first link, as links are in order
        place, least = np.arange(len(at)), np.full(n, len(at))
        np.minimum.at(least, la, place)
        np.minimum.at(least, lb, place)
        first = np.unique(least[least < len(at)])
        chosen.append(at[first])
        label = forest_of(n, np.concatenate([np.arange(n), la[first]]), np.concatenate([label, lb[first]]))


def nearest(a: np.ndarray, b: np.ndarray, weight: np.ndarray, most: int) -> np.ndarray:
    """The links that are among the `most` least ones of either end."""
    end, link = np.concatenate([a, b]), np.tile(np.arange(len(a)), 2)
    order = np.lexsort((link, weight[link], end))
    first = np.concatenate([np.ones(min(1, len(end)), bool), end[order][1:] != end[order][:-1]])
    rank = np.arange(len(end)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    return np.unique(link[order][rank < most])


def shard_pairs(fps: np.ndarray, tree: np.ndarray, role: np.ndarray, radius: int, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Pairs a, b of distinct values within the radius: each one's NEAREST, and a spanning forest of least distance."""
    values, index = np.unique(fps, return_inverse=True)
    held, asked = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
    a = b = w = np.zeros(0, np.int64)
    if len(held) and len(asked):
        forest = BKForest(tree[held], fps[held])
        asked = asked[np.isin(tree[asked], forest.roots)]
        sizes = np.bincount(np.searchsorted(forest.roots, tree[held]))
        cost = np.cumsum(sizes[np.searchsorted(forest.roots, tree[asked])])
        start = 0
        while start < len(asked):
            stop = max(start + 1, int(np.searchsorted(cost, (cost[start - 1] if start else 0) + most, "right")))
            q, m = forest.search(tree[asked[start:stop]], fps[asked[start:stop]], radius)
            x, y = index[asked[start:stop][q]], index[held[m]]
            other = x != y
            x, y = np.minimum(x, y)[other], np.maximum(x, y)[other]
            a, b, w = np.concatenate([a, x]), np.concatenate([b, y]), np.concatenate([w, distance(values[x], values[y])])
            _, own = np.unique(a * len(values) + b, return_index=True)  # several trees may hold a pair
            a, b, w = a[own], b[own], w[own]
            own = np.union1d(spanning(len(values), a, b, w), nearest(a, b, w, NEAREST))
            a, b, w, start = a[own], b[own], w[own], stop
    return values[a], values[b]


def with_places(docs: DataFrame) -> DataFrame:
    """`docs` with __file and __row, which name each row by its place in the files that it is read from."""
    try:
        place = docs.metadataColumn("_metadata")
        return docs.withColumns({"__file": F.xxhash64(place["file_path"]), "__row": place["row_index"]})
    except AnalysisException:  # not read from files
        return with_places(keep(docs, "copies-input"))


def dealt_trees(members: DataFrame, shards: DataFrame, most: int) -> DataFrame:
    """`members` (fp, shard and others) of the given `shards` (shard, members), with tree and role (1 member, 2 query, 3 both): a shard
    of more than `most` is cut into chunks, and each pair of chunks is a tree, so that each two members meet in one."""
    chunks = F.ceil(F.col("members") / F.lit(most)).cast("int")
    dealt = members.join(shards.select("shard", "members"), "shard").withColumn("own", F.pmod(F.xxhash64("fp", "shard"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    role = F.when(F.col("own") == F.col("other"), 3).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return dealt.withColumns({"tree": F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other")), "role": role}).drop("own", "other", "members")


def one_tree_each(batches) -> Iterator[pa.Table]:
    """Whole trees, one at a time, from batches in order of their trees."""
    parts: list = []
    for batch in batches:
        tree = batch.column("tree").to_numpy()
        cuts = [0, *(np.flatnonzero(tree[1:] != tree[:-1]) + 1).tolist(), len(tree)]
        for start, stop in zip(cuts, cuts[1:]):
            if start == stop:
                continue
            if parts and parts[-1].column("tree")[0].as_py() != tree[start]:
                yield pa.Table.from_batches(parts).combine_chunks()
                parts = []
            parts.append(batch.slice(start, stop - start))
    if parts:
        yield pa.Table.from_batches(parts).combine_chunks()


def apart(held: pa.Table, similarity: float, radius: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places x, y of two members of one of the held trees each, in blocks: of different roots, fingerprints within the radius, and sizes
    that allow the similarity. A pair that shares several least hashes is taken in the shard of the first of these."""
    fps, tree, role, root, n = (np.ascontiguousarray(held.column(k).to_numpy()) for k in ("fp", "tree", "role", "root", "n"))
    shard = held.column("shard").to_numpy().astype(np.int64).view(np.uint64)
    lists = held.column("least").combine_chunks()
    values, bounds = lists.flatten().to_numpy().astype(np.int64).view(np.uint64), np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
    least, shift = np.zeros((len(fps), BINS), np.uint64), np.uint64(64 - BINS.bit_length() + 1)
    filled = np.zeros((len(fps), BINS), bool)
    at = np.repeat(np.arange(len(fps)), np.diff(bounds)), (values >> shift).astype(np.int64)
    least[at], filled[at] = values, True
    members, asked = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
    if not len(members) or not len(asked):
        return
    forest = BKForest(tree[members], fps[members])
    asked = asked[np.isin(tree[asked], forest.roots)]
    sizes = np.bincount(np.searchsorted(forest.roots, tree[members]))
    cost = np.cumsum(sizes[np.searchsorted(forest.roots, tree[asked])])
    start = 0
    while start < len(asked):
        stop = max(start + 1, int(np.searchsorted(cost, (cost[start - 1] if start else 0) + most, "right")))
        q, m = forest.search(tree[asked[start:stop]], fps[asked[start:stop]], radius)
        x, y = asked[start:stop][q], members[m]
        # in a tree of one chunk both orders are found
        good = (root[x] != root[y]) & (np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y])) & ((role[x] != 3) | (fps[x] < fps[y]))
        x, y = x[good], y[good]
        shared = filled[x] & filled[y] & (least[x] == least[y])
        first = shared.argmax(axis=1) == (shard[x] >> shift).astype(np.int64)
        yield x[first], y[first]
        start = stop


def similar_links(held: pa.Table, similarity: float, radius: int, most: int = 1 << 22) -> tuple[list[int], list[int]]:
    """Links of members of one tree that are `similarity` alike by their hashes; pairs that links already connect are passed over.
    Each member's hashes are marked once and counted in all of its partners, about `most` hashes at a time."""
    fps = held.column("fp").to_numpy()
    group = np.unique(held.column("root").to_numpy(), return_inverse=True)[1]
    lists = held.column("hashes").combine_chunks()
    number = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
    n = np.diff(lists.offsets.to_numpy())
    begin = np.cumsum(n) - n
    marked = np.zeros(int(number.max(initial=-1)) + 1, bool)
    a, b = [], []
    for xs, ys in apart(held, similarity, radius):
        order = np.argsort(xs, kind="stable")
        xs, ys = xs[order], ys[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(xs)), bool), xs[1:] != xs[:-1]]))
        for start, stop in zip(first.tolist(), [*first[1:].tolist(), len(xs)]):
            x, rest = int(xs[start]), ys[start:stop]
            own = number[begin[x] : begin[x] + n[x]]
            marked[own] = True
            while len(rest):
                rest = rest[group[rest] != group[x]]
                part = rest[: max(1, int(np.searchsorted(np.cumsum(n[rest]), most, "right")))]
                rest = rest[len(part) :]
                if not len(part):
                    break
                at = np.cumsum(n[part]) - n[part]
                place = np.repeat(begin[part] - at, n[part]) + np.arange(int(n[part].sum()))
                both = np.add.reduceat(marked[number[place]].astype(np.int64), at)
                for y in part[both >= similarity * (n[x] + n[part] - both)].tolist():
                    if group[x] != group[y]:
                        group[group == group[y]] = group[x]
                        a.append(int(fps[x]))
                        b.append(int(fps[y]))
            marked[own] = False
    return a, b


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, radius: int = COPY_RADIUS, size: int = COPY_SHINGLE) -> DataFrame:
    """`docs` with one row of each group of near copies: the one of smallest key, a null key last.

    Texts of one fingerprint over shingles of `size` words are one class. Classes that share a least shingle hash are
    the members of a shard's BK-tree. In a first round each one's NEAREST within `radius` bits and a spanning forest of least
    distance are compared, and linked if the exact similarity of the shingle sets of their first rows' texts is `similarity`
    or more. What these links leave apart is compared in a second round: every two members of a shard within the radius whose
    sizes allow the similarity, unless links connect them meanwhile, so that a large group of copies gives no pairs and a family
    of pages that are less alike is compared whole. Similar pairs are missed only by chance of the hashes: with eight least hashes
    at a similarity of 0.8 a pair shares none once in 390,000 times, and few are over 20 bits apart.
    Rows are told apart by their place in their files, so that rows which share a key but not a text both stay.
    """
    rows = with_places(docs)
    given = rows.select("__file", "__row", F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    hashed = lambda x: np.unique(np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles(x, size), repeat(SEED))), ">u8").astype(np.uint64))

    def listed(arrays: list) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)))

    def mark(batches):
        for part in tx.steps(batches, "__text"):
            texts = tx.blobs(part.column("__text"))
            found = fingerprint_bytes(texts, size).view(">u8")[:, 0].astype(np.uint64).view(np.int64)
            hashes = [hashed(x) for x in texts]
            n = pa.array([len(x) for x in hashes], pa.int64())
            yield pa.record_batch([*(part.column(k) for k in ("__file", "__row", "__key")), pa.array(found), n, listed([least_hashes(x) for x in hashes])], names=["__file", "__row", "__key", "fp", "n", "least"])

    kind = given.schema["__key"].dataType.simpleString()
    marked = keep(given.mapInArrow(mark, f"__file long, __row long, __key {kind}, fp long, n long, least array<long>"), "copies-marked")
    place = F.struct(F.col("__key").isNull().alias("unnamed"), F.col("__key").alias("key"), F.col("__file").alias("file"), F.col("__row").alias("row"))
    classes = keep(marked.groupBy("fp").agg(F.min(F.struct(place.alias("place"), "n", "least")).alias("first")).select("fp", "first.*"), "copies-classes")
    members = classes.select("fp", F.explode("least").alias("shard"))
    sizes = members.groupBy("shard").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")

    def pair(batches):
        for held in whole_trees(batches):
            fps, tree, role = (np.ascontiguousarray(held.column(k).to_numpy()) for k in ("fp", "tree", "role"))
            a, b = shard_pairs(fps, tree, role, radius)
            yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    dealt = dealt_trees(members, sizes, MAX_MEMBERS).select("fp", "tree", "role")
    pairs = keep(dealt.repartition("tree").sortWithinPartitions("tree").mapInArrow(pair, "a long, b long").distinct(), "copies-pairs")

    def texts_of(fps: DataFrame) -> DataFrame:
        """Columns fp, __text of the first row of each of the classes `fps`."""
        wanted = fps.join(classes, "fp").select("fp", F.col("place.file").alias("__file"), F.col("place.row").alias("__row"))
        return given.select("__file", "__row", "__text").join(few(wanted), ["__file", "__row"]).select("fp", "__text")

    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct())

    def compare(batches):
        for batch in batches:
            for part in tx.steps(iter([batch]), "text_a"):
                good = []
                for x, y in zip(tx.blobs(part.column("text_a")), tx.blobs(part.column("text_b"))):
                    x, y = set(shingles(x, size)), set(shingles(y, size))
                    good.append(len(x & y) >= similarity * len(x | y))
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(texts.select(F.col("fp").alias("a"), F.col("__text").alias("text_a")), "a").join(texts.select(F.col("fp").alias("b"), F.col("__text").alias("text_b")), "b")
    linked = keep(both.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long"), "copies-linked")

    # second round: what is in a shard together and still apart
    named = keep(classes.join(components(linked).withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root")), "copies-named")
    members = named.select("*", F.explode("least").alias("shard"))
    mixed = members.groupBy("shard").agg(F.count(F.lit(1)).alias("members"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    dealt = dealt_trees(members, mixed, CHUNK)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema)

    def partnered(batches):
        for held in whole_trees(batches):
            seen = np.zeros(held.num_rows, bool)
            for x, y in apart(held, similarity, radius):
                seen[x] = seen[y] = True
            yield from held.filter(pa.array(seen)).to_batches()

    some = keep(dealt.repartition("tree").sortWithinPartitions("tree").mapInArrow(partnered, fields), "copies-partnered")

    def hashes(batches):
        for part in tx.steps(batches, "__text"):
            yield pa.record_batch([part.column("fp"), listed([hashed(x) for x in tx.blobs(part.column("__text"))])], names=["fp", "hashes"])

    def link(batches):
        for held in one_tree_each(batches):
            a, b = similar_links(held, similarity, radius)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    own = texts_of(some.select("fp").distinct()).mapInArrow(hashes, "fp long, hashes array<long>")
    late = some.join(own, "fp").repartition("tree").sortWithinPartitions("tree").mapInArrow(link, "a long, b long")
    roots = components(linked.union(keep(late, "copies-late")))
    of = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "place", F.coalesce("root", "fp").alias("root"))
    first = of.join(of.groupBy("root").agg(F.min("place").alias("first")), "root").select(F.col("fp").alias("of_fp"), "first")
    gone = marked.join(first, F.col("fp") == F.col("of_fp")).filter((F.col("__file") != F.col("first.file")) | (F.col("__row") != F.col("first.row"))).select("__file", "__row")
    return rows.join(few(keep(gone, "copies-gone")), ["__file", "__row"], "left_anti").select(docs.columns)


def few(rows: DataFrame) -> DataFrame:
    """`rows`, to be broadcast if they are counted as BROADCAST_ROWS or fewer."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows.hint("merge")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "documents"))
