"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Each distinct set of word shingles gets, in every tree of the forest, a signature: a string of LABELS min-hash labels. The
signatures of a tree, sorted, are its prefix trie: neighbours in the order share the longest prefixes, and a set whose neighbours
share too short a prefix with it has no candidates in that tree. The join starts from the longest prefixes and shortens them, step by
step. At each step, sets that agree in the shortened prefix, and did not meet before, are verified on their shingles (64-bit
hashes of the word tuples). From the similarities of the links found so far follows how many such links the forest would have
missed at this length; once the estimated recall reaches the target, or the length at which even a pair at the threshold
meets with that chance, the join is done. The members of a trie node are dealt into blocks, and pairs of blocks are verified.

Large groups of near copies are not compared pair by pair. A set of a large node of the longest prefix is compared with the node's
smallest set, its centre. As Jaccard distance keeps the triangle inequality, sets within half the threshold's distance of their
centre all link with each other: they form a cluster, whose links follow from its size. Within a node, only what is outside the
cluster that fills most of it is compared, with all of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityloom.llm.blocks import grouped, lists, sided_pairs
from cityloom.llm.common import drop_table, partitions, write_table
from cityloom.llm.components import connected_components, forest

TREES, LABELS, RECALL = 16, 10, 0.999
#: Bytes of a label in a signature.
WIDTH = 2
#: Lengths of the prefix that the join shortens to in turn.
DEPTHS = (10, 8, 6, 5, 4, 3, 2, 1)
#: Similarities are counted in so many bins from 0 to 1.
BINS = 100
#: Members of a block: what a task compares is two of them.
BLOCK = 192
_RADIX = np.uint64(0x100000001B3)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts in order, words of each text). Words: runs without ASCII white space, lower case.

    A word's hash is a polynomial of its bytes, taken for all words at once from running sums.
    """
    raw = [(t or "").lower().encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    inside = ~_SPACE[data]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if inside[-1]:
        end = np.append(end, len(data))
    with np.errstate(over="ignore"):
        lens = end - begin
        out = np.zeros(len(begin), np.uint64)
        k, live = 0, np.arange(len(begin))
        while live.size:
            out[live] = out[live] * _RADIX + data[begin[live] + k].astype(np.uint64) + np.uint64(1)
            k += 1
            live = live[lens[live] > k]
        out = mixed(out + lens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    upto = np.cumsum([len(r) + 1 for r in raw])
    return out, np.diff(np.searchsorted(begin, upto), prepend=0)


def shingle_sets(texts: list[str | None], words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text in turn, offsets). A text of fewer words is one shingle; without any: none."""
    hashes, many = word_hashes(texts)
    first = np.cumsum(many) - many
    count = np.where(many == 0, 0, np.maximum(1, many - words + 1))
    owner = np.repeat(np.arange(len(texts)), count)
    at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    left = (first + many)[owner] - at
    value = np.full(len(at), 0x51ED270B, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            has = left > k
            value = np.where(has, mixed(value * np.uint64(0x9E3779B97F4A7C15) + hashes[np.minimum(at + k, max(0, len(hashes) - 1))]), value) if len(hashes) else value
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(texts)))])


def meeting_chance(similarity: float | np.ndarray, depth: int, trees: int = TREES):
    """Chance that two sets agree in the first depth labels of some tree."""
    return 1 - (1 - similarity**depth) ** trees


def depths_for(threshold: float, trees: int = TREES, labels: int = LABELS, recall: float = RECALL) -> list[int]:
    """Lengths to shorten to: down to the longest one at which a pair at the threshold meets with a chance of recall, if any."""
    steps = [d for d in DEPTHS if d <= labels]
    last = next((d for d in steps if meeting_chance(threshold, d, trees) >= recall), steps[-1])
    return [d for d in steps if d >= last]


def estimated_recall(found: np.ndarray, depth: int, trees: int = TREES) -> float:
    """Share of the links that were met, from the links found by similarity bin: each stands for 1 / its chance of being met."""
    bins = np.flatnonzero(found)
    stand_for = found[bins] / meeting_chance((bins + 0.5) / len(found), depth, trees)
    return float(found.sum() / stand_for.sum()) if len(bins) else 0.0


def signatures(values: np.ndarray, offsets: np.ndarray, trees: int, labels: int) -> np.ndarray:
    """(sets, trees * labels * WIDTH) bytes: the labels of each tree, high byte first, so that byte order is label order. Empty sets have zeros."""
    full = np.flatnonzero(np.diff(offsets) > 0)
    out = np.zeros((len(offsets) - 1, trees, labels), ">u2")
    rng = np.random.default_rng(20240229)
    a = rng.integers(1, 1 << 63, (trees, labels), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, (trees, labels), dtype=np.uint64)
    if len(full):
        with np.errstate(over="ignore"):
            for t in range(trees):
                for k in range(labels):
                    v = values * a[t, k] + b[t, k]
                    v ^= v >> np.uint64(32)
                    out[full, t, k] = (mixed(np.minimum.reduceat(v, offsets[full])) & np.uint64(0xFFFF)).astype(np.uint16)
    return out.reshape(len(out), -1).view(np.uint8)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    at = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(rows))])


def _bytes(column: pa.Array) -> np.ndarray:
    """A binary column of equal lengths as rows of bytes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(len(column), -1)


def _sign(trees: int, labels: int, words: int):
    @F.arrow_udf("struct<n:int,a:bigint,b:bigint,signature:binary>")
    def sign(text: pa.Array) -> pa.Array:
        values, offsets = shingle_sets(text.to_pylist(), words)
        full = np.diff(offsets) > 0
        a, b = np.zeros(len(full), np.uint64), np.zeros(len(full), np.uint64)
        if full.any():
            with np.errstate(over="ignore"):
                a[full] = np.add.reduceat(mixed(values), offsets[:-1][full])
                b[full] = np.add.reduceat(mixed(values * np.uint64(0xD6E8FEB86659FD93)), offsets[:-1][full])
        columns = [pa.array(np.diff(offsets).astype(np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), _binary(signatures(values, offsets, trees, labels))]
        return pa.StructArray.from_arrays(columns, ["n", "a", "b", "signature"])

    return sign


def _shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels that rows of x and y share from the start."""
    same = (x == y).reshape(len(x), x.shape[1] // WIDTH, WIDTH).all(axis=2)
    return np.where(same.all(axis=1), same.shape[1], same.argmin(axis=1)).astype(np.int32)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tree, label string, rep) of sorted tries with ``deep``: the longest prefix that a neighbour in the order shares.

    What the neighbour beyond the partition shares is not known: the first and last row of a partition count as sharing all.
    """
    held = None

    def out(batch: pa.RecordBatch, before: np.ndarray | None, after: np.ndarray | None) -> pa.RecordBatch:
        tree, own = np.asarray(batch.column("tree")), _bytes(batch.column("labels"))
        most = own.shape[1] // WIDTH
        link = np.where(tree[1:] == tree[:-1], _shared(own[1:], own[:-1]), 0)
        left = np.append(most if before is None else (_shared(before[None, 1:].view(np.uint8), own[:1])[0] if before[0] == tree[0] else 0), link)
        right = np.append(link, most if after is None else (_shared(own[-1:], after[None, 1:].view(np.uint8))[0] if after[0] == tree[-1] else 0))
        return pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("labels"), batch.column("rep"), pa.array(np.maximum(left, right).astype(np.int32))], names=["tree", "labels", "rep", "deep"])

    def edge(batch: pa.RecordBatch, k: int) -> np.ndarray:
        return np.append(np.uint8(batch.column("tree")[k].as_py()), _bytes(batch.column("labels"))[k])

    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            yield out(held, before, edge(batch, 0))
            before = edge(held, held.num_rows - 1)
        held = batch
    if held is not None:
        yield out(held, before, None)


def _shingles(words: int):
    @F.arrow_udf("array<bigint>")
    def shingles(text: pa.Array) -> pa.Array:
        values, offsets = shingle_sets(text.to_pylist(), words)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)))

    return shingles


def overlaps(left: list[np.ndarray], right: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """Sizes of the intersections of every left set with every right set, by products of 0/1 matrices over the values both sides have."""
    x, y = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(x, y)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(shared):
        return out
    xr, yr = np.repeat(np.arange(len(left)), list(map(len, left))), np.repeat(np.arange(len(right)), list(map(len, right)))
    xi, yi = np.searchsorted(shared, x), np.searchsorted(shared, y)
    xk, yk = shared[np.minimum(xi, len(shared) - 1)] == x, shared[np.minimum(yi, len(shared) - 1)] == y
    xr, xi, yr, yi = xr[xk], xi[xk], yr[yk], yi[yk]
    for a in range(0, len(shared), step):
        width = min(step, len(shared) - a)
        m, n = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        k = (xi >= a) & (xi < a + width)
        m[xr[k], xi[k] - a] = 1
        k = (yi >= a) & (yi < a + width)
        n[yr[k], yi[k] - a] = 1
        out += m @ n.T
    return out


def _keys(signature: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """(sets, trees) values that agree where the first depth labels do."""
    labels = np.ascontiguousarray(signature).view(">u2").reshape(len(signature), trees, -1)[:, :, :depth].astype(np.uint64)
    key = np.full(labels.shape[:2], depth, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(depth):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + labels[:, :, k] + np.uint64(1))
    return key


def _verify(threshold: float, trees: int, depth: int, before: int | None):
    """Links among the sets of two blocks of a node at this depth, unless they met at the depth before, or meet in an earlier tree."""

    def work(rows: pa.Table) -> list[pa.RecordBatch]:
        tree, i, j = (rows.column(k)[0].as_py() for k in ("tree", "i", "j"))
        ids, weight, side = (np.asarray(rows.column(k).combine_chunks()) for k in ("rep", "weight", "side"))
        p = np.flatnonzero(side == 0)
        q = p if i == j else np.flatnonzero(side == 1)
        if not len(p) or not len(q) or i == j and len(p) < 2:
            return []
        signature = _bytes(rows.column("signature"))
        cluster = np.asarray(rows.column("cluster").combine_chunks())  # -1: none
        open_pairs = (cluster[p][:, None] != cluster[q][None]) | (cluster[p][:, None] < 0)
        keys = _keys(signature, trees, depth)
        for t in range(tree):
            open_pairs &= keys[p, t][:, None] != keys[q, t][None]
        if before is not None:
            keys = _keys(signature, trees, before)
            for t in range(trees):
                open_pairs &= keys[p, t][:, None] != keys[q, t][None]
        if i == j:
            open_pairs = np.triu(open_pairs, 1)
        r, c = np.flatnonzero(open_pairs.any(axis=1)), np.flatnonzero(open_pairs.any(axis=0))
        if not len(r):
            return []
        p, q, open_pairs = p[r], q[c], open_pairs[np.ix_(r, c)]
        values, at = lists(rows, "shingles")
        common = overlaps([values[at[k] : at[k + 1]] for k in p], [values[at[k] : at[k + 1]] for k in q])
        n = np.diff(at)
        either = n[p][:, None] + n[q][None] - common
        a, b = np.nonzero(open_pairs & (common >= threshold * either - 1e-6))
        if not len(a):
            return []
        bins = np.minimum(common[a, b] / either[a, b] * BINS, BINS - 1).astype(np.int64)
        a, b = p[a], q[b]
        links = np.bincount(a, weight[b], len(ids)) + np.bincount(b, weight[a], len(ids))
        node, root = forest(ids[a], ids[b])
        hit = np.flatnonzero(links)
        seen, many = np.unique(bins, return_counts=True)
        # three kinds of rows: links of a set, an edge to the smallest set of its group, links of a similarity bin
        columns = [np.concatenate([ids[hit], node, seen]), np.concatenate([links[hit], np.zeros(len(node)), many]).astype(np.int64), np.concatenate([ids[hit], root, seen])]
        kind = np.repeat(np.array([0, 1, 2], np.int32), [len(hit), len(node), len(seen)])
        return [pa.RecordBatch.from_arrays([pa.array(kind), *map(pa.array, columns)], names=["kind", "rep", "links", "root"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from grouped(batches, ["tree", "prefix", "i", "j"], work)

    return run


def clusters_of(nodes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``rep, cluster, weight``: sets of nodes (tree, prefix, rep) of more than BLOCK members that are within half the threshold's distance of a centre.

    The centre of a node is its smallest set; a set of several such nodes takes the smallest of their centres. Centres are dealt
    out with a salt, so that no task meets all sets of one.
    """
    large = nodes.groupBy("tree", "prefix").agg(F.count("*").alias("members"), F.min("rep").alias("centre")).where(F.col("members") > BLOCK)
    own = nodes.join(large, ["tree", "prefix"]).groupBy("rep").agg(F.min(F.struct("centre", "members")).alias("c")).select("rep", "c.centre", F.ceil(F.col("c.members") / BLOCK).cast("int").alias("salts"))
    own = write_table(own, "centres")
    centre = own.groupBy("centre").agg(F.max("salts").alias("salts")).join(sets.select(F.col("rep").alias("centre"), F.col("shingles").alias("of_centre")), "centre")
    centre = centre.select("centre", "of_centre", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    most = own.groupBy("centre").agg(F.max("salts").alias("all_salts"))
    members = own.join(most, "centre").join(sets.select("rep", "weight", "shingles"), "rep").withColumn("salt", F.pmod(F.xxhash64("rep", F.lit(29)), F.col("all_salts").cast("long")).cast("int"))
    pairs = members.drop("salts", "all_salts").join(centre, ["centre", "salt"])
    common = F.size(F.array_intersect("shingles", "of_centre"))
    near = common >= (1 - (1 - threshold) / 2) * (F.size("shingles") + F.size("of_centre") - common) + 1e-9
    found = write_table(pairs.where(near).select("rep", F.col("centre").alias("cluster"), "weight"), "clusters")
    several = found.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1").select("cluster")
    drop_table(own)
    return write_table(found.join(several, "cluster", "left_semi").select("rep", "cluster", "weight"), "clusters")


def ngram_join(df: DataFrame, threshold: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text", trees: int = TREES, labels: int = LABELS, recall: float = RECALL) -> DataFrame:
    """``doc_id, n_links, component_id, kept`` for every row of df.

    n_links counts the other rows whose shingle sets have a Jaccard similarity of at least threshold (equal sets included),
    component_id is the smallest id reachable by links, and the row with that id is kept. Null, empty and blank texts have no
    shingles and link with nothing; texts of any length count whole. Of rows that share an id the one with the most shingles stands in
    the join for the id; the others link with nothing unless they equal a class. Null ids link with nothing and are kept. An empty
    table gives an empty result; other columns are not read. Every link is verified; recall is the estimated share that is found.
    """
    spark = df.sparkSession
    depths = depths_for(threshold, trees, labels, recall)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = write_table(docs.select("id", _sign(trees, labels, words)("text").alias("s")).select("id", "s.*"), "signed")
    usable = signed.where("n > 0 AND id IS NOT NULL")
    # equal sets are one class, whatever their number
    one = usable.groupBy("id").agg(F.max(F.struct("n", "a", "b", "signature")).alias("s")).select("id", "s.*")
    classes = write_table(one.groupBy("n", "a", "b", "signature").agg(F.min("id").alias("rep"), F.count("*").alias("weight")), "classes")
    length = labels * WIDTH
    parts = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.substring(F.col("signature"), t * length + 1, F.lit(length)))
    entries = classes.select(F.posexplode(parts).alias("tree", "labels"), "rep")
    tries = entries.repartitionByRange(partitions(spark), "tree", "labels", "rep").sortWithinPartitions("tree", "labels", "rep")
    live = write_table(tries.mapInArrow(_neighbours, "tree int, labels binary, rep long, deep int").where(F.col("deep") >= depths[-1]), "tries")
    # not deterministic, so to say, lest the test of its size drag it below the join, to every text
    wanted = live.select("rep").distinct().join(classes.select("rep", "weight", "n", "signature"), "rep")
    sets = docs.join(wanted, docs["id"] == wanted["rep"]).select("rep", "weight", "signature", "n", _shingles(words).asNondeterministic()("text").alias("shingles"))
    sets = write_table(sets.where(F.size("shingles") == F.col("n")).drop("n"), "sets")
    spread = F.xxhash64("rep")

    def nodes_of(depth: int) -> DataFrame:
        return live.where(F.col("deep") >= depth).select("tree", F.substring("labels", 1, depth * WIDTH).alias("prefix"), "rep")

    clusters = clusters_of(nodes_of(depths[0]), sets, threshold)
    inside = clusters.join(clusters.groupBy("cluster").agg(F.sum("weight").alias("all")), "cluster")
    found = inside.select(F.lit(0).alias("kind"), "rep", (F.col("all") - F.col("weight")).alias("links"), F.col("rep").alias("root"))
    found = write_table(found.union(inside.where("rep <> cluster").select(F.lit(1), "rep", F.lit(0).cast("long"), "cluster")), "links")
    bare, sets = sets, write_table(sets.join(clusters.select("rep", "cluster"), "rep", "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1))), "sets")
    drop_table(bare)
    handled, before, similar = None, None, np.zeros(BINS)
    for depth in depths:
        nodes = nodes_of(depth)
        full = nodes.groupBy("tree", "prefix").agg(F.count("*").alias("members"), F.sum(spread % (1 << 40)).alias("x"), F.bit_xor(spread).alias("y")).where("members > 1")
        # a node with the same members as one of an earlier tree, or of a longer prefix, has nothing to add
        full = full.groupBy("members", "x", "y").agg(F.min(F.struct("tree", "prefix")).alias("k"))
        full = write_table(full if handled is None else full.join(handled, ["members", "x", "y"], "left_anti"), "nodes")
        handled = full.select("members", "x", "y") if handled is None else handled.union(full.select("members", "x", "y"))
        # one block where all members fit; else those of the cluster that has most of them apart from the others
        small = full.where(F.col("members") <= BLOCK).select("k.tree", "k.prefix", F.lit(-2).cast("long").alias("home"), F.lit(1).alias("others"), F.lit(0).alias("homes"))
        large = full.where(F.col("members") > BLOCK).select("members", "k.tree", "k.prefix")
        most = nodes.join(clusters.select("rep", "cluster"), "rep").groupBy("tree", "prefix", "cluster").agg(F.count("*").alias("n")).groupBy("tree", "prefix").agg(F.max(F.struct("n", "cluster")).alias("home"))
        at_home = F.coalesce("home.n", F.lit(0))
        large = large.join(most, ["tree", "prefix"], "left").select("tree", "prefix", F.coalesce("home.cluster", F.lit(-2)).alias("home"), F.ceil((F.col("members") - at_home) / BLOCK).cast("int").alias("others"), F.ceil(at_home / BLOCK).cast("int").alias("homes"))
        sized = small.unionByName(large).where("others > 0")
        visits = nodes.join(sized, ["tree", "prefix"]).groupBy("rep").agg(F.collect_list(F.struct("tree", "prefix", "home", "others", "homes")).alias("visits"))
        columns = ["rep", "weight", "cluster", "signature", "shingles"]
        dealt = sets.join(visits, "rep").select(*columns, F.explode("visits").alias("v")).select(*columns, "v.*")
        pairs = F.explode(sided_pairs(F.col("rep"), F.col("cluster") == F.col("home"), F.col("others"), F.col("homes"))).alias("p")
        dealt = dealt.select(*columns, "tree", "prefix", pairs).select(*columns, "tree", "prefix", "p.*")
        keyed = dealt.repartition(partitions(spark), "tree", "prefix", "i", "j").sortWithinPartitions("tree", "prefix", "i", "j", "side", "rep")
        new = write_table(keyed.mapInArrow(_verify(threshold, trees, depth, before), "kind int, rep long, links long, root long"), "links")
        for r in new.where("kind = 2").groupBy("rep").agg(F.sum("links").alias("links")).collect():
            similar[r["rep"]] += r["links"]
        found = found.union(new)
        before = depth
        if estimated_recall(similar, depth, trees) >= recall:
            break
    drop_table(sets)
    drop_table(live)
    links = found.where("kind = 0").groupBy("rep").agg(F.sum("links").alias("far"))
    parts = connected_components(found.where("kind = 1").select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    per_class = classes.select("n", "a", "b", "rep", "weight").join(links, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    per_class = per_class.select(F.col("n").alias("cn"), F.col("a").alias("ca"), F.col("b").alias("cb"), (F.col("weight") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("id", "n", "a", "b").join(per_class, (F.col("n") == F.col("cn")) & (F.col("a") == F.col("ca")) & (F.col("b") == F.col("cb")), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias("doc_id"), F.when(F.col("id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
