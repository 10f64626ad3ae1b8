"""MinHash near-duplicates: tensored banding finds candidate pairs, full shingle sets confirm them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators.graph import connected_components

from .shared import carried, emptied, fits, mixed, rolling, slices, strings, uncarried, word_hashes, written

#: Words of a shingle.
SHINGLE = 5
#: Each of two collections holds so many half keys of so many minimum hashes. A table's key is a pair of half
#: keys, one of each collection: 144 tables of 6 hashes each come from 72 minimum hashes in place of 864. A pair of
#: similarity s meets in a table with probability (1 - (1 - s**3)**12)**2, which is 0.99998 at 0.85.
HALF_KEYS, HALF_ROWS = 12, 3

#: Odd multipliers of the minimum hashes.
MULTIPLIERS = mixed(np.arange(1, 2 * HALF_KEYS * HALF_ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_set(text: str) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles of lower-cased (A-Z) words; a shorter text is one shingle."""
    words = text.encode().lower().split()
    k = min(SHINGLE, len(words))
    if not k:
        return np.empty(0, dtype=np.uint64)
    return np.unique(mixed(rolling(word_hashes(words), k, 0x5851F42D4C957F2D + 2 * k)))


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """Minimum of each multiplicative hash over the set."""
    out = np.full(len(MULTIPLIERS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 4096):
        np.minimum(out, (MULTIPLIERS[:, None] * shingles[None, at:at + 4096]).min(axis=1), out=out)
    return out


def half_keys(signature: np.ndarray) -> tuple[list[int], list[int]]:
    """The two collections of half keys, 64 bits each."""
    rows = signature.reshape(2, HALF_KEYS, HALF_ROWS)
    keys = np.arange(2 * HALF_KEYS, dtype=np.uint64).reshape(2, HALF_KEYS) + np.uint64(1)
    for i in range(HALF_ROWS):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) ^ rows[:, :, i])
    signed = keys.view(np.int64)
    return signed[0].tolist(), signed[1].tolist()


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n (size of the shingle set), whole (128-bit hash of the set) and the half keys of each row."""
    def rows(batches):
        emptied()
        for batch in batches:
            for b in slices(batch):
                n, whole, first, second = [], [], [], []
                for text in strings(b.column(1)):
                    s = shingle_set(text)
                    x, y = half_keys(min_hashes(s)) if len(s) else (None, None)
                    n.append(len(s))
                    whole.append(xxhash.xxh3_128_digest(s.tobytes()))
                    first.append(x)
                    second.append(y)
                keys = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(whole, pa.binary()), pa.array(first, keys), pa.array(second, keys)], names=["doc_id", "n", "whole", "first", "second"])

    return docs.mapInArrow(rows, "doc_id bigint, n bigint, whole binary, first array<bigint>, second array<bigint>")


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", with_set: bool = False) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (smallest doc_id reachable by links, its own
    included) and kept (doc_id = component_id). Linked are documents whose sets of distinct five-word shingles
    have 100 * intersection >= ``percent`` * union.

    1. Documents with equal sets become one node, before anything else: a group of copies is one row.
    2. Half keys that only one node has go first, so texts without any relative make no table keys. The others
       make pairs of half keys. Nodes under one key are candidates of each other.
    3. Nodes that cannot reach the similarity, as too few of their shingles are in any other set, drop out.
    4. Links come in rounds. In each, every node is compared on full sets with one node of each of its keys (in
       the first, with one only), unless they are in one component already, and links are merged to
       components. A group of near copies soon is one component, without its pairs. When few pairs are left (or
       a round no longer helps), the nodes outside of each cluster's largest component are compared with all
       of it, in blocks of which only links come out. So no candidate link that matters to components is left out, and there is no limit to a group's size.

    A null or empty text, or one without words, has an empty set and is linked with nothing. Rows with equal
    ids are documents of their own. A row with a null id is linked by an equal set only, never is a component's
    smallest, and is kept if its component has no id. Other columns are not used. An empty table gives no rows.
    ``with_set`` adds ``whole``, a 128-bit hash of the row's set, which tells rows of one id apart.
    """
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    marks = written(sketches(own), "sketches")
    nodes = marks.where("n > 0").groupBy("whole", "n").agg(F.min("doc_id").alias("least"), F.any_value("first").alias("first"), F.any_value("second").alias("second"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = written(bucket_members(nodes), "members")
    labels = linked(own, nodes, members, percent)
    of_node = nodes.select("whole", "node", "least").join(labels, "node", "left").select("whole", "least", F.coalesce("component", "node").alias("component"))
    smallest = of_node.groupBy("component").agg(F.min("least").alias("component_id"))
    of_set = of_node.join(smallest, "component").select("whole", "component_id")
    own_set = ["whole"] if with_set else []
    out = marks.where("n > 0").join(of_set, "whole").select("doc_id", F.col("n").alias("n_shingles"), "component_id", *own_set)
    out = out.unionAll(marks.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), *own_set))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "n_shingles", "component_id", "kept", *own_set)


def without_near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, with the columns it has, and one row of each group of documents that links connect (``near_duplicates``, from
    ``percent`` on): one of the smallest id.

    Rows are judged, not ids: of equal or linked rows of one id one stays (by the hashes of set and row), and rows of
    one id whose texts are not linked are documents of their own. Rows without words, and rows with a null id, are linked with
    nothing here and all stay. An empty table gives no rows. Only rows of ids that stand several times are moved to
    be told apart, by the hash of their sets; all others are kept or dropped by their id.
    """
    judged = written(near_duplicates(docs, percent, id_col, text_col, with_set=True).where("doc_id IS NOT NULL"), "judged")
    by_id = judged.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max("kept").alias("kept"))
    moved = written(by_id.where("rows > 1 OR NOT kept").select("doc_id", (F.col("rows") > 1).alias("several")), "moved")
    gone, several = moved.select("doc_id"), moved.where("several").select("doc_id")
    key = F.col(f"`{id_col}`").cast("bigint")
    rest = docs.withColumn("_doc", key).join(fits(gone, 8).withColumnRenamed("doc_id", "_doc"), "_doc", "left_anti").select(*[f"`{c}`" for c in docs.columns])

    # Rows of an id that stands several times: those that are kept, then one for each id of those with words.
    own = docs.select(key.alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *carried(docs, id_col, text_col, True)).join(fits(several, 8), "doc_id")

    names = [*own.columns, "whole"]

    def rows(batches):
        emptied()
        for batch in batches:
            for b in slices(batch):
                whole = [xxhash.xxh3_128_digest(shingle_set(t).tobytes()) for t in strings(b.column(1))]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(whole, pa.binary())], names=names)

    told = own.mapInArrow(rows, T.StructType([*own.schema.fields, T.StructField("whole", T.BinaryType())]))
    verdict = judged.join(fits(several, 8), "doc_id").where("kept").groupBy("doc_id", "whole").agg(F.max("n_shingles").alias("n_shingles"))
    told = written(told.join(verdict, ["doc_id", "whole"]), "several")
    one = told.where("n_shingles > 0").groupBy("doc_id").agg(F.min_by(F.struct("text", "row"), F.struct("whole", F.xxhash64("text", "row"))).alias("r")).select("r.*")
    back = one.unionByName(told.where("n_shingles = 0").select("text", "row"))
    return rest.unionByName(uncarried(back, docs.columns, text_col))


def bucket_members(nodes: DataFrame) -> DataFrame:
    """(key, node, n, i, j) for every table key, of half keys i and j, that at least two nodes have."""
    halves = nodes.select("node", "n", "second", F.posexplode("first").alias("i", "half"))
    shared = halves.groupBy("i", "half").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("i", "half")
    pairs = halves.join(shared, ["i", "half"]).select("node", "n", "i", "half", F.posexplode("second").alias("j", "other"))
    keyed = pairs.select(F.xxhash64("i", "half", "j", "other").alias("key"), "node", "n", F.col("i").cast("tinyint").alias("i"), F.col("j").cast("tinyint").alias("j"))
    common = keyed.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x != y").select("key")
    return keyed.join(common, "key")


def linked(docs: DataFrame, nodes: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(node, component) of all nodes that have a link."""
    spark = docs.sparkSession
    sets = full_sets(docs, nodes, members)
    open_ = written(possible(members, sets, percent), "possible")
    done = spark.createDataFrame([], "a bigint, b bigint")
    labels, left, turn = spark.createDataFrame([], "node bigint, component bigint"), None, 0
    while True:
        placed = open_.drop("component").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        final = False
        if turn:
            # Only keys whose nodes are not of one component yet, each row with its part of the key's pairs and of the key.
            in_key = placed.groupBy("key", "component").agg(F.count(F.lit(1)).cast("double").alias("c")).groupBy("key").agg(F.sum("c").alias("rows"), ((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("p"))
            placed = written(placed.join(in_key.where("p > 0").select("key", (F.col("p") / F.col("rows")).alias("p"), (1 / F.col("rows")).alias("k")), "key"), "open")
            before, left = left, placed.agg(F.coalesce(F.sum("p"), F.lit(0.0)).alias("p"), F.sum("k").alias("keys")).first()
            open_ = placed = placed.drop("p", "k")
            if not left["p"]:
                return labels
            final = left["p"] <= 4 * left["keys"] or (before is not None and left["p"] > 0.7 * before["p"])
        if final:
            return merged(labels, written(rest_linked(placed, sets, percent), "links"))
        star = placed.groupBy("key").agg(F.min_by(F.struct("node", "n", "c", "component"), F.col("node") if not turn else F.xxhash64("node", F.lit(turn))).alias("a"))
        both = placed.select("key", F.struct("node", "n", "c", "component").alias("b")).join(star, "key").where((F.col("a.component") != F.col("b.component")) & within(percent))
        pairs = both.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()
        if not turn:
            pairs = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        fresh = written(compared(pairs.join(done, ["a", "b"], "left_anti"), sets, percent), "compared")
        done = done.unionAll(fresh.select("a", "b"))
        labels = merged(labels, fresh.where("similar").select("a", "b"))
        turn += 1


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, component) after further links. Only the components that the links connect go through the rounds of
    ``connected_components``, a node each; all others stay as they are."""
    of = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    ends = written(links.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("of_a", "a").alias("of_a"), F.coalesce("of_b", "b").alias("of_b")), "ends")
    edges = ends.select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    moved = connected_components(edges).select(F.col("node").alias("component"), F.col("component").alias("least"))
    every = labels.unionAll(ends.select("a", "of_a")).unionAll(ends.select("b", "of_b")).distinct()
    return written(every.join(moved, "component", "left").select("node", F.coalesce("least", "component").alias("component")), "labels")


#: Nodes of one side that one task compares with nodes of the other.
QUERY_BLOCK, TARGET_BLOCK = 512, 4096


def rest_linked(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): all links between nodes of different components, of what the rounds have left.

    Nodes that keys connect make a cluster (small ones share a bin). In each, all nodes but those of its largest
    component are compared with all its nodes, block against block, on full sets; only links leave a task.
    """
    star = placed.groupBy("key").agg(F.min("node").alias("a"))
    edges = placed.select("key", F.col("node").alias("b")).join(star, "key").select("a", "b")
    cluster = connected_components(edges).withColumnRenamed("component", "cluster")
    nodes = written(placed.select("node", "n", "c", "component").distinct().join(cluster, "node"), "rest")
    size = nodes.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    bins = max(1, nodes.count() // QUERY_BLOCK)
    nodes = nodes.join(size, "cluster").withColumn("bin", F.when(F.col("size") > QUERY_BLOCK, F.col("cluster")).otherwise(-1 - F.pmod(F.xxhash64("cluster"), F.lit(bins))))
    parts = nodes.groupBy("bin", "component").agg(F.count(F.lit(1)).alias("k")).groupBy("bin").agg(F.max_by("component", F.struct("k", "component")).alias("largest"), F.sum("k").alias("all"), F.max("k").alias("most"))
    parts = parts.select("bin", "largest", F.ceil((F.col("all") - F.col("most")) / QUERY_BLOCK).cast("int").alias("qs"), F.ceil(F.col("all") / TARGET_BLOCK).cast("int").alias("ts")).where("qs > 0")
    nodes = nodes.join(parts, "bin").join(sets, "node")
    row = ["bin", "q", "t", "node", "n", "c", "component", "shingles"]
    block = lambda count, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(count)).cast("int")
    all_of = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    queries = nodes.where("component != largest").withColumn("q", block("qs", 1)).withColumn("t", all_of("ts")).select(row)
    targets = nodes.withColumn("t", block("ts", 2)).withColumn("q", all_of("qs")).select(row).toDF(*[f"{c}_" for c in row]).toDF(*row)
    keys = ["bin", "q", "t"]

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        out = ([], [])
        if x.num_rows and y.num_rows:
            (u, n_u, c_u, k_u), (v, n_v, c_v, k_v) = ([t[c].to_numpy() for c in ("node", "n", "c", "component")] for t in (x, y))
            flat, owner = x["shingles"].combine_chunks().flatten().to_numpy(), np.repeat(np.arange(len(u)), n_u)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            for i, shingles in enumerate(y["shingles"]):
                most = np.minimum(c_u, c_v[i])
                if ((k_u != k_v[i]) & (most * 100 >= (n_u + n_v[i] - most) * percent)).any():
                    own = shingles.values.to_numpy()
                    lo, hi = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
                    # Places lo..hi of each of the target's shingles, by the ups and downs at their ends.
                    steps = np.bincount(lo, minlength=len(flat) + 1) - np.bincount(hi, minlength=len(flat) + 1)
                    both = np.bincount(owner, weights=np.cumsum(steps[:-1]), minlength=len(u)).astype(np.int64)
                    hit = np.flatnonzero((k_u != k_v[i]) & (both * 100 >= (n_u + n_v[i] - both) * percent))
                    out[0].append(np.minimum(u[hit], v[i]))
                    out[1].append(np.maximum(u[hit], v[i]))
        return pa.table({name: np.concatenate([np.empty(0, np.int64), *o]).astype(np.int64) for name, o in zip("ab", out)})

    return queries.groupBy(keys).cogroup(targets.groupBy(keys)).applyInArrow(compare, "a bigint, b bigint")


def within(percent: int) -> Column:
    """Whether the sizes of ``a`` and ``b``, and how many of their shingles other sets have, leave room for a link."""
    most = F.least("a.c", "b.c", "a.n", "b.n")
    return most * 100 >= (F.col("a.n") + F.col("b.n") - most) * percent


def possible(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``members`` (with c) without nodes that sizes alone show to have no link, and without keys left to one node.

    A set of n shingles, c of which other sets have too, meets another of m shingles in at most c of them, so
    their similarity is at most c / (n + m - c), for the smallest m under its keys. That takes out the strays
    of a group of near copies (each has shingles of its own) and texts that share a passage only.
    """
    least = members.groupBy("key").agg(F.min("n").alias("m"))
    sizes = members.join(least, "key").groupBy("node").agg(F.max("n").alias("n"), F.min("m").alias("m"))
    bound = F.greatest("m", "c", F.ceil(F.col("n") * percent / 100))
    kept = sizes.join(shared_shingles(sets), "node").where(F.col("c") * 100 >= (F.col("n") + bound - F.col("c")) * percent)
    left = members.join(kept.select("node", "c"), "node")
    common = left.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x != y").select("key")
    return left.join(common, "key").select("key", "node", "n", "c", "i", "j")


#: Shingles that one task groups at once, and after which a task hands on what it gathered (or those of one long text).
SHARD_SHINGLES, SHINGLES_AT_ONCE = 2_000_000, 500_000


def shared_shingles(sets: DataFrame) -> DataFrame:
    """(node, c): how many of a set's shingles are in another set too.

    A part of a task knows that of shingles which it has twice; it sends on one mark for each of those, and its
    other shingles, to the shard of their hash. So a shingle that very many sets have is one row a part.
    """
    total = sets.agg(F.sum(F.size("shingles")).alias("n")).first()["n"] or 0
    shards = np.uint64(max(1, -(-total // SHARD_SHINGLES)))

    def sent(nodes, hashes):
        found, back, times = np.unique(hashes, return_inverse=True, return_counts=True)
        twice = times[back] > 1
        own, c = np.unique(nodes[twice], return_counts=True)
        none = pa.nulls(len(own), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.nulls(len(own), pa.int64()), pa.array(own), pa.array(c), none, none], names=SHARED)
        hashes = np.concatenate([hashes[~twice], found[times > 1]])
        nodes = np.concatenate([nodes[~twice], np.full((times > 1).sum(), -1, dtype=np.int64)])
        shard = (hashes % shards).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        at = np.flatnonzero(np.diff(shard[order], prepend=-1, append=int(shards)))
        parts = [order[i:j] for i, j in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([pa.array([int(shard[p[0]]) for p in parts], pa.int64()), pa.nulls(len(parts), pa.int64()), pa.nulls(len(parts), pa.int64()),
                                          pa.array([nodes[p].tobytes() for p in parts], pa.binary()), pa.array([hashes[p].tobytes() for p in parts], pa.binary())], names=SHARED)

    def parts_(batches):
        emptied()
        held, n = [], 0
        for b in batches:
            for node, own in zip(b.column(0).to_pylist(), b.column(1)):
                held.append((node, own.values.to_numpy().view(np.uint64)))
                n += len(held[-1][1])
                if n >= SHINGLES_AT_ONCE:
                    yield from sent(np.repeat([k for k, _ in held], [len(v) for _, v in held]), np.concatenate([v for _, v in held]))
                    held, n = [], 0
        if n:
            yield from sent(np.repeat([k for k, _ in held], [len(v) for _, v in held]), np.concatenate([v for _, v in held]))

    def group(table: pa.Table) -> pa.Table:
        nodes, hashes = (np.concatenate([np.frombuffer(x.as_buffer(), dtype=kind) for x in table[name]]) for name, kind in (("nodes", np.int64), ("hashes", np.uint64)))
        order = np.argsort(hashes, kind="stable")
        same = hashes[order][1:] == hashes[order][:-1]
        also = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        own, c = np.unique(nodes[order][also], return_counts=True)
        return pa.table({"node": own[own >= 0], "c": c[own >= 0]})

    sent = sets.select("node", "shingles").mapInArrow(parts_, "shard bigint, node bigint, c bigint, nodes binary, hashes binary")
    sent = written(sent, "shingles")
    of_shards = sent.where("shard IS NOT NULL").select("shard", "nodes", "hashes").groupBy("shard").applyInArrow(group, "node bigint, c bigint")
    return sent.where("shard IS NULL").select("node", "c").unionAll(of_shards).groupBy("node").agg(F.sum("c").alias("c"))


SHARED = ["shard", "node", "c", "nodes", "hashes"]


def full_sets(docs: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes that have candidates, from whole texts again."""
    def rows(batches):
        emptied()
        for batch in batches:
            for b in slices(batch):
                sets = [shingle_set(t) for t in strings(b.column(1))]
                whole = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), whole, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "whole", "shingles"])

    wanted = written(nodes.join(members.select("node").distinct(), "node").select("node", "least", "whole"), "wanted")
    texts = docs.join(fits(wanted.select(F.col("least").alias("doc_id"), "node"), 24), "doc_id").select("node", "text")
    # Another row of the same id may have another text: the set's hash says which one is meant.
    sets = texts.mapInArrow(rows, "node bigint, whole binary, shingles array<bigint>")
    return written(sets.join(fits(wanted.select("node", "whole"), 40), ["node", "whole"]).groupBy("node").agg(F.any_value("shingles").alias("shingles")), "sets")


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``similar`` of each pair (a, b), from the full sets; a is the node that many pairs share."""
    x, y = sets.select(F.col("node").alias("a"), F.col("shingles").alias("s")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("t"))
    both = F.size(F.array_intersect("s", "t"))
    return pairs.join(y, "b").join(x, "a").select("a", "b", (both * 100 >= (F.size("s") + F.size("t") - both) * percent).alias("similar"))
