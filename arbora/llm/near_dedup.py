"""MinHash near-duplicate detection by a signature-coordinate inverted join.

Every text becomes a set of hashed 5-word shingles and a signature of 64
minima. Texts with the same set are one node. A node is posted under its
coordinate-value pairs; pairs that no other node has cannot collide, so a node
with fewer than ``MATCHES`` shared pairs is out, and of the rest only the
``shared - MATCHES + 1`` rarest (the prefix) are posted, since two nodes that
agree on ``MATCHES`` coordinates must meet in their prefixes. Posting lists with
the same most central node (the hub) form one cluster. A cluster of more than
one block is first joined with its hub: nodes that the full sets link with the
hub are in one component already and needn't meet each other. What the hub
doesn't reach (the rest) meets itself and the others in cells of two blocks, so
that no task holds a cluster whole. A cluster of more than CELL_BLOCKS blocks of
which some are out of the hub's reach is clustered anew, by its rarest shingles:
texts that share a passage, but are no near copies, fall out there at a cost in
proportion to their shingles, and what is left has hubs nearer by.
A cell counts the collisions of its nodes, skips nodes that are joined already,
confirms counts of at least ``MATCHES`` on the full sets and emits a spanning
forest.

Two sets of similarity 0.75 agree on fewer than 32 of 64 coordinates about
once in 100,000 times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .components import components
from .shared import dealt, only, stash
from .shingles import Signer, shingle_set, similar

COORDINATES = 64
MATCHES = 32
WORDS = 5
PERCENT = 75
#: Nodes and shingles of a block; a cell has two blocks at most.
BLOCK_NODES = 512
BLOCK_SHINGLES = 1_000_000
#: Blocks of a cluster up to which all of its blocks meet in cells.
CELL_BLOCKS = 8


#: Bits of the filter that tells most documents that take part from the rest: 16 for each within these bounds, at most 16 MB; more documents only blur it.
FILTER_LEAST, FILTER_MOST = 1 << 20, 1 << 27
_BITMAP_BITS = 32768


def _key(shingles: np.ndarray) -> int:
    """A set's 64-bit hash, by which it is known from here on."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def signatures(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, key (of the set) and signature; key and signature are null for an empty set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(COORDINATES)
        for batch in batches:
            n, keys, signed = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), WORDS)
                n.append(len(s))
                keys.append(_key(s) if len(s) else None)
                signed.append(signer.sign(s).view(np.int32) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(signed, pa.list_(pa.int32()))], ["doc_id", "n_shingles", "key", "signature"])

    rows = dealt(only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return rows.mapInArrow(sign, "doc_id long, n_shingles long, key long, signature array<int>")


def prefix_posts(nodes: DataFrame) -> DataFrame:
    """The posts (token, key, shared) of every node's prefix; nodes has key and signature."""
    tokens = nodes.select("key", F.posexplode("signature").alias("at", "low")).select("key", (F.col("at").cast("long") * F.lit(1 << 32) + F.col("low").cast("long")).alias("token"))
    common = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = tokens.join(common, "token").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("got"))
    kept = shared.where(F.size("got") >= MATCHES).select("key", F.size("got").alias("shared"), F.slice("got", F.lit(1), F.size("got") - F.lit(MATCHES - 1)).alias("got"))
    return kept.select("key", "shared", F.explode("got.token").alias("token"))


def clusters(posts: DataFrame) -> DataFrame:
    """Distinct (hub, key): the nodes of all posting lists that have the same most central node."""
    hubs = posts.groupBy("token").agg(F.min(F.struct((-F.col("shared")).alias("s"), "key")).alias("hub"), F.count("*").alias("n")).where("n > 1")
    return posts.join(hubs.select("token", F.col("hub.key").alias("hub")), "token").select("hub", "key").distinct()


def blocks(members: DataFrame) -> DataFrame:
    """Rows (hub, blocks): the blocks that each cluster (hub, key, n_shingles) fills."""
    return members.groupBy("hub").agg(F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias("blocks"))


def spokes(large: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (hub, key, n_shingles, near): whether the full sets link each node of a large cluster with its hub."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(3), batch.column(4), strict=True)
            near = [similar(np.frombuffer(x.as_py(), dtype=np.uint64), np.frombuffer(y.as_py(), dtype=np.uint64), PERCENT) for x, y in pairs]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(near, pa.bool_())], ["hub", "key", "n_shingles", "near"])

    # written first, so that the join's both sides are shuffled for it and a hot hub can be split
    hubs = stash(large.select("hub").distinct().join(sets.withColumnRenamed("key", "hub"), "hub").select("hub", F.col("shingles").alias("centre")), "hubs")
    rows = large.join(sets.select("key", "shingles"), "key").join(hubs, "hub")
    return rows.select("hub", "key", "n_shingles", "shingles", "centre").mapInArrow(confirm, "hub long, key long, n_shingles long, near boolean")


def cells(met: DataFrame) -> DataFrame:
    """Deal large clusters (hub, key, near, and the blocks r of the rest and l of the others) out as rows (hub, i, j, key, near).

    The rest of a cluster fills the blocks from 0 to r - 1, the nodes near the
    hub those from r on; there is a cell for each two blocks of which one is of
    the rest. The hub is near itself, so every block of the rest has a partner,
    and meets itself there.
    """
    own = F.when(F.col("near"), F.col("r") + F.pmod(F.xxhash64("key"), F.col("l"))).otherwise(F.pmod(F.xxhash64("key"), F.col("r")))
    last = F.when(F.col("near"), F.col("r")).otherwise(F.col("r") + F.col("l")) - 1
    each = met.select("hub", "key", "near", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("other")).where("own <> other")
    return each.select("hub", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "key", "near")


def shingle_posts(wide: DataFrame, sets: DataFrame) -> DataFrame:
    """The posts (token, key, shared) of the nodes of wide clusters (hub, key, near) under their rarest shingles.

    Of two linked sets the smaller shares 6/7 of its shingles and the larger 3/4
    with the other. So a node with fewer shingles that its cluster's rest has too
    is out, and the others meet where a token is in the shorter prefix of one
    and in the longer one of the other. Texts that share a passage, but too
    little of themselves, are all out here, however many they are.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(3)
            flat = [np.frombuffer(x.as_py(), dtype=np.int64) for x in raw]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, flat)]), pa.int32()), pa.array(np.concatenate(flat) if flat else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], ["hub", "key", "near", "all"])

    rows = wide.join(sets.select("key", "shingles"), "key").select("hub", "key", "near", "shingles").mapInArrow(spread, "hub long, key long, near boolean, all array<long>")
    tokens = rows.select("hub", "key", "near", F.size("all").cast("long").alias("n"), F.explode("all").alias("shingle")).withColumn("token", F.xxhash64("hub", "shingle"))
    # only what the rest has counts, since two nodes near the hub needn't meet; written first, so that a hot shingle's join can be split
    common = stash(tokens.groupBy("token").agg(F.count("*").alias("df"), F.max(~F.col("near")).alias("rest")).where("df > 1 AND rest").select("token", "df"), "shingles")
    shared = tokens.join(common, "token").groupBy("hub", "key", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("got"))
    smaller, larger = (f"CAST(size(got) AS BIGINT) - (n * {2 * PERCENT // 25} + {(100 + PERCENT) // 25 - 1}) div {(100 + PERCENT) // 25} + 1", f"CAST(size(got) AS BIGINT) - (n * {PERCENT} + 99) div 100 + 1")
    kept = shared.select("key", F.size("got").alias("shared"), "got", F.expr(smaller).alias("short"), F.expr(larger).alias("long")).where("long > 0")
    posts = stash(kept.select("key", "shared", "short", F.posexplode(F.slice("got", F.lit(1), F.col("long").cast("int"))).alias("at", "x")).select(F.col("x.token").alias("token"), "key", "shared", (F.col("at") < F.col("short")).alias("first")), "posts")
    lists = stash(posts.groupBy("token").agg(F.count("*").alias("n"), F.max("first").alias("first")).where("n > 1 AND first").select("token"), "lists")
    return posts.join(lists, "token", "left_semi").select("token", "key", "shared")


def meetings(members: DataFrame, sets: DataFrame, deeper: bool = True) -> tuple[DataFrame, DataFrame]:
    """The cells' rows (hub, i, j, key, near) of clusters (hub, key, n_shingles), and the links (a, b) of nodes near a hub.

    Clusters of one block are a cell. Of others the nodes near the hub are
    linked first. What is left of a cluster of more than CELL_BLOCKS blocks is
    clustered anew by its rarest shingles, and those clusters are met like the
    first, once.
    """
    filled = stash(blocks(members), "filled")
    zero = F.lit(0).cast("long")
    small = members.join(filled.where("blocks = 1"), "hub", "left_semi").select("hub", zero.alias("i"), zero.alias("j"), "key", F.lit(False).alias("near"))
    large = members.join(filled.where("blocks > 1"), "hub", "left_semi").select("hub", "key", "n_shingles")
    spoken = stash(spokes(large, sets), "spokes")
    links = spoken.where("near").select(F.col("hub").alias("a"), F.col("key").alias("b"))
    size = F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES))
    counted = spoken.groupBy("hub", "near").agg(size.alias("n")).groupBy("hub").agg(F.sum(F.when(~F.col("near"), F.col("n"))).alias("r"), F.sum(F.when(F.col("near"), F.col("n"))).alias("l"))
    # written first, so that the join's both sides are shuffled for it and a hot hub can be split; a cluster without a rest has no cells
    met = spoken.join(stash(counted.where("r > 0"), "blocks"), "hub")
    if not deeper:
        return small.unionAll(cells(met)), links
    rows = small.unionAll(cells(met.where(F.col("r") + F.col("l") <= CELL_BLOCKS)))
    wide = stash(met.where(F.col("r") + F.col("l") > CELL_BLOCKS).select("hub", "key", "n_shingles", "near"), "wide")
    if wide.isEmpty():
        return rows, links
    again = clusters(shingle_posts(wide, sets)).join(wide.select("key", "n_shingles").distinct(), "key")
    more, joined = meetings(stash(again, "clusters"), sets, False)
    return rows.unionByName(more), links.unionAll(joined)


def forest(keys: list[int], sets: list[np.ndarray], signed: np.ndarray, near: np.ndarray, matches: int = MATCHES, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that join the nodes as all confirmed pairs would, if those that are near are joined beforehand: a spanning forest of the rest of the links."""
    n = len(keys)
    order = np.argsort([len(s) for s in sets], kind="stable")
    size = np.array([len(sets[i]) for i in order])
    ids, flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    ends = np.cumsum(size)
    parts = [flat[e - s : e] for s, e in zip(size, ends, strict=True)]
    signed, near, links = signed[order], near[order], []
    root = np.where(near, n, np.arange(n))
    mark = np.zeros(len(ids), dtype=bool)
    # the nodes with the most collisions come first: the more they join, the more is skipped
    collisions = np.zeros(n, dtype=np.int64)
    for c in range(signed.shape[1]):
        _, inverse, count = np.unique(signed[:, c], return_inverse=True, return_counts=True)
        collisions += count[inverse]
    done = np.zeros(n, dtype=bool)
    for a in np.argsort(-collisions, kind="stable"):
        done[a] = True
        open_ = np.nonzero((root != root[a]) & ~done)[0]
        open_ = open_[(100 * np.minimum(size[open_], size[a]) >= percent * np.maximum(size[open_], size[a]))]
        if len(open_):
            open_ = open_[(signed[open_] == signed[a]).sum(axis=1) >= matches]
        if not len(open_):
            continue
        mark[parts[a]] = True
        both = np.array([np.count_nonzero(mark[parts[b]]) for b in open_]) if len(open_) < 64 else np.add.reduceat(mark[np.concatenate([parts[b] for b in open_])].astype(np.int64), np.concatenate(([0], np.cumsum(size[open_])[:-1])))
        mark[parts[a]] = False
        for b in open_[100 * both >= percent * (size[a] + size[open_] - both)]:
            if root[b] != root[a]:
                links.append((keys[order[a]], keys[order[b]]))
                root[root == root[b]] = root[a]
    return links


def _links(rows: DataFrame) -> DataFrame:
    """The forests' links (a, b) of all cells; rows has hub, i, j, key, near, shingles, signature."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, near, sets, signed = None, [], [], [], []

        def close() -> list[tuple[int, int]]:
            return forest(keys, sets, np.stack(signed), np.array(near, dtype=bool)) if len(keys) > 1 else []

        for batch in batches:
            found = []
            for hub, i, j, key, joined, shingles, signature in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (hub, i, j):
                    found += close()
                    at, keys, near, sets, signed = (hub, i, j), [], [], [], []
                keys.append(key)
                near.append(joined)
                sets.append(np.frombuffer(shingles, dtype=np.uint64))
                signed.append(np.frombuffer(signature, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])
        found = close()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return rows.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j").select("hub", "i", "j", "key", "near", "shingles", "signature").mapInArrow(walk, "a long, b long")


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, shingles, signature) from the whole texts of the documents in wanted (doc_id), which is stored, and of the few others that a filter lets through."""
    size, most = FILTER_LEAST, min(FILTER_MOST, 16 * wanted.count())
    while size < most:
        size *= 2
    place = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(F.lit("filter"), "doc_id"), F.lit(size)))
    maps = wanted.select(place.alias("p")).groupBy(F.floor(F.col("p") / _BITMAP_BITS).alias("n")).agg(F.bitmap_construct_agg(F.col("p") % _BITMAP_BITS).alias("bits"))
    bits = np.zeros(size // 8, dtype=np.uint8)
    for n, got in maps.collect():  # size / 8 bytes at most
        bits[n * _BITMAP_BITS // 8 :][: len(got)] = np.frombuffer(bytes(got), dtype=np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, sought = Signer(COORDINATES), shared.value
        for batch in batches:
            keys, sets, signed = [], [], []
            at = batch.column(1).to_numpy()
            here = np.nonzero(sought[at >> 3] >> (at & 7).astype(np.uint8) & 1)[0]
            for text in batch.column(0).take(pa.array(here)):
                s = shingle_set(text.as_py(), WORDS)
                if len(s):
                    keys.append(_key(s))
                    sets.append(s.tobytes())
                    signed.append(signer.sign(s).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.binary()), pa.array(signed, pa.binary())], ["key", "shingles", "signature"])

    rows = dealt(only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return rows.select("text", place.alias("p")).mapInArrow(read, "key long, shingles binary, signature binary")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    Texts are linked where 100 * intersection >= 75 * union of their sets of
    distinct 5-word shingles; component_id is the smallest doc_id of all that
    can be reached. A text of fewer words is one shingle; one without words, or
    null, has n_shingles 0, is linked with nothing and is kept. Repeated rows
    come out as often as they come in. Rows with a null doc_id count as texts;
    in a component of their own they have a null component_id and aren't kept.
    An empty table gives no rows; other columns of docs are ignored. Very long
    texts are read whole. Sets and shingles are known by 64-bit hashes.
    """
    signed, named, least = _grouped(docs)
    classes = stash(named.join(least, "root").select("key", "component_id"), "classes")
    out = signed.select("doc_id", "n_shingles", "key").join(classes, "key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The signatures; (key, doc_id, root) of each set; (root, component_id, first_key) of each component: its smallest doc_id and a set that has it."""
    signed = stash(signatures(docs), "signatures")
    nodes = signed.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"))
    nodes = stash(nodes, "nodes")
    chosen = nodes.select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"))
    first = signed.join(chosen, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key"))).select("key", "signature").dropDuplicates(["key"])
    posts = stash(prefix_posts(first), "posts")
    members = stash(clusters(posts).join(nodes, "key"), "clusters")
    # rows that are repeated, or have no id, can give a set many times; a cell gets it once
    sets = stash(_full_sets(docs, stash(members.select("doc_id").distinct(), "wanted")).groupBy("key").agg(F.first("shingles").alias("shingles"), F.first("signature").alias("signature")), "sets")
    rows, spoken = meetings(members, sets)
    roots = components(_links(rows.join(sets, "key")).unionAll(spoken), "links")
    named = nodes.select("key", "doc_id").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    # both written first, so that the join's both sides are shuffled for it and a hot component can be split
    named = stash(named, "named")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))
    least = named.groupBy("root").agg(first.alias("first")).select("root", F.col("first.doc_id").alias("component_id"), F.col("first.key").alias("first_key"))
    return signed, named, stash(least, "least")


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with the key of each text's set as _key, null for an empty set."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text.as_py(), WORDS) for text in batch.column(0)]
            keys = pa.array([_key(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([keys, *batch.columns[1:]], ["_key", *batch.schema.names[1:]])

    rows = docs.select(F.col("text").cast("string").alias("_text"), *[docs[f"`{c}`"] for c in docs.columns])
    return rows.mapInArrow(read, StructType([StructField("_key", LongType()), *docs.schema.fields]))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of near duplicates, of its smallest doc_id (all of its columns stay), and all rows without words.

    A group whose rows all have a null doc_id keeps one of them. Rows that share
    a doc_id, or have none, are told apart by their sets. Very long texts are
    read whole; columns of any names stay; an empty table stays empty.
    """
    signed, _, least = _grouped(docs)
    odd = stash(signed.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_odd")), "odd")
    kept = least.select(F.col("component_id").alias("_kept")).unionAll(signed.where("n_shingles = 0").select("doc_id")).where("_kept IS NOT NULL").distinct()
    plain = docs.join(kept, docs["doc_id"] == kept["_kept"], "left_semi")
    if odd.isEmpty():
        return plain
    known = docs["doc_id"].cast("long").eqNullSafe(odd["_odd"])
    rows = stash(_keyed(docs.join(odd, known, "left_semi")), "odd-rows")
    chosen = least.select(F.col("component_id").alias("_first"), F.col("first_key").alias("_first_key"))
    firsts = rows.join(chosen, rows["doc_id"].cast("long").eqNullSafe(chosen["_first"]) & (rows["_key"] == chosen["_first_key"]), "left_semi")
    told = firsts.dropDuplicates(["doc_id", "_key"]).unionByName(rows.where("_key IS NULL")).select(*[F.col(f"`{c}`") for c in docs.columns])
    return plain.join(odd, plain["doc_id"].cast("long") == odd["_odd"], "left_anti").unionByName(told)
