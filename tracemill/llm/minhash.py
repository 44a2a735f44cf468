"""MinHash near-dedup: one-permutation hashing, bands, stars of candidates, links confirmed on full sets."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.llm import kernels as K
from tracemill.llm.common import Scratch, fresh, if_few, read_table, row_keyed, without_ids
from tracemill.llm.components import connected_components

BINS = 128  # one-permutation bins: BANDS bands of ROWS bins
BANDS, ROWS = 32, 4
#: Later turns sketch afresh, each with its own permutation: bins and rows of a fine band.
FINE_BINS, FINE_ROWS = 512, 8
#: Permutations of a later turn.
FINE_DRAWS = 2
#: Sets of up to so many shingles also get prefix keys, which miss no pair whose smaller set has 40 shingles.
SMALL = 50
#: Nodes left open are joined exactly: members of a key that are paired one by one, and members and shingles of a block
#: where a key has more.
PAIRED = 16
BLOCK_NODES, BLOCK_SHINGLES = 512, 400_000
#: Edges of one node that meet its set in one task.
HUB_EDGES = 256
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_PROBES = 64


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts in turn, where each text's begin and the end)."""
    data = K.FOLD[data]
    starts, ends, first = K.words(data, offs, K.SPACE_WORDS)
    codes = K.word_hashes(data, starts, ends)
    parts, at = [], [0]
    grams = K.word_grams(codes, size)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            s = np.sort(grams[a : b - size + 1])
            s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            s = K.word_grams(codes[a:b], b - a)
        else:
            s = grams[:0]
        parts.append(s)
        at.append(at[-1] + len(s))
    return (np.concatenate(parts) if parts else grams[:0]), np.array(at)


def signatures(hashes: np.ndarray, at: np.ndarray, bins: int = BINS, turn: int = 0) -> np.ndarray:
    """One-permutation signatures, (texts x bins), with optimal densification.

    A hash's top bits choose its bin and each bin keeps its smallest hash. An empty bin copies a filled one, found by
    probing bins in an order that depends on the bin alone. ``turn`` chooses the permutation.
    """
    if turn:
        hashes = K.mix64(hashes ^ np.uint64((turn * K.MULT) % 2**64))
    n, shift = len(at) - 1, np.uint64(64 - (bins.bit_length() - 1))
    out = np.full((n, bins), EMPTY)
    np.minimum.at(out.ravel(), np.repeat(np.arange(n), np.diff(at)) * bins + (hashes >> shift).astype(np.int64), hashes)
    filled = out != EMPTY
    todo = np.flatnonzero(filled.any(axis=1) & ~filled.all(axis=1))
    original = out.copy()
    places = np.arange(bins, dtype=np.uint64) * np.uint64(1_000_003)
    for t in range(_PROBES + bins):
        if not len(todo):
            break
        if t < _PROBES:
            probe = (K.mix64(places + np.uint64(t + 1)) % np.uint64(bins)).astype(np.int64)
        else:  # very small sets: the next filled bin
            probe = (np.arange(bins) + t - _PROBES + 1) % bins
        near = original[todo][:, probe]
        take = ~filled[todo] & (near != EMPTY)
        rows = out[todo]
        rows[take] = near[take]
        out[todo] = rows
        filled[todo] |= take
        todo = todo[~filled[todo].all(axis=1)]
    return out


def band_keys(sig: np.ndarray, rows: int = ROWS, turn: int = 0) -> np.ndarray:
    """A key for each band of ``rows`` bins."""
    bands = sig.shape[1] // rows
    keys = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(K.MULT) + np.full((len(sig), 1), turn, np.uint64)
    for r in range(rows):
        keys = K.mix64(keys ^ sig[:, r::rows])
    return keys


def prefix_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """The smallest hashes of a sorted set, so many that two sets with the given similarity share one."""
    keep = len(s) - -(-percent * len(s) // 100) + 1
    return K.mix64(s[:keep] ^ np.uint64(0x5851F42D4C957F2D))


def _sketch(size: int, percent: int):
    def run(batches):
        K.begin("shingles")
        for batch in batches:
            for lo, hi, data, offs in K.text_blocks(K.column(batch, "text")):
                hashes, at = shingle_sets(data, offs, size)
                n = np.diff(at)
                bands = band_keys(signatures(hashes, at)).view(np.int64)
                keys = [np.concatenate((b, prefix_keys(hashes[x:y], percent).view(np.int64))) if 0 < y - x <= SMALL else b if y > x else b[:0] for b, x, y in zip(bands, at[:-1], at[1:])]
                sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(K.mix64(hashes ^ np.uint64(c))))) for c in (0, 0xDA942042E4DD58B5)]
                yield pa.RecordBatch.from_arrays([
                    K.column(batch, "doc_id").slice(lo, hi - lo), pa.array(n.astype(np.int64)), *(pa.array((s[at[1:]] - s[at[:-1]]).view(np.int64)) for s in sums),
                    pa.array(keys, pa.list_(pa.int64())),
                ], names=["doc_id", "n", "k1", "k2", "keys"])

    return run


def _fine_keys(turn: int):
    """Keys of fine bands from the sets of shingles."""

    def run(batches):
        for batch in batches:
            data, offs = K.buffers(K.column(batch, "grams"))
            for lo in range(0, batch.num_rows, 256):
                hi = min(lo + 256, batch.num_rows)
                hashes = np.frombuffer(data[offs[lo] : offs[hi]].tobytes(), np.uint64)
                at, draws = (offs[lo : hi + 1] - offs[lo]) // 8, range(turn * FINE_DRAWS, (turn + 1) * FINE_DRAWS)
                keys = np.concatenate([band_keys(signatures(hashes, at, FINE_BINS, d), FINE_ROWS, d) for d in draws], axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(K.column(batch, c).slice(lo, hi - lo) for c in ("node", "n", "part")), pa.array(list(keys), pa.list_(pa.int64()))], names=["node", "n", "part", "keys"])

    return run


def _sets(size: int):
    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in K.text_blocks(K.column(batch, "text")):
                hashes, at = shingle_sets(data, offs, size)
                raw = hashes.tobytes()
                yield pa.RecordBatch.from_arrays([K.column(batch, "node").slice(lo, hi - lo), K.column(batch, "n").slice(lo, hi - lo), pa.array([raw[8 * a : 8 * b] for a, b in zip(at[:-1], at[1:])], pa.binary())], names=["node", "n", "grams"])

    return run


def _confirm(percent: int):
    """Keeps the pairs whose full sets are similar enough; both sets are sorted and distinct."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(K.column(batch, "u_set"), K.column(batch, "v_set")):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate((a, b)))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(a) + len(b) - common) and common > 0)
            yield pa.RecordBatch.from_arrays([K.column(batch, "u"), K.column(batch, "v"), pa.array(keep, pa.bool_())], names=["u", "v", "linked"])

    return run


def _shingle_rows(batches):
    """One row for each shingle of a set."""
    for batch in batches:
        data, offs = K.buffers(K.column(batch, "grams"))
        hashes = np.frombuffer(data[offs[0] : offs[-1]].tobytes(), np.int64)
        repeat = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(offs) // 8))
        yield pa.RecordBatch.from_arrays([*(K.column(batch, c).take(repeat) for c in ("node", "n", "part")), pa.array(hashes)], names=["node", "n", "part", "key"])


def _block_links(percent: int):
    """Links between the two sides of a block, by counting the common shingles of all of them at once."""

    def run(table: pa.Table) -> pa.Table:
        node, n, part, left = (table.column(c).to_numpy() for c in ("node", "n", "part", "left"))
        hashes = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("grams")])
        owner = np.repeat(np.arange(len(node)), n)
        a, b = np.flatnonzero(left), np.flatnonzero(~left)
        row = np.zeros(len(node), np.int64)
        row[a], row[b] = np.arange(len(a)), np.arange(len(b))
        words, at = np.unique(hashes, return_inverse=True)
        side = left[owner]
        both = (np.bincount(at[side], minlength=len(words)) > 0) & (np.bincount(at[~side], minlength=len(words)) > 0)
        place = np.cumsum(both) - 1
        here = both[at]
        place, owner, side = place[at[here]], owner[here], side[here]
        order = np.argsort(place, kind="stable")
        place, owner, side = place[order], owner[order], side[order]
        common = np.zeros((len(a), len(b)), np.float32)
        for lo in range(0, int(both.sum()), 4096):
            x, y = np.searchsorted(place, (lo, lo + 4096))
            width = min(4096, int(both.sum()) - lo)
            ma, mb = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
            w, o, l = place[x:y] - lo, owner[x:y], side[x:y]
            ma[row[o[l]], w[l]] = 1
            mb[row[o[~l]], w[~l]] = 1
            common += ma @ mb.T
        common = common.astype(np.int64)
        i, j = np.nonzero((common > 0) & (100 * common >= percent * (n[a][:, None] + n[b][None, :] - common)) & (part[a][:, None] != part[b][None, :]))
        u, v = node[a[i]], node[b[j]]
        return pa.table({"u": pa.array(np.maximum(u, v)), "v": pa.array(np.minimum(u, v))})

    return run


def _length_classes(members: DataFrame, percent: int) -> DataFrame:
    """Each member (key, n, ...) in the class of its set's size and, as a ``guest``, in the next larger one.

    Sets whose sizes are within the similarity of each other are in one class or in two that follow each other, so of a
    key only members of one class and its guests can be linked.
    """
    own = F.floor(F.ln("n") / F.lit(math.log(100 / percent) + 1e-9)).cast("int")
    at = F.array(F.struct(own.alias("class"), F.lit(False).alias("guest")), F.struct((own + 1).alias("class"), F.lit(True).alias("guest")))
    return members.withColumn("at", F.explode(at)).select(*members.columns, "at.class", "at.guest")


def _mixed(members: DataFrame) -> DataFrame:
    """(key, class, size, lead) of the classes in which members of different parts meet one that is no guest."""
    lead = F.max("lead") if "lead" in members.columns else F.lit(True)
    groups = members.groupBy("key", "class").agg(F.count("*").alias("size"), F.min("part").alias("lo"), F.max("part").alias("hi"), F.min("guest").alias("empty"), lead.alias("led"))
    return groups.filter("lo < hi and not empty and led").select("key", "class", "size")


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents whose sets of word shingles are similar: 100 * intersection >= percent * union.

    1. Every text is sketched where it is read: number of shingles, 128-bit set key, one-permutation signature with
       optimal densification cut to ``BANDS`` bands; sets of up to ``SMALL`` shingles also emit prefix keys.
    2. Equal sets fall to one node, the smallest doc_id (an aggregate with map-side combining). Groups of copies,
       however large, are one node from here on.
    3. Nodes that share a key form a bucket. Each bucket gives a star, edges from its smallest node to the others, so
       candidates grow with bucket sizes and not with their squares.
    4. Edges are confirmed on full sets. Nodes of buckets that still hold several components of like sizes are sketched afresh, with new
       permutations and bands of ``FINE_ROWS`` bins, which hold little but like nodes, and get stars around centres
       drawn by hash. An edge within a component can't change the result and isn't checked.
    5. Buckets of fine bands that then still hold several components are finished exactly (``_finish``), as centres are
       drawn by chance.
    6. Components by alternating stars over tables in the shared folder.

    With 32 bands of 4 bins a pair at similarity 0.8 shares no key with probability 5e-8, and no fine band of 128 with
    probability 6e-11; every pair that shares a fine band is compared or in one component. No bucket is capped, and work is
    linear in nodes and keys but for keys of step 5 that many unlike components share.

    Returns one row per input row: doc_id, n_shingles, component_id, kept. Words are runs of non-space bytes, A-Z
    lower-cased; a text with fewer words than ``shingle`` is one shingle, one without words is empty and linked with
    nothing. Rows that repeat a doc_id are one node of the graph: what one of them is linked with, all are. A null doc_id
    is linked with nothing: component_id is null, kept true. An empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(spark, "minhash")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if rows.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return _components(scratch, rows, shingle, percent)
    # each row is a node, and then the components that rows of one doc_id are in are joined; keys ascend with doc_id
    rows, _ = row_keyed(scratch, rows, ordered=True)
    found = scratch.save(_components(scratch, rows.select(F.col("row_key").alias("doc_id"), "text"), shingle, percent).select(F.col("doc_id").alias("row_key"), "n_shingles", "component_id"), "by-row")
    found = rows.drop("text").join(found, "row_key").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    first = found.filter("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("v"), F.max("component_id").alias("u")).filter("u <> v")
    bonds = found.join(first.select("doc_id", "v"), "doc_id").select(F.col("component_id").alias("u"), "v").filter("u <> v").distinct()
    whole = connected_components(scratch, scratch.save(bonds, "bonds"), "whole")
    found = found.join(whole, found["component_id"] == whole["node"], "left").withColumn("component_id", F.coalesce("component", "component_id"))
    name = rows.select(F.col("row_key").alias("component_id"), F.col("doc_id").alias("least"))
    out = found.select("doc_id", "n_shingles", "component_id").join(name, "component_id", "left").select("doc_id", "n_shingles", F.col("least").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _components(scratch: Scratch, rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``near_duplicates`` of rows (doc_id, text) whose doc_ids don't repeat."""
    sketch = scratch.save(rows.mapInArrow(_sketch(shingle, percent), "doc_id long, n long, k1 long, k2 long, keys array<long>"), "sketch")
    real = sketch.filter("n > 0 and doc_id is not null")
    nodes = real.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys"))
    nodes = scratch.save(nodes, "nodes")
    buckets = nodes.select(F.explode("keys").alias("key"), "node", "n")
    shared = buckets.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select("key")
    buckets = scratch.save(buckets.join(shared, "key", "left_semi"), "buckets")

    ids = scratch.save(buckets.select("node", "n").distinct(), "candidates")
    hint, packed = if_few(ids)  # for tables of candidates
    texts = rows.withColumnRenamed("doc_id", "node").join(hint(ids), "node")
    grams = scratch.save(texts.select("node", "text", "n").mapInArrow(_sets(shingle), "node long, n long, grams binary"), "grams")

    def confirm(edges: DataFrame, name: str) -> DataFrame:
        """The written edges (u, v) with ``linked``, of which v may be a hub: its set is copied, so that its edges meet it in several tasks.

        Where edges are few they go to the sets, and only sets that have edges are shuffled, once."""
        edges, (few, packed) = edges.select("u", "v"), if_few(edges)
        hubs = few(packed(edges.groupBy("v").agg(F.ceil(F.count("*") / HUB_EDGES).cast("int").alias("cuts"))))
        b = grams.select(F.col("node").alias("v"), F.col("grams").alias("v_set")).join(hubs, "v").select("v", "v_set", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("salt"))
        a = grams.select(F.col("node").alias("u"), F.col("grams").alias("u_set"))
        edges = edges.join(hubs, "v").select("u", "v", F.pmod(F.xxhash64("u"), "cuts").cast("int").alias("salt"))
        found = few(edges).join(a, "u").join(b, ["v", "salt"])
        return scratch.save(found.select("u", "v", "u_set", "v_set").mapInArrow(_confirm(percent), "u long, v long, linked boolean"), name)

    def stars(members: DataFrame, turn: int) -> DataFrame:
        """Edges to each bucket's centre v, its smallest node or in a later turn one drawn by hash, from its other members u.

        Members have a ``part``: buckets of one part give no star, and no edge stays within a part.
        """
        rank = F.col("node") if turn == 0 else F.xxhash64("key", "node")
        ends = [F.min("part").alias("lo"), F.max("part").alias("hi")]
        centre = members.groupBy("key").agg(F.min(F.struct(rank.alias("rank"), "node", "n", "part")).alias("c"), *ends).filter("lo < hi").select("key", "c")
        pairs = members.join(centre, "key").filter("part <> c.part and 100 * least(n, c.n) >= %d * greatest(n, c.n)" % percent)
        return pairs.select(F.col("node").alias("u"), F.col("c.node").alias("v")).distinct()

    def in_parts(members: DataFrame, parts: DataFrame) -> DataFrame:
        return members.join(hint(parts), "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("part"))

    def open_nodes(members: DataFrame) -> DataFrame:
        """(node, part) of the members that meet another part of like size in one of their buckets."""
        classed = _length_classes(members, percent)
        return classed.join(_mixed(classed), ["key", "class"], "left_semi").select("node", "part").distinct()

    candidates = scratch.save(stars(buckets.withColumn("part", F.col("node")), 0), "stars")
    links = confirm(candidates, "links").filter("linked").select("u", "v")
    parts = connected_components(scratch, links, "parts")
    open_ = scratch.save(packed(open_nodes(in_parts(buckets, parts))), "open")
    if not open_.isEmpty():
        fine = grams.join(hint(open_), "node").select("node", "n", "part", "grams").mapInArrow(_fine_keys(1), "node long, n long, part long, keys array<long>")
        fine = scratch.save(fine.select(F.explode("keys").alias("key"), "node", "n", "part"), "fine")
        mixed = fine.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo < hi").select("key")
        fine = scratch.save(fine.select("key", "node").join(mixed, "key", "left_semi").join(hint(ids.select("node", "n")), "node").join(hint(open_), "node").select("key", "node", "n", "part"), "fine-mixed")
        pairs = scratch.save(stars(fine, 1), "pairs")
        links = links.unionByName(confirm(pairs, "links-fine").filter("linked").select("u", "v"))
        parts = connected_components(scratch, links, "parts-fine")
        crowded = fine.groupBy("key").agg(F.count("*").alias("size")).filter("size > 2").select("key")  # of two members, one was the centre
        left = scratch.save(packed(open_nodes(in_parts(fine.join(crowded, "key", "left_semi").drop("part"), parts))), "left")
        if not left.isEmpty():
            links = links.unionByName(_finish(scratch, grams, left, confirm, percent))
            parts = connected_components(scratch, links, "parts-last")

    scratch.drop("buckets", "candidates", "grams", "stars", "links", "open", "fine", "fine-mixed", "pairs", "links-fine", "left", *FINISH_TABLES)
    member = sketch.join(nodes.select("n", "k1", "k2", "node"), ["n", "k1", "k2"], "left")
    out = member.join(hint(parts), "node", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "node", "doc_id")).cast("long")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _families(scratch: Scratch, many: DataFrame) -> DataFrame:
    """Members of large keys (key, class, node, n, part, lead), dealt so that sets are copied least.

    Members of an edited family share many keys and would be compared under each. Where all nodes that are connected by
    such keys make fewer copies of sets as one group than their keys do, the family takes the keys' place (class -1, all
    members lead).
    """
    volume = F.sum("n") * F.ceil(F.greatest(F.count("*") / BLOCK_NODES, F.sum("n") / BLOCK_SHINGLES))
    groups = scratch.save(many.groupBy("key", "class").agg(F.min("node").alias("first"), volume.alias("copied")), "large-keys")
    edges = many.join(if_few(groups)[0](groups), ["key", "class"]).select(F.col("node").alias("u"), F.col("first").alias("v")).distinct()
    family = connected_components(scratch, scratch.save(edges, "family-edges"), "families").withColumnRenamed("component", "family")
    hint, packed = if_few(family)
    members = many.select("node", "n", "part").distinct().join(hint(family), "node")
    by_key = groups.join(hint(family), groups["first"] == family["node"]).groupBy("family").agg(F.sum("copied").alias("by_key"))
    whole = members.groupBy("family").agg(volume.alias("copied")).join(by_key, "family").filter("copied <= by_key").select("family")
    whole = scratch.save(packed(whole), "whole-families")
    alone = many.join(hint(family.join(hint(whole), "family", "left_anti").select("node")), "node", "left_semi").select(*many.columns)
    return alone.unionByName(members.join(hint(whole), "family").select(F.col("family").alias("key"), F.lit(-1).alias("class"), "node", "n", "part", F.lit(True).alias("lead")))


FINISH_TABLES = ("open-sets", "rare", "rare-shared", "rare-pairs", "links-rare", "large-keys", "family-edges", "whole-families", "large", "links-blocks")


def _finish(scratch: Scratch, grams: DataFrame, open_: DataFrame, confirm, percent: int) -> DataFrame:
    """All links between open nodes (node, part) of different parts, by prefix filter.

    Shingles are ordered by how many open sets hold them; those that one part alone has come first, can't be common, and
    are only counted. Of two similar sets the first n - ceil(t n) + 1 shingles have one in common, which is a ``lead`` of
    the smaller one (among its first n - ceil(2 t n / (1 + t)) + 1), as overlap is at least 2t / (1 + t) of its size. Members
    of a key and a class of set sizes are compared pair by pair if they are up to ``PAIRED``, else in blocks of two
    sides that count all common shingles at once, by key or by family of keys (``_families``). Only members outside the
    most frequent part are a left side.
    """
    sets = scratch.save(grams.join(if_few(open_)[0](open_), "node"), "open-sets")
    long = sets.select("node", "n", "part", "grams").mapInArrow(_shingle_rows, "node long, n long, part long, key long")
    common = long.groupBy("key").agg(F.count("*").alias("size"), F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo < hi").select("key", "size")
    own = Window.partitionBy("node")
    place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("size", "key"))
    first = lambda over, under: F.col("n") - F.ceil(over * F.col("n") / under) + 1
    rare = long.join(common, "key").withColumn("place", place).filter(F.col("place") <= first(percent, 100))
    rare = rare.select("key", "node", "n", "part", (F.col("place") <= first(2 * percent, 100 + percent)).alias("lead"))
    rare = _length_classes(scratch.save(rare, "rare"), percent)
    near = scratch.save(rare.join(_mixed(rare), ["key", "class"]), "rare-shared")

    few = near.filter(F.col("size") <= PAIRED).drop("size")
    other = few.select("key", "class", *[F.col(c).alias(f"{c}_2") for c in ("node", "n", "part", "lead", "guest")])
    once = "not (guest and guest_2) and (guest or not guest_2 and node > node_2)"
    led = "(lead and n <= n_2 or lead_2 and n_2 <= n)"
    pairs = few.join(other, ["key", "class"]).filter(f"part <> part_2 and {once} and {led} and 100 * least(n, n_2) >= {percent} * greatest(n, n_2)")
    pairs = scratch.save(pairs.select(F.greatest("node", "node_2").alias("u"), F.least("node", "node_2").alias("v")).distinct(), "rare-pairs")
    links = confirm(pairs, "links-rare").filter("linked").select("u", "v")

    many = near.filter(F.col("size") > PAIRED).select("key", "class", "node", "n", "part", "lead")
    if many.isEmpty():
        return links
    many = scratch.save(_families(scratch, many), "large")
    lead = F.when(F.col("lead"), F.col("n"))
    of_part = many.groupBy("key", "class", "part").agg(F.count("*").alias("k"), F.sum("n").alias("m"), F.count(lead).alias("lk"), F.coalesce(F.sum(lead), F.lit(0)).alias("lm"))
    of_key = of_part.groupBy("key", "class").agg(F.max_by(F.struct("part", "k", "m", "lk", "lm"), "k").alias("main"), *[F.sum(c).alias(f"all_{c}") for c in ("k", "m", "lk", "lm")])
    cut = lambda k, m: F.ceil(F.greatest(F.expr(k) / BLOCK_NODES, F.expr(m) / BLOCK_SHINGLES))
    of_key = of_key.select(
        "key", "class", F.col("main.part").alias("main"), cut("all_k", "all_m").alias("every"),
        cut("all_lk - main.lk", "all_lm - main.lm").alias("a"), cut("all_k - all_lk - main.k + main.lk", "all_m - all_lm - main.m + main.lm").alias("b"), cut("main.lk", "main.lm").alias("main_b"),
    )
    many = many.join(of_key, ["key", "class"]).withColumn("salt", F.xxhash64("key", "node", "n"))

    def side(where: str, kind: str, own: str, others: str, left: bool) -> DataFrame:
        """One side's rows, each in a block of its own side and in every block of the other."""
        at, all_ = F.pmod("salt", own), F.explode(F.sequence(F.lit(0).cast("long"), F.col(others) - 1))
        return many.filter(f"{own} > 0 and {others} > 0").filter(where).select(
            "key", "class", "node", "n", "part", F.lit(kind).alias("kind"), (at if left else all_).alias("i"), (all_ if left else at).alias("j"), F.lit(left).alias("left")
        )

    # of members outside the main part: those with the key as a lead meet all, the others the main part's leads
    sides = side("part <> main and lead", "a", "a", "every", True).unionByName(side("true", "a", "every", "a", False))
    sides = sides.unionByName(side("part <> main and not lead", "b", "b", "main_b", True)).unionByName(side("part = main and lead", "b", "main_b", "b", False))
    sides = sides.join(sets.select("node", "grams"), "node")
    blocked = sides.groupBy("key", "class", "kind", "i", "j").applyInArrow(_block_links(percent), "u long, v long")
    return links.unionByName(scratch.save(blocked.distinct(), "links-blocks"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one of each component left, that with the smallest doc_id.

    Where doc_ids repeat or are missing each row is a node of its own, in the order of doc_id (nulls last) and text. Of
    what is left of rows that repeat a doc_id one stays, that with the smallest text.
    """
    scratch = Scratch(spark, "near-deduped")
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").isEmpty():
        return without_ids(scratch, docs, near_duplicates(spark, docs, shingle, percent).filter(~F.col("kept")))
    rows, key = row_keyed(scratch, docs, ordered=True)
    found = near_duplicates(spark, rows.select(F.col(key).alias("doc_id"), "text"), shingle, percent)
    left = scratch.save(without_ids(scratch, rows, found.filter(~F.col("kept")), key).drop(key), "left")
    name, turn = fresh(docs, "again_id"), fresh(docs, "near_turn")
    again = left.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias(name)).filter(F.col(name) > 1).select(F.col("doc_id").alias(name))
    again = scratch.save(again, "again")
    if again.isEmpty():
        return left
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    once = left.join(again, F.col("doc_id") == F.col(name), "left_semi").withColumn(turn, first).filter(F.col(turn) == 1).drop(turn)
    return left.join(again, F.col("doc_id") == F.col(name), "left_anti").unionByName(once)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by four-word shingles at 80 percent; nulls, repeats and empty texts as in ``near_duplicates``."""
    return near_duplicates(spark, read_table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4, percent=80)
