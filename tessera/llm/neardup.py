"""Near-duplicate classes by a MinHash LSH forest, confirmed on full shingle sets.

Each different shingle set has ``TREES`` signatures of ``DEPTH`` MinHash values. A tree of the forest is the order of all sets by one signature: each is sorted over range partitions,
so sets that agree on a prefix stand next to each other, as a region of that order. A region begins where neighbours have ``ROOT`` values in common.

1. Each region proposes its hub to its members: the member that most sets share prefixes with, over all depths and trees. A text from which many copies were made has
   the commonest value at almost every place and so is the hub, which finds in linear work the links that copies have to their origin.
2. In regions that hold different components then, depth adapts: a set goes to the shallowest prefix that at most ``LEAF`` sets share, and its longest-common-prefix
   neighbours there, if they are of another component, are its candidates.
3. Sets of regions that more than ``LEAF`` sets share and that still hold different components are joined exactly, by a prefix filter: tokens (shingles) are ordered from the rarest on, two
   linked sets share one in their prefixes, and its places, both sizes and sketches of both sets bound their intersection. Of each token the entries of its largest component meet those of others, never each other.

Candidates are confirmed on the full sets after each step, and classes are the connected components of the confirmed links. Rows that are equal as sets are one node from
the start; a group of copies is reduced by partial aggregation before anything is shuffled by its digest. Joins on keys that may be hot are of two shuffled sides, which the adaptive
planner can split. Nothing grows with the square of a group of copies; only in step 3 sets of different components that share a token in their prefixes, and whose sizes, places and sketches allow a link, are each compared.

Two sets that share a region in any tree are in one class whenever they are linked, with certainty. That they share one has a probability: of sets of which r in 100 shingles
are shared, 1 - (1 - (r/100)**ROOT)**TREES; for 85 that is 0.999993, for 80 0.9997.

Defined results: null texts, empty texts and texts without words have no shingles and are linked with nothing; a text of fewer than ``N`` words is one shingle;
rows that repeat a key are judged each by their own text; a null key never names a class unless all its class's keys are null, and then it is not kept; extra columns, whatever their names, are ignored by
:func:`classes` and passed through by :func:`representatives`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import BASE, Bitmap, Scratch, U, bound_batches, hashes, mix, unused, without

N, TREES, DEPTH, ROOT, LEAF = 5, 16, 12, 4, 32
#: Binary logarithm of the number of cells in which the exact join counts tokens to order them by rarity. Collisions cost time only: any order that all sets share is right.
CELLS = 21
#: Words of 64 bits of a sketch of a set.
WORDS = 32
#: Entries of a token that one task meets with all others of that token.
BLOCK = 2048
_SEPARATES = np.zeros(256, bool)
_SEPARATES[[0x20, 9, 10, 11, 12, 13]] = True
_RNG = np.random.default_rng(20240229)
_XOR = _RNG.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)
_MUL = _RNG.integers(0, 1 << 31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(text: str | bytes | None, n: int = N) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's n-word shingles."""
    raw = (text.encode() if isinstance(text, str) else text or b"").lower()
    w = hashes(raw, _SEPARATES)
    if not len(w):
        return w
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, U)
    for i in range(k):
        h = h * BASE + w[i : len(w) - k + 1 + i]
    return np.unique(mix(h))


def signature(h: np.ndarray) -> bytes:
    """TREES * DEPTH MinHash values of 16 bits, tree by tree."""
    x, least = (h >> U(32)).astype(np.uint32), np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(least, ((x[at : at + 512, None] ^ _XOR) * _MUL).min(axis=0), out=least)
    # The low bits of a least value tell sets apart best: its high bits are almost all zero.
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2").tobytes()


def _profiles(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """key, mark (of the text), n_shingles, digest (of the set; null for the empty set) and sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, digests, sigs = [], [], []
            for t in b.column("text"):
                h = shingles(t.as_py(), n)
                sizes.append(len(h))
                digests.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                sigs.append(signature(h) if len(h) else None)
            yield pa.RecordBatch.from_pydict({"key": b.column("key"), "mark": b.column("mark"), "n_shingles": pa.array(sizes, pa.int64()), "digest": pa.array(digests, pa.binary()), "sig": pa.array(sigs, pa.binary())})

    rows = docs.select(F.col(key).cast("long").alias("key"), _mark(text).alias("mark"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "key long, mark binary, n_shingles long, digest binary, sig binary")


def _mark(text: str) -> Column:
    """What tells texts apart, in 16 bytes; the null text's is the empty text's."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def _sets(docs: DataFrame, marks: DataFrame, most: int, text: str, n: int) -> DataFrame:
    """digest and set of the texts with these marks (``most`` at most), and of the few others whose marks share their places in the bitmap.

    Texts are not shuffled: each task drops those that no mark can mean and hashes the rest.
    """
    bits = Bitmap(most).filled(marks, "mark")
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in np.flatnonzero(held.value.has(b.column("place").to_numpy())):
                h = shingles(b.column("text")[int(i)].as_py(), n)
                if len(h):
                    yield pa.RecordBatch.from_pydict({"digest": pa.array([hashlib.blake2b(h.tobytes(), digest_size=16).digest()], pa.binary()), "set": pa.array([h.view("i8")], pa.list_(pa.int64()))})

    rows = docs.select(bits.place(_mark(text)).alias("place"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "digest binary, set array<long>")


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    """A column of binary values of one length as rows of bytes."""
    column = column.cast(pa.binary(width))
    return np.frombuffer(column.buffers()[1], np.uint8)[column.offset * width : (column.offset + len(column)) * width].reshape(-1, width)


def _common(keys: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """How many leading values neighbours have in common (none if their keys differ), for all rows but the first."""
    same = np.logical_and.accumulate(parts[1:] == parts[:-1], axis=1).sum(axis=1)
    return np.where(keys[1:] == keys[:-1], same, 0)


def _runs(common: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the number of its run of neighbours that agree at a depth, and that run's length."""
    run = np.concatenate(([0], np.cumsum(common < depth)))
    return run, np.bincount(run)[run]


def _regions(profiles: DataFrame) -> DataFrame:
    """digest, region, part (the signature in that tree) and weight (prefixes shared, over all depths) of each set in each of its trees where it may share a region.

    A row whose neighbour is in another partition counts as one that shares a region; where it doesn't, it is alone there and does no harm.
    """
    nodes = profiles.where("digest IS NOT NULL").groupBy("digest").agg(F.first("sig").alias("sig"))
    parts = F.array(*[F.substring("sig", 2 * DEPTH * t + 1, 2 * DEPTH) for t in range(TREES)])
    trees = nodes.select("digest", F.posexplode(parts).alias("tree", "part"))
    order = ["tree", "part", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in (*(b for b in batches if b.num_rows), None):
            if last is not None and b is not None:
                rows = pa.Table.from_batches([last, b]).combine_chunks().to_batches()[0]
            else:
                rows = b if last is None else last
            if rows is None:
                return
            tree, raw = rows.column("tree").to_numpy(), np.ascontiguousarray(_fixed(rows.column("part"), 2 * DEPTH))
            common = _common(tree, raw.view("<u2"))
            left, right = np.concatenate(([ROOT if last is None else first], common)), np.concatenate((common, [ROOT]))
            done = slice(0, len(tree) - (b is not None))  # the last row waits for its right neighbour
            keep = np.flatnonzero(np.maximum(left, right)[done] >= ROOT)
            weight = sum(_runs(common, d)[1] for d in range(ROOT, DEPTH + 1))
            region = mix(raw[:, : 2 * ROOT].copy().view("<u8")[:, 0] ^ (tree.astype(U) + U(1)) * BASE)
            kept = rows.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([kept.column("digest"), pa.array(region[keep].view("i8")), kept.column("part"), pa.array(weight[keep].astype("i8"))], ["digest", "region", "part", "weight"])
            first, last = left[-1], rows.slice(len(tree) - 1) if b is not None else None

    return trees.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "digest binary, region long, part binary, weight long")


def _to_hubs(regions: DataFrame) -> DataFrame:
    """Pairs (a, b) of digests, a before b: each set and the hub of its region."""
    standing = F.sum("weight").over(Window.partitionBy("digest")).alias("standing")
    members = regions.select("region", "digest", standing)
    hubs = members.groupBy("region").agg(F.max(F.struct("standing", "digest"))["digest"].alias("hub"))
    return members.join(hubs, "region").where("digest <> hub").select(F.least("digest", "hub").alias("a"), F.greatest("digest", "hub").alias("b")).distinct()


def _mixed(regions: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of regions that hold different components, with label and n, the region's number of sets. ``labels``: (node, label); a set that it lacks is its own."""
    rows = regions.join(_merged(labels).withColumnRenamed("node", "digest"), "digest", "left").select("region", "digest", "part", F.coalesce("label", "digest").alias("label"))
    sizes = rows.groupBy("region").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("region", "n")
    return rows.join(sizes, "region")


def _neighbours(mixed: DataFrame) -> DataFrame:
    """Pairs (a, b) of digests of different components that share a leaf: in regions of at most LEAF sets all, in others those of the shallowest prefix that so few sets share."""
    few = mixed.where(F.col("n") <= LEAF).select("region", "digest", "label")
    other = few.select("region", F.col("digest").alias("other"), F.col("label").alias("its"))
    small = few.join(other, "region").where("digest < other AND label <> its").select(F.col("digest").alias("a"), F.col("other").alias("b"))
    order = ["region", "part", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows < 2:
                continue
            raw, label = np.ascontiguousarray(_fixed(b.column("part"), 2 * DEPTH)), b.column("label").dictionary_encode().indices.to_numpy()
            common = _common(b.column("region").to_numpy(), raw.view("<u2"))
            leaf = np.full(len(label), -1)
            for d in range(ROOT, DEPTH + 1):
                number, size = _runs(common, d)
                fits = (leaf < 0) & (size <= LEAF)
                leaf[fits] = (number * (DEPTH + 1) + d)[fits]
            for k in range(1, LEAF):
                i = np.flatnonzero((leaf[:-k] >= 0) & (leaf[:-k] == leaf[k:]) & (label[:-k] != label[k:])) if k < len(leaf) else []
                if len(i):
                    yield pa.RecordBatch.from_arrays([b.column("digest").take(pa.array(i)), b.column("digest").take(pa.array(i + k))], ["a", "b"])

    many = mixed.where(F.col("n") > LEAF).select(*order, "label").repartitionByRange(*order).sortWithinPartitions(*order)
    large = many.mapInArrow(run, "a binary, b binary").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return small.unionByName(large).distinct()


def _entries(sets: DataFrame, percent: int) -> DataFrame:
    """token, digest, label, size and place of the tokens in each set's prefix: so many of its rarest that every linked set has one of them.

    ``sets``: digest, label and set. A link to a set no larger than this one takes percent in 100 of its tokens at least.
    """

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELLS, np.int64)
        for b in batches:
            tokens = b.column("set").flatten().to_numpy(zero_copy_only=False)
            total += np.bincount((tokens.view("u8") >> U(64 - CELLS)).astype("i8"), minlength=1 << CELLS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype("i4")), pa.array(total[at])], ["cell", "n"])

    often = sets.select("set").mapInArrow(cells, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1").toPandas()
    counts = np.ones(1 << CELLS, np.int32)
    counts[often["cell"]] = often["n"].clip(upper=np.iinfo(np.int32).max)
    counts = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for digest, label, tokens in zip(b.column("digest"), b.column("label"), b.column("set"), strict=True):
                t = tokens.values.to_numpy(zero_copy_only=False)
                size = len(t)
                n = size - -(-percent * size // 100) + 1
                first = t[np.lexsort((t, counts.value[t.view("u8") >> U(64 - CELLS)]))[:n]]
                yield pa.RecordBatch.from_pydict(
                    {"token": first, "digest": pa.array([digest.as_py()] * len(first), pa.binary()), "label": pa.array([label.as_py()] * len(first), pa.binary()), "size": np.full(len(first), size), "place": np.arange(len(first))}
                )

    return sets.select("digest", "label", "set").mapInArrow(run, "token long, digest binary, label binary, size long, place long")


def _sketches(sets: DataFrame) -> DataFrame:
    """digest and sketch: WORDS * 64 bits, of which those at the places of the set's tokens are set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = np.zeros((b.num_rows, WORDS * 64), np.uint8)
            for i, tokens in enumerate(b.column("set")):
                bits[i, tokens.values.to_numpy().view("u8") % U(WORDS * 64)] = 1
            words = np.packbits(bits, axis=1).view("<i8")
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(w)) for w in words.T], [f"w{k}" for k in range(WORDS)])], ["digest", "sketch"])

    return sets.select("digest", "set").mapInArrow(run, f"digest binary, sketch struct<{', '.join(f'w{k}: long' for k in range(WORDS))}>")


def _missing(scratch: Scratch, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of digests with different labels, among which are all linked ones.

    Of sets of m <= n tokens that are linked, the intersection is at least percent * (m + n) / (100 + percent). Their first common token, at places i and j, has
    m - i and n - j of each from it on, so both are that at least, and i is among the few first places that a link to a set of the same size needs. Sketches
    differ in no more bits than the sets in tokens, so these bits bound the intersection too.
    """
    every = scratch.write(_entries(sets, percent), "entries")
    whole = 100 + percent
    indexed = F.expr(f"{2 * percent} * size <= {whole} * (size - place)")
    # Per token: the labels that have it, which of them has it most often, and what sizes its indexed entries can meet.
    reach = F.max(F.when(indexed, F.expr(f"{whole} * (size - place) div {percent} - size"))).alias("reach")
    least = F.min(F.when(indexed, F.col("size"))).alias("least")
    by_label = every.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"), reach, least)
    tokens = by_label.groupBy("token").agg(F.count(F.lit(1)).alias("labels"), F.max(F.struct("n", "label"))["label"].alias("top"), F.max("reach").alias("reach"), F.min("least").alias("least"), (1 + F.floor(F.sum("n") / BLOCK)).cast("int").alias("blocks"))
    tokens = tokens.where("labels > 1 AND reach IS NOT NULL").drop("labels")
    met = every.join(tokens, "token").withColumn("indexed", indexed).withColumn("probes", F.expr(f"size <= reach AND {percent} * (least + size) <= {whole} * (size - place)"))
    met = met.where("indexed OR probes").select(*every.columns, "indexed", "probes", "blocks", (F.col("label") == F.col("top")).alias("top"))
    met = scratch.write(met.join(_sketches(sets), "digest"), "met-entries")
    scratch.drop("entries")
    # The entries of a frequent token that are met are dealt out in blocks of about BLOCK, each in a task of its own.
    end = lambda df, x: df.select("token", "block", *[F.col(c).alias(f"{c}_{x}") for c in ("digest", "label", "size", "place", "top")], *[F.col(f"sketch.w{k}").alias(f"w{k}_{x}") for k in range(WORDS)])
    small = end(met.where("indexed").withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")), "a")
    large = end(met.where("probes").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))), "b")
    apart = " + ".join(f"bit_count(w{k}_a ^ w{k}_b)" for k in range(WORDS))
    least_common = f"{percent} * (size_a + size_b)"  # times 1 / whole
    fits = F.expr(
        f"label_a <> label_b AND (size_a < size_b OR size_a = size_b AND digest_a < digest_b) AND {least_common} <= {whole} * (size_a - place_a) AND {least_common} <= {whole} * (size_b - place_b)"
        f" AND 2 * {least_common} <= {whole} * (size_a + size_b - ({apart}))"
    )
    rest, top = small.where("NOT top_a").join(large, ["token", "block"]).where(fits), small.where("top_a").join(large.where("NOT top_b"), ["token", "block"]).where(fits)
    return rest.unionByName(top).select(F.least("digest_a", "digest_b").alias("a"), F.greatest("digest_a", "digest_b").alias("b")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that are linked."""
    one = pairs.join(sets.select(F.col("digest").alias("a"), F.col("set").alias("x")), "a")
    two = one.join(sets.select(F.col("digest").alias("b"), F.col("set").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return two.where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")


def _merged(labels: DataFrame) -> DataFrame:
    """Labels for a join of two shuffled sides. Their files are far smaller than their rows, as many share a label, so Spark's estimate must not have them broadcast."""
    return labels.hint("merge")


def _components(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """node and label (the least node that it reaches) of the links' ends: labels spread along links and jump to their label's label until none changes."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), f"{name}-0")
    for k in range(1, 200):
        heard = both.join(_merged(labels).withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "label", F.lit(None).cast("binary").alias("was"))
        spread = heard.unionByName(labels.select("node", "label", F.col("label").alias("was"))).groupBy("node").agg(F.min("label").alias("label"), F.max("was").alias("was"))
        goal = spread.select(F.col("node").alias("label"), F.col("label").alias("goal"))
        found = scratch.write(spread.join(_merged(goal), "label").select("node", F.col("goal").alias("label"), (F.col("goal") != F.col("was")).alias("moved")), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        labels = found.select("node", "label")
        if found.where("moved").isEmpty():
            return labels
    raise RuntimeError("the components did not settle")


def _joined(scratch: Scratch, labels: DataFrame, pairs: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """The labels once the pairs that are linked have joined their components. ``labels`` is written table ``name`` then."""
    of = lambda end: _merged(labels).select(F.col("node").alias(end), F.col("label").alias(f"l{end}"))
    linked = _confirmed(pairs, sets, percent).join(of("a"), "a", "left").join(of("b"), "b", "left")
    found = scratch.write(linked.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b").distinct(), f"{name}-links")
    if found.isEmpty():
        return labels
    joined = _components(scratch, found, f"{name}-of")
    # A label that was joined stands for its own node too, which has no row of its own if no link was known of it.
    own = joined.select("node", F.col("node").alias("label")).join(labels, "node", "left_anti")
    again = labels.unionByName(own).join(_merged(joined).select(F.col("node").alias("label"), F.col("label").alias("joined")), "label", "left")
    return scratch.write(again.select("node", F.coalesce("joined", "label").alias("label")), name)


def _labels(scratch: Scratch, docs: DataFrame, profiles: DataFrame, percent: int, text: str, n: int) -> DataFrame:
    """node (digest) and label (its component) of the sets that have a link."""
    regions = scratch.write(_regions(profiles), "regions")
    pairs = scratch.write(_to_hubs(regions), "to-hubs")
    # Full sets, of the sets that are part of a pair only.
    wanted = pairs.select(F.col("a").alias("digest")).union(pairs.select("b")).distinct()
    marks = profiles.select("mark", "digest").join(wanted, "digest", "left_semi").groupBy("digest").agg(F.min("mark").alias("mark"))
    sets = scratch.write(_sets(docs, marks, 2 * pairs.count(), text, n).groupBy("digest").agg(F.first("set").alias("set")), "sets")
    links = scratch.write(_confirmed(pairs, sets, percent), "links")
    labels = _components(scratch, links, "labels")

    # What hubs have missed.
    mixed = scratch.write(_mixed(regions, labels), "mixed")
    scratch.drop("regions", "to-hubs", "links")
    if mixed.isEmpty():
        return labels
    labels = _joined(scratch, labels, _neighbours(mixed), sets, percent, "near")

    # What leaves have missed in regions of more sets.
    crowded = _mixed(mixed.where(F.col("n") > LEAF).select("region", "digest", "part"), labels).select("digest", "label").distinct()
    busy = scratch.write(sets.join(crowded, "digest"), "busy")
    scratch.drop("mixed", "sets")
    if busy.isEmpty():
        return labels
    missing = scratch.write(_missing(scratch, busy, percent), "missing")
    scratch.drop("met-entries")
    return _joined(scratch, labels, missing, busy, percent, "exact")


def _classes(docs: DataFrame, percent: int, key: str, text: str, n: int) -> tuple[Scratch, DataFrame, DataFrame]:
    """The profiles, and of each set (digest) that other rows share or that has a link: first (its rows' least key), rows (their number) and label (its class)."""
    scratch = Scratch(bound_batches(docs).sparkSession, "neardup")
    profiles = scratch.write(_profiles(docs, key, text, n), "profiles")
    labels = _labels(scratch, docs, profiles, percent, text, n)
    firsts = profiles.where("digest IS NOT NULL").groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("rows"))
    named = firsts.join(_merged(labels).withColumnRenamed("node", "digest"), "digest", "left").where("rows > 1 OR label IS NOT NULL")
    named = scratch.write(named.select("digest", "first", F.coalesce("label", "digest").alias("label")), "named")
    scratch.keep("profiles", "named")
    return scratch, profiles, named


def classes(docs: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text", n: int = N) -> DataFrame:
    """Per row: key, n_shingles, digest, component_id (the least key reachable by links of ``100 * intersection >= percent * union``) and kept (its own key is that)."""
    scratch, profiles, named = _classes(docs, percent, key, text, n)
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    of_set = scratch.write(named.join(least, "label").select("digest", "component_id", F.lit(True).alias("grouped")), "of-set")
    scratch.keep("profiles", "of-set")
    out = profiles.select("key", "n_shingles", "digest").join(of_set, "digest", "left")
    component = F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("key"))
    return out.select(F.col("key").alias(key), "n_shingles", "digest", component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"))


def representatives(docs: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text", n: int = N) -> DataFrame:
    """``docs``, of each class one row: that of the least key (null keys last) and then of the least text mark. Rows without words are all kept."""
    scratch, profiles, named = _classes(docs, percent, key, text, n)
    # Only rows of sets with a class of several rows can go.
    rows = profiles.select("key", "mark", "digest").join(named.select("digest", "label"), "digest")
    best = F.min(F.struct(F.col("key").isNull().alias("last"), "key", "mark")).alias("best")
    chosen = rows.groupBy("label", "digest").agg(best).groupBy("label").agg(F.min("best").alias("best"))
    judged = scratch.write(rows.groupBy("label", "key", "mark").agg(F.count(F.lit(1)).alias("n")).join(chosen, "label"), "judged")
    stays = F.col("key").eqNullSafe(F.col("best.key")) & (F.col("mark") == F.col("best.mark"))
    k, m = unused("key", docs), unused("mark", docs)
    gone = scratch.write(judged.where(~stays).select(F.col("key").alias(k), F.col("mark").alias(m)), "gone")
    twice = scratch.write(judged.where(stays & (F.col("n") > 1)).select(F.col("key").alias(k), F.col("mark").alias(m)), "twice")
    scratch.keep("gone", "twice")
    whole = docs.withColumns({k: F.col(key).cast("long"), m: _mark(text)})
    left = without(whole, gone, [k, m])
    # Rows equal in key and text are told apart by nothing; only such rows, if there are any, are compared with each other.
    if not twice.isEmpty():
        named_twice = twice.select(F.col(k).alias(f"{k}2"), F.col(m).alias(f"{m}2"))
        same = F.col(k).eqNullSafe(F.col(f"{k}2")) & (F.col(m) == F.col(f"{m}2"))
        left = without(left, twice, [k, m]).unionByName(left.join(named_twice, same, "left_semi").dropDuplicates([k, m]))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
