"""SimHash near-duplicate detection with pigeonhole blocks, and near copies by wider fingerprints in the same way.

Two 64-bit fingerprints that differ in at most 3 bits agree on at least 3 of 6 blocks of
bits, so the pair meets in one of the 20 tables keyed by 3 blocks (32 bits or so). Within a
key all pairs are compared. A key with more than ``BUCKET`` distinct fingerprints is split
by the same argument over its remaining bits, twice if need be; by then at most 9 bits are
free, so the size of a bucket is bounded whatever the data, and no link is lost.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from quern.llm._spark import checkpointed, dealt_anew, map_batches, map_partitions, maybe_members, members
from quern.llm.components import components

#: Bits that linked fingerprints may differ in; blocks of each split. Fixed by the pigeonhole argument above.
DISTANCE, BLOCKS = 3, 6
#: Distinct fingerprints of one key that are compared with each other before the key is split.
BUCKET = 128
#: Symbols of a sketch, 16 bits each, and of a key: four symbols fill a long. A pair of texts whose shingles have the
#: similarity s shares one of the 32 keys with probability 1 - (1 - s**4)**32, whatever was edited: 1 - 5e-8 at 0.8.
SKETCH, BAND = 128, 4
#: Rows of a block. Larger groups are compared block against block, each pair of blocks a cell of its own.
BLOCK_ROWS = 1024
#: The same in characters, where texts are compared.
BLOCK_CHARS = 8_000_000
#: Pairs whose sketches agree by this much less than the similarity are decided by their shingles: 3.4 standard errors at 0.8.
MARGIN = 0.12
_FACTORS, _SECOND = (np.random.default_rng(n).integers(0, 1 << 31, SKETCH, np.uint32) * np.uint32(2) + np.uint32(1) for n in (5, 6))
#: Shingles whose bits are counted at once.
COUNT_ROWS = 1 << 16


def bit_majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the unsigned 64-bit hashes; none give 0."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), COUNT_ROWS):
        rows = np.ascontiguousarray(hashes[i : i + COUNT_ROWS]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(rows, axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text: its word shingles, repeats included, by XXH64."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    ends = ends[shingle - 1 :] or ends[-1:]
    digest = xxhash.xxh64_intdigest
    return bit_majority(np.fromiter((digest(joined[a : b - 1], seed) for a, b in zip(starts, ends)), np.uint64, len(ends)))


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long) of every text; null, empty and blank texts have fingerprint 0."""

    def work():
        def each(batch):
            values = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

        return each

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, fp long")


def _choices(free: list[int]) -> list[int]:
    """Masks of every BLOCKS - DISTANCE of BLOCKS even parts of the given bit places."""
    parts = [part.tolist() for part in np.array_split(np.array(free), BLOCKS)]
    return [sum(1 << b for part in chosen for b in part) for chosen in combinations(parts, BLOCKS - DISTANCE)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(spark, rows: DataFrame, masks: dict[int, list[int]]) -> DataFrame:
    """Each row once per mask that refines its own mask; the mask table has a fixed size."""
    if masks.keys() == {0}:  # the whole fingerprints
        finer = rows.select("node", "fp", F.explode(F.array(*(F.lit(_signed(m)).cast("long") for m in masks[0]))).alias("mask"))
        return finer.select("mask", "node", "fp", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    pairs = spark.createDataFrame([(_signed(p), _signed(m)) for p, ms in masks.items() for m in ms], "mask long, finer long")
    finer = rows.join(F.broadcast(pairs), "mask").select(F.col("finer").alias("mask"), "node", "fp")
    return finer.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def differing_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints held in signed longs; numpy counts the bits of a negative number's absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def bucket_links(distance: int):
    """Links within sorted runs of (mask, key): a spanning forest of the close pairs of each run.

    Rows are (mask, key, node, fp).
    """

    def close(mask, key, node, fp):
        n = len(node)
        run = np.cumsum(np.r_[False, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
        root = np.arange(n)  # flat for all rows that are still compared

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        a, b = [], []
        longest = int(np.bincount(run).max()) if n else 0
        line = np.arange(n)
        for d in range(1, longest):
            line = line[: np.searchsorted(line, n - d)]
            line = line[run[line] == run[line + d]]
            # pairs that are joined already need no second look
            near = line[(root[line] != root[line + d]) & (differing_bits(fp[line], fp[line + d]) <= distance)]
            for i, j in zip(near.tolist(), (near + d).tolist()):
                x, y = find(i), find(j)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    a.append(node[i])
                    b.append(node[j])
            if len(near):
                active = np.union1d(line, line + d)
                while (root[root[active]] != root[active]).any():
                    root[active] = root[root[active]]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            columns = [np.asarray(batch.column(i)) for i in range(4)]
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns)]
            mask, key = columns[:2]
            if not len(mask):
                continue
            # the last run may go on in the next batch
            last = int(np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])[-1])
            held = [c[last:] for c in columns]
            if last:
                yield close(*(c[:last] for c in columns))
        if held is not None:
            yield close(*held)

    return run


def links(nodes: DataFrame) -> DataFrame:
    """(a, b) joining nodes (node long, fp long), enough to connect all close ones.

    Close: ``fp`` differs in at most ``DISTANCE`` bits. A key is split until it has at most
    ``BUCKET`` nodes or 12 free bits; nodes that share a fingerprint count once each.
    """
    spark, all_bits = nodes.sparkSession, list(range(64))
    level, found = {0: _choices(all_bits)}, []
    rows = nodes.select(F.lit(0).cast("long").alias("mask"), "node", "fp")
    while True:
        masks = sorted({m for ms in level.values() for m in ms})
        final = 64 - min(m.bit_count() for m in masks) <= 12
        keyed = _keyed(spark, rows, level)
        if 0 not in level:
            keyed = keyed.distinct()  # several coarser keys lead to one finer key
        many = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        shared = checkpointed(keyed.join(dealt_anew(many, "mask", "key"), ["mask", "key"]).select("mask", "key", "node", "fp", "n"))
        small = shared if final else shared.where(F.col("n") <= BUCKET)
        small = small.select("mask", "key", "node", "fp")
        dealt = small.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp", "node")
        found.append(map_partitions(dealt, bucket_links(DISTANCE), "a long, b long"))
        rows = shared.where(F.col("n") > BUCKET).select("mask", "node", "fp")
        if final or rows.isEmpty():
            break
        level = {m: [m | x for x in _choices([b for b in all_bits if not m >> b & 1])] for m in masks}
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of ``docs`` (doc_id, text).

    Documents are linked where their fingerprints differ in at most 3 bits; component_id is
    the smallest doc_id reachable. Equal fingerprints are merged before any pair is looked
    at, so copies cost one row in a map-side minimum. Null and blank texts have fingerprint
    zero and are linked like any other. A row without a doc_id links nothing; its component is
    that of its fingerprint, or null. Repeated rows are answered alike.
    """
    prints = checkpointed(fingerprints(docs, shingle, seed))
    nodes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("node")))
    found = components(links(nodes.where("node is not null")))
    labels = checkpointed(
        nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    )
    return prints.join(labels, "fp").select("doc_id", F.format_string("%016x", "fp").alias("fingerprint"), "component_id")


def joined_shingles(text: str | None, shingle: int) -> set[bytes]:
    """The distinct word shingles of a text; one of all its words if they are fewer."""
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))}


def shingle_sketch(text: str | None, shingle: int) -> bytes:
    """``SKETCH`` symbols of 16 bits: the shingle of the least value under each of as many hashes, by the value's low bits.

    The high bits of a least value are near zero in long texts, and equal by chance. Two texts' share of equal symbols estimates the Jaccard similarity of their shingles.
    """
    joined = joined_shingles(text, shingle)
    h = np.fromiter((xxhash.xxh32_intdigest(x) for x in joined), np.uint32, len(joined))
    least = np.full(SKETCH, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(h), 2048):
        mixed = h[None, i : i + 2048] * _FACTORS[:, None]
        mixed ^= mixed >> np.uint32(15)
        mixed *= _SECOND[:, None]
        least = np.minimum(least, mixed.min(1))
    return least.astype(np.uint16).tobytes()


def set_fingerprint(text: str | None, shingle: int, seed: int = 42) -> int:
    """The SimHash of a text's distinct word shingles, so that texts of one repeated line are not close to all others that repeat it."""
    joined = joined_shingles(text, shingle)
    return bit_majority(np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in joined), np.uint64, len(joined)))


def fingerprint_links(nodes: DataFrame) -> DataFrame:
    """(a, b) joining the nodes of (node, fp) whose fingerprints differ in at most ``DISTANCE`` bits: equal ones by their smallest node, that by ``links``."""
    firsts = checkpointed(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    equal = nodes.select("fp", "node").join(firsts, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return equal.unionByName(links(firsts.select(F.col("first").alias("node"), "fp")))


def dealt(rows: DataFrame, group: list[str], blocks: Column, *columns: str) -> DataFrame:
    """``rows`` as (cell, node, columns), sorted by cell: every two rows of a group meet in a cell.

    A group is cut into ``blocks`` by a hash of the nodes; a row goes once to each cell of its block and another.
    Groups whose cells share a hash are only compared with each other too.
    """
    cut = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cell = F.xxhash64(*group, F.least("block", "other"), F.greatest("block", "other"))
    return met.select(cell.alias("cell"), "node", *columns)


def _cells(batches):
    """The rows of one cell after another, as tables, from rows sorted by their first column."""
    held = []
    for batch in batches:
        cell = np.asarray(batch.column(0))
        ends = np.r_[np.flatnonzero(cell[1:] != cell[:-1]) + 1, len(cell)].tolist() if len(cell) else []
        for a, b in zip([0, *ends], ends):
            if held and held[0].column(0)[0].as_py() != cell[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def cell_links(closeness, sided: bool = False):
    """Links within sorted runs of (cell, node, ...): a spanning forest of the close pairs of each cell.

    ``closeness(rows)`` gives the function of a place and an array of later places that tells which are close. With
    ``sided`` the fourth column is 0 for rows that are linked already and need no look at each other.
    """

    def run(batches):
        a, b = [], []
        for rows in _cells(batches):
            node, root, close = rows.column(1).to_pylist(), np.arange(rows.num_rows), closeness(rows)
            if sided and len(joined := np.flatnonzero(np.asarray(rows.column(3)) == 0)):
                root[joined] = joined[0]
            for i in range(len(node) - 1):
                # pairs that are joined already need no second look
                later = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
                for j in later[close(i, later)].tolist() if len(later) else ():
                    if root[j] != root[i]:
                        root[root == root[j]] = root[i]
                        a.append(node[i])
                        b.append(node[j])
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def sketch_closeness(similarity: float):
    """Close: the share of equal symbols of (cell, node, sketch) is at least ``similarity``."""

    def closeness(rows):
        sketch = np.frombuffer(b"".join(rows.column(2).to_pylist()), np.uint16).reshape(-1, SKETCH)
        return lambda i, later: (sketch[later] == sketch[i]).mean(1) >= similarity

    return closeness


def shingle_closeness(shingle: int, similarity: float):
    """Close: the word shingles of (cell, node, text) have the Jaccard similarity ``similarity`` at least.

    Shingles are compared by 64-bit hashes.
    """

    def closeness(rows):
        digest, sets = xxhash.xxh64_intdigest, []
        for text in rows.column(2):
            joined = joined_shingles(text.as_py(), shingle)
            sets.append(np.fromiter((digest(x) for x in joined), np.uint64, len(joined)))
        size = np.array([len(x) for x in sets])
        start = np.cumsum(size) - size
        place = np.unique(np.concatenate(sets), return_inverse=True)[1]
        own = np.zeros(int(place.max()) + 1, bool)

        def close(i, later):
            alike = later[np.minimum(size[later], size[i]) >= similarity * np.maximum(size[later], size[i])]
            mine = place[start[i] : start[i] + size[i]]
            own[mine] = True
            common = np.array([np.count_nonzero(own[place[start[j] : start[j] + size[j]]]) for j in alike], np.int64)
            own[mine] = False
            return np.isin(later, alike[common >= similarity * (size[i] + size[alike] - common) - 1e-9])

        return close

    return closeness


def judged_by_center(shingle: int, similarity: float):
    """(component, node, center, text, state) of sorted rows (cell, is_center, component, node, text), a cell's centre first.

    ``state`` is 0 for texts within ``similarity`` of the centre, 1 for those that could be within it of such a text,
    2 for others. The distance 1 - similarity of sets is a metric: what is near one that is near the centre is at most
    twice as far from the centre. A task holds the shingles of one centre and one text.
    """
    digest = xxhash.xxh64_intdigest

    def hashes(text):
        joined = joined_shingles(text, shingle)
        return np.fromiter((digest(x) for x in joined), np.uint64, len(joined))

    def run(batches):
        center, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            kept, centers, states = [], [], []
            for k, (first, node, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4))):
                if first:
                    center, own = node, hashes(text.as_py())
                    continue
                other = hashes(text.as_py())
                common = np.intersect1d(own, other).size
                share = common / (own.size + other.size - common)
                kept.append(k)
                centers.append(center)
                states.append(0 if share >= similarity - 1e-12 else 1 if share >= 2 * similarity - 1 - 1e-9 else 2)
            rows = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(2), rows.column(3), pa.array(centers, pa.int64()), rows.column(4), pa.array(states, pa.int32())], ["component", "node", "center", "text", "state"])

    return run


def close_texts(texts: DataFrame, shingle: int, similarity: float) -> list[DataFrame]:
    """Tables of links (a long, b long) that join, within each component of (component, node, text), the texts of that similarity.

    A component that fits a block is compared as a whole in one cell. Of a larger one every text is first compared with one
    centre, the smallest node: those linked to it need no look at each other. Texts that could be near one of them
    are compared with them, block by block, and all that were not linked are a smaller component of the next round. So a
    component of near copies of one text is sent about once, not once for each of its blocks. Where a round links less
    than an eighth of the rows, what is left is compared block against block.
    """
    found, left, before = [], texts, None
    compare = shingle_closeness(shingle, similarity)

    def cells(rows: DataFrame, *columns: str) -> DataFrame:
        return rows.select(*columns).repartition("cell").sortWithinPartitions("cell", "node")

    def parts(n: str, chars: str) -> Column:
        return F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK_ROWS), F.ceil(F.col(chars) / BLOCK_CHARS)).cast("long")

    def part(blocks: str) -> Column:
        return F.pmod(F.xxhash64("node"), F.col(blocks))

    while True:
        sizes = left.groupBy("component").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.min("node").alias("center"))
        sizes = checkpointed(sizes.withColumn("blocks", parts("n", "chars")))
        large = sizes.where("blocks > 1").agg(F.sum("n")).first()[0] or 0
        grown = left.join(dealt_anew(sizes, "component"), "component")
        if not large or before is not None and 8 * large > 7 * before:
            met = dealt(grown.select("component", "node", "text", "blocks"), ["component"], F.col("blocks"), "text")
            found.append(map_partitions(met.repartition("cell").sortWithinPartitions("cell", "node"), cell_links(compare), "a long, b long"))
            return found
        before = large
        small = grown.where("blocks = 1").withColumn("cell", F.xxhash64("component"))
        found.append(map_partitions(cells(small, "cell", "node", "text"), cell_links(compare), "a long, b long"))
        first = F.col("node") == F.col("center")
        every = F.when(first, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(part("blocks")))
        spread = grown.where("blocks > 1").select("component", "node", "text", first.alias("is_center"), F.explode(every).alias("block"))
        spread = spread.select(F.xxhash64("component", "block").alias("cell"), "is_center", "component", "node", "text")
        spread = spread.repartition("cell").sortWithinPartitions("cell", "component", F.desc("is_center"), "node")
        judged = checkpointed(map_partitions(spread, judged_by_center(shingle, similarity), "component long, node long, center long, text string, state int"))
        found.append(judged.where("state = 0").select(F.col("center").alias("a"), F.col("node").alias("b")))
        # texts near the centre's, against those that could be near them
        sides = judged.where("state < 2").groupBy("component").agg(*(f(F.when(F.col("state") == k, x)).alias(f"{name}{k}") for k in (0, 1) for name, f, x in (("n", F.count, F.lit(1)), ("chars", F.sum, F.length("text")))))
        sides = sides.where("n0 > 0 and n1 > 0").select("component", parts("n0", "chars0").alias("blocks0"), parts("n1", "chars1").alias("blocks1"))
        both = judged.where("state < 2").join(dealt_anew(sides, "component"), "component")
        linked, near = F.col("state") == 0, F.sequence(F.lit(0).cast("long"), F.col("blocks1") - 1)
        pairs = F.when(linked, F.transform(near, lambda j: F.struct(part("blocks0").alias("i"), j.alias("j"))))
        pairs = pairs.otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks0") - 1), lambda i: F.struct(i.alias("i"), part("blocks1").alias("j"))))
        crossed = both.select("component", "node", "text", "state", F.explode(pairs).alias("c")).withColumn("cell", F.xxhash64("component", "c.i", "c.j"))
        found.append(map_partitions(cells(crossed, "cell", "node", "text", "state"), cell_links(compare, sided=True), "a long, b long"))
        left = judged.where("state > 0").select("component", "node", "text")


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, component_id by similarity of word shingles: documents of one group are near copies.

    Candidates come from SimHash, as in ``near_duplicates``: 64-bit fingerprints of each text's distinct shingles, all pairs
    within ``DISTANCE`` bits linked. Near copies further apart than that come from a sketch of 128 symbols, split into 32
    blocks of ``BAND``. Two that differ in fewer symbols than there are blocks share a block for certain, others with
    the probability given there. Texts that share a block are linked if their sketches' Hamming distance,
    in symbols, is within what ``similarity`` less ``MARGIN`` leaves. The texts of each group that both kinds of
    links make are then compared by their shingles themselves, which alone decides.

    Rows of one doc_id are one document, which is a near copy if one of its texts is. Texts without
    words are copies of nothing and left out, as are rows without a doc_id. component_id is
    the smallest doc_id of the group.
    """

    def work():
        def each(batch):
            texts = [t.as_py() for t in batch.column(1)]
            same = [xxhash.xxh3_128_digest(b" ".join(t.encode().lower().split())) for t in texts]
            sketches = [shingle_sketch(t, shingle) for t in texts]
            fps = np.fromiter((set_fingerprint(t, shingle) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), pa.array(fps), pa.array(sketches, pa.binary())], ["doc_id", "same", "fp", "sketch"])

        return each

    def keys(batches):
        for batch in batches:
            sketch = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64).reshape(batch.num_rows, -1)
            n, bands = sketch.shape
            columns = [np.repeat(np.asarray(batch.column(0)), bands), np.tile(np.arange(bands, dtype=np.int32), n), sketch.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "band", "key"])

    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    worded = texts.where(F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    prints = checkpointed(map_batches(worded, work, "doc_id long, same binary, fp long, sketch binary"))
    nodes = checkpointed(prints.groupBy("same").agg(F.min("doc_id").alias("node"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch")))
    keyed = map_partitions(nodes.select("node", "sketch"), keys, "node long, band int, key long")
    many = keyed.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = dealt(keyed.join(dealt_anew(many, "band", "key"), ["band", "key"]), ["band", "key"], F.ceil(F.col("n") / BLOCK_ROWS))
    met = shared.join(nodes, "node").select("cell", "node", "sketch").repartition("cell").sortWithinPartitions("cell", "node")
    further = map_partitions(met, cell_links(sketch_closeness(similarity - MARGIN)), "a long, b long")
    groups = checkpointed(components(fingerprint_links(nodes).unionByName(further)))
    possible = maybe_members(worded, "doc_id", members(groups, "node"))
    firsts = checkpointed(possible.join(groups, F.col("doc_id") == F.col("node")).select("component", "node", "text").distinct())
    found = components(reduce(DataFrame.unionByName, close_texts(firsts, shingle, similarity)))
    labels = checkpointed(nodes.join(found, "node", "left").select("same", F.coalesce("component", "node").alias("component_id")))
    return prints.select("doc_id", "same").join(labels, "same").select("doc_id", "component_id")
