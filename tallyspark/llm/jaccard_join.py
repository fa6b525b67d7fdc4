"""Operator 5: n-gram Jaccard join by vertical partitioning.

A text's set holds the 64-bit hashes of its distinct n-word shingles, in the
global order of hashes. Two texts link when ``den`` times their intersection is
at least ``num`` times their union.

*Candidates.* The order is cut into fragments, one more than the symmetric
difference that a link of the size class allows, and a few to spare. A link
must agree on so many whole fragments, so the fragments' contents are grouped,
texts with too few shared fragments are left out, and every other text links to
the least text of each group. These stars' components hold all
candidates, whatever the number of texts in a group, without pairs of a group.

*Pairs.* Within a component, pairs of texts not yet connected are compared by
size and by parity sketches. A sketch has a bit for every residue of the
hashes, the parity of their number; two sketches differ in at most as many bits
as the sets differ in elements, so a pair is only passed over when it is
certainly no link. Of the others a spanning forest is proposed. Large
components are dealt into blocks, and pairs of blocks into tasks.

*Overlaps.* Proposed pairs are counted vertically: the sets of the proposed
texts are cut into a few fragments of the order, each fragment's overlap is
counted separately, and the counts are summed per pair. Links join components;
pairs that fail are not proposed again, until no pair is left. After
``forests`` rounds all pairs left are proposed at once.

Texts with fewer words than ``n`` have the whole sequence as their one shingle;
those without words, null ones included, have an empty set and no links.
Equal sets, and so exact copies, are one text throughout.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import Bounded, fresh, lean, materialize, schema_of, words
from .components import connected_components

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
SLICES = 8  # fragments of the order in which overlaps are counted


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, n: int, word_hash) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles."""
    w = words(text)
    if not w:
        return np.zeros(0, np.uint64)
    a = np.fromiter(map(word_hash, w), np.uint64, len(w))
    size = min(n, len(a))
    h = np.full(len(a) - size + 1, size, np.uint64)
    for k in range(size):
        h = mix(h * _A + a[k:len(a) - size + 1 + k])
    return np.unique(h)


def set_name(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


class Classes:
    """Size classes: class c holds sizes from ``start[c]`` to before ``start[c + 1]``.

    Small sizes are classes of their own; the others are as wide as whole
    steps of the threshold come to about 1.37, since the fragments of a class
    are cut for its largest sets.
    """

    def __init__(self, num: int, den: int, largest: int = 1 << 40):
        self.num, self.den = num, den
        wide = (den / num) ** max(1, round(np.log(1.37) / np.log(den / num)))
        start = [1]
        while start[-1] <= largest:
            start.append(max(start[-1] + 1, int(start[-1] * wide) + 1 if start[-1] >= 48 else 0))
        self.start = np.array(start)

    def differ(self, size: int) -> int:
        """The largest symmetric difference of a link whose larger set has ``size`` elements."""
        return 2 * size * (self.den - self.num) // (self.den + self.num)

    def of(self, size: int) -> range:
        """Classes in which a set meets all its links: a link is found in the class of its larger set."""
        first, last = np.searchsorted(self.start, [size, size * self.den // self.num], "right") - 1
        return range(int(first), int(last) + 1)

    def signatures(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A hash per fragment of every class, and with each the class and how many fragments a link agrees on.

        Fragments without elements are left out unless all that agree may be empty.
        """
        sums = np.concatenate(([np.uint64(0)], np.cumsum(mix(s + _C), dtype=np.uint64)))
        out, tags = [], []
        for c in self.of(len(s)):
            d = self.differ(int(self.start[c + 1]) - 1)
            if not d:
                continue
            spare = 3 + d // 12  # so many fragments must agree; more than a set usually has empty ones
            f = d + spare
            at = np.searchsorted(((s >> np.uint64(32)) * np.uint64(f)) >> np.uint64(32), np.arange(f + 1, dtype=np.uint64))
            at[-1] = len(s)
            keys = mix((sums[at[1:]] - sums[at[:-1]]) ^ mix((np.arange(f, dtype=np.uint64) + np.uint64(c << 40)) * _A + _B))
            filled = at[1:] > at[:-1]
            empty = f - int(filled.sum())
            out.append(keys[filled] if empty < spare else keys)
            tags.append(np.full(len(out[-1]), (c << 32) + (spare - empty if empty < spare else 1), np.int64))
        return (np.concatenate(out), np.concatenate(tags)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def sketch(s: np.ndarray) -> bytes:
    """Parity of the number of elements for every residue of a power of two, about twice the size."""
    bits = max(64, 1 << int(2 * len(s) - 1).bit_length())
    parity = np.bincount((mix(s ^ _A) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).tobytes()


def _fold(m: np.ndarray, size: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) as sketches of fewer words."""
    while m.shape[1] > size:
        half = m.shape[1] // 2
        m = m[:, :half] ^ m[:, half:]
    return m


def propose(nodes, sizes, sketches, labels, failed, side, num: int, den: int, forest: bool):
    """Pairs of a task's texts that may link and are not connected; a spanning forest of them, or all.

    ``failed``: for a node, the smaller ones it was compared to in vain.
    ``side``: block of each node; in a task of two blocks, pairs within a block are left to its own task.
    """
    n = len(nodes)
    word = [np.frombuffer(s, np.uint64) for s in sketches]
    width = np.array([len(w) for w in word])
    label = np.unique(labels, return_inverse=True)[1]
    two = len(set(side)) > 1
    bad = {(int(x), int(f)) for x, fs in zip(nodes, failed) if fs is not None for f in fs}
    out = []
    for size in np.unique(width):
        own = np.flatnonzero(width == size)
        pool = np.flatnonzero((width == size) | (width == 2 * size))
        m = np.concatenate([_fold(word[i][None, :], size) for i in pool])
        for i in own:
            total = sizes[pool] + sizes[i]
            near = (label[pool] != label[i]) & (den * np.minimum(sizes[pool], sizes[i]) >= num * np.maximum(sizes[pool], sizes[i]))
            near &= (width[pool] > size) | (pool > i)
            if two:
                near &= side[pool] != side[i]
            k = np.flatnonzero(near)
            if not len(k):
                continue
            apart = np.bitwise_count(m[k] ^ _fold(word[i][None, :], size)).sum(axis=1, dtype=np.int64)
            for j in pool[k[apart * (den + num) <= total[k] * (den - num)]]:
                a, b = int(max(nodes[i], nodes[j])), int(min(nodes[i], nodes[j]))
                if (forest and label[i] == label[j]) or (a, b) in bad:
                    continue
                out.append((a, b))
                if forest:
                    label[label == label[j]] = label[i]
    return out


def _grouped(batches, key: list[str]):
    """Rows of a sorted partition, group by group, as lists of dictionaries' columns."""
    import pyarrow as pa
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        if not t.num_rows:
            continue
        ks = [t.column(k).to_numpy() for k in key]
        new = np.zeros(t.num_rows, bool)
        for k in ks:
            new[1:] |= k[1:] != k[:-1]
        starts = np.concatenate(([0], np.flatnonzero(new)))
        for a, z in zip(starts[:-1], starts[1:]):
            yield t.slice(a, z - a)
        rest = t.slice(starts[-1])
    if rest is not None and rest.num_rows:
        yield rest


def _groups(docs: DataFrame, key: str, text: str, n: int, num: int, den: int, block: int, forests: int, keep: list[str]):
    """Rows (``keep``, ``row``, ``n_shingles``, ``_node``) and the ``_label`` of nodes that have links.

    A node is a distinct set, named by a 64-bit hash of its elements.
    """
    classes = Classes(num, den)
    row, size = (fresh(x, docs.columns) for x in ("row", "n_shingles"))
    columns = list(dict.fromkeys([*keep, key]))
    keyed = docs.select(*dict.fromkeys([*columns, text])).withColumn("_text", F.md5(F.col(text)))
    columns = [*columns, "_text"]

    def sets(batches):
        import pyarrow as pa
        word_hash = Bounded(xxhash.xxh3_64_intdigest, 300_000).__getitem__
        for b in batches:
            out = [shingles(t, n, word_hash) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in columns] + [
                    pa.array([len(s) for s in out], pa.int64()), pa.array([set_name(s) for s in out], pa.int64()),
                    pa.array([sketch(s) for s in out], pa.binary())], names=[*columns, size, "_node", "_sketch"])

    def signatures(batches):
        import pyarrow as pa
        word_hash = Bounded(xxhash.xxh3_64_intdigest, 300_000).__getitem__
        sent: set[int] = set()  # a set goes once from a task: copies do not burden their signatures' tasks
        for b in batches:
            out = []
            for t in b.column(text).to_pylist():
                s = shingles(t, n, word_hash)
                name = set_name(s)
                if name not in sent:
                    sent.add(name)
                    out.append((name, s))
            sigs = [classes.signatures(s) for _, s in out]
            names = [np.full(len(g), name, np.int64) for (name, _), (g, _) in zip(out, sigs)]
            if sigs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([g.view(np.int64) for g, _ in sigs])), pa.array(np.concatenate(names)),
                     pa.array(np.concatenate([t for _, t in sigs]))], names=["sig", "node", "tag"])

    rows = keyed.mapInArrow(lean(sets), ", ".join([*schema_of(keyed, columns), f"{size} long, _node long, _sketch binary"]))
    rows = materialize(rows.withColumn(row, F.monotonically_increasing_id()), "shingle-sets")
    # signatures that two different sets have; a set with fewer of them in a class than a link agrees on has no link there
    sigs = docs.select(text).mapInArrow(lean(signatures), "sig long, node long, tag long")
    bucket = Window.partitionBy("sig")
    sigs = materialize(sigs.withColumn("one", F.min("node").over(bucket)).withColumn("other", F.max("node").over(bucket))
                       .filter("one <> other").select("sig", "node", "tag").distinct(), "shared-signatures", release=True)
    enough = sigs.groupBy("node", "tag").agg(F.count("*").alias("n")).filter("n >= (tag & 4294967295)").drop("n")
    stars = (sigs.join(enough, ["node", "tag"]).withColumn("hub", F.min("node").over(bucket)).filter("node <> hub")
             .select("node", "hub").distinct())
    stars = materialize(stars, "stars", release=True)
    clusters = connected_components(stars, "node", "hub").withColumnRenamed("component", "cluster")
    # of the rows only those of candidates are shuffled, one per set
    one = F.min_by(F.struct("n", "_text", "_sketch"), "at").alias("one")
    nodes = (rows.select(F.col("_node").alias("node"), F.col(size).alias("n"), "_text", "_sketch", F.col(row).alias("at"))
             .join(_fitting(clusters, 16), "node").groupBy("node", "cluster").agg(one).select("node", "cluster", "one.*"))
    members = (nodes.join(clusters.groupBy("cluster").agg(F.count("*").alias("many")), "cluster")
               .withColumn("blocks", F.ceil(F.col("many") / block).cast("int"))
               .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("many"))
    members = materialize(members, "cluster-members", release=True)
    labels = _links(members, _slices(docs, members, text, n), num, den, forests)
    return rows, row, size, labels.select(F.col("node").alias("_node"), F.col("label").alias("_label"))


BROADCAST_BYTES = 64 << 20


def _fitting(df: DataFrame, width: int) -> DataFrame:
    """``df``, to be broadcast if its rows of about ``width`` bytes are within ``BROADCAST_BYTES``; it is shuffled otherwise."""
    return F.broadcast(df) if df.count() * width <= BROADCAST_BYTES else df


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, num: int = 90, den: int = 100,
                   block: int = 4096, forests: int = 2, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all by default) plus ``n_shingles`` and ``component_id``.

    ``component_id``: the least non-null ``key`` of the rows that links reach from a row, its own for rows without links.
    """
    kept = docs.columns if keep is None else keep
    comp = fresh("component_id", docs.columns)
    rows, _, size, labels = _groups(docs, key, text, n, num, den, block, forests, kept)
    final = _least(rows, size, labels, F.min(key).alias("_low")).select("_node", "_low")
    return rows.join(final, "_node", "left").select(*kept, size, F.coalesce("_low", F.col(key)).alias(comp))


def _least(rows: DataFrame, size: str, labels: DataFrame, aggregate) -> DataFrame:
    """``aggregate`` over the rows of every component, for each of its nodes."""
    sets = rows.filter(F.col(size) > 0)
    own = sets.select("_node").distinct().join(labels, "_node", "left").withColumn("_label", F.coalesce("_label", "_node"))
    own = materialize(own, "components", release=True)
    return own.join(sets.join(own, "_node").groupBy("_label").agg(aggregate), "_label")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, num: int = 90, den: int = 100,
                block: int = 4096, forests: int = 2) -> DataFrame:
    """The rows of ``docs`` without the near-duplicates of rows that stay: of each component, the row with the least
    non-null ``key`` (of several such rows, any one). Rows without words stay."""
    rows, _, size, labels = _groups(docs, key, text, n, num, den, block, forests, [key])
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("_text").alias("text"))
    first = _least(rows, size, labels, F.min(order).alias("first")).select(
        F.col("first.key").alias("_key"), F.col("first.text").alias("_text")).distinct()
    # a row is known by its key and its text; equal rows are one, and texts meet their verdicts in one shuffle
    columns = docs.columns
    named = docs.withColumn("_text", F.md5(F.col(text)))
    chosen = named.join(first, (named["_text"] == first["_text"]) & named[key].eqNullSafe(first["_key"]), "left_semi")
    some = F.col(text).rlike(r"[^\x20\x09-\x0D]")
    return chosen.dropDuplicates(["_text", key]).select(*columns).unionByName(
        docs.filter(~F.coalesce(some, F.lit(False))))


def _slices(docs: DataFrame, members: DataFrame, text: str, n: int) -> DataFrame:
    """Elements of every member's set, by fragment of the global order: node, slice, elements."""

    def cut(batches):
        import pyarrow as pa
        word_hash = Bounded(xxhash.xxh3_64_intdigest, 300_000).__getitem__
        for b in batches:
            owner, part, elements = [], [], []
            for t in b.column(text).to_pylist():
                s = shingles(t, n, word_hash)
                name = set_name(s)
                at = np.searchsorted(s >> np.uint64(61), np.arange(SLICES + 1, dtype=np.uint64))
                for k in range(SLICES):
                    if at[k + 1] > at[k]:
                        owner.append(name)
                        part.append(k)
                        elements.append(s[at[k]:at[k + 1]].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(part, pa.int32()),
                                              pa.array(elements, pa.list_(pa.int64()))],
                                             names=["node", "slice", "elements"])

    # only texts of candidates are shuffled, for their copies to collapse; beyond the broadcast's bound that shuffle serves the join too
    texts = docs.select(F.md5(F.col(text)).alias("_text"), text)
    wanted = _fitting(members.select("_text").distinct(), 64)
    texts = texts.join(wanted, "_text", "left_semi").dropDuplicates(["_text"]).select(text)
    return materialize(texts.mapInArrow(lean(cut), "node long, slice int, elements array<long>"), "slices", release=True)


def _links(members: DataFrame, slices: DataFrame, num: int, den: int, forests: int) -> DataFrame:
    """``node``, ``label`` (least node) of the nodes that have links."""
    spark = members.sparkSession
    labels = spark.createDataFrame([], "node long, label long")
    links = failed = None
    step = 0
    while True:
        forest = step < forests
        state = members.select("cluster", "node", "n", "_sketch", "blocks", "block").join(labels, "node", "left") \
            .withColumn("label", F.coalesce("label", "node"))
        if failed is not None:
            state = state.join(failed.groupBy(F.col("a").alias("node")).agg(F.collect_list("b").alias("failed")), "node", "left")
        else:
            state = state.withColumn("failed", F.lit(None).cast("array<long>"))
        # a task per pair of blocks; the first step of a large cluster meets only the first block, which connects most
        other = F.sequence(F.lit(0), F.col("blocks") - 1) if step else F.array_distinct(
            F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0), F.col("block"))))
        tasks = state.withColumn("other", F.explode(other)).withColumn("lo", F.least("block", "other")) \
            .withColumn("hi", F.greatest("block", "other"))
        open_ = tasks.groupBy("cluster", "lo", "hi").agg(F.min("label").alias("x"), F.max("label").alias("y")) \
            .filter("x <> y").drop("x", "y")
        tasks = tasks.join(open_, ["cluster", "lo", "hi"]).select("cluster", "lo", "hi", "block", "node", "n", "_sketch",
                                                                 "label", "failed")

        def pairs(batches, forest=forest):
            import pyarrow as pa
            out = []
            for g in _grouped(batches, ["cluster", "lo", "hi"]):
                out += propose(*(g.column(c).to_numpy() for c in ("node", "n")), g.column("_sketch").to_pylist(),
                               g.column("label").to_numpy(), g.column("failed").to_pylist(),
                               g.column("block").to_numpy(), num, den, forest)
                if len(out) > 10_000:
                    yield _pair_batch(out)
                    out = []
            yield _pair_batch(out)

        def _pair_batch(out):
            import pyarrow as pa
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

        # dealt by a name that no join is dealt by: a shuffle by the join's own columns is left out, and the join's rows need not stay
        # where they are (a side that is broadcast after all has the other one read by its mappers), which would cut the tasks up
        found = (tasks.withColumn("task", F.xxhash64("cluster", "lo", "hi")).repartition("task").drop("task")
                 .sortWithinPartitions("cluster", "lo", "hi").mapInArrow(lean(pairs), "a long, b long").distinct())
        found = materialize(found, "pairs", release=True)
        if found.isEmpty():
            if step or not _large(members):
                break
            step += 1
            continue
        judged = materialize(_overlaps(found, members, slices, num, den), "overlaps", release=True)
        new, bad = judged.filter("linked").select("a", "b"), judged.filter("not linked").select("a", "b")
        links = new if links is None else links.unionByName(new)
        failed = bad if failed is None else failed.unionByName(bad)
        labels = connected_components(links, "a", "b").withColumnRenamed("component", "label")
        step += 1
        if not forest:
            break
    return labels


def _large(members: DataFrame) -> bool:
    return not members.filter("blocks > 1").isEmpty()


def _overlaps(pairs: DataFrame, members: DataFrame, slices: DataFrame, num: int, den: int) -> DataFrame:
    """Overlap of every pair: counted in each fragment of the order separately, then summed."""
    left = slices.select(F.col("node").alias("a"), "slice", F.col("elements").alias("ea"))
    right = slices.select(F.col("node").alias("b"), "slice", F.col("elements").alias("eb"))
    # the same plan at every size: sets are shuffled to pairs, whichever of them is small
    parts = (pairs.join(left.hint("merge"), "a").join(right.hint("merge"), ["b", "slice"])
             .select("a", "b", F.size(F.array_intersect("ea", "eb")).alias("part")))
    total = parts.groupBy("a", "b").agg(F.sum("part").alias("both"))
    size = members.select("node", "n")
    both = (pairs.join(total, ["a", "b"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
            .join(size.select(F.col("node").alias("a"), F.col("n").alias("na")), "a")
            .join(size.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b"))
    return both.select("a", "b", "both", (den * F.col("both") >= num * (F.col("na") + F.col("nb") - F.col("both"))).alias("linked"))
