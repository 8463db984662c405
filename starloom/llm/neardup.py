"""Similarity join on word n-grams: a forest of MinHash tries, then exact verification.

Texts alike are one class from the start. Each class has a signature of TREES x DEPTH MinHash values, and each of the TREES tries
holds all classes by their label there, DEPTH values long. A trie is its labels in order, dealt by range (the class itself is
the last sort key, so that a label of any number of classes is split): what two neighbours have in common is a path, and a node
of depth x is a run with x values in common. Pairs meet in the deepest nodes first. In how many tries pairs of one
similarity meet tells how many there are and how many of them meet in none, so after the deepest level matched prefixes are shortened,
value by value, until the share that meets somewhere reaches TARGET; the nodes at that depth are joined where they hold classes
of different groups. By then any pair at the threshold has met with that probability at the latest (prefix_length).

Inside a node, pairs whose whole signatures agree too little to be at the threshold are left out, and what remains is joined to
groups; each group is verified exactly, block against block, on the n-gram sets themselves. Pairs are counted where they are
verified and never become rows: a block yields a number of links for each class, and links that span its components. A node or
group of any size is dealt out as pairs of blocks, so no task holds more than two blocks of it.

Defined results: n-grams are sets of `n` consecutive words; a text of fewer words has itself as its only n-gram; a text without
words (null, empty) is alone and has no links. Texts count whole. Classes are told apart by 64-bit hashes of their words. Repeated
rows are copies. n_links counts the other rows, copies too, at the threshold or above. The group of a row is the smallest doc_id
that links reach; of rows with that doc_id, the one whose text has the smallest hash. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm import anchors, repeats
from starloom.llm.common import spread, written
from starloom.llm.substring import word_items
from starloom.operators.components import connected_components

N = 5
THRESHOLD = 0.8
TREES = 20
DEPTH = 6
TARGET = 0.9999
#: Classes of a block, in nodes and in groups.
TREE_BLOCK = 2048
BLOCK = 512
#: Standard deviations that a signature's agreement may lie below the threshold before a pair is left out.
SLACK = 5.0


def meets(s, x: int, trees: int = TREES):
    """Probability that a pair of similarity s has a prefix of x values in common in some tree."""
    return 1 - (1 - s**x) ** trees


def prefix_length(threshold: float, trees: int = TREES, depth: int = DEPTH, target: float = TARGET) -> int:
    """The longest prefix in which a pair at the threshold meets with probability `target`, whatever the data: no shorter one is needed."""
    k = depth
    while k > 1 and meets(threshold, k, trees) < target:
        k -= 1
    return k


def recall(met: dict[int, int], x: int, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH) -> float:
    """The share of pairs that meet in a prefix of x values, from how often pairs met in prefixes of `depth` values.

    met[m] is how often, over all trees, a pair met whose signatures agree in m values: a pair of similarity s does so trees * s^depth times
    on average, so met / (trees * s^depth) is the number of such pairs, those that never met included. Agreement strays around
    the similarity, so pairs one standard deviation below the threshold count too.
    """
    size, pairs, missed = trees * depth, 0.0, 0.0
    for m, n in met.items():
        s = m / size
        if s >= threshold - (threshold * (1 - threshold) / size) ** 0.5:
            n = n / (trees * s**depth)
            pairs, missed = pairs + n, missed + n * (1 - meets(s, x, trees))
    return 1 - missed / pairs if pairs else 1.0


def ngrams(text: bytes, n: int) -> np.ndarray:
    """Hashes of the n-gram set of a text."""
    items = word_items(text)
    return np.unique(anchors.Rolling(items, 0).every(min(n, len(items)))) if len(items) else np.empty(0, np.uint64)


def minhashes(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Signatures, a row for each set (none empty), as 32-bit values."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    factors = np.random.default_rng(11).integers(1, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(sets), size), np.uint32)
    for j, f in enumerate(factors):
        out[:, j] = np.minimum.reduceat(flat * f >> np.uint64(32), starts)
    return out


def signature_rows(n: int, size: int) -> Callable[[Iterator], Iterator]:
    """(id, tag, node, signature): node names the class; null for a text without words."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        def rows(held: list) -> pa.RecordBatch:
            sets = [h[3] for h in held if len(h[3])]
            sig = iter(minhashes(sets, size)) if sets else iter(())
            cols = [h[0] for h in held], [h[1] for h in held], [h[2] for h in held], [next(sig).tobytes() if len(h[3]) else None for h in held]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int64(), pa.binary()), strict=True)], names=["id", "tag", "node", "signature"])

        held, weight = [], 0
        for i, tag, text in repeats.texts(batches):
            words = text.split()
            node = xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63) if words else None
            held.append((i, tag, node, ngrams(text, n)))
            weight += len(words)
            if weight > 100_000 or len(held) >= 1000:
                yield rows(held)
                held, weight = [], 0
        if held:
            yield rows(held)

    return run


def grouped(batches: Iterator, keys: list[str]) -> Iterator:
    """The groups of sorted batches as tables; a group may lie in several batches."""
    import pyarrow as pa

    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        if not t.num_rows:
            continue
        change = np.zeros(t.num_rows - 1, bool)
        for k in keys:
            v = t.column(k).to_numpy()
            change |= v[1:] != v[:-1]
        cut = np.r_[0, np.flatnonzero(change) + 1]
        for a, z in zip(cut[:-1], cut[1:], strict=True):
            yield t.slice(a, z - a)
        held = t.slice(cut[-1]).combine_chunks()
    if held is not None:
        yield held


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the smallest one that the pairs (a, b) connect it with."""
    low = np.arange(n)
    while len(a):
        least = np.minimum(low[a], low[b])
        before = low.copy()
        np.minimum.at(low, low[a], least)
        np.minimum.at(low, low[b], least)
        while (low[low] != low).any():
            low = low[low]
        if (low == before).all():
            break
    return low


def label_names(depth: int) -> list[str]:
    return [f"l{j}" for j in range(-(-depth // 2))]


def label_rows(trees: int, depth: int) -> Callable[[Iterator], Iterator]:
    """(tree, label as longs of two values each, node): a row for each class and tree."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = label_names(depth)
        for b in batches:
            sig = np.frombuffer(b"".join(b.column("signature").to_pylist()), np.uint32).reshape(-1, trees, depth).astype(np.uint64)
            if depth % 2:
                sig = np.concatenate([sig, np.zeros((*sig.shape[:2], 1), np.uint64)], axis=2)
            two = (sig[:, :, ::2] << np.uint64(32) | sig[:, :, 1::2]).view(np.int64).reshape(-1, len(names))
            tree, node = np.tile(np.arange(trees, dtype=np.int32), len(sig)), np.repeat(b.column("node").to_numpy(), trees)
            yield pa.RecordBatch.from_arrays([pa.array(tree), *(pa.array(two[:, j]) for j in range(len(names))), pa.array(node)], names=["tree", *names, "node"])

    return run


def in_common(tree: np.ndarray, labels: np.ndarray, depth: int) -> np.ndarray:
    """How many values each label has in common with the next one."""
    low = np.uint64(0xFFFFFFFF)
    values = np.stack([labels >> np.uint64(32), labels & low], axis=2).reshape(len(labels), -1)[:, :depth]
    same = np.logical_and.accumulate(values[1:] == values[:-1], axis=1)
    return same.sum(axis=1) * (tree[1:] == tree[:-1])


def node_rows(least: int, depth: int) -> Callable[[Iterator], Iterator]:
    """(depth, key, node): the classes of all nodes from depth `least` on that hold two classes at least, from a part of the sorted tries.

    The first and last label of a part may have neighbours in the next one, so they are taken for members of all their nodes.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = label_names(depth)
        held = None

        def rows(tree: np.ndarray, labels: np.ndarray, node: np.ndarray, before: int, after: np.ndarray) -> pa.RecordBatch:
            shared = np.maximum(np.r_[before, after[:-1]], after)
            out = []
            for x in range(least, depth + 1):
                at = np.flatnonzero(shared >= x)
                key = anchors.mixed(tree[at].astype(np.uint64) << np.uint64(8) | np.uint64(x))
                for j in range(-(-x // 2)):
                    part = labels[at, j] if 2 * j + 2 <= x else labels[at, j] >> np.uint64(32)
                    key = anchors.mixed(key ^ part)
                out.append((np.full(len(at), x, np.int32), key.view(np.int64), node[at]))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["depth", "key", "node"])

        for b in batches:
            if not b.num_rows:
                continue
            tree, node = b.column("tree").to_numpy(), b.column("node").to_numpy()
            labels = np.stack([b.column(c).to_numpy().view(np.uint64) for c in names], axis=1)
            before = depth
            if held is not None:
                tree, labels, node, before = np.r_[held[0], tree], np.concatenate([held[1], labels]), np.r_[held[2], node], held[3]
            common = in_common(tree, labels, depth)
            if len(common):
                yield rows(tree[:-1], labels[:-1], node[:-1], before, common)
                before = int(common[-1])
            held = tree[-1:], labels[-1:], node[-1:], before
        if held is not None:
            yield rows(*held, np.array([depth]))

    return run


def alike(sig: np.ndarray, mine: np.ndarray, other: np.ndarray, least: float, once: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of places (mine[i], other[j]) whose signatures agree in the share `least` of their values, and in how many; `once`: mine below other only."""
    out = [(np.empty(0, int),) * 3]
    size = sig.shape[1]
    for at in range(0, len(mine), 64):
        part = mine[at : at + 64]
        same = np.zeros((len(part), len(other)), np.uint16)
        for j in range(size):
            same += sig[part, j][:, None] == sig[other, j][None, :]
        x, y = np.nonzero(same >= least * size)
        if once:
            below = part[x] < other[y]
            x, y = x[below], y[below]
        out.append((part[x], other[y], same[x, y].astype(int)))
    a, b, n = zip(*out, strict=True)
    return np.concatenate(a), np.concatenate(b), np.concatenate(n)


def sides(block: np.ndarray, one: int, two: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of both blocks of a pair."""
    return np.flatnonzero(block == one), np.flatnonzero(block == two)


def met(least: float, size: int) -> Callable[[Iterator], Iterator]:
    """(src, dst, agree, n): links that span what agrees in a pair of blocks of a node; and, without src, how many pairs agreed in how many values."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names, kinds = ["src", "dst", "agree", "n"], (pa.int64(), pa.int64(), pa.int64(), pa.int64())
        seen = np.zeros(size + 1, np.int64)
        for t in grouped(batches, ["key", "one", "two"]):
            node = t.column("node").to_numpy()
            sig = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint32).reshape(-1, size)
            one, two = t.column("one")[0].as_py(), t.column("two")[0].as_py()
            a, b, agree = alike(sig, *sides(t.column("block").to_numpy(), one, two), least, one == two)
            seen += np.bincount(agree, minlength=size + 1)
            top = joined(len(node), a, b)
            moved = np.flatnonzero(top != np.arange(len(node)))
            if len(moved):
                none = pa.nulls(len(moved), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[top[moved]]), none, none], names=names)
        some = np.flatnonzero(seen)
        none = pa.nulls(len(some), pa.int64())
        yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip((none, none, pa.array(some), pa.array(seen[some])), kinds, strict=True)], names=names)

    return run


def block_pairs(rows: DataFrame, sizes: DataFrame, key: str, block: int) -> DataFrame:
    """rows of each key dealt into blocks, and one copy for each pair of blocks that a row belongs to; sizes(key, n)."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    dealt = rows.join(sizes, key).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    with_all = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("block"), o).alias("one"), F.greatest(F.col("block"), o).alias("two")))
    return dealt.withColumn("pair", F.explode(with_all)).select(*rows.columns, "block", F.col("pair")["one"].alias("one"), F.col("pair")["two"].alias("two"))


def together(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.repartition(spread(rows.sparkSession), *keys).sortWithinPartitions(*keys)


def verified(n: int, threshold: float) -> Callable[[Iterator], Iterator]:
    """(node, links, dst): for each class of a pair of blocks, the rows that it links to there and a link of the spanning forest."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        d = zstandard.ZstdDecompressor()
        for t in grouped(batches, ["component", "one", "two"]):
            one, two = t.column("one")[0].as_py(), t.column("two")[0].as_py()
            node, copies = t.column("node").to_numpy(), t.column("copies").to_numpy()
            sets = [ngrams(d.decompress(x), n) for x in t.column("text").to_pylist()]
            mine, other = sides(t.column("block").to_numpy(), one, two)
            a, b = jaccard_pairs(sets, mine, other, threshold)
            if one == two:
                keep = a < b
                a, b = a[keep], b[keep]
            links = np.bincount(a, copies[b], len(node)) + np.bincount(b, copies[a], len(node))
            top = joined(len(node), a, b)
            hit = np.flatnonzero(links)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(links[hit].astype(np.int64)), pa.array(node[top[hit]])], names=["node", "links", "dst"])

    return run


def jaccard_pairs(sets: list[np.ndarray], mine: np.ndarray, other: np.ndarray, threshold: float, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a of mine, b of other, not the same) of sets whose Jaccard similarity reaches the threshold, by products of incidence matrices."""
    length = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), length)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[column] > 1  # what one set has alone adds to no intersection
    _, column = np.unique(column[shared], return_inverse=True)
    row = row[shared]
    common = np.zeros((len(mine), len(other)), np.float32)
    place_a, place_b = np.full(len(sets), -1), np.full(len(sets), -1)
    place_a[mine], place_b[other] = np.arange(len(mine)), np.arange(len(other))
    for at in range(0, int(column.max(initial=-1)) + 1, step):
        here = (column >= at) & (column < at + step)
        a, b = np.zeros((len(mine), step), np.float32), np.zeros((len(other), step), np.float32)
        r, c = row[here], column[here] - at
        left, right = place_a[r] >= 0, place_b[r] >= 0
        a[place_a[r[left]], c[left]] = 1
        b[place_b[r[right]], c[right]] = 1
        common += a @ b.T
    whole = length[mine][:, None] + length[other][None, :] - common
    x, y = np.nonzero(common >= threshold * whole - 1e-6)
    a, b = mine[x], other[y]
    exact = (a != b) & (common[x, y] * 1000 >= threshold * 1000 * whole[x, y] - 1e-6)
    return a[exact], b[exact]


def candidates(classes: DataFrame, threshold: float, trees: int, depth: int, target: float, tree_block: int, report: dict | None) -> DataFrame:
    """(node, component): candidate groups of classes(node, signature) by the forest; only classes that met another one."""
    spark, size, floor = classes.sparkSession, trees * depth, prefix_length(threshold, trees, depth, target)
    least = threshold - SLACK * (threshold * (1 - threshold) / size) ** 0.5
    order = ["tree", *label_names(depth), "node"]
    labels = classes.mapInArrow(label_rows(trees, depth), ", ".join(["tree int", *(f"{c} long" for c in label_names(depth)), "node long"]))
    tries = labels.repartitionByRange(spread(spark), *order).sortWithinPartitions(*order)
    nodes = written(tries.mapInArrow(node_rows(floor, depth), "depth int, key long, node long"))

    def met_at(members: DataFrame, several: DataFrame) -> DataFrame:
        # Written, so that Spark shuffles both sides of the join by key and can split a hot one.
        pairs = block_pairs(members, written(several), "key", tree_block).join(classes, "node")
        return written(together(pairs, ["key", "one", "two"]).mapInArrow(met(least, size), "src long, dst long, agree long, n long"))

    deepest = nodes.where(F.col("depth") == depth).select("key", "node")
    found = met_at(deepest, deepest.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    seen = {r["agree"]: r["n"] for r in found.where("agree IS NOT NULL").groupBy("agree").agg(F.sum("n").alias("n")).collect()}
    x = depth
    while x > floor and recall(seen, x, threshold, trees, depth) < target:
        x -= 1
    if report is not None:
        report |= {"prefix": x, "recall": recall(seen, x, threshold, trees, depth)}
    links = found.where("src IS NOT NULL").select("src", "dst")
    groups = written(connected_components(links))
    if x == depth:
        return groups
    # Shorter prefixes bring something new only where a node holds classes of different groups.
    members = nodes.where(F.col("depth") == x).select("key", "node").join(groups, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    several = members.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key", "n")
    more = met_at(members.select("key", "node"), several).where("src IS NOT NULL").select("src", "dst")
    group_of = lambda end: groups.select(F.col("node").alias(end), F.col("component").alias(f"{end}_group"))
    between = more.join(group_of("src"), "src", "left").join(group_of("dst"), "dst", "left").select(F.coalesce("src_group", "src").alias("src"), F.coalesce("dst_group", "dst").alias("dst")).where("src <> dst")
    merged = connected_components(between).withColumnsRenamed({"node": "group", "component": "into"})
    old = groups.unionByName(more.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(groups, "node", "left_anti").withColumn("component", F.col("node")))
    return written(old.join(merged, F.col("component") == F.col("group"), "left").select("node", F.coalesce("into", "component").alias("component")))


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, target: float = TARGET, tree_block: int = TREE_BLOCK, block: int = BLOCK, report: dict | None = None) -> DataFrame:
    """(id, tag, group, group_tag, n_links, copies) for each row of docs; id and tag as in repeats.keyed().

    report, if given, gets the prefix length at which the forest stopped and the recall estimated there.
    """
    size = trees * depth
    rows = written(repeats.text_rows(docs).mapInArrow(signature_rows(n, size), "id long, tag binary, node long, signature binary"))
    at = F.struct("id", "tag")
    classes = written(rows.where("node IS NOT NULL").groupBy("node").agg(F.min(at).alias("first"), F.count("*").alias("copies")))
    one_each = rows.join(classes.select("node", "first"), "node").where((F.col("id") == F.col("first")["id"]) & (F.col("tag") == F.col("first")["tag"])).select("node", "signature").dropDuplicates(["node"])
    groups = candidates(written(one_each), threshold, trees, depth, target, tree_block, report)
    sizes = groups.groupBy("component").agg(F.count("*").alias("n"))
    texts = repeats.packed(docs)
    first = classes.join(groups, "node").select("node", "component", "copies", F.col("first")["id"].alias("id"), F.col("first")["tag"].alias("tag"))
    asked = texts.join(first, ["id", "tag"]).dropDuplicates(["node"]).select("node", "component", "copies", "text")
    checked = written(together(block_pairs(asked, sizes, "component", block), ["component", "one", "two"]).mapInArrow(verified(n, threshold), "node long, links long, dst long"))
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    linked = connected_components(checked.select(F.col("node").alias("src"), "dst"))
    named = classes.join(links, "node", "left").join(linked, "node", "left").select("node", "copies", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component"))
    top = named.groupBy("component").agg(F.min("first").alias("top"))
    result = named.join(top, "component").select("node", "copies", (F.col("links") + F.col("copies") - 1).alias("n_links"), "top")
    out = rows.select("id", "tag", "node").join(result, "node", "left")
    alone = F.struct("id", "tag")
    return out.select("id", "tag", F.coalesce(F.col("top")["id"], alone["id"]).alias("group"), F.coalesce(F.col("top")["tag"], alone["tag"]).alias("group_tag"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the group), n_links, copies (rows with the same words)."""
    j = join(docs)
    return j.select(F.nullif("id", F.lit(repeats.NO_ID)).alias("doc_id"), F.nullif("group", F.lit(repeats.NO_ID)).alias("class_id"), "n_links", "copies")


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with one row of each group: the one with the smallest doc_id. Rows without words stay, repeated rows once."""
    keep = join(docs).where("id = group AND tag = group_tag").select("id", "tag").distinct()
    keyed = repeats.keyed(docs, F.struct(*docs.columns).alias("row"))
    return keyed.join(keep, ["id", "tag"]).dropDuplicates(["id", "tag"]).select("row.*")
