"""N-gram Jaccard join: MinHash banding, a shuffle on band hashes, verification on the full n-gram sets.

Documents with equal n-gram sets are one node. Every band bucket has a leader, another one in each of the buckets that the
same nodes share, and each member is verified against the leader, so a bucket of k members costs k pairs. Members of a
bucket that are still in different components are then held against its member of most links, and what stays apart is
joined by prefix filtering over the rarest n-grams, which finds every remaining link without forming a bucket's pairs.
The links of a class are then counted exactly: its n-gram sets meet block against block, and only sums per node leave a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablebridge.llm.common import bounded_broadcast, hot_keys, split_join, stored

NGRAM = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.9999
MAX_HASHES = 256
#: Ids with text hashes that may be broadcast: 16 MB of numbers.
BROADCAST_IDS = 1_000_000
#: Nodes, and n-grams, that a block of a class holds on average at most; columns of n-grams that are multiplied at once.
BLOCK_NODES, BLOCK_GRAMS, COLUMNS = 256, 1 << 20, 4096
_MIX = np.uint64(0x9E3779B97F4A7C15)


def plan_bands(threshold: float = THRESHOLD, recall: float = TARGET_RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows for which enough bands for the recall at the threshold fit into max_hashes."""
    best = (max_hashes, 1)
    for rows in range(1, max_hashes + 1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - hit))
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    return best


class _Words(dict):
    """64-bit hashes of words; cleared when it holds too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, hashes: dict, n: int = NGRAM) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of the lower-cased text; a shorter text is one shingle."""
    words = (text or "").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = (out ^ h[i : len(h) - n + 1 + i]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def minhash(grams: np.ndarray, masks: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least 32-bit hash under each of the hash functions."""
    x = (grams >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(masks), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        part = x[None, i : i + 1024] ^ masks[:, None]
        part *= factors[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return low


def signatures(docs: DataFrame, n: int = NGRAM, bands: int = 31, rows: int = 6, seed: int = 7) -> DataFrame:
    """doc_id, text_hash, node (digest of the shingle set), n_grams, keys (a 64-bit hash per band)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        masks = rng.integers(0, 2**32, bands * rows, np.uint32)
        factors = rng.integers(0, 2**31, bands * rows, np.uint32) * np.uint32(2) + np.uint32(1)
        hashes = _Words()
        for batch in batches:
            nodes, sizes, keys = [], [], []
            for text in batch.column("text").to_pylist():
                grams = shingles(text, hashes, n)
                nodes.append(xxhash.xxh128_hexdigest(grams.tobytes()))
                sizes.append(len(grams))
                if not len(grams):
                    keys.append(None)
                    continue
                low = minhash(grams, masks, factors).astype(np.uint64).reshape(bands, rows)
                key = np.arange(1, bands + 1, dtype=np.uint64) * _MIX
                for i in range(rows):
                    key = (key ^ low[:, i]) * _MIX
                    key ^= key >> np.uint64(31)
                keys.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(nodes, pa.string()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "node", "n_grams", "keys"],
            )

    source = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, text_hash long, node string, n_grams long, keys array<long>")


def gram_sets(docs: DataFrame, n: int = NGRAM) -> DataFrame:
    """node, grams array<long>: the full n-gram set of each node among docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Words()
        for batch in batches:
            sets = [shingles(text, hashes, n) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh128_hexdigest(x.tobytes()) for x in sets], pa.string()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))],
                ["node", "grams"],
            )

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "node string, grams array<long>")


def verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (a, b) those whose n-gram sets have at least that Jaccard similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("grams").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    # a leader meets every member of its bucket: its pairs are shared among tasks
    joined = split_join(split_join(pairs, left, "a", "b"), right, "b", "a", hot_keys(pairs.groupBy("b").count(), "b", "count", pairs.count())).select("a", "b", both.alias("both"), (F.size("x") + F.size("y")).alias("total"))
    return joined.where(F.col("both") >= threshold * (F.col("total") - F.col("both")) - 1e-9).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for the nodes of edges (a, b): large-star and small-star steps, each pair of them written to the shared folder, until every edge leads to the least node."""

    def with_least(df: DataFrame, rows: int) -> DataFrame:
        """df with m, the least of u and its neighbours; the rows of a node with very many are shared among tasks."""
        low = df.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        return split_join(df, low.drop("n"), "u", "v", hot_keys(low, "u", "n", rows))

    def stars(df: DataFrame) -> bool:
        """No node has two edges downwards, or edges both ways."""
        ends = df.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))).alias("e"))
        odd = ends.groupBy("e.x").agg(F.sum("e.down").alias("down"), F.max("e.up").alias("up")).where("down > 1 OR (down > 0 AND up > 0)")
        return odd.agg(F.count("*")).first()[0] == 0

    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while not stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges_now = now.count()
        large = with_least(both, 2 * edges_now).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = with_least(large, edges_now).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = stored(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, component) after further links (a, b): only the components that the links join are worked on."""
    ends = links.join(labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(labels.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    joined = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    again = labels.join(joined.select(F.col("node").alias("component"), F.col("component").alias("lower")), "component", "left").select("node", F.coalesce("lower", "component").alias("component"))
    return stored(again.union(joined.join(labels, "node", "left_anti")), "labels")


def _prefix_pairs(mixed: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of nodes of different components that can reach the threshold, by prefix filtering over n-grams in order of rarity.

    The smaller node's index prefix and the larger one's probe prefix share their first common n-gram, and after its places
    enough n-grams must be left in both. At each n-gram the nodes of its most frequent component are not paired among themselves.
    """
    own = mixed.select("node", "component").distinct().join(sets, "node")
    grams = stored(own.select("node", "component", F.size("grams").alias("n"), F.explode("grams").alias("gram")), "grams")
    often = grams.groupBy("gram", "component").agg(F.count("*").alias("k")).groupBy("gram").agg(F.sum("k").alias("often"), F.max(F.struct("k", "component"))["component"].alias("modal"), F.count("*").alias("kinds"))
    entry = F.struct("often", "gram", (F.col("kinds") > 1).alias("crosses"), (F.col("component") != F.col("modal")).alias("minor"))
    ordered = grams.join(often, "gram").groupBy("node", "component", "n").agg(F.sort_array(F.collect_list(entry)).alias("by"))
    part = 2 * threshold / (1 + threshold)
    probe = F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1
    index = F.col("n") - F.ceil(part * F.col("n") - 1e-9) + 1
    rows = ordered.select("node", "component", "n", index.alias("index"), F.posexplode(F.slice("by", F.lit(1), probe.cast("int"))).alias("pos", "g"))
    rows = stored(rows.where("g.crosses").select("g.gram", "g.minor", "node", "component", "n", "pos", (F.col("pos") < F.col("index")).alias("indexed")), "prefix")
    a, b = rows.where("indexed").alias("a"), rows.alias("b")
    needed = F.ceil(threshold / (1 + threshold) * (F.col("a.n") + F.col("b.n")) - 1e-9)
    fits = (F.col("a.n") <= F.col("b.n")) & (F.col("a.n") >= threshold * F.col("b.n") - 1e-9) & (F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos")) >= needed)
    on = (F.col("a.gram") == F.col("b.gram")) & fits & (F.col("a.component") != F.col("b.component"))
    found = [x.join(y, on).select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")) for x, y in ((a.where("minor"), b), (a.where("NOT minor"), b.where("minor")))]
    return found[0].union(found[1]).distinct()


def _mixed(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of those buckets (key, node, n) that hold several components: key, node, n, component."""
    placed = buckets.join(labels, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("component"))
    split = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members")).where("low < high").select("key", "members")
    split = stored(split, "split")
    total = split.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    return stored(split_join(placed, split.select("key"), "key", "node", hot_keys(split, "key", "members", total)).select("key", "node", "n", "component"), "mixed")


def _hub_pairs(mixed: DataFrame, links: DataFrame, threshold: float) -> DataFrame:
    """Each bucket's members against its member of most links, where they are in another component."""
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    ranked = mixed.join(degree, "node", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    hubs = ranked.groupBy("key").agg(F.max(F.struct("links", "node", "n", "component")).alias("hub"), F.count("*").alias("members"))
    hubs = stored(hubs, "hubs")
    fits = F.least("n", "hub.n") >= threshold * F.greatest("n", "hub.n") - 1e-9
    pairs = split_join(mixed, hubs.drop("members"), "key", "node", hot_keys(hubs, "key", "members", mixed.count())).where((F.col("component") != F.col("hub.component")) & fits)
    return pairs.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()


def _shared_grams(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """[left, right]: how many n-grams each two sets share; without right those of left among themselves."""
    both = left + (right or [])
    row = np.repeat(np.arange(len(both)), [len(x) for x in both])
    _, at, often = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    some = often[at] > 1
    row, at = row[some], (np.cumsum(often > 1) - 1)[at[some]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    out = np.zeros((len(left), len(both) - len(left) if right else len(left)))
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
        own = slice(*np.searchsorted(at, [low, low + COLUMNS]))
        ones = np.zeros((len(both), min(COLUMNS, int(at[-1]) + 1 - low)), np.float32)
        ones[row[own], at[own] - low] = 1
        out += ones[: len(left)] @ (ones[len(left) :] if right else ones).T
    return out


def _cell_degrees(sides: np.ndarray, copies: np.ndarray, grams: list[np.ndarray], threshold: float) -> np.ndarray:
    """For each node of a cell the documents that it is linked to there: nodes of side 0 are held against those of side 1, those of side 2 (a block alone) against each other."""
    out = np.zeros(len(grams), np.int64)
    alone = sides[0] == 2
    left = np.flatnonzero(sides != 1)
    right = left if alone else np.flatnonzero(sides == 1)
    if not len(left) or not len(right):
        return out
    size = np.fromiter(map(len, grams), np.int64, len(grams))
    both = _shared_grams([grams[i] for i in left], None if alone else [grams[i] for i in right])
    linked = both >= threshold * (size[left][:, None] + size[right][None, :] - both) - 1e-9
    if alone:
        np.fill_diagonal(linked, False)
    else:
        out[right] = linked.T.astype(np.int64) @ copies[left]
    out[left] = linked.astype(np.int64) @ copies[right]
    return out


def linked_copies(members: DataFrame, sets: DataFrame, threshold: float, block_nodes: int = BLOCK_NODES, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """node, links: the documents of other nodes of its component whose n-gram sets reach the threshold, for members (node, component, copies).

    A class of more than a block is cut into size bands, of which only equal and neighbouring ones can hold links, and
    these by hash into blocks. A cell is a pair of blocks, or a block alone, so a node is sent once for each block that it meets.
    """
    own = members.join(sets, "node").select("node", "component", "copies", F.size("grams").cast("long").alias("n"), "grams")
    own = stored(own, "members")
    whole = own.groupBy("component").agg(F.count("*").alias("nodes"), F.sum("n").alias("total")).where("nodes > 1")
    small = (F.col("nodes") <= block_nodes) & (F.col("total") <= block_grams)
    band = F.when(small, 0).otherwise(F.floor(F.log(F.col("n").cast("double")) / math.log(1 / threshold) + 1e-9)).cast("int")
    banded = own.drop("grams").join(whole, "component").select("node", "component", "n", band.alias("band"))
    per = banded.groupBy("component", "band").agg(F.greatest(F.ceil(F.count("*") / block_nodes), F.ceil(F.sum("n") / block_grams)).cast("int").alias("blocks"))
    per = stored(per, "bands")
    table = per.groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("band", "blocks"))).alias("blocks"))
    placed = banded.join(table, "component").withColumn("block", F.pmod(F.xxhash64("node", F.lit(17)), F.element_at("blocks", F.col("band"))).cast("int"))
    same = F.transform(F.sequence(F.lit(0), F.element_at("blocks", F.col("band")) - 1), lambda j: F.struct(F.col("band").alias("la"), F.least("block", j).alias("i"), F.col("band").alias("lb"), F.greatest("block", j).alias("j"), F.when(F.col("block") == j, 2).otherwise((F.col("block") > j).cast("int")).alias("side")))

    def across(step: int) -> Column:
        other = F.coalesce(F.try_element_at("blocks", F.col("band") + step), F.lit(0))
        mine, side = (F.col("band"), F.col("block")), 0 if step > 0 else 1

        def cell(j: Column) -> Column:
            a, b = (mine, (F.col("band") + step, j)) if step > 0 else ((F.col("band") + step, j), mine)
            return F.struct(a[0].alias("la"), a[1].alias("i"), b[0].alias("lb"), b[1].alias("j"), F.lit(side).alias("side"))

        return F.when(other > 0, F.transform(F.sequence(F.lit(0), F.greatest(other - 1, F.lit(0))), cell)).otherwise(F.filter(same, lambda x: F.lit(False)))

    cells = placed.select("node", "component", F.explode(F.concat(same, *map(across, (-1, 1)))).alias("c"))
    key = F.concat_ws(":", "component", "c.la", "c.i", "c.lb", "c.j")
    sent = cells.select("node", key.alias("cell"), F.col("c.side").alias("side")).join(own.select("node", "copies", "grams"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sides, copies, grams = None, [], [], [], []

        def told() -> pa.RecordBatch:
            links = _cell_degrees(np.array(sides), np.array(copies, np.int64), grams, threshold)
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array(links)], ["node", "links"])

        for batch in batches:
            lists = batch.column("grams")
            values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for i, (cell, node, side, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("cell", "node", "side", "copies")), strict=True)):
                if cell != now:
                    if len(nodes) > 1:
                        yield told()
                    now, nodes, sides, copies, grams = cell, [], [], [], []
                nodes.append(node)
                sides.append(side)
                copies.append(n)
                grams.append(values[ends[i] : ends[i + 1]])
        if len(nodes) > 1:
            yield told()

    dealt = sent.select("cell", "node", "side", "copies", "grams").repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(run, "node string, links long").groupBy("node").agg(F.sum("links").alias("links"))


def ngram_join(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, recall: float = TARGET_RECALL, max_hashes: int = MAX_HASHES) -> DataFrame:
    """Near-duplicate classes of documents (doc_id, text).

    One row per row of docs: doc_id, of any type that can be ordered; class_id, the least doc_id of the documents linked to it directly or through
    others; n_links, the other documents of the class that it is linked to directly, those of the same n-gram set included; n_grams.
    A link is a Jaccard similarity of n-word shingle sets (lower-cased, split at white space) of at least threshold; a
    text of fewer than n words is one shingle. Null and empty texts have no shingles, equal each other and nothing
    else. Rows of null doc_id are linked like others; a class of such rows alone has a null class_id. Repeated rows are copies, an empty table gives none. Bands and rows are chosen for the recall at the threshold. Other columns of docs are ignored.
    """
    return classes(docs, threshold, n, recall, max_hashes).select("doc_id", "class_id", "n_links", "n_grams")


def classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, recall: float = TARGET_RECALL, max_hashes: int = MAX_HASHES, count_links: bool = True) -> DataFrame:
    """ngram_join with component and text_hash: a component is one class, also where ids are null or repeated, and rows of equal doc_id and text_hash are copies.

    A caller that needs the classes alone may leave the links uncounted: the classes are the same, and n_links is null.
    """
    bands, rows = plan_bands(threshold, recall, max_hashes)
    signed = stored(signatures(docs, n, bands, rows), "signatures")
    one = F.min(F.struct("doc_id", "text_hash")).alias("one")  # a row that stands for the node
    nodes = signed.groupBy("node").agg(F.min("doc_id").alias("first_id"), one, F.count("*").alias("copies"), F.first("n_grams").alias("n"), F.first("keys").alias("keys"))
    nodes = stored(nodes, "nodes")
    posted = nodes.select("node", "n", F.explode("keys").alias("key"))
    lead = F.min(F.struct(F.xxhash64("node", "key").alias("h"), "node", "n")).alias("lead")  # another leader in each of the buckets that the same nodes share
    buckets = stored(posted.groupBy("key").agg(lead, F.count("*").alias("members")).where("members > 1"), "leaders")
    hot = hot_keys(buckets, "key", "members", nodes.count() * bands)
    shared = stored(split_join(posted, buckets, "key", "node", hot).select("key", "members", "node", "n", F.col("lead.node").alias("leader"), F.col("lead.n").alias("leader_n")), "buckets")

    near = shared.where("node <> leader").where(F.least("n", "leader_n") >= threshold * F.greatest("n", "leader_n") - 1e-9)
    pairs = stored(near.select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct(), "pairs")
    wanted = stored(shared.select("node").distinct().join(nodes.select("node", "one"), "node").select(F.col("one.doc_id").alias("one_id"), F.col("one.text_hash").alias("one_hash")), "wanted")
    wanted = bounded_broadcast(wanted, BROADCAST_IDS)
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("one_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("one_hash")), "left_semi")
    sets = stored(gram_sets(texts, n).dropDuplicates(["node"]), "sets")
    links = stored(verify(pairs, sets, threshold), "links")
    labels = components(links)
    mixed = shared.where("members > 2")
    for more in (_hub_pairs, None):
        mixed = _mixed(mixed.select("key", "node", "n"), labels)  # components only grow: no other bucket is split again
        if mixed.isEmpty():
            break
        new = more(mixed, links, threshold) if more else _prefix_pairs(mixed, sets, threshold)
        new = stored(new.join(pairs, ["a", "b"], "left_anti"), "pairs")
        pairs = pairs.union(new)
        new = stored(verify(new, sets, threshold), "links")
        links = links.union(new)
        labels = merged(labels, new)

    told = nodes.select("node", "first_id", "copies").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    n_links = F.lit(None).cast("long")
    if count_links:
        told = told.join(linked_copies(labels.join(nodes.select("node", "copies"), "node"), sets, threshold), "node", "left")
        n_links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    told = stored(told, "told")
    least = stored(told.groupBy("component").agg(F.min("first_id").alias("class_id"), F.count("*").alias("nodes")), "least")
    hot = hot_keys(least, "component", "nodes", told.count())
    told = stored(split_join(told, least.drop("nodes"), "component", "node", hot).select("node", "component", "class_id", n_links.alias("n_links"), "copies"), "told")
    rows_ = signed.select("doc_id", "text_hash", "node", "n_grams")
    return split_join(rows_, told.drop("copies"), "node", "doc_id", hot_keys(told, "node", "copies", signed.count())).select("doc_id", "text_hash", "component", "class_id", "n_links", "n_grams")
