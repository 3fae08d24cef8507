"""N-gram Jaccard self-join by a token-group matrix, for components of near-duplicate documents.

1.  Each text becomes a set of shingle hashes; texts with the same set are one node.
2.  Keys of a node are its first shingles by hash: as many as a partner may lack, and a few more.
    Two sets over the threshold share at least those few: of the set whose keys end first, a
    partner lacks too few to miss more, and what both have before that end is a key of both.
3.  Groups: the leader of a key is its node with the best connected keys.  Each node joins the
    leader it shares most keys with, if their exact similarity reaches the threshold; the
    components of these links are the groups.
4.  Nodes with as many keys as a partner would share in keys that several groups have stay open.
    For them the matrix holds, by group, the union of its members' shingles.  A node's partner in
    another group has all but a few of its shingles, so its rarest ones bound the overlap: those
    in no other group's union come first, then the others, fewest nodes first.  If a union lacks
    all of the first n - ceil(share * n) + 1, that group stays closed for the node.  Two nodes are
    asked about at the first shingle they share in that order: what a node has before it, the other
    lacks, which bounds their similarity from above.
5.  The members of open groups that have such a shingle among their own first are compared exactly;
    the links join the groups.

Nodes within a group are never paired with each other: what they would add, their component has.
A key or shingle that very many nodes hold is counted by partial sums and joined back, so Spark can split it;
the nodes to compare with one leader are dealt out by hands of HAND, each with one copy of the leader's set.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.llm.arrays import U64, distinct, mix, prefix_hash, shingles, slices, span_hash, spread, words
from engram.llm.tables import discard, stage, unused

#: Nodes compared with one copy of another's set.
HAND = 256
#: Digests shared by different sets that are looked after; more than chance ever gives.
CLASHES = 10_000


@dataclass(frozen=True)
class Threshold:
    """Two sets link when over * |both| >= of * |either|, for instance 100 and 85."""

    k: int = 5
    of: int = 80
    over: int = 100

    def least(self, size: np.ndarray) -> np.ndarray:
        """Shingles that a set shares with a partner at least, and the size of its smallest partner."""
        return -(-size * self.of // self.over)

    def classes(self, largest: int) -> tuple[np.ndarray, np.ndarray]:
        """Lowest sizes of the classes, up to sets of the largest size, and the keys that partners in each share at least."""
        low = np.concatenate([[1], np.arange(16, largest + 16, 16)])
        return low, np.arange(1, len(low) + 1)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and their offsets."""
    s, e, d = words(data, offs)
    h, at = shingles(span_hash(prefix_hash(data, lower=True), s, e), d, len(offs) - 1, k)
    return distinct(h, at, len(offs) - 1)


def node_ids(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set, as signed numbers; 0 for an empty set."""
    docs = len(bounds) - 1
    full = np.flatnonzero(np.diff(bounds))
    out = []
    for salt in (11, 12):
        x = np.zeros(docs, U64)
        if len(full):
            x[full] = mix(np.add.reduceat(mix(h, salt), bounds[full]), salt)
        out.append(x.view(np.int64))
    return out[0], out[1]


def numbers(h: np.ndarray, bounds: np.ndarray, clashes: np.ndarray) -> np.ndarray:
    """The number of each set: its first digest, and where two different sets have that one, a mix of both digests."""
    return _apart(*node_ids(h, bounds), clashes)


def _apart(node: np.ndarray, check: np.ndarray, clashes: np.ndarray) -> np.ndarray:
    hit = np.isin(node, clashes) if len(clashes) else np.zeros(len(node), bool)
    return np.where(hit, mix(node.view(U64) ^ mix(check.view(U64), 13), 14).view(np.int64), node) if hit.any() else node


def part_keys(h: np.ndarray, bounds: np.ndarray, t: Threshold) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of each set, the index of their set, and how many of them each set shares with any partner at least."""
    size = np.diff(bounds)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(size), np.int64)
    low, asked = t.classes(int(size.max()))
    share = lambda n: asked[np.maximum(np.searchsorted(low, n, "right") - 1, 0)]
    n = np.where(size > 0, size - t.least(size) + share(size), 0)
    return h[spread(bounds[:-1], n)].view(np.int64), np.repeat(np.arange(len(size)), n), share(t.least(size))


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each node's component, for edges (a, b) of long.

    Smallest labels spread over the edges and jump from label to label, so the rounds grow with
    the logarithm of a component's width.  Each round is written to the shared folder.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        far = labels.select(F.col("node").alias("b"), F.col("root").alias("near"))
        spread_ = both.join(far, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        nearer = labels.join(spread_, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("jump"))
        nearer = nearer.join(jump, "root", "left").select("node", F.least("root", F.coalesce("jump", "root")).alias("root"), "was")
        nearer = stage(nearer, "labels")
        discard(labels)
        if nearer.where("root <> was").isEmpty():
            discard(both)
            return nearer
        labels = nearer


def _linked(pairs: DataFrame, texts: DataFrame, t: Threshold) -> DataFrame:
    """The pairs (a, b) of nodes whose texts (node, text) link.

    Texts cross the network, not their sets: they compress, hashes don't.
    """
    load = pairs.groupBy("b").agg(F.ceil(F.count("*") / HAND).cast("int").alias("hands"))
    hand = F.pmod(F.xxhash64("a"), F.col("hands")).cast("int")
    mine = pairs.join(load, "b").select("b", hand.alias("hand"), "a").join(texts.select(F.col("node").alias("a"), "text"), "a")
    theirs = load.join(texts.select(F.col("node").alias("b"), "text"), "b")
    theirs = theirs.select("b", F.explode(F.sequence(F.lit(0), F.col("hands") - 1)).alias("hand"), F.lit(None).cast("long").alias("a"), "text")
    dealt = mine.unionByName(theirs).repartition("b", "hand").sortWithinPartitions("b", "hand", F.asc_nulls_first("a"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, theirs = None, np.zeros(0, U64)
        for rows, data, offs in slices(batches, 3):
            linked = []
            h, bounds = shingle_sets(data, offs, t.k)
            for i, (b, hand, a) in enumerate(zip(*(rows.column(c).to_pylist() for c in range(3)), strict=True)):
                own = h[bounds[i] : bounds[i + 1]]
                if a is None:
                    key, theirs = (b, hand), own.copy()
                    continue
                if (b, hand) != key:
                    raise ValueError("a set to compare with is missing")
                at = np.minimum(np.searchsorted(theirs, own), len(theirs) - 1)
                both = int((theirs[at] == own).sum())
                if t.over * both >= t.of * (len(own) + len(theirs) - both):
                    linked.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in linked], pa.int64()) for j in (0, 1)], ["a", "b"])

    return dealt.select("b", "hand", "a", "text").mapInArrow(compare, "a long, b long")


def _components_of_rows(docs: DataFrame, t: Threshold, id_col: str, text_col: str) -> tuple[DataFrame, np.ndarray]:
    """id, n, node, root, component_id of each row: jaccard_components with the numbers of the row's set and component.

    And the digests that different sets share: of 10 ** 10 sets about three.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in slices(batches, 1):
            h, bounds = shingle_sets(data, offs, t.k)
            a, b = node_ids(h, bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(a), pa.array(b)], ["id", "n", "node", "check"])

    def unseen(node: np.ndarray, seen: set[int]) -> np.ndarray:
        """Whether each node is met for the first time; copies met by one task count once."""
        new = np.zeros(len(node), bool)
        for i, v in enumerate(node.tolist()):
            if v not in seen:
                new[i] = True
                seen.add(v)
        return new

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, data, offs in slices(batches, 1):
            h, bounds = shingle_sets(data, offs, t.k)
            node = numbers(h, bounds, clashes)
            key, at, need = part_keys(h, bounds, t)
            mine = unseen(node, seen)[at]
            key, at = key[mine], at[mine]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node[at]), pa.array(need[at], pa.int32())], ["key", "node", "need"])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([pa.array(numbers(*shingle_sets(data, offs, t.k), clashes)), batch.column(1)], ["node", "text"])

    digests = stage(rows.mapInArrow(digest, "id long, n long, node long, check long"), "digests")
    some = digests.where("n > 0 AND id IS NOT NULL")
    twice = some.groupBy("node").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).where("lo < hi").select("node")
    clashes = np.array([r["node"] for r in twice.take(CLASHES + 1)], np.int64)
    if len(clashes) > CLASHES:
        raise RuntimeError("far more sets share a digest than chance gives")
    if len(clashes):

        def renumber(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                node = _apart(batch.column(2).to_numpy(), batch.column(3).to_numpy(), clashes)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(node), batch.column(3)], batch.schema.names)

        digests = digests.mapInArrow(renumber, "id long, n long, node long, check long")
        some = digests.where("n > 0 AND id IS NOT NULL")
    copies = some.groupBy("node", "id").agg(F.count("*").alias("copies"))
    nodes = copies.groupBy("node").agg(F.min(F.struct("id", "copies")).alias("first"))
    # a row that is repeated with id and text gives its set again
    nodes = stage(nodes.select("node", F.col("first.id").alias("id"), (F.col("first.copies") > 1).alias("again")), "nodes")

    # rows of the matrix whose key two nodes or more have
    matrix = rows.where("id IS NOT NULL").mapInArrow(keys_of, "key long, node long, need int")
    held = matrix.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("m")).where("low < high")
    shared = stage(matrix.join(held.select("key", "m"), "key"), "shared")
    # a node with fewer shared keys than a partner would share has no partner
    own = Window.partitionBy("node")
    ties = shared.withColumns({"ties": F.sum("m").over(own), "keys": F.count("*").over(own)}).where("keys >= need").select("key", "node", "need", "ties")
    lead = ties.groupBy("key").agg(F.max(F.struct("ties", "node")).alias("lead")).select("key", F.col("lead.node").alias("lead"))
    leads = stage(ties.drop("ties").join(lead, "key"), "leads")
    discard(shared)
    stars = stage(leads.where("node <> lead").groupBy("node", "lead").count(), "stars")
    best = stars.groupBy("node").agg(F.max(F.struct("count", (-F.col("lead")).alias("lead"))).alias("m"))
    best = stage(best.select(F.col("node").alias("a"), (-F.col("m.lead")).alias("b")), "best")

    # texts of all nodes that share keys; of an id with several texts, all of them
    wanted = nodes.join(leads.select("node").distinct(), "node").select("id").distinct()
    texts = stage(rows.join(wanted, "id", "left_semi").select("id", "text").mapInArrow(numbered, "node long, text string"), "texts", "zstd")
    links = stage(_linked(best, texts, t), "links")
    groups = components(links)
    discard(links)

    def group_of(df: DataFrame, node: str, name: str) -> DataFrame:
        """df with the group of its nodes: the component's root, or the node alone."""
        found = df.join(groups.select(F.col("node").alias(node), F.col("root").alias(name)), node, "left")
        return found.withColumn(name, F.coalesce(name, node))

    # keys whose nodes aren't all of one group, and the nodes with enough of them
    loose = group_of(group_of(stars.select("node", "lead"), "node", "g"), "lead", "h").where("g <> h")
    keys = leads.join(loose.select("node", "lead"), ["node", "lead"], "left_semi").select("key").distinct()
    open_nodes = leads.join(keys, "key", "left_semi").select("node", "need", "key").distinct().groupBy("node", "need").count().where("count >= need")
    open_nodes = stage(group_of(open_nodes.select("node"), "node", "g").join(nodes.select("node", "again"), "node"), "open")
    discard(leads, stars)

    def open_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in slices(batches, 2):
            h, bounds = shingle_sets(data, offs, t.k)
            n = np.diff(bounds)
            of = np.repeat(np.arange(len(n)), n)
            take = lambda c: rows.column(c).take(pa.array(of))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([take(0), take(1), pa.array(n[of], pa.int32()), pa.array(h.view(np.int64))], ["node", "g", "n", "token"])

    held = texts.join(open_nodes, "node")
    held = held.where("NOT again").select("node", "g", "text").unionByName(held.where("again").dropDuplicates(["node"]).select("node", "g", "text"))
    union = held.mapInArrow(open_tokens, "node long, g long, n int, token long")
    spread_ = union.groupBy("token").agg(F.min("g").alias("g0"), F.max("g").alias("g1"), F.count("*").alias("df")).where("g0 < g1").select("token", "df")
    common = union.join(spread_, "token")
    # of n shingles a node needs the first n - ceil(share * n) + 1; those of its group alone come before the common ones
    order = own.orderBy("df", "token")
    first_ones = common.withColumns({"c": F.count("*").over(own), "at": F.row_number().over(order)}).where(F.col("at") <= F.col("c") - F.ceil(F.col("n") * t.of / t.over - 1e-9) + 1)
    # rest: what it can share with a node that has none of its shingles before this one
    first_ones = stage(first_ones.select("token", "node", "g", "n", (F.col("c") - F.col("at") + 1).alias("rest")), "first")

    def can_link(rest: str, n: str, rest2: str, n2: str) -> Column:
        return F.least(rest, rest2) * (t.over + t.of) >= (F.col(n) + F.col(n2)) * t.of

    # a group's row: of its members with the token, the most they can share and the smallest size
    row = first_ones.groupBy("token", F.col("g").alias("to")).agg(F.max("rest").alias("rest2"), F.min("n").alias("n2"))
    opened = first_ones.join(row, "token").where((F.col("g") < F.col("to")) & can_link("rest", "n", "rest2", "n2"))
    members = first_ones.select("token", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("rest").alias("restb"), F.col("g").alias("to"))
    pairs = opened.join(members, ["token", "to"]).where(can_link("rest", "n", "restb", "nb")).select(F.col("node").alias("a"), "b").distinct()
    pairs = stage(pairs.join(best.union(best.select("b", "a")), ["a", "b"], "left_anti"), "pairs")
    discard(first_ones, open_nodes, best)
    more = stage(_linked(pairs, texts, t), "more-links")
    joined = components(group_of(group_of(more, "a", "g"), "b", "h").select(F.col("g").alias("a"), F.col("h").alias("b")))
    discard(pairs, texts, more)
    root = group_of(nodes.select("node", "id"), "node", "g").join(joined.select(F.col("node").alias("g"), "root"), "g", "left")
    root = stage(root.select("node", "id", F.coalesce("root", "g").alias("root")), "roots")
    discard(groups, joined, nodes)
    named = root.join(root.groupBy("root").agg(F.min("id").alias("component_id")), "root").select("node", "root", "component_id")
    out = digests.join(named, "node", "left")
    return out.select("id", "n", "node", "root", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")), clashes


def jaccard_components(docs: DataFrame, t: Threshold = Threshold(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id: the smallest id reachable over links, itself included.

    Words are runs without white space, A-Z lower-cased; a text of fewer than k words is one shingle,
    the whole of it.  A null or empty text has no shingles and links with nothing.  Ids are whole numbers;
    a null id gives a row with the component of its text's copies, but takes no part.  Rows with a repeated id are
    linked like others and each gives a row.  Shingles are 64-bit hashes; sets are told apart by two 64-bit digests.
    """
    out, _ = _components_of_rows(docs, t, id_col, text_col)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one_of_each(docs: DataFrame, t: Threshold = Threshold(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the component's own; rows that link with nothing, or have no id, stay.

    Texts of a repeated id are judged one by one, and of several in one component one stays; a row repeated
    with id and text stays as often as it is found.
    """
    comp, clashes = _components_of_rows(docs, t, id_col, text_col)
    comp = comp.where("id IS NOT NULL")
    fates = stage(comp.groupBy("id").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.min("component_id").alias("component")), "fates")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    drop = fates.where("low = high AND component <> id").select(F.col("id").alias(id_col))
    kept = docs.join(drop, id_col, "left_anti").select(*columns)
    several = fates.where("low < high").select(F.col("id").alias(id_col))
    if several.isEmpty():
        return kept
    node, first = unused(docs.columns, "_node"), unused(docs.columns, "_first")
    texts = comp.where("n > 0").join(several.select(F.col(id_col).alias("id")), "id", "left_semi")
    one = texts.where(F.col("component_id") == F.col("id")).groupBy("id", "root").agg(F.min("node").alias(node)).select(F.col("id").alias(id_col), node, F.lit(True).alias(first))
    at, fields = docs.columns.index(text_col), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in slices(batches, at):
            own = numbers(*shingle_sets(data, offs, t.k), clashes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], [*batch.schema.names, node])

    mine = docs.join(several, id_col, "left_semi").select(*columns).mapInArrow(digest, f"{fields}, `{node}` long")
    mine = mine.join(one, [id_col, node], "left").where((F.col(node) == 0) | F.col(first)).select(*columns)
    return kept.join(several, id_col, "left_anti").select(*columns).unionByName(mine)
