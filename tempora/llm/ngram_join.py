"""N-gram Jaccard join with count-vector R-trees.

A document is the set of hashes of its word shingles. Shingles are hashed into ``GROUPS`` groups, and a set becomes the
point of its counts in each group. Of two sets the overlap is at most the sum of the coordinates' minima, so a pair
whose bound is below what the threshold needs is never compared. Points of one block are bulk-loaded into an R-tree,
whose boxes give the same bound for all pairs below two nodes; the pairs that survive are verified on the sets.

Counts of random sets are alike, so one tree over all points would compare most of them. Points are therefore dealt to
blocks by an exact rule: two sets that are similar enough share at least ``common`` of the first shingles of each, in
an order that all sets use (``prefix``). Shingles that many sets have come last in that order, the rest by hash. The
sets that have one shingle in front are its list. A set that shares too few of its lists with anyone is in no link, so
such sets go, and with them the lists that they leave to one set.

Only components are wanted, so most pairs need no look. First every set goes to one block, that of the list with the
smallest hash among its lists; large blocks are dealt to chunks, which share a few pivots. Within a chunk neighbours in
the tree are verified first, then pairs of different components whose bound reaches, and only links that span are handed
on. Lists whose members are all in one component are done. In the lists that stay open every pair of different
components is a candidate: in short lists pairs are counted over all lists, and those that share too few shingles in
front are dropped; in long lists the sets outside the largest component meet all others, tree by tree.

Equal sets are one point with many documents. Shingles are hashes of 64 bits, of which 48 are compared at the end.

Cases: null, empty and white-space texts have no shingle and are linked with nothing; a text with fewer words than a
shingle is one shingle of all of them; texts of any length are read whole; repeated rows are equal sets; a null id is
never the smallest of its component unless it is alone. Columns other than id and text are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import apart, texts, tidy, written
from .components import components

WORDS, SHARE = 5, 80
GROUPS = 256
#: Words whose hashes a task keeps; postings that a task holds before it hands them on; postings of a bucket, about.
CACHE, HELD, BUCKET = 200_000, 400_000, 100_000
#: Bytes of the longest word whose hash is kept.
KEPT_WORD = 64
BUCKETS = 64
#: Shingles in front that similar sets must share, if they have as many in all: so many at least, or this part of the set.
#: More of them make longer fronts, but fewer texts that share a passage only are taken for candidates.
COMMON, COMMON_PART = 4, 16
#: Shingles that come last in the order: found this often in a partition and in all, so many at most. The order only
#: decides how long lists get; any order that all sets share gives the same links.
LOCAL_FREQUENT, FREQUENT, MOST_FREQUENT, MOST_LOCAL = 3, 8, 200_000, 20_000
#: Members of a list that is one leaf; of a chunk of longer lists, about; pivots of a list, about; of a tree's
#: leaf; boxes of a box.
SHORT, CHUNK, PIVOTS, LEAF, FAN = 64, 512, 8, 32, 4
#: Bits of the bitmaps of wanted rows at most; they are broadcast.
MOST_BITS = 1 << 27
#: Sets of a partition's texts with which a shingle is hot: its postings go to many tasks and its list counts as long.
HOT = 20_000

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_word_hashes: dict[bytes, bytes] = {}


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    known = _word_hashes
    if len(known) > CACHE:
        known.clear()
    new = set(found).difference(known)
    known.update((w, xxhash.xxh3_64_digest(w)) for w in new)
    h = np.frombuffer(b"".join(map(known.__getitem__, found)), ">u8").astype(np.uint64)
    for w in new:
        if len(w) > KEPT_WORD:
            del known[w]
    if len(h) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=len(h))], np.uint64)
    n = len(h) - words + 1
    key = np.zeros(n, np.uint64)
    for i in range(words):
        key = (key ^ (key >> np.uint64(31))) * _MIX[-1] + h[i : i + n] * _MIX[i % len(_MIX)]
    key ^= key >> np.uint64(29)
    key *= _MIX[1]
    key ^= key >> np.uint64(32)
    return np.unique(key)


def set_id(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes(), seed=len(shingles)) - (1 << 63)


def needed(a, b, share: int):
    """The overlap that sets of sizes ``a`` and ``b`` need: 100 * i >= share * (a + b - i)."""
    return -(-share * (np.asarray(a, np.int64) + b) // (100 + share))


def common(n):
    """Shingles in front that a set of ``n`` must share with a similar one that is at least as large."""
    return np.maximum(COMMON, np.asarray(n, np.int64) // COMMON_PART)


def prefix(shingles: np.ndarray, frequent: np.ndarray, share: int) -> np.ndarray:
    """The shingles of which similar sets share ``common``: all but ``ceil(share * n) - common(n)``, in the common order.

    ``frequent``: sorted hashes, with ranks in the second row; they come last, by rank.
    """
    n = len(shingles)
    k = min(n, n - (-(-share * n // 100)) + int(common(n)))
    if n and frequent.shape[1]:
        at = np.minimum(np.searchsorted(frequent[0], shingles), frequent.shape[1] - 1)
        rank = np.where(frequent[0][at] == shingles, frequent[1][at], np.uint64(0))
        shingles = shingles[np.lexsort((shingles, rank))]
    return shingles[:k]


def point(shingles: np.ndarray) -> bytes:
    """Counts in the groups, one byte each; 255 stands for 255 or more."""
    counts = np.bincount((shingles % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def bound(a: np.ndarray, b: np.ndarray, sizes_a, sizes_b) -> np.ndarray:
    """Sums of the coordinates' minima of rows of points, at least the overlap of their sets."""
    low = np.minimum(a, b)
    sums = low.sum(axis=-1, dtype=np.int64)
    full = (low == 255).any(axis=-1)
    return np.where(full, np.minimum(sizes_a, sizes_b), sums)


class RTree:
    """Points packed into leaves by size and then by their counts; a box for each leaf, and for each ``FAN`` boxes of a
    level one of the level above, up to the root. ``high``, ``least`` and ``most`` hold the levels, leaves first."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        slabs = max(1, int(np.sqrt(len(sizes) / LEAF)))
        by_size = np.argsort(sizes, kind="stable")
        order = np.concatenate([x[np.lexsort(points[x][:, :4].T)] for x in np.array_split(by_size, slabs)])
        self.order, self.points, self.sizes = order, points[order], sizes[order]
        self.starts = np.arange(0, len(order), LEAF)
        self.high, self.least, self.most = [], [], []
        self._level(self.starts, self.points, self.sizes, self.sizes)
        while len(self.high[-1]) > 1:
            self.rise()

    def _level(self, starts: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> None:
        self.high.append(np.maximum.reduceat(high, starts, axis=0))
        self.least.append(np.minimum.reduceat(least, starts))
        self.most.append(np.maximum.reduceat(most, starts))

    def rise(self) -> None:
        """One more level."""
        self._level(np.arange(0, len(self.high[-1]), FAN), self.high[-1], self.least[-1], self.most[-1])

    def leaf(self, i: int) -> slice:
        return slice(self.starts[i], min(self.starts[i] + LEAF, len(self.order)))


def _near_boxes(left: RTree, right: RTree, share: int):
    """Pairs of leaves below which pairs may be similar: from the roots down, box meets box."""
    while len(left.high) < len(right.high):
        left.rise()
    while len(right.high) < len(left.high):
        right.rise()
    a = b = np.zeros(1, np.int64)
    for k in range(len(left.high) - 1, -1, -1):
        kept = []
        for x in range(0, len(a), 4096):
            i, j = a[x : x + 4096], b[x : x + 4096]
            ok = (100 * left.most[k][i] >= share * right.least[k][j]) & (100 * right.most[k][j] >= share * left.least[k][i])
            ok &= bound(left.high[k][i], right.high[k][j], left.most[k][i], right.most[k][j]) >= needed(left.least[k][i], right.least[k][j], share)
            kept.append(ok)
        ok = np.concatenate(kept) if kept else np.zeros(0, bool)
        a, b = a[ok], b[ok]
        if k:
            a = (a[:, None, None] * FAN + np.arange(FAN)[None, :, None] + np.zeros((1, 1, FAN), np.int64)).ravel()
            b = (b[:, None, None] * FAN + np.arange(FAN)[None, None, :] + np.zeros((1, FAN, 1), np.int64)).ravel()
            there = (a < len(left.high[k - 1])) & (b < len(right.high[k - 1]))
            a, b = a[there], b[there]
    return a, b


def tree_join(left: RTree, right: RTree, share: int):
    """Arrays (i, j) of places in the two trees whose bound reaches what their sizes need; boxes are tried first."""
    out_i, out_j = [], []
    for a, b in zip(*(x.tolist() for x in _near_boxes(left, right, share))):
        mine, other = left.leaf(a), right.leaf(b)
        na, nb = left.sizes[mine][:, None], right.sizes[other][None, :]
        near = bound(left.points[mine][:, None], right.points[other][None], na, nb) >= needed(na, nb, share)
        near &= (100 * na >= share * nb) & (100 * nb >= share * na)
        i, j = np.nonzero(near)
        out_i.append(left.order[mine][i])
        out_j.append(right.order[other][j])
    empty = np.zeros(0, np.int64)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (empty, empty)


def packed(shingles: np.ndarray) -> bytes:
    """48 bits of each shingle."""
    low = shingles & np.uint64((1 << 48) - 1)
    return low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def similar(a: bytes, b: bytes, share: int) -> bool:
    x, y = unpacked(a), unpacked(b)
    both = len(np.intersect1d(x, y))
    return 100 * both >= share * (len(x) + len(y) - both)


def _sets(words: int):
    """doc_id, set_id, n_shingles of each row; rows of a second kind name shingles that are frequent in the partition."""

    @tidy
    def run(batches):
        held, n_held = [], 0
        frequent: Counter = Counter()

        def count():
            nonlocal held, n_held
            if held:
                h, n = np.unique(np.concatenate(held), return_counts=True)
                frequent.update(dict(zip(h[n > 1].tolist(), n[n > 1].tolist())))
            if len(frequent) > 10 * MOST_LOCAL:
                kept = frequent.most_common(5 * MOST_LOCAL)
                frequent.clear()
                frequent.update(dict(kept))
            held, n_held = [], 0

        for batch in batches:
            ids, sizes = [], []
            for x in texts(batch):
                s = shingle_set(x, words)
                sizes.append(len(s))
                ids.append(set_id(s) if len(s) else None)
                held.append(s)
                n_held += len(s)
                if n_held > HELD:
                    count()
            nothing = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), nothing, nothing], names=["doc_id", "set_id", "n_shingles", "shingle", "seen"]
            )
        count()
        found = [(h, n) for h, n in frequent.most_common(MOST_LOCAL) if n >= LOCAL_FREQUENT]
        nothing = pa.nulls(len(found), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [nothing, nothing, nothing, pa.array(np.array([h for h, _ in found], np.uint64).view(np.int64)), pa.array([n for _, n in found], pa.int64())],
            names=["doc_id", "set_id", "n_shingles", "shingle", "seen"],
        )

    return run


def _postings(shared, words: int, share: int, buckets: int, hot: int):
    """(bucket, packed postings): shingle, set and size of each first shingle, once for each set of the task.

    Postings of hot shingles are dealt to negative buckets by task, so that no bucket holds a hot list whole.
    """
    kind = np.dtype([("shingle", "<u8"), ("set", "<i8"), ("n", "<i4")])

    @tidy
    def run(batches):
        held, n_held, seen = [], 0, set()
        often = shared.value[0][shared.value[1] >= hot]
        context = TaskContext.get()
        own_bucket = -1 - (context.partitionId() if context else 0) % buckets

        def out():
            nonlocal held, n_held
            rows = np.concatenate(held) if held else np.zeros(0, kind)
            to = ((rows["shingle"] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            if len(often):
                to[np.isin(rows["shingle"], often)] = own_bucket
            order = np.argsort(to, kind="stable")
            rows, to = rows[order], to[order]
            starts = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.zeros(0, np.int64)
            packed = [x.tobytes() for x in np.split(rows, starts[1:])] if len(to) else []
            held, n_held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(to[starts], pa.int64()), pa.array(packed, pa.binary())], names=["bucket", "postings"])

        for batch in batches:
            for x in texts(batch):
                s = shingle_set(x, words)
                if not len(s) or (own := set_id(s)) in seen:
                    continue
                seen.add(own)
                first = prefix(s, shared.value, share)
                rows = np.zeros(len(first), kind)
                rows["shingle"], rows["set"], rows["n"] = first, own, len(s)
                held.append(rows)
                n_held += len(rows)
                if n_held > HELD:
                    yield from out()
                    seen.clear()
        yield from out()

    return kind, run


def _lists(kind):
    """Members of the lists of one bucket: (list, set_id, n, members); lists of one set are left out. Of hot lists a
    bucket has a part only, so ``members`` is null there."""

    def run(frame: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(x, kind) for x in frame["postings"].to_pylist()])
        rows = rows[np.lexsort((rows["set"], rows["shingle"]))]
        rows = rows[np.append(True, (rows["shingle"][1:] != rows["shingle"][:-1]) | (rows["set"][1:] != rows["set"][:-1]))]
        starts = np.flatnonzero(np.append(True, rows["shingle"][1:] != rows["shingle"][:-1]))
        length = np.diff(np.append(starts, len(rows)))
        members = np.repeat(length, length)
        hot = frame["bucket"][0].as_py() < 0
        keep = slice(None) if hot else members > 1
        rows, members = rows[keep], members[keep]
        return pa.table(
            {
                "list": pa.array(rows["shingle"].astype(np.uint64).view(np.int64)),
                "set_id": pa.array(rows["set"].astype(np.int64)),
                "n": pa.array(rows["n"].astype(np.int64)),
                "members": pa.nulls(len(rows), pa.int64()) if hot else pa.array(members.astype(np.int64)),
            }
        )

    return run


MEMBERS = "set_id long, n long, point binary, shingles binary"


def _members(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``MEMBERS`` of the sets in ``wanted`` (set_id, doc_id), and of a few others.

    Two bitmaps of a bounded size, of ids and of ids with sets, let the wanted through, so no text is shuffled. They are
    sparse up to some millions of wanted rows; beyond that more others pass, at most all sets, which costs room for one
    copy of the sets and changes no result, as all that follows joins by sets. A set may come twice.
    """
    bits = min(MOST_BITS, max(1 << 16, 1 << (16 * wanted.count()).bit_length()))
    by_id = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    by_set = F.pmod(F.col("set_id").bitwiseXOR(by_id), F.lit(bits))  # the same in Python below

    def bitmap(place):
        at = wanted.select((place / 64).cast("long").alias("at"), (place % 64).cast("int").alias("bit"))
        found = at.groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
        table = np.zeros(bits // 64, np.int64)
        table[found["at"].to_numpy()] = found["bits"].to_numpy()
        return docs.sparkSession.sparkContext.broadcast(table)

    ids, sets = bitmap(by_id), bitmap(by_set)
    has = lambda table, at: (table.value.view(np.uint64)[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1)

    @tidy
    def make(batches):
        for batch in batches:
            batch = batch.filter(pa.array(has(ids, batch.column("place").to_numpy()).astype(bool)))
            found = [shingle_set(x, words) for x in texts(batch)]
            own = np.array([set_id(s) if len(s) else 0 for s in found], np.int64)
            asked = has(sets, (own ^ batch.column("place").to_numpy()) % bits).astype(bool) & np.array([len(s) > 0 for s in found], bool)
            found, own = [s for s, ok in zip(found, asked) if ok], own[asked]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(own),
                    pa.array([len(s) for s in found], pa.int64()),
                    pa.array([point(s) for s in found], pa.binary()),
                    pa.array([packed(s) for s in found], pa.binary()),
                ],
                names=["set_id", "n", "point", "shingles"],
            )

    return docs.withColumn("place", by_id).mapInArrow(make, MEMBERS)


class Links:
    """Components of sets by the links that join them, which are verified one by one."""

    def __init__(self, components: list[int], sets: list[bytes], share: int):
        self.own, self.sets, self.share, self.found = components, sets, share, []
        self.parent: dict[int, int] = {c: c for c in components}

    def top(self, i: int) -> int:
        c = self.own[i]
        while self.parent[c] != c:
            self.parent[c] = self.parent[self.parent[c]]
            c = self.parent[c]
        return c

    def meet(self, pairs) -> None:
        """Verify the pairs whose sets are in different components yet, and join the components of those that link."""
        for i, j in pairs:
            a, b = self.top(i), self.top(j)
            if a != b and similar(self.sets[i], self.sets[j], self.share):
                self.parent[max(a, b)] = min(a, b)
                self.found.append((i, j))


def spanning(points: np.ndarray, sizes: np.ndarray, sets: list[bytes], share: int, pivots: np.ndarray):
    """Links (i, j) that span the components: neighbours in the tree and pivots meet first, then what is apart."""
    links = Links(list(range(len(sizes))), sets, share)
    tree = RTree(points, sizes)
    links.meet(zip(tree.order[:-1].tolist(), tree.order[1:].tolist()))
    for p in pivots.tolist():
        near = bound(points[p][None], points, sizes[p], sizes) >= needed(sizes[p], sizes, share)
        links.meet((p, i) for i in np.flatnonzero(near).tolist())
    own = np.array([links.top(i) for i in range(len(sizes))])
    if len(np.unique(own)) > 1:
        i, j = tree_join(tree, tree, share)
        apart_yet = (own[i] != own[j]) & (i < j)
        links.meet(zip(i[apart_yet].tolist(), j[apart_yet].tolist()))
    return links.found


def _blocks(share: int):
    """One chunk of a block: links that span it."""

    def run(frame: pa.Table) -> pa.Table:
        ids = frame["set_id"].to_numpy()
        _, first = np.unique(ids, return_index=True)
        frame = frame.take(pa.array(first))
        ids, sizes = frame["set_id"].to_numpy(), frame["n"].to_numpy()
        if len(ids) < 2:
            return _pairs_table(ids[:0], ids[:0])
        pivots = np.flatnonzero(np.array(frame["pivot"].to_pylist(), bool))
        links = spanning(_points(frame), sizes, frame["shingles"].to_pylist(), share, pivots)
        return _pairs_table(ids[[i for i, _ in links]], ids[[j for _, j in links]])

    return run


def _dealt(lists: DataFrame, chunk: int) -> DataFrame:
    """``lists`` with the number of chunks of each, the member's chunk and whether it is a pivot, which a list without
    chunks needs not have."""
    return (
        lists.withColumn("chunks", F.ceil(F.col("members") / chunk))
        .withColumn("chunk", F.pmod(F.xxhash64("set_id", F.lit(3)), F.col("chunks")))
        .withColumn("pivot", (F.col("chunks") > 1) & (F.pmod(F.xxhash64("set_id", F.lit(7)), F.col("members")) < PIVOTS))
    )


def _per_list(rows: DataFrame, **values) -> DataFrame:
    """``rows`` with aggregates over their lists. Lists of bounded size are sorted together once; hot ones are aggregated
    by many tasks and joined."""
    cold = rows.filter("not hot").withColumns({k: v.over(Window.partitionBy("list")) for k, v in values.items()})
    hot = rows.filter("hot").drop(*values)
    return cold.unionByName(hot.join(apart(hot.groupBy("list").agg(*[v.alias(k) for k, v in values.items()])), "list"))


def _pruned(lists: DataFrame, share: int) -> DataFrame:
    """``lists`` without the sets that share fewer lists than any link needs, and without the lists of one set."""
    enough = F.least(F.greatest(F.lit(COMMON), F.floor(F.col("n") / COMMON_PART)), F.ceil(F.col("n") * share / 100))
    able = lists.groupBy("set_id").agg(F.count("*").alias("lists"), F.first("n").alias("n")).filter(F.col("lists") >= enough).select("set_id")
    kept = lists.join(written(able, "able"), "set_id", "left_semi")
    return written(_per_list(kept, members=F.count("*")).filter("members > 1"), "lists")


def _homes(lists: DataFrame, chunk: int) -> DataFrame:
    """(set_id, list, chunk, pivot): the block of each set, one row for each chunk that it goes to."""
    smallest = F.min(F.struct(F.xxhash64("list").alias("h"), "list", "members")).alias("home")
    own = lists.groupBy("set_id").agg(smallest).select("set_id", "home.list", "home.members")
    spread = F.when(F.col("pivot"), F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).otherwise(F.array("chunk"))
    return _dealt(own, chunk).withColumn("chunk", F.explode(spread)).select("set_id", "list", "chunk", "pivot")


def _labelled(lists: DataFrame, joined: DataFrame) -> DataFrame:
    """``lists`` with the component of each member."""
    of = joined.select(F.col("node").alias("set_id"), "component")
    return lists.drop("component").join(of, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))


def _cross_pairs(share: int):
    """Rows of short lists, in the order of leaders and lists, to pairs (a, b) of different components with the shingles
    that they share (n) and those that they need to share in all lists.

    Lists of one leader have much the same members, so pairs are counted over all of them before they are handed on; a
    leader has no more lists than it has shingles in front.
    """

    def counted(held):
        found = np.concatenate(held)
        rows, at = np.unique(found[:, :3], axis=0, return_inverse=True)
        return np.column_stack([rows, np.bincount(at.ravel(), weights=found[:, 3]).astype(np.int64)])

    def pairs(rows: pa.Table):
        of, ids, sizes, own = (rows[c].to_numpy() for c in ("list", "set_id", "n", "component"))
        starts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
        length = np.diff(np.append(starts, len(of)))
        held, n_held = [], 0
        for m in np.unique(length[length > 1]).tolist():
            i, j = np.triu_indices(m, 1)
            at = starts[length == m]
            step = max(1, 200_000 // len(i))
            for k in range(0, len(at), step):
                a, b = (at[k : k + step, None] + i).ravel(), (at[k : k + step, None] + j).ravel()
                small, large = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
                near = (own[a] != own[b]) & (100 * small >= share * large)
                a, b, small, large = ids[a[near]], ids[b[near]], small[near], large[near]
                need = np.minimum(common(small), -(-share * large // 100))
                held.append(np.stack([np.minimum(a, b), np.maximum(a, b), need, np.ones(len(a), np.int64)], axis=1))
                n_held += len(a)
                if n_held > 400_000:
                    held = [counted(held)]
                    n_held = len(held[0])
        return counted(held) if held else np.zeros((0, 4), np.int64)

    def run(batches):
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            leader = rows["leader"].to_numpy()
            ends = np.append(np.flatnonzero(leader[1:] != leader[:-1]) + 1, len(leader))
            # Whole leaders, some thousands of rows at a time; the last one may go on in the next batch.
            begin = 0
            for end in ends[:-1].tolist():
                if end - begin >= 20_000 or end == ends[-2]:
                    yield out(pairs(rows.slice(begin, end - begin)))
                    begin = end
            rest = rows.slice(begin)
        if rest is not None and len(rest):
            yield out(pairs(rest))

    def out(found):
        return pa.RecordBatch.from_arrays([pa.array(found[:, i]) for i in range(4)], names=["a", "b", "need", "n"])

    return run


def _with(pairs: DataFrame, members: DataFrame, column: str) -> DataFrame:
    """``pairs`` (a, b) with the column of both members."""
    left = members.select(F.col("set_id").alias("a"), F.col("n").alias("n_a"), F.col(column).alias("of_a"))
    right = members.select(F.col("set_id").alias("b"), F.col("n").alias("n_b"), F.col(column).alias("of_b"))
    return pairs.join(left, "a").join(right, "b")


def _verified(pairs: DataFrame, members: DataFrame, share: int) -> DataFrame:
    """The pairs that are links. Bounds of whole points come first, so few sets are moved."""

    def by_points(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, GROUPS) for c in ("of_a", "of_b"))
            na, nb = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            keep = bound(a, b, na, nb) >= needed(na, nb, share)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    def by_sets(batches):
        for batch in batches:
            keep = [similar(x, y, share) for x, y in zip(batch.column("of_a").to_pylist(), batch.column("of_b").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # Written, so that Spark knows how few they are and need not move the sets.
    near = written(_with(pairs, members, "point").mapInArrow(by_points, "a long, b long"), "near")
    return _with(near, members, "shingles").mapInArrow(by_sets, "a long, b long")


def _points(frame: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(frame["point"].to_pylist()), np.uint8).reshape(-1, GROUPS)


def _pairs_table(a, b) -> pa.Table:
    return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})


def _second_meetings(share: int):
    """A chunk of a long list (side 0) and one of its sets outside the list's largest component (side 1): links that join
    components, verified on the sets where they are."""

    def run(frame: pa.Table) -> pa.Table:
        ids, sizes, own, side = (frame[c].to_numpy() for c in ("set_id", "n", "component", "side"))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(left) or not len(right) or len(np.unique(own)) < 2:
            return _pairs_table(ids[:0], ids[:0])
        points = _points(frame)
        i, j = tree_join(RTree(points[left], sizes[left]), RTree(points[right], sizes[right]), share)
        i, j = left[i], right[j]
        apart_yet = own[i] != own[j]
        links = Links(own.tolist(), frame["shingles"].to_pylist(), share)
        links.meet(zip(i[apart_yet].tolist(), j[apart_yet].tolist()))
        return _pairs_table(ids[[a for a, _ in links.found]], ids[[b for _, b in links.found]])

    return run


def _second(grouped: DataFrame, members: DataFrame, share: int, chunk: int) -> DataFrame:
    """Links (a, b) between components of the long lists ``grouped`` (list, set_id, component).

    Of two components at least one is not the list's largest, so only the sets outside it meet all sets of the list,
    chunk by chunk; the others are copied once for each chunk of those, not for each chunk of the list.
    """
    sizes = grouped.groupBy("list", "component").agg(F.count("*").alias("c")).groupBy("list")
    sizes = sizes.agg(F.sum("c").alias("members"), F.max(F.struct("c", "component")).alias("main"))
    rows = grouped.join(apart(sizes), "list").withColumns({"ones": F.ceil(F.col("members") / chunk), "twos": F.ceil((F.col("members") - F.col("main.c")) / chunk)})
    place = lambda seed, n: F.pmod(F.xxhash64("set_id", F.lit(seed)), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    every = rows.select("list", "set_id", "component", place(3, "ones").alias("one"), each("twos").alias("two"), F.lit(0).alias("side"))
    others = rows.filter(F.col("component") != F.col("main.component"))
    others = others.select("list", "set_id", "component", each("ones").alias("one"), place(5, "twos").alias("two"), F.lit(1).alias("side"))
    tiles = every.unionByName(others).join(members, "set_id")
    return tiles.groupBy("list", "one", "two").applyInArrow(_second_meetings(share), "a long, b long")


def similarity_classes(docs: DataFrame, words: int = WORDS, share: int = SHARE, short: int = SHORT, chunk: int = CHUNK, hot: int = HOT) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, set_id.

    Documents are linked when 100 * intersection >= share * union of their shingle sets; ``component_id`` is the
    smallest id that links reach. ``set_id`` is null where there is no shingle. ``short``, ``chunk`` and ``hot``: see the
    constants; they change the work, not the result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    both = written(docs.mapInArrow(_sets(words), "doc_id long, set_id long, n_shingles long, shingle long, seen long"), "sets")
    own = both.filter("n_shingles is not null").select("doc_id", "set_id", "n_shingles")
    nodes = own.filter("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"))

    top = both.filter("seen is not null").groupBy("shingle").agg(F.sum("seen").alias("seen")).filter(F.col("seen") >= FREQUENT)
    top = top.orderBy(F.desc("seen"), "shingle").limit(MOST_FREQUENT).toArrow()
    hashes, seen = top["shingle"].to_numpy().astype(np.int64).view(np.uint64), top["seen"].to_numpy().astype(np.uint64)
    order = np.argsort(hashes)
    frequent = spark.sparkContext.broadcast(np.stack([hashes[order], seen[order]]))

    front = F.floor(F.col("n") * (100 - share) / 100) + F.greatest(F.lit(COMMON), F.floor(F.col("n") / COMMON_PART))
    total = nodes.agg(F.sum(front)).first()[0] or 0
    buckets = max(BUCKETS, -(-int(total) // BUCKET))
    kind, deal = _postings(frequent, words, share, buckets, hot)
    dealt = docs.mapInArrow(deal, "bucket long, postings binary")
    lists = written(dealt.groupBy("bucket").applyInArrow(_lists(kind), "list long, set_id long, n long, members long"), "lists")
    lists = lists.withColumn("hot", F.col("members").isNull())
    if len(seen) and int(seen.max()) >= hot:
        lists = lists.filter("not hot").unionByName(lists.filter("hot").distinct())  # a hot list's sets come from many tasks
    lists = _pruned(lists, share)

    wanted = written(lists.select("set_id").distinct().join(nodes, "set_id").select("set_id", "doc_id"), "wanted")
    members = written(_members(docs, wanted, words), "members")
    homes = written(_homes(lists, chunk), "homes")
    links = written(members.join(homes, "set_id").groupBy("list", "chunk").applyInArrow(_blocks(share), "a long, b long"), "links")
    joined = components(links)

    labelled = _per_list(_labelled(lists, joined), least=F.min("component"), most=F.max("component"), leader=F.min("set_id"))
    still = written(labelled.filter("least <> most").drop("least", "most", "hot"), "open")
    near = still.filter(F.col("members") <= short).select("leader", "list", "set_id", "n", "component")
    counted = near.repartition("leader").sortWithinPartitions("leader", "list").mapInArrow(_cross_pairs(share), "a long, b long, need long, n long")
    pairs = counted.groupBy("a", "b").agg(F.min("need").alias("need"), F.sum("n").alias("n")).filter("n >= need").select("a", "b")
    # Long lists of one leader have much the same members, too: they are one list of all of them.
    grouped = written(still.filter(F.col("members") > short).select(F.col("leader").alias("list"), "set_id", "component").distinct(), "long")
    second = written(_second(grouped, members, share, chunk), "links")
    if not second.isEmpty():
        joined = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(second))
    candidates = written(pairs, "candidates")
    # One pair of every two components first: what it joins needs no more looks.
    for last in (False, True):
        between = candidates
        for x in "ab":
            between = between.join(apart(joined.select(F.col("node").alias(x), F.col("component").alias(f"_{x}"))), x, "left").withColumn(f"_{x}", F.coalesce(f"_{x}", x))
        between = between.filter("_a <> _b")
        if not last:
            between = between.groupBy(F.least("_a", "_b"), F.greatest("_a", "_b")).agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b")
        more = written(_verified(written(between.select("a", "b"), "pairs"), members, share), "links")
        if not more.isEmpty():
            joined = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    label = nodes.join(joined.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    smallest = label.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    label = label.join(apart(smallest), "component").select("set_id", "component_id", F.col("component").alias("class_set"))
    out = own.join(apart(label), "set_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "set_id", "class_set")


def keep_one_each(docs: DataFrame, words: int = WORDS, share: int = SHARE) -> DataFrame:
    """``docs`` with one row of each class of similar documents, that with the smallest id; all columns stay, also of
    texts without words.

    Where an id stands on several rows each is judged by its own text, and of rows of one class with the smallest id one
    stays; so it does of a class whose rows have no id.
    """
    found = written(similarity_classes(docs, words, share), "classes")
    several = found.groupBy("doc_id").agg(F.count("*").alias("_n")).filter("_n > 1 or doc_id is null").select(F.col("doc_id").alias("_several"))
    gone = written(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "similar")
    names = [f"_c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    own, text = F.col(names[docs.columns.index("doc_id")]).cast("long"), names[docs.columns.index("text")]
    if several.isEmpty():
        return rows.join(gone, own == F.col("_gone"), "left_anti").toDF(*docs.columns)
    several = written(several, "several")
    kept = rows.filter(own.isNotNull()).join(several, own == F.col("_several"), "left_anti").join(gone, own == F.col("_gone"), "left_anti")

    def sets(batches):
        for batch in batches:
            found = [shingle_set(x, words) for x in texts(batch, text)]
            yield batch.append_column("_set", pa.array([set_id(s) if len(s) else None for s in found], pa.int64()))

    looked_at = rows.join(several, own.eqNullSafe(F.col("_several")), "left_semi").withColumn("_row", F.monotonically_increasing_id())
    looked_at = written(looked_at.mapInArrow(sets, StructType([*looked_at.schema.fields, StructField("_set", LongType())])), "repeats")
    classes = found.select(F.col("set_id").alias("_set"), "class_set", "component_id").filter("_set is not null").distinct()
    first = looked_at.join(classes, "_set").filter(own.eqNullSafe(F.col("component_id"))).groupBy("class_set").agg(F.min(F.struct("_set", "_row")).alias("k"))
    stay = looked_at.join(first.select(F.col("k._row").alias("_row")), "_row", "left_semi").unionByName(looked_at.filter("_set is null"))
    return kept.unionByName(stay.select(*names)).toDF(*docs.columns)
