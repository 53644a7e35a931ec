"""Trie of conversation prefixes by van Emde Boas recursion.

Prefixes are named by running digests of their turns, so equal prefixes have one name wherever they are. Sequences of
names are cut at half of their height: the upper halves, of which there are as many as cut prefixes, become one row each
with the number and the smallest id of their conversations; the lower halves hang below the cut prefix's name. Upper
trie and lower forests of all segments are cut again side by side, one pass for each halving, until segments are single
turns: the nodes. On the way back, totals of the forests below a cut are grafted onto the nodes of the path above it,
from the smallest halves to the largest, so no pass follows the trie turn by turn.

Sequences longer than ``BLOCK`` turns are rows of that many turns: the names of the prefixes before them come from
prefix doubling over the rows' digests, and their totals go up by doubled pointers. So no row and no group grows with
the length of a conversation. A conversation's turns are numbered by ranges of all turns, ends of one node are
digested in order from chunks that many tasks have joined; hot turns and prefixes are counted before they are shuffled.

Cases: rows without conv_id belong to no conversation and are left out; null turns come first, turns of equal number by
the digest of role and text, repeated rows are turns each; null role and text are empty; a conversation may be left
without turns, it ends at the root; an empty table gives no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import tidy, written

#: Turns of a sequence that are one row at most; a power of two.
BLOCK = 256
#: Ids that are joined to one text.
JOINED = 4096
#: A rebuilt conversation begins with up to eight turns of the conversation whose id is the next multiple of five below.
FAMILY, BORROWED = 5, 9

#: The name of the empty prefix. Others are hexadecimal digests.
ROOT = ""
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _tasks(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, mark, size): every turn with its place from 1, the digest of its role and text, and the text's bytes.

    Turns are dealt to ranges of (conv_id, turn) and numbered there; a range's first conversation goes on from the
    ranges before it, so a conversation of any length is numbered by many tasks.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    mark = _digest(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), mark.alias("mark"), F.octet_length(text).cast("long").alias("size")
    )
    order = [F.col("turn").asc_nulls_first(), F.col("mark")]
    dealt = rows.repartitionByRange(_tasks(rows), F.col("conv_id"), *order).withColumn("part", F.spark_partition_id())
    dealt = written(dealt.withColumn("at", F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(*order))).drop("turn"), "turns")
    sizes = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    moved = sizes.withColumn("before", earlier).filter("before > 0").drop("n")  # one row for a range at most
    placed = dealt.join(F.broadcast(moved), ["conv_id", "part"], "left")
    return placed.select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).cast("long").alias("pos"), "mark", "size")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, length), and their rebuilt turns (conv_id, length, pos, mark, size)."""
    own = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    known = own.select(
        "conv_id", "own", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % BORROWED).alias("wanted"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")
    )
    lenders = own.select(F.col("conv_id").alias("base"), F.col("own").alias("lent")).filter(F.col("base") % FAMILY == 0)
    taken = F.least("wanted", F.coalesce("lent", F.lit(0)))
    length = taken + F.greatest(F.col("own") - F.col("wanted"), F.lit(0))
    known = written(known.join(lenders, "base", "left").select("conv_id", "base", "wanted", taken.alias("taken"), length.alias("length")), "conversations")
    kept = turns.join(known.drop("base"), "conv_id").filter("pos > wanted").withColumn("pos", F.col("pos") - F.col("wanted") + F.col("taken"))
    first = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < BORROWED)).withColumnRenamed("conv_id", "base")
    lent = first.join(known.drop("wanted"), "base").filter("pos <= taken")
    columns = ["conv_id", "length", "pos", "mark", "size"]
    return known.select("conv_id", "length"), kept.select(columns).unionByName(lent.select(columns))


def _named(turns: DataFrame, longest: int, block: int) -> DataFrame:
    """(conv_id, length, number, forest, names, sizes): sequences in rows of ``block`` turns; ``names`` are those of the
    prefixes that end with each turn, ``forest`` that of the prefix before the row."""
    inner = F.sort_array(F.collect_list(F.struct("pos", "mark", "size")))
    rows = turns.groupBy("conv_id", F.expr(f"(pos - 1) div {block}").alias("number")).agg(F.first("length").alias("length"), inner.alias("t"))
    rows = rows.select("conv_id", "length", "number", F.col("t.mark").alias("marks"), F.col("t.size").alias("sizes"))
    end = F.lit(None).cast("string")
    if longest > block:
        rows = written(rows, "rows")
        # Prefix doubling: a digest stands for the rows up to its own, twice as many after each round.
        scan = rows.filter(F.size("marks") == block).select("conv_id", "number", _digest(F.array_join("marks", "")).alias("end"))
        reach = 1
        while reach < longest // block:
            before = scan.select("conv_id", (F.col("number") + reach).alias("number"), F.col("end").alias("before"))
            joined = scan.join(before, ["conv_id", "number"], "left")
            scan = written(joined.select("conv_id", "number", F.coalesce(_digest("before", "end"), "end").alias("end")), "doubled")
            reach *= 2
        forests = scan.select("conv_id", (F.col("number") + 1).alias("number"), F.col("end").alias("forest"))
        rows = rows.join(scan, ["conv_id", "number"], "left").join(forests, ["conv_id", "number"], "left")
        rows, end = rows.withColumn("forest", F.coalesce("forest", F.lit(ROOT))), F.col("end")
    else:
        rows = rows.withColumn("forest", F.lit(ROOT))
    chain = F.aggregate("marks", F.array("forest"), lambda names, m: F.concat(names, F.array(_digest(F.element_at(names, -1), m))))
    names = F.slice(chain, 2, block)
    names = F.when(end.isNotNull(), F.concat(F.slice(chain, 2, block - 1), F.array(end))).otherwise(names)
    return rows.select("conv_id", "length", "number", "forest", names.alias("names"), "sizes")


def _ends_digested(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256) of ``ends`` (name, conv_id): the digest of each name's ids in order, joined by commas.

    Ranges of (name, conv_id) join up to ``JOINED`` ids to a text; a name's texts are then digested one by one.
    """

    @tidy
    def join(batches):
        name, own, out = None, [], []
        for batch in batches:
            for n, i in zip(batch.column("name").to_pylist(), batch.column("conv_id").to_pylist()):
                if own and (n != name or len(own) == JOINED):
                    out.append((name, own[0], ",".join(map(str, own))))
                    own = []
                name = n
                own.append(i)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(("name", "first", "ids"), x)) for x in out], joined)
                out = []
        if own:
            out.append((name, own[0], ",".join(map(str, own))))
        yield pa.RecordBatch.from_pylist([dict(zip(("name", "first", "ids"), x)) for x in out], joined)

    @tidy
    def digest(batches):
        name, state = None, None
        for batch in batches:
            out = []
            for n, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist()):
                if state is not None and n == name:
                    state.update(b",")
                else:
                    if state is not None:
                        out.append({"name": name, "ends_sha256": state.hexdigest()})
                    name, state = n, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_pylist(out, digested)
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"name": name, "ends_sha256": state.hexdigest()}], digested)

    joined = pa.schema([("name", pa.string()), ("first", pa.int64()), ("ids", pa.string())])
    digested = pa.schema([("name", pa.string()), ("ends_sha256", pa.string())])
    dealt = ends.repartitionByRange(_tasks(ends), "name", "conv_id").sortWithinPartitions("name", "conv_id")
    texts = dealt.mapInArrow(join, "name string, first long, ids string")
    return texts.repartition(_tasks(ends), "name").sortWithinPartitions("name", "first").mapInArrow(digest, "name string, ends_sha256 string")


def _cut(level: DataFrame, half: int) -> DataFrame:
    """Segments of twice ``half`` turns cut in the middle: upper halves once for each cut prefix, lower halves below it."""
    n = F.size("names")
    upper = level.filter(n >= half).withColumns({c: F.slice(c, 1, half) for c in ("names", "sizes")})
    lower = level.filter(n > half).select(
        (F.col("depth") + half).alias("depth"), F.element_at("names", half).alias("forest"), F.slice("names", half + 1, half).alias("names"), F.slice("sizes", half + 1, half).alias("sizes"), "conv_id", "n_convs"
    )
    return level.filter(n < half).unionByName(_merged(upper)).unionByName(lower)


def _merged(segments: DataFrame) -> DataFrame:
    """Segments with the same last prefix as one row."""
    same = ["depth", "forest", "names", "sizes"]
    grouped = segments.groupBy(F.element_at("names", -1).alias("end")).agg(*[F.first(c).alias(c) for c in same], F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"))
    return grouped.drop("end")


def _grafted(below: DataFrame, paths: DataFrame) -> DataFrame:
    """Totals ``below`` (end, leaves, saved) for every node of the path that leads to ``end`` from its segment's top."""
    path = below.join(paths, "end").select("depth", "leaves", "saved", "forest", "names", F.posexplode("names").alias("i", "name"))
    parent = F.when(F.col("i") == 0, F.col("forest")).otherwise(F.get("names", F.col("i") - 1))
    return path.select("name", parent.alias("parent"), (F.col("depth") + F.col("i") + 1).alias("depth"), "leaves", "saved")


def _sums(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.groupBy(F.col(key).alias(name)).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _below_rows(below: DataFrame, paths: DataFrame, longest: int, block: int) -> DataFrame:
    """``below`` (end, leaves, saved) summed over all whole rows that follow: values and pointers double their reach."""
    zero = F.lit(0).cast("long")
    at = paths.select("end", F.col("forest").alias("up")).join(below, "end", "left").select("end", "up", F.coalesce("leaves", zero).alias("leaves"), F.coalesce("saved", zero).alias("saved"))
    reach = 1
    while reach < longest // block:
        at = written(at, "pointers")
        sent = at.filter(F.col("up") != ROOT).groupBy(F.col("up").alias("end")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        above = at.select(F.col("end").alias("up"), F.col("up").alias("further"))
        at = at.join(above, "up", "left").join(sent, "end", "left").select(
            "end", F.coalesce("further", F.lit(ROOT)).alias("up"), (F.col("leaves") + F.coalesce("l", zero)).alias("leaves"), (F.col("saved") + F.coalesce("s", zero)).alias("saved")
        )
        reach *= 2
    return at.select("end", "leaves", "saved")


def prefix_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations; see ``COLUMNS``."""
    known, turns = rebuilt(numbered_turns(conversations))
    whole = known.agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), F.coalesce(F.max("length"), F.lit(0)).alias("longest")).first()
    longest, spark = whole["longest"], conversations.sparkSession
    if not whole["n"]:
        return spark.createDataFrame([], ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in COLUMNS))
    named = written(_named(turns, longest, block), "named")
    last = named.filter(F.col("number") == F.expr(f"(length - 1) div {block}")).select(F.element_at("names", -1).alias("name"), "conv_id")
    ends = _ends_digested(last.unionByName(known.filter("length = 0").select(F.lit(ROOT).alias("name"), "conv_id")))

    top = level = written(_merged(named.select((F.col("number") * block).alias("depth"), "forest", "names", "sizes", "conv_id", F.lit(1).cast("long").alias("n_convs"))), "segments")
    halves = [h for h in (1 << k for k in reversed(range(block.bit_length() - 1))) if h < longest]
    levels = {}
    for half in halves:
        levels[half] = level = written(_cut(level, half), "segments")
    first = lambda c: F.element_at(c, 1)
    nodes = level.select(first("names").alias("name"), F.col("forest").alias("parent"), (F.col("depth") + 1).alias("depth"), "conv_id", "n_convs", first("sizes").alias("size"))
    children = nodes.groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    leaf, saved = F.col("n_children").isNull().cast("long"), (F.col("n_convs") - 1) * F.col("size")
    nodes = written(nodes.join(children, "name", "left").select(*nodes.columns[:-1], F.coalesce("n_children", F.lit(0)).alias("n_children"), leaf.alias("leaves"), saved.alias("saved")), "nodes")

    totals = nodes.select("name", "parent", "depth", "leaves", "saved")
    ending = lambda rows, size: rows.filter(F.size("names") == size).select(F.element_at("names", size).alias("end"), "depth", "forest", "names")
    for half in reversed(halves):
        below = _sums(totals.filter((F.col("depth") - 1) % (2 * half) == half), "parent", "end")
        totals = totals.unionByName(written(_grafted(below, ending(levels[half].filter(F.col("depth") % (2 * half) == 0), half)), "grafts"))
    if longest > block:
        below = _sums(totals.filter(((F.col("depth") - 1) % block == 0) & (F.col("depth") > 1)), "parent", "end")
        paths = ending(top, block)
        totals = totals.unionByName(written(_grafted(_below_rows(below, paths, longest, block), paths), "grafts"))

    zero, least = F.lit(0).cast("long"), F.lit(whole["least"]).cast("long")
    above = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    inner = nodes.drop("leaves", "saved").join(above, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", least)).join(_sums(totals, "name", "name"), "name")
    highest = totals.filter("depth = 1").agg(F.coalesce(F.sum("leaves"), F.lit(1)).alias("leaves"), F.coalesce(F.sum("saved"), zero).alias("saved"))
    highest = highest.crossJoin(nodes.filter("depth = 1").agg(F.count("*").alias("n_children")))  # one row with one row
    root = highest.select(
        F.lit(ROOT).alias("name"), zero.alias("depth"), least.alias("conv_id"), F.lit(whole["n"]).cast("long").alias("n_convs"), "n_children", F.lit(None).cast("long").alias("parent_conv_id"), "leaves", "saved"
    )
    every = inner.drop("parent").unionByName(root).join(ends, "name", "left")
    return every.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    )
