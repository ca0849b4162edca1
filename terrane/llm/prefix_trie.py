"""Operator 11, trie of conversation prefixes by vertical bitmaps.

Conversations are dealt to shards, stretches of conv_id of a bounded number of turns. A shard indexes (position, turn) to a
bitset of its conversations. Starting from the root's bitset, a node's children are the intersections of its bitset with the
postings of the turns that follow; members are popcounts, ends are intersections with the conversations of that length.

What a node needs of its whole subtree is a sum over its members, so shards only have to agree on who counts a node: its
owner, the smallest member. A first pass over the shards gives each node its owner and tells how many members go on; a
second pass, told from which depth on each conversation owns its nodes, gives each shard's part of every figure. The parts
of a node are folded in order of conv_id, end lists as a stream.

Conversations of more than SEGMENT turns go on in shards of their own segments, so no task holds a whole one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.session import ship, stored

#: Turns of a conversation that one task holds; turns of a shard as a power of two (those of conversations that start in it).
SEGMENT, SHARD_BITS = 4096, 12
#: Original turns of the conversation that a group shares: conversations c, c + 1, ... up to FAMILY share the first of them.
FAMILY, SHARED = 5, 9
ROOT = hashlib.md5(b"").digest()
NO_ENDS = hashlib.sha256(b"").hexdigest()
#: Kinds of rows that a shard is given.
TURN, HEAD, OWNED, TAIL, BARE = range(5)
ROWS = ["shard", "seg", "conv_id", "kind", "pos", "key", "size", "n"]


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, key, size, n, at): the turns of each conversation numbered from 0 in order of turn, null first.

    key: 16 bytes that stand for role and text, null ones as empty. size: UTF-8 bytes of the text. n: the conversation's
    turns. at: the place of its first turn in the sorted table, from which shards are cut. Turns of equal number are in order
    of key. Rows without conv_id are left out. Rows are sorted by range, so turns of one conversation of any
    length are numbered by several tasks; texts aren't shuffled.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    slim = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), key.alias("key"), F.octet_length(text).cast("long").alias("size"))
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("key")]
    sorted_ = stored(slim, "turns").repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_ = stored(sorted_.select("conv_id", "key", "size", F.monotonically_increasing_id().alias("id")), "ordered")
    runs = sorted_.withColumn("part", F.shiftright("id", 33)).groupBy("conv_id", "part").agg(F.min("id").alias("first"), F.count("*").alias("own"))
    whole = Window.partitionBy("conv_id")  # a row for each task that sorted turns of the conversation
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumns({"earlier": F.coalesce(F.sum("own").over(before), F.lit(0)), "n": F.sum("own").over(whole), "at": F.min("first").over(whole)})
    return sorted_.withColumn("part", F.shiftright("id", 33)).join(runs, ["conv_id", "part"]).select("conv_id", (F.col("id") - F.col("first") + F.col("earlier")).alias("pos"), "key", "size", "n", "at")


def family(conv_id: Column) -> Column:
    return conv_id - F.pmod(conv_id, F.lit(FAMILY))


def shared(conv_id: Column) -> Column:
    """How many original turns of its family's first conversation a conversation starts with."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % SHARED).cast("long")


def rebuilt(conversations: DataFrame, segment: int = SEGMENT, shard_bits: int = SHARD_BITS) -> DataFrame:
    """ROWS of every rebuilt conversation: the first h = crc32(conv_id) % 9 turns of conversation conv_id - conv_id % 5 (all
    if fewer, none if absent), then its own turns after its first h. One without turns gets a row of kind BARE. conv_id % 5
    is never negative."""
    turns = stored(numbered(conversations), "numbered")
    convs = turns.where("pos = 0").select("conv_id", "n", "at")
    bases = convs.where(F.pmod("conv_id", F.lit(FAMILY)) == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    h = shared(F.col("conv_id"))
    convs = convs.withColumn("base", family(F.col("conv_id"))).join(bases, "base", "left")
    convs = convs.select("conv_id", "base", "n", F.shiftright("at", shard_bits).alias("shard"), h.alias("h"), F.least(h, F.coalesce("base_n", F.lit(0))).alias("lead"))
    convs = stored(convs.withColumn("length", F.col("lead") + F.greatest(F.lit(0), F.col("n") - F.col("h"))), "conversations")
    heads = turns.where((F.pmod("conv_id", F.lit(FAMILY)) == 0) & (F.col("pos") < SHARED)).withColumnRenamed("conv_id", "base").select("base", "pos", "key", "size")
    heads = heads.join(convs.select("base", "conv_id", "shard", "lead", F.col("length").alias("n")), "base").where("pos < lead")
    own = turns.drop("n", "at").join(convs.select("conv_id", "shard", "h", "lead", F.col("length").alias("n")), "conv_id").where("pos >= h").withColumn("pos", F.col("pos") - F.col("h") + F.col("lead"))
    columns = ["shard", "conv_id", "pos", "key", "size", "n"]
    rows = own.select(columns).unionByName(heads.select(columns)).withColumn("kind", F.lit(TURN))
    bare = convs.where("length = 0").select("shard", "conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("size"), F.col("length").alias("n"), F.lit(BARE).alias("kind"))
    return rows.unionByName(bare).withColumn("seg", F.expr(f"pos div {segment}")).select(ROWS)


def segment_heads(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """HEAD rows: the node that each segment but the first of a long conversation starts from, as ``key``."""
    long = rows.where(F.col("n") > segment).groupBy("shard", "conv_id", "seg", "n").agg(F.array_sort(F.collect_list(F.struct("pos", F.hex("key").alias("key")))).alias("k"))  # segment turns at most
    long = long.select("shard", "conv_id", "seg", "n", F.unhex(F.md5(F.array_join(F.transform("k", lambda x: x["key"]), "").cast("binary"))).alias("digest"))
    before = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)  # 16 bytes a segment
    chain = F.aggregate(F.collect_list("digest").over(before), F.lit(ROOT), lambda node, d: F.unhex(F.md5(F.concat(node, d))))
    return long.withColumn("key", chain).where("seg > 0").select("shard", "seg", "conv_id", F.lit(HEAD).alias("kind"), F.lit(0).cast("long").alias("pos"), "key", F.lit(0).cast("long").alias("size"), "n")


@dataclass
class Conversation:
    """A segment of a conversation as a shard holds it. owned: depth from which on it owns its nodes; up: owner of the node before."""

    conv_id: int
    n: int = 0
    start: bytes = ROOT
    turns: list[tuple[int, bytes, int]] = field(default_factory=list)
    owned: int = 1 << 62
    leaf: bool = False
    up: int | None = None
    tail: int = 0


@dataclass
class Node:
    depth: int
    id: bytes
    parent: bytes | None
    above: int
    bits: int
    ends: int
    size: int


def read_shard(shard: pa.Table) -> tuple[int, list[Conversation]]:
    """Segment number and conversations, in order of conv_id, of the rows of one shard."""
    found: dict[int, Conversation] = {}
    columns = [shard.column(c).to_pylist() for c in ROWS[2:]]
    for conv_id, kind, pos, key, size, n in zip(*columns, strict=True):
        c = found.get(conv_id)
        if c is None:
            c = found[conv_id] = Conversation(conv_id)
        if kind == OWNED:
            c.owned, c.leaf, c.up = pos, bool(size), n
        elif kind == TAIL:
            c.tail = size
        else:
            c.n = n
            if kind == HEAD:
                c.start = key
            elif kind == TURN:
                c.turns.append((pos, key, size))
    for c in found.values():
        c.turns.sort()
    return shard.column("seg")[0].as_py(), [found[k] for k in sorted(found)]


def grow(convs: list[Conversation], seg: int, segment: int) -> list[Node]:
    """The nodes that a shard's conversations pass, parents before children; bit k of a bitset is conversation k."""
    postings: dict[tuple[int, bytes], int] = {}
    lengths: dict[int, int] = {}
    tops: dict[bytes, int] = {}
    for k, c in enumerate(convs):
        bit = 1 << k
        for at, (_, key, _) in enumerate(c.turns):
            postings[at, key] = postings.get((at, key), 0) | bit
        if seg * segment + len(c.turns) == c.n:
            lengths[len(c.turns)] = lengths.get(len(c.turns), 0) | bit
        tops[c.start] = tops.get(c.start, 0) | bit
    nodes: list[Node] = []
    todo = [Node(0, start, None, -1, bits, bits & lengths.get(0, 0), 0) for start, bits in tops.items()]
    while todo:
        node = todo.pop()
        here = len(nodes)
        nodes.append(node)
        rest = node.bits & ~node.ends if node.depth < segment else 0
        deeper = lengths.get(node.depth + 1, 0)
        while rest:
            c = convs[(rest & -rest).bit_length() - 1]
            _, key, size = c.turns[node.depth]
            bits = node.bits & postings[node.depth, key]
            rest &= ~bits
            if node.depth + 1 < segment:
                name = hashlib.md5(node.id + key).digest()
            else:
                name = hashlib.md5(c.start + hashlib.md5("".join(k.hex().upper() for _, k, _ in c.turns).encode()).digest()).digest()
            todo.append(Node(node.depth + 1, name, node.id, here, bits, bits & deeper, size))
    return nodes


def first_pass(shard: pa.Table, segment: int = SEGMENT) -> pa.Table:
    """(id, parent, depth, owner, shard, going) of a shard's nodes: owner is its smallest member, going the members that go on."""
    seg, convs = read_shard(shard)
    nodes = [x for x in grow(convs, seg, segment) if x.depth or not seg]
    name = shard.column("shard")[0].as_py()
    return pa.table({
        "id": pa.array([x.id for x in nodes], pa.binary()), "parent": pa.array([x.parent for x in nodes], pa.binary()), "depth": pa.array([seg * segment + x.depth for x in nodes], pa.int64()),
        "owner": pa.array([convs[(x.bits & -x.bits).bit_length() - 1].conv_id for x in nodes], pa.int64()), "shard": pa.array([name] * len(nodes), pa.int64()),
        "going": pa.array([(x.bits & ~x.ends).bit_count() for x in nodes], pa.int64()),
    })


PARTS = "id binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, n_ends long, ends string"


def second_pass(shard: pa.Table, segment: int = SEGMENT) -> pa.Table:
    """PARTS of a shard's nodes. parent_conv_id is set in the shard of the node's owner. A segment's first node has only its children here."""
    seg, convs = read_shard(shard)
    nodes = grow(convs, seg, segment)
    leaves = sum(1 << k for k, c in enumerate(convs) if c.leaf)
    children, saved, out = [0] * len(nodes), [0] * len(nodes), []
    for here in range(len(nodes) - 1, -1, -1):
        x = nodes[here]
        first, depth = convs[(x.bits & -x.bits).bit_length() - 1], seg * segment + x.depth
        own = first.owned <= depth
        if x.depth == 0 and seg:
            out.append((x.id, first.conv_id, depth, None, 0, children[here], 0, 0, 0, None))
            continue
        saved[here] += (x.bits.bit_count() - own) * x.size
        if x.depth == segment:
            saved[here] += sum(c.tail for k, c in enumerate(convs) if x.bits >> k & 1)
        if x.above >= 0:
            children[x.above] += own
            saved[x.above] += saved[here]
        up = (first.up if first.owned == depth else first.conv_id) if own else None
        ends = None
        if x.ends:
            ended, at = bin(x.ends)[:1:-1], -1
            ends = []
            while (at := ended.find("1", at + 1)) >= 0:
                ends.append(str(convs[at].conv_id))
        out.append((x.id, first.conv_id, depth, up, x.bits.bit_count(), children[here], (x.bits & leaves).bit_count(), saved[here], x.ends.bit_count(), ends and ",".join(ends)))
    kinds = [pa.binary(), *[pa.int64()] * 8, pa.string()]
    names = [c.split()[0] for c in PARTS.split(", ")]
    return pa.table({n: pa.array(v, k) for n, k, v in zip(names, kinds, zip(*out, strict=True), strict=True)})


NODES = "node string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, n_ends long, ends_sha256 string"


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """NODES from PARTS sorted by id and conv_id; the parts of a node, whose end lists follow one another, are taken as a stream."""
    names = [c.split()[0] for c in NODES.split(", ")]
    kinds = [pa.string(), *[pa.int64()] * 8, pa.string()]
    now: list | None = None
    digest = None

    def closed() -> tuple:
        return (now[0].hex(), *now[1:9], digest.hexdigest() if digest else NO_ENDS)

    for batch in batches:
        done = []
        for part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is not None and part[0] == now[0]:
                if part[3] is not None:
                    now[3] = part[3]
                for k in range(4, 9):
                    now[k] += part[k]
            else:
                if now is not None:
                    done.append(closed())
                now, digest = list(part[:9]), None
            if part[9] is not None:
                if digest:
                    digest.update(b",")
                else:
                    digest = hashlib.sha256()
                digest.update(part[9].encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for k, v in zip(kinds, zip(*done, strict=True), strict=True)], names)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for k, v in zip(kinds, closed(), strict=True)], names)


def prefix_trie(conversations: DataFrame, segment: int = SEGMENT, shard_bits: int = SHARD_BITS) -> DataFrame:
    """NODES: one row for each distinct sequence of first turns of the rebuilt ``conversations`` (conv_id, turn, role, text).

    node: hex name of the sequence; conv_id: its smallest member; parent_conv_id: its parent's (root: null); saved_tokens:
    over its subtree, itself included, each node's (n_convs - 1) times the UTF-8 bytes of its last text; n_leaves: childless
    nodes of its subtree, itself included; ends_sha256: of the decimal ids of the n_ends members that end here, ascending.

    Null role or text is empty, null turns come first, turns of equal number are in order of a hash of role and text, a
    repeated row is a turn of its own. Rows without conv_id take no part; no rows give no nodes. Other columns are ignored.
    """
    ship(conversations.sparkSession)
    rows = stored(rebuilt(conversations.select("conv_id", "turn", "role", "text"), segment, shard_bits), "rebuilt")
    rows = rows.unionByName(stored(segment_heads(rows, segment), "heads"))
    nodes = rows.groupBy("shard", "seg").applyInArrow(lambda shard: first_pass(shard, segment), "id binary, parent binary, depth long, owner long, shard long, going long")
    nodes = nodes.groupBy("id").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min(F.struct("owner", "shard")).alias("o"), F.sum("going").alias("going"))
    nodes = stored(nodes.select("id", "parent", "depth", "o.owner", "o.shard", "going"), "nodes")
    owners = nodes.groupBy("owner", "shard").agg(F.min("depth").alias("owned"), F.max("depth").alias("length"), F.max_by("going", "depth").alias("going"), F.min_by("parent", "depth").alias("parent"))
    above = nodes.select(F.col("id").alias("parent"), F.col("owner").alias("up"))
    owners = stored(owners.join(above, "parent", "left"), "owners")
    segs = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"greatest(length - 1, 0) div {segment}")))
    told = owners.select("shard", segs.alias("seg"), F.col("owner").alias("conv_id"), F.lit(OWNED).alias("kind"), F.col("owned").alias("pos"), F.lit(None).cast("binary").alias("key"), (F.col("going") == 0).cast("long").alias("size"), F.col("up").alias("n"))

    long = rows.where((F.col("n") > segment) & (F.col("kind") == TURN)).join(owners.select(F.col("owner").alias("conv_id"), "owned"), "conv_id", "left")
    free = F.when(F.col("owned").isNull() | (F.col("pos") + 1 < F.col("owned")), F.col("size")).otherwise(0)
    long = long.groupBy("shard", "conv_id", "seg").agg(F.sum(free).alias("free"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("seg")).rowsBetween(Window.unboundedPreceding, -1)  # a row a segment
    long = long.withColumn("later", F.sum("free").over(later)).where("later > 0")
    tails = long.select("shard", "seg", "conv_id", F.lit(TAIL).alias("kind"), F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("key"), F.col("later").alias("size"), F.lit(None).cast("long").alias("n"))

    parts = rows.unionByName(told).unionByName(tails).groupBy("shard", "seg").applyInArrow(lambda shard: second_pass(shard, segment), PARTS)
    return parts.repartition("id").sortWithinPartitions("id", "conv_id").mapInArrow(fold, NODES)


def trie_nodes(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node."""
    return prefix_trie(conversations).drop("node", "n_ends")


SQL = """
WITH own AS (SELECT CAST(conv_id AS BIGINT) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos,
               md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT c, c - ((c % 5) + 5) % 5 AS base, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda d: [CAST(ascii(d) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
               lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, CAST(3988292384 AS BIGINT) * (s & 1)) END), CAST(4294967295 AS BIGINT)) % 9 AS h FROM (SELECT DISTINCT c FROM own)),
base_n AS (SELECT c, count(*) AS n FROM own GROUP BY c),
conv AS (SELECT crc.c, base, h, least(h, coalesce(n, 0)) AS lead FROM crc LEFT JOIN base_n ON base_n.c = crc.base),
turns AS (SELECT conv.c, own.pos, key, size FROM conv JOIN own ON own.c = conv.base AND own.pos < conv.lead
          UNION ALL SELECT conv.c, own.pos - h + lead, key, size FROM conv JOIN own ON own.c = conv.c AND own.pos >= h),
path AS (SELECT c, pos + 1 AS depth, size, md5(string_agg(key, '') OVER (PARTITION BY c ORDER BY pos)) AS id, coalesce(md5(string_agg(key, '') OVER (PARTITION BY c ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), md5('')) AS parent FROM turns
         UNION ALL SELECT c, 0, 0, md5(''), NULL FROM conv),
len AS (SELECT c, max(depth) AS n FROM path GROUP BY c),
node AS (SELECT id, any_value(parent) AS parent, any_value(depth) AS depth, any_value(size) AS size, min(c) AS conv_id, count(*) AS n_convs,
           string_agg(CAST(CASE WHEN depth = n THEN c END AS VARCHAR), ',' ORDER BY c) AS ends FROM path JOIN len USING (c) GROUP BY id),
kids AS (SELECT parent, count(*) AS k FROM node GROUP BY parent),
below AS (SELECT DISTINCT a.id AS above, b.id FROM path a JOIN path b ON a.c = b.c AND a.depth <= b.depth),
sums AS (SELECT above, sum(CASE WHEN kids.k IS NULL THEN 1 ELSE 0 END) AS leaves, sum((n_convs - 1) * size) AS saved FROM below JOIN node USING (id) LEFT JOIN kids ON kids.parent = node.id GROUP BY above)
SELECT node.conv_id, CAST(node.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(node.n_convs AS BIGINT) AS n_convs, CAST(coalesce(k, 0) AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(node.ends, '')) AS ends_sha256
FROM node LEFT JOIN node up ON up.id = node.parent LEFT JOIN kids ON kids.parent = node.id JOIN sums ON sums.above = node.id
"""
