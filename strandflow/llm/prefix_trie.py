"""Prefix trie of conversations: hash-partitioned by first turn, pointer tries in groups, large subtries split by the next turn.

A conversation is its turns in ascending order (null first; turns of equal number in the order of their
digests). Null role or text count as empty; rows without conv_id belong to no conversation and are left out.
`rebuilt` puts the first h turns of conversation c - c % 100 (towards zero) before c's own turns after its
first h, h being the CRC-32 of c in decimal modulo HEADS; so c may be left without turns.

A turn is a step of 20 bytes: 128 bits of SHA-256 of its role and text, and the number of code points of the
text. A conversation is a path of steps: texts are read once and not moved. Equal paths are one row with a
count, the smallest conv_id, and the digest of all their conv_ids, which run in order through one hash in
packs, never as a group in memory. Paths are dealt out by a digest of the first step. Where more than LIMIT
paths share it, they have their longest common path in common (that of the least and the greatest), which
makes a chain of nodes; its paths are dealt out by the next step, and so on, so no first turn, however
frequent, is built by one task. Each bucket of subtries is built inside applyInPandas: nodes point to their
children by dictionaries and are made parents first, so that going backwards through them is a postorder.
Chains above add up their subtries' sums, round by round, the root at last.

A conversation's steps, 20 bytes each, stand in one row. An empty table gives an empty one; repeated rows are
turns again. Only conv_id, turn, role and text are read; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import cut, partitions

#: Bytes of a step: digest and length of a turn.
STEP = 20
#: A conversation takes fewer than HEADS turns of the first one of its BLOCK.
HEADS, BLOCK = 6, 100
#: Distinct paths that may share a first step before they are split by the next one.
LIMIT = 256
#: Distinct paths of a bucket, on average.
BUCKET = 4096
#: Numbers that are packed into one row of the digest of conv_ids.
PACK = 65_536
NOTHING = hashlib.sha256(b"").hexdigest()
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary, top boolean, above binary"


def _short(data: Column) -> Column:
    return F.substring(F.unhex(F.sha2(data, 256)), 1, 16)


def paths(conversations: DataFrame) -> DataFrame:
    """conv_id and path, its steps in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    step = F.concat(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32), F.lpad(F.hex(F.length(text)), 8, "0"))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", step.alias("step")).alias("t"))
    inside = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t"), _in_order).alias("t"))
    return inside.select("conv_id", F.unhex(F.array_join(F.transform("t", lambda x: x["step"]), "")).alias("path"))


def _in_order(a: Column, b: Column) -> Column:
    """Turns by number, null first, then by step."""
    less = (a["turn"].isNull() & b["turn"].isNotNull()) | (a["turn"] < b["turn"])
    same = a["turn"].eqNullSafe(b["turn"])
    return F.when(F.coalesce(less, F.lit(False)) | (same & (a["step"] < b["step"])), -1).when(same & (a["step"] == b["step"]), 0).otherwise(1)


def rebuilt(whole: DataFrame) -> DataFrame:
    """conv_id and path, each with the head of the first conversation of its block."""
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS * STEP).cast("int")
    heads = whole.where(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("base"), F.substring("path", 1, (HEADS - 1) * STEP).alias("head"))
    met = whole.withColumn("base", F.col("conv_id") - F.col("conv_id") % BLOCK).join(heads, "base", "left")
    return met.select("conv_id", F.concat(F.substring(F.coalesce("head", F.lit(b"")), F.lit(1), h), F.substring("path", h + 1, F.lit(1 << 30))).alias("path"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs of the sorted rows' conv_ids, comma-joined, each with its smallest."""
    end, held = None, []

    def full() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([end], pa.binary()), pa.array([held[0]], pa.int64()), pa.array([",".join(map(str, held))], pa.string())], names=["end", "first", "ids"])

    for batch in batches:
        for e, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and (e != end or len(held) >= PACK):
                yield full()
                held = []
            end = e
            held.append(c)
    if held:
        yield full()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each end's packs, which come in order, joined by commas."""
    end, sha = None, None
    for batch in batches:
        out: list[tuple[bytes, bytes]] = []
        for e, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if sha is not None and e == end:
                sha.update(b",")
            else:
                if sha is not None:
                    out.append((end, sha.digest()))
                end, sha = e, hashlib.sha256()
            sha.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], names=["end", "ends"])
    if sha is not None:
        yield pa.RecordBatch.from_arrays([pa.array([end], pa.binary()), pa.array([sha.digest()], pa.binary())], names=["end", "ends"])


def distinct_paths(whole: DataFrame) -> DataFrame:
    """Each distinct path once: n, its conversations, `first`, the smallest conv_id, and `ends`, the digest of all conv_ids in order."""
    rows = whole.select(_short(F.col("path")).alias("end"), "conv_id")
    packs = rows.repartitionByRange("end", "conv_id").sortWithinPartitions("end", "conv_id").mapInArrow(_pack, "end binary, first long, ids string")
    digests = packs.repartition("end").sortWithinPartitions("end", "first").mapInArrow(_digest, "end binary, ends binary")
    grouped = whole.groupBy("path").agg(F.count("*").alias("n"), F.min("conv_id").alias("first"))
    return grouped.withColumn("end", _short(F.col("path"))).join(digests, "end").drop("end")


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a bucket's subtries, whose paths come with the depth of their subtrie's top and what stands above it."""
    tops: dict[bytes, int] = {}
    children: list[dict[bytes, int]] = []
    nodes: list[list] = []  # depth, code points, parent's place or -1, conv_id of the top's parent, what is above it, conv_id, n_convs, ends
    for path, n, first, ends, depth, parent, above in zip(*(rows[c] for c in ("path", "n", "first", "ends", "depth", "parent", "above")), strict=True):
        at, pointers, key = -1, tops, bytes(path[: depth * STEP])
        for d in range(depth, len(path) // STEP + 1):
            step = path[(d - 1) * STEP : d * STEP]
            place = pointers.get(key if d == depth else step)
            if place is None:
                place = len(nodes)
                pointers[key if d == depth else step] = place
                nodes.append([d, int.from_bytes(step[16:], "big"), at, parent, above, first, 0, None])
                children.append({})
            node = nodes[place]
            node[5] = min(node[5], first)
            node[6] += n
            at, pointers = place, children[place]
        nodes[at][7] = ends
    leaves, saved = [0] * len(nodes), [0] * len(nodes)
    out = []
    for i in range(len(nodes) - 1, -1, -1):  # children are made after their parents: a postorder
        d, size, up, parent, above, conv, n, ends = nodes[i]
        leaves[i] = leaves[i] or 1
        saved[i] += (n - 1) * size
        if up >= 0:
            leaves[up] += leaves[i]
            saved[up] += saved[i]
        out.append((conv, d, nodes[up][5] if up >= 0 else parent, n, len(children[i]), leaves[i], saved[i], ends, up < 0, above if up < 0 else None))
    return pd.DataFrame(out, columns=[c.split()[0] for c in NODES.split(", ")])


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with `deep`, how many steps least and greatest path have in common, and `sizes`, the code points of those from `depth` on."""
    for batch in batches:
        deep, sizes = [], []
        for r in batch.to_pylist():
            a, b = r["least"], r["most"]
            d = r["depth"]
            while (d + 1) * STEP <= min(len(a), len(b)) and a[d * STEP : (d + 1) * STEP] == b[d * STEP : (d + 1) * STEP]:
                d += 1
            deep.append(d)
            sizes.append([int.from_bytes(a[i * STEP + 16 : (i + 1) * STEP], "big") for i in range(r["depth"] - 1, d)])
        kept = batch.drop_columns(["least", "most"])
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(deep, pa.int32()), pa.array(sizes, pa.list_(pa.int64()))], names=[*kept.schema.names, "deep", "sizes"])


def _split(live: DataFrame, limit: int) -> tuple[DataFrame, DataFrame] | None:
    """Chains of the paths that too many share, and all paths with `deep`, how deep that chain reaches; None if there are none.

    The join takes a key's paths apart where they are many, as it is a plain one on the key.
    """
    shared = live.groupBy("key").agg(F.count("*").alias("rows"), F.sum("n").alias("n"), F.min("first").alias("first"), F.min("path").alias("least"), F.max("path").alias("most"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("above").alias("above"))
    shared = shared.where(F.col("rows") > limit).drop("rows")
    kind = "key binary, n long, first long, depth int, parent long, above binary, deep int, sizes array<long>"
    chains = cut(shared.mapInArrow(_common, kind))
    if chains.isEmpty():
        return None
    return chains, cut(live.join(chains.select("key", F.col("first").alias("chain_first"), "deep"), "key", "left"))


def _chain_nodes(chains: DataFrame, pool: DataFrame, ends: DataFrame) -> DataFrame:
    """The nodes of chains, from the sums of the subtries below them; `ends` has the digest of the path that is a whole chain."""
    below = pool.groupBy("above").agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("below"))
    rows = chains.join(below.withColumnRenamed("above", "key"), "key").join(ends, "key", "left")
    each = rows.select("*", F.posexplode("sizes").alias("i", "size"))
    last, top = F.col("i") == F.size("sizes") - 1, F.col("i") == 0
    own = F.aggregate(F.slice("sizes", F.col("i") + 1, F.size("sizes")), F.lit(0).cast("long"), lambda a, x: a + x)
    return each.select(
        F.col("first").alias("conv_id"), (F.col("depth") + F.col("i")).cast("long").alias("depth"), F.when(top, F.col("parent")).otherwise(F.col("first")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(last, F.col("kids")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("below") + (F.col("n") - 1) * own).alias("saved_tokens"), F.when(last, F.col("ends")).alias("ends"), top.alias("top"), F.when(top, F.col("above")).alias("above"),
    )


def trie(whole: DataFrame, limit: int = LIMIT, bucket: int = BUCKET) -> DataFrame:
    """The nodes of the trie of (conv_id, path)."""
    spark = whole.sparkSession
    found = cut(distinct_paths(whole))
    total = found.agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.count("*").alias("rows")).first()
    root = b""
    at = lambda depth: _short(F.substring("path", F.lit(1), depth * STEP))
    live = found.where(F.length("path") > 0).select("path", "n", "first", "ends", F.lit(1).alias("depth"), F.lit(total.first).cast("long").alias("parent"), F.lit(root).alias("above")).withColumn("key", at(F.col("depth")))
    small, rounds = [], []
    while split := _split(live, limit):
        chains, judged = split
        small.append(judged.where("deep IS NULL").select("path", "n", "first", "ends", "depth", "parent", "above", "key"))
        over = judged.where("deep IS NOT NULL")
        rounds.append((chains, over.where(F.length("path") == F.col("deep") * STEP).select("key", "ends")))
        further = over.where(F.length("path") > F.col("deep") * STEP)
        live = further.select("path", "n", "first", "ends", (F.col("deep") + 1).alias("depth"), F.col("chain_first").alias("parent"), F.col("key").alias("above")).withColumn("key", at(F.col("depth")))
    for part in small:
        live = live.unionByName(part)
    buckets = max(partitions(spark), total.rows // bucket + 1)
    dealt = live.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")).drop("key")
    nodes = cut(dealt.groupBy("bucket").applyInPandas(_build, NODES))
    pool = nodes.where("top").select("above", "n_leaves", "saved_tokens")
    for chains, ends in reversed(rounds):
        made = cut(_chain_nodes(chains, pool, ends))
        nodes, pool = nodes.unionByName(made), pool.unionByName(made.where("top").select("above", "n_leaves", "saved_tokens"))
    if total.n is not None:
        none = F.lit(0).cast("long")
        tops = pool.where(F.col("above") == root).select(F.lit(1).alias("kids"), "n_leaves", "saved_tokens", F.lit(None).cast("binary").alias("ends"))
        parts = tops.unionByName(found.where(F.length("path") == 0).select(F.lit(0).alias("kids"), none.alias("n_leaves"), none.alias("saved_tokens"), "ends"))
        top = parts.agg(F.sum("kids").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("ends").alias("ends")).select(
            F.lit(total.first).cast("long").alias("conv_id"), none.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(total.n).cast("long").alias("n_convs"), "n_children",
            F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), "saved_tokens", "ends", F.lit(True).alias("top"), F.lit(None).cast("binary").alias("above"),
        )
        nodes = nodes.unionByName(top)
    ends = F.coalesce(F.lower(F.hex("ends")), F.lit(NOTHING))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends.alias("ends_sha256"))


def nodes(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie(rebuilt(paths(conversations)))
