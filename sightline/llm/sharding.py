"""Resharding by minimum-cost flow: new shards of equal bytes for the fewest bytes moved.

The old shards' bytes flow to the new shards' capacities at a cost of one for each byte that leaves its shard. The flow out
of an old shard cuts the line of its documents into ranges, one for each target. The line is counted in blocks and ordered
by text, so copies in one old shard stay next to each other. Whole documents don't end at the cuts, so a few documents
(RESERVE a shard, the least by hash) are held back and then put, largest first, where the most is missing among the shards
that the flow sends bytes of theirs to, or among all where none of those lacks half of a document's bytes; so they level
the shards and move hardly any bytes that the flow would leave.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import BROADCAST_ROWS, cut, remove

#: Blocks that each old shard is counted in at least, and rows of a block from which there are more blocks.
BLOCKS = 256
ROWS_A_BLOCK = 20_000
#: Copies of one text in one old shard that share a block and so stay next to each other; more are dealt to several blocks.
COPIES = 250
#: Documents held back for each new shard, and the share of all documents that they are at most.
RESERVE = 16
RESERVE_SHARE = 0.5


def min_cost_flow(supply: list[int], demand: list[int], cost: np.ndarray) -> np.ndarray:
    """Units from each supply to each demand (equal totals) at the least total cost, by the primal-dual method.

    cost[i, j] >= 0. Shortest distances in the residual network give potentials; as much as can goes along arcs of no
    reduced cost (a maximum flow by levels), and then distances are found anew. There is one round for each distance that
    paths have, so few for costs of few values.
    """
    cost = np.asarray(cost, float)
    n, m = cost.shape
    flow = np.zeros((n, m), np.int64)
    left, need = np.array(supply, np.int64), np.array(demand, np.int64)
    high, low = np.zeros(n), np.zeros(m)
    while left.any():
        reduced = np.maximum(cost + high[:, None] - low[None, :], 0.0)
        du, dv = _distances(reduced, flow, left)
        high += np.minimum(du, dv.max())
        low += dv
        _saturate(np.abs(cost + high[:, None] - low[None, :]) < 1e-9, flow, left, need)
    return flow


def _distances(reduced: np.ndarray, flow: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances from the supplies with something left; arcs with flow go back at no reduced cost."""
    n, m = reduced.shape
    near = np.concatenate((np.where(left > 0, 0.0, np.inf), np.full(m, np.inf)))
    final = np.full(n + m, np.inf)
    for _ in range(n + m):
        u = int(np.argmin(near))
        d = near[u]
        if d == np.inf:
            break
        final[u], near[u] = d, np.inf
        if u < n:
            to, through = slice(n, n + m), d + reduced[u]
        else:
            to, through = slice(0, n), np.where(flow[:, u - n] > 0, d, np.inf)
        open_ones = final[to] == np.inf
        near[to] = np.where(open_ones, np.minimum(near[to], through), np.inf)
    return final[:n], final[n:]


def _saturate(free: np.ndarray, flow: np.ndarray, left: np.ndarray, need: np.ndarray) -> None:
    """Sends all that can be sent over free arcs and back over those with flow."""
    n, m = free.shape
    while True:
        level_u, level_v = np.where(left > 0, 0, -1), np.full(m, -1)
        front, depth, met = np.flatnonzero(left > 0), 0, False
        while len(front) and not met:
            new = np.flatnonzero(free[front].any(axis=0) & (level_v < 0))
            level_v[new] = depth + 1
            met = bool(need[new].any())
            front = np.flatnonzero(((flow[:, new] > 0) & free[:, new]).any(axis=1) & (level_u < 0)) if len(new) else new
            level_u[front] = depth + 2
            depth += 2
        if not met:
            return
        ahead: dict[int, list[int]] = {}

        def arcs(node: int) -> list[int]:
            if node not in ahead:
                if node < n:
                    ahead[node] = (n + np.flatnonzero(free[node] & (level_v == level_u[node] + 1))).tolist()
                else:
                    v = node - n
                    ahead[node] = [] if level_v[v] >= depth - 1 else np.flatnonzero(free[:, v] & (flow[:, v] > 0) & (level_u == level_v[v] + 1)).tolist()
            return ahead[node]

        for source in np.flatnonzero(left > 0).tolist():
            path = [source]
            while path and left[source]:
                node = path[-1]
                if node >= n and need[node - n]:
                    back = [flow[v, u - n] for u, v in zip(path, path[1:]) if u >= n]
                    sent = min(left[source], need[node - n], *back) if back else min(left[source], need[node - n])
                    for u, v in zip(path, path[1:]):
                        if u < n:
                            flow[u, v - n] += sent
                        else:
                            flow[v, u - n] -= sent
                    left[source] -= sent
                    need[node - n] -= sent
                    path = [source]
                    continue
                # an arc back that has no flow any more leads nowhere
                while arcs(node) and node >= n and not flow[arcs(node)[-1], node - n]:
                    arcs(node).pop()
                if arcs(node):
                    path.append(arcs(node)[-1])
                else:
                    path.pop()
                    if path:
                        arcs(path[-1]).pop()


def _shares(total: int, parts: int) -> list[int]:
    return [total // parts + (j < total % parts) for j in range(parts)]


def _rows(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(map(int, x)) for x in rows], schema)


def reshard(docs: DataFrame, old_shard: Column, new_shards: int = 40, blocks: int = BLOCKS, reserve: int = RESERVE) -> DataFrame:
    """(doc_id, size, text_crc32, old_shard, shard, slot) for each row of docs (doc_id, text): near-equal bytes a shard.

    old_shard is an int expression from 0; old shard i and new shard i are the same files. size is the text's UTF-8 bytes
    (null: none) plus 16; slot numbers a shard's rows from 0 without gaps. Of a text's copies in one old shard up to COPIES
    stay together, but where a cut falls or where one is held back; copies in other old shards stay in theirs, because
    bringing them together would move bytes. The driver holds one sum for each old or new shard, never documents but the
    reserve. A null old shard counts as shard 0; repeated rows are placed once each; row_key, if docs has it, is returned
    too; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    key = [c for c in docs.columns if c == "row_key"]
    slim = docs.select("doc_id", *key, (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.coalesce(old_shard.cast("int"), F.lit(0)).alias("old_shard"), F.xxhash64(text).alias("rank"))
    slim = cut(slim).withColumn("uid", F.monotonically_increasing_id()).withColumn("lot", F.xxhash64("uid"))
    olds = {r[0]: r[1] for r in slim.groupBy("old_shard").count().collect()}
    total = sum(olds.values())

    held = slim.orderBy("lot", "uid").limit(int(min(reserve * new_shards, RESERVE_SHARE * total + 1))).select("uid", "lot", "size", "old_shard").toPandas()
    bound = int(held["lot"].max()) if len(held) else -(1 << 63)
    rest = slim.filter(F.col("lot") > bound)

    # texts with many copies are few: at most BROADCAST_ROWS
    most = max(COPIES, total // BROADCAST_ROWS)
    copies = rest.groupBy(F.col("rank").alias("c_rank"), F.col("old_shard").alias("c_old")).agg(F.count("*").alias("n")).filter(F.col("n") > most)
    copies = F.broadcast(copies.select("c_rank", "c_old", F.ceil(F.col("n") / most).alias("parts")))
    numbers = F.broadcast(_rows(spark, [(i, max(blocks, -(-n // ROWS_A_BLOCK))) for i, n in olds.items()], "b_old int, blocks long"))
    rest = rest.join(numbers, F.col("old_shard") == F.col("b_old")).join(copies, (F.col("rank") == F.col("c_rank")) & (F.col("old_shard") == F.col("c_old")), "left")
    part = F.pmod("lot", F.coalesce("parts", F.lit(1)))
    rest = rest.withColumn("block", F.pmod(F.xxhash64("rank", part), F.col("blocks"))).drop("b_old", "blocks", "c_rank", "c_old", "parts")
    counted = cut(rest.groupBy(F.col("old_shard").alias("r_old"), F.col("block").alias("r_block")).agg(F.sum("size").alias("bytes")))

    # the flow is that of all bytes; the held back ones leave each range of a line in proportion
    kept = {r[0]: int(r[1]) for r in counted.groupBy("r_old").agg(F.sum("bytes")).collect()}
    supply = {i: kept.get(i, 0) for i in olds}
    for i, size in held.groupby("old_shard")["size"].sum().items():
        supply[int(i)] += int(size)
    lines = sorted(supply)
    cost = np.array([[0.0 if i == j else 1.0 for j in range(new_shards)] for i in lines]).reshape(len(lines), new_shards)
    flow = min_cost_flow([supply[i] for i in lines], _shares(sum(supply.values()), new_shards), cost)
    ranges, ways = [], {}
    for row, i in enumerate(lines):
        at = 0
        # what stays comes first
        targets = ways[i] = [j for j in sorted(range(new_shards), key=lambda j: (j != i, j)) if flow[row, j]]
        for j in targets:
            at += int(flow[row, j])
            low, high = (x * kept.get(i, 0) // supply[i] for x in (at - int(flow[row, j]), at))
            ranges.append((i, low, high if j != targets[-1] else (1 << 62), j))

    starts = counted.select("r_old", "r_block", (F.sum("bytes").over(Window.partitionBy("r_old").orderBy("r_block")) - F.col("bytes")).alias("before"))
    cuts = F.broadcast(_rows(spark, ranges, "c_old int, low long, high long, shard int"))
    line = Window.partitionBy("old_shard", "block").orderBy("rank", "uid")
    within = Window.partitionBy("old_shard", "block", "shard").orderBy("rank", "uid")
    middle = F.col("before") + F.sum("size").over(line) - F.expr("size div 2") - 1
    placed = rest.join(starts, (F.col("old_shard") == F.col("r_old")) & (F.col("block") == F.col("r_block"))).withColumn("middle", middle)
    placed = placed.join(cuts, (F.col("old_shard") == F.col("c_old")) & (F.col("middle") >= F.col("low")) & (F.col("middle") < F.col("high")))
    placed = placed.withColumn("place", F.row_number().over(within) - 1).select("doc_id", *key, "size", "text_crc32", "old_shard", "shard", "block", "place")

    parts = cut(placed.groupBy(F.col("shard").alias("p_shard"), F.col("old_shard").alias("p_old"), F.col("block").alias("p_block")).agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")))
    last = _place_reserve(held, parts.groupBy("p_shard").agg(F.sum("rows"), F.sum("bytes")).collect(), _shares(sum(supply.values()), new_shards), ways)
    offsets = parts.select("p_shard", "p_old", "p_block", (F.sum("rows").over(Window.partitionBy("p_shard").orderBy("p_old", "p_block")) - F.col("rows")).alias("offset"))
    placed = placed.join(offsets, (F.col("shard") == F.col("p_shard")) & (F.col("old_shard") == F.col("p_old")) & (F.col("block") == F.col("p_block")))
    out = ["doc_id", "size", "text_crc32", "old_shard", "shard", "slot", *key]
    fixed = slim.filter(F.col("lot") <= bound).join(F.broadcast(_rows(spark, last, "h_uid long, shard int, slot long")), F.col("uid") == F.col("h_uid"))
    return placed.withColumn("slot", F.col("offset") + F.col("place")).select(*out).union(fixed.select(*out))


def _place_reserve(held: pd.DataFrame, filled: list[tuple[int, int, int]], capacity: list[int], ways: dict[int, list[int]]) -> list[tuple[int, int, int]]:
    """(uid, shard, slot) of the documents held back: largest first, each to the shard that lacks most of its capacity among
    those in `ways` of its old shard, or among all if that one lacks less than half of it; filled has a shard's rows and
    bytes so far."""
    rows, lack = np.zeros(len(capacity), np.int64), np.array(capacity, np.int64)
    for j, n, size in filled:
        rows[j] += n
        lack[j] -= size
    targets = {i: np.array(js, np.int64) for i, js in ways.items()}
    out = []
    for uid, own, old in held.sort_values(["size", "uid"], ascending=[False, True])[["uid", "size", "old_shard"]].itertuples(index=False):
        open_ones = targets[int(old)]
        j = int(open_ones[np.argmax(lack[open_ones])])
        if 2 * lack[j] < own:
            j = int(np.argmax(lack))
        out.append((int(uid), j, int(rows[j])))
        rows[j] += 1
        lack[j] -= int(own)
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """docs with row_key, a number of its own for each row, written once so that every use reads the same numbers."""
    return cut(docs.withColumn("row_key", F.monotonically_increasing_id()))


def rewrite_affected(docs: DataFrame, placed: DataFrame, folder: str, rows_a_file: int = 100_000) -> list[int]:
    """Writes the shards that lose or gain rows under folder (one subfolder each) and returns their numbers.

    Shards whose rows all stay keep their files, and those left without rows lose theirs. docs and placed are matched by
    row_key if both have it (see keyed(); it is not written), else by doc_id, which must then be unique and not null
    (ValueError). A large shard is written by several tasks. Files change when all are written, but not all at one moment.
    """
    key = "row_key" if "row_key" in docs.columns and "row_key" in placed.columns else "doc_id"
    for side in (docs, placed):
        if not side.groupBy(key).count().filter(F.col(key).isNull() | (F.col("count") > 1)).isEmpty():
            raise ValueError(f"{key} must be unique and not null: give docs by keyed()")
    moved = placed.filter("shard <> old_shard")
    affected = sorted(r[0] for r in moved.select(F.explode(F.array("shard", "old_shard")).alias("s")).distinct().collect())
    rows = placed.filter(F.col("shard").isin(affected)).select(F.col(key).alias("p_key"), "shard", "slot")
    filled = {r[0] for r in rows.select("shard").distinct().collect()}
    # a layout that was read has these columns already
    out = docs.drop("shard", "slot").join(rows, F.col(key) == F.col("p_key")).drop("p_key", "row_key")
    out = out.repartition(F.col("shard"), F.expr(f"slot div {rows_a_file}")).sortWithinPartitions("shard", "slot")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(folder)
    for shard in set(affected) - filled:
        remove(docs.sparkSession, f"{folder}/shard={shard}")
    return affected
