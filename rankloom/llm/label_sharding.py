"""Sharding by balanced label propagation: linked rows gather in one shard, shard sizes stay even."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.llm.common import drop_stored, join_counted, numbered, stored

CELLS = 1024
FEW = 1000


def fraction(*cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)).cast("double") / float(1 << 30)


def propagate(labels: DataFrame, edges: DataFrame, quota: float, shards: int, rounds: int = 6) -> DataFrame:
    """Move linked nodes towards their neighbours' shards.

    labels: (node, shard) of the linked nodes; edges: (a, b), read in both directions; quota: how many of the linked
    nodes a shard may take. In every round a node that a hash bit makes eligible asks for the shard that most of its
    neighbours are in. As many moves from i to j are granted as come back from j to i, and beyond those as many as j
    has room for under its quota; who moves is decided by a hash, so no task ranks a shard's requests. Only tables of
    shards x shards counts reach the driver.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    found = dict(labels.groupBy("shard").count().collect())
    sizes = [found.get(i, 0) for i in range(shards)]
    for k in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), F.col("shard").alias("to")), "b").groupBy("a", "to").agg(F.count("*").alias("n"))
        best = near.groupBy("a").agg(F.max(F.struct("n", F.negative("to").alias("to"))).alias("best"), F.map_from_entries(F.collect_list(F.struct("to", "n"))).alias("all"))
        asked = labels.join(best, labels["node"] == best["a"], "left").select(
            "node", "shard", F.negative("best.to").alias("to"), (F.col("best.n") - F.coalesce(F.try_element_at("all", F.col("shard")), F.lit(0))).alias("gain")
        )
        eligible = (F.col("gain") > 0) & (F.pmod(F.xxhash64("node", F.lit(k)), F.lit(2)) == 0)
        asked = stored(asked.withColumn("to", F.when(eligible, F.col("to"))).drop("gain"), "asked")
        demand = {(r["shard"], r["to"]): r["count"] for r in asked.where("to is not null").groupBy("shard", "to").count().collect()}
        if not demand:
            if k % 2:
                break
            continue
        granted = {}
        for (i, j), n in demand.items():
            granted[i, j] = min(n, demand.get((j, i), 0))
        for j in range(shards):
            more = sum(n - granted[i, t] for (i, t), n in demand.items() if t == j)
            room = min(1.0, max(0.0, quota - sizes[j]) / more) if more else 0.0
            for (i, t), n in demand.items():
                if t == j:
                    granted[i, t] += (n - granted[i, t]) * room
        for (i, j), n in granted.items():
            sizes[i] -= n
            sizes[j] += n
        rate = F.create_map(*[F.lit(x) for (i, j), n in sorted(granted.items()) for x in (i * shards + j, n / demand[i, j])])
        goes = fraction(F.col("node"), F.lit(-1 - k)) < F.coalesce(F.try_element_at(rate, F.col("shard") * shards + F.col("to")), F.lit(0.0))
        moved = stored(asked.select("node", F.when(F.col("to").isNotNull() & goes, F.col("to")).otherwise(F.col("shard")).alias("shard")), "labels")
        drop_stored(asked)
        labels = moved
    return labels


def shard_rows(rows: DataFrame, node: str, group: str, shards: int = 16, rounds: int = 6) -> DataFrame:
    """Put every row into a shard: counts differ by one at most, rows of one group stay together where they fit.

    Rows whose `group` is equal and not null are linked, each to the group's smallest node. After `propagate`, groups
    that are still cut are joined by `settled` as long as a shard has room for them; then each shard keeps its quota,
    whole groups first, and what is over fills the places that are free elsewhere, so the counts are exact. Adds `shard` and `slot` (gapless from 0 within a shard).

    Defined results: null nodes and null groups are linked with nothing; repeated rows count each and stay
    together; an empty table gives no rows; a group larger than a shard is cut; other columns pass through,
    whatever their names, and columns named shard or slot are replaced.
    """
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    rows = rows.select(F.col(f"`{node}`").alias("__node"), F.col(f"`{group}`").alias("__group"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row"))
    start = F.pmod(F.xxhash64(F.lit("start"), "__node"), F.lit(shards)).cast("int")
    named = rows.where("__group is not null and __node is not null")
    groups = named.groupBy("__group").agg(F.min("__node").alias("__hub"), F.count("*").alias("__n")).where("__n > 1")
    groups = stored(groups.withColumn("__rows", F.col("__n")), "groups")
    total = rows.count()
    joined = join_counted(named, groups, ["__group"], total)
    alone = rows.join(groups.select("__group"), "__group", "left_anti") if total else rows
    alone = alone.unionByName(rows.where("__group is not null and __node is null").join(groups.select("__group"), "__group", "left_semi"))
    linked = joined.unionByName(alone.withColumns({"__hub": F.lit(None).cast(rows.schema["__node"].dataType), "__n": F.lit(None).cast("long")}))
    linked = stored(linked.withColumn("__at", start).drop("__group"), "linked")
    edges = stored(linked.where(F.col("__hub").isNotNull() & (F.col("__node") != F.col("__hub"))).select(F.col("__node").alias("a"), F.col("__hub").alias("b")).distinct(), "edges")
    quota = total / shards  # unlinked rows give way, so all of a shard is open to linked ones
    labels = linked.where("__hub is not null").select(F.col("__node").alias("node"), F.col("__at").alias("shard")).distinct()
    if edges.isEmpty():
        labels = labels.limit(0)
    labels = propagate(stored(labels, "labels"), edges, quota, shards, rounds)
    placed = linked.join(labels, linked["__node"] == labels["node"], "left").drop("node")
    placed = stored(placed.withColumn("__at", F.coalesce("shard", "__at")).drop("shard"), "placed")
    out = balanced(settled(placed, shards), "__node", shards)
    return out.select(*[F.col(f"__row.`{c}`").alias(c) for c in kept], "shard", "slot")


def quotas(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def of_shard(values: list[int], shard: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), shard + 1)


def settled(placed: DataFrame, shards: int) -> DataFrame:
    """Join what propagation left cut: whole groups go to one shard each as long as one has room. Adds `__whole`.

    A group prefers the shard that most of its rows are in. Larger groups come first; those that a shard's quota has
    no room for are laid along the free places of all shards, the freest first, and those that fall within one shard
    go there. This repeats until no group that is left fits the room of any shard; each pass places one at
    least, and leaves one for each border between shards at most. The last FEW groups are placed by the driver, each where it leaves least room, from their sizes.
    """
    quota = quotas(placed.count(), shards)
    can = F.col("__hub").isNotNull() & (F.col("__n") <= quota[0])
    near = placed.where(can).groupBy("__hub", "__n", "__at").agg(F.count("*").alias("n"))
    groups = near.groupBy("__hub", "__n").agg(F.negative(F.max(F.struct("n", F.negative("__at").alias("at")))["at"]).alias("at"))
    cell = F.lit(63 * CELLS) - F.floor(F.log2("__n")).cast("int") * CELLS + F.pmod(F.xxhash64("__hub"), F.lit(CELLS))
    groups = groups.withColumn("cell", cell)
    order, done = [F.negative("__n"), F.col("__hub")], []
    tried = numbered(groups, ["at"], "cell", order, F.col("__n"), "start")
    tried = stored(tried.withColumn("fits", F.col("start") + F.col("__n") <= of_shard(quota, F.col("at"))).drop("start"), "tried")
    free = list(quota)
    while True:
        done.append(tried.where("fits").select(F.col("__hub").alias("hub"), F.col("at").alias("to")))
        for r in tried.where("fits").groupBy("at").agg(F.sum("__n").alias("n")).collect():
            free[r["at"]] -= r["n"]
        left = tried.where(~F.col("fits") & (F.col("__n") <= max(free))).select("__hub", "__n", "cell")
        count = left.count()
        if count <= FEW:
            break
        tried = numbered(left, [], "cell", order, F.col("__n"), "start")
        at, first = F.lit(None).cast("int"), 0
        for i in sorted(range(shards), key=lambda i: -free[i]):
            at = F.when((F.col("start") >= first) & (F.col("start") + F.col("__n") <= first + free[i]), F.lit(i)).otherwise(at)
            first += free[i]
        tried = stored(tried.withColumn("at", at).withColumn("fits", F.col("at").isNotNull()).drop("start"), "tried")
    if count:
        last = stored(left.withColumn("i", F.row_number().over(Window.orderBy(*order))), "last")
        to = []
        for r in last.orderBy("i").select("__n").collect():
            room = [i for i in range(shards) if free[i] >= r["__n"]]
            to.append(min(room, key=lambda i: (free[i], i)) if room else -1)
            if room:
                free[to[-1]] -= r["__n"]
        last = last.withColumn("to", F.element_at(F.split(F.lit(",".join(map(str, to))), ","), F.col("i")).cast("int"))
        done.append(last.where("to >= 0").select(F.col("__hub").alias("hub"), "to"))
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d)
    some = placed.where(can).join(whole, F.col("__hub") == F.col("hub"), "left")
    some = some.withColumns({"__whole": F.col("to").isNotNull(), "__at": F.coalesce("to", "__at")}).drop("hub", "to")
    return some.unionByName(placed.where(~can).withColumn("__whole", F.lit(False)))


def balanced(placed: DataFrame, node: str, shards: int) -> DataFrame:
    """Exact quotas: rows beyond a shard's quota, unlinked ones first, then those of cut groups, go to the free places of the others."""
    kind = F.when(F.col("__whole"), F.lit(0)).when(F.col("__hub").isNotNull(), F.lit(1)).otherwise(F.lit(2))
    total = placed.count()
    # A group of more than a fraction of a cell's rows is dealt over the cells of its shard, so that no cell is hot.
    salt = F.when(F.col("__n") > max(16, total // (16 * CELLS)), F.xxhash64(node)).otherwise(F.lit(0))
    cell = kind * CELLS + F.pmod(F.xxhash64(F.coalesce("__hub", node), salt), F.lit(CELLS))
    placed = placed.withColumn("__cell", cell)
    ranked = numbered(placed, ["__at"], "__cell", [F.col("__hub"), F.col(node)], F.lit(1), "__rank").drop("__cell")
    ranked = stored(ranked, "ranked")
    held = dict(ranked.groupBy("__at").count().collect())  # one row for each shard
    quota = quotas(total, shards)
    over = [max(0, held.get(i, 0) - quota[i]) for i in range(shards)]
    free = [max(0, quota[i] - held.get(i, 0)) for i in range(shards)]
    place = lambda values: of_shard(values, F.col("__at"))
    extra = F.col("__rank") - place(quota) + place([sum(over[:i]) for i in range(shards)])
    keeps = F.col("__rank") < place(quota)
    to, slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i in range(shards):
        first = sum(free[:i])
        mine = (extra >= first) & (extra < first + free[i])
        to = F.when(mine, F.lit(i)).otherwise(to)
        slot = F.when(mine, held.get(i, 0) + extra - first).otherwise(slot)
    out = ranked.withColumns({"shard": F.when(keeps, F.col("__at")).otherwise(to).cast("int"), "slot": F.when(keeps, F.col("__rank")).otherwise(slot).cast("long")})
    return out.drop("__rank")
