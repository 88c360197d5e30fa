"""Problem 7: fill containers of fixed capacity with items, by grouping genetic algorithms on islands.

Items are dealt by hash into shards of bounded size. A shard has several islands, each with its own population of
packings. Crossover injects the best-filled containers of one packing into another, drops the containers that now
hold duplicates, and puts the displaced items back by best fit. Between epochs every island gets the elite of its
neighbour. The shard's best packing counts; its poorly filled containers are dealt anew with those of other shards
and packed again.

An item larger than the capacity is cut into pieces: full ones, which are containers of their own, and one rest.
Nothing else is cut.

Defined results for odd input: items without tokens take no room and share a container; rows with a null id are
left out; of repeated ids the largest size counts; capacities that are null or below 1 are left out.
"""

from __future__ import annotations

import bisect
import itertools
import random
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslane.runtime import cut_lineage

SHARD_ITEMS = 600
ISLANDS = 2
EPOCHS = 2
#: An island evolves until so many generations in a row have made no better packing, or none can have fewer containers.
GENERATIONS = 24
POPULATION = 4
#: Containers filled below this share are opened and packed again with those of other shards.
REPACK_BELOW = 0.985
REPACK_ROUNDS = 1

Box = tuple[int, list[int]]  # tokens in it, and its items
Packing = list[Box]


def _fitness(packing: Packing, capacity: int) -> float:
    if not packing:
        return 1.0
    return sum((fill / capacity) ** 2 for fill, _ in packing) / len(packing)


def best_fit(packing: Packing, loose: list[int], sizes: list[int], capacity: int) -> Packing:
    """Puts ``loose`` items, largest first, into the fullest container with room, opening new ones as needed.

    Boxes are not changed in place, so packings may share them.
    """
    room = sorted((capacity - fill, b) for b, (fill, _) in enumerate(packing))
    opened: dict[int, list[int]] = {}
    fills = [fill for fill, _ in packing]
    for item in sorted(loose, key=lambda i: (-sizes[i], i)):
        size = sizes[item]
        at = bisect.bisect_left(room, (size, -1))
        if at == len(room):
            b, left = len(fills), capacity
            fills.append(0)
            opened[b] = []
        else:
            left, b = room.pop(at)
            if b not in opened:
                opened[b] = list(packing[b][1])
        opened[b].append(item)
        fills[b] += size
        bisect.insort(room, (left - size, b))
    return [(fill, opened[b] if b in opened else packing[b][1]) for b, fill in enumerate(fills)]


def crossover(mother: Packing, father: Packing, sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    ranked = sorted(father, key=lambda box: -box[0])
    injected = [b for b in ranked[: max(1, len(ranked) // 3)] if rng.random() < 0.6] or [ranked[0]]
    taken = {i for _, box in injected for i in box}
    child, loose = injected, []
    for box in mother:
        if taken.isdisjoint(box[1]):
            child.append(box)
        else:
            loose += [i for i in box[1] if i not in taken]
    return best_fit(child, loose, sizes, capacity)


def mutate(packing: Packing, sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    """Opens the least filled containers and a few others, and puts their items back in a shaken order."""
    order = sorted(range(len(packing)), key=lambda b: packing[b][0])
    opened = set(order[: max(1, len(order) // 12)]) | {rng.randrange(len(packing)) for _ in range(max(2, len(packing) // 10))}
    loose = [i for b in sorted(opened) for i in packing[b][1]]
    kept = [box for b, box in enumerate(packing) if b not in opened]
    early = [i for i in loose if rng.random() < 0.25]
    early_set = set(early)
    return best_fit(best_fit(kept, early, sizes, capacity), [i for i in loose if i not in early_set], sizes, capacity)


def least_boxes(sizes: list[int], capacity: int) -> int:
    """A number of containers that no packing falls below (bound L2 of Martello and Toth; no size exceeds the capacity).

    Items above ``capacity - a`` meet none of ``a`` or more, those above half meet none of each other, and only the room
    beside the latter takes the others of ``a`` or more.
    """
    rising = sorted(sizes)
    sums = [0, *itertools.accumulate(rising)]
    half = bisect.bisect_right(rising, capacity / 2)
    least = -(-sums[-1] // capacity)
    for a in {0, *rising[:half]}:
        low, high = bisect.bisect_left(rising, a), bisect.bisect_right(rising, capacity - a)
        middle = max(0, high - half)
        room = middle * capacity - (sums[half + middle] - sums[half])
        least = max(least, len(rising) - half + max(0, -(-(sums[half] - sums[low] - room) // capacity)))
    return least


def evolve(sizes: list[int], capacity: int, elites: list[list[list[int]]], rng: random.Random, generations: int = GENERATIONS) -> list[list[int]]:
    """The best packing (items of each box) of an island from ``elites`` and shaken best-fit packings.

    The search ends where a packing has as few boxes as any can have, or after so many generations without a better one.
    """
    population: list[Packing] = [[(sum(sizes[i] for i in box), box) for box in e] for e in elites] or [best_fit([], list(range(len(sizes))), sizes, capacity)]
    least = least_boxes(sizes, capacity) if generations else 0
    while generations and len(population) < POPULATION:
        population.append(mutate(population[0], sizes, capacity, rng))
    scored = sorted(((_fitness(p, capacity), n, p) for n, p in enumerate(population)), key=lambda x: -x[0])
    step = idle = 0
    while idle < generations and len(scored[0][2]) > max(1, least):
        mother, father = rng.sample([p for _, _, p in scored[:POPULATION]], 2)
        child = crossover(mother, father, sizes, capacity, rng)
        if rng.random() < 0.7:
            child = mutate(child, sizes, capacity, rng)
        idle = 0 if (fitness := _fitness(child, capacity)) > scored[0][0] + 1e-12 else idle + 1
        scored = sorted([*scored, (fitness, POPULATION + step, child)], key=lambda x: -x[0])[:POPULATION]
        step += 1
    return [box for _, box in scored[0][2]]


def _evolve_rows(seed: int, generations: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made, fits = [], []
            for row in frame.itertuples(index=False):
                sizes = [int(s) for s in row.sizes]
                elites = [[[int(i) for i in box] for box in e] for e in (row.own, row.migrant) if e is not None]
                best = evolve(sizes, int(row.capacity), elites, random.Random(f"{seed}:{row.container_id}:{row.shard}:{row.island}"), generations)
                made.append(best)
                fits.append(_fitness([(sum(sizes[i] for i in box), box) for box in best], int(row.capacity)))
            yield pd.DataFrame({"container_id": frame["container_id"], "capacity": frame["capacity"], "shard": frame["shard"], "island": frame["island"], "items": frame["items"], "sizes": frame["sizes"], "own": made, "fitness": fits})

    return run


ISLAND_SCHEMA = "container_id int, capacity int, shard bigint, island int, items array<struct<id:bigint,piece:int>>, sizes array<int>, own array<array<int>>, fitness double"


def pack_shards(pieces: DataFrame, seed: int, shard_items: int = SHARD_ITEMS, generations: int = GENERATIONS) -> DataFrame:
    """(container_id, capacity, shard, box, id, piece, tokens) for pieces (container_id, capacity, id, piece, tokens)."""
    many = pieces.groupBy("container_id").agg(F.ceil(F.count("*") / shard_items).alias("_shards"))
    dealt = pieces.join(F.broadcast(many), "container_id")  # a row for each capacity
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "id", "piece", "container_id"), F.col("_shards")))
    packed = F.array_sort(F.collect_list(F.struct("id", "piece", "tokens")))
    groups = dealt.groupBy("container_id", "capacity", "shard").agg(packed.alias("_p"))
    islands = groups.select(
        "container_id", "capacity", "shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"),
        F.transform("_p", lambda p: F.struct(p["id"].alias("id"), p["piece"].alias("piece"))).alias("items"), F.transform("_p", lambda p: p["tokens"]).alias("sizes"),
    )
    nothing = F.lit(None).cast("array<array<int>>")
    islands = islands.withColumn("own", nothing).withColumn("migrant", nothing)
    for epoch in range(EPOCHS):
        islands = islands.mapInPandas(_evolve_rows(seed + epoch, generations), ISLAND_SCHEMA)
        ring = Window.partitionBy("container_id", "shard").orderBy("island")
        whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        if epoch < EPOCHS - 1:
            islands = islands.withColumn("migrant", F.coalesce(F.lead("own").over(ring), F.first("own").over(whole)))
    best = islands.groupBy("container_id", "capacity", "shard").agg(F.max_by(F.struct("items", "sizes", "own"), F.struct("fitness", -F.col("island"))).alias("b"))
    boxes = best.select("container_id", "capacity", "shard", "b.items", "b.sizes", F.posexplode("b.own").alias("box", "members"))
    member = boxes.select("*", F.explode("members").alias("m"))
    return member.select("container_id", "capacity", "shard", "box", F.get("items", F.col("m"))["id"].alias("id"), F.get("items", F.col("m"))["piece"].alias("piece"), F.get("sizes", F.col("m")).alias("tokens"))


def fill_containers(items: DataFrame, containers: DataFrame, cut: Callable[[DataFrame], DataFrame] = cut_lineage, shard_items: int = SHARD_ITEMS, generations: int = GENERATIONS) -> DataFrame:
    """(container_id, box, doc_id, piece, first_token, tokens): which documents, or pieces of them, share a box.

    ``items`` has (doc_id, n_tokens), ``containers`` (container_id, capacity_tokens); ``box`` is unique in a
    container kind; ``cut`` stores a stage so that it is not made twice; without ``generations`` it is best fit alone.
    """
    kinds = containers.where("capacity_tokens >= 1 and container_id is not null").select("container_id", F.col("capacity_tokens").cast("int").alias("capacity")).distinct()
    sized = cut(items.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max("n_tokens").cast("int").alias("n")))
    each = sized.crossJoin(F.broadcast(kinds))  # a few capacities
    full = each.where("n >= capacity").select("container_id", "capacity", "id", F.explode(F.expr("sequence(0, n div capacity - 1)")).alias("piece"), F.col("capacity").alias("tokens"))
    rest = each.where("n % capacity > 0 or n = 0").select("container_id", "capacity", "id", F.expr("cast(n div capacity as int)").alias("piece"), F.expr("n % capacity").alias("tokens"))
    done = full.withColumn("box", F.concat_ws("-", F.lit("f"), "id", "piece"))
    todo, parts = rest, [done]
    for turn in range(REPACK_ROUNDS + 1):
        packed = cut(pack_shards(todo, 1000 * turn, shard_items, generations).withColumn("box", F.concat_ws("-", F.lit(f"r{turn}"), "shard", "box")))
        if turn == REPACK_ROUNDS:
            parts.append(packed)
            break
        fill = F.sum("tokens").over(Window.partitionBy("container_id", "box")) / F.col("capacity")
        judged = packed.withColumn("_fill", fill)
        parts.append(judged.where(F.col("_fill") >= REPACK_BELOW))
        todo = judged.where(F.col("_fill") < REPACK_BELOW).select("container_id", "capacity", "id", "piece", "tokens")
    columns = ["container_id", "box", F.col("id").alias("doc_id"), "piece", (F.col("piece") * F.col("capacity")).cast("int").alias("first_token"), F.col("tokens").cast("int").alias("tokens")]
    out = parts[0].select(*columns)
    for part in parts[1:]:
        out = out.unionByName(part.select(*columns))
    return out


def fill_report(filled: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_id, boxes, tokens, least_boxes, fill): how full the boxes of each capacity are."""
    per = filled.groupBy("container_id").agg(F.count_distinct("box").alias("boxes"), F.sum("tokens").alias("tokens"))
    caps = containers.select("container_id", F.col("capacity_tokens").alias("_c")).distinct()
    return per.join(caps, "container_id").select(
        "container_id", "boxes", "tokens", F.ceil(F.col("tokens") / F.col("_c")).alias("least_boxes"), F.round(F.col("tokens") / (F.col("boxes") * F.col("_c")), 6).alias("fill")
    )
