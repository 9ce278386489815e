"""Filling containers of fixed capacity: a grouping genetic algorithm on islands, level by level.

Every row is an item of its own under a row number, whatever its key. Items are spread over shards by a hash of that number, so
a shard is an even sample of sizes; a shard holds many containers' worth, so its last, half-empty container weighs little. Each
shard is evolved on several islands. A chromosome is a list of containers. Crossover injects whole well-filled containers of
one parent into the other, drops the containers that now hold an item twice, trades displaced items for smaller ones in what is
left where that fills a container better, and puts the rest back by best fit; mutation empties the worst containers. After an
epoch each island's elite moves to the next island (an exchange between tasks), evolution goes on, and the best island of a
shard wins. A shard at its lower bound (large items counted, not only volume) stops at once: no packing is smaller.

Then the emptiest eighth of the containers of every eight shards is pooled into one shard of the next level and evolved
again, with the containers as they are as one of the first chromosomes, so that pooling never costs a container; this goes on
until one shard is left.

Defined results: a null text is no item; an item of size 0 sits in some container; an item beyond the capacity is split into
full containers and a rest, which is packed like any item; no other item is split; rows that repeat a key, or have none, are
items of their own, each packed once; an empty table gives no containers. Containers depend on the rows, their order and the seed.
"""

from __future__ import annotations

import bisect
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import bpe, pieces
from caseloom.session import materialize, ship_package, spread

ITEMS_PER_SHARD, ITEMS_MOST, CONTAINERS_LEAST = 3000, 50_000, 16  # a shard's usual items, its most, and containers' worth it should hold
POOLED = 8  # shards pooled into one of the next level, each giving that part of its containers
ISLANDS, EPOCHS, POPULATION, GENERATIONS, ELITE = 2, 2, 6, 60, 2

Chromosome = tuple[list[list[int]], list[int]]  # containers of item numbers, and their loads


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Containers that any packing needs: by volume, and by items too large to share a container (Martello and Toth's L2)."""
    s = np.sort(np.asarray(sizes, dtype=np.int64))[::-1]
    s = s[s > 0]
    if not len(s):
        return 1 if len(sizes) else 0
    best = -(-int(s.sum()) // capacity)
    total = np.concatenate(([0], np.cumsum(s)))
    small_from = int(np.searchsorted(-s, -(capacity // 2), side="left"))  # items of at most half the capacity start here
    for k in np.unique(np.concatenate(([0], s[small_from:]))):
        large = int(np.searchsorted(-s, -(capacity - k), side="left"))  # more than capacity - k: alone
        end = int(np.searchsorted(-s, -k, side="right"))  # at least k
        middle = small_from - large
        rest = int(total[end] - total[small_from]) - (middle * capacity - int(total[small_from] - total[large]))
        best = max(best, small_from + max(0, -(-rest // capacity)))
    return best


def best_fit(bins: list[list[int]], loads: list[int], items: list[int], sizes: list[int], capacity: int) -> None:
    """Puts items, largest first, where the least space is left; opens containers as needed. In place."""
    free = sorted((capacity - load, i) for i, load in enumerate(loads) if load < capacity)
    for item in sorted(items, key=sizes.__getitem__, reverse=True):
        size = sizes[item]
        at = bisect.bisect_left(free, (size, -1))
        if at < len(free):
            left, i = free.pop(at)
            bins[i].append(item)
            loads[i] += size
        else:
            left, i = capacity, len(bins)
            bins.append([item])
            loads.append(size)
        if left > size or not size:
            bisect.insort(free, (left - size, i))


def trade(bins: list[list[int]], loads: list[int], displaced: list[int], sizes: list[int], capacity: int) -> list[int]:
    """Trades one or two items of a container for a displaced one where that fills the container better; what is displaced then."""
    loose = sorted((sizes[i], i) for i in displaced)
    for b, load in enumerate(loads):
        room = capacity - load
        if not room or not loose:
            continue
        found = None
        inside = bins[b]
        pairs = [(i,) for i in inside] + ([(i, j) for x, i in enumerate(inside) for j in inside[x + 1 :]] if len(inside) <= 8 else [])
        for out in pairs:
            size = sum(sizes[i] for i in out)
            at = bisect.bisect_right(loose, (size + room, 1 << 60)) - 1
            if at >= 0 and loose[at][0] > size and (found is None or loose[at][0] - size > found[0]):
                found = (loose[at][0] - size, at, out)
        if found:
            gain, at, out = found
            _, item = loose.pop(at)
            bins[b] = [i for i in inside if i not in out] + [item]
            loads[b] = load + gain
            for i in out:
                bisect.insort(loose, (sizes[i], i))
    return [i for _, i in loose]


def fitness(chromosome: Chromosome, capacity: int) -> tuple[int, float]:
    """Fewer containers first, then fuller ones (squares reward a few nearly empty containers over many half full)."""
    return -len(chromosome[0]), sum(load * load for load in chromosome[1]) / (capacity * capacity)


def crossover(a: Chromosome, b: Chromosome, sizes: list[int], capacity: int, rng: random.Random) -> Chromosome:
    """Injects well-filled containers of ``b`` into ``a``."""
    filled = sorted(range(len(b[0])), key=b[1].__getitem__, reverse=True)
    pool = filled[: max(1, len(filled) // 2)]
    injected = rng.sample(pool, max(1, len(pool) // 3))
    taken = {i for k in injected for i in b[0][k]}
    bins, loads, displaced = [list(b[0][k]) for k in injected], [b[1][k] for k in injected], []
    for x, load in zip(*a):
        if taken.isdisjoint(x):
            bins.append(list(x))
            loads.append(load)
        else:
            displaced += [i for i in x if i not in taken]
    best_fit(bins, loads, trade(bins, loads, displaced, sizes, capacity), sizes, capacity)
    return bins, loads


def mutate(chromosome: Chromosome, sizes: list[int], capacity: int, rng: random.Random) -> Chromosome:
    """Empties the worst containers and a few others, and puts their items back."""
    old, weights = chromosome
    n = 1 + len(old) // 50
    gone = set(sorted(range(len(old)), key=weights.__getitem__)[:n]) | set(rng.sample(range(len(old)), min(len(old), n)))
    displaced = [i for k in gone for i in old[k]]
    bins, loads = [list(x) for k, x in enumerate(old) if k not in gone], [w for k, w in enumerate(weights) if k not in gone]
    best_fit(bins, loads, trade(bins, loads, displaced, sizes, capacity), sizes, capacity)
    return bins, loads


def best_fit_decreasing(sizes: list[int], capacity: int) -> Chromosome:
    bins: list[list[int]] = []
    loads: list[int] = []
    best_fit(bins, loads, list(range(len(sizes))), sizes, capacity)
    return bins, loads


def first_population(sizes: list[int], capacity: int, rng: random.Random, n: int = POPULATION) -> list[Chromosome]:
    """Best fit over items in random order, block by block, each chromosome with smaller blocks."""
    population = []
    for k in range(n):
        bins: list[list[int]] = []
        loads: list[int] = []
        items = list(range(len(sizes)))
        rng.shuffle(items)
        step = max(1, -(-len(items) // (k + 2)))
        for at in range(0, len(items), step):
            best_fit(bins, loads, items[at : at + step], sizes, capacity)
        population.append((bins, loads))
    return population


def evolve(population: list[Chromosome], sizes: list[int], capacity: int, rng: random.Random, generations: int = GENERATIONS, least: int | None = None) -> list[Chromosome]:
    """The population after some generations, fittest first. Ends at the lower bound, which no packing can beat."""
    least = lower_bound(sizes, capacity) if least is None else least
    scored = sorted(((fitness(c, capacity), c) for c in population), key=lambda x: x[0], reverse=True)
    for _ in range(generations):
        if len(scored[0][1][0]) <= least:
            break
        a, b = (max(rng.sample(range(len(scored)), min(2, len(scored))), key=lambda k: scored[k][0]) for _ in range(2))
        child = crossover(scored[a][1], scored[b][1], sizes, capacity, rng)
        if rng.random() < 0.5:
            child = mutate(child, sizes, capacity, rng)
        scored[-1] = (fitness(child, capacity), child)
        scored.sort(key=lambda x: x[0], reverse=True)
    return [c for _, c in scored]


def solve(seed: str, sizes: list[int], capacity: int, known: list[Chromosome]) -> list[Chromosome]:
    """An epoch of one island from the solutions known, fittest first; other chromosomes are made only if these can be beaten."""
    rng = random.Random(seed)
    least = lower_bound(sizes, capacity)
    start = [*known, best_fit_decreasing(sizes, capacity)]
    start.sort(key=lambda c: fitness(c, capacity), reverse=True)
    if len(start[0][0]) > least:
        start += first_population(sizes, capacity, rng, max(2, POPULATION - len(start)))
    return evolve(start, sizes, capacity, rng, least=least)


# --- distributed levels: one row per shard and island, items as arrays ---


def _to_chromosome(of_item: np.ndarray, sizes: list[int]) -> Chromosome:
    bins: dict[int, list[int]] = {}
    for item, b in enumerate(of_item):
        bins.setdefault(int(b), []).append(item)
    return list(bins.values()), [sum(sizes[i] for i in x) for x in bins.values()]


def _to_array(chromosome: Chromosome, n: int) -> np.ndarray:
    of_item = np.empty(n, dtype=np.int32)
    for k, items in enumerate(chromosome[0]):
        of_item[items] = k
    return of_item


SHARD_SCHEMA = "spec_id int, shard long, capacity long, ids array<long>, sizes array<int>, known array<array<int>>"
ISLAND_SCHEMA = SHARD_SCHEMA + ", island int, n_bins int, squares double"
PART_SCHEMA = "spec_id int, shard long, capacity long, kept_ids array<long>, kept_bins array<int>, pool_ids array<long>, pool_sizes array<int>, pool_bins array<int>"


def _run_islands(epoch: int, keep: int):
    """mapInPandas over rows of ISLAND_SCHEMA: evolves each row's shard from the solutions it knows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                sizes = [int(x) for x in r.sizes]
                known = [_to_chromosome(k, sizes) for k in (r.known if r.known is not None else [])]
                best = solve(f"{r.spec_id}/{r.shard}/{r.island}/{epoch}", sizes, int(r.capacity), known)[:keep]
                count, squares = fitness(best[0], int(r.capacity))
                rows.append((r.spec_id, r.shard, r.capacity, r.ids, r.sizes, [_to_array(c, len(sizes)) for c in best], r.island, -count, squares))
            yield pd.DataFrame(rows, columns=["spec_id", "shard", "capacity", "ids", "sizes", "known", "island", "n_bins", "squares"])

    return run


def _part(final: dict[int, bool]):
    """mapInPandas: the best island's containers, those that stay and the emptiest ones that go to the next level."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                of_item, sizes = np.asarray(r.known[0]), np.asarray(r.sizes, dtype=np.int64)
                loads = np.bincount(of_item, sizes)
                order = np.argsort(loads, kind="stable")
                gone = np.zeros(len(loads), dtype=bool)
                if not final[r.spec_id]:
                    gone[order[: max(1, len(loads) // POOLED)]] = True
                gone &= loads < r.capacity
                pooled = gone[of_item]
                ids = np.asarray(r.ids)
                rows.append((r.spec_id, r.shard, r.capacity, ids[~pooled], of_item[~pooled], ids[pooled], np.asarray(r.sizes)[pooled], of_item[pooled]))
            yield pd.DataFrame(rows, columns=["spec_id", "shard", "capacity", "kept_ids", "kept_bins", "pool_ids", "pool_sizes", "pool_bins"])

    return run


def _join_pools(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """mapInPandas: pools of several shards as one shard that knows the containers as they are."""
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            pools = sorted(r.pools, key=lambda p: p["shard"])
            at, known = 0, []
            for p in pools:
                b = np.asarray(p["pool_bins"], dtype=np.int32)
                known.append(b + at)
                at += int(b.max()) + 1 if len(b) else 0
            ids, sizes = (np.concatenate([np.asarray(p[c]) for p in pools]) for c in ("pool_ids", "pool_sizes"))
            rows.append((r.spec_id, r.shard, r.capacity, ids, sizes, [np.concatenate(known)]))
        yield pd.DataFrame(rows, columns=["spec_id", "shard", "capacity", "ids", "sizes", "known"])


def pack_shards(shards: DataFrame, counts: dict[int, int]) -> DataFrame:
    """(spec_id, id, container) of items in shards (SHARD_SCHEMA); ``counts`` holds the number of shards per spec."""
    placed = None
    for level in range(64):
        state = shards.withColumns({"island": F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])), "n_bins": F.lit(0), "squares": F.lit(0.0)})
        for epoch in range(EPOCHS):
            if epoch:  # elites stay, and those of the island before arrive
                away = state.select("spec_id", "shard", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("known").alias("_away"))
                state = state.join(away, ["spec_id", "shard", "island"]).withColumn("known", F.concat("known", "_away")).drop("_away")
            else:
                state = state.repartition("spec_id", "shard", "island")
            run = _run_islands(level * EPOCHS + epoch, 1 if epoch == EPOCHS - 1 else ELITE)
            state = materialize(state.select(*[c.split()[0] for c in ISLAND_SCHEMA.split(", ")]).mapInPandas(run, ISLAND_SCHEMA), f"pack-{level}-{epoch}")
        best = state.groupBy("spec_id", "shard").agg(F.max_by(F.struct("capacity", "ids", "sizes", "known"), F.struct(-F.col("n_bins"), "squares", -F.col("island"))).alias("b"))
        parts = materialize(best.select("spec_id", "shard", "b.*").mapInPandas(_part({k: n == 1 for k, n in counts.items()}), PART_SCHEMA), f"pack-{level}-parts")
        kept = parts.select("spec_id", "shard", F.explode(F.arrays_zip("kept_ids", "kept_bins")).alias("e"))
        kept = kept.select("spec_id", F.col("e.kept_ids").alias("id"), F.concat_ws("-", F.lit(level), "shard", "e.kept_bins").alias("container_id"))
        placed = kept if placed is None else placed.unionByName(kept)
        if all(n == 1 for n in counts.values()):
            return placed
        counts = {k: -(-n // POOLED) for k, n in counts.items() if n > 1}
        pools = parts.filter(F.size("pool_ids") > 0).groupBy("spec_id", F.floor(F.col("shard") / POOLED).alias("shard")).agg(F.max("capacity").alias("capacity"), F.collect_list(F.struct(F.col("shard").alias("shard"), "pool_ids", "pool_sizes", "pool_bins")).alias("pools"))
        shards = pools.mapInPandas(_join_pools, SHARD_SCHEMA)
    raise RuntimeError("levels do not end")


def text_sizes(df: DataFrame, key: str, text: str, tokenizers: list[str], folder: str = bpe.TOKENIZER_FOLDER) -> DataFrame:
    """(tokenizer_name, key, n_tokens) of every text that is not null; each text is read once for all vocabularies."""
    spark = df.sparkSession

    def size(name: str) -> Column:
        if name.startswith("piece"):
            return pieces.count_column(F.col(text), bpe.ship_file(spark, f"{folder}/{name}.model"))
        return bpe.count_column(F.col(text), bpe.ship_file(spark, bpe.vocabulary_path(name, folder)))

    texts = spread(df.filter(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("item_key"), text))
    wide = texts.select("item_key", *[size(name).alias(f"_n{k}") for k, name in enumerate(tokenizers)])
    return wide.select("item_key", F.explode(F.array(*[F.struct(F.lit(name).alias("tokenizer_name"), F.col(f"_n{k}").alias("n_tokens")) for k, name in enumerate(tokenizers)])).alias("s")).select("s.tokenizer_name", "item_key", "s.n_tokens")


def shard_count(items: int, volume: int, capacity: int) -> int:
    """Shards of a spec: enough containers' worth in each, but never more than ITEMS_MOST items (however small) in one task."""
    by_volume = min(-(-items // ITEMS_PER_SHARD), volume // (capacity * CONTAINERS_LEAST))
    return max(1, by_volume, -(-items // ITEMS_MOST))


def pack(sizes: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, item_key, part_no, first_token, n_tokens, container_id) for every spec; ``specs`` is a small fixed table."""
    joined = sizes.join(specs, "tokenizer_name").withColumn("capacity", F.col("capacity").cast("long"))
    capacity = F.col("capacity")
    full = F.floor(F.col("n_tokens") / capacity)
    rest = F.col("n_tokens") % capacity
    parts = F.when(F.col("n_tokens") <= capacity, F.array(F.struct(F.lit(1).alias("part_no"), F.lit(0).cast("long").alias("first_token"), F.col("n_tokens").alias("size")))).otherwise(
        F.transform(
            F.sequence(F.lit(1), (full + F.when(rest > 0, 1).otherwise(0)).cast("int")),
            lambda p: F.struct(p.alias("part_no"), ((p - 1).cast("long") * capacity).alias("first_token"), F.when(p.cast("long") <= full, capacity).otherwise(rest).alias("size")),
        )
    )
    items = joined.select("spec_id", "item_key", "capacity", F.explode(parts).alias("p")).select("spec_id", "item_key", "capacity", "p.*")
    items = materialize(items.withColumn("id", F.monotonically_increasing_id()), "pack-items")
    names = ["spec_id", "item_key", "part_no", "first_token", F.col("size").alias("n_tokens")]
    whole = items.filter("size = capacity").select(*names, F.concat_ws("-", F.lit("full"), "id").alias("container_id"))  # nothing fits beside these
    loose = items.filter("size < capacity")
    totals = loose.groupBy("spec_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("volume"), F.max("capacity").alias("capacity")).collect()  # a row per spec
    if not totals:
        return whole
    counts = {r["spec_id"]: shard_count(r["n"], r["volume"], r["capacity"]) for r in totals}
    shards_of = F.create_map(*[F.lit(x) for kv in counts.items() for x in kv])
    placed = loose.withColumn("shard", F.pmod(F.xxhash64("id", "item_key"), F.element_at(shards_of, F.col("spec_id")).cast("long")))
    gathered = placed.groupBy("spec_id", "shard").agg(F.max("capacity").alias("capacity"), F.sort_array(F.collect_list(F.struct("id", F.col("size").cast("int").alias("size")))).alias("i"))
    shards = gathered.select("spec_id", "shard", "capacity", F.col("i.id").alias("ids"), F.col("i.size").alias("sizes"), F.array().cast("array<array<int>>").alias("known"))
    where = pack_shards(shards, counts)
    return whole.unionByName(loose.join(where, ["spec_id", "id"]).select(*names, "container_id"))


def packing_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Per spec: containers used, the least number possible by volume, and the share of space used."""
    loads = packed.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("load"))
    total = loads.groupBy("spec_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("load").alias("tokens"), F.max("load").alias("fullest"))
    return total.join(specs, "spec_id").select(
        "spec_id", "tokenizer_name", "capacity", "containers", "tokens", "fullest", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"), F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("fill")
    )


def pack_texts(spark: SparkSession, df: DataFrame, key: str, text: str, specs: DataFrame, folder: str = bpe.TOKENIZER_FOLDER) -> DataFrame:
    """Packs the texts of a table for every container specification."""
    ship_package(spark)
    names = sorted(r["tokenizer_name"] for r in specs.select("tokenizer_name").distinct().collect())
    return pack(text_sizes(df, key, text, names, folder), specs)
