"""Range sharding by sampled splitters, with near-equal bytes in every shard.

Every row gets a 64-bit key: 40 bits of its text's hash, then 24 bits of its row's, so
equal texts stand together yet any number of them can be divided. Keys are drawn with a
chance in proportion to their rows' sizes and their quantiles split all keys into ranges.
The bytes of each range are counted over all rows; a range in which a shard has to end and
which holds too many rows is overfull and is divided by keys drawn from its own rows, until
the few rows around each shard's end can be looked at one by one. What comes to the driver
is a constant number of keys for each shard, whatever the number of rows. Texts are read
once, by built-in functions; only keys and sizes are written, and they are shuffled once.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import prepare, stage

#: Bytes a row costs besides its text.
ROW_BYTES = 16
LAW = "bytes"
#: First ranges for each shard, and keys drawn for each.
RANGES_PER_SHARD = 12
KEYS_PER_RANGE = 24
#: Keys drawn from an overfull range in a round.
KEYS_PER_DIVISION = 64
#: A range with a shard's end and more rows than this is overfull.
LEAF_ROWS = 2_000
#: Rounds of dividing; each leaves about one row in KEYS_PER_DIVISION.
ROUNDS = 12
#: A group of equal texts at a shard's end stays whole up to this share of a shard, or the largest row.
GROUP_SHARE = 0.01
#: Rows in one written file.
ROWS_PER_FILE = 500_000

_GROUP = 1 << 24
_LOW, _HIGH = -(1 << 63), 1 << 63
_PREFIX_BITS = 8


def _digests(docs: DataFrame, id_col: str, text_col: str, row: Column) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), row.alias("row"))
    low = F.xxhash64("row", "doc_id").bitwiseAND(_GROUP - 1)
    return rows.select(
        "doc_id", "row", (F.octet_length("text") + ROW_BYTES).cast("long").alias("size"), F.crc32("text").alias("text_crc32"),
        F.xxhash64("text").bitwiseAND(-_GROUP).bitwiseOR(low).alias("key"),
    )


def _ranged(rows: DataFrame, cuts: list[int], name: str = "range", chances: dict[int, float] | None = None) -> DataFrame:
    """``rows`` with the number of the range between ``cuts`` that holds their key; with
    ``chances``, of these ranges alone, and with a column ``chance``.

    The ranges, a constant number for each shard, are broadcast under the keys' leading
    bits, so a row meets the few ranges that begin like it.
    """
    ends = [_LOW, *cuts, _HIGH]
    wanted = range(len(ends) - 1) if chances is None else sorted(chances)
    table = [
        (prefix, ends[i], ends[i + 1] - 1, i, 0.0 if chances is None else chances[i])
        for i in wanted if ends[i] < ends[i + 1]
        for prefix in range(ends[i] >> 64 - _PREFIX_BITS, (ends[i + 1] - 1 >> 64 - _PREFIX_BITS) + 1)
    ]
    ranges = rows.sparkSession.createDataFrame(table, f"_prefix int, _from long, _to long, {name} int, chance double")
    held = F.shiftright("key", 64 - _PREFIX_BITS).cast("int") == F.col("_prefix")
    both = rows.join(F.broadcast(ranges), held & F.col("key").between(F.col("_from"), F.col("_to")))
    return both.drop("_prefix", "_from", "_to", *([] if chances else ["chance"]))


def _drawn(rows: DataFrame, chance: Column, seed: int) -> DataFrame:
    """Rows drawn with a chance of ``size * chance``, the same at every run."""
    return rows.where(F.xxhash64(F.lit(seed), "row").bitwiseAND((1 << 53) - 1) / F.lit(float(1 << 53)) < F.col("size") * chance)


def _one_group(low: int, high: int) -> bool:
    """Whether all keys of a range belong to one text (its hash, that is)."""
    return low != _LOW and high != _HIGH and low // _GROUP == (high - 1) // _GROUP


def end_near(target: float, keys: list[tuple[int, int]], before: int, slack: float) -> int | None:
    """First key behind a shard's end: the rows' edge nearest to ``target``, or the nearer edge
    of the group that it would divide if the group has at most ``slack`` bytes.

    ``keys``: sorted ``(key, bytes)`` of a range behind ``before`` bytes. None: the range's end.
    """
    upto = [before, *accumulate((size for _, size in keys), initial=before)][1:]
    at = min(range(len(upto)), key=lambda i: (abs(upto[i] - target), i))
    names = [key // _GROUP for key, _ in keys]
    if 0 < at < len(keys) and names[at - 1] == names[at]:
        first = names.index(names[at])
        behind = len(names) - names[::-1].index(names[at])
        if upto[behind] - upto[first] <= slack:
            at = min((first, behind), key=lambda i: (abs(upto[i] - target), i))
    return keys[at][0] if at < len(keys) else None


def shard_ends(rows: DataFrame, shards: int) -> list[int]:
    """The first key of every shard but the first, from rows ``(key, row, size)``."""
    n, total, largest = rows.agg(F.count(F.lit(1)), F.sum("size"), F.max("size")).first()
    if not n:
        return []
    targets = [total * i / shards for i in range(1, shards)]
    slack = max(GROUP_SHARE * total / shards, largest)
    ranges = shards * RANGES_PER_SHARD
    keys = sorted(r[0] for r in _drawn(rows, F.lit(ranges * KEYS_PER_RANGE / total), 0).select("key").collect())
    # Ranges end between texts, so that only a large text's own keys are ever divided.
    cuts = sorted({keys[len(keys) * i // ranges] & -_GROUP for i in range(1, ranges)}) if keys else []
    for seed in range(1, ROUNDS + 1):
        sums = {r["range"]: (r["bytes"], r["n"]) for r in _ranged(rows, cuts).groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()}
        held = [sums.get(i, (0, 0)) for i in range(len(cuts) + 1)]
        upto = list(accumulate(b for b, _ in held))
        ends = [_LOW, *cuts, _HIGH]
        holders = [min(bisect_right(upto, t), len(cuts)) for t in targets]

        def whole(i: int) -> bool:
            return _one_group(ends[i], ends[i + 1]) and ends[i + 1] - ends[i] == _GROUP and held[i][0] <= slack

        over = {i: KEYS_PER_DIVISION / held[i][0] for i in holders if held[i][1] > LEAF_ROWS and ends[i + 1] - ends[i] > 1 and not whole(i)}
        if not over or seed == ROUNDS:
            break
        new = set()
        for i, key in _drawn(_ranged(rows, cuts, chances=over), F.col("chance"), seed).select("range", "key").collect():
            group = key & -_GROUP
            new |= {key} if _one_group(ends[i], ends[i + 1]) else {k for k in (group, group + _GROUP) if ends[i] < k < ends[i + 1]}
        cuts = sorted({*cuts, *new})
    leaves: dict[int, list] = {i: [] for i in holders}
    for i, key, size in _ranged(rows, cuts, chances=dict.fromkeys(leaves, 1.0)).groupBy("range", "key").agg(F.sum("size")).collect():
        leaves[i].append((key, size))
    found = []
    for target, i in zip(targets, holders):
        first = end_near(target, sorted(leaves[i]), upto[i] - held[i][0], slack)
        found.append(min(ends[i + 1], _HIGH - 1) if first is None else first)
    return sorted(found)


def _assign(rows: DataFrame, shards: int) -> DataFrame:
    """Rows ``(doc_id, row, size, text_crc32, key)`` with shard and slot."""
    placed = _ranged(rows, shard_ends(rows, shards), "shard").withColumn("lot", F.shiftright("row", 33))
    # A slot is a row's place in its lot (the partition it was read in) behind the shard's lots before.
    lots = placed.groupBy("shard", "lot").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    lots = lots.select("shard", "lot", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "lot").orderBy("row"))
    return placed.withColumn("at", inside).join(lots, ["shard", "lot"]).withColumn("slot", F.col("before") + F.col("at") - 1)


def assign_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` of every row.

    Shards have equal bytes but for what whole rows ask for: each ends at the row's edge nearest
    to its even share. Equal texts stand in one shard; where a shard would end among them they
    move to one side if they have at most ``GROUP_SHARE`` of a shard's bytes or those of the
    largest row, and are divided only beyond. A null text has no bytes; a null id stays null;
    repeated rows get a slot each; an empty table gives no rows; other columns are not looked
    at. ``grown_shard`` is null: under this law one more shard moves rows between all.
    """
    prepare(docs.sparkSession)
    rows = stage(_digests(docs, id_col, text_col, F.monotonically_increasing_id()), "shard-keys")
    return _assign(rows, shards).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the rows as Parquet, a folder ``shard=N`` for each shard, rows in slot order in files
    that each hold one run of slots; returns the assignment as ``assign_shards`` does.

    Rows are numbered in a stage table and joined by number, so null and repeated ids are
    written like any others. Columns of ``docs`` named ``shard`` or ``slot`` are replaced.
    """
    prepare(docs.sparkSession)
    numbered = stage(docs.withColumn("_quern_row", F.monotonically_increasing_id()), "shard-rows")
    rows = stage(_digests(numbered, id_col, text_col, F.col("_quern_row")), "shard-keys")
    placed = stage(_assign(rows, shards), "shard-plan")
    plan = placed.select(F.col("row").alias("_quern_row"), "shard", "slot")
    full = numbered.drop("shard", "slot").join(plan, "_quern_row").drop("_quern_row")
    run = F.floor(F.col("slot") / ROWS_PER_FILE)
    full.repartition("shard", run).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
