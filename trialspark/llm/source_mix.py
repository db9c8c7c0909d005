"""Mixing sources to target weights, in DataFrame functions only.

The words of a source, document after document in a fixed pseudorandom order, are packed into blocks of BLOCK words.
Weights and the cap of REPEATS give every source a target; the target in blocks is its quota. An output shard has SLOTS
slots. Each slot draws its source with the quotas as weights, so a shard's source counts are a multinomial draw. Over
all shards such draws would leave small sources percents off their targets; so a source drawn more often than its quota
frees the surplus slots, spread over its draws, and these go to the sources drawn too seldom. The n-th draw of a source
takes the block at place n of a pseudorandom permutation of its blocks, a new permutation after each full round; so no
block is taken more than REPEATS times. Slots are joined with blocks by source and index. The draws decide where in the
mix a document's words lie: in which shards, and at which slots.

Everything is numbered by sums over small tables: documents are dealt to groups of about GROUP rows by a hash, a window
numbers the words within a group, and groups are summed up to their source. No source, however large, meets in a task,
and sources may be many: their running sums go over ranges, and a slot finds its source by a join on cells of the line
of all quotas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.llm.common import WORD, columns_but, fresh, let, scratch, stored, words
from trialspark.operators.ranges import numbered, running_sums, with_ranges

BLOCK, SLOTS, REPEATS, GROUP = 64, 1024, 3, 4_000
DRAWS_A_TASK = 100_000
#: Weights of the sources in the order of their names, repeated.
WEIGHTS = (1, 2, 3)
SEED = 20240611
#: Multipliers that spread surplus draws and a shard's slots: a prime or another one, and an odd number.
_SPREAD, _OTHER_SPREAD, _ODD = 1299709, 1299721, 421
#: Shards whose counts are summed up together before sums run over the groups, and cells of the line of all quotas at least.
SHARDS_A_GROUP, CELLS = 4096, 1024
#: A prime near 2**31 and multipliers whose products stay in 64 bits.
_P, _M1, _M2, _M3 = 2147483647, 48271, 69621, 16807
#: Rounds of the permutation, and steps after which a walk has surely left the few surplus places.
_ROUNDS, _WALK = 4, 16


def _scramble(x: Column, key: Column) -> Column:
    """A pseudorandom number below _P of x and key."""
    y = ((x % _P + key) % _P * _M1 + F.lit(11)) % _P
    y = (y * _M2 + F.shiftright(y, 15)) % _P
    return (y * _M3 + F.shiftright(y, 13)) % _P


def permuted(x: Column, n: Column, key: Column) -> Column:
    """The place of x in a pseudorandom permutation of 0 .. n - 1 that key names; x, n and key are bigint columns.

    x stands in a grid of a columns and b rows, a * b just above n; each round shifts columns by a function of the row
    and rows by a function of the column. A place of n or more is permuted again; there are fewer than a of them.
    """
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))), F.lit(1)).cast("long")
    b = F.floor((n + a - 1) / a).cast("long")

    def once(at: Column, a: Column, b: Column) -> Column:
        grid = F.struct((at % a).alias("l"), F.floor(at / a).cast("long").alias("r"))

        def half(g: Column, i: Column) -> Column:
            k, even = key + F.floor(i / 2) * 7919, i % 2 == 0
            l_moved, r_moved = (g["l"] + _scramble(g["r"], k)) % a, (g["r"] + _scramble(g["l"], k + 104729)) % b
            return F.struct(F.when(even, l_moved).otherwise(g["l"]).alias("l"), F.when(even, g["r"]).otherwise(r_moved).alias("r"))

        return F.aggregate(F.sequence(F.lit(2), F.lit(2 * _ROUNDS + 1)), grid, half, lambda g: g["r"] * a + g["l"])

    sides = F.struct(a.alias("a"), b.alias("b"))
    walk = lambda s: F.aggregate(F.sequence(F.lit(1), F.lit(_WALK)), F.lit(-1).cast("long"), lambda at, i: F.when((i > 1) & (at < n), at).otherwise(once(F.when(i == 1, x).otherwise(at), s["a"], s["b"])))
    return let(sides, walk)


def document_sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, source, size, tie): the words of each row, written out as they are read several times; tie orders rows of one id."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.size(words(F.col(text))).cast("long").alias("size"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("tie"))
    return stored(sized, "mix-sizes")


def _all(df: DataFrame) -> DataFrame:
    return df.withColumn("all", F.lit(0))


def _sums_before(df: DataFrame, order: str, values: dict[str, str]) -> DataFrame:
    """df with a column for each of values (new name -> column): its sum over the rows before in order, over ranges."""
    run = running_sums(with_ranges(_all(df), ["all"], order), ["all"], order, {n: v for n, v in values.items()})
    return run.select(*df.columns, *[(F.col(n) - F.col(v)).alias(n) for n, v in values.items()])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, rank, source_size, weight, target, n_blocks, quota, key): one row a source; sources may be many.

    A source is capped where repeats * size / weight is below what the weights would give; sorted by that ratio, the
    capped ones come first, so running sums find the one share per weight under which nothing is above its cap.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = _all(by.withColumn("name", F.struct(F.col("source").isNull().alias("last"), "source")))
    ranked = stored(numbered(named, ["all"], "name", "rank").drop("name", "all"), "mix-ranked")
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("ratio", F.struct((F.col("source_size") / F.col("weight")).alias("r"), "rank"))
    total, all_weights = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    cap = F.col("source_size") * repeats
    run = _sums_before(ranked, "ratio", {"before": "source_size", "used": "weight"})
    share = (total - F.col("before") * repeats).cast("double") / (all_weights - F.col("used"))
    # the share under which this source and all later ones are uncapped; the first that holds is the answer
    tried = stored(run.withColumn("share", share).withColumn("fits", F.col("share") * F.col("weight") <= cap), "mix-shares")
    first = tried.where("fits").agg(F.min_by("share", "ratio")).first()[0]
    aimed = tried.withColumn("target", F.least(F.lit(first).cast("double") * F.col("weight"), cap.cast("double")))  # least() passes nulls over
    blocks = aimed.withColumn("n_blocks", F.floor((F.col("source_size") + BLOCK - 1) / BLOCK).cast("long"))
    quota = F.when(F.col("source_size") > 0, F.floor(F.col("target") * F.col("n_blocks") / F.col("source_size") + 0.5)).otherwise(0).cast("long")
    drawn = blocks.withColumn("quota", F.least(quota, F.col("n_blocks") * repeats))
    out = drawn.withColumn("key", (F.col("rank") * 1299709 + SEED) % _P)
    return stored(out.select("source", "rank", "source_size", "weight", "target", "n_blocks", "quota", "key"), "mix-targets")


def _before(df: DataFrame, value: str, by: str, *within: str) -> Column:
    """The sum of value over the rows before, in the order of by."""
    window = Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(window), F.lit(0))


def shard_counts(targets: DataFrame, seed: int = SEED) -> DataFrame:
    """(shard, rank, n, slot): the multinomial source counts of each shard, and the first slot of each source in it.

    A slot takes the source in whose part of the line of all quotas a pseudorandom number falls. The line is cut into
    cells, about as many as there are sources; slots meet the parts in their cell.
    """
    spark = targets.sparkSession
    total, n = targets.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count("*")).first()
    width = -(-_P // max(CELLS, n))
    at = lambda x: F.floor(x / max(total, 1) * _P).cast("long")
    ends = _sums_before(targets.select("rank", "quota"), "rank", {"lo": "quota"})
    line = ends.select("rank", at(F.col("lo")).alias("lo"), at(F.col("lo") + F.col("quota")).alias("hi")).where("lo < hi")
    cells = line.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    parts = max(2 * spark.sparkContext.defaultParallelism, total // DRAWS_A_TASK + 1)
    head = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")).cast("binary")), 1, 8)
    number = F.conv(head, 16, 10).cast("long") % _P
    slots = spark.range(0, total, 1, parts).withColumn("r", number).withColumn("at", F.floor(F.col("r") / width))
    found = slots.join(cells, (F.col("at") == F.col("cell")) & (F.col("r") >= F.col("lo")) & (F.col("r") < F.col("hi")))
    counts = found.select(F.floor(F.col("id") / SLOTS).cast("long").alias("shard"), "rank").groupBy("shard", "rank").agg(F.count("*").alias("n"))
    return stored(counts.withColumn("slot", _before(counts, "n", "rank", "shard")), "mix-counts")


def draws(targets: DataFrame, seed: int = SEED) -> DataFrame:
    """(source, block, place): one row for each slot of the mix, each source as often as its quota says.

    place is shard * SLOTS + slot. A source's draws are numbered by sums over groups of shards, and what is known of a
    source comes with its groups, so that no task holds all shards of a source.
    """
    counts = shard_counts(targets, seed).withColumn("grp", F.floor(F.col("shard") / SHARDS_A_GROUP).cast("long"))
    sums = counts.groupBy("rank", "grp").agg(F.sum("n").alias("of_group"))
    sums = sums.withColumn("before", _before(sums, "of_group", "grp", "rank")).drop("of_group")
    drawn = counts.groupBy("rank").agg(F.sum("n").alias("drawn"))
    named = targets.join(drawn, "rank", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    more, less = F.greatest(F.col("drawn") - F.col("quota"), F.lit(0)), F.greatest(F.col("quota") - F.col("drawn"), F.lit(0))
    named = stored(_sums_before(named.withColumn("more", more).withColumn("less", less), "rank", {"free": "more", "wants": "less"}), "mix-named")
    known = ["source", "n_blocks", "key"]
    groups = sums.join(named.select("rank", "quota", "drawn", "free", *known), "rank")
    one = counts.withColumn("start", _before(counts, "n", "shard", "rank", "grp")).join(groups, ["rank", "grp"]).withColumn("start", F.col("start") + F.col("before"))
    # a stated number of tasks: by their bytes the few rows of counts would be one task, though they become all draws
    total = targets.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    tasks = max(2 * targets.sparkSession.sparkContext.defaultParallelism, total // DRAWS_A_TASK + 1)
    each = one.repartition(tasks, "shard", "rank").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    # a bijection that spreads the surplus over all draws: the multiplier has no factor of the number of draws
    by = F.when(F.col("drawn") % _SPREAD == 0, _OTHER_SPREAD).otherwise(_SPREAD)
    at = F.col("start") + F.col("k")
    nth = F.when(F.col("drawn") > F.col("quota"), at * by % F.col("drawn")).otherwise(at)
    slot = F.col("slot") + F.col("k")
    last = F.floor(F.lit(total) / SLOTS).cast("long")
    mixed = F.when(F.col("shard") < last, slot * _ODD % SLOTS).otherwise(slot)
    numbered_ = each.select(*known, "quota", "free", nth.alias("nth"), (F.col("shard") * SLOTS + mixed).alias("place"))
    kept = numbered_.where("nth < quota").select(*known, "nth", "place")
    freed = numbered_.where("nth >= quota").select((F.col("free") + F.col("nth") - F.col("quota")).alias("f"), "place")
    wanted = named.where("less > 0").withColumn("w", F.explode(F.sequence(F.lit(0).cast("long"), F.col("less") - 1)))
    filled = wanted.select(*known, (F.col("drawn") + F.col("w")).alias("nth"), (F.col("wants") + F.col("w")).alias("f")).join(freed, "f")
    taken = kept.union(filled.select(*known, "nth", "place"))
    lap = F.floor(F.col("nth") / F.col("n_blocks")).cast("long")
    block = permuted(F.col("nth") % F.col("n_blocks"), F.col("n_blocks"), F.col("key") + lap * 15485863)
    return taken.select("source", block.alias("block"), "place")


def packed(sizes: DataFrame) -> DataFrame:
    """sizes with `start`, the place of a row's first word in its source, and `grp`, its group there; rows without words
    have no place of their own."""
    n = sizes.count()
    groups = max(1, -(-n // GROUP))
    grouped = sizes.withColumn("grp", _scramble(F.abs(F.coalesce("doc_id", F.lit(-1)) % _P), F.lit(SEED).cast("long")) % groups)
    totals = grouped.groupBy("source", "grp").agg(F.sum("size").alias("words"))
    before = totals.withColumn("before", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = Window.partitionBy("source", "grp").orderBy("doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    within = grouped.withColumn("within", F.coalesce(F.sum("size").over(own), F.lit(0)))
    named = before.select(F.col("source").alias("of"), F.col("grp").alias("og"), "before")
    joined = within.join(named, F.col("source").eqNullSafe(F.col("of")) & (F.col("grp") == F.col("og")))
    return joined.withColumn("start", F.col("before") + F.col("within")).drop("of", "og", "before", "within")


def pieces(placed: DataFrame) -> DataFrame:
    """(source, start, block, from_word, n): the parts of each row with words that lie in one block."""
    last = F.floor((F.col("start") + F.col("size") - 1) / BLOCK).cast("long")
    cut = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK).cast("long"), last)))
    lo = F.greatest(F.col("start"), F.col("block") * BLOCK)
    hi = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK)
    return cut.select("source", "start", "block", (lo - F.col("start")).alias("from_word"), (hi - lo).alias("n"))


def _row_key(tie: Column) -> Column:
    """One string for a row's id, source and text digest; rows that share it are alike."""
    return F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")), tie))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def taken_pieces(placed: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """pieces with `places`, where in the mix their block lies, REPEATS times at most; blocks that are not taken are left out."""
    taken = draws(targets, seed).groupBy("source", "block").agg(F.array_sort(F.collect_list("place")).alias("places"))
    named = taken.select(F.col("source").alias("of"), F.col("block").alias("ob"), "places")
    # it is as large as the mix, which the planner cannot see: it must not be broadcast
    return pieces(placed).join(named.hint("merge"), _same("source", "of") & (F.col("block") == F.col("ob"))).drop("of", "ob")


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_shard, last_shard, places): one row for each row of docs (doc_id, text, source).

    size counts words, null text none. A null source is a source of its own, the last in order. taken counts the
    words of the row that the mix takes, repeats counted; it is at most REPEATS * size. first_shard and last_shard are
    the shards of the mix between which they lie, null if none are taken, and places sums shard * SLOTS + slot over the
    row's taken pieces: these are what the draws of seed decide. A null doc_id is allowed, and repeated rows are taken
    each on their own. Ties in order are broken by the text's md5. Texts are counted whole. Other columns are ignored.
    An empty table gives an empty table.
    """
    with scratch(docs.sparkSession) as kept:
        placed = stored(packed(document_sizes(docs)), "mix-placed")
        targets = source_targets(placed)
        one = taken_pieces(placed, targets, seed).withColumn("times", F.size("places"))
        where = F.aggregate("places", F.lit(0).cast("long"), lambda a, x: a + x)
        shard = lambda i: F.floor(F.element_at("places", i) / SLOTS)
        sums = {"taken": F.sum(F.col("times") * F.col("n")), "first_shard": F.min(shard(1)), "last_shard": F.max(shard(-1)), "places": F.sum(where)}
        taken = one.groupBy(F.col("source").alias("of"), F.col("start").alias("os")).agg(*[v.alias(k) for k, v in sums.items()])
        rows = placed.join(taken, _same("source", "of") & (F.col("start") == F.col("os")) & (F.col("size") > 0), "left").drop("of", "os")
        # a source's row goes to each of its groups first, so that a source's rows need not meet
        groups = placed.select(F.col("source").alias("og"), F.col("grp").alias("gg")).distinct()
        named = groups.join(targets.select(F.col("source").alias("of"), "source_size", "target"), _same("og", "of")).drop("of")
        out = rows.join(named, _same("source", "og") & (F.col("grp") == F.col("gg")))
        return kept.stored(out.select("doc_id", "size", "source_size", "target", *[F.coalesce(c, F.lit(0)).alias(c) if c in ("taken", "places") else c for c in sums]), "mix-result")


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs as the mix takes them: for each lap of the permutations a row with the taken words of the text.

    Rows come in the order of the mix, by the place of a lap's first block, in ranges of it. Columns of docs stay,
    whatever their names; text keeps its blanks between taken words and n_chars, if there, is the new length. A row of
    which the mix takes nothing goes; one taken whole twice comes twice. Texts are taken whole.
    """
    key, at, laps, lap, split, order = (fresh(docs, x) for x in ("mix_key", "mix_at", "mix_laps", "mix_lap", "mix_words", "mix_order"))
    with scratch(docs.sparkSession) as kept:
        placed = stored(packed(document_sizes(docs)), "mix-placed")
        parts = taken_pieces(placed, source_targets(placed), seed)
        laps_ = parts.select("source", "start", F.posexplode("places").alias("lap", "place"), F.struct("from_word", "n").alias("p"))
        per_lap = laps_.groupBy("source", "start", "lap").agg(F.struct(F.min("place").alias("place"), F.array_sort(F.collect_list("p")).alias("parts")).alias("l"))
        per = per_lap.groupBy(F.col("source").alias("of"), F.col("start").alias("os")).agg(F.collect_list("l").alias("laps"))
        found = placed.join(per, _same("source", "of") & (F.col("start") == F.col("os")) & (F.col("size") > 0))
        # repeated rows are alike, so one of them gets the laps of all
        merged = kept.stored(found.select(_row_key(F.col("tie")).alias(at), "laps").groupBy(at).agg(F.flatten(F.collect_list("laps")).alias(laps)), "mix-laps")
    own = docs.withColumn(key, _row_key(F.md5(F.coalesce(F.col("text"), F.lit("")))))
    joined = own.join(merged, F.col(key) == F.col(at)).dropDuplicates([key])
    cut = joined.withColumn(split, F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)))
    taken = F.flatten(F.transform(F.col(lap)["parts"], lambda p: F.slice(split, (p["from_word"] + 1).cast("int"), p["n"].cast("int"))))
    each = cut.withColumn(lap, F.explode(laps)).withColumn("text", F.array_join(taken, "")).withColumn(order, F.col(lap)["place"])
    if "n_chars" in docs.columns:
        each = each.withColumn("n_chars", F.length("text").cast("long"))
    return each.select(*columns_but(docs), order).repartitionByRange(order).sortWithinPartitions(order).select(*columns_but(docs))


def _scramble_sql(rows: str, x: str, key: str, name: str) -> str:
    """rows with a column `name` that holds _scramble(x, key): a nested query for each line of it."""
    one = f"select *, (({x} % {_P} + {key}) % {_P} * {_M1} + 11) % {_P} as y1 from ({rows})"
    two = f"select *, (y1 * {_M2} + (y1 >> 15)) % {_P} as y2 from ({one})"
    return f"select * exclude (y1, y2), (y2 * {_M3} + (y2 >> 13)) % {_P} as {name} from ({two})"


def _sql(docs: str = "documents", seed: int = SEED) -> str:
    """DuckDB SQL for mix()."""
    step = "select source, t, n, k, a, b, i, pos % a as l, pos // a as r from walk where i = 0 or (pos >= n and i < 16)"
    for i in range(_ROUNDS):
        step = f"select * replace ((l + s) % a as l) from ({_scramble_sql(step, 'r', f'(k + {7919 * (i + 1)})', 's')})"
        step = f"select * exclude (s) from ({step})"
        step = f"select * replace ((r + s) % b as r) from ({_scramble_sql(step, 'l', f'(k + {7919 * (i + 1) + 104729})', 's')})"
        step = f"select * exclude (s) from ({step})"
    grouped = _scramble_sql("select * from d", f"abs(coalesce(doc_id, -1) % {_P})", str(SEED), "h")
    return f"""
with recursive d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as bigint) as size, md5(coalesce(text, '')) as tie from {docs}),
g as (select * exclude (h), h % greatest(1, (select cast(ceil(count(*) / {GROUP}) as bigint) from d)) as grp from ({grouped})),
b as (select source, grp, sum(words) over (partition by source order by grp) - words as before from (select source, grp, sum(size) as words from g group by all)),
p as (select g.doc_id, g.source, g.size, cast(before + sum(size) over (partition by g.source, g.grp order by doc_id nulls first, tie rows between unbounded preceding and current row) - size as bigint) as start
      from g join b on g.source is not distinct from b.source and g.grp = b.grp),
s1 as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source is null, source) - 1 as rank from d group by source),
s2 as (select *, {list(WEIGHTS)}[rank % {len(WEIGHTS)} + 1] as weight from s1),
s3 as (select *, cast(source_size as double) / weight as ratio, sum(source_size) over () as total, sum(weight) over () as w,
      coalesce(sum(source_size) over o, 0) * {REPEATS} as capped, coalesce(sum(weight) over o, 0) as used
      from s2 window o as (order by cast(source_size as double) / weight, rank rows between unbounded preceding and 1 preceding)),
s4 as (select *, cast(total - capped as double) / (w - used) as share from s3),
level as (select max(share) as share from (select share from s4 where share * weight <= source_size * {REPEATS} order by ratio, rank limit 1)),
s5 as (select s4.source, source_size, rank, least(coalesce(level.share * weight, cast(source_size * {REPEATS} as double)), cast(source_size * {REPEATS} as double)) as target,
      (source_size + {BLOCK - 1}) // {BLOCK} as nb from s4, level),
s6 as (select *, (rank * 1299709 + {SEED}) % {_P} as k,
      case when source_size > 0 then least(cast(floor(target * nb / source_size + 0.5) as bigint), nb * {REPEATS}) else 0 end as quota from s5),
total as (select cast(sum(quota) as bigint) as total from s6),
ends as (select rank, cast(floor(cast(e - quota as double) / total * {_P}) as bigint) as lo, cast(floor(cast(e as double) / total * {_P}) as bigint) as hi from (select rank, quota, cast(sum(quota) over (order by rank) as bigint) as e from s6), total),
slots as (select id, id // {SLOTS} as shard, cast('0x' || substr(md5('{seed}:' || id), 1, 8) as bigint) % {_P} as h from (select unnest(range(0, total)) as id from total)),
dr as (select id, shard, rank, row_number() over (partition by shard order by rank, id) - 1 as slot, row_number() over (partition by rank order by shard, id) - 1 as at_ from slots join ends on h >= lo and h < hi),
nm as (select s6.*, coalesce(drawn, 0) as drawn, greatest(coalesce(drawn, 0) - quota, 0) as more, greatest(quota - coalesce(drawn, 0), 0) as less from s6 left join (select rank, count(*) as drawn from dr group by rank) using (rank)),
n2 as (select *, cast(sum(more) over (order by rank) as bigint) - more as free, cast(sum(less) over (order by rank) as bigint) - less as wants from nm),
nu as (select n2.*, case when drawn > quota then at_ * (case when drawn % {_SPREAD} = 0 then {_OTHER_SPREAD} else {_SPREAD} end) % drawn else at_ end as nth,
      shard * {SLOTS} + case when shard < total // {SLOTS} then slot * {_ODD} % {SLOTS} else slot end as place from dr join n2 using (rank), total),
tk as (select source, nb, k, nth, place from nu where nth < quota union all select w.source, w.nb, w.k, w.nth, f.place from (select *, drawn + j as nth, wants + j as f from (select *, unnest(range(0, less)) as j from n2)) w
      join (select free + nth - quota as f, place from nu where nth >= quota) f using (f)),
t as (select source, place, nb as n, k + (nth // nb) * 15485863 as k, nth % nb as x from tk),
walk as (select source, t, n, k, a, (n + a - 1) // a as b, x as pos, 0 as i from (select *, place as t, greatest(cast(ceil(sqrt(n)) as bigint), 1) as a from t)
  union all select source, t, n, k, a, b, r * a + l as pos, i + 1 as i from ({step})),
times as (select source, pos as block, t as place from walk where i > 0 and pos < n),
piece as (select source, start, block, least(start + size, (block + 1) * {BLOCK}) - greatest(start, block * {BLOCK}) as n
      from (select *, unnest(range(start // {BLOCK}, (start + size - 1) // {BLOCK} + 1)) as block from p where size > 0)),
taken as (select piece.source, start, cast(sum(n) as bigint) as taken, min(place) // {SLOTS} as first_shard, max(place) // {SLOTS} as last_shard, cast(sum(place) as bigint) as places
      from piece join times on piece.source is not distinct from times.source and piece.block = times.block group by piece.source, start)
select p.doc_id, p.size, s6.source_size, s6.target, coalesce(taken.taken, 0) as taken, first_shard, last_shard, coalesce(places, 0) as places from p join s6 on p.source is not distinct from s6.source
left join taken on p.source is not distinct from taken.source and p.start = taken.start and p.size > 0
"""


SQL = _sql()
