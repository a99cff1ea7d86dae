"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions only.

1. Sizes are words; every source gets a weight (1, 2, 3 repeating by code point, null last) and
   a target: its weighted share of all words, stopped at ``most`` times its size, with the excess
   reshared by weight. The capped sources are a prefix of the order by cap/weight, so running
   sums give the level at once instead of repeated resharing.
2. Documents are dealt to shards (seeded hash of id and text, so an id that repeats with other texts
   spreads), which bounds every running sum below; within a (source, shard) they stand in seeded
   order and their words are cut into blocks of equal length.
3. The blocks of the whole mix are allocated by highest quotients v/(2s+1): first to sources, then,
   where a table has more than ``GROUP_SHARDS`` shards, inside a source to groups of so many shards,
   then inside these to shards, so no window has more than ``GROUP_SHARDS`` shards of a source.
   Seats that surely belong to a party are given at once; only the seats near the common divisor
   are ranked, so the rows stay in proportion to the parties. Sources themselves (a row each) meet
   in one window.
4. A shard takes its quota by seeded systematic choice: block j is taken floor((j+1+o)q/n) -
   floor((j+o)q/n) times. The sums telescope, so a document of any length needs four terms and
   no block is ever written out as a row.

Defined cases: null and blank texts have size 0 and take 0; a null source is a source of its own
(last); texts of any length are counted whole; repeated rows count separately and may take
different amounts; ties in order are broken by id, text and size, ties of quotients by party and
seat; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCK_WORDS = 16
SHARD_DOCS = 1000
#: Shards of a source that one window deals blocks to.
GROUP_SHARDS = 1000
SEED = 17
MOST = 3


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+"))).cast("long")


def seeded(seed: int, *cols: Column) -> Column:
    """Hex text in seeded order; MD5, so that other engines can repeat it."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("-")) for c in cols]))


def number(hex_text: Column) -> Column:
    """The first 8 hex digits as a number below 2^32."""
    return F.conv(F.substring(hex_text, 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """source, source_size, cap, weight, target; one row a source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_first())
    before, whole = level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    free = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    share = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    shared = weighed.withColumn("level", free / share).withColumn("capped", F.col("cap") < F.col("level") * F.col("weight"))
    # beyond the capped prefix the level stays as it was at the first source that isn't capped
    first = F.min_by(F.col("level"), F.when(~F.col("capped"), F.col("cap") / F.col("weight"))).over(whole)
    return shared.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("cap"), first * F.col("weight")))).select("source", "source_size", "weight", "target")


def apportion(parties: DataFrame, group: list[str], key: list[Column], votes: str, seats: str, most: str) -> DataFrame:
    """Adds ``quota``: ``seats`` seats of each group dealt to its parties by highest quotients.

    ``most`` (seats a party can hold) bounds every quota. A party surely gets the seats whose
    quotient beats the pessimistic divisor and none below the optimistic one; what lies between
    is ranked. The ideal divisor d gives every party votes/d seats, give or take half a seat
    each, so between d(1-w) and d(1+w) with w = (parties+1)/seats lie all open seats.
    """
    whole = Window.partitionBy(*group)
    total, n = F.sum(votes).over(whole), F.count(F.lit(1)).over(whole)
    ideal = F.when(F.col("__total") > 0, F.col(votes) * F.col(seats) / F.col("__total")).otherwise(0.0)
    slack = (F.col("__n") + 1) / F.greatest(F.col(seats), F.lit(1))
    df = parties.withColumns({"__total": total, "__n": n}).withColumn("__ideal", ideal)
    df = df.withColumn("__low", F.least(F.col(most), F.greatest(F.lit(0), F.floor(F.col("__ideal") * (1 - slack) - 1))).cast("long"))
    df = df.withColumn("__high", F.least(F.col(most), F.ceil(F.col("__ideal") * (1 + slack) + 2)).cast("long"))
    df = df.withColumn("__open", F.col(seats) - F.sum("__low").over(whole))
    seat = df.select("*", F.explode_outer(F.when(F.col("__high") > F.col("__low"), F.sequence(F.col("__low"), F.col("__high") - 1))).alias("__seat"))
    quotient = F.col(votes) / (2 * F.col("__seat") + 1)
    ranked = seat.withColumn("__rank", F.row_number().over(whole.orderBy(quotient.desc_nulls_last(), *key, F.col("__seat"))))
    won = (F.col("__seat").isNotNull() & (F.col("__rank") <= F.col("__open"))).cast("long")
    kept = [c for c in parties.columns]
    return ranked.groupBy(*kept, "__low").agg(F.sum(won).alias("__won")).select(*kept, (F.col("__low") + F.col("__won")).alias("quota"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, seed: int = SEED, most: int = MOST, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and the columns ``carry`` for every document;
    a carried ``text`` comes back as the mix has it: the blocks taken, as often as they are taken."""
    ids = docs.select(*carry, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("body"))
    count = docs.count()
    shards = max(1, -(-count // shard_docs))
    ids = ids.withColumn("shard", number(seeded(seed, F.col("doc_id"), F.col("body"))) % shards)
    by_shard = ids.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))
    by_source = targets(by_shard.groupBy("source").agg(F.sum("shard_size").alias("source_size")), most)
    seats = by_source.withColumns({"__all": F.lit(1), "blocks": F.round(F.sum("target").over(Window.partitionBy(F.lit(1))) / block_words).cast("long"), "most": F.ceil(F.lit(most) * F.col("source_size") / block_words).cast("long")})
    seats = apportion(seats, ["__all"], [F.col("source").asc_nulls_last()], "target", "blocks", "most").withColumnRenamed("quota", "source_quota")
    shard = by_shard.join(seats.select(F.col("source").alias("s2"), "source_size", "target", "source_quota"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    shard = shard.withColumns({"votes": F.col("shard_size").cast("double"), "most": F.ceil(F.col("shard_size") / block_words) * most})
    groups = -(-shards // GROUP_SHARDS)
    shard = shard.withColumn("group", F.pmod(F.col("shard"), F.lit(groups)))
    if groups > 1:
        # a table of their own, so that a source with most shards can be split in the join
        of_group = shard.groupBy("source", "group").agg(F.sum("votes").alias("votes"), F.sum("most").alias("most"), F.first("source_quota").alias("source_quota"))
        won = written(apportion(of_group, ["source"], [F.col("group")], "votes", "source_quota", "most").select(F.col("source").alias("s2"), F.col("group").alias("g2"), F.col("quota").alias("group_quota")))
        shard = shard.join(won, F.col("source").eqNullSafe(F.col("s2")) & (F.col("group") == F.col("g2"))).drop("s2", "g2", "source_quota").withColumnRenamed("group_quota", "source_quota")
    dealt = apportion(shard, ["source", "group"], [F.col("shard")], "votes", "source_quota", "most")
    dealt = dealt.select(F.col("source").alias("s2"), F.col("shard").alias("h2"), "source_size", "target", "shard_size", "quota")

    line = Window.partitionBy("source", "shard").orderBy(seeded(seed + 1, F.col("doc_id")), "doc_id", "body", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = ids.withColumn("stop", F.sum("size").over(line)).withColumn("start", F.col("stop") - F.col("size"))
    joined = placed.join(dealt, F.col("source").eqNullSafe(F.col("s2")) & (F.col("shard") == F.col("h2"))).drop("s2", "h2")
    blocks = F.greatest(F.ceil(F.col("shard_size") / block_words), F.lit(1)).cast("long")
    joined = joined.withColumn("n", blocks).withColumn("o", number(seeded(seed + 2, F.col("source"), F.col("shard"))) % F.col("n"))
    joined = joined.withColumns({"a": F.floor(F.col("start") / block_words).cast("long"), "b": F.floor((F.col("stop") - 1) / block_words).cast("long")})

    def upto(j: Column) -> Column:
        """Blocks taken among the first j of the shard."""
        return F.floor((j + F.col("o")) * F.col("quota") / F.col("n")) - F.floor(F.col("o") * F.col("quota") / F.col("n"))

    times = lambda j: upto(j + 1) - upto(j)
    a, b = F.col("a"), F.col("b")
    one = times(a) * F.col("size")
    ends = times(a) * ((a + 1) * block_words - F.col("start")) + times(b) * (F.col("stop") - b * block_words) + (upto(b) - upto(a + 1)) * block_words
    taken = F.when(F.col("size") == 0, F.lit(0)).when(a == b, one).otherwise(ends).cast("long")
    carried = [mixed_text(times, block_words, most).alias(c) if c == "text" else c for c in carry]
    return joined.select("doc_id", "source", "size", "source_size", "target", F.least(taken, F.col("size") * most).alias("taken"), *carried)


def mixed_text(times, block_words: int, most: int) -> Column:
    """The words taken of ``text``, in passes: the first has every block taken at all, the second
    those taken twice or more, and so on; a pass starts after an empty line. White space between
    words of neighbouring blocks stays as it is."""
    words = F.regexp_extract_all(F.concat(F.col("text").cast("string"), F.lit("\n")), F.lit("[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*"), F.lit(0))

    def of_block(words: Column, j: Column) -> Column:
        first = F.greatest(j * block_words, F.col("start"))
        return F.slice(words, (first - F.col("start") + 1).cast("int"), (F.least((j + 1) * block_words, F.col("stop")) - first).cast("int"))

    def one_pass(words: Column, p: Column) -> Column:
        blocks = F.filter(F.sequence(F.col("a"), F.col("b")), lambda j: times(j) >= p)
        return F.rtrim(F.array_join(F.flatten(F.transform(blocks, lambda j: of_block(words, j))), ""), F.lit(" \t\n\x0b\f\r"))

    passes = F.element_at(F.transform(F.array(words), lambda w: F.filter(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda p: one_pass(w, p)), lambda t: t != "")), 1)
    return F.when(F.col("size") > 0, F.array_join(passes, "\n\n")).otherwise(F.lit(""))
