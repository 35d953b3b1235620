"""Mixing sources to target weights, with DataFrame functions only.

Each source's words, in a fixed order of its documents, are packed into blocks of BLOCK words (the last may be shorter).
A source fills `slots` of the mix: whole passes over its blocks, then as many more as the target still asks for, the
last of them cut to the word. How many slots of a source an output shard gets is drawn: multinomial counts, given the
sources' totals, which stay exact. A shard's slots of a source are a range of the source's slot numbers. A slot's number
within its pass goes through a pseudorandom permutation of the source's block numbers, one for each pass: Feistel rounds
over a rectangle that holds the numbers, walked on until the number is a block's. So a pass takes each block once.
Blocks, and with them documents, join the slots by (source, index).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

BLOCK = 1024
#: Documents of one part of a source for the running sum: a hot source is summed by many tasks.
PART_ROWS = 50_000
#: Slots of a source that one row is exploded into.
CHUNK = 65_536
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SHARDS = 64
#: Half rounds of the permutation, and steps of the walk: numbers outside are fewer than the rectangle is wide, so 32
#: steps always do up to 1,024 blocks, and beyond that they fail with a chance below 32^-32; then the query stops.
ROUNDS, WALK = 4, 32


def let(c: Column, f) -> Column:
    """f(c) with c computed once, however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def draw(value: Column, key: Column) -> Column:
    """A pseudorandom integer of 27 bits for a value and a key, both from 0 to 2^31. Products stay below 2^63."""
    first = (value * 1103515245 + key * 12345 + 99991) % 2147483647
    return let(let(first, lambda t: (t * t + key) % 2147483629), lambda t: F.floor((t * t + value) % 2147483587 / 16))


def key_of(rank: Column, number: Column, seed: int) -> Column:
    return draw(rank * 1009 + number, F.lit(seed + 7).cast("long"))


def permuted(k: Column, n: Column, key: Column) -> Column:
    """The place of k among 0 to n - 1 under the permutation that the key names."""
    wide = F.ceil(F.sqrt(n.cast("double")))

    def walked(size: Column) -> Column:
        wide, high = size["wide"], size["high"]

        def half(s: Column, i: Column) -> Column:
            even = i % 2 == 0
            drawn = let(
                F.struct(F.when(even, s["right"]).otherwise(s["left"]).alias("v"), (key + i).alias("k")),
                lambda x: draw(x["v"], x["k"]),
            )
            left = F.when(even, (s["left"] + drawn) % wide).otherwise(s["left"])
            return F.struct(
                left.alias("left"), F.when(even, s["right"]).otherwise((s["right"] + drawn) % high).alias("right")
            )

        def turn(x: Column) -> Column:
            start = F.struct(F.floor(x / high).alias("left"), (x % high).alias("right"))
            return F.aggregate(
                F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, half, lambda s: s["left"] * high + s["right"]
            )

        step = lambda x, i: F.when((i > 0) & (x < n), x).otherwise(turn(x))
        return F.aggregate(F.sequence(F.lit(0), F.lit(WALK)), k.cast("long"), step)

    found = let(F.struct(wide.alias("wide"), F.ceil(n / wide).alias("high")), walked)
    return let(
        found,
        lambda x: F.when(x < n, x).otherwise(F.raise_error(F.lit("a permutation's walk did not end")).cast("long")),
    )


def targets(rows: DataFrame) -> DataFrame:
    """A row for each source: rank, source, source_size, target, and its numbers of blocks, passes, words and slots.

    Shares go by weight and stop at MOST times the source's size; what is left over is shared again by weight. With
    sources in order of size to weight, those that stop come first, and the level of the others is the largest of
    (words left) / (weights left).
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    everything = Window.partitionBy()
    src = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    src = src.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("rank") % len(WEIGHTS) + 1))
    src = src.withColumn("most", F.col("source_size") * MOST).withColumn(
        "asked", F.sum("source_size").over(everything) * F.lit(SHARE)
    )
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    full = F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    src = src.withColumn("level", (F.col("asked") - full) / open_weight)
    src = src.withColumn(
        "target", F.least(F.col("most").cast("double"), F.max("level").over(everything) * F.col("weight"))
    )
    src = src.withColumn(
        "blocks", F.ceil(F.col("source_size") / BLOCK)
    ).withColumn("words", F.floor(F.col("target") + 0.5))
    src = src.withColumn(
        "passes", F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(0)
    )
    src = src.withColumn("rest", F.col("words") - F.col("passes") * F.col("source_size"))
    src = src.withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / BLOCK))
    src = src.withColumn("parts", F.ceil(F.col("n_rows") / PART_ROWS))
    return src.select(
        F.col("rank").cast("long").alias("rank"),
        "source",
        "source_size",
        "target",
        "blocks",
        "passes",
        "rest",
        "slots",
        "parts",
    )


def numbered(src: DataFrame, count: str) -> DataFrame:
    """src with `number` from 0 to count - 1, a row each, made by many tasks."""
    chunks = src.filter(F.col(count) > 0).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / CHUNK)))
    )
    last = F.least(F.col(count), (F.col("chunk") + 1) * CHUNK) - 1
    return chunks.repartition("rank", "chunk").withColumn(
        "number", F.explode(F.sequence(F.col("chunk") * CHUNK, last))
    ).drop("chunk")


def shard_counts(src: DataFrame, seed: int = 0, shards: int = SHARDS) -> DataFrame:
    """(rank, shard, n, first): each shard's multinomial count of a source's slots, and the first of its slot numbers."""
    shard = draw(F.col("number"), key_of(F.col("rank"), F.lit(0), seed)) % shards
    drawn = numbered(src, "slots").select(
        "rank", shard.cast("int").alias("shard")
    ).groupBy("rank", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # `shards` rows a source
    return drawn.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))


def slots(src: DataFrame, seed: int = 0, shards: int = SHARDS) -> DataFrame:
    """A row for each slot: rank, shard, slot, pass, block, take (words from the block's start)."""
    counts = shard_counts(src, seed, shards).join(src.select("rank", "blocks", "passes", "rest"), "rank")
    each = numbered(counts, "n").withColumn("slot", F.col("first") + F.col("number"))
    each = each.withColumn(
        "pass", F.floor(F.col("slot") / F.col("blocks"))
    ).withColumn("k", F.col("slot") % F.col("blocks"))
    block = permuted(F.col("k"), F.col("blocks"), key_of(F.col("rank"), F.col("pass") + 1, seed))
    whole = F.lit(BLOCK).cast("long")
    take = F.when(F.col("pass") < F.col("passes"), whole).otherwise(F.least(whole, F.col("rest") - F.col("k") * BLOCK))
    return each.select("rank", "shard", "slot", "pass", block.alias("block"), take.alias("take"))


def word_count(text: Column) -> Column:
    return F.regexp_count(C.null_safe_text(text), F.lit(C.WORD)).cast("long")


def packed(rows: DataFrame, src: DataFrame) -> DataFrame:
    """rows (with source, size, doc_id) with rank, source_size, target and start: the document's first word in its source.

    doc_id is a number. A source's documents are dealt to parts by a draw from their ids; parts follow one another, and
    within a part documents follow by id, size and tie, a hash of what else they hold. Parts of a source have about PART_ROWS rows, whatever its size.
    """
    of = src.select(F.col("source").alias("of"), "rank", "source_size", "target", "parts")
    rows = rows.join(of, rows["source"].eqNullSafe(of["of"])).drop("of")
    part = draw(F.pmod(F.coalesce("doc_id", "size"), F.lit(1 << 31)), F.col("rank")) % F.col("parts")
    rows = rows.withColumn("part", part).drop("parts")
    totals = rows.groupBy("rank", "part").agg(F.sum("size").alias("part_words"))
    before = Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "rank", "part", F.coalesce(F.sum("part_words").over(before), F.lit(0)).alias("words_before")
    )
    within = Window.partitionBy("rank", "part").orderBy("doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("run", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = rows.join(offsets.hint("merge"), ["rank", "part"])
    return placed.withColumn("start", F.col("words_before") + F.col("run")).drop("part", "run", "words_before", "tie")


def taken_pieces(placed: DataFrame, src: DataFrame, seed: int = 0) -> DataFrame:
    """The mix: a row for each piece of a document in a slot: rank, start (which name the document), shard, slot, pass, first, words."""
    end = F.col("start") + F.col("size")
    blocks = F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((end - 1) / BLOCK)))
    pieces = placed.filter("size > 0").select("rank", "start", "size", blocks.alias("block"))
    low, high = F.greatest(F.col("start"), F.col("block") * BLOCK), F.least(end, (F.col("block") + 1) * BLOCK)
    pieces = pieces.select(
        "rank",
        "block",
        "start",
        (low - F.col("block") * BLOCK).alias("at"),
        (low - F.col("start")).alias("first"),
        (high - low).alias("length"),
    )
    out = pieces.join(slots(src, seed).hint("merge"), ["rank", "block"])
    words = F.least(F.col("length"), F.col("take") - F.col("at"))
    return out.withColumn("words", words).filter("words > 0").select(
        "rank", "start", "shard", "slot", "pass", "first", "words"
    )


def mix(df: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards for every row of df. shards: the output shards with words of it.

    size: words of the text (null: 0). Null source: a source of its own, the last. Null id: a document like any other.
    Repeated rows: one row each, each with words of its own. Very long texts are counted whole. Empty text: taken 0. Empty
    table: no rows. Ties in the order are between rows of one id, size and text. Reruns take the same words. Other columns are not read.
    """
    tie = F.xxhash64("text").alias("tie")
    rows = C.materialise(df.select("doc_id", "source", word_count(F.col("text")).alias("size"), tie), "words")
    src = C.materialise(targets(rows), "targets", narrow=True)
    placed = packed(rows, src)
    shards = F.array_join(F.sort_array(F.collect_set("shard")), ",").alias("shards")
    taken = taken_pieces(placed, src, seed).groupBy("rank", "start").agg(F.sum("words").alias("taken"), shards)
    same = (F.col("d.rank") == F.col("t.rank")) & (F.col("d.start") == F.col("t.start")) & (F.col("d.size") > 0)
    named = placed.alias("d").join(taken.hint("merge").alias("t"), same, "left")
    return named.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        F.coalesce("shards", F.lit("")).alias("shards"),
    )


def mixed_documents(df: DataFrame, seed: int = 0, shard: str | None = None) -> DataFrame:
    """df as the mix takes it: for each pass over its source a row for each document of which words are taken.

    A document taken whole keeps its text; of one taken in part the words taken are joined by one space. n_chars, if it
    is a column, is counted again. Documents without words (null or empty text) are in no block and go. All columns of
    df stay, under any names; very long texts are cut like any other; `shard` names one more, for the output shard of the document's first words. Null source: a
    source of its own. Repeated rows: each has words of its own. Empty table: no rows. Reruns agree.
    """
    names = df.columns
    wide = df.select(
        "doc_id",
        "source",
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        word_count(F.col("text")).alias("size"),
        F.xxhash64(*[F.col(f"`{c}`") for c in names]).alias("tie"),
    )
    src = C.materialise(targets(wide.select("source", "size")), "targets", narrow=True)
    placed = packed(wide, src)
    thin = packed(wide.drop("row"), src)
    pieces = F.sort_array(F.collect_list(F.struct("first", "words", "shard"))).alias("pieces")
    taken = taken_pieces(thin, src, seed).groupBy("rank", "start", "pass").agg(F.sum("words").alias("taken"), pieces)
    both = placed.join(taken.hint("merge"), ["rank", "start"]).filter("size > 0")
    words = F.regexp_extract_all(F.col("row.text"), F.lit(C.WORD), F.lit(0))
    cut = lambda w: F.flatten(
        F.transform("pieces", lambda p: F.slice(w, (p["first"] + 1).cast("int"), p["words"].cast("int")))
    )
    # the array of one keeps the words from being split anew for every piece
    some = F.get(F.transform(F.array(words), lambda w: F.array_join(cut(w), " ")), F.lit(0))
    text = F.when(F.col("taken") == F.col("size"), F.col("row.text")).otherwise(some)
    both = both.withColumn("text", text)
    fields = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    extra = [F.col("pieces")[0]["shard"].alias(shard)] if shard else []
    return both.select(*[(fields[c] if c in fields else F.col(f"row.`{c}`")).alias(c) for c in names], *extra)
