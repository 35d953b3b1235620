"""Set-similarity self-join on word n-grams: rare-first prefixes, length, positional and suffix filters, one check a pair.

Documents with equal sets are one node; a node's set is kept once. Then:

1. Census. Exact document frequencies of all n-grams over all nodes, pre-aggregated in each bucket. They fix one global
   order, from rare to common, ties by hash.
2. Prefixes. Two sets of similarity >= t share an n-gram within the first n - ceil(t n) + 1 of either. N-grams of one
   node are in no other set, so they stay in the prefix's count but are not sent. Most nodes send nothing.
3. Candidates join on prefix n-grams, under the filters below. Only links matter, not all pairs of a group, so there
   are three passes. First each node is checked with the one hub that shares most prefix n-grams with it (an n-gram's
   hub is the node with the fewest n-grams of its own). Then, of each n-gram, one node of every component is checked
   with the hub. Last, all candidate pairs whose nodes are still in different components are checked.
   No link is lost: two nodes that link share a first n-gram in the order; it is in both prefixes, and there both pass
   the filters. Either they are in one component already, or the last pass meets them. Pairs within one component need
   no check, so a large group of near copies costs about one check a node.
   An n-gram's rows are split by its document frequency, which each row carries, so no task holds all of a hot one.
4. A pair is checked once, on whole sets.

Filters for sets x, y with overlap bound a = ceil(t/(1+t) (|x|+|y|)): length |x| >= t |y|; positional: the shorter rest
from the shared n-gram on >= a; suffix: each set has a signature of BITS bits, the parities of its counts in BITS hash
classes, and signatures that differ in more than |x|+|y|-2a bits belong to sets that differ in more members than that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


from . import common as C
from .components import components

#: Partners of one hub in one group of rows.
HUB_SHARE = 512
#: Rows of one n-gram in one group of rows.
HOT = 4096
#: Doublings of the paths of which components are made between the passes.
CLIMBS = 2
#: Cells of like sizes between n and e * n: about four up to the longest partner at 80 percent.
CELLS = 18


def ngram_set(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct k-gram hashes, sorted; fewer than k words are one n-gram; no words, none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(C.grams(words, min(k, len(words))))


def sets_of(texts: pa.Array, k: int) -> list[np.ndarray]:
    words = C.Words(texts, lower=True)
    whole = C.grams(words.flat, k)
    bounds = zip(words.ends[:-1].tolist(), words.ends[1:].tolist())
    return [np.unique(whole[i : j - k + 1]) if j - i >= k else ngram_set(words.flat[i:j], k) for i, j in bounds]


def node_of(own: np.ndarray) -> int:
    """A set's name: 63 bits of a hash of its members and size."""
    return (C.xxh3_64_intdigest(own.tobytes(), seed=len(own)) >> 1) if len(own) else -1


def describe(k: int):
    def run(batches):
        for batch in batches:
            own = sets_of(batch.column("text"), k)
            nodes, sizes = pa.array([node_of(s) for s in own], pa.int64()), pa.array([len(s) for s in own], pa.int64())
            columns = [batch.column("key"), batch.column("doc_id"), nodes, sizes]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "node", "n"])

    return run


def nodes_of(k: int):
    """A text for each distinct set that a task meets: (node, text)."""

    def run(batches):
        seen = set()
        for batch in batches:
            text = batch.column("text")
            found = {}
            for i, own in enumerate(sets_of(text, k)):
                if len(own):
                    found.setdefault(node_of(own), i)
            new = [(node, i) for node, i in found.items() if node not in seen]
            seen.update(found)  # as many as a task has rows
            rows = pa.array([i for _, i in new], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([node for node, _ in new], pa.int64()), text.take(rows)], names=["node", "text"]
            )

    return run


#: An n-gram is counted by the first CLASS bytes of its hash. N-grams that share them count as one, so they may look
#: more common than they are, to every node alike: the order stays one order, and none that another node has looks unique.
CLASS = 6


def classes(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - 8 * CLASS)


def packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :CLASS].tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // CLASS, 8), np.uint8)
    out[:, :CLASS] = np.frombuffer(blob, np.uint8).reshape(-1, CLASS)
    return out.reshape(-1).view("<u8")


def census(k: int, parts: int):
    """To the parts: a bucket's n-grams, and in how many of its nodes those are that are in several. Singles come first."""

    def run(key, tbl):
        found, times = np.unique(classes(np.concatenate(sets_of(tbl.column("text"), k))), return_counts=True)
        part = (found % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((times > 1, part))
        found, times, part = found[order], times[order], part[order]
        at, out = C.split_runs(part), []
        for i, j in zip(at[:-1], at[1:]):
            own = times[i:j]
            out.append((int(part[i]), packed(found[i:j]), own[own > 1].astype(np.uint32).tobytes()))
        kinds = (pa.int32(), pa.binary(), pa.binary())
        p, grams, many = (pa.array([x[c] for x in out], t) for c, t in enumerate(kinds))
        return pa.table({"p": p, "b": pa.array([key[0].as_py()] * len(out), pa.int32()), "grams": grams, "times": many})

    return run


def tally(key, tbl):
    """Of one part: to each bucket, those of its n-grams that two nodes or more have, and how many."""
    owners = tbl.column("b").to_pylist()
    grams = [unpacked(x) for x in tbl.column("grams").to_pylist()]
    times = []
    for own, many in zip(grams, tbl.column("times").to_pylist()):
        many = np.frombuffer(many, np.uint32).astype(np.int64)
        times += [np.ones(len(own) - len(many), np.int64), many]
    names, index = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.bincount(index, weights=np.concatenate(times), minlength=len(names)).astype(np.int64)[index]
    out, at = [], 0
    for b, own in zip(owners, grams):
        df = total[at : at + len(own)]
        at += len(own)
        many = df > 1
        if many.any():
            out.append((b, packed(own[many]), df[many].astype(np.uint32).tobytes()))
    kinds = (pa.int32(), pa.binary(), pa.binary())
    return pa.table(
        {name: pa.array([x[c] for x in out], t) for c, (name, t) in enumerate(zip(("b", "grams", "times"), kinds))}
    )


def ordered(own: np.ndarray, grams: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set from rare to common, ties by hash, and each member's document frequency."""
    df = np.ones(len(own), np.int64)
    if len(grams):
        key = classes(own)
        at = np.minimum(np.searchsorted(grams, key), len(grams) - 1)
        df = np.where(grams[at] == key, times[at], df)
    order = np.lexsort((own, df))
    return own[order], df[order]


BITS = 2048
PREFIX = pa.schema([
    ("h", pa.int64()), (
        "node", pa.int64()
    ), ("n", pa.int32()), ("pos", pa.int32()), ("own", pa.int32()), ("df", pa.int64()),
    ("signature", pa.list_(pa.int64())), ("members", pa.binary()),
])


def signature(own: np.ndarray) -> list[int]:
    """Parities of the members' counts in BITS classes, as 64-bit integers."""
    shift = np.uint64(64 - BITS.bit_length() + 1)
    odd = (np.bincount((own >> shift).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).tolist()


def prefixes(k: int, percent: int):
    """Of a bucket: a row for each prefix n-gram that another node has too, and one with the whole set of each such node."""

    def run(key, left, right):
        if not left.num_rows:
            return PREFIX.empty_table()
        grams = unpacked(b"".join(right.column("grams").to_pylist()))
        times = C.from_blobs(right.column("times"), np.uint32).astype(np.int64)
        order = np.argsort(grams, kind="stable")
        grams, times = grams[order], times[order]
        columns, kept = {c: [] for c in ("h", "node", "n", "pos", "own", "df")}, []
        for name, own in zip(left.column("node").to_pylist(), sets_of(left.column("text"), k)):
            size = len(own)
            first = size - -(-percent * size // 100) + 1
            line, df = ordered(own, grams, times)
            sent = np.flatnonzero(df[:first] != 1)
            if not len(sent):
                continue
            columns["h"].append(line[sent].view(np.int64))
            columns["pos"].append(sent)
            columns["df"].append(df[sent])
            for c, value in (("node", name), ("n", size), ("own", int((df == 1).sum()))):
                columns[c].append(np.full(len(sent), value, np.int64))
            kept.append((name, size, signature(own), own.tobytes()))
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        m = len(kept)
        rows = [pa.array(cat(columns[c]).astype(PREFIX.field(c).type.to_pandas_dtype())) for c in columns]
        rows += [pa.nulls(len(rows[0]), PREFIX.field(c).type) for c in ("signature", "members")]
        whole = {
            "node": [x[0] for x in kept],
            "n": [x[1] for x in kept],
            "signature": [x[2] for x in kept],
            "members": [x[3] for x in kept],
        }
        sets = [pa.array(whole[f.name], f.type) if f.name in whole else pa.nulls(m, f.type) for f in PREFIX]
        return pa.concat_tables([pa.table(rows, schema=PREFIX), pa.table(sets, schema=PREFIX)])

    return run


def overlap(nx, ny, percent: int):
    """The least overlap with which sets of nx and ny members link."""
    return F.floor(((nx + ny) * percent + (100 + percent - 1)) / F.lit(100 + percent))


def most_partner(percent: int):
    """The largest partner with which a row may link: its rest from the n-gram on must hold the whole overlap."""
    return F.floor((F.col("n") - F.col("pos")).cast("long") * (100 + percent) / F.lit(percent)) - F.col("n")


def may_link(x: str, y: str):
    """Length and positional filter for two prefix rows of one n-gram. A partner within `most` is within the length bound."""
    c = lambda side, name: F.col(f"{side}.{name}")
    return (c(x, "n") <= c(y, "most")) & (c(y, "n") <= c(x, "most"))


def near_enough(x: str, y: str, percent: int):
    """Suffix filter for two nodes."""
    nx, ny = F.col(f"{x}.n").cast("long"), F.col(f"{y}.n").cast("long")
    apart = sum(
        (F.bit_count(F.col(f"{x}.signature")[i].bitwiseXOR(F.col(f"{y}.signature")[i])) for i in range(BITS // 64)),
        F.lit(0),
    )
    return apart <= nx + ny - 2 * overlap(nx, ny, percent)


def verify(percent: int):
    def run(key, tbl):
        sets, hubs = {}, {}
        for x, share, node, members in zip(*(tbl.column(c).to_pylist() for c in ("x", "share", "node", "members"))):
            sets.setdefault((x, share), []).append((node, np.frombuffer(members, np.uint64)))
            if node == x:
                hubs[x, share] = sets[x, share][-1][1]
        found = []
        for (x, share), own in sets.items():
            hub = hubs[x, share]
            for node, members in own:
                both = int((hub[np.minimum(np.searchsorted(hub, members), len(hub) - 1)] == members).sum())
                if node != x and 100 * both >= percent * (len(hub) + len(members) - both):
                    found.append((x, node))
        return pa.table(
            {"x": pa.array([f[0] for f in found], pa.int64()), "y": pa.array([f[1] for f in found], pa.int64())}
        )

    return run


def linked(pairs: DataFrame, sets: DataFrame, percent: int, parts: int) -> DataFrame:
    """Those of pairs (x: hub, y) that link. A hub with many partners is split over several groups of rows."""
    pairs = C.materialise(pairs, "pairs", narrow=True)
    shares = pairs.groupBy("x").agg(F.ceil(F.count("*") / HUB_SHARE).cast("int").alias("shares"))
    dealt = pairs.join(shares, "x").select(
        "x", F.pmod(F.xxhash64("y"), F.col("shares")).cast("int").alias("share"), F.col("y").alias("node")
    )
    hubs = shares.select(
        "x", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("x").alias("node")
    )
    wanted = C.materialise(dealt.unionByName(hubs), "wanted", narrow=True)
    whole = wanted.join(sets.select("node", "members"), "node").withColumn(
        "g", F.pmod(F.xxhash64("x", "share"), F.lit(parts * 4))
    )
    links = C.materialise(
        whole.groupBy("g").applyInArrow(C.lean_group(verify(percent)), "x long, y long"), "links", narrow=True
    )
    C.discard(pairs, wanted)
    return links


def similar_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80
) -> DataFrame:
    """A row per row of df: doc_id, n_shingles, component_id.

    Words are lower-cased (A-Z only). A set holds the distinct k-word shingles of the whole text; a text of fewer words
    is one shingle. Sets link when 100 |both| >= percent |either|; component_id is the smallest id reachable.
    Null text or no words: n_shingles 0, linked with nothing, component_id the own id. Null id: takes part in linking;
    its component_id is the least id of its component, null if there is none. Repeated rows: one row each, linked.
    Very long texts are hashed whole, in running sums over their bytes. Empty table: no rows. Other columns, under any
    names, are not read.
    """
    found = grouped(df, id_col, text_col, k, percent)
    return found.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def row_key(id_col: str, text_col: str):
    """Names the rows that have one id and one text."""
    return F.xxhash64(F.col(id_col).isNull(), id_col, text_col)


def dealt(rows: DataFrame) -> DataFrame:
    """rows with `salt`: an n-gram of many documents is split over as many groups of rows as its frequency asks for."""
    return rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.floor(F.col("df") / HOT) + 1))


def each_gram(rows: DataFrame, *found) -> DataFrame:
    """Aggregates of every n-gram's rows (partial before the shuffle), a copy for each of its groups of rows."""
    every = rows.groupBy("h").agg(F.first("df").alias("df"), *found)
    return every.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("df") / HOT)))).drop("df")


def starred(rows: DataFrame) -> DataFrame:
    """(y, x, count): every node y of an n-gram with its hub x, the node with fewest n-grams of its own, where they may link."""
    hubs = each_gram(rows, F.min(F.struct("own", "n", "node", "most")).alias("s"))
    both = dealt(rows).join(hubs, ["h", "salt"]).filter("node <> s.node").select(
        F.struct("n", "node", "most").alias("r"), "s"
    )
    return both.filter(may_link("r", "s")).groupBy(F.col("r.node").alias("y"), F.col("s.node").alias("x")).count()


def climbed(parents: DataFrame) -> DataFrame:
    """(node, label) with the label's label in place of the label, CLIMBS times over: paths shorten to their roots.

    parents is a forest, since a parent comes before its child in one order. Where a path is longer still, its nodes have
    several labels, which are merely more components than there are: later passes check more, and lose nothing.
    """
    up = C.materialise(parents, "parents", narrow=True)
    for _ in range(CLIMBS):
        higher = up.toDF("label", "higher")
        next_ = C.spread_join(up, higher, "label", by="node", how="left").select(
            "node", F.coalesce("higher", "label").alias("label")
        )
        next_ = C.materialise(next_, "parents", narrow=True)  # each round names the table three times: plans would grow as 3 to the rounds
        C.discard(up)
        up = next_
    return up


def split_grams(named: DataFrame) -> DataFrame:
    """Rows of n-grams that several components have."""
    ends = each_gram(named, F.min("label").alias("a"), F.max("label").alias("z"))
    return dealt(named).join(ends.filter("a <> z").select("h", "salt"), ["h", "salt"]).drop("salt")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with their component, of n-grams that several components have."""
    return split_grams(rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))


def undecided(rows: DataFrame) -> DataFrame:
    """(x, y): each pair of different components that may link at a shared n-gram, once.

    A row x asks for partners y with n_x <= n_y <= most_x, in cells of like sizes; y answers where n_x <= most_y. Rows
    that nobody in their cell can ask for go before rows meet, so in a large group only pairs that may link are compared.
    """
    cell = lambda c: F.floor(F.ln(c.cast("double")) * CELLS).cast("int")
    cells = F.explode(F.sequence(cell(F.col("n")), cell(F.col("most"))))
    asking = rows.filter("most >= n").withColumn("cell", cells).select("h", "cell", "node", "n", "most", "label", "df")
    homes = dealt(rows).withColumn("cell", cell(F.col("n")))
    bounds = F.min("n").alias("low"), F.max("most").alias("high"), F.min("label").alias("a"), F.max("label").alias("z")
    asked = asking.groupBy("h", "cell").agg(F.first("df").alias("df"), *bounds)
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("df") / HOT))).alias("salt")
    asked = asked.select("h", "cell", "low", "high", "a", "z", salts)
    heard = homes.join(asked, ["h", "cell", "salt"]).filter(
        "low <= most and n <= high and not (a = label and z = label)"
    )
    heard = heard.select("h", "cell", "salt", F.struct("node", "n", "most", "label").alias("y"))
    asking = asking.select("h", "cell", F.struct("node", "n", "most", "label").alias("x"), salts)
    once = (F.col("x.n") < F.col("y.n")) | (F.col("x.n") == F.col("y.n")) & (F.col("x.node") < F.col("y.node"))
    pairs = asking.join(heard, ["h", "cell", "salt"]).filter(
        once & (F.col("x.label") != F.col("y.label")) & may_link("x", "y")
    )
    return pairs.select(F.least("x.node", "y.node").alias("x"), F.greatest("x.node", "y.node").alias("y")).distinct()


def grouped(df: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """A row per row of df: key, doc_id, node, n; where n > 0 also label (the component) and component_id (its least id, or null)."""
    n = C.bucket_count(df)
    parts, spark = max(8, n // 2), df.sparkSession
    text = F.col(text_col).alias("text")
    plain = df.select(row_key(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("doc_id"), text)
    known = C.small_batches(plain).mapInArrow(C.lean_batches(describe(k)), "key long, doc_id long, node long, n long")
    known = C.materialise(known, "nodes")
    nodes = C.small_batches(df.select(text)).mapInArrow(C.lean_batches(nodes_of(k)), "node long, text string")
    nodes = nodes.withColumn(
        "b", F.pmod("node", F.lit(n)).cast("int")
    ).repartition(C.partitions(spark), "b").dropDuplicates(["b", "node"])
    counts = nodes.groupBy("b").applyInArrow(C.lean_group(census(k, parts)), "p int, b int, grams binary, times binary")
    answer = counts.groupBy("p").applyInArrow(C.lean_group(tally), "b int, grams binary, times binary")
    kind = "h long, node long, n int, pos int, own int, df long, signature array<bigint>, members binary"
    sent = nodes.groupBy("b").cogroup(answer.groupBy("b")).applyInArrow(C.lean_pair(prefixes(k, percent)), kind)
    sent = C.materialise(sent, "prefixes")
    rows = sent.filter("h is not null").select("h", "node", "n", "own", "df", most_partner(percent).alias("most"))
    sets = sent.filter("members is not null").select("node", "n", "signature", "members")

    side = lambda node: sets.select(F.col("node").alias(node), F.struct("n", "signature").alias(f"of_{node}"))

    def checked(pairs: DataFrame) -> DataFrame:
        near = pairs.join(side("x"), "x").join(side("y"), "y").filter(near_enough("of_x", "of_y", percent))
        return linked(near.select("x", "y"), sets, percent, parts)

    best = starred(rows).groupBy("y").agg(
        F.max(F.struct("count", "x")).alias("best")
    ).select(F.col("best.x").alias("x"), "y")
    links = [checked(best)]
    labels = climbed(links[0].select(F.col("y").alias("node"), F.col("x").alias("label")))
    mixed = C.materialise(labelled(rows, labels), "mixed", narrow=True)
    one = mixed.groupBy("h", "label").agg(
        F.min(F.struct("own", "n", "node", "most", "df")).alias("r")
    ).select("h", "r.*", "label")
    of = one.select("node", "label").distinct()
    links.append(checked(starred(one).select("x", "y")))
    # a component joins the least of those that it is linked with
    hooks = links[1].join(of.toDF("x", "a"), "x").join(of.toDF("y", "b"), "y").filter("a <> b")
    hooks = hooks.groupBy(F.greatest("a", "b").alias("node")).agg(F.min(F.least("a", "b")).alias("label"))
    higher = climbed(hooks).toDF("label", "top")
    again = C.spread_join(
        mixed, higher, "label", by="node", how="left"
    ).withColumn("label", F.coalesce("top", "label")).drop("top")
    again = C.materialise(again, "again", narrow=True)
    left = C.materialise(split_grams(again), "left", narrow=True)
    links.append(checked(undecided(left)))
    everything = links[0].unionByName(links[1]).unionByName(links[2])
    labels_ = C.materialise(components(everything, "x", "y"), "labels", narrow=True)
    C.discard(sent, mixed, labels, higher, again, left, *links)
    labels = labels_

    least = known.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("low"))
    least = C.materialise(
        least.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "least", narrow=True
    )
    whole = least.groupBy("label").agg(F.min("low").alias("component_id"))
    named = C.spread_join(least, whole, "label", by="node").select("node", "label", "component_id")
    named = named.unionByName(spark.createDataFrame([(-1, None, None)], "node long, label long, component_id long"))  # no words
    return C.spread_join(known, named, "node", by="key").select("key", "doc_id", "node", "n", "label", "component_id")


def one_of_each(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80
) -> DataFrame:
    """df without near copies: of each group one row stays, that with the smallest id.

    Null ids come last, so a group keeps one of them only if it has no other. Rows that repeat an id stand for
    themselves: they go only if their own sets are linked with those of a row that stays. Of rows of a group with equal
    ids the least key stays, of rows with equal texts too the least by a hash of all columns. Rows without words (null or
    empty text) stay. Very long texts are compared whole. Empty table: no rows. Columns may have any names; all stay.
    """
    found = grouped(df, id_col, text_col, k, percent).filter("n > 0")
    first = found.groupBy("label").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("first")
    )
    stay = first.select(F.col("first.key").alias("__key"))
    words = F.regexp_like(C.null_safe_text(F.col(text_col)), F.lit(C.WORD))
    columns = [F.col(f"`{c}`") for c in df.columns]
    # the row travels as one struct, so its columns may have any names
    rows = df.filter(words).select(
        F.struct(*columns).alias("__row"),
        row_key(id_col, text_col).alias("__key"),
        F.xxhash64(*columns).alias("__order"),
    )
    rows = rows.join(stay, "__key", "left_semi")
    once = rows.withColumn(
        "__place", F.row_number().over(Window.partitionBy("__key").orderBy("__order"))
    ).filter("__place = 1")
    once = once.select(*[F.col(f"__row.`{c}`").alias(c) for c in df.columns])
    return once.unionByName(df.filter(~words))
