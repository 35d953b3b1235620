"""Passages that repeat across documents, by prefix-partitioned suffix trees over words.

A suffix is a word position with `window` words or more behind it. Two suffixes share a passage when their paths in
the suffix tree meet at a node of depth `window` or deeper (an internal node: it has two leaves or more).

1. Census. Not every prefix is counted, only an anchor of each window: its least 6-word gram, by hash. Equal windows
   have equal anchors, and neighbouring windows mostly share one, so a run of windows is one entry. Anchors that one
   document alone has cannot lead to an internal node and go. For the others the census tells how many runs they have.
2. Partition. Prefixes have variable length: runs are dealt by their 6-word anchor; where an anchor has more than HEAVY
   runs, each of its windows is dealt by its own prefix of `window` words instead, of which a bucket sends one. So a
   group holds HEAVY runs at most, or what one passage has in different buckets.
3. Subtrees. A group's suffixes are sorted by their words, by doubling (2, 4, 8, `window` words); suffixes whose prefix
   of SPLIT words no other shares are leaves already. Neighbours with one prefix of `window` words lie below one deep
   internal node. Its least doc_id goes back to the buckets whose documents lie below it.
4. Removal. Each bucket looks up its windows and drops the words that they cover.

Each document's windows below deep internal nodes join where they overlap: these stretches are the passages that
repeated_passages() reports, as long as they go on. A passage longer than a window has a node for each of its windows;
the tree is not grown below depth `window`.

A bucket sends each distinct run once, with its least and largest doc_id: a group of copies, however large, costs a
bucket one entry. Documents are shuffled once; the three passes over them read the same exchange. Words are known
by 64-bit hashes, and so are the windows that go back; they are compared within one group or bucket, never across the
corpus.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common as C

ANCHOR, SPLIT = 6, 4
#: Runs of one anchor from which on its windows are dealt by longer prefixes.
HEAVY = 4096
NO_DOC = np.iinfo(np.int64).max


class Bucket:
    """Words, window hashes and anchor runs of the documents of one bucket."""

    def __init__(self, tbl: pa.Table, window: int):
        self.ids = tbl.column("doc_id").combine_chunks()
        self.id_of = self.ids.fill_null(NO_DOC).to_numpy(zero_copy_only=False)
        self.words = C.Words(tbl.column("text"))
        self.flat, self.ends = self.words.flat, self.words.ends
        start, doc = C.inside(self.ends, window)
        keep = self.id_of[doc] != NO_DOC  # a document without an id is neither source nor copy
        self.start, self.doc = start[keep], doc[keep]
        self.window = C.grams(self.flat, window)[self.start] if len(self.start) else np.zeros(0, np.uint64)

    def runs(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Anchor of every run of windows, and the runs' bounds among the windows."""
        if not len(self.start):
            return np.zeros(0, np.uint64), np.zeros(1, np.int64)
        least, span, width = C.grams(self.flat, ANCHOR), 1, window - ANCHOR + 1
        while span < width:  # sliding minimum over width grams, by doubling
            step = min(span, width - span)
            least = np.minimum(least[: len(least) - step], least[step:])
            span += step
        anchor = least[self.start]
        cut = (anchor[1:] != anchor[:-1]) | (self.doc[1:] != self.doc[:-1])
        at = np.r_[0, np.flatnonzero(cut) + 1, len(anchor)]
        return anchor[at[:-1]], at


    def distinct(self, anchor: np.ndarray, at: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the runs `keep` (their bounds are `at`) each distinct one, by its least document, and its largest document."""
        begin, end = at[:-1][keep], at[1:][keep]
        step = np.arange(len(self.window)) - np.repeat(at[:-1], np.diff(at))
        sums = np.r_[np.uint64(0), np.cumsum(C.finalise(self.window + step.astype(np.uint64) * C.MIX))]
        content = C.finalise(sums[end] - sums[begin] + (end - begin).astype(np.uint64) * C.MULTIPLIER)
        owner = self.id_of[self.doc[begin]]
        order = np.lexsort((owner, content))
        cut = C.split_runs(content[order])
        return keep[order[cut[:-1]]], owner[order[cut[1:] - 1]]


def member(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is in a sorted table, and where."""
    if not len(table):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values, at


def census(window: int, parts: int):
    """To the parts: a bucket's anchors, how many distinct runs each has, and whether two of its documents have it."""

    def run(key, tbl):
        bucket = Bucket(tbl, window)
        anchor, at = bucket.runs(window)
        first, last = bucket.distinct(anchor, at, np.arange(len(anchor)))
        order = np.argsort(anchor[first], kind="stable")
        first, last = first[order], last[order]
        least = bucket.id_of[bucket.doc[at[first]]] if len(first) else last
        cut = C.split_runs(anchor[first])
        if len(cut) < 2:
            return C.to_blobs(
                key[0].as_py(), np.zeros(0, np.int64), {"anchors": cut[:0], "runs": cut[:0], "both": cut[:0]}
            )
        both = np.minimum.reduceat(least, cut[:-1]) < np.maximum.reduceat(last, cut[:-1])
        anchors, runs = anchor[first][cut[:-1]], np.diff(cut)
        # most anchors have one run of one document: they come first and need no count
        many = both | (runs > 1)
        part = (anchors % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((many, part))
        anchors, runs, both, many, part = anchors[order], runs[order], both[order], many[order], part[order]
        cut, out = C.split_runs(part), []
        for i, j in zip(cut[:-1], cut[1:]):
            own = many[i:j]
            out.append(
                (
                    int(part[i]),
                    anchors[i:j].tobytes(),
                    runs[i:j][own].astype(np.uint32).tobytes(),
                    both[i:j][own].tobytes(),
                )
            )
        kinds = (("p", pa.int32()), ("anchors", pa.binary()), ("runs", pa.binary()), ("both", pa.binary()))
        columns = {name: pa.array([x[c] for x in out], t) for c, (name, t) in enumerate(kinds)}
        return pa.table(
            {"p": columns["p"], "b": pa.array([key[0].as_py()] * len(out), pa.int32())}
            | {c: columns[c] for c in ("anchors", "runs", "both")}
        )

    return run


def meet(most: int):
    """Of one part: to each bucket, those of its anchors that two documents have, those of more than `most` runs apart."""

    def run(key, tbl):
        blobs, owners = tbl.column("anchors").to_pylist(), tbl.column("b").to_pylist()
        values, runs, both = [np.frombuffer(x, np.uint64) for x in blobs], [], []
        for own, r, t in zip(values, tbl.column("runs").to_pylist(), tbl.column("both").to_pylist()):
            one = len(own) - len(t)
            runs += [np.ones(one, np.int64), np.frombuffer(r, np.uint32).astype(np.int64)]
            both += [np.zeros(one, bool), np.frombuffer(t, bool)]
        names, index, buckets = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
        total = np.bincount(index, weights=np.concatenate(runs), minlength=len(names))
        shared = (buckets > 1) | (np.bincount(index, weights=np.concatenate(both), minlength=len(names)) > 0)
        shared, heavy, out, at = shared[index], (total > most)[index], [], 0
        for b, v in zip(owners, values):
            own, much = shared[at : at + len(v)], heavy[at : at + len(v)]
            at += len(v)
            if own.any():
                out.append((b, v[own & ~much].tobytes(), v[own & much].tobytes()))
        kinds = (("b", pa.int32()), ("light", pa.binary()), ("heavy", pa.binary()))
        return pa.table({name: pa.array([x[c] for x in out], t) for c, (name, t) in enumerate(kinds)})

    return run


RUNS = pa.schema(
    [("p", pa.int32()), ("b", pa.int32()), ("runs", pa.binary()), ("sizes", pa.binary()), ("docs", pa.binary())]
)


def candidates(window: int, parts: int):
    """To the parts: each distinct run of words whose anchor two documents share, with its least and largest doc_id here.

    A run of a heavy anchor is sent as its single windows, each to the part of its whole prefix.
    """

    def run(key, left, right):
        if not left.num_rows:
            return RUNS.empty_table()
        bucket = Bucket(left, window)
        anchor, at = bucket.runs(window)
        light, heavy = (np.unique(C.from_blobs(right.column(c), np.uint64)) for c in ("light", "heavy"))
        first, last = bucket.distinct(anchor, at, np.flatnonzero(member(anchor, light)[0]))
        begin, end, part = at[:-1][first], at[1:][first], anchor[first]
        single = np.flatnonzero(np.repeat(member(anchor, heavy)[0], np.diff(at)))
        if len(single):
            each = np.arange(len(bucket.window) + 1)
            one, most = bucket.distinct(bucket.window, each, single)
            begin, end, part, last = np.r_[begin, one], np.r_[end, one + 1], np.r_[
                part, bucket.window[one]
            ], np.r_[last, most]
        if not len(begin):
            return RUNS.empty_table()
        owner = bucket.id_of[bucket.doc[begin]]
        part = (part % np.uint64(parts)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        begin, end, part, owner, last = begin[by], end[by], part[by], owner[by], last[by]
        out, pack = [], zstandard.ZstdCompressor(level=3)
        cut = C.split_runs(part)
        for i, j in zip(cut[:-1], cut[1:]):
            text = [bucket.words.text(bucket.start[begin[k]], bucket.start[end[k] - 1] + window) for k in range(i, j)]
            sizes = np.array([len(x) for x in text], np.int64)
            out.append(
                (
                    int(part[i]),
                    pack.compress(b"".join(text)),
                    sizes.tobytes(),
                    np.stack([owner[i:j], last[i:j]]).tobytes(),
                )
            )
        b = pa.array([key[0].as_py()] * len(out), pa.int32())
        p, runs, sizes, docs = (
            pa.array([x[c] for x in out], t) for c, t in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))
        )
        return pa.table([p, b, runs, sizes, docs], schema=RUNS)

    return run


def longer(ranks: np.ndarray, step: int) -> np.ndarray:
    """Ranks of the suffixes by `step` more words, from ranks by as many as they start apart: pairs sort as suffixes do."""
    pairs = ranks[: len(ranks) - step] * (int(ranks.max(initial=0)) + 1) + ranks[step:]
    return np.unique(pairs, return_inverse=True)[1]


def deep_nodes(words: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes (indices into starts) that lie below an internal node of depth `window`, in suffix order, and each one's
    node.

    Suffixes are sorted by prefixes that double in length, up to the longest power of two within `window`, and last by
    the two of these that overlap and cover it. On the way, at SPLIT words, the suffixes whose prefix no other shares are
    leaves already and go. Neighbours in the order with one prefix of `window` words are leaves of one internal node.
    """
    alive, ranks, depth = np.arange(len(starts)), np.unique(words, return_inverse=True)[1], 1
    while 2 * depth <= window:
        ranks, depth = longer(ranks, depth), 2 * depth
        if depth == SPLIT and len(alive):
            alive = alive[np.bincount(ranks[starts])[ranks[starts]] > 1]
    if not len(alive):
        return alive, alive
    at = starts[alive]
    order = np.lexsort((ranks[at + window - depth], ranks[at]))
    alive, first, second = alive[order], ranks[at][order], ranks[at + window - depth][order]
    new = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
    node = np.cumsum(new) - 1
    inner = np.bincount(node)[node] > 1
    return alive[inner], node[inner]


def subtrees(window: int, every: bool):
    """Nodes go back to the buckets with a document that is not the node's least one; with `every` to all below it."""

    def run(key, tbl):
        unpack, texts, sizes, owners, least, most = zstandard.ZstdDecompressor(), [], [], [], [], []
        for b, text, size, docs in zip(*(tbl.column(c).to_pylist() for c in ("b", "runs", "sizes", "docs"))):
            low, high = np.frombuffer(docs, np.int64).reshape(2, -1)
            texts.append(unpack.decompress(text))
            sizes.append(np.frombuffer(size, np.int64))
            owners.append(np.full(len(low), b, np.int32))
            least.append(low)
            most.append(high)
        bounds = np.r_[0, np.cumsum(np.concatenate(sizes))]
        runs = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(b"".join(texts))]
        )
        found = C.Words(runs)
        words, ends = found.flat, found.ends
        starts, run_of = C.inside(ends, window)
        owner, least, most = np.concatenate(owners)[run_of], np.concatenate(least)[run_of], np.concatenate(most)[run_of]
        digest = C.grams(words, window)[starts]
        suffix, node = deep_nodes(words, starts, window)
        # a run that two documents of one bucket share came once: its suffixes are leaves of two documents all the same
        order = np.argsort(node, kind="stable")
        at = C.split_runs(node[order])
        low, high = least.copy(), most.copy()
        if len(at) > 1:
            low[suffix[order]] = np.repeat(np.minimum.reduceat(least[suffix[order]], at[:-1]), np.diff(at))
            high[suffix[order]] = np.repeat(np.maximum.reduceat(most[suffix[order]], at[:-1]), np.diff(at))
        hit = np.flatnonzero(low < (high if every else most))
        order = hit[np.lexsort((digest[hit], owner[hit]))]
        new = np.r_[
            True, (digest[order][1:] != digest[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        ][: len(order)]
        order = order[new]
        cut = C.split_runs(owner[order])
        return pa.table(
            {
                "b": pa.array(owner[order][cut[:-1]], pa.int32()),
                "digests": pa.array([digest[order[i:j]].tobytes() for i, j in zip(cut[:-1], cut[1:])], pa.binary()),
                "least": pa.array([low[order[i:j]].tobytes() for i, j in zip(cut[:-1], cut[1:])], pa.binary()),
            }
        )

    return run


def looked_up(bucket: Bucket, right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Of a bucket's windows: whether two documents have it, and the least id of those."""
    digests, least = C.from_blobs(right.column("digests"), np.uint64), C.from_blobs(right.column("least"), np.int64)
    order = np.argsort(digests, kind="stable")
    digests, least = digests[order], least[order]
    found, at = member(bucket.window, digests)
    out = np.full(len(bucket.window), NO_DOC)
    out[found] = least[at[found]]
    return found, out


def covered(bucket: Bucket, windows: np.ndarray, window: int) -> np.ndarray:
    """Which words some of the windows cover."""
    edge = np.zeros(len(bucket.flat) + window + 1, np.int32)
    np.add.at(edge, bucket.start[windows], 1)
    np.add.at(edge, bucket.start[windows] + window, -1)
    return np.cumsum(edge)[: len(bucket.flat)] > 0


def stretches(window: int):
    def run(key, left, right):
        bucket = Bucket(left, window)
        found, least = looked_up(bucket, right)
        hit = np.flatnonzero(found)
        start, doc, least = bucket.start[hit], bucket.doc[hit], least[hit]
        new = np.r_[True, (start[1:] > start[:-1] + window) | (doc[1:] != doc[:-1])][: len(start)]
        at = np.flatnonzero(new)
        begin, end = start[at], np.r_[start[at[1:] - 1], start[-1:]] + window
        of = doc[at]
        sources = np.minimum.reduceat(least, at) if len(at) else least
        text = [bucket.words.text(i, j).decode() for i, j in zip(begin.tolist(), end.tolist())]
        columns = [bucket.id_of[of], begin - bucket.ends[of], end - bucket.ends[of], sources]
        return pa.table([*(pa.array(c, pa.int64()) for c in columns), pa.array(text, pa.string())], names=["doc_id", "begin", "stop", "least_id", "passage"])

    return run


def removal(window: int, keep_text: bool):
    def run(key, left, right):
        bucket = Bucket(left, window)
        found, least = looked_up(bucket, right)
        gone = found & (least < bucket.id_of[bucket.doc])
        hidden = covered(bucket, gone, window)
        cut = np.r_[0, np.cumsum(hidden)][bucket.ends]
        removed, shas, kept_texts, texts = np.diff(cut), [], [], left.column("text").to_pylist()
        for i, (text, n) in enumerate(zip(texts, removed.tolist())):
            own = C.words_of(text)
            if n:
                own = [w for w, gone in zip(own, hidden[bucket.ends[i] : bucket.ends[i + 1]].tolist()) if not gone]
            kept = b" ".join(own)
            shas.append(hashlib.sha256(kept).hexdigest())
            if keep_text:
                kept_texts.append(kept.decode() if n else text)
        n_words = pa.array(np.diff(bucket.ends), pa.int64())
        out = {
            "doc_id": bucket.ids,
            "n_words": n_words,
            "n_removed": pa.array(removed, pa.int64()),
            "kept_sha256": pa.array(shas, pa.string()),
        }
        if keep_text:
            out |= {"kept_text": pa.array(kept_texts, pa.string()), "rest": left.column("rest").combine_chunks()}
        return pa.table(out)

    return run


def dealt(df: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    if window < 2 * ANCHOR:
        raise ValueError(f"window must be {2 * ANCHOR} words or more")
    return C.bucketed(df, id_col, text_col, C.bucket_count(df))


def deep(docs: DataFrame, window: int, heavy: int, every: bool = False) -> DataFrame:
    """(b, digests, least): to each bucket its windows that lie below deep internal nodes, and the nodes' least ids."""
    parts = max(8, C.bucket_count(docs) // 4)
    anchors = docs.groupBy("b").applyInArrow(
        C.lean_group(census(window, parts)), "p int, b int, anchors binary, runs binary, both binary"
    )
    shared = anchors.groupBy("p").applyInArrow(C.lean_group(meet(heavy)), "b int, light binary, heavy binary")
    runs = docs.groupBy("b").cogroup(shared.groupBy("b")).applyInArrow(
        C.lean_pair(candidates(window, parts)), "p int, b int, runs binary, sizes binary, docs binary"
    )
    return runs.groupBy("p").applyInArrow(C.lean_group(subtrees(window, every)), "b int, digests binary, least binary")


def repeated_passages(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, heavy: int = HEAVY
) -> DataFrame:
    """doc_id, begin, stop, least_id, passage: the stretches of every document of which each window is in another too.

    begin and stop count words, stop is behind the last one; least_id: the least document that has one of the windows;
    passage: the text from the first word to the last. Null texts and ids, and documents of fewer words, have no rows.
    Rows that repeat an id do not make each other's passages repeat. Very long texts are read whole. Empty table: no rows. Other columns are not read.
    """
    docs = dealt(df.select(id_col, text_col), id_col, text_col, window)
    kind = "doc_id long, begin long, stop long, least_id long, passage string"
    nodes = deep(docs, window, heavy, every=True)
    return docs.groupBy("b").cogroup(nodes.groupBy("b")).applyInArrow(C.lean_pair(stretches(window)), kind)


def remove_repeats(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 13,
    keep_text: bool = False,
    heavy: int = HEAVY,
) -> DataFrame:
    """A row per row of df: doc_id, n_words, n_removed, kept_sha256; with keep_text also kept_text and rest (the other columns).

    A word is removed when a window of `window` words that covers it also starts in a document with a smaller id.
    kept_text: the text itself if nothing was removed, else the kept words joined by one space.
    Null text: no words, nothing removed (kept_text null). Null id: its words stay and remove none elsewhere. Rows that
    repeat an id do not remove each other's words. Fewer than `window` words: nothing removed. Very long texts are cut whole, none of
    their words is left out. Empty table: no rows.
    Other columns may have any names: they travel as one struct.
    """
    docs = dealt(df if keep_text else df.select(id_col, text_col), id_col, text_col, window)
    nodes = deep(docs, window, heavy)
    fields = [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("kept_sha256", T.StringType()),
    ]
    if keep_text:
        fields += [T.StructField("kept_text", T.StringType()), T.StructField("rest", docs.schema["rest"].dataType)]
    return docs.groupBy("b").cogroup(nodes.groupBy("b")).applyInArrow(
        C.lean_pair(removal(window, keep_text)), T.StructType(fields)
    )
