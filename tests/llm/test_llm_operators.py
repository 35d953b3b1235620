"""Each operator against brute force, and its defined results for nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import json
import random
import re
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kiln.llm import additive_ann, bpe, common, components, jaccard_join, license_scan, mixing, mpeg_audio, pu_quality, queries, sharding, substring_dedup, warc

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, shard int, words string, b int, node long, label long"


def sentence(rnd, n):
    return " ".join(f"w{rnd.randrange(5000)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(1)
    base = sentence(rnd, 60)
    own = [
        (1, None),
        (2, ""),
        (3, " \t\n "),
        (4, "one"),
        (5, "one two"),
        (6, "ONE two"),
        (7, base),
        (8, base),
        (9, base.upper()),
        (10, base + " tail"),
        (11, sentence(rnd, 30) + " " + base[:200]),
        (12, sentence(rnd, 40_000)),
        (None, base),
        (13, "a " * 400),
        (14, "a " * 400 + "b"),
        (12, "repeated id"),
        (5, "one two"),
    ]
    for i in range(20, 60):
        words = base.split()
        for _ in range(rnd.randrange(4)):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(99)}"
        own.append((i, " ".join(words) if i % 3 else sentence(rnd, 50)))
    return own


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(
        [(i, t, "en", None if n % 7 == 0 else f"s{n % 3}", None, 1, 2, "x", 3, 4, 5) for n, (i, t) in enumerate(texts)],
        DOCS,
    )


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_bpe_equals_library(spark, docs, texts, nothing):
    t = Tokenizer.from_file(PATH)
    got = sorted(
        ((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, PATH).collect())
    )
    want = []
    for i, x in texts:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append(
            (
                i or -1,
                len(ids),
                hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest(),
            )
        )
    assert got == sorted(want)
    assert bpe.round_trip(nothing, PATH).count() == 0
    one = spark.createDataFrame([(1, "hello<|endoftext|> world"), (2, "")], "doc_id long, text string")
    assert {
        r.doc_id: r.a for r in bpe.encode(one, PATH).select("doc_id", bpe.id_array().alias("a")).collect()
    } == {1: t.encode("hello<|endoftext|> world").ids, 2: []}


def test_bpe_odd_texts():
    t, v, rnd = Tokenizer.from_file(PATH), bpe.Vocabulary(PATH), random.Random(2)
    odd = ["a<|endoftext|>b", "x" * 50_000, "  \n\n x\r\n ", "\x00�", "don't we'LL", "ab" * 3000]
    odd += [
        "".join(
            chr(rnd.choice([rnd.randrange(1, 0x250), rnd.randrange(0x3000, 0x9000), rnd.randrange(0x1F600, 0x1F640)]))
            for _ in range(80)
        )
        for _ in range(200)
    ]
    ids = v.encode(odd)
    assert [list(bpe.numbers(i)) for i in ids] == [e.ids for e in t.encode_batch(odd, add_special_tokens=False)]
    assert v.decode(ids) == odd and v.decode([None, bpe.little_endian([v.id_of[b"\xe4"]])]) == ["", "�"]


@given(st.lists(st.text(st.sampled_from("ab'stré 5.!\n\r\t\v\x1c\x1f\x85\xa0\u2003\u3000\u200b中😀"), max_size=40), max_size=6))
@settings(max_examples=300, deadline=None)
def test_bpe_of_any_white_space(texts):
    got = bpe.vocabulary(PATH).encode(texts)
    want = LIBRARY.encode_batch(texts, add_special_tokens=False)
    assert [list(bpe.numbers(i)) for i in got] == [e.ids for e in want]


def test_warc_round_trip(spark):
    big = "y" * 1500
    rows = [
        (1, "u", big),
        (2, "u", big),
        (3, None, big),
        (4, "u", "small"),
        (5, "u", "small"),
        (6, "u", None),
        (7, "a b", "é" * 900),
        (8, "u", "é" * 900),
        (None, "u", big),
        (3, "again", big),
    ]
    rows += [(i, "u", "copy" * 400) for i in range(100, 400)]
    bundles = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = warc.read(bundles).collect()
    assert len(got) == len(rows)
    by = {(r.page_id, r.url): r for r in got}
    assert by[1, "u"].record_type == "revisit" and by[1, "u"].refers_to == 3 and by[1, "u"].payload_bytes == 1500
    assert by[3, ""].record_type == by[3, "again"].record_type == "response" and by[None, "u"].refers_to == 3
    assert by[
        4, "u"
    ].record_type == by[5, "u"].record_type == by[6, "u"].record_type == "response" and by[6, "u"].payload_bytes == 0
    assert by[7, "a%20b"].refers_to == 8 and by[7, "a%20b"].payload_digest == hashlib.sha1(
        ("é" * 900).encode()
    ).hexdigest()
    assert sum(r.record_type == "response" for r in got if (r.page_id or 0) >= 100) == 1
    assert warc.contradictions(warc.read(bundles)).count() == 0
    wrong = warc.read(bundles).withColumn(
        "payload_digest", F.when(F.col("page_id") == 1, "0").otherwise(F.col("payload_digest"))
    )
    assert [r.page_id for r in warc.contradictions(wrong).collect()] == [1]
    found = warc.fetch(bundles, spark.createDataFrame([(4,), (399,), (999,), (None,)], "page_id long")).collect()
    assert sorted((r.page_id, bytes(r.payload)[:4]) for r in found) == [(4, b"smal"), (399, b"copy")]
    assert warc.read(warc.write(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_bundle_frames_are_independent():
    b = warc.Bundle()
    for i in range(50):
        b.add(
            i,
            warc.record(
                i, "u", bytes([65 + i % 20]) * 20_000, hashlib.sha1(bytes([65 + i % 20]) * 20_000).hexdigest(), None
            ),
        )
    content = b.content()
    table = warc.seek_table(content)
    assert len(table) > 2
    for r in b.index[::7]:
        raw = warc.read_frame(content, table[r["frame"]])[r["at"] : r["at"] + r["length"]]
        assert warc.parse(raw)["page_id"] == r["page_id"]
    with pytest.raises(ValueError):
        warc.seek_table(b"0" * 40)


def test_sharding(docs, texts, nothing):
    got = sharding.shard(docs).collect()
    assert len(got) == len(texts) and sharding.shard(nothing).count() == 0
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted(
        (i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts
    )
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def shards_by_hand(texts, shards=16, parts=sharding.PARTS):
    """(doc_id, size, text_crc32, shard, slot) by one walk over all rows in the global order."""
    rows = []
    for i, t in texts:
        raw = (t or "").encode()
        crc = zlib.crc32(raw)
        seed = 42 if i is None else xxhash.xxh64_intdigest(struct.pack("<q", i), 42)
        part = (xxhash.xxh64_intdigest(struct.pack("<q", crc), seed) + (1 << 63)) % (1 << 64) - (1 << 63)
        rows.append((part % parts, i is not None, i or 0, crc, len(raw) + 1))
    total, at, slots, out = sum(r[4] for r in rows), 0, [0] * shards, []
    for _, known, i, crc, size in sorted(rows):
        shard = min(shards - 1, (2 * at + size) * shards // (2 * total))
        out.append((i if known else -1, size, crc, shard, slots[shard]))
        slots[shard] += 1
        at += size
    return sorted(out)


def test_shards_equal_one_walk(spark, sf, docs, texts, tmp_path):
    tidy = lambda df: sorted(
        (r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32, r.shard, r.slot) for r in df.collect()
    )
    assert tidy(sharding.shard(docs)) == shards_by_hand(texts)
    whole = spark.read.parquet(f"{sf}/documents.parquet")
    found = queries.op3_sharding(spark, sf)
    assert tidy(found) == shards_by_hand([(r.doc_id, r.text) for r in whole.collect()])
    assert {(r.law, r.grown_shard) for r in found.collect()} == {("bytes", None)}
    whole.repartition(7).write.option("compression", "none").parquet(f"{tmp_path}/documents.parquet")
    assert tidy(queries.op3_sharding(spark, str(tmp_path))) == tidy(found)  # files and their sizes decide nothing


def test_shards_are_even(spark, sf):
    got = sharding.shard(spark.read.parquet(f"{sf}/documents.parquet")).groupBy("shard").agg(
        F.sum("size").alias("n"), F.max("size").alias("m")
    ).collect()
    assert len(got) == 16 and max(r.n for r in got) - min(r.n for r in got) <= 2 * max(r.m for r in got)


def components_by_hand(texts, k=5):
    sets = []
    for _, t in texts:
        w = (t or "").encode().lower().split()
        sets.append(
            frozenset([tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else [])
        )
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(texts):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(
        ((d or -1), len(sets[i]), (least.get(find(i)) if sets[i] else d) or -1) for i, (d, _) in enumerate(texts)
    )


def test_jaccard_groups(docs, texts, nothing):
    got = jaccard_join.similar_groups(docs).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in got) == components_by_hand(texts)
    assert jaccard_join.similar_groups(nothing).count() == 0
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id = 7").count() == 1 and kept.filter(
        "doc_id in (8, 9)"
    ).count() == 0


def test_large_groups_of_near_copies(spark, monkeypatch):
    """3,000 near copies with one to nine changed words, others that share a passage only, and sets on the very edge."""
    rnd = random.Random(7)
    base, own = sentence(rnd, 120).split(), []
    for i in range(3000):
        words = list(base)
        for at in rnd.sample(range(120), rnd.choice([1, 1, 2, 2, 3, 9])):
            words[at] = f"n{rnd.randrange(40)}"
        own.append((i, " ".join(words)))
    own += [(3000 + i, " ".join(base[:40]) + " " + sentence(rnd, 80)) for i in range(300)]
    edge = sentence(rnd, 94).split()  # 90 shingles; 81 + 9 of 90 + 9 + ... : similarities at and just below 0.8
    own += [(4000 + n, " ".join(edge[: 94 - n])) for n in range(0, 40)]
    found = spark.createDataFrame(own, "doc_id long, text string").repartition(6)
    monkeypatch.setattr(jaccard_join, "HOT", 64)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(found).collect()}
    sets = {}
    for i, t in own:
        w = t.encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def linked(a, b):
        both = len(sets[a] & sets[b])
        return 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both)

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (i < 3000) == (j < 3000) and find(i) != find(j) and linked(i, j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert got == {i: (len(sets[i]), find(i)) for i in ids}
    assert len({find(i) for i in range(3000)}) > 50


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (1, 2)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 160)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_words_are_those_of_split():
    own = [
        "a b c",
        "",
        "  x\tyy\r\nzz ",
        None,
        "A é ü\x0bq",
        "z" * 70 + " end",
        "abc",
        "abc",
        " ".join(f"w{i % 9999}" for i in range(400_000)),
    ]
    words = common.Words(pa.array(own))
    flat = [w for t in own for w in common.words_of(t)]
    assert np.diff(words.ends).tolist() == [len(common.words_of(t)) for t in own]
    assert [words.raw[i:j].tobytes() for i, j in zip(words.first, words.last)] == flat
    names = dict(zip(flat, words.flat.tolist()))
    assert [names[w] for w in flat] == words.flat.tolist() and len(set(names.values())) == len(names)
    assert (common.Words(pa.array(["ABC Z" * 9]), True).flat == common.Words(pa.array(["abc z" * 9])).flat).all()
    assert (common.Words(pa.array(own)[2:7]).flat == words.flat[words.ends[2] : words.ends[7]]).all()
    assert not len(common.Words(pa.array([], pa.string())).flat)


def repeats_by_hand(texts, window=13):
    least, out = {}, []
    for i, t in texts:
        w = (t or "").encode().split()
        for k in range(len(w) - window + 1) if i is not None else ():
            g = tuple(w[k : k + window])
            least[g] = min(least.get(g, i), i)
    for i, t in texts:
        w = (t or "").encode().split()
        cut = [False] * len(w)
        for k in range(len(w) - window + 1) if i is not None else ():
            if least[tuple(w[k : k + window])] < i:
                cut[k : k + window] = [True] * window
        out.append(
            ((i or -1), len(w), sum(cut), hashlib.sha256(b" ".join(x for x, c in zip(w, cut) if not c)).hexdigest())
        )
    return sorted(out)


def test_substring_dedup(docs, texts, nothing):
    got = substring_dedup.remove_repeats(docs).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept_sha256) for r in got) == repeats_by_hand(texts)
    got = substring_dedup.remove_repeats(docs.repartition(3), heavy=1).collect()  # windows go by their whole prefix
    assert sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept_sha256) for r in got) == repeats_by_hand(texts)
    assert substring_dedup.remove_repeats(nothing).count() == 0
    kept = {
        r.doc_id: r
        for r in substring_dedup.remove_repeats(docs, keep_text=True).filter("doc_id in (1, 4, 8)").collect()
    }
    assert kept[1].kept_text is None and kept[4].kept_text == "one" and kept[8].kept_text == "" and kept[4].rest.shard == 2
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(docs, window=5)


def test_repeated_passages(docs, texts, nothing):
    where, want = {}, []
    for i, t in texts:
        w = (t or "").split()
        for k in range(len(w) - 12) if i is not None else ():
            where.setdefault(tuple(w[k : k + 13]), set()).add(i)
    for i, t in texts:
        w = (t or "").split()
        hits = [k for k in range(len(w) - 12) if i is not None and len(where[tuple(w[k : k + 13])]) > 1]
        while hits:
            n = 1
            while n < len(hits) and hits[n] <= hits[n - 1] + 13:
                n += 1
            least = min(min(where[tuple(w[k : k + 13])]) for k in hits[:n])
            want.append((i, hits[0], hits[n - 1] + 13, least, w[hits[0] : hits[n - 1] + 13]))
            hits = hits[n:]
    got = substring_dedup.repeated_passages(docs).collect()
    assert sorted((r.doc_id, r.begin, r.stop, r.least_id, r.passage.split()) for r in got) == sorted(want) and want
    assert substring_dedup.repeated_passages(nothing).count() == 0


def test_deep_nodes_are_equal_prefixes():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 3, 4000).astype(np.uint64)
    starts = np.arange(4000 - 13)
    suffix, node = substring_dedup.deep_nodes(words, starts, 13)
    by = {}
    for k in starts.tolist():
        by.setdefault(tuple(words[k : k + 13].tolist()), []).append(k)
    want = [tuple(own) for own in by.values() if len(own) > 1]
    got = {}
    for k, n in zip(suffix.tolist(), node.tolist()):
        got.setdefault(n, []).append(k)
    assert sorted(tuple(sorted(own)) for own in got.values()) == sorted(want) and want
    order = [tuple(words[k : k + 8].tolist()) for k in suffix]
    assert order == sorted(order)


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[100:160] = x[100] + rng.normal(size=(60, 16)) * 0.001
    rows = [(i, [float(v) for v in x[i]]) for i in range(300)] + [
        (400, None),
        (420, [0.0] * 16),
        (440, [None] * 16),
        (460, [float("nan")] * 16),
        (480, [float("inf")] + [0.0] * 15),
        (None, [1.0] * 16),
    ]
    got = additive_ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=5).collect()
    exact = x.astype(np.float64) @ x.astype(np.float64).T
    hit = 0
    for q in range(0, 300, 20):
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        want = [i for i in np.lexsort((np.arange(300), -exact[q])) if i != q][:5]
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5] and all(abs(s - exact[q][v]) < 1e-9 for _, v, s in own)
        hit += len({v for _, v, _ in own} & set(want))
    assert hit >= 0.9 * 75 and {r.query_id for r in got} == set(range(0, 300, 20))
    few = spark.createDataFrame(
        [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>"
    )
    assert [(r.query_id, r.rank, r.vec_id) for r in additive_ann.nearest(few).collect()] == [(0, 1, 1), (0, 2, 2)]
    assert additive_ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_nearest_recall_where_codes_decide(spark):
    """20,000 rows in clusters of very different sizes, one of them near copies: recall of the top 20 against brute force."""
    rng = np.random.default_rng(3)
    centres, sizes = rng.normal(size=(200, 32)), rng.zipf(1.6, 20_000) % 200
    x = (centres[sizes] + rng.normal(size=(20_000, 32)) * np.where(sizes == 1, 1e-4, 0.7)[:, None]).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(20_000), "embedding": pa.array(list(x))}))
    got = additive_ann.nearest(df, every=200).toPandas()
    exact = x.astype(np.float64)
    hit = 0
    for q, own in got.groupby("query_id"):
        line = exact @ exact[q]
        line[q] = -np.inf
        assert sorted(own["rank"]) == list(range(1, 21)) and np.allclose(line[own.vec_id], own.score)
        hit += len(set(own.vec_id) & set(np.lexsort((np.arange(len(x)), -line))[:20]))
    assert got.query_id.nunique() == 100 and hit / 2000 >= 0.95


def test_nearest_of_equal_and_shorter_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(400)] + [(1000 + i, [0.5]) for i in range(3)] + [(20, [1.0, 2.0])] * 30
    got = additive_ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).toPandas()
    own = lambda q: list(got[got.query_id == q].sort_values("rank").vec_id)
    assert own(0) == [
        1, 2, 3, 4, 5
    ] and own(20) == [0, 1, 2, 3, 4] and own(380) == [0, 1, 2, 3, 4] and own(1000) == [0, 1, 2, 3, 4]


def test_media_round_trip(docs, texts, nothing):
    got = mpeg_audio.probe(mpeg_audio.to_media(docs)).collect()
    want = sorted((i or -1, mpeg_audio.padded((t or "").encode()), len((t or "").encode())) for i, t in texts)
    assert sorted((r.doc_id or -1, bytes(r.payload), r.n_bytes) for r in got) == want
    assert all(
        r.failed == 0 and r.skipped == 0 and r.seconds == r.frames * 1152 / 48000 and r.table_frames == r.frames
        for r in got
    )
    assert mpeg_audio.probe(mpeg_audio.to_media(nothing)).count() == 0


def test_media_damage():
    raw = mpeg_audio.padded(bytes(range(250)) * 20)
    media = mpeg_audio.pack(raw, 5000)
    good = mpeg_audio.parse(media)
    at = good["offsets"][3]
    noisy = mpeg_audio.parse(media[:at] + b"\xff\x00junk" + media[at:])
    assert noisy["payload"] == raw and noisy["skipped"] == 6 and noisy["frames"] == good["frames"]
    broken = bytearray(media)
    broken[at + 4] ^= 1
    hurt = mpeg_audio.parse(bytes(broken))
    assert hurt["failed"] == 1 and hurt["frames"] == good["frames"] and len(hurt["payload"]) == len(raw) - 576
    assert mpeg_audio.parse(b"")["frames"] == 0 and mpeg_audio.parse(b"\xff" * 50)["frames"] == 0
    assert mpeg_audio.parse(media[:-100])["frames"] == good["frames"] - 1


def frame(data: bytes, size: int = 417) -> bytes:
    """A frame of 128 kbit/s and 44,100 Hz, stereo, without checksum: 32 bytes of side information, then data."""
    return (b"\xff\xfb\x90\x00" + bytes(32) + data).ljust(size, b"\0")


def test_media_tables_and_tags():
    audio = frame(b"") * 10
    plain = mpeg_audio.parse(audio)
    assert (plain["frames"], plain["samples"], plain["hertz"], plain["intact"]) == (10, 11520, 44100, None)
    toc = bytes(range(100))
    only = mpeg_audio.parse(frame(b"Xing" + struct.pack(">I", 4) + toc) + audio)
    assert only["table"]["frames"] is None and only["table"]["toc"] == toc and only["frames"] == 10
    gap = struct.pack(">I", (576 << 12 | 1000))[1:]
    lame = mpeg_audio.parse(
        frame(b"Info" + struct.pack(">III", 3, 10, 5000) + b"LAME3.100".ljust(21, b"\0") + gap) + audio
    )
    assert lame["table"]["frames"] == 10 and lame["samples"] == 11520 - 1576 and lame["seconds"] == (
        11520 - 1576
    ) / 44100
    vbri = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 50, 5000, 10, 4, 1, 2, 3) + bytes(8)
    found = mpeg_audio.parse(frame(vbri) + audio)
    assert found["frames"] == 10 and found["table"]["frames"] == 10 and len(found["table"]["toc"]) == 8
    text = b"\x01" + "Größe".encode("utf-16")
    body = b"TIT2" + mpeg_audio.synchsafe(
        len(text)
    ) + b"\0\0" + text + b"TALB" + mpeg_audio.synchsafe(200) + b"\0\0" + b"\x03" + b"a" * 199
    new = mpeg_audio.parse(
        b"ID3\x04\0\0" + mpeg_audio.synchsafe(len(body)) + body + audio + b"TAG" + b"Old title".ljust(30, b"\0")
        + b"Artist".ljust(95, b"\0")
    )
    assert new["fields"] == {
        "TIT2": "Größe", "TALB": "a" * 199, "TPE1": "Artist"
    } and new["frames"] == 10 and new["skipped"] == 0
    extended = b"ID3\x04\0\x40" + mpeg_audio.synchsafe(len(body) + 6) + b"\0\0\0\x06\x01\0" + body
    assert mpeg_audio.parse(extended + audio)["fields"]["TIT2"] == "Größe"
    short = b"\xff\xfb\x10\x00" + bytes(32) + b"Xing"
    assert mpeg_audio.parse(short)["frames"] == 0  # the table that raised an error


@given(st.binary(max_size=400), st.integers(0, 60), st.integers(0, 400))
@settings(max_examples=300, deadline=None)
def test_media_of_any_bytes(noise, cut, at):
    media = mpeg_audio.pack(mpeg_audio.padded(b"text"), 4)
    for raw in (
        noise,
        noise + frame(b"Xing" + noise)[: 60 + cut],
        frame(noise, 417) + noise,
        media[:at] + noise + media[at + cut :],
        b"ID3" + noise,
    ):
        found = mpeg_audio.parse(raw)
        assert found["frames"] == len(found["offsets"]) and 0 <= found["skipped"] <= len(raw) and found["samples"] >= 0


def test_media_query_equals_formulas(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op6_mpeg_audio(spark, sf).collect()}
    assert len(got) == len(docs)
    for d in docs:
        raw = (d.text or "").encode()
        payload, r = raw + b"\xff" * (-len(raw) % 576 if raw else 576), got[d.doc_id]
        n = len(payload) // 576
        sizes = [768 if i % 8 == 7 else 672 for i in range(n)]
        head = 10 + 2 * 10 + len("\0n_bytes\0" + str(len(raw))) + len("\0sha256\0") + 64
        offsets = [head + 672 + sum(sizes[:i]) for i in range(n)]
        media = mpeg_audio.pack(payload, len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (
            len(raw), len(payload), hashlib.sha256(payload).hexdigest()
        )
        assert r.tail_crc32 == zlib.crc32(payload[-32:]) and r.seconds == n * 1152 / 48000 and r.intact
        assert (r.media_bytes, r.media_sha256) == (head + 672 + sum(sizes), hashlib.sha256(media).hexdigest())
        ends = [sum(sizes[: n * i // 100]) for i in range(100)]
        toc = bytes(min(255, 256 * e // sum(sizes)) for e in ends)
        assert r.feature == f"mp3 48000Hz frames={n} samples={n * 1152} skipped=0 failed=0 table={n}:{zlib.crc32(toc)} offsets={zlib.crc32(','.join(map(str, offsets)).encode())}"


def test_quality(spark, docs, nothing):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = pu_quality.score(
        spark.read.parquet(f"{d}/documents.parquet"), labels
    ).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in held.doc_id]).all()
    assert (held.predicted == held.quality).mean() > 0.95 and got.score.between(0, 1).all() and (
        (got.score >= 0.3) == (got.predicted == 1)
    ).all()
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {round(r.score, 6) for r in pu_quality.score(docs, none).collect()} == {0.5}
    assert pu_quality.score(nothing, none).count() == 0
    some = spark.createDataFrame([(7, 1), (7, None), (8, 0), (None, 1)], "doc_id long, quality int")
    assert pu_quality.score(
        docs, some
    ).count() == docs.count() and pu_quality.accepted(docs, some).columns == docs.columns


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_prior_of_a_known_mixture(share):
    """The prior is found from positives and unlabelled rows alone, and the model tells the kinds apart."""
    rng = np.random.default_rng(0)
    good = lambda n: rng.normal(0.3, 0.08, (n, pu_quality.WIDTH))
    bad = lambda n: rng.normal(0.4, 0.08, (n, pu_quality.WIDTH))
    n = int(8000 * share)
    model = pu_quality.fit(good(4000), np.r_[good(n), bad(8000 - n)])
    assert abs(model.prior - share) < 0.1
    assert (model.score(good(500)) >= 0.3).mean() > 0.9 and (model.score(bad(500)) < 0.3).mean() > 0.85


def test_risk_turns_at_zero():
    """With a prior that is too large the plain risk runs far below zero; the turned one stays near it."""
    rng = np.random.default_rng(1)
    x = np.c_[rng.normal(size=(600, 20)), np.ones(600)]
    p = np.c_[rng.normal(0.3, 1.0, size=(300, 20)), np.ones(300)]
    w = pu_quality.minimise(p, lambda v: pu_quality.losses(x, v), 0.8, np.zeros(21))
    rest = lambda v: np.logaddexp(0, x @ v).mean() - 0.8 * np.logaddexp(0, p @ v).mean()
    assert rest(w) > -0.3 and rest(w) > rest(3 * w)


def test_sums_over_a_table_equal_those_over_arrays(spark):
    rng = np.random.default_rng(2)
    words = ["good prose here.", "xx||<<>>{}", "Plain Text, with marks!", "1 2 3 4 5"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 30)))) for i in range(400)]
    labels = spark.createDataFrame([(i, int("||" not in t)) for i, t in rows if i % 2], "doc_id long, quality int")
    table = pu_quality.featured(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), labels)
    model, x = pu_quality.train(table), {r.doc_id: r for r in table.collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    assert {i for i, r in x.items() if r.trusted} == {i for i, t in rows if i % 2 and "||" not in t and not held(i)}
    rows = lambda keep: np.array([r.x for i, r in sorted(x.items()) if keep(i, r)])
    same = pu_quality.fit(rows(lambda i, r: r.trusted), rows(lambda i, r: not held(i)))
    assert abs(model.prior - same.prior) < 1e-6 and np.allclose(model.weights, same.weights, atol=1e-3)


def test_mixing(docs, nothing, texts):
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(texts) and (got.taken <= 2 * got["size"]).all() and mixing.mix(nothing).count() == 0
    assert sorted(map(str, got.itertuples(index=False))) == sorted(
        map(str, mixing.mix(docs).toPandas().itertuples(index=False))
    )
    per = got.groupby("source_size").agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((per.taken - per.target).abs() <= mixing.BLOCK).all()
    assert abs(per.target.sum() - 1.5 * got["size"].sum()) < 1e-6
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and mixing.mixed_documents(docs, shard="to").columns == [*docs.columns, "to"]
    assert out.select(F.sum(mixing.word_count(F.col("text")))).first()[0] == got.taken.sum()


def test_permutations_take_each_block_once(spark):
    rows = [
        (0, "a", 5000, 1.0, 5, 2, 0, 10, 1),
        (1, "b", 1, 1.0, 1, 1, 0, 1, 1),
        (2, "c", 10, 1.0, 7, 0, 3000, 3, 1),
        (3, "d", 9, 1.0, 2999, 1, 0, 2999, 1),
    ]
    src = spark.createDataFrame(
        rows,
        "rank long, source string, source_size long, target double, blocks long, passes long, rest long, slots long, parts long",
    )
    got = mixing.slots(src).toPandas()
    for (_, p), own in got[got["rank"] == 0].groupby(["rank", "pass"]):
        assert sorted(own.block) == [0, 1, 2, 3, 4]
    assert got[got["rank"] == 2]["take"].sum() == 3000 and got[got["rank"] == 2].block.nunique() == 3
    wide = got[got["rank"] == 3].sort_values("slot")
    assert sorted(wide.block) == list(range(2999)) and abs(np.corrcoef(wide.slot, wide.block)[0, 1]) < 0.1


def test_shard_counts_are_multinomial(spark):
    src = spark.createDataFrame([(r, 64_000) for r in range(4)], "rank long, slots long")
    got = mixing.shard_counts(src).toPandas()
    assert (got.groupby("rank").n.sum() == 64_000).all() and got.groupby("rank").shard.nunique().eq(64).all()
    for _, own in got.groupby("rank"):
        own = own.sort_values("shard")
        assert list(own["first"]) == [0, *own.n.cumsum()[:-1]]
        assert 25 < ((own.n - 1000) ** 2 / 1000).sum() < 120  # chi-square of 63 degrees of freedom


def test_license_query_equals_walk(spark, sf, tmp_path):
    """Every column of the query against word-by-word phrases and notices searched without seeds."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60)  # a small fixture
    whole = {r.doc_id: r.text for r in docs.collect()}
    rnd, notices = random.Random(4), license_scan.notices()
    for i in range(120):  # notices with edits, whole and joined to other words
        phrase = rnd.choice(notices)[0]
        for _ in range(rnd.randrange(5)):
            at = rnd.randrange(len(phrase))
            phrase = phrase[:at] + rnd.choice(["", "x", phrase[at] + "y"]) + phrase[at + 1 :]
        whole[
            10_000_000 + i
        ] = f"{sentence(rnd, 5)} {phrase.title()}, {sentence(rnd, 4)} {rnd.choice(['MIT-License', 'cc  by', ''])}"
    spark.createDataFrame(
        list(whole.items()), "doc_id long, text string"
    ).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op10_license_scan(spark, str(tmp_path)).collect()}
    assert set(got) == set(whole)
    for i, text in whole.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        places = [(k, label) for phrase, label in license_scan.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        line, near, best = (" " + " ".join(words) + " ").encode(), set(), 1.0 if places else 0.0
        for notice in license_scan.SEARCHES:
            for hit in notice.match.finditer(line):
                near.add(notice.label)
                best = max(best, 1 - sum(hit.fuzzy_counts) / len(notice.phrase))
        own, r = sorted({label for _, label in places}), got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(places), ",".join(own))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.labels == ",".join(sorted({*own, *near})) and abs(r.score - best) < 1e-9
        assert {s["label"] for s in json.loads(r.spans)} == near


def test_license_scan_of_a_very_long_text():
    found = license_scan.scan_text("cc by " * 300_000)
    assert found["n_base"] == 300_000 and found["last_word"] == 599_998


def test_license_scan(spark, docs, texts, nothing):
    rows = [
        (1, "Under the GNU General-Public license, v3"),
        (2, "MIT  License and mit license"),
        (3, "CC BY-NC cc by cc by"),
        (4, "gnu genral publc license"),
        (5, "submit license"),
        (6, None),
        (7, "Apache License, Versoin 2"),
        (8, "nothing here"),
    ]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].base_labels == "gpl" and got[1].first_word == 2 and got[1].score == 1.0
    assert (got[2].n_base, got[2].first_word, got[2].last_word) == (2, 0, 3)
    assert got[3].n_base == 3 and got[3].base_labels == "cc-by" and (got[3].first_word, got[3].last_word) == (0, 5)
    assert got[4].n_base == 0 and got[4].labels == "gpl-like" and 0 < got[4].score < 1 and got[4].first_word is None
    assert got[5].labels == "" and got[6].n_words == 0 and got[6].labels == "" and got[8].score == 0
    assert got[7].base_labels == "apache" and "apache-like" in got[7].labels
    assert license_scan.scan(docs).count() == len(texts) and license_scan.scan(nothing).count() == 0
