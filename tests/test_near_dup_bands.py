"""near_dup_removed makes the reference's 128 minima in 16 bands of 8: pairs that meet in a late band only go too."""

import hashlib
import random
import re

from kiln.plans.queries import QUERIES


def sequential_scan(docs: dict[int, str], hashes: int, count: int) -> set[int]:
    sets, buckets, gone = {}, {}, set()
    for k in sorted(docs):
        x = re.sub(r"\s+", " ", docs[k].lower().strip())
        sets[k] = {x[i : i + 3] for i in range(len(x) - 2)}
        sig = [min(hashlib.md5(f"{i}_{g}".encode()).hexdigest() for g in sets[k]) for i in range(hashes)]
        for b in range(count):
            buckets.setdefault((b, tuple(sig[b * 8 : b * 8 + 8])), []).append(k)
    for (b, _), own in sorted(buckets.items(), key=lambda e: (e[1][0], e[0][0])):
        for i, x in enumerate(own):
            for y in own[i + 1 :]:
                if x not in gone and y not in gone and len(sets[x] & sets[y]) / len(sets[x] | sets[y]) >= 0.7:
                    gone.add(y)
    return gone


def test_pairs_of_late_bands_are_removed(spark, tmp_path):
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(6))
    docs = {}
    for k in range(0, 60, 2):  # a text and a copy with one to four of its thirty words changed
        own = [word() for _ in range(30)]
        docs[k] = " ".join(own)
        for at in draw.sample(range(30), 1 + k // 2 % 4):
            own[at] = word()
        docs[k + 1] = " ".join(own)
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    gone = sequential_scan(docs, 128, 16)
    assert sequential_scan(docs, 32, 4) < gone
    assert {r.doc_id for r in QUERIES["near_dup_removed"](spark, str(tmp_path)).collect()} == set(docs) - gone
