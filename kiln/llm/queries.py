"""The queries of this folder, each over its whole table, and the SQL that some of them equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    additive_ann,
    bpe,
    fill_in_middle,
    filter_audit,
    jaccard_join,
    license_scan,
    mixing,
    mpeg_audio,
    pu_quality,
    secret_scan,
    sharding,
    substring_dedup,
    warc,
)
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read(warc.write(table(spark, sf_dir, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(table(spark, sf_dir, "documents"))


def op5_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_ann.nearest(table(spark, sf_dir, "embeddings"))


def op6_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mpeg_audio.probe(mpeg_audio.to_media(table(spark, sf_dir, "documents")))
    offsets = F.crc32(F.array_join("offsets", ",").cast("binary"))
    feature = F.concat_ws(
        " ",
        F.lit("mp3"),
        F.format_string(
            "%dHz frames=%d samples=%d skipped=%d failed=%d table=%d:%d offsets=%d",
            "hertz",
            "frames",
            "samples",
            "skipped",
            "failed",
            "table_frames",
            F.crc32("toc"),
            offsets,
        ),
    )
    tail = F.expr("substring(payload, greatest(octet_length(payload) - 31, 1), 32)")
    return found.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
        "seconds",
        "intact",
    )


def op7_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).withColumn("spans", F.to_json("spans"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.transform(table(spark, sf_dir, "documents"), keep_text=False)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    return secret_scan.scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[secret_scan.count_of(spans, kind).alias(f"n_{kind}") for kind in secret_scan.BASE],
        F.sha2(secret_scan.listed(secret_scan.base_spans(spans)), 256).alias("base_sha256"),
        secret_scan.listed(spans).alias("spans"),
    )


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_bpe,
            op2_warc,
            op3_sharding,
            op4_jaccard_join,
            op5_additive_ann,
            op6_mpeg_audio,
            op7_pu_quality,
            op8_mixing,
            op9_substring_dedup,
            op10_license_scan,
            op11_fill_in_middle,
            op12_filter_audit,
            op13_secret_scan,
        )
    }


OP2 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS top, count(*) AS n FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT d.page_id, payload_bytes, d.payload_digest,
       CASE WHEN n > 1 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n > 1 AND page_id <> top THEN top END AS refers_to
FROM d LEFT JOIN m ON d.payload_digest = m.payload_digest AND d.payload_bytes >= 1000
"""

OP9 = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, s, array_to_string(w[s : s + 12], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d)),
f AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY gram) AS low FROM g),
c AS (SELECT DISTINCT doc_id, s + unnest(range(0, 13)) AS i FROM f WHERE low < doc_id),
x AS (SELECT doc_id, len(w) AS n_words, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS kept FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.i = x.i WHERE c.i IS NULL GROUP BY 1),
r AS (SELECT doc_id, count(*) AS n FROM c GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(r.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN r USING (doc_id)
"""

OP5 = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2])) AS score
      FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


OP11 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
r AS (SELECT doc_id, t, length(t)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
      ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
      CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
           WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, substring(t, 1, i) AS prefix, substring(t, i + 1, j - i) AS middle, substring(t, j + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

OP12 = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(l.toxic, 0) AS toxic, (len(w) < 200)::INT AS A,
      (100 * list_unique(w) < 50 * len(w))::INT AS B, (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t))::INT AS C,
      regexp_matches(t, '[#$%&*|]')::INT AS D, coalesce(w.doc_id > least, false)::INT AS E FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
g AS (SELECT part, [A, B, C, D, E] AS fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x)
      WHERE NOT contains(filter_order, x)),
s AS (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM o WHERE length(filter_order) = 5),
m AS (SELECT filter_order, step, position(filter_order[step] IN 'ABCDE') AS f,
      list_transform(range(1, step), lambda i: position(filter_order[i] IN 'ABCDE')) AS before FROM s),
x AS (SELECT part, filter_order, step, f, n, good, toxic, fails[f] = 1 AS bad, list_sum(fails) = 1 AS sole,
      len(list_filter(before, lambda i: fails[i] = 1)) > 0 AS gone FROM g, m),
r AS (SELECT part, filter_order, step, f, sum(CASE WHEN NOT gone AND NOT bad THEN n ELSE 0 END)::BIGINT AS kept,
      sum(CASE WHEN NOT gone AND bad THEN n ELSE 0 END)::BIGINT AS removed,
      sum(CASE WHEN gone AND bad THEN n ELSE 0 END)::BIGINT AS redundant,
      sum(CASE WHEN bad AND sole THEN n ELSE 0 END)::BIGINT AS unique_fails,
      sum(CASE WHEN NOT gone AND bad THEN n * good ELSE 0 END)::BIGINT AS good_lost,
      sum(CASE WHEN NOT gone AND bad THEN n * toxic ELSE 0 END)::BIGINT AS toxic_lost FROM x GROUP BY ALL)
SELECT * EXCLUDE (f), (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r
"""


def _draw(value: str, key: str) -> str:
    t = f"((({value})::BIGINT * 1103515245 + ({key})::BIGINT * 12345 + 99991) % 2147483647)"
    t = f"(({t} * {t} + ({key})) % 2147483629)"
    return f"(({t} * {t} + ({value})) % 2147483587 // 16)"


def _turn(x: str) -> str:
    """One turn of the permutation's rounds, as nested selects over wide, high and key."""
    sql, names = f"SELECT *, {x} // high AS l0, {x} % high AS r0 FROM walk WHERE steps = 0 OR x >= blocks", ("l0", "r0")
    for i in range(mixing.ROUNDS):
        left, right = names
        made = f"({left} + {_draw(right, f'key + {i}')}) % wide AS l{i + 1}" if i % 2 == 0 else f"({right} + {_draw(left, f'key + {i}')}) % high AS r{i + 1}"
        names = (f"l{i + 1}", right) if i % 2 == 0 else (left, f"r{i + 1}")
        sql = f"SELECT *, {made} FROM ({sql})"
    return f"SELECT rank, slot, blocks, wide, high, key, {names[0]} * high + {names[1]} AS x, steps + 1 AS steps FROM ({sql})"


def _op8() -> str:
    b = mixing.BLOCK
    key = lambda number: _draw(f"rank * 1009 + {number}", "7")
    return rf"""
WITH RECURSIVE r AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_rows, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM r GROUP BY source),
s1 AS (SELECT *, ([5, 2, 1])[rank % 3 + 1] AS weight, 2 * source_size AS most FROM s0),
s2 AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
       / sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
s3 AS (SELECT *, least(most::DOUBLE, max(level) OVER () * weight) AS target, (source_size + {b - 1}) // {b} AS blocks FROM s2),
s4 AS (SELECT *, floor(target + 0.5)::BIGINT AS words FROM s3),
s5 AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS passes FROM s4),
s6 AS (SELECT *, words - passes * source_size AS rest FROM s5),
s7 AS (SELECT *, passes * blocks + (rest + {b - 1}) // {b} AS slots, (n_rows + {mixing.PART_ROWS - 1}) // {mixing.PART_ROWS} AS parts FROM s6),
n AS (SELECT rank, unnest(range(0, slots::BIGINT)) AS number FROM s7 WHERE slots > 0),
c AS (SELECT rank, {_draw("number", key("0"))} % {mixing.SHARDS} AS shard, count(*) AS n FROM n GROUP BY 1, 2),
c1 AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY rank ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM c),
j AS (SELECT rank, shard, first + unnest(range(0, n)) AS slot FROM c1),
j1 AS (SELECT j.rank, shard, slot, blocks, passes, rest, slot // blocks AS pass, slot % blocks AS k FROM j JOIN s7 USING (rank)),
w0 AS (SELECT rank, slot, blocks::BIGINT AS blocks, k::BIGINT AS x, ceil(sqrt(blocks::DOUBLE))::BIGINT AS wide, ({key("pass + 1")})::BIGINT AS key FROM j1),
walk(rank, slot, blocks, wide, high, key, x, steps) AS (SELECT rank, slot, blocks, wide, (blocks + wide - 1) // wide, key, x, 0 FROM w0 UNION ALL {_turn("x")}),
j2 AS (SELECT j1.rank, shard, walk.x AS block, CASE WHEN pass < passes THEN {b} ELSE least({b}, rest - k * {b}) END AS take
       FROM j1 JOIN walk ON walk.rank = j1.rank AND walk.slot = j1.slot AND walk.steps > 0 AND walk.x < j1.blocks),
d0 AS (SELECT r.*, s7.rank, s7.source_size, s7.target, {_draw("coalesce(doc_id, size) % 2147483648", "s7.rank")} % parts AS part FROM r JOIN s7 ON r.source IS NOT DISTINCT FROM s7.source),
d AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY rank ORDER BY part, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d0),
p AS (SELECT rank, start, size, unnest(range((start // {b})::BIGINT, ((start + size - 1) // {b} + 1)::BIGINT)) AS block FROM d WHERE size > 0),
p1 AS (SELECT rank, start, block, greatest(start, block * {b}) - block * {b} AS low, least(start + size, (block + 1) * {b}) - greatest(start, block * {b}) AS length FROM p),
t0 AS (SELECT p1.rank, p1.start, shard, least(length, take - low) AS words FROM p1 JOIN j2 ON p1.rank = j2.rank AND p1.block = j2.block),
t AS (SELECT rank, start, sum(words) AS taken, array_to_string(list_sort(list(DISTINCT shard::INT)), ',') AS shards FROM t0 WHERE words > 0 GROUP BY 1, 2)
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN coalesce(taken, 0) ELSE 0 END::BIGINT AS taken, CASE WHEN size > 0 THEN coalesce(shards, '') ELSE '' END AS shards
FROM d LEFT JOIN t ON d.rank = t.rank AND d.start = t.start
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express in full. The others are tested against brute force."""
    return {
        "op2_warc": OP2,
        "op5_additive_ann": OP5,
        "op8_mixing": _op8(),
        "op9_substring_dedup": OP9,
        "op11_fill_in_middle": OP11,
        "op12_filter_audit": OP12,
    }
