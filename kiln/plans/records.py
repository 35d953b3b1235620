"""Queries of choices, look-ups, parsers, graders and packing, each with the SQL that it equals where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.functions import grading, text
from kiln.operators import chat, evaluation, packing, records, uncertainty
from kiln.plans.registry import query, r6, t, with_pos

SQL = {}


def equals(sql: str):
    def add(f):
        SQL[f.__name__] = sql
        return query(f)

    return add


@equals(
    "SELECT doc_id, CASE WHEN quality = 1 THEN lang ELSE 'fixed ' || source END AS answer, left(text, 200) AS head, coalesce(nullif(lang, 'en'), 'none') AS lang, 'later' AS note FROM documents LEFT JOIN labels USING (doc_id)"
)
def chosen_fields(s, d):
    rows = t(s, d, "documents").join(t(s, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    answer = records.chosen_answer(F.col("quality") == 1, F.concat(F.lit("fixed "), "source"), F.col("lang"))
    rows = rows.withColumn("answer", answer).withColumn("head", F.substring("text", 1, 200)).withColumn(
        "lang", F.nullif("lang", F.lit("en"))
    )
    rows = records.with_defaults(records.without(rows, "text", "n_chars"), {"lang": "none", "note": "later"})
    return records.selected(rows, "doc_id", "answer", "head", "lang", "note")


@equals(
    "SELECT event_id, coalesce(json_extract_string(CASE WHEN event_id % 3 > 0 THEN props END, '$.k'), event_type) AS kept FROM events"
)
def parse_fallback(s, d):
    parsed = F.from_json(F.when(F.col("event_id") % 3 > 0, F.col("props")), "k string")
    return t(s, d, "events").select("event_id", records.with_fallback(parsed, "k", F.col("event_type")).alias("kept"))


@equals(
    "SELECT doc_id, 'You teach. ' || CASE WHEN doc_id % 3 > 0 THEN 'Reference solution:' || chr(10) || source || chr(10) || chr(10) ELSE '' END || 'Answer: ' || lang AS prompt FROM documents"
)
def teacher_prompts(s, d):
    reference = F.when(F.col("doc_id") % 3 > 0, F.col("source")).otherwise("")
    return t(s, d, "documents").select(
        "doc_id",
        records.teacher_prompt(
            "You teach. {reference_section}Answer: {label}", F.col("lang"), reference
        ).alias("prompt"),
    )


@equals("SELECT doc_id, length(text) >= 20 AS long, doc_id % 10 <= 3 AND doc_id % 7 > 0 AS certain FROM documents")
def row_filters(s, d):
    se = F.when(F.col("doc_id") % 7 > 0, F.col("doc_id") % 10 / 10)
    return t(s, d, "documents").select(
        "doc_id", records.long_problem(F.col("text")).alias("long"), records.certain(se, 0.3).alias("certain")
    )


@equals(
    "WITH x AS (SELECT doc_id % 4 AS e FROM documents) SELECT r::INT AS round, count(*) AS n FROM x, range(1, 4) g(r) WHERE e >= r GROUP BY 1"
)
def evolution_rounds(s, d):
    seeds = t(s, d, "documents").select("doc_id", (F.col("doc_id") % 4).alias("evol_rounds"), F.lit(0).alias("round"))
    return records.rounds(
        seeds, 5, lambda now, r: now.withColumn("round", F.lit(r))
    ).groupBy("round").agg(F.count("*").alias("n"))


@equals(
    "SELECT source, round(avg(n_chars) FILTER (quality = 1), 6) AS good, round(avg(n_chars) FILTER (quality = 0), 6) AS bad FROM documents JOIN labels USING (doc_id) GROUP BY 1"
)
def means_by_label(s, d):
    rows = t(s, d, "documents").join(t(s, d, "labels"), "doc_id")
    return records.by_label(rows, "quality", "n_chars", "source").select(
        "source", r6("good").alias("good"), r6("bad").alias("bad")
    )


@equals("SELECT o_orderkey, o_custkey, coalesce(o_orderkey % 2 = 0 AND o_orderkey % 3 = 0, false) AS equal FROM orders")
def verdict_lookup(s, d):
    orders = t(s, d, "orders").select("o_orderkey", "o_custkey")
    known = orders.filter("o_orderkey % 2 = 0").withColumn("equal", F.col("o_orderkey") % 3 == 0)
    return records.with_verdicts(orders, known, "o_orderkey", "o_custkey")


@equals(
    "SELECT l_orderkey, max_by(l_linestatus, pos) AS l_linestatus FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INT AS pos FROM lineitem) GROUP BY 1"
)
def last_writer(s, d):
    return records.last_written(with_pos(s, d), "l_orderkey", "l_linestatus", "pos")


@equals(
    "SELECT 'known' AS kind, c_nationkey::VARCHAR AS name, count(*) AS n FROM customer WHERE c_nationkey < 12 GROUP BY 1, 2 UNION ALL SELECT 'unknown', c_nationkey::VARCHAR, 1 FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey >= 12)"
)
def registry_lookup(s, d):
    names = t(s, d, "customer").select(F.col("c_nationkey").alias("name"))
    known, unknown = records.registered(
        names, t(s, d, "nation").filter("n_nationkey < 12").select(F.col("n_nationkey").alias("name"), "n_name"), "name"
    )
    known = known.groupBy("name").agg(F.count("*").alias("n")).select(
        F.lit("known").alias("kind"), F.col("name").cast("string").alias("name"), "n"
    )
    return known.unionByName(
        unknown.select(
            F.lit("unknown").alias("kind"), F.col("name").cast("string").alias("name"), F.lit(1).cast("long").alias("n")
        )
    )


@equals("SELECT o_orderkey, o_orderstatus, o_orderkey * 7 % 1000003 AS place FROM orders")
def scattered_results(s, d):
    orders = t(s, d, "orders").select("o_orderkey", "o_orderstatus")
    places = packing.reverse_index(
        orders.select((F.col("o_orderkey") * 7 % 1000003).alias("i"), F.col("o_orderkey").alias("to")), "i", "to"
    )
    both = records.zipped(
        orders.withColumn("i", F.col("o_orderkey")),
        orders.select(F.col("o_orderkey").alias("i"), F.lit(1).alias("one")),
        "i",
    )
    return records.scattered(both.drop("one"), places, "i", "to")


@equals("SELECT conv_id, turn, text FROM conversations")
def samples_of_prompts(s, d):
    lists = F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("responses")
    out = records.to_samples(t(s, d, "conversations").groupBy("conv_id").agg(lists), "responses")
    return out.select("conv_id", "response.turn", "response.text")


@equals(
    "SELECT count(*) FILTER (event_id % 5 > 0) AS success, count(*) FILTER (event_id % 5 = 0 AND event_id % 2 = 0) AS fallback, count(*) FILTER (event_id % 10 = 5) AS failed FROM events"
)
def parse_counts(s, d):
    i = F.col("event_id")
    return records.success_counts(t(s, d, "events"), F.when(i % 5 > 0, i), F.when(i % 2 == 0, i))


@equals(
    "SELECT event_type, count(*) AS n, sum((value > 10)::INT)::BIGINT AS verified, round(avg((value > 10)::INT::DOUBLE), 6) AS share FROM events GROUP BY 1"
)
def verified_counts(s, d):
    out = records.verified_share(t(s, d, "events").withColumn("ok", F.col("value") > 10), "ok", "event_type")
    return out.withColumn("share", r6("share"))


@equals(
    "SELECT conv_id, turn, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn), 100)::INT AS stop FROM conversations"
)
def next_boundaries(s, d):
    out = records.in_blocks(t(s, d, "conversations").withColumn("length", F.lit(100)), "conv_id", "turn", "length")
    return out.select("conv_id", "turn", F.col("stop").cast("int").alias("stop"))


@equals("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey % 3, o_orderkey) - 1)::BIGINT AS i FROM orders")
def joined_shards(s, d):
    orders = t(s, d, "orders").select("o_orderkey")
    return records.shards_joined(
        [orders.filter(F.col("o_orderkey") % 3 == r) for r in range(3)]
    ).select("o_orderkey", "i")


@equals(
    "SELECT event_type, strftime(max(ts), '[%Y-%m-%d %H:%M:%S] ') || 'eval step=' || count(*) || ' | max=' || printf('%.6f', max(value)) || ' | mean=' || printf('%.6f', round(avg(value), 3)) AS line FROM events GROUP BY 1"
)
def log_lines(s, d):
    values = F.create_map(F.lit("mean"), F.round(F.avg("value"), 3), F.lit("max"), F.max("value"))
    return t(s, d, "events").groupBy("event_type").agg(
        text.log_line(F.max("ts"), F.lit("eval"), F.count("*"), values).alias("line")
    )


@equals(
    "SELECT p_partkey, p_size AS num, p_size || '.【' || p_brand || '】' || p_type AS raw FROM part UNION ALL SELECT p_partkey, 7, '- 7 ．【' || p_name FROM part"
)
def question_blocks(s, d):
    raw = F.expr("concat('head\n ', p_size, '.【', p_brand, '】', p_type, '\n - 7 ．【', p_name, ' ')")
    return t(s, d, "part").select(
        "p_partkey", F.explode(text.question_blocks(raw)).alias("b")
    ).select("p_partkey", "b.num", "b.raw")


@equals("""SELECT p_partkey, p_brand AS question, p_size::VARCHAR AS answer FROM part""")
def json_arrays(s, d):
    one = "concat('{\"question\": \"', p_brand, '\", \"answer\": \"', p_size, '\"}')"
    raw = F.expr(
        f"CASE p_partkey % 2 WHEN 0 THEN concat('so [', {one}, '] ok') ELSE concat('broken [', {one}, ', {{\"question\": 1}} end') END"
    )
    rows = t(s, d, "part").select(
        "p_partkey", F.explode(text.json_array(raw, "question string, answer string")).alias("x")
    )
    return rows.select("p_partkey", "x.question", "x.answer")


@equals(
    "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_brand || p_type END AS response, CASE WHEN p_partkey % 4 = 1 THEN p_partkey ELSE 999 END::INT AS number, p_name AS line FROM part"
)
def small_parsers(s, d):
    i = F.col("p_partkey")
    prompt = F.when(i % 3 == 0, F.col("p_brand")).otherwise("absent")
    name = F.when(i % 4 == 1, F.concat(F.lit("第"), i.cast("string"), F.lit("讲 x.pdf"))).otherwise("x.pdf")
    line = F.concat(F.lit("<think>a\nb</think>\n "), "p_name", F.lit(" \nmore"))
    return t(s, d, "part").select(
        "p_partkey",
        text.response_part(F.concat("p_brand", "p_type"), prompt).alias("response"),
        text.file_number(name).alias("number"),
        text.first_line(line).alias("line"),
    )


NUMBERS = "p_size % 6 AS a, length(p_name) % 6 AS b, length(p_type) % 6 AS c, p_partkey % 6 AS d"


@equals(rf"""WITH x AS (SELECT p_partkey, p_partkey // 6 % 4 AS shape, {NUMBERS} FROM part)
SELECT p_partkey, CASE shape WHEN 0 THEN a * (d + 1) = c * (b + 1) WHEN 1 THEN a = c AND b = d WHEN 2 THEN a = d AND b = c
       ELSE a - b = c AND a * b = d END AS equal, CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS reward FROM x""")
def graded_answers(s, d):
    """Fractions, an interval against an inequality, chains read from either end, equations."""
    pair = lambda p, r: F.struct(F.format_string(p, "a", "b").alias("p"), F.format_string(r, "c", "d").alias("r"))
    shapes = [
        pair(r"\frac{%d}{%d + 1}", "%d/(%d+1)"),
        pair("(%d, %d]", r"%d < x \le %d"),
        pair("x+%d > y+%d > z", "z < y+%d < x+%d"),
        pair("y = (x+%d)(x-%d)", "x^2 + %dx - %d = y"),
    ]
    rows = t(s, d, "part").selectExpr("p_partkey", "p_size", *NUMBERS.split(", "))
    query_ = F.concat(F.lit("How many? It is \\boxed{"), F.col("p_size").cast("string"), F.lit(".0}"))
    label = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise("-1")
    rows = rows.withColumn("answers", F.get(F.array(*shapes), F.expr("cast(p_partkey / 6 as int) % 4")))
    return rows.select(
        "p_partkey",
        grading.enhanced_equal(F.col("answers.p"), F.col("answers.r")).alias("equal"),
        grading.math_reward(query_, F.lit("How many?"), label).alias("reward"),
    )


@equals("""WITH x AS (SELECT p_partkey, p_size % 4 AS a, length(p_name) % 4 AS b, length(p_type) % 3 AS c, p_partkey % 5 AS d FROM part)
SELECT p_partkey, a = b AND a * a - c = d AS equal FROM x""")
def algebra_equal(s, d):
    a = F.expr(r"concat('\\left(x+', p_size % 4, '\\right)^2 - ', length(p_type) % 3)")
    b = F.expr(r"concat('x^{2}+2\\cdot ', length(p_name) % 4, 'x+\\frac{', p_partkey % 5 * 2, '}{2}')")
    return t(s, d, "part").select("p_partkey", grading.algebra_equal(a, b).alias("equal"))


@equals(
    "SELECT o_orderkey, (i % 5)::INT AS robin, CASE WHEN i = 0 THEN 1 WHEN i = 1 THEN 1 WHEN i = 2 THEN 2 ELSE ([0, 1, 2])[(i - 3) % 3 + 1] END::INT AS engine FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)"
)
def engine_assignment(s, d):
    rows = packing.number_rows(t(s, d, "orders").select("o_orderkey"), "o_orderkey")
    return rows.select(
        "o_orderkey",
        packing.round_robin(F.col("i"), 5).alias("robin"),
        packing.least_loaded(F.col("i"), [8, 0, 4], 4).alias("engine"),
    )


@query
def dynamic_micro_batches(s, d):
    i = F.col("doc_id")
    rows = t(s, d, "documents").select(
        F.floor(i / 64).alias("step"), (F.floor(i / 32) % 2).alias("rank"), "doc_id", "n_chars"
    )
    return packing.micro_batches(rows, "step", "rank", "doc_id", "n_chars", 60_000)


@query
def rollout_batches(s, d):
    return packing.rollout_batches(
        t(s, d, "documents").select(F.floor(F.col("doc_id") / 96).alias("batch"), "doc_id", "n_chars"),
        "batch",
        "doc_id",
        "n_chars",
        60_000,
        4,
    )


@equals("""WITH c AS (SELECT conv_id, role, count(*) AS c FROM conversations GROUP BY 1, 2), n AS (SELECT *, sum(c) OVER (PARTITION BY conv_id) AS n FROM c)
SELECT conv_id, round(CASE WHEN max(n) = 1 THEN 0 ELSE -sum(c / n * ln(c / n)) / ln(max(n)) END, 6) + 0.0::DOUBLE AS entropy FROM n GROUP BY 1""")
def online_entropy(s, d):
    rows = t(s, d, "conversations").groupBy("conv_id").agg(F.collect_list("role").alias("r"))
    return rows.select("conv_id", r6(uncertainty.online_entropy(F.col("r"))).alias("entropy"))


@equals("""WITH v AS (SELECT n_chars::DOUBLE AS v, quality AS label FROM documents JOIN labels USING (doc_id)), b AS (SELECT label, least(floor(v / 100), 49)::BIGINT AS bin, count(*) AS n FROM v WHERE v BETWEEN 0 AND 5000 GROUP BY 1, 2)
SELECT label, bin, n, round(n / (sum(n) OVER (PARTITION BY label) * 100.0), 6) AS density FROM b""")
def histogram_by_class(s, d):
    rows = t(s, d, "documents").join(t(s, d, "labels"), "doc_id").select(
        F.col("n_chars").cast("double").alias("v"), F.col("quality").alias("label")
    )
    return evaluation.histogram(rows, "v", 0.0, 5000.0, 50, "label")


TIERS = """(VALUES ('easy', [0.3, 0.2, 0.15, 0.15, 0.1, 0.1]), ('medium', [0.25, 0.15, 0.15, 0.15, 0.15, 0.15]), ('hard', [0.2, 0.15, 0.15, 0.1, 0.2, 0.2]),
('competition', [0.15, 0.2, 0.15, 0.1, 0.2, 0.2])) t(tier, w)"""
SIZED = "CASE WHEN p_size <= 10 THEN 'easy' WHEN p_size <= 25 THEN 'medium' WHEN p_size <= 40 THEN 'hard' ELSE 'competition' END"


@equals(f"""WITH n AS (SELECT {SIZED} AS tier, count(*) AS parts FROM part GROUP BY 1)
SELECT tier, strategy, round(weight * parts, 6)::DOUBLE AS expected FROM n JOIN (SELECT tier, unnest(['harder', 'rewrite', 'algebraize', 'apply', 'compose', 'competition']) AS strategy, unnest(w)::DOUBLE AS weight FROM {TIERS}) USING (tier)""")
def strategy_table(s, d):
    sized = t(s, d, "part").groupBy(F.expr(SIZED).alias("tier")).agg(F.count("*").alias("parts"))
    return sized.join(records.strategies(s), "tier").select("tier", "strategy", r6(F.col("weight") * F.col("parts")).alias("expected"))


@equals("""SELECT lang, count(*) FILTER (n < 298) AS kept, count(*) FILTER (n >= 298) AS dropped
FROM (SELECT lang, least(len(string_split(text, ' ')), 300) AS n FROM documents) GROUP BY 1""")
def preference_length_filter(s, d):
    rows = t(s, d, "documents").withColumn("fits", chat.prompt_fits(F.size(F.split("text", " ", -1)), 300))
    return rows.groupBy("lang").agg(F.count_if("fits").alias("kept"), F.count_if(~F.col("fits")).alias("dropped"))


@equals("""SELECT doc_id, CASE source WHEN 'src1' THEN 'a b' WHEN 'src2' THEN 'c' ELSE 'x y' END AS shots FROM documents""")
def template_choice(s, d):
    name = F.concat(F.lit("team/"), F.upper("source"))
    shots = chat.template_for(name, {"src1": ["a", "b", "z"], "src2": ["c"]}, ["x", "y", "z"], 2)
    return t(s, d, "documents").select("doc_id", F.array_join(shots, " ").alias("shots"))


@equals("""SELECT p_partkey, coalesce(starts_with(prompt, 'Write') AND ends_with(prompt, p_name), false) AS whole, coalesce(length(prompt), 0)::INT AS n FROM (SELECT p_partkey, p_name,
CASE p_size % 3 WHEN 0 THEN 'Write a harder problem about the same idea as this one:' || chr(10) || chr(10) || p_name WHEN 1 THEN 'Write this problem as one of a mathematics competition:' || chr(10) || chr(10) || p_name END AS prompt FROM part)""")
def evolution_prompts(s, d):
    chosen = F.expr("CASE p_size % 3 WHEN 0 THEN 'harder' WHEN 1 THEN 'competition' ELSE 'unknown' END")
    rows = records.evolution_prompts(t(s, d, "part").withColumn("strategy", chosen), "p_name", "strategy")
    whole = F.startswith("prompt", F.lit("Write")) & F.endswith("prompt", F.col("p_name"))
    return rows.select("p_partkey", F.coalesce(whole, F.lit(False)).alias("whole"), F.coalesce(F.length("prompt"), F.lit(0)).alias("n"))


@equals("""WITH c AS (SELECT l_orderkey AS k, list(l_linenumber ORDER BY l_linenumber, l_partkey, l_suppkey) AS ids FROM lineitem GROUP BY 1)
SELECT k, CASE WHEN ids[-1] = 3 THEN len(ids) ELSE len(ids) + 1 END::INT AS closed, len(list_filter(ids, lambda x: x % 2 = 1))::INT AS odd, ceil(len(ids) / 4)::BIGINT AS quarters,
CASE WHEN k % 2 = 0 THEN 7 ELSE 15 END::INT AS opened FROM c""")
def row_endings(s, d):
    order = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: x.l_linenumber)
    rows = t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(order.alias("ids"))
    odd = chat.unpadded(F.col("ids"), F.transform("ids", lambda x: x % 2))
    prompt = F.when(F.col("k") % 2 == 0, F.lit("<think>")).otherwise("problem")
    return rows.select(
        "k",
        F.size(chat.with_eos(F.col("ids"), 3)).alias("closed"),
        F.size(odd).alias("odd"),
        packing.ceildiv(F.size("ids"), 4).alias("quarters"),
        F.length(chat.with_think(prompt)).alias("opened"),
    )
