"""Named queries over the driver's tables: how each operator is fed, and what comes out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.functions import grading, losses, text
from kiln.operators import chat, curation, evaluation, neardup, packing, preference, rollout, scans, uncertainty
from kiln.operators.records import tier_weights
from kiln.plans import records, training  # noqa: F401  their queries register themselves
from kiln.plans.registry import QUERIES, preference_rows, query, r6, t, with_pos  # noqa: F401

def responses(s, d) -> DataFrame:
    return t(s, d, "lineitem").select(
        F.col("l_orderkey").alias("prompt"),
        F.concat(F.expr("nullif(l_returnflag, 'N')"), F.col("l_linestatus")).alias("boxed"),
        (-F.col("l_extendedprice") / 1000).alias("slp"),
        F.col("l_quantity").alias("len"),
    )


@query
def weighted_se(s, d):
    return uncertainty.weighted_entropy(responses(s, d))


@query
def count_se(s, d):
    return uncertainty.count_entropy(responses(s, d))


@query
def se_distribution(s, d):
    return uncertainty.se_distribution(uncertainty.weighted_entropy(responses(s, d)))


@query
def se_thresholds(s, d):
    return uncertainty.threshold_accuracy(scored(s, d), [(0.0, 0.1), (0.0, 0.3), (0.1, 0.5), (0.5, 1.0)])


@query
def judge_pairs(s, d):
    return uncertainty.pair_counts(
        t(s, d, "lineitem"), "l_orderkey", "l_returnflag"
    ).withColumnRenamed("l_orderkey", "prompt")


@query
def judged_clusters(s, d):
    rows = with_pos(s, d).select(
        F.col("l_orderkey").alias("prompt"), F.col("pos").cast("int").alias("i"), F.col("l_quantity").alias("q")
    )
    x, y = rows.alias("x"), rows.alias("y")
    pairs = x.join(y, (F.col("x.prompt") == F.col("y.prompt")) & (F.col("x.i") < F.col("y.i"))).select(
        F.col("x.prompt").alias("prompt"),
        F.col("x.i").alias("i"),
        F.col("y.i").alias("j"),
        (F.abs(F.col("x.q") - F.col("y.q")) <= 5).alias("equal"),
    )
    return uncertainty.clusters_by_verdict(pairs, rows)


def marked(s, d) -> DataFrame:
    extra = F.expr(
        "CASE doc_id % 5 WHEN 0 THEN ' Step 1: Therefore, the answer is 4' WHEN 1 THEN ' Find x' WHEN 2 THEN ' (A) one (B) two' WHEN 3 THEN ' step 2: so' ELSE '' END"
    )
    return t(s, d, "documents").select("doc_id", "source", "lang", F.concat("text", extra).alias("q"))


@query
def filter_funnel(s, d):
    q = F.col("q")
    return curation.funnel(
        marked(s, d),
        {
            "length": F.length(q).between(30, 2000),
            "not_solution": ~text.is_likely_solution(q),
            "problem": text.is_likely_problem(q),
            "not_choice": ~text.is_multiple_choice(q),
        },
    ).select(F.col("ord").cast("int").alias("ord"), "stage", "kept", "removed")


@query
def solution_filter(s, d):
    q = F.col("q")
    return marked(s, d).select(
        "doc_id",
        text.is_likely_solution(q).alias("solution"),
        text.is_likely_problem(q).alias("problem"),
        text.is_multiple_choice(q).alias("choice"),
        text.answer_too_complex(q).alias("complex"),
    )


@query
def counts_by_source(s, d):
    return t(s, d, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")


@query
def counts_by_lang(s, d):
    return t(s, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))


@query
def seeds_capped(s, d):
    return curation.capped(
        t(s, d, "documents").filter(F.length(text.strip(F.col("text"))) >= 10), "source", "doc_id", 10
    ).select("source", "doc_id")


@query
def routed_keep_remove(s, d):
    said = F.expr(
        "CASE WHEN quality = 1 THEN 'fine. VERDICT: keep' WHEN doc_id % 2 = 0 THEN 'REMOVE it' ELSE 'unclear' END"
    )
    rows = t(s, d, "labels").join(t(s, d, "documents"), "doc_id").withColumn("keep", text.parse_keep(said))
    return rows.groupBy("keep").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query
def strict_judgment(s, d):
    said = F.expr(
        "CASE o_orderkey % 6 WHEN 0 THEN concat('<think>no</think>ok', chr(10), 'Accept: fine') WHEN 1 THEN 'REJECT: wrong' WHEN 2 THEN 'we accept this' WHEN 3 THEN '<think>ACCEPT' WHEN 4 THEN 'Please reject: bad form' ELSE 'hm' END"
    )
    return t(s, d, "orders").select(
        "o_orderkey", text.parse_accept(said).alias("j")
    ).select("o_orderkey", "j.accept", "j.reason")


@query
def resume_remaining(s, d):
    orders = t(s, d, "orders")
    return curation.remaining(
        orders, orders.filter("o_orderkey % 3 = 0"), "o_orderkey"
    ).select("o_orderkey", "o_orderstatus")


def scored_outputs(s, d) -> DataFrame:
    return t(s, d, "events").select(
        F.col("user_id").alias("input"),
        F.col("event_id").alias("pos"),
        F.col("value").alias("reward"),
        F.col("event_type").alias("output"),
    )


@query
def best_of_n(s, d):
    return preference.best_of_n(scored_outputs(s, d), "input", "reward", "pos")


@query
def iterative_dpo(s, d):
    return preference.chosen_rejected(scored_outputs(s, d), "input", "output", "reward", "pos")


@query
def reward_zscore(s, d):
    return preference.normalised(scored_outputs(s, d), "reward").select("pos", r6("reward").alias("z"))


@query
def reward_stats(s, d):
    return preference.reward_stats(scored_outputs(s, d), "reward").select(
        r6("mean").alias("mean"), r6("std").alias("std")
    )


@query
def csft_prompt(s, d):
    rows = scored_outputs(s, d).withColumn(
        "reward", F.floor("reward") + F.lit(0.25)
    ).withColumn("input", F.col("input").cast("string"))
    return preference.conditioned(rows, "input", "reward", "{input} <rm_score>: {reward} ").select("pos", "input")


@query
def majority_vote(s, d):
    return evaluation.majority_vote(scored_outputs(s, d), "input", "output", "pos")


def graded(s, d) -> DataFrame:
    return t(s, d, "lineitem").join(t(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "o_orderpriority", "o_orderstatus", (F.col("l_returnflag") == "R").alias("correct")
    )


@query
def pass_at_k(s, d):
    return evaluation.pass_at_k(
        graded(s, d).withColumn("reward", F.col("correct").cast("double")), "l_orderkey", "o_orderpriority", "reward"
    )


@query
def avg_at_n(s, d):
    return evaluation.avg_at_n(graded(s, d), "l_orderkey", "o_orderpriority")


@query
def greedy_accuracy(s, d):
    return evaluation.accuracy(graded(s, d), "o_orderpriority")


@query
def accuracy_pivot(s, d):
    return evaluation.accuracy_pivot(
        graded(s, d).withColumn("c", F.col("correct").cast("double")),
        "o_orderpriority",
        "o_orderstatus",
        ["F", "O", "P", "X"],
        "c",
    )


@query
def report_lines(s, d):
    return t(s, d, "orders").select(
        "o_orderkey",
        evaluation.result_line(
            F.col("o_orderstatus") == "F", F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
        ).alias("line"),
    )


@query
def dynamic_filtering(s, d):
    out = rollout.dynamic_filter(
        graded(s, d).withColumn("score", F.col("correct").cast("double")), "l_orderkey", "score", 0.0, 1.0
    )
    return out.groupBy("l_orderkey").agg(F.count("*").alias("n"), r6(F.avg("score")).alias("mean"))


@query
def refill_accepted(s, d):
    out = rollout.dynamic_filter(
        graded(s, d).withColumn("score", F.col("correct").cast("double")), "l_orderkey", "score", 0.0, 1.0
    )
    return rollout.first_accepted(out, "l_orderkey", 20).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query
def group_baselines(s, d):
    out = rollout.group_baselines(with_pos(s, d), "l_orderkey", "l_discount")
    return out.select(
        "l_orderkey",
        "pos",
        r6("rloo").alias("rloo"),
        r6("centred").alias("centred"),
        F.when(F.col("group_std") > 1e-6, F.round("normed", 4) + F.lit(0.0)).alias("normed"),
        r6("group_std").alias("group_std"),
    )


@query
def return_to_go(s, d):
    own = t(s, d, "events").select("user_id", "ts", "event_id", "value")
    out = scans.returns(own, "user_id", ["ts", "event_id"], F.col("value"), 1.0)
    return out.select("event_id", (F.round("togo", 4) + F.lit(0.0)).alias("togo"))


@query
def gae(s, d):
    own = scans.positions(t(s, d, "events").select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"])
    out = scans.advantages(own, "user_id", ["ts", "event_id"], F.col("value"), F.col("value") / 2, 0.9, 0.8)
    return out.select("user_id", F.col("p").cast("int").alias("p"), (F.round("advantage", 5) + F.lit(0.0)).alias("advantage"))


@query
def whitened_advantages(s, d):
    out = rollout.whitened(with_pos(s, d).withColumn("m", F.col("l_returnflag") != "N"), "l_discount", "m")
    return out.select("l_orderkey", "pos", (F.round("l_discount", 5) + F.lit(0.0)).alias("a"))


@query
def kl_estimators(s, d):
    p, b = -F.col("l_quantity") / 10, -F.col("l_discount") * 20
    return with_pos(s, d).select("l_orderkey", "pos", *[r6(losses.kl(p, b, k)).alias(k) for k in ("k1", "k2", "k3")])


@query
def length_penalties(s, d):
    r, n = F.col("l_discount"), F.col("l_quantity")
    long = rollout.overlong(r, n, 50, 20, 0.5)
    return with_pos(s, d).select(
        "l_orderkey",
        "pos",
        r6(long).alias("overlong"),
        r6(rollout.stop_properly(long, F.col("l_returnflag") == "R", 0.5)).alias("both"),
    )


@query
def terminal_reward(s, d):
    rows = with_pos(s, d).groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("pos", (F.col("l_returnflag") != "N").alias("m"), "l_tax"))).alias("e"),
        F.max("l_discount").alias("r"),
    )
    out = rows.select("l_orderkey", rollout.terminal_reward(F.col("e.m"), F.col("r"), F.col("e.l_tax"), 0.1).alias("x"))
    return out.select("l_orderkey", F.posexplode("x").alias("p", "v")).select(
        "l_orderkey", (F.col("p") + 1).alias("pos"), r6("v").alias("reward")
    )


def scored(s, d) -> DataFrame:
    rows = t(s, d, "labels").join(t(s, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select(
        F.col("doc_id").alias("pos"),
        (1 - F.col("quality")).alias("label"),
        (F.col("n_chars") / (F.col("n_chars") + 5000.0)).alias("score"),
    )


@query
def auroc(s, d):
    return uncertainty.auroc(scored(s, d))


@query
def roc_points(s, d):
    return uncertainty.roc_points(scored(s, d)).select("rank", r6("tpr").alias("tpr"), r6("fpr").alias("fpr"))


@query
def binned_accuracy(s, d):
    return uncertainty.binned_accuracy(scored(s, d))


@query
def class_summary(s, d):
    out = uncertainty.class_summary(scored(s, d), "label")
    return out.select("label", "n", *[r6(c).alias(c) for c in ("mean", "median", "least", "most")])


@query
def reward_histogram(s, d):
    values = t(s, d, "embeddings").select(F.explode("embedding").alias("v")).select(
        (F.col("v").cast("double") * 20).alias("v")
    )
    return evaluation.histogram(values, "v", -10.0, 10.0, 10)


def latex(s, d) -> DataFrame:
    answer = F.expr(
        "concat('so ', '\\\\boxed{1} or \\\\boxed{\\\\frac{', p_size, '}{', p_partkey % 7 + 1, CASE WHEN p_partkey % 11 = 0 THEN '}' ELSE '}}' END, ' end')"
    )
    return t(s, d, "part").select("p_partkey", "p_size", answer.alias("a"))


@query
def boxed_extract(s, d):
    return latex(s, d).select("p_partkey", text.last_boxed(F.col("a")).alias("boxed"))


@query
def gsm8k(s, d):
    a = F.expr(
        "concat('<<', p_size, '*2=', p_size * 2, '>>', 'total ', p_size * 2, chr(10), '#### ', p_size * 2, chr(10), 'tail')"
    )
    return t(s, d, "part").select("p_partkey", text.gsm8k_label(a).alias("label"), text.gsm8k_clean(a).alias("cot"))


@query
def think_strip(s, d):
    a = F.expr(
        "CASE p_partkey % 3 WHEN 0 THEN concat('<think>', p_name, '</think> ', p_brand) WHEN 1 THEN concat(p_brand, ' <think>', p_name) ELSE p_type END"
    )
    return t(s, d, "part").select("p_partkey", text.strip_think(a).alias("answer"))


@query
def numeric_grade(s, d):
    p = F.expr(
        "CASE p_partkey % 4 WHEN 0 THEN cast(p_size AS string) WHEN 1 THEN concat(p_size, '%') WHEN 2 THEN '1,000' ELSE 'x' END"
    )
    r = F.expr("CASE p_partkey % 3 WHEN 0 THEN cast(p_size AS string) WHEN 1 THEN '1000' ELSE 'X' END")
    return t(s, d, "part").select("p_partkey", grading.math_equal(p, r).alias("equal"))


@query
def tuple_grade(s, d):
    p = F.expr("concat('(', p_size, ', ', p_partkey % 3, ')')")
    r = F.expr(
        "concat(CASE WHEN p_partkey % 2 = 0 THEN '[' ELSE '(' END, p_size, ', ', p_partkey % 2, CASE WHEN p_partkey % 2 = 0 THEN ']' ELSE ')' END)"
    )
    return t(s, d, "part").select("p_partkey", grading.math_equal(p, r).alias("equal"))


@query
def extracted_answers(s, d):
    return latex(s, d).select(
        "p_partkey", grading.extract_answer(F.regexp_replace("a", r"\}( end)$", "}$1")).alias("answer")
    )


@query
def intervals(s, d):
    a = F.expr(
        "CASE p_partkey % 4 WHEN 0 THEN concat('(', '-\\\\infty', ', ', p_size, ']') WHEN 1 THEN concat('x\\\\le ', p_size) WHEN 2 THEN concat('1 < y ≤ ', p_size) ELSE 'none' END"
    )
    return t(s, d, "part").select("p_partkey", grading.to_interval(a).alias("v")).select(
        "p_partkey", "v.lo", "v.lo_closed", "v.hi", "v.hi_closed"
    )


@query
def translate_roundtrip(s, d):
    rows = t(s, d, "documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("中"), "text")).otherwise(F.col("text")).alias("question"),
        F.col("lang").alias("answer"),
    )
    return curation.translated(rows, "doc_id", ["question", "answer"], text.has_chinese, F.reverse)


@query
def json_object_parse(s, d):
    raw = F.concat(F.lit("Sure: "), F.regexp_replace("props", r"\}$", ", }"), F.lit(" done"))
    return t(s, d, "events").select(
        "event_id",
        text.json_object(raw, "k STRING", ["k"]).isNotNull().alias("has_k"),
        F.length(F.regexp_extract(raw, r"(?s)\{.*\}", 0)).alias("n"),
    )


@query
def sft_prefixes(s, d):
    turns = t(s, d, "conversations").withColumn("n", F.length("text"))
    return chat.prefixes(turns, "conv_id", "turn", "n").select("conv_id", "turn", "start", "stop", "turns_before")


@query
def multi_turn_mask(s, d):
    turns = t(s, d, "conversations").withColumn("n", F.length("text") % 7 + 1)
    w = chat.prefixes(turns, "conv_id", "turn", "n").groupBy("conv_id").agg(
        F.collect_list(F.struct("start", "stop")).alias("r")
    )
    total = turns.groupBy("conv_id").agg(F.sum("n").alias("total"))
    out = total.join(w, "conv_id").select("conv_id", chat.range_mask(F.col("total"), F.col("r")).alias("m"))
    return out.select(
        "conv_id", F.size("m").cast("long").alias("total"), F.size(F.filter("m", lambda x: x)).cast("long").alias("set")
    )


@query
def token_length_filter(s, d):
    n, p = F.size(F.split("text", " ")), F.col("doc_id") % 3
    return t(s, d, "documents").filter(chat.long_enough(p, n, 400)).groupBy("lang").agg(F.count("*").alias("n"))


@query
def kto_rotation(s, d):
    rows = packing.number_rows(
        t(s, d, "labels").join(t(s, d, "documents"), "doc_id").select("doc_id", "source"), "doc_id"
    )
    return preference.rotated(
        rows.withColumn("batch", F.floor(F.col("i") / 8)), "batch", "doc_id", "source"
    ).select("doc_id", "batch", "mismatched")


@query
def softmax_entropy(s, d):
    v = F.transform("embedding", lambda x: x.cast("double") * 4)
    return t(s, d, "embeddings").select(
        "vec_id", r6(losses.entropy(v)).alias("entropy"), r6(losses.log_prob(v, F.col("label"))).alias("log_prob")
    )


@query
def kd_loss(s, d):
    e = t(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    pair = e.alias("a").join(e.alias("b"), F.col("b.vec_id") == F.col("a.vec_id") + 1)
    return pair.select(
        F.col("a.vec_id").alias("vec_id"), r6(losses.cross_entropy(F.col("a.v"), F.col("b.v"))).alias("loss")
    )


@query
def topk_logits(s, d):
    top = losses.top_k(F.transform("embedding", lambda x: x.cast("double")), 5)
    return t(s, d, "embeddings").select("vec_id", F.posexplode(top).alias("p", "x")).select(
        "vec_id", (F.col("p") + 1).alias("rank"), F.col("x.id").cast("int").alias("id"), r6("x.value").alias("value")
    )


@query
def preference_losses(s, d):
    c = [F.col(x) for x in ("pc", "pr", "rc", "rr")]
    return preference_rows(s, d).select(
        "l_orderkey",
        "pos",
        r6(losses.dpo(*c, 0.5)).alias("dpo"),
        r6(losses.dpo(*c, 0.5, 0.1)).alias("cdpo"),
        r6(losses.dpo(*c, 0.5, ipo=True)).alias("ipo"),
        r6(losses.pairwise(c[0], c[1], 0.2)).alias("pairwise"),
        r6(losses.kto(0.5 * (c[0] - c[2]), F.lit(0.1), F.col("y"))).alias("kto"),
    )


@query
def policy_loss(s, d):
    ratio, adv = F.exp(F.col("pc") - F.col("rc")), F.col("pr") + 1.0
    return preference_rows(s, d).select(
        "l_orderkey",
        "pos",
        r6(losses.policy(ratio, adv)).alias("loss"),
        r6(losses.policy(ratio, adv, dual=3.0)).alias("dual"),
        losses.clipped(ratio, adv).alias("clipped"),
        r6(losses.value(F.col("pc"), F.col("rc"), F.col("rr"), 0.2)).alias("value"),
        r6(losses.importance(F.col("pc") - F.col("rc"), 0.5, 2.0, "icepop")).alias("icepop"),
    )


@query
def rank_shard(s, d):
    rows = packing.number_rows(t(s, d, "orders").select("o_orderkey"), "o_orderkey")
    return packing.rank_shard(rows, "i", rows.count(), 7).select("o_orderkey", "rank", "place")


@query
def chunk_shard(s, d):
    rows = packing.number_rows(t(s, d, "orders").select("o_orderkey"), "o_orderkey")
    return rows.select("o_orderkey", packing.chunk_shard(F.col("i"), rows.count(), 6).alias("actor"))


@query
def snake_balance(s, d):
    return packing.snake(t(s, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 4).select("doc_id", "rank", "turn")


@query
def first_fit(s, d):
    rows = t(s, d, "documents").select(
        "doc_id", F.col("n_chars").alias("n"), F.floor(F.col("doc_id") / 50).alias("batch")
    )
    return packing.first_fit_bins(rows, "batch", "doc_id", "n", 8000)


@query
def karmarkar_karp(s, d):
    rows = t(s, d, "documents").select("doc_id", "n_chars", F.floor(F.col("doc_id") / 64).alias("batch"))
    return packing.balanced(rows, "batch", "doc_id", "n_chars", 4)


@query
def char_budget_groups(s, d):
    return scans.budget_groups(
        t(s, d, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 6000
    )


@query
def concat_blend(s, d):
    docs = t(s, d, "documents").select("doc_id", "source")
    clean = F.coalesce(F.col("source") == "src1", F.lit(False))
    a, b = docs.filter(clean).withColumn("from", F.lit("clean")), docs.filter(~clean).withColumn(
        "from", F.lit("augment")
    )
    return a.unionByName(b)


@query
def interleave(s, d):
    docs = t(s, d, "documents").select("doc_id", "source")
    first = F.coalesce(F.col("source") == "src1", F.lit(False))
    return curation.interleave([(docs.filter(first), 0.7), (docs.filter(~first), 0.3)], "doc_id", docs.count())


def two_sources(s, d):
    docs = t(s, d, "documents").select("doc_id", "source")
    first = F.coalesce(F.col("source") == "src1", F.lit(False))
    return [(docs.filter(first), 0.1), (docs.filter(~first), 0.9)]


@query
def interleave_first(s, d):
    return curation.interleave_until(two_sources(s, d), "doc_id", "first_exhausted", 3)


@query
def interleave_all(s, d):
    return curation.interleave_until(two_sources(s, d), "doc_id", "all_exhausted", 3)


@query
def image_filter(s, d):
    raw = F.when(
        F.col("page_id") % 3 == 0, F.concat(F.lit("see ![x]("), F.col("url"), F.lit(")"))
    ).otherwise(F.col("url"))
    return t(s, d, "pages").select("page_id", text.has_image(raw).alias("image"))


@query
def ordered_topn(s, d):
    return t(s, d, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(10).select("s_suppkey", "s_acctbal")


@query
def shingle_jaccard_pairs(s, d):
    found = neardup.similar_pairs(t(s, d, "documents"), "doc_id", "text")
    return found.select("i", "j", r6("jaccard").alias("jaccard"))


@query
def minhash_bands(s, d):
    return neardup.bands(neardup.signatures(t(s, d, "documents"), "doc_id", "text"), "doc_id")


@query
def near_dup_removed(s, d):
    return neardup.first_kept(t(s, d, "documents"), "doc_id", "text").select("doc_id")


@query
def metric_lines(s, d):
    rows = t(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("m"))
    return rows.select(
        "event_type",
        F.concat_ws(
            " | ",
            F.concat(F.lit("step="), F.col("n").cast("string")),
            F.concat(F.lit("mean="), F.format_string("%.3f", F.round("m", 3))),
        ).alias("line"),
    )


@query
def shuffled_cap(s, d):
    return t(s, d, "documents").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(100).select("doc_id")


@query
def step_status(s, d):
    rows = with_pos(s, d).withColumn("batch", F.col("l_orderkey") % 16)
    a = rollout.batch_means(rows, "batch", ["l_discount", "l_tax"]).select(
        r6("l_discount").alias("discount"), r6("l_tax").alias("tax")
    )
    return a.crossJoin(  # one row each
        rollout.length_weighted(rows, "l_discount", "l_quantity").select(r6("l_discount").alias("weighted"))
    )


@query
def replay_cap(s, d):
    return rollout.latest(t(s, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 100)


@query
def padded_batch(s, d):
    rows = packing.number_rows(t(s, d, "documents").select("doc_id"), "doc_id")
    return rollout.with_padding(rows, "i", rows.count(), 48).select("i", "padding")


@query
def positional_slice(s, d):
    rows = packing.number_rows(t(s, d, "orders").select("o_orderkey"), "o_orderkey")
    return curation.slice_rows(rows, "i", 128, 192).select("o_orderkey")


@query
def first_hundredth(s, d):
    rows = packing.number_rows(t(s, d, "orders").select("o_orderkey"), "o_orderkey")
    return curation.slice_rows(rows, "i", 0, int(rows.count() * 0.01)).select("o_orderkey")


@query
def length_imbalance(s, d):
    sums = packing.number_rows(
        t(s, d, "documents").select("doc_id", "n_chars"), "doc_id"
    ).groupBy((F.col("i") % 8).alias("part")).agg(F.sum("n_chars").alias("n"))
    return sums.agg(F.min("n").alias("least"), F.max("n").alias("most"), r6(F.avg("n")).alias("mean"))


@query
def reward_model_eval(s, d):
    rows = preference_rows(s, d).withColumn("batch", F.col("l_orderkey") % 32)
    each = rows.groupBy("batch").agg(
        F.avg((F.col("pc") > F.col("pr")).cast("double")).alias("acc"),
        F.avg(losses.pairwise(F.col("pc"), F.col("pr"))).alias("loss"),
    )
    return each.agg(r6(F.avg("acc")).alias("acc"), r6(F.avg("loss")).alias("loss"))


@query
def adaptive_kl(s, d):
    steps = t(s, d, "orders").select(
        "o_custkey", "o_orderkey", (F.col("o_totalprice") / 100000).alias("kl"), F.lit(64).alias("n")
    )
    return rollout.kl_coefficient(
        steps, "o_custkey", "o_orderkey", "kl", "n", 0.1, 1.0, 10000.0
    ).select("o_orderkey", r6("coefficient").alias("coefficient"))


@query
def strategy_draw(s, d):
    return curation.weighted_choice(
        t(s, d, "orders").select("o_orderkey", F.lit("apply").alias("last")), "o_orderkey", tier_weights("easy"), "last"
    ).groupBy("choice").agg(F.count("*").alias("n"))


@query
def soft_labels(s, d):
    return preference_rows(s, d).select(
        "l_orderkey",
        "pos",
        r6(losses.soft_label(F.col("pc"), F.col("pr"), F.when(F.col("y"), 0.9).otherwise(0.2))).alias("loss"),
    )


@query
def inequality_chains(s, d):
    a = F.expr(
        "CASE p_partkey % 3 WHEN 0 THEN concat('1 < x \\\\le ', p_size) WHEN 1 THEN concat(p_size, ' > y ≥ 0') ELSE 'none' END"
    )
    return t(s, d, "part").select("p_partkey", grading.inequality_chain(a).alias("c")).select(
        "p_partkey", F.array_join("c.terms", "|").alias("terms"), F.array_join("c.ops", "|").alias("ops")
    )


@query
def eval_guard(s, d):
    a = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'x+y' WHEN 1 THEN 'a+b+c' WHEN 2 THEN 'x^{2}' ELSE 'sqrt(x)/2' END")
    return t(s, d, "part").select("p_partkey", grading.may_evaluate(a).alias("ok"))


@query
def translation_residue(s, d):
    rows = t(s, d, "documents").select(F.when(F.col("doc_id") % 4 == 0, "中x").otherwise("x").alias("q"))
    return rows.agg(F.count("*").alias("n"), F.sum(text.has_chinese(F.col("q")).cast("long")).alias("left"))


@query
def latex_rows(s, d):
    wide = evaluation.accuracy_pivot(
        graded(s, d).withColumn("c", F.col("correct").cast("double")),
        "o_orderpriority",
        "o_orderstatus",
        ["F", "O", "P"],
        "c",
    )
    return wide.select(F.concat_ws(" & ", "o_orderpriority", "c0", "c1", "c2").alias("line"))
