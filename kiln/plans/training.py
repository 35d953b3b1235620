"""Queries of training rows, losses and evaluations, each with the SQL that it equals."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.functions import losses
from kiln.operators import scans, training
from kiln.plans.registry import preference_rows, query, r6, t, with_pos

SQL = {}
POS = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INT AS pos FROM lineitem)"
TOKENS = f"""(SELECT l_orderkey AS k, pos, -l_quantity / 10 AS lp, -l_discount * 30 AS old, -l_tax * 40 AS roll, 1 - l_linenumber / 2.0::DOUBLE AS adv,
(l_returnflag <> 'N')::INT AS m, count(*) OVER (PARTITION BY l_orderkey) AS n FROM {POS})"""
PREF = f"(SELECT l_orderkey, pos, -l_quantity / 10 AS pc, -l_discount * 30 AS pr, -l_tax * 40 AS rc, (-l_linenumber / 2.0)::DOUBLE AS rr, l_returnflag = 'R' AS y FROM {POS})"
# one row a vector and place: student, teacher, the teacher's softmax over its five best, its rank
LOGITS = """(WITH u AS (SELECT vec_id, label, len(embedding) AS d, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings),
v AS (SELECT a.vec_id, a.label, a.i, a.d, a.x * 4 AS s, b.x * 3 AS q FROM u a JOIN u b ON a.vec_id = b.vec_id AND a.i + b.i = a.d - 1)
SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY q DESC, i) AS rank, max(s) OVER (PARTITION BY vec_id) AS ms, max(q) OVER (PARTITION BY vec_id) AS mq FROM v)"""
Z = f"""(SELECT vec_id, any_value(label) AS label, any_value(ms) + ln(sum(exp(s - ms))) AS zs, any_value(mq) + ln(sum(exp(q - mq))) AS zq,
any_value(mq) + ln(sum(exp(q - mq)) FILTER (rank <= 5)) AS z5 FROM {LOGITS} GROUP BY 1)"""
TOP = f"""(SELECT vec_id, vec_id // 8 AS seq, vec_id % 8 >= 2 AS m, (vec_id // 8 % 3) / 2.0::DOUBLE AS w, -sum(exp(q - z5) * (s - zs)) FILTER (rank <= 5) AS kl,
-sum(exp(s - zs) * (s - zs)) AS hs, -sum(exp(q - z5) * (q - z5)) FILTER (rank <= 5) AS ht FROM {LOGITS} JOIN {Z} USING (vec_id) GROUP BY 1)"""


def equals(sql: str):
    def add(f):
        SQL[f.__name__] = sql
        return query(f)

    return add


def sequences(s, d):
    """A row for each order: arrays of log-probabilities, advantages and a mask, in order."""
    rows = with_pos(s, d).select(
        F.col("l_orderkey").alias("k"), "pos", (
            -F.col("l_quantity") / 10
        ).alias("lp"), (-F.col("l_discount") * 30).alias("old"),
        (-F.col("l_tax") * 40).alias("roll"), (
            1 - F.col("l_linenumber") / 2.0
        ).alias("adv"), (F.col("l_returnflag") != "N").cast("int").alias("m"),
    )
    return training.batch_rows(rows, "k", "pos", ["pos", "lp", "old", "roll", "adv", "m"])


def logits(s, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = t(s, d, "embeddings").select(
        "vec_id",
        "label",
        F.transform(v, lambda x: x * 4).alias("student"),
        F.transform(F.reverse(v), lambda x: x * 3).alias("teacher"),
    )
    rows = rows.withColumn("top", losses.top_k(F.col("teacher"), 5))
    own = rows.withColumn("seq", F.floor(F.col("vec_id") / 8)).withColumn("m", F.col("vec_id") % 8 >= 2)
    return own.withColumn(
        "values", F.col("top.value")
    ).withColumn("ids", F.col("top.id")).withColumn("w", F.col("seq") % 3 / 2)


@equals(
    f"""SELECT round(sum(-lp * m) / sum(m), 6) AS token, round((SELECT avg(x) FROM (SELECT sum(-lp * m) / sum(m) AS x FROM {TOKENS} GROUP BY k HAVING sum(m) > 0)), 6) AS sequence FROM {TOKENS}"""
)
def sft_losses(s, d):
    rows = sequences(s, d)
    token, sequence = training.sft_loss(rows, "lp", "m"), training.sft_loss(rows, "lp", "m", token_level=False)
    return token.select(r6("loss").alias("token")).crossJoin(sequence.select(r6("loss").alias("sequence")))  # one row each


@equals(f"""WITH s AS (SELECT *, exp(sum((lp - old) * m) OVER w / nullif(sum(m) OVER w, 0)) AS r, exp(sum((old - roll) * m) OVER w / nullif(sum(m) OVER w, 0)) AS g FROM {TOKENS} WINDOW w AS (PARTITION BY k)),
p AS (SELECT *, -least(r * adv, least(greatest(r, 0.8), 1.2) * adv) AS a, -least(exp(lp - old) * adv, least(greatest(exp(lp - old), 0.8), 1.2) * adv) * CASE WHEN g BETWEEN 0.5 AND 2 THEN exp(old - roll) ELSE 0 END AS b FROM s)
SELECT k, round(sum(a * m) / nullif(sum(m), 0), 6) + 0.0::DOUBLE AS gspo, round(sum(b * m) / nullif(sum(m), 0), 6) + 0.0::DOUBLE AS gated FROM p GROUP BY 1""")
def sequence_policy(s, d):
    out = training.policy_sequences(sequences(s, d), "lp", "old", "roll", "adv", "m")
    return out.select("k", r6("gspo").alias("gspo"), r6("gated").alias("gated"))


@equals(f"""WITH s AS (SELECT *, exp(sum((lp - roll) * m) OVER w / nullif(sum(m) OVER w, 0)) AS r FROM {TOKENS} WINDOW w AS (PARTITION BY k)),
p AS (SELECT *, -least(r * adv, least(greatest(r, 0.8), 1.2) * adv) AS a FROM s) SELECT k, round(sum(a * m) / nullif(sum(m), 0), 6) + 0.0::DOUBLE AS gspo FROM p GROUP BY 1""")
def gspo_corrected(s, d):
    out = training.policy_sequences(sequences(s, d), "lp", "old", "roll", "adv", "m")
    return out.select("k", r6("gspo_rollout").alias("gspo"))


@equals(f"""WITH b AS (SELECT k % 16 AS b, sum(-lp * m) / nullif(sum(m), 0) AS x FROM {TOKENS} GROUP BY 1) SELECT round(avg(x), 6) AS loss, count(x) AS batches FROM b""")
def eval_batches(s, d):
    rows = sequences(s, d).withColumn("b", F.col("k") % 16)
    return training.eval_loss(rows, "b", "lp", "m").select(r6("loss").alias("loss"), "batches")


@equals(f"""WITH b AS (SELECT *, greatest(avg(pr - rr) OVER (PARTITION BY l_orderkey % 32), 0) AS kl FROM {PREF})
SELECT l_orderkey % 32 AS batch, round(avg(CASE WHEN y THEN 1 - 1 / (1 + exp(-(0.3 * (pc - rc) - 0.3 * kl))) ELSE 0.5 * (1 - 1 / (1 + exp(-(0.3 * kl - 0.3 * (pc - rc))))) END), 6) AS loss,
round(avg(0.3 * (pc - rc)) FILTER (y), 6) + 0.0::DOUBLE AS chosen_reward, round(avg(0.3 * (pc - rc)) FILTER (NOT y), 6) + 0.0::DOUBLE AS rejected_reward, round(any_value(kl), 6) AS kl FROM b GROUP BY 1""")
def kto_eval(s, d):
    rows = preference_rows(s, d).withColumn("batch", F.col("l_orderkey") % 32)
    out = training.kto_batches(rows, "batch", "pc", "rc", "y", ("pr", "rr"), 0.3, 1.0, 0.5)
    return out.select("batch", *[r6(c).alias(c) for c in ("loss", "chosen_reward", "rejected_reward", "kl")])


@equals(f"""WITH b AS (SELECT *, greatest(avg(pc - rc) OVER w, 0) AS ck, greatest(avg(pr - rr) OVER w, 0) AS jk FROM {PREF} WINDOW w AS (PARTITION BY l_orderkey % 32))
SELECT l_orderkey % 32 AS batch, round(avg((1 - 1 / (1 + exp(-0.3 * (pc - rc - jk)))) + (1 - 1 / (1 + exp(-0.3 * (ck - (pr - rr)))))) / 2, 6) AS loss FROM b GROUP BY 1""")
def kto_even(s, d):
    rows = preference_rows(s, d).withColumn("batch", F.col("l_orderkey") % 32)
    return training.kto_even(rows, "batch", "pc", "pr", "rc", "rr", 0.3).select("batch", r6("loss").alias("loss"))


@equals(f"""WITH x AS (SELECT l_orderkey % 32 AS b, 0.5 * ((pc - pr) - (rc - rr)) AS z, pc - rc > pr - rr AS r FROM {PREF}), e AS (SELECT b, avg(-(least(z, 0) - ln(1 + exp(-abs(z))))) AS l, avg(r::INT::DOUBLE) AS a FROM x GROUP BY 1)
SELECT round(avg(l), 6) AS eval_loss, round(avg(a), 6) AS acc_mean FROM e""")
def dpo_eval(s, d):
    out = training.dpo_eval(
        preference_rows(s, d).withColumn("batch", F.col("l_orderkey") % 32), "batch", "pc", "pr", "rc", "rr", 0.5
    )
    return out.select(r6("eval_loss").alias("eval_loss"), r6("acc_mean").alias("acc_mean"))


@equals("""WITH x AS (SELECT vec_id % 16 AS b, embedding[1]::DOUBLE * 4 AS p, embedding[2]::DOUBLE * 4 AS q, label % 2 AS y FROM embeddings),
e AS (SELECT b, avg(greatest(p, q) + ln(exp(p - greatest(p, q)) + exp(q - greatest(p, q))) - CASE WHEN y = 0 THEN p ELSE q END) AS l, avg(((CASE WHEN p >= q THEN 0 ELSE 1 END) = y)::INT::DOUBLE) AS a FROM x GROUP BY 1)
SELECT round(avg(l), 6) AS eval_loss, round(avg(a), 6) AS acc FROM e""")
def prm_eval(s, d):
    rows = logits(s, d).select(
        (F.col("vec_id") % 16).alias("batch"), F.slice("student", 1, 2).alias("x"), (F.col("label") % 2).alias("y")
    )
    out = training.prm_eval(rows, "batch", "x", "y")
    return out.select(r6("eval_loss").alias("eval_loss"), r6("acc").alias("acc"))


@equals(f"""WITH x AS (SELECT *, CASE WHEN m THEN kl / 0.7 END AS x FROM {TOP}), e AS (SELECT *, coalesce(exp(x - max(x) OVER w), 0) AS e FROM x WINDOW w AS (PARTITION BY seq)),
f AS (SELECT *, e / sum(e) OVER w * greatest(sum(m::INT) OVER w, 1) AS share FROM e WINDOW w AS (PARTITION BY seq))
SELECT round(sum(kl * share * w / (1 + exp(-5 * (hs - ht))) * m::INT) / sum(m::INT), 6) AS loss FROM f""")
def distill_loss(s, d):
    return training.distill(
        logits(s, d), "seq", "student", "values", "ids", "m", "w", tau=0.7
    ).select(r6("loss").alias("loss"))


@equals(
    f"""SELECT round(sum(kl * w * m::INT) / sum(m::INT), 6) AS topk, round((SELECT sum(c * m::INT) / sum(m::INT) FROM (SELECT vec_id % 8 >= 2 AS m, -sum(exp(q - zq) * (s - zs)) AS c FROM {LOGITS} JOIN {Z} USING (vec_id) GROUP BY vec_id)), 6) AS full FROM {TOP}"""
)
def simple_distill(s, d):
    rows = logits(s, d)
    top = training.simple_distill(
        rows, losses.top_cross_entropy(F.col("student"), F.col("values"), F.col("ids")), "m", "w"
    )
    full = training.simple_distill(rows, losses.cross_entropy(F.col("student"), F.col("teacher")), "m")
    return top.select(r6("loss").alias("topk")).crossJoin(full.select(r6("loss").alias("full")))  # one row each


@equals(f"""WITH l AS (SELECT *, NOT (vec_id % 7 = 0 AND i = 0) AS k FROM {LOGITS}), z AS (SELECT vec_id, ln(sum(exp(s)) FILTER (k)) AS zs, ln(sum(exp(q))) AS zq FROM l GROUP BY 1)
SELECT vec_id, CASE WHEN vec_id % 5 > 0 THEN round(-sum(exp(q - zq) * (s - zs)) FILTER (k), 6) END AS loss FROM l JOIN z USING (vec_id) GROUP BY 1""")
def kd_ignored(s, d):
    cut = F.transform("student", lambda x, i: F.when((F.col("vec_id") % 7 == 0) & (i == 0), float("-inf")).otherwise(x))
    label = F.when(F.col("vec_id") % 5 == 0, -100).otherwise(F.col("label"))
    return logits(s, d).select("vec_id", r6(losses.kd_position(cut, F.col("teacher"), label)).alias("loss"))


@equals(f"SELECT round(avg(-lp) FILTER (m = 1), 6) AS loss FROM {TOKENS}")
def lm_loss(s, d):
    rows = with_pos(s, d).select(
        (-F.col("l_quantity") / 10).alias("lp"),
        F.when(F.col("l_returnflag") == "N", -100).otherwise(F.col("l_linenumber")).alias("label"),
    )
    return training.lm_loss(rows, "lp", "label").select(r6("loss").alias("loss"))


@equals(f"""WITH g AS (SELECT k % 16 AS micro, any_value(k % 4) AS step, avg(lp) AS p, avg(old) AS q, avg(roll) AS e, count(*) AS n FROM {TOKENS} GROUP BY 1)
SELECT micro, round((p + 0.1 * q - 0.01 * e) * n / sum(n) OVER (PARTITION BY step), 6) AS loss FROM g""")
def scaled_loss(s, d):
    rows = with_pos(s, d).groupBy((F.col("l_orderkey") % 16).alias("micro")).agg(
        F.avg(-F.col("l_quantity") / 10).alias("p"),
        F.avg(-F.col("l_discount") * 30).alias("q"),
        F.avg(-F.col("l_tax") * 40).alias("e"),
        F.count("*").alias("n"),
    )
    steps = rows.groupBy((F.col("micro") % 4).alias("step")).agg(F.sum("n").alias("of"))
    both = rows.join(steps, F.col("micro") % 4 == F.col("step"))
    return both.select(
        "micro",
        r6(losses.step_loss(F.col("p"), F.col("q"), F.col("e"), 0.1, 0.01, F.col("n"), F.col("of"))).alias("loss"),
    )


@equals(
    f"""SELECT k, round(sum(lp) FILTER (pos > 1), 6) + 0.0::DOUBLE AS total, round(avg(lp) FILTER (pos > 1), 6) + 0.0::DOUBLE AS mean FROM {TOKENS} GROUP BY 1"""
)
def batch_log_probs(s, d):
    own = losses.beyond(F.col("lp"), F.lit(1))
    rows = sequences(s, d).select("k", F.when(F.size("lp") > 1, losses.total(own)).alias("x"), F.size(own).alias("n"))
    return rows.select("k", r6("x").alias("total"), r6(F.try_divide("x", "n")).alias("mean"))


@equals("""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p, CASE WHEN event_id % 3 > 0 THEN value ELSE 0 END AS r, CASE WHEN event_id % 3 > 0 THEN value / 2 ELSE 0 END AS v FROM events),
d AS (SELECT user_id, p, r, v, r + 0.9 * coalesce(lead(v) OVER (PARTITION BY user_id ORDER BY p), 0) - v AS d FROM e)
SELECT a.user_id, a.p::INT AS p, round(sum(power(0.72, b.p - a.p) * b.d), 4) + 0.0::DOUBLE AS advantage, round(sum(power(0.72, b.p - a.p) * b.d) + any_value(a.v), 4) + 0.0::DOUBLE AS returns,
round(sum(power(0.9, b.p - a.p) * b.r), 4) + 0.0::DOUBLE AS togo FROM d a JOIN d b ON a.user_id = b.user_id AND b.p >= a.p GROUP BY 1, 2""")
def masked_gae(s, d):
    order, seen = ["ts", "event_id"], F.col("event_id") % 3 > 0
    own = t(s, d, "events").select("user_id", *order, F.when(seen, F.col("value")).alias("r"), F.when(seen, F.col("value") / 2).alias("v"))
    own = scans.positions(own, "user_id", order)
    own = scans.advantages(own, "user_id", order, F.col("r"), F.col("v"), 0.9, 0.8)
    own = scans.returns(own, "user_id", order, F.col("r"), 0.9)
    r4 = lambda c: F.round(c, 4) + F.lit(0.0)
    back = F.col("advantage") + F.coalesce("v", F.lit(0.0))
    return own.select(
        "user_id", F.col("p").cast("int").alias("p"), r4("advantage").alias("advantage"), r4(back).alias("returns"), r4("togo").alias("togo")
    )


@equals(f"""SELECT k, string_agg((pos >= 2 AND pos < n)::INT, '' ORDER BY pos) AS mask, string_agg(pos, ',' ORDER BY pos) FILTER (pos <= last) AS trimmed,
CASE WHEN any_value(n) + 1 > 4 THEN '1,2,3,99' ELSE string_agg(pos, ',' ORDER BY pos) || ',99' END AS ended FROM (SELECT *, coalesce(max(CASE WHEN m = 1 THEN pos END) OVER (PARTITION BY k), n) AS last FROM {TOKENS}) GROUP BY 1""")
def row_masks(s, d):
    pos = F.transform("pos", lambda x: x.cast("int"))
    mask = training.single_turn_mask(F.size("pos"), F.lit(2))
    return sequences(s, d).select(
        "k",
        F.array_join(mask, "").alias("mask"),
        F.array_join(training.right_trimmed(pos, F.col("m")), ",").alias("trimmed"),
        F.array_join(training.ended(pos, 99, 4), ",").alias("ended"),
    )


@equals(f"""SELECT k, coalesce(string_agg((pos - 1 IN (1, 2) OR pos - 1 IN (4, 5))::INT, '' ORDER BY pos) FILTER (pos > 1 AND pos <= 5), '') AS mask,
coalesce(max(pos - 1) FILTER (pos - 1 IN (1, 2, 4) AND pos <= 5) - min(pos - 1) FILTER (pos - 1 IN (1, 2, 4) AND pos <= 5) + 1, 0)::INT AS response_length, any_value(n) >= 5 AS clipped FROM {TOKENS} GROUP BY 1""")
def action_masks(s, d):
    ranges = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("stop")) for a, b in ((1, 3), (4, 6))])
    out = sequences(s, d).select("k", training.action_mask(F.size("pos"), ranges, 5).alias("x"))
    return out.select("k", F.array_join("x.mask", "").alias("mask"), "x.response_length", "x.clipped")


@equals(f"""WITH o AS (SELECT k, unnest(range(0, n + 1)) AS i FROM (SELECT k, max(n) AS n FROM {TOKENS} GROUP BY 1))
SELECT o.k, o.i::INT AS i, CASE WHEN o.i >= 2 THEN coalesce(lp, 0) ELSE 0 END + 0.0::DOUBLE AS v FROM o LEFT JOIN {TOKENS} x ON x.k = o.k AND x.pos = o.i""")
def aligned_spans(s, d):
    n = F.size("lp") + 1
    rows = sequences(s, d).select("k", training.aligned(F.col("lp"), F.lit(1), n, F.lit(2), 0.0).alias("a"))
    return rows.select("k", F.posexplode("a").alias("i", "v")).select("k", "i", (F.col("v") + F.lit(0.0)).alias("v"))


@equals(
    f"""SELECT vec_id, round(coalesce(max(q) FILTER (rank <= 5 AND i = vec_id % 7), max(q)), 6) + 0.0::DOUBLE AS logp FROM {LOGITS} GROUP BY 1"""
)
def picked_log_probs(s, d):
    best = F.map_from_arrays("ids", "values")
    return logits(s, d).select(
        "vec_id",
        r6(training.picked((F.col("vec_id") % 7).cast(dict(logits(s, d).dtypes)["ids"][6:-1]), best)).alias("logp"),
    )


@equals(
    f"""SELECT k, round(coalesce(sum(lp) FILTER (pos > 1), 0), 6) + 0.0::DOUBLE AS chosen, round(coalesce(sum(lp) FILTER (pos < n), 0), 6) + 0.0::DOUBLE AS rejected FROM {TOKENS} GROUP BY 1"""
)
def stacked_pairs(s, d):
    rows = sequences(s, d).select("k", "lp", F.reverse("lp").alias("turned"), F.lit(1).alias("p"))
    stacked = training.stack_pairs(rows, "lp", "turned", "p")
    own = stacked.withColumn("x", r6(losses.total(losses.beyond(F.col("ids"), F.col("prompt_length")))))
    return training.unstack_pairs(own, "k", "x")


@equals("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders")
def batches_and_rows(s, d):
    rows = t(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return training.row_batches(
        training.batch_rows(rows, "o_custkey", "o_orderkey", ["o_orderkey", "o_orderstatus"]),
        "o_custkey",
        ["o_orderkey", "o_orderstatus"],
    )


@equals("""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE lang END AS p, CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END AS l, CASE WHEN doc_id % 3 > 0 THEN (doc_id % 10) / 10.0::DOUBLE END AS w FROM documents)
SELECT doc_id, 'weighed' AS kind, w AS weight FROM x WHERE w IS NOT NULL AND coalesce(p, '') <> '' UNION ALL SELECT doc_id, 'plain', 1.0 FROM x WHERE coalesce(p, '') <> '' AND coalesce(l, '') <> ''""")
def distill_rows(s, d):
    i = F.col("doc_id")
    rows = t(s, d, "documents").select(
        "doc_id",
        F.when(i % 11 == 0, "").otherwise(F.col("lang")).alias("p"),
        F.when(i % 5 == 0, "").otherwise(F.col("source")).alias("l"),
        F.when(i % 3 > 0, i % 10 / 10).alias("w"),
    )
    out = lambda kind, *by: training.distill_rows(rows, "p", "l", *by).select(
        "doc_id", F.lit(kind).alias("kind"), "weight"
    )
    return out("weighed", "w").unionByName(out("plain"))


@equals(
    f"""WITH b AS (SELECT l_orderkey % 32 AS k, avg((pc > pr)::INT::DOUBLE) AS a, avg(-(least(pc - pr, 0) - ln(1 + exp(-abs(pc - pr))))) AS l FROM {PREF} GROUP BY 1),
x AS (SELECT pc AS x FROM {PREF} UNION ALL SELECT pr FROM {PREF})
SELECT (SELECT round(avg(l), 6) FROM b) AS loss, (SELECT round(avg(a), 6) FROM b) AS acc, round(avg(x), 6) AS reward_mean, round(stddev_samp(x), 6) AS reward_std FROM x"""
)
def reward_model_stats(s, d):
    rows = preference_rows(s, d).withColumn("batch", F.col("l_orderkey") % 32)
    out = training.rm_eval(rows, "batch", "pc", "pr")
    return out.select(*[r6(c).alias(c) for c in ("loss", "acc", "reward_mean", "reward_std")])


@equals("SELECT event_id, round((value - 12.5) / 3.0, 6) + 0.0::DOUBLE AS reward FROM events")
def stored_normalisation(s, d):
    return t(s, d, "events").select("event_id", r6(training.normalised_by(F.col("value"), 12.5, 3.0)).alias("reward"))


@equals(
    """WITH r AS (SELECT user_id % 5 AS step, event_id % 4 AS rank, avg(value) AS v FROM events GROUP BY 1, 2)
SELECT step, round(avg(v), 6) AS mean, round(max(v), 6) AS most, string_agg(round(v, 3)::DECIMAL(18, 3)::VARCHAR, ',' ORDER BY rank) AS ranks FROM r GROUP BY 1"""
)
def rank_reductions(s, d):
    step, rank = (F.col("user_id") % 5).alias("step"), (F.col("event_id") % 4).alias("rank")
    rows = t(s, d, "events").groupBy(step, rank).agg(F.avg("value").alias("v"))
    mean, most = training.reduced(rows, ["v"], "mean", "step"), training.reduced(rows, ["v"], "max", "step")
    shown = F.array_join(F.transform("values", lambda x: F.round(x, 3).cast("decimal(18,3)").cast("string")), ",")
    lists = training.gathered(rows, "rank", "v", "step").select("step", shown.alias("ranks"))
    out = mean.select("step", r6("v").alias("mean")).join(most.select("step", r6("v").alias("most")), "step")
    return out.join(lists, "step")
