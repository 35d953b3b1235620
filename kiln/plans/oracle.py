"""DuckDB SQL that the queries equal."""

from __future__ import annotations

import re

from kiln.plans import records, training
from kiln.functions.text import CHOICE_MARKERS, PROBLEM_MARKERS, SOLUTION_MARKERS

POS = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INT AS pos FROM lineitem)"
RESP = "(SELECT l_orderkey AS prompt, nullif(l_returnflag, 'N') || l_linestatus AS boxed, -l_extendedprice / 1000 AS slp, l_quantity AS len FROM lineitem)"
SE = f"""(WITH r AS (SELECT *, boxed IS NOT NULL AND length(boxed) <= 200 AND slp IS NOT NULL AS ok FROM {RESP}),
g AS (SELECT prompt, sum((boxed IS NULL)::INT) AS nulls, sum(ok::INT) AS n FROM r GROUP BY 1),
v AS (SELECT r.prompt, boxed, slp / greatest(len, 1) AS x, n FROM r JOIN g USING (prompt) WHERE ok AND nulls <= 2 AND n >= 2),
w AS (SELECT *, exp(x - max(x) OVER (PARTITION BY prompt)) AS e FROM v),
c AS (SELECT prompt, boxed, sum(e) AS e, max(n) AS n FROM w GROUP BY 1, 2),
p AS (SELECT *, e / sum(e) OVER (PARTITION BY prompt) AS p FROM c),
h AS (SELECT prompt, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) AS raw, max(n) AS n FROM p GROUP BY 1)
SELECT g.prompt, round((raw / ln(h.n))::DECIMAL(20,10), 4)::DOUBLE AS se, round((1 - round((raw / ln(h.n))::DECIMAL(20,10), 4)::DOUBLE)::DECIMAL(20,10), 4)::DOUBLE AS se_weight,
round(raw::DECIMAL(20,10), 4)::DOUBLE AS se_raw, coalesce(h.n, 0)::BIGINT AS n_valid FROM g LEFT JOIN h USING (prompt))"""
MARKED = "(SELECT doc_id, text || CASE doc_id % 5 WHEN 0 THEN ' Step 1: Therefore, the answer is 4' WHEN 1 THEN ' Find x' WHEN 2 THEN ' (A) one (B) two' WHEN 3 THEN ' step 2: so' ELSE '' END AS q FROM documents)"


def _has(column: str, markers: list[str]) -> str:
    return "(" + " + ".join(f"contains({column}, '{m}')::INT" for m in markers) + ")"


SOLUTION, PROBLEM, CHOICE = _has(
    "lower(q)", SOLUTION_MARKERS
) + " >= 2", _has("lower(q)", PROBLEM_MARKERS) + " >= 1", _has("q", CHOICE_MARKERS) + " >= 1"
OUT = "(SELECT user_id AS input, event_id AS pos, value AS reward, event_type AS output FROM events)"
GRADED = "(SELECT l_orderkey, o_orderpriority, o_orderstatus, l_returnflag = 'R' AS correct FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
KEPT = f"(SELECT * FROM {GRADED} QUALIFY avg(correct::INT::DOUBLE) OVER (PARTITION BY l_orderkey) > 0 AND avg(correct::INT::DOUBLE) OVER (PARTITION BY l_orderkey) < 1)"
SCORED = "(SELECT doc_id AS pos, 1 - quality AS label, n_chars / (n_chars + 5000.0::DOUBLE)::DOUBLE AS score FROM labels JOIN documents USING (doc_id))"
PREF = f"(SELECT l_orderkey, pos, -l_quantity / 10 AS pc, -l_discount * 30 AS pr, -l_tax * 40 AS rc, (-l_linenumber / 2.0)::DOUBLE AS rr, l_returnflag = 'R' AS y FROM {POS})"
PART = "CASE WHEN p_partkey % 11 = 0 THEN '}' ELSE '}}' END"


def _sig(x: str) -> str:
    return f"(least({x}, 0) - ln(1 + exp(-abs({x}))))"


def _dpo(s: float) -> str:
    z = "(0.5 * ((pc - pr) - (rc - rr)))"
    return f"-{_sig(z)} * {1 - s} - {_sig('(-' + z + ')')} * {s}"


def _cl(x: str, lo, hi) -> str:
    return f"least(greatest({x}, {lo}), {hi})"


SHING = r"(SELECT doc_id, lang, source, list_distinct([substr(x, i::INT, 3) for i in range(1, length(x) - 1)]) AS sh FROM (SELECT doc_id, lang, source, regexp_replace(trim(lower(text)), '\s+', ' ', 'g') AS x FROM documents))"
OVER = "(CASE WHEN least(l_quantity - 30, 20) > 0 THEN l_discount - least(l_quantity - 30, 20) / 20 * 0.5 ELSE l_discount END)"
EV = "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p FROM events)"
R = "exp(pc - rc)"
A = "(pr + 1.0)"
FIRST = f"least({R} * {A}, {_cl(R, 0.8, 1.2)} * {A})"

SQL = {
    "weighted_se": f"SELECT * FROM {SE}",
    "count_se": f"""WITH c AS (SELECT prompt, boxed, count(*) AS c FROM {RESP} WHERE boxed IS NOT NULL AND length(boxed) <= 200 GROUP BY 1, 2),
p AS (SELECT *, sum(c) OVER (PARTITION BY prompt) AS n FROM c)
SELECT prompt, round(-sum(c / n * ln(c / n)) / ln(max(n)), 6) AS se, max(n)::BIGINT AS n_valid FROM p GROUP BY 1 HAVING max(n) >= 2""",
    "se_distribution": f"SELECT count(*) AS n, round(avg(se), 6) AS avg_se, sum((se < 0.1)::INT)::BIGINT AS low, sum((se >= 0.1 AND se < 0.5)::INT)::BIGINT AS mid, sum((se >= 0.5)::INT)::BIGINT AS high FROM {SE} WHERE se IS NOT NULL",
    "se_thresholds": f"SELECT lo::DOUBLE AS lo, hi::DOUBLE AS hi, count(*) AS n, round(avg(label::DOUBLE), 6) AS accuracy FROM {SCORED} JOIN (VALUES (0.0, 0.1), (0.0, 0.3), (0.1, 0.5), (0.5, 1.0)) b(lo, hi) ON score BETWEEN lo AND hi GROUP BY 1, 2",
    "judge_pairs": f"SELECT x.l_orderkey AS prompt, count(*) AS pairs, sum((x.l_returnflag = y.l_returnflag)::INT)::BIGINT AS equal FROM {POS} x JOIN {POS} y ON x.l_orderkey = y.l_orderkey AND x.pos < y.pos GROUP BY 1",
    "judged_clusters": f"""WITH RECURSIVE m AS (SELECT l_orderkey AS prompt, pos AS i, l_quantity AS q FROM {POS}),
e AS (SELECT x.prompt, x.i, y.i AS j FROM m x JOIN m y ON x.prompt = y.prompt AND x.i <> y.i AND abs(x.q - y.q) <= 5),
r(prompt, i, j) AS (SELECT prompt, i, i FROM m UNION SELECT r.prompt, r.i, e.j FROM r JOIN e ON r.prompt = e.prompt AND r.j = e.i)
SELECT prompt, i, min(j) AS cluster FROM r GROUP BY 1, 2""",
    "filter_funnel": f"""WITH f AS (SELECT length(q) BETWEEN 30 AND 2000 AS a, NOT ({SOLUTION}) AS b, {PROBLEM} AS c, NOT ({CHOICE}) AS d FROM {MARKED}),
n AS (SELECT count(*) AS n0, sum(a::INT)::BIGINT AS n1, sum((a AND b)::INT)::BIGINT AS n2, sum((a AND b AND c)::INT)::BIGINT AS n3, sum((a AND b AND c AND d)::INT)::BIGINT AS n4 FROM f)
SELECT 1 AS ord, 'length' AS stage, n1 AS kept, n0 - n1 AS removed FROM n UNION ALL SELECT 2, 'not_solution', n2, n1 - n2 FROM n UNION ALL SELECT 3, 'problem', n3, n2 - n3 FROM n UNION ALL SELECT 4, 'not_choice', n4, n3 - n4 FROM n""",
    "solution_filter": rf"SELECT doc_id, {SOLUTION} AS solution, {PROBLEM} AS problem, {CHOICE} AS choice, length(q) > 150 OR contains(q, chr(10)) AS complex FROM {MARKED}",
    "counts_by_source": "SELECT source, count(*) AS n FROM documents GROUP BY 1",
    "counts_by_lang": "SELECT lang, count(*) AS n FROM documents GROUP BY 1",
    "seeds_capped": "SELECT source, doc_id FROM documents WHERE length(trim(text)) >= 10 QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 10",
    "routed_keep_remove": "SELECT quality = 1 OR doc_id % 2 = 1 AS keep, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM labels JOIN documents USING (doc_id) GROUP BY 1",
    "strict_judgment": "SELECT o_orderkey, o_orderkey % 6 IN (0, 2) AS accept, CASE o_orderkey % 6 WHEN 0 THEN 'ACCEPT' WHEN 1 THEN 'REJECT: wrong' WHEN 2 THEN 'ACCEPT' WHEN 3 THEN 'REJECT: no clear judgment' WHEN 4 THEN 'reject: bad form' ELSE 'REJECT: no clear judgment' END AS reason FROM orders",
    "resume_remaining": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0",
    "best_of_n": f"SELECT * FROM {OUT} QUALIFY row_number() OVER (PARTITION BY input ORDER BY reward DESC, pos) = 1",
    "iterative_dpo": f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY input ORDER BY reward DESC, pos) AS b, row_number() OVER (PARTITION BY input ORDER BY reward, pos) AS w FROM {OUT})
SELECT x.input AS prompt, x.output AS chosen, x.reward AS chosen_reward, y.output AS rejected, y.reward AS rejected_reward FROM r x JOIN r y ON x.input = y.input AND x.b = 1 AND y.w = 1""",
    "reward_zscore": f"SELECT pos, round((reward - avg(reward) OVER ()) / stddev_samp(reward) OVER (), 6) AS z FROM {OUT}",
    "reward_stats": f"SELECT round(avg(reward), 6) AS mean, round(stddev_samp(reward), 6) AS std FROM {OUT}",
    "csft_prompt": f"SELECT pos, input || ' <rm_score>: ' || floor(reward)::BIGINT || '.25 ' AS input FROM {OUT}",
    "majority_vote": f"SELECT input, output, count(*) AS votes FROM {OUT} GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY input ORDER BY count(*) DESC, min(pos)) = 1",
    "pass_at_k": f"WITH e AS (SELECT o_orderpriority, l_orderkey, max(correct::INT::DOUBLE) AS b, avg(correct::INT::DOUBLE) AS m FROM {GRADED} GROUP BY 1, 2) SELECT o_orderpriority, round(avg(b), 6) AS pass_n, round(avg(m), 6) AS pass_1 FROM e GROUP BY 1",
    "avg_at_n": f"WITH e AS (SELECT o_orderpriority, l_orderkey, max(correct::INT) AS b, avg(correct::INT::DOUBLE) AS m FROM {GRADED} GROUP BY 1, 2) SELECT o_orderpriority, count(*) AS total, sum(b)::BIGINT AS any_correct, round(avg(m), 6) AS avg_accuracy FROM e GROUP BY 1",
    "greedy_accuracy": f"SELECT o_orderpriority, sum(correct::INT)::BIGINT AS correct, count(*) AS total, round(avg(correct::INT::DOUBLE), 6) AS accuracy FROM {GRADED} GROUP BY 1",
    "accuracy_pivot": f"SELECT o_orderpriority, " + ", ".join(f"coalesce(printf('%.1f', round(avg(correct::INT::DOUBLE) FILTER (o_orderstatus = '{v}') * 100, 1)), '--') AS c{i}" for i, v in enumerate("FOPX")) + f" FROM {GRADED} GROUP BY 1",
    "report_lines": "SELECT o_orderkey, '[' || CASE WHEN o_orderstatus = 'F' THEN 'O' ELSE 'X' END || '] #' || left(lpad(o_orderkey::VARCHAR, greatest(3, length(o_orderkey::VARCHAR))::INT, ' '), 3) || '  gt=' || o_orderstatus || '  pred=' || o_orderpriority AS line FROM orders",
    "dynamic_filtering": f"SELECT l_orderkey, count(*) AS n, round(avg(correct::INT::DOUBLE), 6) AS mean FROM {KEPT} GROUP BY 1",
    "refill_accepted": f"SELECT l_orderkey, count(*) AS n FROM {KEPT} WHERE l_orderkey IN (SELECT DISTINCT l_orderkey FROM {KEPT} ORDER BY 1 LIMIT 20) GROUP BY 1",
    "group_baselines": f"""WITH g AS (SELECT l_orderkey, pos, l_discount AS x, count(*) OVER w AS n, sum(l_discount) OVER w AS s, avg(l_discount) OVER w AS m, stddev_samp(l_discount) OVER w AS sd FROM {POS} WINDOW w AS (PARTITION BY l_orderkey))
SELECT l_orderkey, pos, round(CASE WHEN n > 1 THEN x - (s - x) / (n - 1) END, 6) AS rloo, round(x - m, 6) AS centred, CASE WHEN sd > 1e-6 THEN round((x - m) / (sd + 1e-9), 4) END AS normed, round(sd, 6) AS group_std FROM g""",
    "return_to_go": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 4) AS togo FROM events",
    "gae": f"""WITH e AS (SELECT user_id, p, value FROM {EV}),
d AS (SELECT user_id, p, value + 0.9 * coalesce(lead(value / 2) OVER (PARTITION BY user_id ORDER BY p), 0) - value / 2 AS d FROM e)
SELECT a.user_id, a.p::INT AS p, round(sum(power(0.72, b.p - a.p) * b.d), 5) AS advantage FROM d a JOIN d b ON a.user_id = b.user_id AND b.p >= a.p GROUP BY 1, 2""",
    "whitened_advantages": f"""WITH s AS (SELECT avg(l_discount) AS m, greatest(var_pop(l_discount), 1e-8) AS v FROM lineitem WHERE l_returnflag <> 'N')
SELECT l_orderkey, pos, round((l_discount - m) / sqrt(v), 5) AS a FROM {POS}, s""",
    "kl_estimators": "WITH x AS (SELECT l_orderkey, pos, -l_quantity / 10 + l_discount * 20 AS d FROM " + POS + f") SELECT l_orderkey, pos, round({_cl('d', -10, 10)}, 6) AS k1, round({_cl('d * d / 2', -10, 10)}, 6) AS k2, round({_cl('exp(-d) - 1 + d', -10, 10)}, 6) AS k3 FROM x",
    "length_penalties": f"SELECT l_orderkey, pos, round({OVER}, 6) AS overlong, round(CASE WHEN l_returnflag = 'R' THEN {OVER} * 0.5 ELSE {OVER} END, 6) AS both FROM {POS}",
    "terminal_reward": f"""WITH x AS (SELECT l_orderkey, pos, l_tax, l_returnflag <> 'N' AS m, max(l_discount) OVER (PARTITION BY l_orderkey) AS r FROM {POS}),
y AS (SELECT *, max(CASE WHEN m THEN pos END) OVER (PARTITION BY l_orderkey) AS last FROM x)
SELECT l_orderkey, pos, round(-0.1 * l_tax + CASE WHEN pos = last THEN r ELSE 0 END, 6) AS reward FROM y""",
    "auroc": f"""WITH o AS (SELECT *, sum(label) OVER (ORDER BY score DESC, pos) AS tp FROM {SCORED})
SELECT round(sum((1 - label) * tp)::DOUBLE / (sum(label) * sum(1 - label))::DOUBLE, 6) AS auroc FROM o""",
    "roc_points": f"""SELECT row_number() OVER (ORDER BY score DESC, pos)::INT AS rank, round(sum(label) OVER (ORDER BY score DESC, pos) / sum(label) OVER (), 6) AS tpr, round(sum(1 - label) OVER (ORDER BY score DESC, pos) / sum(1 - label) OVER (), 6) AS fpr FROM {SCORED}""",
    "binned_accuracy": f"WITH b AS (SELECT least(floor(score * 10), 9)::BIGINT AS bin, count(*) AS n, avg(label::DOUBLE) AS a FROM {SCORED} GROUP BY 1) SELECT bin, n, round(a, 6) AS accuracy, round(sqrt(a * (1 - a) / n), 6) AS stderr FROM b",
    "class_summary": f"SELECT label, count(*) AS n, round(avg(score), 6) AS mean, round(median(score), 6) AS median, round(min(score), 6) AS least, round(max(score), 6) AS most FROM {SCORED} GROUP BY 1",
    "reward_histogram": """WITH v AS (SELECT unnest(embedding)::DOUBLE * 20 AS v FROM embeddings), b AS (SELECT least(floor((v + 10) / 2), 9)::BIGINT AS bin, count(*) AS n FROM v WHERE v BETWEEN -10 AND 10 GROUP BY 1)
SELECT bin, n, round(n / (sum(n) OVER () * 2.0), 6) AS density FROM b""",
    "boxed_extract": rf"SELECT p_partkey, CASE WHEN p_partkey % 11 <> 0 THEN '\frac{{' || p_size || '}}{{' || p_partkey % 7 + 1 || '}}' END AS boxed FROM part",
    "gsm8k": "SELECT p_partkey, (p_size * 2)::VARCHAR AS label, 'total ' || p_size * 2 AS cot FROM part",
    "think_strip": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_brand ELSE p_type END AS answer FROM part",
    "numeric_grade": """WITH x AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size / 100.0 WHEN 2 THEN 1000 END::DOUBLE AS p, CASE p_partkey % 3 WHEN 0 THEN p_size WHEN 1 THEN 1000 END::DOUBLE AS r FROM part)
SELECT p_partkey, CASE WHEN p IS NULL OR r IS NULL THEN p IS NULL AND r IS NULL ELSE abs(p - r) <= 1e-4 * greatest(abs(p), abs(r)) OR abs(p - r / 100) <= 1e-4 * greatest(abs(p), abs(r / 100)) OR abs(p - r * 100) <= 1e-4 * greatest(abs(p), abs(r * 100)) END AS equal FROM x""",
    "tuple_grade": "SELECT p_partkey, p_partkey % 3 = p_partkey % 2 AS equal FROM part",
    "extracted_answers": rf"SELECT p_partkey, CASE WHEN p_partkey % 11 <> 0 THEN '\frac{{' || p_size || '}}{{' || p_partkey % 7 + 1 || '}}' ELSE '\frac{{' || p_size || '}}{{' || p_partkey % 7 + 1 || '}}end' END AS answer FROM part",
    "intervals": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '-oo' WHEN 1 THEN '-oo' WHEN 2 THEN '1' END AS lo, CASE WHEN p_partkey % 4 < 3 THEN false END AS lo_closed, CASE WHEN p_partkey % 4 < 3 THEN p_size::VARCHAR END AS hi, CASE WHEN p_partkey % 4 < 3 THEN true END AS hi_closed FROM part",
    "translate_roundtrip": "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN reverse('中' || text) ELSE text END AS question, lang AS answer FROM documents",
    "sft_prefixes": "WITH p AS (SELECT *, coalesce(sum(length(text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, row_number() OVER w - 1 AS k FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, start, start + length(text) - 1 AS stop, k::INT AS turns_before FROM p WHERE role = 'assistant'",
    "multi_turn_mask": "SELECT conv_id, sum(length(text) % 7 + 1)::BIGINT AS total, sum(CASE WHEN role = 'assistant' THEN length(text) % 7 + 1 ELSE 0 END)::BIGINT AS set FROM conversations GROUP BY 1 HAVING bool_or(role = 'assistant')",
    "token_length_filter": "SELECT lang, count(*) AS n FROM documents WHERE doc_id % 3 > 0 AND doc_id % 3 < 398 AND len(string_split(text, ' ')) > 0 GROUP BY 1",
    "kto_rotation": """WITH b AS (SELECT doc_id, source, ((row_number() OVER (ORDER BY doc_id) - 1) // 8)::BIGINT AS batch FROM labels JOIN documents USING (doc_id))
SELECT doc_id, batch, coalesce(lead(source) OVER (PARTITION BY batch ORDER BY doc_id), first_value(source) OVER (PARTITION BY batch ORDER BY doc_id)) AS mismatched FROM b""",
    "softmax_entropy": """WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE * 4 AS v, unnest(range(0, len(embedding))) AS i FROM embeddings),
z AS (SELECT vec_id, max(v) + ln(sum(exp(v - m))) AS z FROM (SELECT *, max(v) OVER (PARTITION BY vec_id) AS m FROM v) GROUP BY vec_id)
SELECT vec_id, round(any_value(z) - sum(exp(v - z) * v), 6) AS entropy, round(max(v) FILTER (i = label) - any_value(z), 6) AS log_prob FROM v JOIN z USING (vec_id) GROUP BY 1""",
    "kd_loss": """WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) AS i FROM embeddings),
z AS (SELECT vec_id, ln(sum(exp(v))) AS z FROM v GROUP BY 1)
SELECT a.vec_id, round(-sum(exp(b.v - zb.z) * (a.v - za.z)), 6) AS loss FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 AND a.i = b.i JOIN z za ON za.vec_id = a.vec_id JOIN z zb ON zb.vec_id = b.vec_id GROUP BY 1""",
    "topk_logits": "WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) AS i FROM embeddings) SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i)::INT AS rank, i::INT AS id, round(v, 6) AS value FROM v QUALIFY rank <= 5",
    "preference_losses": f"SELECT l_orderkey, pos, round({_dpo(0.0)}, 6) AS dpo, round({_dpo(0.1)}, 6) AS cdpo, round(power((pc - pr) - (rc - rr) - 1, 2), 6) AS ipo, round(-{_sig('(pc - pr - 0.2)')}, 6) AS pairwise, round(CASE WHEN y THEN 1 - 1 / (1 + exp(-(0.5 * (pc - rc) - 0.1))) ELSE 1 - 1 / (1 + exp(-(0.1 - 0.5 * (pc - rc)))) END, 6) AS kto FROM {PREF}",
    "policy_loss": f"SELECT l_orderkey, pos, round(-{FIRST}, 6) AS loss, round(-CASE WHEN {A} < 0 THEN greatest({FIRST}, 3.0 * {A}) ELSE {FIRST} END, 6) AS dual, ({_cl(R, 0.8, 1.2)} * {A} < {R} * {A})::INT::DOUBLE AS clipped, round(0.5 * greatest(power(rc + {_cl('pc - rc', -0.2, 0.2)} - rr, 2), power(pc - rr, 2)), 6) AS value, round(CASE WHEN {R} BETWEEN 0.5 AND 2.0 THEN {R} ELSE 0 END, 6) AS icepop FROM {PREF}",
    "concat_blend": "SELECT doc_id, source, 'clean' AS \"from\" FROM documents WHERE source = 'src1' UNION ALL SELECT doc_id, source, 'augment' FROM documents WHERE source IS DISTINCT FROM 'src1'",
    "char_budget_groups": """WITH RECURSIVE d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
r(source, doc_id, k, used, grp) AS (SELECT source, doc_id, k, n_chars, 0 FROM d WHERE k = 1 UNION ALL
SELECT d.source, d.doc_id, d.k, CASE WHEN used > 0 AND used + n_chars > 6000 THEN n_chars ELSE used + n_chars END, CASE WHEN used > 0 AND used + n_chars > 6000 THEN grp + 1 ELSE grp END FROM r JOIN d ON d.source = r.source AND d.k = r.k + 1)
SELECT source, doc_id, grp::INT AS grp FROM r""",
    "image_filter": "SELECT page_id, page_id % 3 = 0 AS image FROM pages",
    "ordered_topn": "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10",
    "shingle_jaccard_pairs": f"""WITH s0 AS {SHING}, s AS (SELECT min(doc_id) AS doc_id, sh FROM (SELECT doc_id, list_sort(sh) AS sh FROM s0 WHERE len(sh) > 0) GROUP BY sh),
e AS (SELECT doc_id, unnest(sh) AS g FROM s), v AS (SELECT g, i, left(md5(i::VARCHAR || '_' || g), 15) AS h FROM (SELECT DISTINCT g FROM e), range(0, 128) r(i)),
m AS (SELECT doc_id, i, min(h) AS h FROM e JOIN v USING (g) GROUP BY 1, 2), k AS (SELECT doc_id, i // 8 AS band, string_agg(h, ',' ORDER BY i) AS bucket FROM m GROUP BY 1, 2),
p AS (SELECT DISTINCT x.doc_id AS i, y.doc_id AS j FROM k x JOIN k y ON x.band = y.band AND x.bucket = y.bucket AND x.doc_id < y.doc_id),
q AS (SELECT i, j, len(list_intersect(x.sh, y.sh)) AS b, len(x.sh) + len(y.sh) AS n FROM p JOIN s x ON x.doc_id = i JOIN s y ON y.doc_id = j)
SELECT i, j, round(b::DOUBLE / (n - b), 6) AS jaccard FROM q WHERE b::DOUBLE / (n - b) >= 0.7""",
    "minhash_bands": f"""WITH s AS {SHING}, e AS (SELECT doc_id, unnest(sh) AS g FROM s), v AS (SELECT g, i, left(md5(i::VARCHAR || '_' || g), 15) AS h FROM (SELECT DISTINCT g FROM e), range(0, 128) r(i)),
m AS (SELECT doc_id, i, min(h) AS h FROM e JOIN v USING (g) GROUP BY 1, 2)
SELECT doc_id, (i // 8)::INT AS band, md5(string_agg(h, ',' ORDER BY i)) AS bucket FROM m GROUP BY 1, 2 UNION ALL SELECT doc_id, b::INT, md5('') FROM s, range(0, 16) r(b) WHERE coalesce(len(sh), 0) = 0""",
    "metric_lines": "SELECT event_type, 'step=' || count(*) || ' | mean=' || printf('%.3f', round(avg(value), 3)) AS line FROM events GROUP BY 1",
    "json_object_parse": "SELECT event_id, json_extract_string(props, '$.k') IS NOT NULL AS has_k, (length(props) + 2)::INT AS n FROM events",
}

SQL |= {
    "step_status": f"""WITH b AS (SELECT l_orderkey % 16 AS k, avg(l_discount) AS d, avg(l_tax) AS t FROM lineitem GROUP BY 1), w AS (SELECT sum(l_discount * l_quantity) / sum(l_quantity) AS w FROM lineitem)
SELECT round(avg(d), 6) AS discount, round(avg(t), 6) AS tax, round(any_value(w), 6) AS weighted FROM b, w""",
    "replay_cap": "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey DESC LIMIT 100",
    "positional_slice": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 64 OFFSET 128",
    "first_hundredth": "SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey) <= floor(count(*) OVER () * 0.01)",
    "length_imbalance": "WITH o AS (SELECT n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents), p AS (SELECT i % 8 AS p, sum(n_chars)::BIGINT AS n FROM o GROUP BY 1) SELECT min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean FROM p",
    "reward_model_eval": f"WITH b AS (SELECT l_orderkey % 32 AS k, avg((pc > pr)::INT::DOUBLE) AS a, avg(-{_sig('(pc - pr)')}) AS l FROM {PREF} GROUP BY 1) SELECT round(avg(a), 6) AS acc, round(avg(l), 6) AS loss FROM b",
    "adaptive_kl": "SELECT o_orderkey, round(0.1::DOUBLE * exp(sum(ln(1 + least(greatest(o_totalprice / 100000 - 1, -0.2), 0.2) * 64 / 10000.0)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)), 6) AS coefficient FROM orders",
    "soft_labels": f"SELECT l_orderkey, pos, round(-(CASE WHEN y THEN 0.9 ELSE 0.2 END::DOUBLE * {_sig('(pc - pr)')} + (1 - CASE WHEN y THEN 0.9 ELSE 0.2 END::DOUBLE) * {_sig('(pr - pc)')}), 6) AS loss FROM {PREF}",
    "inequality_chains": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '1|x|' || p_size WHEN 1 THEN '0|y|' || p_size END AS terms, CASE p_partkey % 3 WHEN 0 THEN '<|≤' WHEN 1 THEN '≤|<' END AS ops FROM part",
    "eval_guard": "SELECT p_partkey, p_partkey % 4 IN (0, 3) AS ok FROM part",
    "translation_residue": "SELECT count(*) AS n, sum((doc_id % 4 = 0)::INT)::BIGINT AS left FROM documents",
    "latex_rows": "SELECT o_orderpriority || " + " || ".join(
        f"' & ' || coalesce(printf('%.1f', round(avg(correct::INT::DOUBLE) FILTER (o_orderstatus = '{v}') * 100, 1)), '--')"
        for v in "FOP"
    ) + f" AS line FROM {GRADED} GROUP BY o_orderpriority",
}

# rounding may leave a negative zero, which is a zero
SQL = {name: re.sub(r"(, [456]\)( END)?) AS ", r"\1 + 0.0::DOUBLE AS ", sql) for name, sql in SQL.items()}

SQL |= {
    "rank_shard": """WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders),
w AS (SELECT o_orderkey, i, n FROM o UNION ALL SELECT o_orderkey, i + n, n FROM o WHERE i + n < ((n + 6) // 7) * 7)
SELECT o_orderkey, (i % 7)::INT AS rank, (i // 7)::BIGINT AS place FROM w""",
    "chunk_shard": """WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, (i // ((n + 5) // 6))::INT AS actor FROM o""",
    "padded_batch": """WITH o AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents), n AS (SELECT count(*) AS n FROM documents)
SELECT i, false AS padding FROM o UNION ALL SELECT n + unnest(range(0, (48 - n % 48) % 48)), true FROM n""",
    "snake_balance": """WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS i, count(*) OVER () AS n FROM documents),
g AS (SELECT *, i // 4 AS g, i % 4 AS a, (n + 3) // 4 AS gs, n - ((n + 3) // 4 - 1) * 4 AS width FROM o),
r AS (SELECT *, CASE WHEN g < gs // 2 THEN a ELSE least(4, n - g * 4) - 1 - a END AS rank, CASE WHEN g < gs // 2 THEN 2 * g WHEN gs - 1 - g < gs // 2 THEN 2 * (gs - 1 - g) + 1 ELSE 2 * (gs // 2) END AS turn FROM g)
SELECT doc_id, rank::INT AS rank, turn::INT AS turn FROM r WHERE rank < width""",
}

SQL |= training.SQL | records.SQL
