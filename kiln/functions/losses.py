"""Loss arithmetic on columns and array columns of log-probabilities, rewards and logits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_sigmoid(x: Column) -> Column:
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def kl(logp: Column, base: Column, estimator: str = "k1") -> Column:
    d = logp - base
    found = {"k1": d, "k2": d * d / 2, "k3": F.exp(-d) - 1 + d}[estimator]
    return clamp(found, -10.0, 10.0)


def pairwise(chosen: Column, rejected: Column, margin: Column | float = 0.0) -> Column:
    return -log_sigmoid(chosen - rejected - margin)


def log_exp(chosen: Column, rejected: Column) -> Column:
    return -log_sigmoid(chosen - rejected)


def dpo(
    pc: Column, pr: Column, rc: Column, rr: Column, beta: float, smoothing: float = 0.0, ipo: bool = False
) -> Column:
    """Preference loss of policy and reference log-probabilities of the chosen and the rejected answer."""
    logits = (pc - pr) - (rc - rr)
    if ipo:
        return (logits - 1 / (2 * beta)) ** 2
    return -log_sigmoid(beta * logits) * (1 - smoothing) - log_sigmoid(-beta * logits) * smoothing


def kto(
    reward: Column, kl_mean: Column, is_chosen: Column, chosen_weight: float = 1.0, rejected_weight: float = 1.0
) -> Column:
    """reward: beta times the log-ratio. kl_mean is held at 0 from below."""
    k = F.greatest(kl_mean, F.lit(0.0))
    sigmoid = lambda x: 1 / (1 + F.exp(-x))
    return F.when(
        is_chosen, chosen_weight * (1 - sigmoid(reward - k))
    ).otherwise(rejected_weight * (1 - sigmoid(k - reward)))


def policy(ratio: Column, advantage: Column, low: float = 0.2, high: float = 0.2, dual: float | None = None) -> Column:
    """Clipped policy loss of one token."""
    first = F.least(ratio * advantage, clamp(ratio, 1 - low, 1 + high) * advantage)
    if dual is None:
        return -first
    return -F.when(advantage < 0, F.greatest(first, dual * advantage)).otherwise(first)


def clipped(ratio: Column, advantage: Column, low: float = 0.2, high: float = 0.2) -> Column:
    return (clamp(ratio, 1 - low, 1 + high) * advantage < ratio * advantage).cast("double")


def importance(log_ratio: Column, low: float, high: float, kind: str = "tis") -> Column:
    """Correction factor of a token: clamped, or zero outside the bounds."""
    ratio = F.exp(log_ratio)
    return clamp(ratio, low, high) if kind == "tis" else F.when(ratio.between(low, high), ratio).otherwise(F.lit(0.0))


def value(v: Column, old: Column, returns: Column, eps: float | None = None) -> Column:
    plain = (v - returns) ** 2
    if eps is None:
        return 0.5 * plain
    return 0.5 * F.greatest((old + clamp(v - old, -eps, eps) - returns) ** 2, plain)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def log_sum_exp(x: Column) -> Column:
    """Stable. Empty arrays, and such with nothing but -inf, give -inf."""
    top = F.array_max(x)
    low = F.coalesce(top, F.lit(float("-inf"))) == float("-inf")
    return F.when(low & x.isNotNull(), float("-inf")).otherwise(
        top + F.ln(total(F.transform(x, lambda v: F.exp(v - top))))
    )


def softmax(x: Column) -> Column:
    z = log_sum_exp(x)
    return F.transform(x, lambda v: F.exp(v - z))


def entropy(logits: Column) -> Column:
    z = log_sum_exp(logits)
    return z - total(F.transform(logits, lambda v: F.exp(v - z) * v))


def cross_entropy(student: Column, teacher: Column) -> Column:
    """- sum p_teacher log p_student over the vocabulary."""
    p, z = softmax(teacher), log_sum_exp(student)
    return -total(F.zip_with(p, student, lambda a, b: a * (b - z)))


def log_prob(logits: Column, token: Column) -> Column:
    return F.get(logits, token) - log_sum_exp(logits)


def top_k(logits: Column, k: int) -> Column:
    """The k largest (value, id), ties to the smaller id."""
    pairs = F.array_sort(F.transform(logits, lambda v, i: F.struct((-v).alias("down"), i.alias("id"))))
    return F.transform(F.slice(pairs, 1, k), lambda p: F.struct((-p["down"]).alias("value"), p["id"].alias("id")))


def masked_mean(x: Column, mask: Column) -> Column:
    """Null where the mask is empty."""
    return F.try_divide(
        total(F.zip_with(x, mask, lambda a, m: a * m)), total(F.transform(mask, lambda m: m.cast("double")))
    )


def where(mask: Column, x: Column) -> Column:
    return F.zip_with(x, mask, lambda a, m: F.when(m.cast("boolean"), a).otherwise(0.0))


def discounted(rewards: Column, gamma: float, mask: Column | None = None) -> Column:
    """Return to go at each position of an array; masked rewards count as 0."""
    own = rewards if mask is None else where(mask, rewards)
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("out"))
    add = lambda s, r: F.struct(
        (r + gamma * s["sum"]).alias("sum"), F.array_append(s["out"], r + gamma * s["sum"]).alias("out")
    )
    return F.reverse(F.aggregate(F.reverse(own), start, add, lambda s: s["out"]))


def gae(values: Column, rewards: Column, gamma: float, lam: float, mask: Column | None = None) -> Column:
    """Generalised advantages at each position; the value behind the last one is 0; masked values and rewards count as 0."""
    v, r = (values, rewards) if mask is None else (where(mask, values), where(mask, rewards))
    steps = F.zip_with(
        F.arrays_zip(r.alias("r"), v.alias("v")),
        F.slice(F.array_append(v, F.lit(0.0)), 2, F.size(v)),
        lambda s, n: s["r"] + gamma * n - s["v"],
    )
    return discounted(steps, gamma * lam)


def gae_returns(advantages: Column, values: Column, mask: Column | None = None) -> Column:
    return F.zip_with(advantages, values if mask is None else where(mask, values), lambda a, v: a + v)


def sequence_ratio(log_ratio: Column, mask: Column) -> Column:
    """exp of the masked mean of a sequence's log-ratios at its masked positions, 0 elsewhere: one ratio a sequence."""
    ratio = F.exp(masked_mean(log_ratio, mask))
    return F.transform(mask, lambda m: F.when(m.cast("boolean"), ratio).otherwise(0.0))


def sequence_gate(log_ratio: Column, mask: Column, low: float, high: float) -> Column:
    """Importance factors exp(log_ratio), all 0 if the sequence's geometric mean lies outside the bounds."""
    inside = F.exp(masked_mean(log_ratio, mask)).between(low, high)
    return F.transform(log_ratio, lambda x: F.when(inside, F.exp(x)).otherwise(0.0))


def kd_position(student: Column, teacher: Column, label: Column, ignore: int = -100) -> Column:
    """Distillation cross-entropy of one position; infinite student logits add nothing; null where the label is ignored."""
    p, z = softmax(teacher), log_sum_exp(student)
    parts = F.zip_with(p, student, lambda a, b: F.when(F.abs(b) == float("inf"), 0.0).otherwise(a * (b - z)))
    return F.when(label != ignore, -total(parts))


def top_cross_entropy(student: Column, values: Column, ids: Column) -> Column:
    """- sum p_teacher log p_student over the teacher's top logits, its softmax renormalised over them."""
    z = log_sum_exp(student)
    return -total(F.zip_with(softmax(values), ids, lambda p, i: p * (F.get(student, i) - z)))


def surer(student: Column, values: Column, alpha: float = 5.0) -> Column:
    """sigmoid(alpha (student's entropy - teacher's entropy over its top logits))."""
    return 1 / (1 + F.exp(-alpha * (entropy(student) - entropy(values))))


def hard_label(logits: Column, index: Column) -> Column:
    """Cross-entropy of logits with the index of the right one."""
    return log_sum_exp(logits) - F.get(logits, index)


def argmax(x: Column) -> Column:
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def beyond(logps: Column, start: Column) -> Column:
    """An answer's log-probabilities: those from a start on, which is the prompt's length."""
    return F.slice(logps, start + 1, F.greatest(F.size(logps) - start, F.lit(0)))


def step_loss(
    policy_loss: Column, kl_: Column, entropy_: Column, beta: float, c: float, rows: Column, step_rows: Column
) -> Column:
    """(policy + beta KL - c entropy), scaled by a micro-batch's share of its step's rows."""
    return (policy_loss + beta * kl_ - c * entropy_) * rows / step_rows


def soft_label(logit_good: Column, logit_bad: Column, label: Column) -> Column:
    """Cross-entropy of a two-way prediction with a label in [0, 1]."""
    d = logit_good - logit_bad
    return -(label * log_sigmoid(d) + (1 - label) * log_sigmoid(-d))
