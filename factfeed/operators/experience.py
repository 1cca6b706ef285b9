"""Sequence tables for policy training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ExperienceConfig
from ..functions.rows import bind
from .ordering import first_n, number_by_hash, number_by_key, reverse_scan


def prompt_batches(
    questions: DataFrame, max_samples: int, batch_size: int, seed: int, key: str = "qid"
) -> DataFrame:
    """First max_samples records, shuffled by a seeded hash, in aligned batches."""
    picked = first_n(questions, max_samples, key)
    numbered = number_by_hash(picked, "_no", key, seed)
    numbered = numbered.withColumn("batch_id", F.floor(F.col("_no") / batch_size))
    columns = ["_no", key, "question", "titles", "materials", "extra_materials"]
    batch = numbered.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("_b"))
    return batch.select("batch_id", *[F.col(f"_b.{c}").alias(c) for c in columns[1:]])


def micro_batches(seqs: DataFrame, batch_size: int, key: str = "seq_id", buckets: int | None = None) -> DataFrame:
    """Add batch_id and pos (place in the batch) by the order of key."""
    numbered = number_by_key(seqs, "_no", key, buckets)
    return (
        numbered.withColumn("batch_id", F.floor(F.col("_no") / batch_size))
        .withColumn("pos", (F.col("_no") % batch_size).cast("int"))
        .drop("_no")
    )


def _pad_left(ids: Column, width: Column, value: Column) -> Column:
    return F.concat(F.array_repeat(value, width - F.size(ids)), ids)


def _pad_right(ids: Column, width: Column, value: Column) -> Column:
    return F.concat(ids, F.array_repeat(value, width - F.size(ids)))


def end_with_eos(df: DataFrame, eos: int) -> DataFrame:
    """Write the end token into outputs that lack it and take 1 off there.

    Works on padded output_ids and rewards; output_len is the length before
    padding. A row that fills the batch width loses its last token.
    """
    n, width = F.col("output_len"), F.size("output_ids")
    open_end = F.coalesce(F.get("output_ids", n - 1) != eos, F.lit(True)) & (width > 0)
    slot = F.least(n, width - 1)
    return (
        df.withColumn("_open", open_end)
        .withColumn("_slot", slot)
        .withColumn(
            "output_ids",
            F.transform("output_ids", lambda x, i: F.when(F.col("_open") & (i == F.col("_slot")), F.lit(eos)).otherwise(x)),
        )
        .withColumn(
            "rewards",
            F.transform("rewards", lambda x, i: F.when(F.col("_open") & (i == F.col("_slot")), x - 1).otherwise(x)),
        )
        .drop("_open", "_slot")
    )


def padded_samples(batched: DataFrame, pad: int, eos: int) -> DataFrame:
    """Left-pad prompts, right-pad outputs and rewards to the batch maxima.

    batched has (batch_id, pos, prompt_ids, output_ids, rewards); a batch holds
    batch_size rows, so the window partitions are that small.
    """
    w = Window.partitionBy("batch_id")
    df = (
        batched.withColumn("output_len", F.size("output_ids"))
        .withColumn("_in", F.max(F.size("prompt_ids")).over(w))
        .withColumn("_out", F.max(F.size("output_ids")).over(w))
        .withColumn("prompt_ids", _pad_left(F.col("prompt_ids"), F.col("_in"), F.lit(pad)))
        .withColumn("output_ids", _pad_right(F.col("output_ids"), F.col("_out"), F.lit(pad)))
        .withColumn("rewards", _pad_right(F.col("rewards"), F.col("_out"), F.lit(0.0)))
    )
    df = end_with_eos(df, eos).withColumn("sequence", F.concat("prompt_ids", "output_ids"))
    return with_masks(df, pad, eos).drop("_in", "_out", "prompt_ids")


def with_masks(df: DataFrame, pad: int, eos: int) -> DataFrame:
    """Add attention_mask, action_mask and their sums, total_ and response_length.

    Attention goes from the first token that is neither padding nor an end token to
    the end token behind the last one. An action counts if the token before it is
    neither; the first action of an output always counts. A sequence of nothing but
    padding has no attention.
    """

    def real(x: Column) -> Column:
        return (x != pad) & (x != eos)

    places = F.filter(F.transform("sequence", lambda x, i: F.when(real(x), i)), lambda i: i.isNotNull())
    df = bind(df, "_span", F.struct(F.array_min(places).alias("first"), F.array_max(places).alias("last")))
    inside = lambda x, i: F.coalesce(F.col("_span.first") <= i, F.lit(False)) & (i <= F.col("_span.last") + 1)
    acts = lambda x, i: (i == 0) | real(F.get("output_ids", i - 1))
    one_if = lambda test: lambda x, i: F.when(test(x, i), 1).otherwise(0)
    total = lambda name: F.aggregate(name, F.lit(0), lambda acc, m: acc + m)
    return (
        df.withColumn("attention_mask", F.transform("sequence", one_if(inside)))
        .withColumn("action_mask", F.transform("output_ids", one_if(acts)))
        .withColumn("total_length", total("attention_mask"))
        .withColumn("response_length", total("action_mask"))
        .drop("_span")
    )


def packed_samples(batched: DataFrame) -> DataFrame:
    """One row per batch: all prompts and outputs end to end, without padding."""
    rows = batched.groupBy("batch_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "prompt_ids", "output_ids", "rewards"))).alias("_b")
    )
    ids = F.flatten(F.transform("_b", lambda r: F.concat(r["prompt_ids"], r["output_ids"])))
    length = lambda r: F.size(r["prompt_ids"]) + F.size(r["output_ids"])
    return rows.select(
        "batch_id",
        ids.alias("sequence"),
        F.flatten(F.transform("_b", lambda r: F.array_repeat(r["pos"] + 1, length(r)))).alias("segments"),
        F.transform("_b", length).alias("seq_lens"),
        F.transform("_b", lambda r: F.greatest(F.size(r["output_ids"]), F.lit(1))).alias("num_actions"),
        F.flatten(F.col("_b.rewards")).alias("rewards"),
    )


def approx_kl(logp: Column, ref_logp: Column, mask: Column | None = None, k3: bool = False) -> Column:
    """Per-token log ratio, masked; or its non-negative k3 form."""
    ratio = logp - ref_logp
    if mask is not None:
        ratio = ratio * mask
    return F.exp(ratio) - 1 - ratio if k3 else ratio


def sequence_kl(df: DataFrame, packed: bool = False) -> DataFrame:
    """Mean KL per sequence: masked for padded rows, plain for packed ones."""
    if packed:
        mean = F.avg("kl")
    else:
        mean = F.try_divide(F.sum(F.col("kl") * F.col("mask")), F.sum("mask"))
    return df.groupBy("seq_id").agg(mean.alias("kl"))


def shaped_reward(
    reward: Column, kl: Column, kl_coef: float, clip: tuple[float, float] | None = None
) -> Column:
    """Clipped token reward minus the KL penalty."""
    if clip:
        reward = F.greatest(F.lit(float(clip[0])), F.least(F.lit(float(clip[1])), reward))
    return reward - F.lit(max(float(kl_coef), 0.0)) * kl


def _masked(name: str, mask: str | None) -> Column:
    return F.col(name) * F.col(mask) if mask else F.col(name)


def gae(
    df: DataFrame,
    gamma: float,
    lambd: float,
    value: str = "value",
    reward: str = "shaped",
    mask: str | None = "mask",
    chunk: int = 256,
) -> DataFrame:
    """Add advantage and return per token of (seq_id, tok_no).

    advantage[t] = r[t] + gamma * v[t+1] - v[t] + gamma * lambd * advantage[t+1]
    with v = 0 behind the end; the return is advantage + value.
    """
    r, v = _masked(reward, mask), _masked(value, mask)
    scanned = reverse_scan(
        df, "seq_id", "tok_no", r, gamma * lambd, "advantage", value=v, weight=gamma, chunk=chunk
    )
    return scanned.withColumn("return", F.col("advantage") + v)


def cumulative_returns(
    df: DataFrame, gamma: float, reward: str = "shaped", mask: str | None = "mask", chunk: int = 256
) -> DataFrame:
    """Discounted reward to go; the advantage is the same number."""
    scanned = reverse_scan(df, "seq_id", "tok_no", _masked(reward, mask), gamma, "return", chunk=chunk)
    return scanned.withColumn("advantage", F.col("return"))


def sequence_summary(df: DataFrame) -> DataFrame:
    """Totals per sequence; prompt_len must be constant within a sequence."""
    return df.groupBy("seq_id").agg(
        F.sum("reward").alias("reward"),
        F.sum("shaped").alias("return"),
        F.sum("mask").cast("long").alias("response_length"),
        (F.max("prompt_len") + F.sum("mask")).cast("long").alias("total_length"),
        F.count(F.lit(1)).alias("num_actions"),
    )


def normalize_advantages(df: DataFrame, eps: float = 1e-8, masked: bool = True) -> DataFrame:
    """(a - mean) / std over the valid tokens of the whole table: those of the mask,
    or all of them."""
    valid = F.when(F.col("mask") > 0, F.col("advantage")) if masked else F.col("advantage")
    stats = df.agg(F.struct(F.avg(valid).alias("mean"), F.var_pop(valid).alias("var")).alias("s"))
    return (
        df.withColumn("_s", stats.scalar())
        .withColumn(
            "advantage",
            (F.col("advantage") - F.col("_s.mean")) / F.sqrt(F.col("_s.var") + F.lit(eps)),
        )
        .drop("_s")
    )


def with_kl_and_reward(rollouts: DataFrame, config: ExperienceConfig) -> DataFrame:
    kl = approx_kl(F.col("logp"), F.col("ref_logp"), F.col("mask"), config.k3)
    return rollouts.withColumn("kl", kl).withColumn(
        "shaped", shaped_reward(F.col("reward"), F.col("kl"), config.kl_coef, config.clip)
    )


def padded_tokens(padded: DataFrame) -> DataFrame:
    """Token rows of padded sequences, with their rewards (the end-token penalty is
    in them), action mask, and the model's numbers where it gave some, else 0.

    padded is what padded_samples gives, with logp, ref_logp and value arrays.
    """
    kept = ["seq_id", "batch_id", "pos", "total_length", "response_length", "logp", "ref_logp", "value"]
    rows = padded.select(*kept, F.posexplode(F.arrays_zip("output_ids", "rewards", "action_mask")).alias("tok_no", "_t"))
    number = lambda name: F.coalesce(F.get(name, F.col("tok_no")), F.lit(0.0)).alias(name)
    return rows.select(
        *kept[:5],
        "tok_no",
        F.col("_t.output_ids").alias("token"),
        F.col("_t.rewards").alias("reward"),
        F.col("_t.action_mask").alias("mask"),
        *[number(n) for n in ("logp", "ref_logp", "value")],
    )


def _scan_back(x: Column, v: Column, decay: float, weight: float) -> Column:
    """y[t] = x[t] + weight * v[t+1] - v[t] + decay * y[t+1] over two arrays of one
    sequence, from its end."""

    def step(acc: Column, z: Column) -> Column:
        y = z["x"] + F.lit(float(weight)) * acc["v"] - z["v"] + F.lit(float(decay)) * acc["y"]
        return F.struct(y.alias("y"), z["v"].alias("v"), F.array_append(acc["ys"], y).alias("ys"))

    zero = F.struct(F.lit(0.0).alias("y"), F.lit(0.0).alias("v"), F.array().cast("array<double>").alias("ys"))
    pairs = F.reverse(F.zip_with(x, v, lambda a, b: F.struct(a.alias("x"), b.alias("v"))))
    return F.reverse(F.aggregate(pairs, zero, step)["ys"])


def packed_experience(batched: DataFrame, config: ExperienceConfig) -> DataFrame:
    """One row per micro-batch, its sequences end to end: kl, shaped rewards,
    advantages and returns of all actions in one array each, and one struct of
    totals per sequence in info.

    The scan starts anew at every sequence of the row. Nothing is masked, there is
    no end-token penalty, and no shuffle follows the one that fills the batches.
    batched has (batch_id, pos, seq_id, prompt_ids, output_ids, rewards, logp,
    ref_logp, value); a batch holds batch_size rows.
    """
    names = ["pos", "seq_id", "prompt_ids", "output_ids", "rewards", "logp", "ref_logp", "value"]
    rows = batched.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("_b"))

    def with_kl(r: Column) -> Column:
        kl = F.zip_with(r["logp"], r["ref_logp"], lambda a, b: approx_kl(a, b, None, config.k3))
        return F.struct(*[r[n].alias(n) for n in names], kl.alias("kl"))

    def with_reward(r: Column) -> Column:
        shaped = F.zip_with(r["rewards"], r["kl"], lambda x, k: shaped_reward(x, k, config.kl_coef, config.clip))
        return F.struct(*[r[n].alias(n) for n in (*names, "kl")], shaped.alias("shaped"))

    def with_advantage(r: Column) -> Column:
        if config.estimator == "gae":
            advantage = _scan_back(r["shaped"], r["value"], config.gamma * config.lambd, config.gamma)
        else:
            nothing = F.transform(r["shaped"], lambda x: F.lit(0.0))
            advantage = _scan_back(r["shaped"], nothing, config.gamma, 0.0)
        return F.struct(*[r[n].alias(n) for n in (*names, "kl", "shaped")], advantage.alias("advantage"))

    for step in (with_kl, with_reward, with_advantage):
        rows = bind(rows, "_b", F.transform("_b", step))

    def returns(r: Column) -> Column:
        if config.estimator == "gae":
            return F.zip_with(r["advantage"], r["value"], lambda a, v: a + v)
        return r["advantage"]

    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)

    def info(r: Column) -> Column:
        n = F.size(r["output_ids"])
        return F.struct(
            r["seq_id"].alias("seq_id"),
            F.when(n > 0, total(r["kl"]) / n).alias("kl"),
            total(r["rewards"]).alias("reward"),
            total(r["shaped"]).alias("return"),
            F.greatest(n, F.lit(1)).alias("response_length"),
            (F.size(r["prompt_ids"]) + n).alias("total_length"),
            n.alias("n_actions"),
        )

    every = lambda name: F.flatten(F.transform("_b", lambda r: r[name])).alias(name)
    return rows.select(
        "batch_id",
        *[every(n) for n in ("kl", "shaped", "advantage")],
        F.flatten(F.transform("_b", returns)).alias("return"),
        F.transform("_b", info).alias("info"),
    )


def normalize_packed(packed: DataFrame, eps: float = 1e-8) -> DataFrame:
    """(a - mean) / std over all actions of all rows, inside the arrays."""
    each = packed.select(F.explode("advantage").alias("a"))
    stats = each.agg(F.struct(F.avg("a").alias("mean"), F.var_pop("a").alias("var")).alias("s"))
    scaled = F.transform("advantage", lambda a: (a - F.col("_s.mean")) / F.sqrt(F.col("_s.var") + F.lit(eps)))
    return packed.withColumn("_s", stats.scalar()).withColumn("advantage", scaled).drop("_s")


def packed_tokens(packed: DataFrame) -> DataFrame:
    """Long form: one row per action, with its sequence and place in it."""
    owner = F.flatten(F.transform("info", lambda i: F.transform(F.sequence(F.lit(0), F.greatest(i["n_actions"], F.lit(1)) - 1), lambda t: F.struct(i["seq_id"].alias("seq_id"), t.alias("tok_no"), (i["n_actions"] > 0).alias("is_action")))))
    owner = F.filter(owner, lambda o: o["is_action"])
    fields = ["kl", "shaped", "advantage", "return"]
    rows = packed.select("batch_id", F.explode(F.arrays_zip(owner.alias("owner"), *fields)).alias("_t"))
    return rows.select("batch_id", "_t.owner.seq_id", "_t.owner.tok_no", *[f"_t.{f}" for f in fields])
