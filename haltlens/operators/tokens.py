"""Token accounting: components per step, context of each call, what a stop saves. Windows on one partitioning by trajectory."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from haltlens.functions.scalars import legacy_tokens

CONTEXT = ("action", "feedback", "assistant")
PARTS = (*CONTEXT, "thought")


def count_tokens(texts: str | Column, counter: Callable[[], Callable[[str], int]], *, direct: int = 2_000_000, chunk: int = 1_000_000, exact: int = 20_000_000, windows: int = 5, sample: int = 100_000) -> Column:
    """Tokens of a text column by a counter that each worker makes once. Up to ``direct`` characters at once, up to ``exact`` in chunks, above from evenly spread windows."""

    def one(n: Callable[[str], int], t: str) -> int:
        if len(t) <= direct:
            return n(t)
        if len(t) <= exact:
            return sum(n(t[i : i + chunk]) for i in range(0, len(t), chunk))
        starts = [round(k * (len(t) - sample) / max(1, windows - 1)) for k in range(windows)]
        seen = sum(n(t[s : s + sample]) for s in starts)
        return -(-len(t) * seen // (windows * sample))

    @F.pandas_udf("long")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        n = counter()
        for p in parts:
            yield p.map(lambda t: 0 if t is None else one(n, t)).astype("int64")

    return run(texts)


def method_of(texts: str | Column, *, direct: int = 2_000_000, exact: int = 20_000_000) -> Column:
    """How ``count_tokens`` counts a text."""
    n = F.length(texts)
    return F.when(n <= direct, "tokenizer_exact").when(n <= exact, "tokenizer_chunked_exact").otherwise("tokenizer_sampled_estimate")


def method_summary(counts: DataFrame, by: tuple[str, ...] = ("model_id", "method")) -> DataFrame:
    """Rows, trajectories and tokens by model and method."""
    return counts.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("traj_id").alias("trajectories"), F.sum("context_tokens").cast("long").alias("context_tokens"), F.max("context_tokens").alias("longest"))


def full_prefix_tokens(steps: DataFrame, counter: Callable[[], Callable[[str], int]], *, text: str = "text") -> DataFrame:
    """traj_id, model_id, prefix_step_idx, context_tokens, method: the whole text up to each step, non-empty parts a line each, is counted anew; as exact, and as dear, as it gets."""
    upto = W.partitionBy("traj_id").orderBy("prefix_step_idx").rowsBetween(W.unboundedPreceding, 0)
    said = F.array_join(F.collect_list(F.when(F.col(text) != "", F.col(text))).over(upto), "\n")
    rows = steps.select("traj_id", "model_id", "prefix_step_idx", said.alias("_context"))
    return rows.select("traj_id", "model_id", "prefix_step_idx", count_tokens("_context", counter).alias("context_tokens"), method_of("_context").alias("method"))


def incremental_pieces(steps: DataFrame, *, border: str, text: str = "text") -> DataFrame:
    """traj_id, model_id, prefix_step_idx and what is to be counted at each step: ``_settled`` and ``_closed`` once for good, ``_open`` for this step alone.

    ``border`` is a pattern (of no width, by looking round) of places that no token spans, whatever text surrounds them. Between the first and the last such place of a
    step's part nothing can change any more; what is before the first closes the stretch that earlier steps left open; what is after the last stays open. A
    part without such a place lengthens the open stretch. All in built-in expressions over one exchange by trajectory."""
    order = W.partitionBy("traj_id").orderBy("prefix_step_idx")
    said = F.coalesce(F.col(text) != "", F.lit(False))
    earlier = F.coalesce(F.max(said.cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) > 0
    s = steps.select("traj_id", "model_id", "prefix_step_idx", F.when(said, F.concat(F.when(earlier, "\n").otherwise(""), F.col(text))).otherwise("").alias("_piece"))
    s = s.withColumn("_cut", F.col("_piece").rlike(border))
    upto = lambda ungreedy: F.length(F.regexp_extract("_piece", f"(?s)^(.*{ungreedy})(?:{border})", 1))
    s = s.withColumns({"_first": F.when(F.col("_cut"), upto("?")), "_last": F.when(F.col("_cut"), upto(""))})
    s = s.withColumn("_run", F.sum(F.col("_cut").cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    tail = F.when(F.col("_cut"), F.substr("_piece", F.col("_last") + 1)).otherwise(F.col("_piece"))
    run = W.partitionBy("traj_id", "_run").orderBy("prefix_step_idx").rowsBetween(W.unboundedPreceding, 0)
    s = s.withColumn("_open", F.array_join(F.collect_list(tail).over(run), ""))
    before = F.coalesce(F.lag("_open").over(order), F.lit(""))
    return s.select(
        "traj_id", "model_id", "prefix_step_idx", "_open",
        F.when(F.col("_cut"), F.substr("_piece", F.col("_first") + 1, F.col("_last") - F.col("_first"))).alias("_settled"),
        F.when(F.col("_cut"), F.concat(before, F.substr("_piece", F.lit(1), F.col("_first")))).alias("_closed"),
    )


def incremental_prefix_tokens(steps: DataFrame, counter: Callable[[], Callable[[str], int]], *, border: str, text: str = "text") -> DataFrame:
    """As ``full_prefix_tokens``, in work linear in the text: only stretches about the borders of steps are tokenized again, all else once.

    Exact if ``border`` holds for the tokenizer (``incremental_pieces``): for words ``(?=\\s)``, for tokenizers that never join a letter to a space after it ``(?<=\\p{L})(?=\\s\\p{L})``.
    A run of steps without any such place is read anew with each of them."""
    p = incremental_pieces(steps, border=border, text=text)
    # stretches as rows, so that one worker function counts them all; only numbers are exchanged after it
    each = F.array(*[F.struct(F.lit(i).alias("kind"), F.col(c).alias("text")) for i, c in enumerate(("_closed", "_settled", "_open"))])
    p = p.select("traj_id", "model_id", "prefix_step_idx", F.explode(each).alias("_s")).filter("_s.kind = 2 OR _s.text <> ''")
    p = p.select("traj_id", "model_id", "prefix_step_idx", F.col("_s.kind").alias("_kind"), count_tokens("_s.text", counter).alias("_n"))
    upto = W.partitionBy("traj_id").orderBy("prefix_step_idx", "_kind").rowsBetween(W.unboundedPreceding, 0)
    done = F.coalesce(F.sum(F.when(F.col("_kind") < 2, F.col("_n"))).over(upto), F.lit(0))
    return p.withColumn("context_tokens", (done + F.col("_n")).cast("long")).filter("_kind = 2").select("traj_id", "model_id", "prefix_step_idx", "context_tokens", F.lit("tokenizer_exact").alias("method"))


MODES = ("model", "component_sum_approx", "chars_per_token")


def token_rows(steps: DataFrame, mode: str, counter: Callable[[], Callable[[str], int]] | None = None) -> DataFrame:
    """traj_id, model_id, prefix_step_idx, context_tokens by one of MODES; all but the last need a counter."""
    if mode not in MODES or (mode != "chars_per_token" and counter is None):
        raise ValueError(f"no way to count tokens by {mode}")
    if mode == "model":
        rows = full_prefix_tokens(steps, counter)
    elif mode == "component_sum_approx":
        counted = steps.withColumns({f"{p}_tokens": count_tokens(f"{p}_text", counter) for p in ("task", *PARTS) if f"{p}_text" in steps.columns})
        rows = prefix_tokens(component_tokens(counted, lambda p: F.col(f"{p}_tokens") if f"{p}_text" in steps.columns else legacy_tokens(f"{p}_chars")))
    else:
        rows = prefix_tokens(component_tokens(steps))
    return rows.select("traj_id", "model_id", "prefix_step_idx", "context_tokens")


def content_digest(steps: DataFrame, key: str = "traj_id") -> DataFrame:
    """key and digest of all that a trajectory's rows hold, whatever their order: their number, and the sum and exclusive or of their hashes."""
    text = F.md5(F.to_json(F.struct(*sorted(steps.columns)), {"ignoreNullFields": "false"}))
    half = lambda at: F.conv(F.substring(text, at, 15), 16, 10).cast("long")
    sums = steps.select(key, half(1).alias("_a"), half(17).alias("_b")).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.bit_xor("_a").alias("x"), F.sum(F.col("_b").cast("decimal(38,0)")).alias("s"))
    return sums.select(key, F.concat_ws("-", F.col("n").cast("string"), F.hex("x"), F.col("s").cast("string")).alias("digest"))


def cached(spark: SparkSession, path: str, steps: DataFrame, count: Callable[[DataFrame], DataFrame], settings: dict, keys: tuple[str, ...] = ("traj_id", "prefix_step_idx"), fresh: bool = False) -> DataFrame:
    """Counts of ``steps`` by way of a cache folder. Shards are kept by a digest of the settings, so that counts made otherwise are never read, and hold with each
    trajectory a digest of what was counted: one that no shard has as it is now is counted, whole, and written as one more shard. A run that was cut off goes on where it ended.
    ``fresh``: with a column that tells which rows were counted by this call."""
    shards = f"{path.rstrip('/')}/{hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:16]}"
    p = spark._jvm.org.apache.hadoop.fs.Path(shards)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    have = [x.getPath().toString() for x in fs.listStatus(p) if fs.exists(x.getPath().suffix("/_SUCCESS"))]
    now, own = content_digest(steps, keys[0]), [keys[0], "digest"]
    lacking = now
    if have:
        lacking = now.join(spark.read.parquet(*have).select(*own).distinct(), own, "left_anti")
    counted = count(steps.join(lacking.select(keys[0]), keys[0], "left_semi")).join(now, keys[0]).select("*", F.lit(json.dumps(settings, sort_keys=True)).alias("settings"))
    shard = f"{shards}/shard-{uuid.uuid4().hex}"
    counted.write.option("compression", "zstd").parquet(shard)
    new = spark.read.parquet(shard).withColumn("fresh", F.lit(True))
    rows = new if not have else spark.read.parquet(*have).withColumn("fresh", F.lit(False)).unionByName(new)
    rows = rows.join(now, own, "left_semi").dropDuplicates([*keys, "digest"]).drop("settings", "digest")
    return rows if fresh else rows.drop("fresh")


def compacted(spark: SparkSession, path: str, steps: DataFrame, settings: dict, keys: tuple[str, ...] = ("traj_id", "prefix_step_idx")) -> int:
    """Puts the shards of ``settings`` into one that holds what is valid for ``steps``, then deletes them; how many there were. Readers that began before it keep to the shards
    they listed, so that it runs between runs."""
    shards = f"{path.rstrip('/')}/{hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:16]}"
    p = spark._jvm.org.apache.hadoop.fs.Path(shards)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    have = [x.getPath() for x in fs.listStatus(p) if fs.exists(x.getPath().suffix("/_SUCCESS"))] if fs.exists(p) else []
    if len(have) > 1:
        rows = spark.read.parquet(*[x.toString() for x in have]).join(content_digest(steps, keys[0]), [keys[0], "digest"], "left_semi")
        rows.dropDuplicates([*keys, "digest"]).write.option("compression", "zstd").parquet(f"{shards}/shard-{uuid.uuid4().hex}")
        for x in have:
            fs.delete(x, True)
    return len(have)


def component_tokens(steps: DataFrame, count: Callable[[str], Column] | None = None) -> DataFrame:
    """<part>_tokens and <part>_nonempty from <part>_chars; by four characters a token unless ``count`` says otherwise."""
    count = count or (lambda p: legacy_tokens(f"{p}_chars"))
    return steps.withColumns({f"{p}_tokens": count(p) for p in ("task", *PARTS)} | {f"{p}_nonempty": (F.col(f"{p}_chars") > 0).cast("long") for p in PARTS})


def prefix_tokens(steps: DataFrame, *, newline_tokens: int = 1) -> DataFrame:
    """Per step: tokens of the call's context, of input and output so far, and what stopping after it would save; baselines per trajectory."""
    order = W.partitionBy("traj_id").orderBy("prefix_step_idx")
    upto, later, whole = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(1, W.unboundedFollowing), W.partitionBy("traj_id")
    s = steps.withColumns({f"{p}_cum": F.sum(f"{p}_tokens").over(upto) for p in PARTS} | {f"{p}_parts": F.sum(f"{p}_nonempty").over(upto) for p in PARTS})
    inner = sum((F.greatest(F.col(f"{p}_parts") - 1, F.lit(0)) for p in CONTEXT), F.lit(0))
    top = sum(((F.col(f"{p}_parts") > 0).cast("long") for p in CONTEXT), (F.col("task_chars") > 0).cast("long"))
    context = sum((F.col(f"{p}_cum") for p in CONTEXT), F.col("task_tokens")) + (inner + F.greatest(top - 1, F.lit(0))) * newline_tokens
    s = s.withColumns({
        "context_tokens": context.cast("long"),
        "input_tokens_cum": (F.col("task_tokens") + F.col("feedback_cum")).cast("long"),
        "output_tokens_cum": (F.col("action_cum") + F.col("thought_cum") + F.col("assistant_cum")).cast("long"),
    })
    s = s.withColumn("transcript_tokens_cum", F.col("input_tokens_cum") + F.col("output_tokens_cum"))
    last = lambda c: F.max_by(c, "prefix_step_idx").over(whole)
    return s.select(
        "traj_id", "model_id", "prefix_step_idx", "context_tokens",
        F.coalesce(F.sum("context_tokens").over(later), F.lit(0)).cast("long").alias("future_context_saved"),
        F.sum("context_tokens").over(whole).cast("long").alias("baseline_context"),
        "input_tokens_cum", "output_tokens_cum", "transcript_tokens_cum",
        last("input_tokens_cum").alias("baseline_input"), last("output_tokens_cum").alias("baseline_output"), last("transcript_tokens_cum").alias("baseline_transcript"),
        F.count(F.lit(1)).over(whole).alias("n_steps"),
        (F.count(F.lit(1)).over(whole) - F.row_number().over(order)).cast("long").alias("remaining_steps"),
    )


def savings(decisions: DataFrame, tokens: DataFrame) -> DataFrame:
    """Tokens that each decision saves; 0 where undecided. A decided trajectory without its token row raises."""
    base = tokens.groupBy("traj_id").agg(*[F.max(f"baseline_{x}").alias(f"baseline_{x}") for x in ("context", "input", "output", "transcript")])
    spent = tokens.select("traj_id", F.col("prefix_step_idx").alias("at"), "future_context_saved", "input_tokens_cum", "output_tokens_cum")
    d = decisions.withColumn("at", F.greatest(F.coalesce("decision_step", F.lit(-1)), F.lit(0))).join(base, "traj_id", "left").join(spent, ["traj_id", "at"], "left")
    missing = F.raise_error(F.concat(F.lit("no token row for "), F.col("traj_id").cast("string")))
    known = F.col("input_tokens_cum").isNotNull()
    cut = lambda a, b: F.when(~F.col("decided"), 0).when(~known, missing.cast("long")).otherwise(F.greatest(F.col(a) - F.col(b), F.lit(0))).cast("long")
    d = d.withColumns({"saved_context": F.when(F.col("decided"), F.col("future_context_saved")).otherwise(0).cast("long"), "saved_input": cut("baseline_input", "input_tokens_cum"), "saved_output": cut("baseline_output", "output_tokens_cum")})
    return d.withColumn("saved_total", F.col("saved_input") + F.col("saved_output")).drop("at", "future_context_saved", "input_tokens_cum", "output_tokens_cum")


def attach(rows: DataFrame, tokens: DataFrame, keys: tuple[str, ...], *, complete: bool = True) -> DataFrame:
    """Left join of rows with one match at most; an unmatched row raises if ``complete``."""
    j = rows.join(tokens.withColumn("_hit", F.lit(True)), list(keys), "left")
    if complete:
        j = j.withColumn("_hit", F.when(F.col("_hit").isNull(), F.raise_error(F.concat_ws(" ", F.lit("unmatched key"), *[F.col(k).cast("string") for k in keys])).cast("boolean")).otherwise(True)).filter("_hit")
    return j.drop("_hit")


def fill_cache(plan: DataFrame, cache: DataFrame, keys: tuple[str, ...] = ("traj_id", "prefix_step_idx")) -> DataFrame:
    """What a token cache lacks of a plan."""
    return plan.join(cache.select(*keys).distinct(), list(keys), "left_anti")


def cache_meta(ids: DataFrame, column: str = "traj_id") -> DataFrame:
    """Count and order-free digest of the ids that a cache covers; two caches with equal rows cover the same. Constant memory, unlike a list of ids."""
    h = F.xxhash64(F.col(column).cast("string"))
    d = ids.select(column).distinct()
    return d.agg(F.count(F.lit(1)).alias("ids"), F.bit_xor(h).alias("xor"), F.sum((h % 1_000_003).cast("long")).alias("sum"))
