"""Corpus preparation and classification scoring (A1, A2, A9, A10, A13-A15, P1, P2, P11,
J1, J3, J4, T3-T6, T8, U1-U4, W3, W10, W11, F13, F14).

Skew: per-class operators never sort a whole class in one task.  Top-n per
class runs in two rounds (per salted sub-group, then per class over at most
``salt * n`` survivors); per-class indices use ``ordering.dense_index``.
Draws with replacement are hash draws (md5 of seed and draw number), so a
retried task draws the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import dense_index, md5_bucket

# Benchmark datasets, their tasks, display names and output order.
DATASET_TASKS = {"hwu": "intent", "clinc": "intent", "banking": "intent", "restaurant8k": "slot",
                 "dstc8": "slot", "multiwoz": "dst", "top": "top"}
DATASET_LABELS = {"hwu": "HWU64 (Acc)", "clinc": "CLINC150 (Acc)", "banking": "Banking77 (Acc)",
                  "restaurant8k": "Restaurant8k (F-1)", "dstc8": "DSTC8 (F-1)", "top": "TOP (EM)",
                  "multiwoz": "MultiWOZ (Joint Goal Acc)"}
SUMMARY_ORDER = ("Average", "Banking77 (Acc)", "CLINC150 (Acc)", "HWU64 (Acc)", "Restaurant8k (F-1)",
                 "DSTC8 (F-1)", "TOP (EM)", "MultiWOZ (Joint Goal Acc)")
# BIO prefixes and the padding label.
BIO_PREFIXES = ("B-", "I-")
PAD_LABEL = "[PAD]"


def draw_hash(seed: str, *parts) -> Column:
    cols = [F.lit(seed)] + [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))


def draw_index(seed: str, n: Column, *parts) -> Column:
    """Uniform-ish draw in [0, n) from the first 8 hex digits of an md5."""
    h = draw_hash(seed, *parts)
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % F.greatest(n, F.lit(1))


# ------------------------------------------------------------------ scoring

def align(pred: DataFrame, gold: DataFrame, keys=("pos",), pred_col="pred", gold_col="gold") -> DataFrame:
    """Positional zip as an inner equi-join on the position key(s)."""
    return gold.select(*keys, F.col(gold_col).alias("gold")).join(
        pred.select(*keys, F.col(pred_col).alias("pred")), list(keys), "inner")


def accuracy(pred: DataFrame, gold: DataFrame, keys=("pos",), pred_col="pred", gold_col="gold") -> DataFrame:
    """A1: matches over the aligned pairs divided by the gold count (evaluator) and the prediction count (trainer)."""
    keys = list(keys)
    j = gold.select(*keys, F.col(gold_col).alias("gold"), F.lit(1).alias("__g")).join(
        pred.select(*keys, F.col(pred_col).alias("pred"), F.lit(1).alias("__p")), keys, "full")
    out = j.agg(F.count("__g").alias("n_gold"), F.count("__p").alias("n_pred"),
                F.count(F.when((F.col("__g") == 1) & (F.col("__p") == 1) & (F.col("pred") == F.col("gold")), 1))
                .alias("n_match"))
    return out.select(F.col("n_gold").cast("bigint"), F.col("n_pred").cast("bigint"),
                      F.col("n_match").cast("bigint"),
                      F.round(F.try_divide(F.col("n_match"), F.col("n_gold")), 6).alias("acc_gold"),
                      F.round(F.try_divide(F.col("n_match"), F.col("n_pred")), 6).alias("acc_pred"))


def grouped_accuracy(pairs: DataFrame, group: list[str]) -> DataFrame:
    """Accuracy per group over aligned (pred, gold) pairs."""
    return pairs.groupBy(*group).agg(F.count(F.lit(1)).alias("n"),
                                     F.avg(F.when(F.col("pred") == F.col("gold"), 1.0).otherwise(0.0)).alias("acc"))


def exact_match(pairs: DataFrame) -> DataFrame:
    """A2: intent and the whole tag list both equal (struct equality)."""
    ok = (F.col("pred_intent") == F.col("gold_intent")) & (F.col("pred_tags") == F.col("gold_tags"))
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(ok, 1.0).otherwise(0.0)), 6).alias("exact_match"))


def benchmark_summary(scores: DataFrame) -> DataFrame:
    """Per-dataset score x100 under its display name, plus the mean of all, in the fixed order."""
    names = F.create_map(*[x for k, v in DATASET_LABELS.items() for x in (F.lit(k), F.lit(v))])
    per = scores.select(F.try_element_at(names, F.col("dataset")).alias("label"), (F.col("score") * 100).alias("value"))
    avg = per.agg(F.avg("value").alias("value")).select(F.lit("Average").alias("label"), "value")
    order = F.create_map(*[x for i, k in enumerate(SUMMARY_ORDER) for x in (F.lit(k), F.lit(i))])
    return per.unionByName(avg).select("label", F.try_element_at(order, F.col("label")).alias("ord"),
                                       F.round("value", 6).alias("value"))


def run_summary(run_scores: DataFrame, expected_runs: int = 5) -> DataFrame:
    """A10: mean/max/min over runs per dataset; ``ok`` flags datasets with the expected number of runs."""
    return run_scores.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_runs"), F.round(F.avg("score"), 6).alias("mean"),
        F.round(F.max("score"), 6).alias("max"), F.round(F.min("score"), 6).alias("min")
    ).withColumn("ok", F.col("n_runs") == expected_runs)


def validate_submission(submitted: DataFrame, expected=tuple(DATASET_TASKS)) -> DataFrame:
    """Anti joins both ways between submitted and expected dataset names -> violations."""
    spark = submitted.sparkSession
    exp = spark.createDataFrame([(d,) for d in expected], "dataset string")
    got = submitted.select("dataset").distinct()
    missing = exp.join(got, "dataset", "left_anti").select("dataset", F.lit("missing").alias("problem"))
    extra = got.join(exp, "dataset", "left_anti").select("dataset", F.lit("unexpected").alias("problem"))
    return missing.unionByName(extra)


# --------------------------------------------------------------- vocabularies

def category_counts(rows: DataFrame, col="category") -> DataFrame:
    """A13."""
    return rows.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def distinct_vocab(*frames: DataFrame, col="category") -> DataFrame:
    """Sorted distinct labels over splits with a 0-based index.

    The distinct set is the label vocabulary (bounded by the label space, a few
    hundred entries), so one ordered window over it is cheap.
    """
    u = frames[0].select(col)
    for f in frames[1:]:
        u = u.unionByName(f.select(col))
    return u.distinct().select(col, (F.row_number().over(Window.orderBy(col)) - 1).alias("idx"))


def bio_vocab(slot_names: DataFrame, col="slot") -> DataFrame:
    """``O`` then ``B-``/``I-`` per distinct slot (slots sorted, Q14); ``[PAD]`` at 0 on read."""
    slots = slot_names.select(col).distinct()
    per = slots.select(F.col(col).alias("__s"),
                       F.posexplode(F.array(*[F.concat(F.lit(p), F.col(col)) for p in BIO_PREFIXES]))
                       .alias("__p", "label"))
    spark = slot_names.sparkSession
    head = spark.createDataFrame([(PAD_LABEL, "", -2), ("O", "", -1)], "label string, __s string, __p int")
    allv = head.unionByName(per.select("label", "__s", "__p"))
    w = Window.orderBy(F.col("__p") >= 0, "__s", "__p")
    return allv.select("label", (F.row_number().over(w) - 1).alias("idx"))


def label_encode(rows: DataFrame, vocab: DataFrame, col="category", out="label_id") -> tuple[DataFrame, DataFrame]:
    """Label -> vocabulary index; unknown labels go to an error table (the reference raises KeyError)."""
    v = vocab.select(F.col(col).alias("__v"), F.col("idx").alias(out))
    joined = rows.join(v, rows[col] == v["__v"], "left").drop("__v")
    return joined.where(F.col(out).isNotNull()), joined.where(F.col(out).isNull())


def label_decode(rows: DataFrame, vocab: DataFrame, idx_col="pred_id", col="category", out="pred") -> DataFrame:
    """Index -> label (NULL for unknown ids, like ``dict.get``)."""
    v = vocab.select(F.col("idx").alias("__i"), F.col(col).alias(out))
    return rows.join(v, rows[idx_col] == v["__i"], "left").drop("__i")


# ------------------------------------------------------------------ sampling

def top_n_per_group(df: DataFrame, group: list[str], order: Column, n: int, salt_buckets: int = 32,
                    salt_key: str | None = None) -> DataFrame:
    """Rows with the ``n`` smallest ``order`` values per group, in two rounds (skew-proof)."""
    d = df.withColumn("__o", order)
    if salt_key:
        d = d.withColumn("__salt", md5_bucket(F.col(salt_key), salt_buckets))
        w1 = Window.partitionBy(*group, "__salt").orderBy("__o")
        d = d.withColumn("__r1", F.row_number().over(w1)).where(F.col("__r1") <= n).drop("__r1", "__salt")
    w2 = Window.partitionBy(*group).orderBy("__o")
    return d.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= n).drop("__o")


def sample_per_class(rows: DataFrame, n: int, seed: str = "0", key="pos", col="category",
                     strict: bool = True) -> DataFrame:
    """Exactly ``n`` rows per class without replacement; a smaller class is an error."""
    if strict:
        small = category_counts(rows, col).where(F.col("n") < n).limit(1).collect()
        if small:
            raise ValueError(f"class {small[0][col]!r} has fewer than {n} rows")
    return top_n_per_group(rows, [col], draw_hash(seed, F.col(key)), n, salt_key=key)


def every_other(sample: DataFrame, n: int, col="category") -> DataFrame:
    """Rows 0, 2, 4, ... of the few-shot file (classes sorted, draws in rank order)."""
    cls = sample.select(col).distinct()
    cls = cls.select(col, (F.row_number().over(Window.orderBy(col)) - 1).alias("__c"))
    pos = sample.join(cls, col).withColumn("file_pos", F.col("__c") * n + F.col("rank") - 1)
    return pos.where(F.col("file_pos") % 2 == 0).drop("__c")


def value_anti(rows: DataFrame, other: DataFrame, cols: list[str]) -> DataFrame:
    """Drop every row whose value (on ``cols``) occurs in ``other`` (all copies go, NULL-safe)."""
    o = other.select(*[F.col(c).alias(f"__o_{c}") for c in cols]).distinct()
    cond = None
    for c in cols:
        e = rows[c].eqNullSafe(o[f"__o_{c}"])
        cond = e if cond is None else cond & e
    return rows.join(o, cond, "left_anti")


def stratified_val(train: DataFrame, test: DataFrame, exclude: DataFrame | None, ratio: int, seed: str = "0",
                   key="pos", col="category") -> tuple[DataFrame, DataFrame]:
    """T4: per test class with c rows draw c // ratio candidate train rows *with* replacement.

    Candidates are train rows whose (text, category) value is not in ``exclude``
    (J4).  Returns (val draws, new train = train rows never drawn).  Draw j of
    class k comes from the test row numbered j, so no task generates a whole
    class's draws.
    """
    cand = value_anti(train, exclude, ["text", col]) if exclude is not None else train
    cand = dense_index(cand, [col], key, "cidx", count_col="n_cand")
    t = dense_index(test.select(key, col), [col], key, "tidx", count_col="n_test")
    draws = t.where(F.col("tidx") < F.floor(F.col("n_test") / ratio)).select(col, F.col("tidx").alias("draw"))
    sizes = cand.groupBy(col).agg(F.count(F.lit(1)).alias("n_cand"))
    draws = draws.join(sizes, col).withColumn("cidx", draw_index(seed, F.col("n_cand"), F.col(col), F.col("draw")))
    val = draws.join(cand.drop("n_cand"), [col, "cidx"]).drop("cidx", "n_cand")
    new_train = train.join(val.select(key).distinct(), key, "left_anti")
    return val, new_train


def sample_fraction(rows: DataFrame, frac_div: int = 10, seed: str = "0", key="pos") -> DataFrame:
    """T5: ``n // frac_div`` draws *with* replacement over the whole table.

    Draw j takes row ``h(seed, j) mod n``; draws are generated from rows whose
    dense index is below the draw count, so nothing passes through the driver.
    """
    idx = dense_index(rows, [], key, "ridx", count_col="n_rows")
    k = F.floor(F.col("n_rows") / frac_div)
    draws = idx.where(F.col("ridx") < k).select(F.col("ridx").alias("draw"), "n_rows")
    draws = draws.withColumn("ridx", draw_index(seed, F.col("n_rows"), F.col("draw")))
    return draws.join(idx.drop("n_rows"), "ridx").drop("ridx", "n_rows")


def tail_pool(rows: DataFrame, group: list[str], key="pos", keep: str = "half", last_n: int | None = None,
              block: int = 1 << 16) -> DataFrame:
    """The last ``last_n`` rows, or the last ceil(n/2) (``-len(x)//2`` rounds up, Q15), in file order."""
    r = dense_index(rows, group, key, "fidx", count_col="n_rows", range_block=block)
    if last_n is not None:
        cond = F.col("fidx") >= F.col("n_rows") - last_n
    else:
        cond = F.col("fidx") >= F.col("n_rows") - F.ceil(F.col("n_rows") / 2)
    return r.where(cond)


def slot_holdout(train: DataFrame, val: DataFrame, test: DataFrame | None, group: list[str], cols: list[str],
                 key="pos", seed: str = "0", frac_div: int = 10) -> DataFrame:
    """Every part of a slot set as (part, *group, draw, key), from the ``val`` draws (*group, draw, key).

    ``train`` is the rows whose value (``cols``, in their group) is not among
    those drawn for ``val``; ``few`` draws a tenth of it with replacement.
    ``draw`` is null where rows are not drawn.
    """
    out = [*group, "draw", key]
    drawn = train.join(val.select(key).distinct(), key, "left_semi")
    rest = value_anti(train, drawn, [*group, *cols])
    few = sample_fraction(rest.select(*group, key), frac_div, seed, key)
    parts = {"train": rest.withColumn("draw", F.lit(None).cast("bigint")), "val": val, "few": few}
    if test is not None:
        parts["test"] = test.withColumn("draw", F.lit(None).cast("bigint"))
    frames = [f.select(F.lit(name).alias("part"), *[F.col(c).cast("bigint").alias(c) if c == "draw" else c for c in out])
              for name, f in parts.items()]
    return reduce(DataFrame.unionByName, frames)


def last_rows_val(train: DataFrame, last_n: int = 4000, n_val: int = 1000, key="pos", seed: str = "0",
                  block: int = 1 << 16) -> DataFrame:
    """T6, second form: ``n_val`` draws with replacement from the last ``last_n`` rows, as (draw, key)."""
    pool = tail_pool(train.select(key), [], key, last_n=last_n, block=block)
    pool = pool.withColumn("pidx", F.col("fidx") - F.greatest(F.col("n_rows") - last_n, F.lit(0)))
    size = pool.agg(F.count(F.lit(1)).alias("n_pool"))
    draws = train.sparkSession.range(n_val).select(F.col("id").alias("draw")).crossJoin(F.broadcast(size))
    draws = draws.withColumn("pidx", draw_index(seed, F.col("n_pool"), F.col("draw")))
    return draws.join(pool.select("pidx", key), "pidx").select("draw", key)


def batches(rows: DataFrame, size: int, seed: str = "0", key="pos") -> DataFrame:
    """A fixed pseudo-random order (md5 of seed and key), cut into batches of ``size``."""
    r = rows.withColumn("__h", draw_hash(seed, F.col(key)))
    idx = dense_index(r, [], "__h", "order_idx")
    return idx.withColumn("batch", F.floor(F.col("order_idx") / size)).drop("__h")


# ------------------------------------------------------------- text records

def prepend_context(text, slots) -> Column:
    """each requested slot is prepended in turn, so they end up reversed before the text."""
    return F.concat_ws(" ", F.reverse(F.coalesce(slots, F.array().cast("array<string>"))), text)


def cumulative_history(utts: DataFrame, dialog="dialog_id", order="utt_idx", text="text",
                       sep=" [SEP] ") -> DataFrame:
    """All utterances up to each one joined by `` [SEP] `` with whitespace collapsed.

    Output size is quadratic in dialogue length by definition; the window is
    per dialogue.
    """
    w = Window.partitionBy(dialog).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = F.array_join(F.collect_list(text).over(w), sep)
    return utts.withColumn("history", F.trim(F.regexp_replace(hist, r"\s+", " ")))


def batch_examples(batched: DataFrame, key: str = "pos", label: str = "label", seed: str = "0",
                   fill_factor: int = 2) -> DataFrame:
    """Per batch, one example for every label in the batch (not a batch member), then random
    distinct examples until the set holds min(N, fill_factor x batch size) rows.

    ``batched``: every row with its ``batch`` id (T8).  Per-label and global
    dense indices are in md5 order.  A label's example is the first row that is
    no batch member, walking the label's index from a hashed start; the walk
    needs one step more than the batch has members of that label.  A label all
    of whose rows are in the batch keeps the row at the start.  The fill walks
    the global index the same way: what is needed plus what is taken already
    are enough steps.  Both walks are exact and their total length is linear in
    the rows.
    """
    # the batched rows feed many branches below: cut the lineage once (reliable checkpoint in the shared folder)
    from ..session import shared_dir
    shared_dir(batched.sparkSession)
    rows = batched.select(key, label, "batch").checkpoint(eager=True)
    members = rows.select("batch", key)
    lab_idx = dense_index(rows.select(key, label), [label], key, "lidx", count_col="n_label").checkpoint(eager=True)
    glob = dense_index(rows.select(key), [], key, "gidx")
    n_all = F.lit(rows.count())                       # one scalar for the whole set
    # one example per label present in the batch
    walk = (rows.where(F.col(label).isNotNull()).groupBy("batch", label).agg(F.count(F.lit(1)).alias("m"))
            .join(lab_idx.groupBy(label).agg(F.max("n_label").alias("n_label")), label)
            .withColumn("start", draw_index(seed, F.col("n_label"), F.col("batch"), F.col(label)))
            .select("batch", label, "n_label", "start",
                    F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.col("n_label") - 1, F.col("m")))).alias("a"))
            .withColumn("lidx", (F.col("start") + F.col("a")) % F.col("n_label")))
    cand = walk.join(lab_idx.select(label, "lidx", key), [label, "lidx"])
    inside = members.withColumn("member", F.lit(True))
    per_label = (cand.join(inside, ["batch", key], "left").groupBy("batch", label)
                 .agg(F.coalesce(F.min_by(key, F.when(F.col("member").isNull(), F.col("a"))),
                                 F.min_by(key, "a")).alias(key))
                 .select("batch", key, F.lit("label").alias("kind"), F.lit(-1).cast("bigint").alias("attempt"))
                 .checkpoint(eager=True))
    # random fill up to min(N, fill_factor x batch size)
    taken = members.unionByName(per_label.select("batch", key)).distinct()
    need = (rows.groupBy("batch").agg(F.count(F.lit(1)).alias("bs"))
            .join(per_label.groupBy("batch").agg(F.count(F.lit(1)).alias("nl")), "batch", "left")
            .join(taken.groupBy("batch").agg(F.count(F.lit(1)).alias("nt")), "batch")
            .withColumn("need", F.least(n_all, F.col("bs") * fill_factor) - F.coalesce("nl", F.lit(0)))
            .where(F.col("need") > 0))
    fill = (need.withColumn("start", draw_index(seed, n_all, F.col("batch"), F.lit("fill")))
            .select("batch", "need", "start",
                    F.explode(F.sequence(F.lit(0).cast("bigint"),
                                         F.least(n_all, F.col("need") + F.col("nt")) - 1)).alias("f"))
            .withColumn("gidx", (F.col("start") + F.col("f")) % n_all)
            .join(glob.select("gidx", key), "gidx").join(taken, ["batch", key], "left_anti"))
    w = Window.partitionBy("batch").orderBy("f")
    fill_rows = (fill.withColumn("r", F.row_number().over(w)).where(F.col("r") <= F.col("need"))
                 .select("batch", key, F.lit("fill").alias("kind"), F.col("f").cast("bigint").alias("attempt")))
    return per_label.unionByName(fill_rows)
