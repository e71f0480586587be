"""Gold dialogue acts aligned to utterances, and what is measured against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions import tags as G
from callscope.functions import text as X
from callscope.operators.groups import correlation

KEY = ["call_id", "side", "utt_num"]
BIN_SECONDS = 60.0


def resolve_spans(groups: DataFrame, terminals: DataFrame, by: list[str], ids: str = "ids") -> DataFrame:
    """Adds start, end and n_terminals of each row's terminal ids; null span if none is timed."""
    each = groups.select(*by, F.explode(ids).alias("terminal_id")).join(terminals.select("terminal_id", F.col("start").alias("ts"), F.col("end").alias("te")), "terminal_id", "left")
    span = each.groupBy(*by).agg(F.min("ts").alias("start"), F.max("te").alias("end"), F.count(F.lit(1)).alias("n_terminals"))
    return groups.join(span, by, "left")


def align(spans: DataFrame, utterances: DataFrame, share: float = 0.5) -> DataFrame:
    """Adds utt_num of the utterance of the same side with the largest overlap, if that is at least `share` of the shorter one.

    Ties go to the later-starting utterance, then to the later one in (start, end, utt_num) order. Equi-join on call, side and
    time bin; a pair counts in the later of its first bins.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / BIN_SECONDS), F.greatest(F.floor(F.col(a) / BIN_SECONDS), F.floor(F.col(b) / BIN_SECONDS))))
    s = spans.where("start IS NOT NULL AND end IS NOT NULL").select("call_id", "side", "act_id", "start", "end").withColumn("bin", bins("start", "end"))
    u = utterances.select("call_id", "side", "utt_num", F.col("start").alias("us"), F.col("end").alias("ue")).withColumn("bin", bins("us", "ue"))
    met = s.join(u, ["call_id", "side", "bin"]).where((F.col("us") < F.col("end")) & (F.col("start") < F.col("ue")) & (F.col("bin") == F.floor(F.greatest("start", "us") / BIN_SECONDS)))
    ov = F.round(F.least("end", "ue") - F.greatest("start", "us"), 6)
    best = met.groupBy("call_id", "side", "act_id").agg(F.max(F.struct(ov.alias("ov"), "us", "ue", "utt_num", F.least(F.col("end") - F.col("start"), F.col("ue") - F.col("us")).alias("shorter"))).alias("b"))
    found = best.where(F.col("b.ov") >= F.round(share * F.col("b.shorter"), 6)).select("call_id", "side", "act_id", F.col("b.utt_num").alias("utt_num"))
    return spans.join(found, ["call_id", "side", "act_id"], "left")


def at_midpoint(terminals: DataFrame, utterances: DataFrame) -> DataFrame:
    """Adds utt_num of the last utterance of the side that starts at or before the terminal's midpoint and doesn't end before it.

    An as-of join: both tables in one sorted window by side, no product.
    """
    mid = F.round((F.col("start") + F.col("end")) / 2, 6)
    t = terminals.select("call_id", "side", "terminal_id", mid.alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("struct<end: double, utt_num: bigint>").alias("u"))
    u = utterances.select("call_id", "side", F.lit(None).cast(dict(terminals.dtypes)["terminal_id"]).alias("terminal_id"), F.col("start").alias("at"), F.lit(0).alias("kind"), F.struct(F.col("end").cast("double").alias("end"), F.col("utt_num").cast("bigint").alias("utt_num")).alias("u"))
    w = Window.partitionBy("call_id", "side").orderBy("at", "kind", F.col("u.utt_num")).rowsBetween(Window.unboundedPreceding, 0)
    dealt = t.unionByName(u).repartition("call_id", "side")  # by the size of these rows, not of the calls they were made from
    seen = dealt.withColumn("u", F.last("u", ignorenulls=True).over(w)).where("kind = 1")
    return seen.select("call_id", "side", "terminal_id", F.when(F.col("at") <= F.col("u.end"), F.col("u.utt_num")).alias("utt_num"))


def utterance_labels(aligned: DataFrame) -> DataFrame:
    """(key, n_acts, all_bases, gold_q, gold_bc, gold_bc_wide): ANY act a question, ALL bases backchannels."""
    b = G.bases(F.col("tag"))
    own = aligned.where("utt_num IS NOT NULL").select(*KEY, b.alias("b"))
    every = lambda names: F.forall("b", lambda x: x.isin(*names))
    return own.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_acts"), F.array_sort(F.flatten(F.collect_list("b"))).alias("all_bases"), F.bool_or(G.is_question(F.col("b"))).alias("gold_q"), F.bool_and(every(("b",))).alias("gold_bc"), F.bool_and(every(("b", "bh", "bk"))).alias("gold_bc_wide"))


def first_and_last_act(aligned: DataFrame) -> DataFrame:
    """(key, first_tag, last_tag) by start, then act id."""
    order = F.struct("start", "act_id")
    return aligned.where("utt_num IS NOT NULL").groupBy(*KEY).agg(F.min_by("tag", order).alias("first_tag"), F.max_by("tag", order).alias("last_tag"))


def confusion(df: DataFrame, predicted: Column, actual: Column, *by: str) -> DataFrame:
    """tp, fp, fn, precision, recall, f1; a ratio without a denominator is null."""
    p, a = F.coalesce(predicted, F.lit(False)), F.coalesce(actual, F.lit(False))
    c = df.groupBy(*by).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"))
    precision, recall = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select(*by, "tp", "fp", "fn", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6).alias("f1"))


def behaviour_rates(acts: DataFrame, utterances: DataFrame) -> DataFrame:
    """Gold behaviours per 100 utterances of each side."""
    flags = G.behaviours(G.bases(F.col("tag")), G.decorations(F.col("tag")))
    counts = acts.groupBy("call_id", "side").agg(*[F.count_if(c).alias(k) for k, c in flags.items()])
    total = utterances.groupBy("call_id", "side").agg(F.count(F.lit(1)).alias("n_utt"))
    return counts.join(total, ["call_id", "side"]).select("call_id", "side", *[F.round(100.0 * F.col(k) / F.col("n_utt"), 6).alias(f"{k}_per100") for k in flags])


def tag_inventory(acts: DataFrame) -> DataFrame:
    """(kind, tag, n): how often each base and each decoration occurs."""
    b = acts.select(F.lit("base").alias("kind"), F.explode(G.bases(F.col("tag"))).alias("name"))
    d = acts.select(F.lit("decoration").alias("kind"), F.explode(G.decorations(F.col("tag"))).alias("name"))
    return b.unionByName(d).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))


def floor_retention(acts_with_events: DataFrame) -> DataFrame:
    """Share of '+' acts (same speaker goes on) whose utterance opens a turn all the same."""
    plus = acts_with_events.where(F.array_contains(G.bases(F.col("tag")), "+"))
    return plus.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("turn_initial"), 6).alias("opened_share"))


def token_counts(words: DataFrame) -> DataFrame:
    """(key, t, n, k): how often each lower-case token t is in an utterance, in all and outside of repairs; brackets don't count.

    words: (key, token, repair), repair boolean.
    """
    w = words.where(~X.is_bracket(F.col("token")))
    return w.groupBy(*KEY, F.lower("token").alias("t")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce("repair", F.lit(False))).alias("k"))


def predecessors(utterances: DataFrame) -> DataFrame:
    """(key, prev_side, prev_num): the utterance of either side that starts before, ties by side and number; null for a call's first."""
    w = Window.partitionBy("call_id").orderBy("start", "side", "utt_num")
    return utterances.select(*KEY, F.lag("side").over(w).alias("prev_side"), F.lag("utt_num").over(w).alias("prev_num"))


def _share(pairs: DataFrame) -> DataFrame:
    n, k = F.sum("n"), F.sum("k")
    return pairs.agg(F.coalesce(n, F.lit(0)).cast("long").alias("pairs"), F.coalesce(k, F.lit(0)).cast("long").alias("pairs_without_repair"), F.round(1 - F.try_divide(k, n), 6).alias("repair_share"))


def current_pairs(counts: DataFrame) -> DataFrame:
    """(key, n, k): repeated token pairs within an utterance, with and without repair tokens; a row for each utterance with tokens."""
    c2 = lambda c: F.sum((F.col(c) * (F.col(c) - 1) / 2).cast("long")).alias(c)
    return counts.groupBy(*KEY).agg(c2("n"), c2("k"))


def repair_share_current(words: DataFrame) -> DataFrame:
    """One row: pairs, pairs_without_repair, repair_share; the share is null without pairs."""
    return _share(current_pairs(token_counts(words)))


def repair_share_previous(words: DataFrame, utterances: DataFrame) -> DataFrame:
    """As repair_share_current, over token pairs shared with the predecessor in time; an equi-join on call, predecessor and token."""
    counts = token_counts(words)
    before = counts.select("call_id", F.col("side").alias("prev_side"), F.col("utt_num").alias("prev_num"), "t", F.col("n").alias("pn"), F.col("k").alias("pk"))
    met = counts.join(predecessors(utterances), KEY).join(before, ["call_id", "prev_side", "prev_num", "t"])
    return _share(met.select((F.col("n") * F.col("pn")).alias("n"), (F.col("k") * F.col("pk")).alias("k")))


def repetition_against_mirror(words: DataFrame, acts: DataFrame, decoration: str = "^m") -> DataFrame:
    """(measure, n_sides, r): side-level repetition per utterance, whole, without repairs and by repairs, against acts with the decoration per 100 utterances.

    Sides are those with tokens; one without acts has rate 0. r is null where a column is constant.
    """
    sides = current_pairs(token_counts(words)).groupBy("call_id", "side").agg(F.count(F.lit(1)).alias("u"), F.sum("n").alias("n"), F.sum("k").alias("k"))
    m = acts.groupBy("call_id", "side").agg(F.count_if(F.array_contains(G.decorations(F.col("tag")), decoration)).alias("m"))
    s = sides.join(m, ["call_id", "side"], "left").select((F.col("n") / F.col("u")).alias("raw"), (F.col("k") / F.col("u")).alias("clean"), ((F.col("n") - F.col("k")) / F.col("u")).alias("by_repair"), (100 * F.coalesce("m", F.lit(0)) / F.col("u")).alias("mirror"))
    names = ("raw", "clean", "by_repair")
    one = s.agg(F.count(F.lit(1)).alias("n_sides"), *[correlation(c, "mirror").alias(c) for c in names])
    return one.select("n_sides", F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.round(c, 6).alias("r")) for c in names])).alias("x")).select("x.measure", "n_sides", "x.r")
