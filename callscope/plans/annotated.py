"""Queries on prosody, speakers, topics and gold acts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from callscope.functions import tags as G
from callscope.functions import text as X
from callscope.operators import chronology as C
from callscope.operators import gold, people, prosody
from callscope.operators import turns as T
from callscope.plans import core, corpus
from callscope.plans.core import BC_SQL, CONTENT, ORDER, STARTERS, TURNS_SQL, _TOK

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH RECURSIVE {corpus.SQL.strip()}, {sql.strip()}" if sql.strip()[:6].upper() != "SELECT" else f"WITH {corpus.SQL.strip()} {sql}"
        return f

    return add


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("SELECT call_id, side, utt_num, round(avg(f0), 6) AS pitch_mean, round(stddev_pop(f0), 6) AS pitch_std, round(max(f0) - min(f0), 6) AS pitch_range FROM fr GROUP BY ALL")
def agg_pitch(spark, sf_dir):
    return _rounded(prosody.pitch(corpus.frames(spark, sf_dir)), "pitch_mean", "pitch_std", "pitch_range")


@query("SELECT call_id, side, utt_num, round(avg(rms), 6) AS loudness_mean, round(stddev_pop(rms), 6) AS loudness_std, round(max(rms) - min(rms), 6) AS loudness_range FROM fr GROUP BY ALL")
def agg_loudness(spark, sf_dir):
    return _rounded(prosody.loudness(corpus.frames(spark, sf_dir)), "loudness_mean", "loudness_std", "loudness_range")


@query("SELECT call_id, side, utt_num, t, round(12 * log2(f0), 6) AS st FROM fr WHERE f0 IS NOT NULL")
def scl_semitones(spark, sf_dir):
    return corpus.frames(spark, sf_dir).where("f0 IS NOT NULL").select(*C.KEY, "t", F.round(prosody.semitones(F.col("f0")), 6).alias("st"))


ANCHOR_SQL = """
anc AS (SELECT u.call_id, u.side, u.utt_num, round(coalesce(we, "end") - start, 6) AS anchor FROM u LEFT JOIN (SELECT call_id, side, utt_num, max("end") AS we FROM w GROUP BY ALL) USING (call_id, side, utt_num) WHERE round(coalesce(we, "end") - start, 6) > 0)
"""
SLOPE_SQL = f"""{ANCHOR_SQL},
la AS (SELECT l.call_id, l.side, l.utt_num, coalesce(anchor, last) AS anchor FROM (SELECT call_id, side, utt_num, max(t) AS last FROM fr GROUP BY ALL) l LEFT JOIN anc USING (call_id, side, utt_num)),
nr AS (SELECT fr.* FROM fr JOIN la USING (call_id, side, utt_num) WHERE f0 IS NOT NULL AND t <= anchor AND t >= round(anchor - 0.3, 6)),
sl AS (SELECT call_id, side, utt_num, round(regr_slope(f0, t), 6) AS slope_hz, round(regr_slope(12 * log2(f0), t), 6) AS slope_st, (round(regr_slope(12 * log2(f0), t), 6) >= 3.07)::INT AS rising FROM nr GROUP BY ALL HAVING count(*) >= 3)
"""


def _slopes(spark, sf_dir):
    bounds = T.word_bounds(corpus.utterances(spark, sf_dir), corpus.words(spark, sf_dir))
    return prosody.terminal_slope(corpus.frames(spark, sf_dir), prosody.speech_end(bounds))


@query(f"{ANCHOR_SQL} SELECT * FROM anc")
def jn_speech_end(spark, sf_dir):
    return prosody.speech_end(T.word_bounds(corpus.utterances(spark, sf_dir), corpus.words(spark, sf_dir)))


@query(f"{SLOPE_SQL} SELECT * FROM sl")
def agg_terminal_slope(spark, sf_dir):
    return _slopes(spark, sf_dir)


@query(f"{SLOPE_SQL} SELECT call_id, side, utt_num, least(greatest(slope_hz * 20, -1000), 1000) AS clipped FROM sl")
def prj_clip_slope(spark, sf_dir):
    return _slopes(spark, sf_dir).select(*C.KEY, prosody.clip_slope(F.col("slope_hz") * 20).alias("clipped"))


PITCH_SQL = "pm AS (SELECT call_id, side, utt_num, avg(f0) AS pitch_mean FROM fr GROUP BY ALL), bl AS (SELECT call_id, side, quantile_cont(pitch_mean, 0.75) AS high_pitch FROM pm WHERE pitch_mean IS NOT NULL GROUP BY ALL HAVING count(*) >= 10)"


@query(f"{PITCH_SQL} SELECT call_id, side, round(high_pitch, 6) AS high_pitch FROM bl")
def agg_side_pitch_baseline(spark, sf_dir):
    return _rounded(prosody.side_pitch_baseline(prosody.pitch(corpus.frames(spark, sf_dir))), "high_pitch")


@query(rf"""{TURNS_SQL}, {SLOPE_SQL}, {PITCH_SQL},
b AS (SELECT call_id, side, utt_num, len({_TOK}) AS tc, CASE WHEN len({CONTENT}) > 0 THEN (({CONTENT})[1] IN ({STARTERS}))::INT END AS q FROM u),
j AS (SELECT b.*, ev.backchannel, ev.onset_gap, sl.rising, pm.pitch_mean, bl.high_pitch FROM b JOIN ev USING (call_id, side, utt_num) LEFT JOIN sl USING (call_id, side, utt_num) LEFT JOIN pm USING (call_id, side, utt_num) LEFT JOIN bl USING (call_id, side)),
s AS (SELECT *, CASE WHEN backchannel = 1 THEN NULL WHEN coalesce(q, 0) = 0 AND rising IS NULL THEN NULL WHEN coalesce(q, 0) = 0 AND rising = 0 THEN 0 ELSE 1 + (tc <= 4)::INT + coalesce((onset_gap <= 0.5)::INT, 0) + coalesce((round(pitch_mean, 9) >= round(high_pitch, 9))::INT, 0) END AS mgq_score FROM j)
SELECT call_id, side, utt_num, mgq_score, (mgq_score = 4)::INT AS mgq_flag FROM s""")
def scl_marked_question(spark, sf_dir):
    u = corpus.utterances(spark, sf_dir)
    text = C.text_features(u)
    pitch = prosody.pitch(corpus.frames(spark, sf_dir)).select(*C.KEY, F.round("pitch_mean", 9).alias("pitch_mean"))
    rows = lambda t, *c: u.select(*C.KEY).join(t.select(*C.KEY, *c), C.KEY, "left")
    tables = {"question_flags": text.select(*C.KEY, "question_flag"), "rising_terminal": rows(_slopes(spark, sf_dir), "rising"), "token_count": text.select(*C.KEY, "token_count"), "fto": core.features(spark, sf_dir).select(*C.KEY, "onset_gap", "backchannel"), "pitch": rows(pitch, "pitch_mean")}
    return prosody.marked_question_of(u, tables)


PEOPLE_SQL = """
ppl AS (SELECT caller, CASE upper(trim(sex)) WHEN 'MALE' THEN 'male' WHEN 'FEMALE' THEN 'female' END AS gender, CASE WHEN upper(trim(dialect)) IN ('', 'UNK') THEN 'unk' ELSE replace(lower(trim(dialect)), ' ', '_') END AS region, birth_year::INT AS birth_year,
  CASE WHEN birth_year <= 1926 THEN 'GI' WHEN birth_year <= 1944 THEN 'Silent' WHEN birth_year <= 1964 THEN 'Baby_Boomer' ELSE 'Generation_X' END AS generation, ((birth_year // 10) * 10)::VARCHAR || 's' AS decade, education::VARCHAR AS education FROM callers)
"""


@query(f"{PEOPLE_SQL} SELECT * FROM ppl")
def prj_normalised_callers(spark, sf_dir):
    return people.normalised_callers(corpus.callers(spark, sf_dir))


@query(f"{PEOPLE_SQL} SELECT u.call_id, u.side, u.utt_num, p.* FROM u LEFT JOIN (sides JOIN ppl USING (caller)) p ON u.call_id = p.call_id AND u.side = p.side".replace("p.*", "caller, gender, region, birth_year, generation, decade, education"))
def jn_demographics(spark, sf_dir):
    d = people.with_demographics(corpus.utterances(spark, sf_dir), corpus.sides(spark, sf_dir), corpus.callers(spark, sf_dir))
    return d.select(*C.KEY, "caller", "gender", "region", "birth_year", "generation", "decade", "education")


@query("""
cv AS (SELECT DISTINCT conv_id AS call_id, CASE WHEN conv_id % 9 = 8 THEN 'UNK' ELSE (conv_id % 7)::VARCHAR END AS topic_no FROM conversations WHERE conv_id % 10 <> 9),
tp AS (SELECT r_regionkey AS topic_no, r_name AS topic FROM region)
SELECT c.call_id, coalesce(topic, 'UNK') AS topic FROM (SELECT DISTINCT call_id FROM u) c LEFT JOIN cv USING (call_id) LEFT JOIN tp ON try_cast(cv.topic_no AS INT) = tp.topic_no""")
def jn_topic(spark, sf_dir):
    calls = corpus.utterances(spark, sf_dir).select("call_id").distinct()
    c = corpus.table(spark, sf_dir, "conversations").where("conv_id % 10 <> 9").select(F.col("conv_id").alias("call_id"), F.when(F.col("conv_id") % 9 == 8, "UNK").otherwise((F.col("conv_id") % 7).cast("string")).alias("topic_no")).distinct()
    topics = corpus.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("topic_no"), F.col("r_name").alias("topic"))
    return people.with_topic(calls, c, topics)


@query("SELECT call_id, u.side, utt_num, caller FROM u JOIN sides USING (call_id, side)")
def jn_side_to_caller(spark, sf_dir):
    return people.mapped_rows(corpus.utterances(spark, sf_dir), corpus.sides(spark, sf_dir)).select(*C.KEY, "caller")


@query("SELECT count(*) AS n_unmapped FROM u ANTI JOIN sides USING (call_id, side)")
def jn_unmapped_count(spark, sf_dir):
    return people.unmapped_count(corpus.utterances(spark, sf_dir), corpus.sides(spark, sf_dir))


@query("SELECT call_id, side, utt_num, \"end\" - start AS seconds FROM u".replace('"end" - start', 'round("end" - start, 6)'))
def jn_duration(spark, sf_dir):
    u = corpus.utterances(spark, sf_dir)
    return u.select(*C.KEY, "text").join(u.select(*C.KEY, F.round(F.col("end") - F.col("start"), 6).alias("seconds")), C.KEY, "left").drop("text")


TAG_SQL = r"""
pt AS (SELECT call_id, side, act_id, trim(p) AS p, i FROM (SELECT *, unnest(string_split(tag, ',')) AS p, generate_subscripts(string_split(tag, ','), 1) AS i FROM acts)),
ps AS (SELECT *, regexp_replace(p, '(\(\^q\)|\^[a-z0-9]+|@|\*)+$', '') AS stem, regexp_extract_all(regexp_extract(p, '(\(\^q\)|\^[a-z0-9]+|@|\*)+$'), '\(\^q\)|\^[a-z0-9]+|@|\*') AS run FROM pt WHERE p <> ''),
tg AS (SELECT call_id, side, act_id, list(CASE WHEN stem <> '' THEN stem ELSE run[1] END ORDER BY i) AS bases, list_sort(list_distinct(flatten(list(CASE WHEN stem <> '' THEN run ELSE run[2:] END)))) AS decorations FROM ps GROUP BY ALL)
"""


@query(f"{TAG_SQL} SELECT call_id, act_id, side, array_to_string(bases, ' ') AS bases, array_to_string(decorations, ' ') AS decorations FROM tg")
def scl_tag_grammar(spark, sf_dir):
    t = F.col("tag")
    return corpus.acts(spark, sf_dir).select("call_id", "act_id", "side", F.array_join(G.bases(t), " ").alias("bases"), F.array_join(G.decorations(t), " ").alias("decorations"))


@query(f"""{TAG_SQL} SELECT call_id, act_id, side, CASE WHEN list_contains(decorations, '^d') THEN 'declarative' WHEN list_contains(bases, '^g') OR list_contains(decorations, '^g') THEN 'tag' ELSE 'syntactic' END AS category,
CASE WHEN list_contains(bases, 'qy') AND list_contains(decorations, '^d') THEN 'declq' WHEN list_contains(bases, 'qy') THEN 'ynq' WHEN list_has_any(bases, ['sd', 'sv']) THEN 'stmt' ELSE 'other' END AS terminal FROM tg""")
def prj_act_classes(spark, sf_dir):
    b, d = G.bases(F.col("tag")), G.decorations(F.col("tag"))
    return corpus.acts(spark, sf_dir).select("call_id", "act_id", "side", G.question_category(b, d).alias("category"), G.terminal_class(b, d).alias("terminal"))


@query(f"{TAG_SQL} SELECT 'base' AS kind, name, count(*) AS n FROM (SELECT unnest(bases) AS name FROM tg) GROUP BY name UNION ALL SELECT 'decoration', name, count(*) FROM (SELECT unnest(decorations) AS name FROM tg) GROUP BY name")
def agg_tag_inventory(spark, sf_dir):
    return gold.tag_inventory(corpus.acts(spark, sf_dir))


@query(f"""{TAG_SQL}, k AS (SELECT call_id, side, count_if(list_contains(bases, '^2') OR list_contains(decorations, '^2')) AS a, count_if(list_contains(bases, '^m') OR list_contains(decorations, '^m')) AS b, count_if(list_contains(bases, 'bh')) AS c, count_if(list_contains(bases, 'ba')) AS d,
count_if(list_contains(bases, '^q') OR list_contains(decorations, '^q') OR list_contains(decorations, '(^q)')) AS e, count_if(list_contains(bases, 'b')) AS f FROM tg GROUP BY ALL), n AS (SELECT call_id, side, count(*) AS n FROM u GROUP BY ALL)
SELECT call_id, side, round(100 * a / n, 6) AS collab_completion_per100, round(100 * b / n, 6) AS mirror_per100, round(100 * c / n, 6) AS echo_question_per100, round(100 * d / n, 6) AS appreciation_per100, round(100 * e / n, 6) AS quotation_per100, round(100 * f / n, 6) AS backchannel_per100 FROM k JOIN n USING (call_id, side)""")
def agg_behaviour_rates(spark, sf_dir):
    return gold.behaviour_rates(corpus.acts(spark, sf_dir), corpus.utterances(spark, sf_dir))


ALIGN_SQL = """
mt AS (SELECT a.call_id, a.side, act_id, tag, a.start, utt_num, u.start AS us, u."end" AS ue, round(least(a."end", u."end") - greatest(a.start, u.start), 6) AS ov, least(a."end" - a.start, u."end" - u.start) AS sh FROM acts a JOIN u ON a.call_id = u.call_id AND a.side = u.side AND u.start < a."end" AND a.start < u."end"),
bs AS (SELECT *, row_number() OVER (PARTITION BY call_id, side, act_id ORDER BY ov DESC, us DESC, ue DESC, utt_num DESC) AS r FROM mt),
al AS (SELECT call_id, side, act_id, tag, start, utt_num FROM bs WHERE r = 1 AND ov >= round(0.5 * sh, 6))
"""


def _aligned(spark, sf_dir):
    return gold.align(corpus.acts(spark, sf_dir), corpus.utterances(spark, sf_dir))


@query(f"{ALIGN_SQL} SELECT a.call_id, a.side, a.act_id, utt_num FROM acts a LEFT JOIN al USING (call_id, side, act_id)")
def jn_gold_alignment(spark, sf_dir):
    return _aligned(spark, sf_dir).select("call_id", "side", "act_id", "utt_num")


@query("""
m AS (SELECT call_id, side, utt_num * 1000 + i AS terminal_id, round((start + "end") / 2, 6) AS mid FROM w),
c AS (SELECT m.call_id, m.side, terminal_id, mid, u.utt_num, u."end" AS ue, row_number() OVER (PARTITION BY m.call_id, m.side, terminal_id ORDER BY u.start DESC, u.utt_num DESC) AS r FROM m JOIN u ON u.call_id = m.call_id AND u.side = m.side AND u.start <= mid)
SELECT m.call_id, m.side, m.terminal_id, CASE WHEN m.mid <= ue THEN utt_num END AS utt_num FROM m LEFT JOIN (SELECT * FROM c WHERE r = 1) c USING (call_id, side, terminal_id)""")
def jn_midpoint_asof(spark, sf_dir):
    w = corpus.words(spark, sf_dir).select("call_id", "side", (F.col("utt_num") * 1000 + F.col("i")).alias("terminal_id"), "start", "end")
    return gold.at_midpoint(w, corpus.utterances(spark, sf_dir))


@query("""
x AS (SELECT call_id, side, utt_num, list(i) AS ids FROM w WHERE i < 3 GROUP BY ALL)
SELECT x.call_id, x.side, x.utt_num, min(CASE WHEN w.i <> 1 THEN start END) AS start, max(CASE WHEN w.i <> 1 THEN "end" END) AS "end", count(*) AS n_terminals FROM x JOIN w ON w.call_id = x.call_id AND w.side = x.side AND w.utt_num = x.utt_num AND list_contains(ids, w.i) GROUP BY ALL""")
def jn_resolve_spans(spark, sf_dir):
    w = corpus.words(spark, sf_dir).withColumn("terminal_id", F.concat_ws("_", "call_id", "side", "utt_num", "i"))
    groups = w.where("i < 3").groupBy(*C.KEY).agg(F.collect_list("terminal_id").alias("ids"))
    return gold.resolve_spans(groups, w.where("i <> 1"), C.KEY).drop("ids")


LABEL_SQL = f"""{TAG_SQL}, {ALIGN_SQL},
gl AS (SELECT al.call_id, al.side, al.utt_num, count(*) AS n_acts, list_sort(flatten(list(bases))) AS all_bases, bool_or(list_has_any(bases, ['qy', 'qw', 'qo', 'qr', 'qrr', 'qh', '^g'])) AS gold_q, bool_and(len(list_filter(bases, lambda x: x <> 'b')) = 0) AS gold_bc, bool_and(len(list_filter(bases, lambda x: x NOT IN ('b', 'bh', 'bk'))) = 0) AS gold_bc_wide FROM al JOIN tg USING (call_id, side, act_id) GROUP BY ALL)
"""


@query(f"{LABEL_SQL} SELECT call_id, side, utt_num, n_acts, array_to_string(all_bases, ' ') AS all_bases, gold_q, gold_bc, gold_bc_wide FROM gl")
def agg_gold_labels(spark, sf_dir):
    return gold.utterance_labels(_aligned(spark, sf_dir)).withColumn("all_bases", F.array_join("all_bases", " "))


@query(f"{ALIGN_SQL} SELECT call_id, side, utt_num, arg_min(tag, (start, act_id)) AS first_tag, arg_max(tag, (start, act_id)) AS last_tag FROM al GROUP BY ALL")
def agg_first_last_act(spark, sf_dir):
    return gold.first_and_last_act(_aligned(spark, sf_dir))


def _labelled(spark, sf_dir):
    u = corpus.utterances(spark, sf_dir)
    return u.select(*C.KEY, X.is_backchannel(F.col("text")).alias("bc"), X.question_flag(F.col("text")).alias("q"), X.question_flag_after_markers(F.col("text")).alias("q_after"), "text").join(gold.utterance_labels(_aligned(spark, sf_dir)), C.KEY)


LABELLED_SQL = f"{LABEL_SQL}, lb AS (SELECT gl.*, {BC_SQL} AS bc, CASE WHEN len({CONTENT}) > 0 THEN (({CONTENT})[1] IN ({STARTERS}))::INT END AS q, CASE WHEN len({CONTENT}) > 0 THEN coalesce(list_filter({CONTENT}, lambda w: w NOT IN ({core._LIST(X.MARKERS)}))[1] IN ({STARTERS}), false)::INT END AS q_after FROM gl JOIN u USING (call_id, side, utt_num))"
_PRF = "round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1"


@query(f"{LABELLED_SQL} SELECT call_id, side, utt_num, bc, q, gold_q, gold_bc FROM lb")
def jn_gold_labels(spark, sf_dir):
    return _labelled(spark, sf_dir).select(*C.KEY, "bc", "q", "gold_q", "gold_bc")


@query(f"""{LABELLED_SQL}, c AS (SELECT 'backchannel' AS what, bc = 1 AS p, gold_bc AS a FROM lb UNION ALL SELECT 'backchannel_wide', bc = 1, gold_bc_wide FROM lb UNION ALL SELECT 'question', coalesce(q = 1, false), gold_q FROM lb),
k AS (SELECT what, count_if(p AND a) AS tp, count_if(p AND NOT a) AS fp, count_if(NOT p AND a) AS fn FROM c GROUP BY what) SELECT what, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, {_PRF} FROM k""")
def agg_confusion(spark, sf_dir):
    l = _labelled(spark, sf_dir)  # noqa: E741
    rows = l.select(F.explode(F.array(*[F.struct(F.lit(n).alias("what"), p.alias("p"), F.col(a).alias("a")) for n, p, a in (("backchannel", F.col("bc") == 1, "gold_bc"), ("backchannel_wide", F.col("bc") == 1, "gold_bc_wide"), ("question", F.col("q") == 1, "gold_q"))])).alias("x")).select("x.*")
    return gold.confusion(rows, F.col("p"), F.col("a"), "what")


@query(f"{LABELLED_SQL} SELECT count_if(coalesce(q, 0) = 0 AND gold_q)::BIGINT AS n_missed, count_if(coalesce(q, 0) = 0 AND gold_q AND q_after = 1)::BIGINT AS n_gained, count_if(coalesce(q, 0) = 0 AND NOT gold_q)::BIGINT AS n_clear, count_if(coalesce(q, 0) = 0 AND NOT gold_q AND q_after = 1)::BIGINT AS n_cost FROM lb")
def agg_marker_counterfactual(spark, sf_dir):
    no = F.coalesce(F.col("q"), F.lit(0)) == 0
    g, after = F.col("gold_q"), F.coalesce(F.col("q_after") == 1, F.lit(False))
    return _labelled(spark, sf_dir).agg(F.count_if(no & g).alias("n_missed"), F.count_if(no & g & after).alias("n_gained"), F.count_if(no & ~g).alias("n_clear"), F.count_if(no & ~g & after).alias("n_cost"))


@query(f"{LABELLED_SQL} SELECT name, count(*) AS n FROM (SELECT unnest(list_distinct(all_bases)) AS name FROM lb WHERE q = 1 AND NOT gold_q) GROUP BY name")
def agg_false_positive_tags(spark, sf_dir):
    return _labelled(spark, sf_dir).where("q = 1 AND NOT gold_q").select(F.explode(F.array_distinct("all_bases")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{LABELLED_SQL}, qa AS (SELECT al.*, bases, decorations FROM al JOIN tg USING (call_id, side, act_id) WHERE list_has_any(bases, ['qy', 'qw', 'qo', 'qr', 'qrr', 'qh', '^g']))
SELECT CASE WHEN list_contains(decorations, '^d') THEN 'declarative' WHEN list_contains(bases, '^g') OR list_contains(decorations, '^g') THEN 'tag' ELSE 'syntactic' END AS category, count(*) AS n, round(avg(coalesce(q, 0)), 6) AS recall FROM qa JOIN lb USING (call_id, side, utt_num) GROUP BY 1""")
def agg_recall_by_category(spark, sf_dir):
    b, d = G.bases(F.col("tag")), G.decorations(F.col("tag"))
    acts = _aligned(spark, sf_dir).where("utt_num IS NOT NULL").where(G.is_question(b)).select(*C.KEY, G.question_category(b, d).alias("category"))
    q = corpus.utterances(spark, sf_dir).select(*C.KEY, F.coalesce(X.question_flag(F.col("text")), F.lit(0)).alias("q"))
    return acts.join(q, C.KEY).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("q"), 6).alias("recall"))


@query(f"{LABELLED_SQL} SELECT round(avg(bc), 6) AS predicted_bc, round(avg(gold_bc::INT), 6) AS gold_bc, round(avg(coalesce(q, 0)), 6) AS predicted_q, round(avg(gold_q::INT), 6) AS gold_q FROM lb")
def agg_predicted_vs_gold(spark, sf_dir):
    return _labelled(spark, sf_dir).agg(F.round(F.avg("bc"), 6).alias("predicted_bc"), F.round(F.avg(F.col("gold_bc").cast("int")), 6).alias("gold_bc"), F.round(F.avg(F.coalesce("q", F.lit(0))), 6).alias("predicted_q"), F.round(F.avg(F.col("gold_q").cast("int")), 6).alias("gold_q"))


@query(f"""{TURNS_SQL}, {ALIGN_SQL}, {TAG_SQL} SELECT count(*) AS n, round(avg(turn_initial), 6) AS opened_share FROM al JOIN tg USING (call_id, side, act_id) JOIN ev USING (call_id, side, utt_num) WHERE list_contains(bases, '+')""")
def agg_floor_retention(spark, sf_dir):
    acts = _aligned(spark, sf_dir).where("utt_num IS NOT NULL")
    return gold.floor_retention(acts.join(core.features(spark, sf_dir).select(*C.KEY, "turn_initial"), C.KEY))


@query(f"""{TURNS_SQL}, {LABELLED_SQL} SELECT (bc = 1) AS listed, count(*) AS n, sum(cooperative)::BIGINT AS n_cooperative, sum(obstructive)::BIGINT AS n_obstructive FROM lb JOIN ev USING (call_id, side, utt_num) WHERE gold_bc GROUP BY 1""")
def agg_overlap_on_gold_backchannels(spark, sf_dir):
    l = _labelled(spark, sf_dir).where("gold_bc").join(core.features(spark, sf_dir).select(*C.KEY, "cooperative", "obstructive"), C.KEY)  # noqa: E741
    return l.groupBy((F.col("bc") == 1).alias("listed")).agg(F.count(F.lit(1)).alias("n"), F.sum("cooperative").alias("n_cooperative"), F.sum("obstructive").alias("n_obstructive"))


@query("""
rep AS (SELECT call_id, side, utt_num, i FROM w WHERE i % 6 IN (2, 3)),
m AS (SELECT w.*, rep.i IS NOT NULL AS repair FROM w LEFT JOIN rep USING (call_id, side, utt_num, i)) SELECT call_id, side, utt_num, i, token, repair FROM m""")
def jn_reparandum(spark, sf_dir):
    w = corpus.words(spark, sf_dir)
    marked = w.where((F.col("i") % 6).isin(2, 3)).select(*C.KEY, "i", F.lit(True).alias("m"))
    return w.join(marked, [*C.KEY, "i"], "left").select(*C.KEY, "i", "token", F.col("m").isNotNull().alias("repair"))


@query(f"""
tk AS (SELECT call_id, side, utt_num, i, lower(token) AS t, i % 6 IN (2, 3) AS rep FROM w WHERE NOT (starts_with(token, '[') AND ends_with(token, ']'))),
a AS (SELECT call_id, side, utt_num, t, count(*) AS n, count_if(NOT rep) AS k FROM tk GROUP BY ALL)
SELECT sum(n * (n - 1) // 2)::BIGINT AS pairs, sum(k * (k - 1) // 2)::BIGINT AS pairs_without_repair, round(1 - sum(k * (k - 1) // 2) / sum(n * (n - 1) // 2), 6) AS repair_share FROM a""")
def agg_repair_share(spark, sf_dir):
    return gold.repair_share_current(corpus.words(spark, sf_dir).select(*C.KEY, "token", (F.col("i") % 6).isin(2, 3).alias("repair")))


@query(f"{ORDER and ''} SELECT DISTINCT a.call_id FROM acts a SEMI JOIN u USING (call_id)")
def set_calls_in_both(spark, sf_dir):
    return corpus.acts(spark, sf_dir).select("call_id").intersect(corpus.utterances(spark, sf_dir).select("call_id"))
