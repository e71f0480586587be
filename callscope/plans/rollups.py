"""Queries on tables, unit roll-ups, group comparisons and audits, with their SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from callscope.functions import text as X
from callscope.operators import analysis, prosody
from callscope.operators import chronology as C
from callscope.operators import groups as S
from callscope.operators import overlap as O
from callscope.operators import quality as Q
from callscope.operators import registry as R
from callscope.operators import turns as T
from callscope.operators import units as U
from callscope.plans import annotated, core, corpus
from callscope.plans.core import BC_SQL, CONTENT, ORDER, PAUSES_SQL, STARTERS, TURNS_SQL, _BARE, _TOK
from callscope.sources import tables as B
from callscope.streaming import incremental as I

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH RECURSIVE {corpus.SQL.strip()}, {sql.strip()}" if sql.strip()[:6].upper() != "SELECT" else f"WITH {corpus.SQL.strip()} {sql}"
        return f

    return add


def _round(df, *cols, places=6):
    return df.withColumns({c: F.round(c, places) for c in cols})


# --- tables ---------------------------------------------------------------------------------------------------

_KEY_SQL = "printf('%03d/sw%04d%s-U%04d.wav', call_id // 10, call_id, side, utt_num)"


@query(f'SELECT {_KEY_SQL} AS "Utterance File Name", text AS "Transcript" FROM u')
def src_manifest(spark, sf_dir):
    return B.build_manifest(corpus.utterances(spark, sf_dir))


@query(f"SELECT call_id, side, utt_num, printf('sw%04d%s', call_id, side) AS side_key FROM u")
def prj_parse_key(spark, sf_dir):
    k = B.parse_key(F.col("`Utterance File Name`"))
    return src_manifest(spark, sf_dir).select(*[c.alias(n) for n, c in k.items()])


@query("SELECT DISTINCT call_id, side FROM u WHERE call_id % 3 <> 0")
def src_pending_units(spark, sf_dir):
    u = corpus.utterances(spark, sf_dir)
    return B.pending_units(u.select("call_id", "side").distinct(), B.build_manifest(u.where("call_id % 3 = 0")))


@query("SELECT DISTINCT call_id, side FROM u WHERE side = 'B' AND call_id IN (SELECT o_orderkey FROM orders)")
def src_select_units(spark, sf_dir):
    calls = corpus.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call_id"))
    return B.select_units(corpus.utterances(spark, sf_dir), calls, ["B"])


@query("SELECT DISTINCT call_id, side FROM u ORDER BY call_id, side LIMIT 25")
def src_first_units(spark, sf_dir):
    return B.select_units(corpus.utterances(spark, sf_dir), limit=25)


@query("SELECT DISTINCT u.call_id, u.side, caller AS path FROM u JOIN sides USING (call_id, side)")
def src_resolve_audio(spark, sf_dir):
    units = corpus.utterances(spark, sf_dir).select("call_id", "side").distinct()
    from callscope.sources.transcripts import resolve_audio

    return resolve_audio(units, corpus.sides(spark, sf_dir).withColumnRenamed("caller", "path"))[0]


@query("SELECT DISTINCT call_id, side, 'transcript missing' AS reason FROM sides WHERE NOT EXISTS (FROM u WHERE u.call_id = sides.call_id AND u.side = sides.side AND length(u.text) > 20)")
def src_units_without_transcript(spark, sf_dir):
    """Sides none of whose utterances is longer than 20 characters count as not transcribed: the given tables have text on every side."""
    from callscope.sources.transcripts import without_transcript

    return without_transcript(corpus.sides(spark, sf_dir), corpus.utterances(spark, sf_dir).where("length(text) > 20"))


@query(f"""{TURNS_SQL}, {PAUSES_SQL} SELECT u.call_id, u.side, u.utt_num, u.text, kind, fto, latching, pause_total, pause_count, len({_TOK})::INT AS token_count FROM u JOIN ev USING (call_id, side, utt_num) JOIN pz USING (call_id, side, utt_num)""")
def src_canonical_table(spark, sf_dir):
    c = corpus.calls(spark, sf_dir)
    u, w = c["utterances"], c["words"]
    features = {
        "turns": T.transfer_columns(T.turn_events(u, w)).select(*C.KEY, "kind", "fto", "latching"),
        "pauses": O.pauses(u, w).select(*C.KEY, "pause_total", "pause_count"),
        "text": C.text_features(u).select(*C.KEY, "token_count"),
    }
    return B.build_table(u.select(*C.KEY, "text"), features)


def _registry(spark):
    rows = [(0, "token_count", "volume", "Trusted"), (1, "word_rate", "volume", "Trusted"), (2, "question_flag", "interactional", "WIP"), (3, "repetitions_current", "volume", "Trusted"), (4, "turn_gap", "interactional", "Deprecated"), (5, "laughter", "interactional", "Trusted")]
    return spark.createDataFrame(rows, "position int, column string, family string, status string")


@query(f"SELECT call_id, side, utt_num, len({_TOK})::INT AS token_count, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w = '[laughter]'))::INT AS laughter FROM u")
def src_guarded_load(spark, sf_dir):
    table = C.text_features(corpus.utterances(spark, sf_dir))
    return B.load_features(table, _registry(spark).where("column <> 'word_rate' AND column <> 'repetitions_current'"), "validated")


@query(f"SELECT call_id, side, utt_num, CASE WHEN len({CONTENT}) > 0 THEN (({CONTENT})[1] IN ({STARTERS}))::INT END AS question_flag FROM u")
def prj_family_selector(spark, sf_dir):
    table = C.text_features(corpus.utterances(spark, sf_dir))
    return B.load_features(table, _registry(spark).where("column <> 'laughter'"), "provisional", "interactional")


@query("""
m AS (SELECT call_id, side, utt_num, printf('%03d/sw%04d%s-U%04d.wav', call_id // 10, call_id, side, utt_num) AS file, round("end" - start, 6) AS d FROM u)
SELECT file, CASE WHEN utt_num % 10 = 3 THEN 'no audio' WHEN utt_num % 6 = 4 THEN 'duration differs' END AS reason FROM m""")
def src_verify_durations(spark, sf_dir):
    u = corpus.utterances(spark, sf_dir)
    key = B.format_key(F.col("call_id"), F.col("side"), F.col("utt_num"))
    audio = u.where("utt_num % 10 <> 3").select(key.alias("file"), (F.col("end") - F.col("start") + F.when(F.col("utt_num") % 6 == 4, 0.02).otherwise(0.001)).alias("seconds"))
    return B.verify_durations(B.build_manifest(u), audio, u, n=None, seed=7)


@query(f"{TURNS_SQL} SELECT u.call_id, u.side, u.utt_num, text, kind, fto FROM u LEFT JOIN ev USING (call_id, side, utt_num)")
def jn_idempotent_merge(spark, sf_dir):
    u, f = corpus.utterances(spark, sf_dir).select(*C.KEY, "text"), core.features(spark, sf_dir)
    once = B.merge_features(u, f, ["kind", "fto"])
    return B.merge_features(once, f, ["kind", "fto"])


@query("SELECT family, status, count(*) AS n FROM (SELECT c_mktsegment AS family, c_custkey % 3 AS status FROM customer) GROUP BY CUBE (family, status)")
def agg_dashboard(spark, sf_dir):
    c = corpus.table(spark, sf_dir, "customer")
    return B.dashboard(c.select(F.col("c_mktsegment").alias("family"), (F.col("c_custkey") % 3).alias("status")))


@query("""
a AS (SELECT DISTINCT n_name AS c FROM nation), b AS (SELECT n_name AS c FROM nation WHERE n_nationkey % 4 <> 0 UNION ALL SELECT r_name FROM region)
SELECT c AS "column", 'unregistered' AS problem FROM (SELECT c FROM a EXCEPT ALL SELECT c FROM b) UNION ALL SELECT c, 'missing' FROM (SELECT c FROM b EXCEPT ALL SELECT c FROM a)""")
def set_registry_differences(spark, sf_dir):
    n = corpus.table(spark, sf_dir, "nation")
    known = n.where("n_nationkey % 4 <> 0").select(F.col("n_name").alias("column")).unionByName(corpus.table(spark, sf_dir, "region").select(F.col("r_name").alias("column")))
    return B.validate_registry(n.select(F.col("n_name").alias("column")), known)


@query(f"""
l AS (SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'buy' END AS x FROM events)
SELECT section, count(*) AS n FROM (SELECT last_value(CASE WHEN event_id % 50 = 0 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS section FROM events) GROUP BY section""")
def win_section_fill(spark, sf_dir):
    e = corpus.table(spark, sf_dir, "events")
    marked = B.filled(e, F.when(F.col("event_id") % 50 == 0, F.col("event_id")), "section", "event_id", "user_id")
    return marked.groupBy("section").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{TURNS_SQL} SELECT call_id, side, utt_num, fto, 'v2' AS version FROM ev""")
def str_feature_cache(spark, sf_dir):
    f = core.features(spark, sf_dir).select(*C.KEY, "fto")
    cached = f.where("call_id % 2 = 0").withColumn("version", F.when(F.col("call_id") % 4 == 0, "v2").otherwise("v1"))
    return I.with_cache(f.select(*C.KEY), cached, lambda rows: rows.join(f, C.KEY), C.KEY, "v2")


# --- units ----------------------------------------------------------------------------------------------------

UNIT_SQL = f"""{TURNS_SQL}, {PAUSES_SQL}, {annotated.PEOPLE_SQL},
fu AS (SELECT u.call_id, u.side, u.utt_num, caller, gender, region, generation, education, ev.backchannel, ev.fto, ev.latching, ev.cooperative, ev.obstructive, ev.kind, ev.turn_initial, pz.pause_total, pz.pause_max, pz.pause_count, pz.pause_rate, len({_TOK}) AS token_count,
  round(len({_TOK}) / ("end" - start), 6) AS word_rate, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w = '[laughter]')) AS laughter, u.text
  FROM u JOIN ev USING (call_id, side, utt_num) JOIN pz USING (call_id, side, utt_num) LEFT JOIN (sides JOIN ppl USING (caller)) USING (call_id, side))
"""


def _table(spark, sf_dir):
    from callscope.operators import people

    c = corpus.calls(spark, sf_dir)
    u, w = c["utterances"], c["words"]
    parts = {
        "turns": T.transfer_columns(T.turn_events(u, w)),
        "text": C.text_features(u).select(*C.KEY, "token_count", F.round("word_rate", 6).alias("word_rate"), "laughter"),
        "pauses": O.pauses(u, w),
    }
    return people.with_demographics(B.union_rows(u.select(*C.KEY, "text"), parts), corpus.sides(spark, sf_dir), corpus.callers(spark, sf_dir))


FEATURES = ["token_count", "word_rate", "fto", "pause_total", "obstructive"]


def _mean_sql(x: str) -> str:
    """Whole millionths added up, divided and rounded half up in whole numbers."""
    s, n = f"(2 * sum(round({x} * 1000000)::BIGINT)::BIGINT + count({x}))", f"(2 * nullif(count({x}), 0))"
    return f"(({s} - ({s} % {n} + {n}) % {n}) // {n}) / 1000000.0::DOUBLE"


_SUB = "CASE WHEN backchannel = 0 THEN {} END"
_FTO = "CASE WHEN backchannel = 0 AND fto BETWEEN -2 AND 2 THEN fto END"
_MEANS = ", ".join([f"{_mean_sql(_FTO if c == 'fto' else _SUB.format(c))} AS {c}" for c in FEATURES]) + f", count_if(backchannel = 0)::BIGINT AS n_sub, count({_FTO}) AS n_fto, {_mean_sql('backchannel')} AS bc_rate"


@query(f"{UNIT_SQL} SELECT caller, {_MEANS}, min(gender) AS gender, min(region) AS region FROM fu WHERE caller IS NOT NULL GROUP BY caller HAVING count_if(backchannel = 0) >= 20")
def agg_unit_table_caller(spark, sf_dir):
    return U.unit_table(_table(spark, sf_dir).where("caller IS NOT NULL"), "caller", FEATURES, demographics=["gender", "region"], places=6)


@query(f"{UNIT_SQL} SELECT call_id, side, {_MEANS} FROM fu GROUP BY ALL HAVING count_if(backchannel = 0) >= 5")
def agg_unit_table_side(spark, sf_dir):
    return U.unit_table(_table(spark, sf_dir), ["call_id", "side"], FEATURES, min_utterances=5, places=6)


@query(f"{TURNS_SQL} SELECT call_id, side, utt_num, CASE WHEN fto BETWEEN -2 AND 2 THEN fto END AS fto FROM ev")
def prj_response_window(spark, sf_dir):
    return core.features(spark, sf_dir).select(*C.KEY, U.in_window(F.col("fto")).alias("fto"))


@query(f"{TURNS_SQL} SELECT call_id, side, utt_num, kind FROM ev WHERE turn_initial = 1")
def prj_turn_initial(spark, sf_dir):
    return core.features(spark, sf_dir).where("turn_initial = 1").select(*C.KEY, "kind")


@query(f"{UNIT_SQL} SELECT call_id, side, utt_num, token_count::DOUBLE AS token_count, fto FROM fu WHERE backchannel = 0 AND fto IS NOT NULL")
def agg_utterance_level(spark, sf_dir):
    rows, _ = U.utterance_level(_table(spark, sf_dir), ["token_count", "fto"])
    return rows.select(*C.KEY, "token_count", "fto")


@query(f"{UNIT_SQL} SELECT count_if(fto IS NOT NULL)::BIGINT AS n_kept, count_if(fto IS NULL)::BIGINT AS n_dropped FROM fu WHERE backchannel = 0")
def agg_utterance_level_counts(spark, sf_dir):
    return U.utterance_level(_table(spark, sf_dir), ["token_count", "fto"])[1]


@query("SELECT round(quantile_cont(value, 0.01), 6) AS value_lo, round(quantile_cont(value, 0.99), 6) AS value_hi, round(min(value), 6) AS value_min FROM events")
def agg_winsor_bounds(spark, sf_dir):
    return _round(U.winsor_bounds(corpus.table(spark, sf_dir, "events"), ["value"]), "value_lo", "value_hi", "value_min")


@query("""b AS (SELECT quantile_cont(o_totalprice, 0.01) AS lo, quantile_cont(o_totalprice, 0.99) AS hi, quantile_cont(o_orderkey, 0.01) AS klo, quantile_cont(o_orderkey, 0.99) AS khi FROM orders)
SELECT o_custkey, round(ln(1 + least(greatest(o_totalprice, lo), hi)), 6) AS o_totalprice, round(ln(1 + least(greatest(o_orderkey, klo), khi)), 6) AS o_orderkey FROM orders, b""")
def scl_winsor_log(spark, sf_dir):
    o = corpus.table(spark, sf_dir, "orders").select("o_custkey", F.col("o_totalprice").cast("double").alias("o_totalprice"), F.col("o_orderkey").cast("double").alias("o_orderkey"))
    return _round(U.winsor_log(o, ["o_totalprice", "o_orderkey"]), "o_totalprice", "o_orderkey")


LEXICON = [("family", "personal"), ("home", "personal"), ("the", "personal"), ("of", "impersonal"), ("in", "impersonal"), ("and", "impersonal"), ("that", "personal")]
LEXICON_SQL = "lx AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in LEXICON) + ") v(term, bucket)), hw AS (SELECT call_id, side, utt_num, unnest(" + _TOK + ") AS token FROM u), ph AS (SELECT call_id, side, utt_num, count_if(bucket = 'personal')::BIGINT AS personal, count_if(bucket = 'impersonal')::BIGINT AS impersonal, count(*) AS analyzed FROM hw LEFT JOIN lx ON token = term GROUP BY ALL)"


def _lexicon(spark):
    """Of a size that Spark knows, so that tokens meet it where they are."""
    return spark.createDataFrame(pa.table({"term": [a for a, _ in LEXICON], "bucket": [b for _, b in LEXICON]}))


def _hits(spark, sf_dir):
    w = corpus.utterances(spark, sf_dir).select(*C.KEY, F.explode(X.tokens(F.col("text"))).alias("token"))
    return U.personal_hits(w, _lexicon(spark), C.KEY)


@query(f"{LEXICON_SQL.replace('count_if(', 'coalesce(count_if(').replace(')::BIGINT', '), 0)::BIGINT')} SELECT *, CASE WHEN personal + impersonal >= 3 THEN round(personal / (personal + impersonal), 6) END AS score FROM ph")
def scl_personal_focus(spark, sf_dir):
    return _hits(spark, sf_dir)


@query(rf"tg AS (SELECT call_id, side, utt_num, count_if(lower(token) IN ('i', 'you', 'it', 'that')) AS n FROM w GROUP BY ALL) SELECT u.call_id, u.side, u.utt_num, round(coalesce(n, 0) / (\"end\" - start), 6) AS per_second FROM u LEFT JOIN tg USING (call_id, side, utt_num)".replace('\\"', '"'))
def scl_pronoun_rate(spark, sf_dir):
    tagged = corpus.words(spark, sf_dir).select(*C.KEY, F.when(F.lower("token").isin("i", "you", "it", "that"), "PRON").otherwise("X").alias("pos"))
    return U.tagged_rate(tagged, corpus.utterances(spark, sf_dir), C.KEY)


PANEL_SQL = f"""{UNIT_SQL}, {annotated.SLOPE_SQL}, {LEXICON_SQL.replace('count_if(', 'coalesce(count_if(').replace(')::BIGINT', '), 0)::BIGINT')},
pj AS (SELECT fu.*, rising, personal, impersonal FROM fu LEFT JOIN sl USING (call_id, side, utt_num) LEFT JOIN ph USING (call_id, side, utt_num)),
pn AS (SELECT call_id, side, sum(CASE WHEN backchannel = 0 THEN personal + impersonal END)::BIGINT AS hits, sum(CASE WHEN backchannel = 0 THEN personal END) AS personal, round(avg(CASE WHEN backchannel = 0 THEN rising END), 6) AS rising_share, round(avg(CASE WHEN backchannel = 0 THEN (rising IS NOT NULL)::INT END), 6) AS rising_defined,
  round(sum(CASE WHEN backchannel = 0 THEN coalesce(rising, 0) END) / nullif(count_if(backchannel = 0), 0), 6) AS rising_lower_bound, round(100 * sum(laughter) / count(*), 6) AS laughs_per100, round(sum(obstructive) / nullif(sum(obstructive + cooperative), 0), 6) AS obstructive_share FROM pj GROUP BY ALL)
"""


def _panel(spark, sf_dir):
    t = _table(spark, sf_dir).join(annotated._slopes(spark, sf_dir).select(*C.KEY, "rising"), C.KEY, "left").join(_hits(spark, sf_dir).select(*C.KEY, "personal", "impersonal"), C.KEY, "left")
    return U.panel(t, ["call_id", "side"])


@query(f"{PANEL_SQL} SELECT call_id, side, hits, CASE WHEN hits >= 30 THEN round(personal / hits, 6) END AS focus_ratio, rising_share, rising_defined, rising_lower_bound, laughs_per100, obstructive_share FROM pn")
def agg_panel(spark, sf_dir):
    return _panel(spark, sf_dir)


@query(f"{PANEL_SQL} SELECT count(*) AS n_units, round(avg((coalesce(hits, 0) >= 10)::INT), 6) AS share_10, round(avg((coalesce(hits, 0) >= 30)::INT), 6) AS share_30, round(avg((coalesce(hits, 0) >= 100)::INT), 6) AS share_100 FROM pn")
def agg_coverage(spark, sf_dir):
    return U.coverage(_panel(spark, sf_dir))


@query(f"{UNIT_SQL}, d AS (SELECT call_id, side, caller, backchannel AS listed, (token_count <= 2)::INT AS short FROM fu), l AS (SELECT 'listed' AS bc_def, call_id, side, caller, listed AS bc FROM d UNION ALL SELECT 'short', call_id, side, caller, short FROM d UNION ALL SELECT 'none', call_id, side, caller, 0 FROM d), n AS (SELECT bc_def, 'caller' AS unit, caller::VARCHAR AS id, count_if(bc = 0) AS k FROM l WHERE caller IS NOT NULL GROUP BY ALL UNION ALL SELECT bc_def, 'side', call_id || side, count_if(bc = 0) FROM l GROUP BY ALL), m AS (SELECT unnest([5, 10, 20]) AS min_utt) SELECT bc_def, unit, min_utt, count_if(k >= min_utt)::BIGINT AS n_units FROM n, m GROUP BY ALL")
def agg_units_kept(spark, sf_dir):
    t = _table(spark, sf_dir)
    bc = F.explode(F.array(*[F.struct(F.lit(n).alias("bc_def"), c.alias("bc")) for n, c in (("listed", F.col("backchannel")), ("short", (F.col("token_count") <= 2).cast("int")), ("none", F.lit(0)))])).alias("d")
    unit = F.explode(F.array(F.struct(F.lit("caller").alias("unit"), F.col("caller").cast("string").alias("id")), F.struct(F.lit("side").alias("unit"), F.concat(F.col("call_id").cast("string"), "side").alias("id")))).alias("v")
    n = t.select("call_id", "side", "caller", bc).select("call_id", "side", "caller", "d.*").select("bc_def", "bc", unit).where("v.id IS NOT NULL").groupBy("bc_def", "v.unit", "v.id").agg(F.count_if(F.col("bc") == 0).alias("k"))
    return n.select("*", F.explode(F.array(F.lit(5), F.lit(10), F.lit(20))).alias("min_utt")).groupBy("bc_def", "unit", "min_utt").agg(F.count_if(F.col("k") >= F.col("min_utt")).alias("n_units"))


@query("SELECT count(*) AS n_rows, count(DISTINCT u.call_id) AS n_calls, count(DISTINCT (u.call_id, u.side)) AS n_sides, count(DISTINCT caller) AS n_callers FROM u LEFT JOIN sides USING (call_id, side)")
def agg_distinct_units(spark, sf_dir):
    u = corpus.utterances(spark, sf_dir).join(corpus.sides(spark, sf_dir), ["call_id", "side"], "left")
    return u.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("call_id").alias("n_calls"), F.countDistinct("call_id", "side").alias("n_sides"), F.countDistinct("caller").alias("n_callers"))


# --- audits ---------------------------------------------------------------------------------------------------


@query(f"""{UNIT_SQL} SELECT * FROM (SELECT 'fto_without_turn_start' AS rule, count_if(fto IS NOT NULL AND turn_initial = 0)::BIGINT AS n_violations FROM fu UNION ALL SELECT 'latch_outside_window', coalesce(count_if(latching = 1 AND (fto < 0 OR fto > 0.2)), 0)::BIGINT FROM fu UNION ALL SELECT 'pause_total_below_max', count_if(pause_total < pause_max)::BIGINT FROM fu
UNION ALL SELECT 'pause_count_and_max_disagree', count_if((pause_count >= 1) <> (pause_max >= 0.25))::BIGINT FROM fu UNION ALL SELECT 'pause_rate_above_one', count_if(pause_rate > 1)::BIGINT FROM fu)""")
def agg_invariants(spark, sf_dir):
    return Q.audit(_table(spark, sf_dir))


@query(f"{UNIT_SQL} SELECT call_id, count(*) AS n, count_if(fto IS NULL)::BIGINT AS fto_nulls, count_if(pause_total IS NULL)::BIGINT AS pause_total_nulls FROM fu GROUP BY call_id")
def agg_null_structure(spark, sf_dir):
    return Q.null_structure(_table(spark, sf_dir), ["fto", "pause_total"], "call_id")


@query(f"{UNIT_SQL} SELECT CASE WHEN token_count <= 2 THEN '1-2' WHEN token_count <= 5 THEN '3-5' WHEN token_count <= 10 THEN '6-10' ELSE '11+' END AS length, count(*) AS n, round(avg((fto IS NULL)::INT), 6) AS null_share FROM fu GROUP BY 1")
def agg_missing_by_length(spark, sf_dir):
    return Q.missing_by(_table(spark, sf_dir), "fto", Q.length_bucket(F.col("token_count")), "length")


@query(f"{UNIT_SQL} SELECT gender, count(*) AS n, round(avg((pause_total IS NULL)::INT), 6) AS null_share FROM fu GROUP BY 1")
def agg_missing_by_gender(spark, sf_dir):
    return Q.missing_by(_table(spark, sf_dir), "pause_total", F.col("gender"), "gender")


@query(f"{UNIT_SQL} SELECT (SELECT count(*) FROM u) AS rows_before, count(*) AS rows_after, count_if(fto IS NULL)::BIGINT AS fto_nulls FROM fu")
def jn_merge_drift(spark, sf_dir):
    return Q.drift(corpus.utterances(spark, sf_dir), _table(spark, sf_dir), ["fto"])


@query(f"{UNIT_SQL}, z AS (SELECT *, CASE WHEN token_count >= 20 THEN 2 WHEN token_count >= 10 THEN 1 ELSE 0 END AS label FROM fu) SELECT label, count(*) AS n, round(avg(token_count), 6) AS mean_tokens, round(avg((token_count <= 2)::INT), 6) AS short_share, round(avg(word_rate), 6) AS word_rate FROM z GROUP BY label")
def agg_cluster_profile(spark, sf_dir):
    n = F.col("token_count")
    z = _table(spark, sf_dir).withColumn("label", F.when(n >= 20, 2).when(n >= 10, 1).otherwise(0))
    return z.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("token_count"), 6).alias("mean_tokens"), F.round(F.avg((n <= 2).cast("double")), 6).alias("short_share"), F.round(F.avg("word_rate"), 6).alias("word_rate"))


# --- group comparisons, over customers and orders ---------------------------------------------------------------


@query("SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS sd FROM customer GROUP BY 1 HAVING count(*) >= 5")
def agg_group_table(spark, sf_dir):
    return _round(S.group_table(_customers(spark, sf_dir), "c_mktsegment", "c_acctbal"), "mean", "sd")


def _customers(spark, sf_dir):
    return corpus.table(spark, sf_dir, "customer").withColumn("c_acctbal", F.col("c_acctbal").cast("double"))


@query(None)
def agg_welch_t(spark, sf_dir):
    return S.welch_t(_customers(spark, sf_dir), F.col("c_mktsegment") == "BUILDING", "c_acctbal")


@query("""g AS (SELECT c_mktsegment = 'BUILDING' AS b, count(*) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer GROUP BY 1)
SELECT x.n AS n1, y.n AS n2, round((x.m - y.m) / sqrt(x.v / x.n + y.v / y.n), 6) AS t, round((x.v / x.n + y.v / y.n) ** 2 / ((x.v / x.n) ** 2 / (x.n - 1) + (y.v / y.n) ** 2 / (y.n - 1)), 6) AS dof, round((x.m - y.m) / sqrt((x.v + y.v) / 2), 6) AS cohen_d FROM g x, g y WHERE x.b AND NOT y.b""")
def agg_welch_t_statistic(spark, sf_dir):
    return agg_welch_t(spark, sf_dir).drop("p")


@query(None)
def agg_anova(spark, sf_dir):
    return S.anova(_customers(spark, sf_dir), "c_mktsegment", "c_acctbal")


@query("""g AS (SELECT c_mktsegment AS k, count(*) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer GROUP BY 1 HAVING count(*) >= 5),
s AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m) AS nm, sum(n * m * m) AS nmm, sum((n - 1) * v) AS wi, sum(n / v) AS w, sum(n / v * m) AS wm, sum(n / v * m * m) AS wmm FROM g),
l AS (SELECT sum((1 - n / v / (SELECT w FROM s)) ** 2 / (n - 1)) AS lam FROM g)
SELECT k, round((nmm - nm * nm / n) / (k - 1) / (wi / (n - k)), 6) AS f, (n - k)::DOUBLE AS dof, round((wmm - wm * wm / w) / (k - 1) / (1 + 2 * (k - 2) / (k * k - 1) * lam), 6) AS welch_f, round((k * k - 1) / (3 * lam), 6) AS welch_dof FROM s, l""")
def agg_anova_statistic(spark, sf_dir):
    return agg_anova(spark, sf_dir).drop("p", "welch_p")


@query("""x AS (SELECT o_totalprice::DOUBLE AS v FROM orders), m AS (SELECT avg(v) AS a, count(v) AS n FROM x), c AS (SELECT avg((v - a) ** 2) AS m2, avg((v - a) ** 3) AS m3, avg((v - a) ** 4) AS m4, any_value(n) AS n FROM x, m)
SELECT 'o_totalprice' AS name, n, round(m3 / m2 ** 1.5, 6) AS skewness, round(m4 / m2 ** 2 - 3, 6) AS kurtosis FROM c""")
def agg_shape(spark, sf_dir):
    return S.shape(corpus.table(spark, sf_dir, "orders"), ["o_totalprice"])


@query("SELECT * FROM (SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem)")
def agg_correlations(spark, sf_dir):
    return S.correlations(corpus.table(spark, sf_dir, "lineitem").select(*[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount")]), ["l_quantity", "l_extendedprice", "l_discount"])


@query("""r AS (SELECT c_mktsegment, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2.0 AS a, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) - 1) / 2.0 AS b FROM customer)
SELECT c_mktsegment, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY 1""")
def agg_spearman(spark, sf_dir):
    return S.spearman(_customers(spark, sf_dir), "c_acctbal", "c_nationkey", ["c_mktsegment"])


@query("""r AS (SELECT c_mktsegment, c_custkey % 3 = 0 AS p, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) - 1) / 2.0 AS r FROM customer)
SELECT c_mktsegment, count_if(p)::BIGINT AS n1, count_if(NOT p)::BIGINT AS n0, round((sum(CASE WHEN p THEN r END) - count_if(p) * (count_if(p) + 1) / 2) / (count_if(p) * count_if(NOT p)), 6) AS auc FROM r GROUP BY 1""")
def agg_auc(spark, sf_dir):
    return S.auc(_customers(spark, sf_dir), F.col("c_custkey") % 3 == 0, "c_nationkey", "c_mktsegment")


@query("""p AS (SELECT p_brand AS family, p_partkey, (p_partkey * 37 % 1009 + 1) / 1010.0::DOUBLE AS p FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p) AS r, count(*) OVER (PARTITION BY family) AS m FROM p)
SELECT family, p_partkey, p, round(least(min(p * m / r) OVER (PARTITION BY family ORDER BY r DESC), 1.0), 9) AS p_adjusted FROM r""")
def win_adjusted_p(spark, sf_dir):
    p = corpus.table(spark, sf_dir, "part").select(F.col("p_brand").alias("family"), "p_partkey", ((F.col("p_partkey") * 37 % 1009 + 1) / 1010.0).alias("p"))
    return S.adjusted_p(p, "p", "family")


@query("SELECT c_custkey, round(rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) / (count(*) OVER (PARTITION BY c_mktsegment) + 1), 9) AS percentile FROM customer")
def win_percentile(spark, sf_dir):
    return S.percentile_rank(_customers(spark, sf_dir), "c_acctbal", "c_mktsegment").select("c_custkey", "percentile")


@query("SELECT side, text, n, place FROM (SELECT side, text, count(*) AS n, row_number() OVER (PARTITION BY side ORDER BY count(*) DESC, text)::INT AS place FROM u GROUP BY side, text) WHERE place <= 12")
def srt_top_transcripts(spark, sf_dir):
    return S.top_groups(corpus.utterances(spark, sf_dir), "side", "text", 12)


@query(f"{TURNS_SQL} SELECT fto, call_id, side, utt_num FROM ev WHERE fto IS NOT NULL ORDER BY fto DESC, call_id, side, utt_num LIMIT 20")
def srt_largest(spark, sf_dir):
    return S.largest(core.features(spark, sf_dir), "fto", 20, *C.KEY)


@query("r AS (SELECT c_custkey, c_acctbal::DOUBLE AS c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS r, count(*) OVER () AS n FROM customer) SELECT a AS \"at\", c_custkey, c_acctbal FROM r, (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95])::DOUBLE AS a) WHERE r = greatest(1, ceil(a * n))")
def srt_representatives(spark, sf_dir):
    return S.representatives(_customers(spark, sf_dir), "c_acctbal", "c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def jn_semi(spark, sf_dir):
    o = corpus.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return corpus.table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left_semi")


@query("SELECT call_id, side, utt_num FROM u ANTI JOIN acts a ON u.call_id = a.call_id AND u.side = a.side AND u.utt_num = a.act_id")
def jn_anti(spark, sf_dir):
    a = corpus.acts(spark, sf_dir).select("call_id", "side", F.col("act_id").alias("utt_num"))
    return corpus.utterances(spark, sf_dir).select(*C.KEY).join(a, C.KEY, "left_anti")


@query("SELECT call_id, side, utt_num, text FROM u WHERE side = 'A' UNION ALL SELECT call_id, side, utt_num, text FROM u WHERE side = 'B'")
def set_union_sides(spark, sf_dir):
    u = corpus.utterances(spark, sf_dir).select(*C.KEY, "text")
    return u.where("side = 'A'").unionByName(u.where("side = 'B'"))


@query(f"SELECT call_id, side, utt_num, len({_TOK})::INT AS token_count, {BC_SQL} AS backchannel, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w = '[noise]'))::INT AS noise FROM u")
def set_column_union(spark, sf_dir):
    return B.union_columns(C.text_features(corpus.utterances(spark, sf_dir)), ["token_count", "backchannel"], ["backchannel", "noise"])


@query(f"{UNIT_SQL} SELECT education, count(*) AS n, round(avg(token_count), 4) AS mean_tokens FROM fu WHERE education IS NOT NULL AND education NOT IN ('0', '9') GROUP BY 1 HAVING count(*) >= 5")
def prj_known_education(spark, sf_dir):
    known = _table(spark, sf_dir).where(F.col("education").isNotNull() & ~F.col("education").isin("0", "9"))
    return known.groupBy("education").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("token_count"), 4).alias("mean_tokens")).where("n >= 5")


@query(f"SELECT call_id, side, utt_num, len({_TOK}) >= 0 AND len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '' AND NOT (starts_with(w, '[') AND ends_with(w, ']')))) >= 5 AND regexp_matches({_BARE}, '{X.FIRST_PERSON}') AS may_be_anecdote FROM u")
def scl_anecdote_candidate(spark, sf_dir):
    return corpus.utterances(spark, sf_dir).select(*C.KEY, X.may_be_anecdote(F.col("text")).alias("may_be_anecdote"))


@query(f"{TURNS_SQL} SELECT call_id, side, utt_num, kind, fto FROM ev ORDER BY call_id, side, utt_num")
def srt_manifest_order(spark, sf_dir):
    return core.features(spark, sf_dir).select(*C.KEY, "kind", "fto").orderBy(*C.KEY)


@query(f"SELECT call_id, side, utt_num, len({_TOK})::INT AS token_count, {BC_SQL} AS backchannel, CASE WHEN \"end\" > start THEN round(len({_TOK}) / (\"end\" - start), 6) END AS word_rate FROM u")
def udf_run_feature(spark, sf_dir):
    u = corpus.utterances(spark, sf_dir)
    out = R.run_feature("token_count", u)
    for name in ("backchannel", "word_rate"):
        out = out.join(R.run_feature(name, u), C.KEY)
    return out


@query(f"SELECT call_id, side, utt_num, i, token, CASE WHEN length(token) % 2 = 0 THEN 'even' ELSE 'odd' END AS tag FROM w")
def udf_tag_tokens(spark, sf_dir):
    words = corpus.words(spark, sf_dir)
    return R.tag_tokens(words, lambda: lambda tokens: ["odd" if len(t) % 2 else "even" for t in tokens]).select(*C.KEY, "i", "token", "tag")


ALL_SQL = f"""{TURNS_SQL}, {PAUSES_SQL}, {core.OVERLAP_SQL}, {annotated.SLOPE_SQL}, {annotated.PITCH_SQL}, {annotated.PEOPLE_SQL}, {LEXICON_SQL.replace('count_if(', 'coalesce(count_if(').replace(')::BIGINT', '), 0)::BIGINT')},
cv AS (SELECT DISTINCT conv_id AS call_id, (conv_id % 7)::INT AS topic_no FROM conversations), tp AS (SELECT r_regionkey AS topic_no, r_name AS topic FROM region),
mb AS (SELECT call_id, side, utt_num, len({_TOK}) AS tc, CASE WHEN len({CONTENT}) > 0 THEN (({CONTENT})[1] IN ({STARTERS}))::INT END AS q FROM u),
mj AS (SELECT mb.*, ev.backchannel, ev.onset_gap, sl.rising, pm.pitch_mean, bl.high_pitch FROM mb JOIN ev USING (call_id, side, utt_num) LEFT JOIN sl USING (call_id, side, utt_num) LEFT JOIN pm USING (call_id, side, utt_num) LEFT JOIN bl USING (call_id, side)),
mg AS (SELECT *, CASE WHEN backchannel = 1 THEN NULL WHEN coalesce(q, 0) = 0 AND rising IS NULL THEN NULL WHEN coalesce(q, 0) = 0 AND rising = 0 THEN 0 ELSE 1 + (tc <= 4)::INT + coalesce((onset_gap <= 0.5)::INT, 0) + coalesce((round(pitch_mean, 9) >= round(high_pitch, 9))::INT, 0) END AS mgq_score FROM mj)
"""
#: Feature names of every kind of input, each family of the catalogue once at least.
EACH_KIND = ["token_count", "word_rate", "floor_transfer", "latching", "overlap_split", "overlap", "pauses", "rising_terminal", "marked_question", "personal_focus", "demographics", "topic"]


@query(f"""{ALL_SQL} SELECT u.call_id, u.side, u.utt_num, len({_TOK})::INT AS token_count, CASE WHEN "end" > start THEN round(len({_TOK}) / ("end" - start), 6) END AS word_rate,
  ev.kind, ev.fto, ev.onset_gap, ev.turn_initial, ev.backchannel AS turn_backchannel, ev.interjection, ev.latching, ev.cooperative, ev.obstructive, overlap_sec, overlap_count, overlap_onset, pause_total, pause_count, pause_rate, pause_max,
  slope_hz, slope_st, sl.rising, mgq_score, (mgq_score = 4)::INT AS mgq_flag, personal, impersonal, analyzed, CASE WHEN personal + impersonal >= 3 THEN round(personal / (personal + impersonal), 6) END AS score,
  caller, gender, region, birth_year, generation, decade, education, coalesce(topic, 'UNK') AS topic
FROM u LEFT JOIN ev USING (call_id, side, utt_num) LEFT JOIN ovl USING (call_id, side, utt_num) LEFT JOIN pz USING (call_id, side, utt_num) LEFT JOIN sl USING (call_id, side, utt_num) LEFT JOIN mg USING (call_id, side, utt_num)
LEFT JOIN ph USING (call_id, side, utt_num) LEFT JOIN (sides JOIN ppl USING (caller)) pe USING (call_id, side) LEFT JOIN cv USING (call_id) LEFT JOIN tp ON cv.topic_no = tp.topic_no""")
def udf_run_features(spark, sf_dir):
    """Features of every kind of input by name, in one run."""
    c = corpus.calls(spark, sf_dir)
    inputs = {
        "utterances": c["utterances"],
        "words": c["words"],
        "frames": corpus.frames(spark, sf_dir, c["pieces"]),
        "lexicon": _lexicon(spark),
        "sides": corpus.sides(spark, sf_dir),
        "callers": corpus.callers(spark, sf_dir),
        "conversations": corpus.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("call_id"), (F.col("conv_id") % 7).cast("string").alias("topic_no")).distinct(),
        "topics": corpus.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("topic_no"), F.col("r_name").alias("topic")),
    }
    return R.run_features(EACH_KIND, inputs)


def _energy(frame):
    """A user's analyser: mean power and number of an utterance's frames."""
    return {"energy": [float((frame["rms"] ** 2).mean())], "n_frames": [len(frame["rms"])]}


@query("SELECT call_id, side, utt_num, round(avg(rms * rms), 12) AS energy, count(*) AS n_frames FROM fr GROUP BY ALL")
def udf_frame_energy(spark, sf_dir):
    out = analysis.analyse(corpus.frames(spark, sf_dir), analysis.whole(_energy), "energy double, n_frames long", ["rms"])
    return out.withColumn("energy", F.round("energy", 12))


_TAPER = "(0.5 - 0.5 * cos(2 * pi() * j / 16))"


@query(f"""sm AS (SELECT call_id, side, utt_num, list_transform(string_split(text, ''), lambda c: ascii(c)::DOUBLE) AS x FROM u WHERE length(text) > 0),
sp2 AS (SELECT call_id, side, utt_num, x || list_transform(range(0, greatest(16 - len(x), 0)), lambda i: 0.0::DOUBLE) AS x FROM sm),
k AS (SELECT call_id, side, utt_num, x, unnest(range(0, (len(x) - 16) // 8 + 1)) AS k FROM sp2)
SELECT call_id, side, utt_num, k * 8 AS t, round(sqrt(list_sum(list_transform(range(0, 16), lambda j: (x[k * 8 + j + 1] * {_TAPER}) ** 2)) / 16), 6) AS rms FROM k""")
def scl_frame_rms(spark, sf_dir):
    """Characters of the text stand for samples, in rows of ten, so that frames reach over rows."""
    u = corpus.utterances(spark, sf_dir).where("length(text) > 0")
    at = F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 10).cast("int"))).alias("block")
    rows = u.select(*C.KEY, "text", at).select(*C.KEY, "block", F.transform(F.split(F.substring(F.col("text"), F.col("block") * 10 + 1, F.lit(10)), ""), lambda c: F.ascii(c).cast("double")).alias("samples"))
    return prosody.frame_rms(rows, "samples", 16, 8, "block").withColumn("rms", F.round("rms", 6))
