"""Queries on text features, chronology, turns, overlap, pauses and prosody, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from callscope.functions import text as X
from callscope.operators import chronology as C
from callscope.operators import overlap as O
from callscope.operators import turns as T
from callscope.plans import corpus

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH RECURSIVE {corpus.SQL.strip()}, {sql.strip()}" if sql.strip()[:6].upper() != "SELECT" else f"WITH {corpus.SQL.strip()} {sql}"
        return f

    return add


def features(spark, sf_dir):
    u, w = corpus.utterances(spark, sf_dir), corpus.words(spark, sf_dir)
    return T.transfer_columns(T.turn_events(u, w))


_LIST = lambda xs: ", ".join(f"'{x}'" for x in xs)
_WORDS = r"list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')"
_BARE = r"array_to_string(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '' AND NOT (starts_with(w, '[') AND ends_with(w, ']'))), ' ')"
_TOK = f"list_filter({_WORDS}, lambda w: NOT (starts_with(w, '[') AND ends_with(w, ']')))"
_BC = rf"list_filter(list_transform({_WORDS}, lambda w: regexp_replace(regexp_replace(w, '^[[:punct:]]+', ''), '[[:punct:]]+$', '')), lambda w: w <> '')"
BC_SQL = f"CASE WHEN len({_BC}) > 0 AND len(list_filter({_BC}, lambda w: w NOT IN ({_LIST(X.BACKCHANNELS)}))) = 0 THEN 1 ELSE 0 END"
_STRIP = r"regexp_replace(regexp_replace(w, '^[\"''.,!?;:()\[\]]+', ''), '[\"''.,!?;:()\[\]]+$', '')".replace('\\"', '"')
CONTENT_SQL = rf"list_filter(list_transform(list_filter(string_split_regex(TXT, '\s+'), lambda w: w <> '' AND NOT (starts_with(w, '[') AND ends_with(w, ']'))), lambda w: lower({_STRIP})), lambda w: w <> '')"
CONTENT = CONTENT_SQL.replace("TXT", "text")
STARTERS = _LIST((*X.QUESTION_WORDS, *X.AUXILIARIES))
ORDER = 'PARTITION BY call_id ORDER BY start, "end", utt_num, side'

TURNS_SQL = f"""
tight AS (SELECT call_id, side, utt_num, min(start) AS ws, max("end") AS we FROM w GROUP BY ALL),
tb AS (SELECT u.call_id, u.side, u.utt_num, coalesce(ws, start) AS w_start, coalesce(we, "end") AS w_end, {BC_SQL} AS lex_bc, start, "end" FROM u LEFT JOIN tight USING (call_id, side, utt_num)),
rk AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY w_start, w_end, utt_num, start, "end", side) AS r FROM tb),
walk AS (
  SELECT call_id, r, side, utt_num, w_start, w_end, lex_bc, CASE WHEN lex_bc = 1 THEN 'bc' ELSE 'first' END AS kind, NULL::DOUBLE AS ref_end,
    CASE WHEN lex_bc = 1 THEN NULL ELSE side END AS cur, CASE WHEN lex_bc = 1 THEN NULL ELSE w_end END AS turn_end,
    CASE WHEN lex_bc = 0 AND side = 'A' THEN greatest(0.0, w_end) ELSE 0.0 END AS la, CASE WHEN lex_bc = 0 AND side = 'B' THEN greatest(0.0, w_end) ELSE 0.0 END AS lb
  FROM rk WHERE r = 1
  UNION ALL
  SELECT n.call_id, n.r, n.side, n.utt_num, n.w_start, n.w_end, n.lex_bc,
    CASE WHEN n.lex_bc = 1 AND n.side IS DISTINCT FROM p.cur THEN 'bc' WHEN p.cur IS NULL THEN 'first' WHEN n.side = p.cur THEN 'cont' WHEN n.w_end <= p.turn_end THEN 'interj' ELSE 'transfer' END,
    CASE WHEN n.lex_bc = 1 AND n.side IS DISTINCT FROM p.cur THEN p.turn_end WHEN p.cur IS NULL THEN NULL WHEN n.side = p.cur THEN CASE n.side WHEN 'A' THEN p.la ELSE p.lb END ELSE p.turn_end END,
    CASE WHEN n.lex_bc = 1 AND n.side IS DISTINCT FROM p.cur THEN p.cur WHEN p.cur IS NULL THEN n.side WHEN n.side = p.cur THEN p.cur WHEN n.w_end <= p.turn_end THEN p.cur ELSE n.side END,
    CASE WHEN n.lex_bc = 1 AND n.side IS DISTINCT FROM p.cur THEN p.turn_end WHEN p.cur IS NULL THEN n.w_end WHEN n.side = p.cur THEN greatest(p.turn_end, n.w_end) WHEN n.w_end <= p.turn_end THEN p.turn_end ELSE n.w_end END,
    CASE WHEN n.side = 'A' AND NOT (n.lex_bc = 1 AND n.side IS DISTINCT FROM p.cur) THEN greatest(p.la, n.w_end) ELSE p.la END,
    CASE WHEN n.side = 'B' AND NOT (n.lex_bc = 1 AND n.side IS DISTINCT FROM p.cur) THEN greatest(p.lb, n.w_end) ELSE p.lb END
  FROM walk p JOIN rk n ON n.call_id = p.call_id AND n.r = p.r + 1),
ev0 AS (SELECT call_id, side, utt_num, w_start, w_end, lex_bc, kind, ref_end, round(w_start - ref_end, 6) AS gap,
  ref_end IS NOT NULL AND w_start < ref_end AND kind IN ('bc', 'interj', 'transfer') AS ov FROM walk),
ev1 AS (SELECT *, ov AND kind = 'transfer' AND round(ref_end - w_start, 6) <= 1.0 AS obs, CASE WHEN kind = 'transfer' THEN gap END AS fto FROM ev0),
ev AS (SELECT call_id, side, utt_num, kind, w_start, w_end, ref_end, fto, CASE WHEN kind IN ('cont', 'interj', 'transfer') THEN gap END AS onset_gap, (kind IN ('first', 'transfer'))::INT AS turn_initial,
  CASE kind WHEN 'bc' THEN 1 WHEN 'cont' THEN lex_bc ELSE 0 END AS backchannel, (kind = 'interj')::INT AS interjection, CASE WHEN fto IS NOT NULL THEN (fto BETWEEN 0 AND 0.2)::INT END AS latching,
  (ov AND NOT obs)::INT AS cooperative, obs::INT AS obstructive FROM ev1)
"""
SUMMARY = "count(*) AS n, round(quantile_cont(fto, 0.5), 6) AS median_fto, round(avg(fto), 6) AS mean_fto, round(avg((fto < 0)::INT), 6) AS overlap_share, round(avg((fto BETWEEN -1 AND 2)::INT), 6) AS window_share, round(avg(latching), 6) AS latch_rate"


@query('SELECT call_id, side, utt_num, start, "end", text FROM u')
def prj_utterances(spark, sf_dir):
    return corpus.utterances(spark, sf_dir)


@query('SELECT call_id, side, utt_num, i, start, "end", token FROM w')
def prj_words(spark, sf_dir):
    return corpus.words(spark, sf_dir)


_N = f"len(list_filter(t, lambda x: x = w))"


@query(rf"""
t AS (SELECT call_id, side, utt_num, text, "end" - start AS sec, {_TOK} AS t, list_filter(string_split_regex(text, '\s+'), lambda w: starts_with(w, '[') AND ends_with(w, ']')) AS b, {CONTENT} AS c FROM u),
f AS (SELECT call_id, side, utt_num, unnest(t) AS w FROM t), n AS (SELECT call_id, side, utt_num, w, count(*) AS n FROM f GROUP BY ALL),
r AS (SELECT call_id, side, utt_num, count_if(n >= 2) AS types, sum(n * (n - 1) // 2) AS pairs FROM n GROUP BY ALL),
s AS (SELECT call_id, side, utt_num, sum(CASE WHEN regexp_matches(w, '[a-z]') THEN greatest(len(regexp_extract_all(w, '[aeiouy]+')), 1) ELSE 0 END) AS syl FROM f GROUP BY ALL)
SELECT call_id, side, utt_num, len(t)::INT AS token_count, round(len(t) / sec, 6) AS word_rate, round(coalesce(syl, 0) / sec, 6) AS syllable_rate,
  len(regexp_extract_all(' ' || array_to_string(t, '  ') || ' ', ' (you  know|i  mean|i  guess|um|uh|like|so|well|basically|er) '))::INT AS filler_hits,
  round(len(regexp_extract_all(' ' || array_to_string(t, '  ') || ' ', ' (you  know|i  mean|i  guess|um|uh|like|so|well|basically|er) ')) / sec, 6) AS fillers_per_second,
  round(coalesce(types, 0) / sec, 6) AS repetitions_per_second, coalesce(pairs, 0)::BIGINT AS repetitions_current,
  len(list_filter(b, lambda w: w = '[laughter]'))::INT AS laughter, len(list_filter(b, lambda w: starts_with(w, '[laughter-')))::INT AS laughed_words, len(list_filter(b, lambda w: w = '[noise]'))::INT AS noise,
  len(list_filter(b, lambda w: w = '[vocalized-noise]'))::INT AS vocalized_noise, len(list_filter(b, lambda w: w NOT IN ('[laughter]', '[noise]', '[vocalized-noise]') AND NOT starts_with(w, '[laughter-')))::INT AS other,
  CASE WHEN len(c) > 0 THEN (c[1] IN ({STARTERS}))::INT END AS question_flag,
  CASE WHEN len(c) > 0 THEN coalesce(list_filter(c, lambda w: w NOT IN ({_LIST(X.MARKERS)}))[1] IN ({STARTERS}), false)::INT END AS question_after_markers,
  {BC_SQL} AS backchannel
FROM t LEFT JOIN r USING (call_id, side, utt_num) LEFT JOIN s USING (call_id, side, utt_num)
""")
def scl_text_features(spark, sf_dir):
    f = C.text_features(corpus.utterances(spark, sf_dir))
    rates = ["word_rate", "syllable_rate", "fillers_per_second", "repetitions_per_second"]
    return f.withColumns({c: F.round(c, 6) for c in rates})


@query(rf"SELECT call_id, side, utt_num, array_to_string(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '' AND NOT (starts_with(w, '[') AND ends_with(w, ']'))), ' ') AS bare, {_TOK} AS tokens FROM u")
def prj_tokens(spark, sf_dir):
    return corpus.utterances(spark, sf_dir).select(*C.KEY, X.strip_brackets(F.col("text")).alias("bare"), X.tokens(F.col("text")).alias("tokens"))


@query(rf"""
b AS (SELECT call_id, side, utt_num, {BC_SQL} AS listed, (len({_TOK}) <= 2)::INT AS short, (hash_bucket = 0)::INT AS supplied FROM (SELECT *, utt_num % 5 AS hash_bucket FROM u))
SELECT call_id, side, utt_num, listed, short, greatest(listed, short) AS either, 0 AS none, supplied FROM b
""")
def prj_backchannel_definitions(spark, sf_dir):
    u = corpus.utterances(spark, sf_dir)
    listed, short = X.is_backchannel(F.col("text")), (X.token_count(F.col("text")) <= 2).cast("int")
    return u.select(*C.KEY, listed.alias("listed"), short.alias("short"), F.greatest(listed, short).alias("either"), F.lit(0).alias("none"), (F.col("utt_num") % 5 == 0).cast("int").alias("supplied"))


@query(f"SELECT call_id, side, utt_num, row_number() OVER ({ORDER})::INT AS position FROM u")
def win_chronology(spark, sf_dir):
    return C.position(corpus.utterances(spark, sf_dir)).select(*C.KEY, "position")


@query(f'SELECT call_id, side, utt_num, lag(text) OVER ({ORDER}) AS prev_text, lag(side) OVER ({ORDER}) AS prev_side, round(start - lag("end") OVER ({ORDER}), 6) AS turn_gap FROM u')
def win_predecessor(spark, sf_dir):
    return C.predecessor(corpus.utterances(spark, sf_dir)).select(*C.KEY, "prev_text", "prev_side", F.round("turn_gap", 6).alias("turn_gap"))


_FRAME = f"({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
OTHER_SQL = f"o AS (SELECT *, CASE side WHEN 'A' THEN last_value(CASE WHEN side = 'B' THEN text END IGNORE NULLS) OVER {_FRAME} ELSE last_value(CASE WHEN side = 'A' THEN text END IGNORE NULLS) OVER {_FRAME} END AS other_text FROM u)"


@query(f"{OTHER_SQL} SELECT call_id, side, utt_num, other_text FROM o")
def win_other_side_before(spark, sf_dir):
    return C.other_side_before(corpus.utterances(spark, sf_dir)).select(*C.KEY, "other_text")


@query(rf"""
{OTHER_SQL}, q AS (SELECT call_id, side, utt_num, {CONTENT} AS c, {CONTENT_SQL.replace('TXT', "coalesce(other_text, '')")} AS p FROM o)
SELECT call_id, side, utt_num, CASE WHEN len(c) > 0 THEN (c[1] IN ({STARTERS}))::INT END AS question_flag,
  CASE WHEN len(c) = 0 THEN NULL WHEN c[1] IN ({STARTERS}) AND len(c) <= 6 AND len(p) > 0 AND len(list_filter(c, lambda w: list_contains(p, w))) / len(c) >= 0.5 THEN 1 ELSE 0 END AS echo_flag FROM q
""")
def scl_question_flags(spark, sf_dir):
    return C.question_flags(corpus.utterances(spark, sf_dir))


@query(rf"""
p AS (SELECT call_id, side, utt_num, {_TOK} AS t, lag({_TOK}) OVER ({ORDER}) AS o FROM u),
a AS (SELECT call_id, side, utt_num, w, count(*) AS n FROM (SELECT call_id, side, utt_num, unnest(t) AS w FROM p) GROUP BY ALL),
b AS (SELECT call_id, side, utt_num, w, count(*) AS n FROM (SELECT call_id, side, utt_num, unnest(o) AS w FROM p) GROUP BY ALL),
m AS (SELECT call_id, side, utt_num, sum(a.n * b.n) AS s FROM a JOIN b USING (call_id, side, utt_num, w) GROUP BY ALL)
SELECT call_id, side, utt_num, CASE WHEN o IS NOT NULL THEN coalesce(s, 0)::BIGINT END AS repetitions_previous FROM p LEFT JOIN m USING (call_id, side, utt_num)
""")
def scl_repetitions_previous(spark, sf_dir):
    return C.repetitions_previous(corpus.utterances(spark, sf_dir))


@query(f"SELECT call_id, side, utt_num, r - lag(r) OVER (PARTITION BY call_id, side ORDER BY r) > 1 AS intervening FROM (SELECT *, row_number() OVER ({ORDER}) AS r FROM u)")
def win_intervening_talk(spark, sf_dir):
    return C.intervening_talk(corpus.utterances(spark, sf_dir)).select(*C.KEY, "intervening")


#: A small past-tense lexicon for the queries; a real run joins tagged tokens.
PAST = ("was", "were", "had", "did", "went", "asked", "answered", "worked")


@query(rf"""
a AS (SELECT *, len({_TOK}) >= 5 AND regexp_matches({_BARE}, '{X.FIRST_PERSON}') AND len(list_intersect({_TOK}, [{_LIST(PAST)}])) > 0 AS an FROM u),
l AS (SELECT *, lag(side) OVER ({ORDER}) AS ls, lag(an) OVER ({ORDER}) AS la FROM a)
SELECT call_id, side, utt_num, CASE WHEN ls IS NULL THEN NULL WHEN ls = side THEN 0 ELSE (an AND la)::INT END AS mutual_revelation FROM l
""")
def win_mutual_revelation(spark, sf_dir):
    past = F.arrays_overlap(X.tokens(F.col("text")), F.array(*map(F.lit, PAST)))
    return C.mutual_revelation(corpus.utterances(spark, sf_dir), X.may_be_anecdote(F.col("text")) & past).select(*C.KEY, "mutual_revelation")


@query(f"{TURNS_SQL} SELECT call_id, side, utt_num, w_start, w_end FROM tb")
def jn_word_bounds(spark, sf_dir):
    return T.word_bounds(corpus.utterances(spark, sf_dir), corpus.words(spark, sf_dir)).select(*T.KEY, "w_start", "w_end")


@query(f"{TURNS_SQL} SELECT * FROM ev")
def win_turn_walk(spark, sf_dir):
    return features(spark, sf_dir)


@query(f"{TURNS_SQL} SELECT side, {SUMMARY} FROM ev WHERE fto IS NOT NULL GROUP BY side")
def agg_fto_by_side(spark, sf_dir):
    return T.transfer_summary(features(spark, sf_dir), "side")


@query(f"{TURNS_SQL} SELECT {SUMMARY} FROM ev WHERE fto IS NOT NULL")
def agg_fto_summary(spark, sf_dir):
    return T.transfer_summary(features(spark, sf_dir))


@query(f"""{TURNS_SQL}, m AS (SELECT call_id, side, utt_num, text FROM u WHERE utt_num % 7 <> 0 UNION ALL SELECT call_id, side, utt_num + 100000, 'um-hum' FROM u WHERE utt_num % 13 = 0),
j AS (SELECT m.*, kind, fto, turn_initial, coalesce(backchannel, {BC_SQL}) AS backchannel FROM m LEFT JOIN ev USING (call_id, side, utt_num)) SELECT call_id, side, utt_num, kind, fto, turn_initial, backchannel FROM j""")
def src_feature_per_manifest_row(spark, sf_dir):
    u = corpus.utterances(spark, sf_dir).select(*C.KEY, "text")
    manifest = u.where("utt_num % 7 <> 0").unionByName(u.where("utt_num % 13 = 0").select("call_id", "side", (F.col("utt_num") + 100000).alias("utt_num"), F.lit("um-hum").alias("text")))
    events = T.turn_events(corpus.utterances(spark, sf_dir), corpus.words(spark, sf_dir))
    return T.attach(manifest, events).select(*C.KEY, "kind", "fto", "turn_initial", "backchannel")


@query(f"""{TURNS_SQL} SELECT count(*) AS n_rows, count_if(kind = 'transfer')::BIGINT AS n_transfers, count(fto) AS n_fto, sum(turn_initial)::BIGINT AS n_initial, sum(backchannel)::BIGINT AS n_backchannels, sum(interjection)::BIGINT AS n_interjections,
round(avg(latching), 6) AS latch_rate, sum(cooperative)::BIGINT AS n_cooperative, sum(obstructive)::BIGINT AS n_obstructive, round(sum(obstructive) / sum(cooperative + obstructive), 6) AS obstructive_share, count_if(kind IS NULL)::BIGINT AS n_unplaceable FROM ev""")
def agg_event_rollup(spark, sf_dir):
    return T.rollup(features(spark, sf_dir))


OVERLAP_SQL = """
sp AS (SELECT call_id, side, utt_num, min(start) AS us, max("end") AS ue FROM w GROUP BY ALL),
is0 AS (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY call_id, side, utt_num ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM w),
is1 AS (SELECT *, sum(nw) OVER (PARTITION BY call_id, side, utt_num ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS isl FROM is0),
own AS (SELECT call_id, side, utt_num, isl, min(start) AS s, max("end") AS e FROM is1 GROUP BY ALL),
met AS (SELECT own.call_id, own.side, own.utt_num, w.utt_num AS ou, w.i AS oi, greatest(s, w.start) AS s, least(e, w."end") AS e FROM own JOIN w ON w.call_id = own.call_id AND w.side <> own.side AND w.start < e AND w."end" > s),
cnt AS (SELECT call_id, side, utt_num, count(DISTINCT (ou, oi)) AS n FROM met GROUP BY ALL),
m0 AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY call_id, side, utt_num ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM met),
m1 AS (SELECT *, sum(nw) OVER (PARTITION BY call_id, side, utt_num ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM m0),
m2 AS (SELECT call_id, side, utt_num, isl, min(s) AS s, max(e) AS e FROM m1 GROUP BY ALL), sec AS (SELECT call_id, side, utt_num, sum(e - s) AS x FROM m2 GROUP BY ALL),
ons AS (SELECT DISTINCT sp.call_id, sp.side, sp.utt_num, 1 AS o FROM sp JOIN w ON w.call_id = sp.call_id AND w.side <> sp.side AND w.start <= us AND us < w."end"),
ovl AS (SELECT u.call_id, u.side, u.utt_num, CASE WHEN us IS NOT NULL THEN round(coalesce(x, 0), 6) END AS overlap_sec, CASE WHEN us IS NOT NULL THEN coalesce(n, 0)::INT END AS overlap_count, CASE WHEN us IS NOT NULL THEN coalesce(o, 0) END AS overlap_onset
  FROM u LEFT JOIN sp USING (call_id, side, utt_num) LEFT JOIN cnt USING (call_id, side, utt_num) LEFT JOIN sec USING (call_id, side, utt_num) LEFT JOIN ons USING (call_id, side, utt_num))
"""


@query(f"{OVERLAP_SQL} SELECT * FROM ovl")
def jn_word_overlap(spark, sf_dir):
    return O.word_overlap(corpus.utterances(spark, sf_dir), corpus.words(spark, sf_dir))


@query(f"{OVERLAP_SQL} SELECT call_id, side, utt_num, round(s, 6) AS start, round(e, 6) AS \"end\" FROM own")
def win_merged_spans(spark, sf_dir):
    own = O.merge_spans(corpus.words(spark, sf_dir).select(*O.KEY, "start", "end"), *O.KEY)
    return own.select(*O.KEY, F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


PAUSES_SQL = """
pg AS (SELECT *, round(lead(start) OVER (PARTITION BY call_id, side, utt_num ORDER BY start, "end", token) - "end", 6) AS gap FROM w),
pa AS (SELECT call_id, side, utt_num, sum(CASE WHEN gap > 0 THEN gap ELSE 0 END) AS t, coalesce(count_if(gap >= 0.25), 0) AS n, max(CASE WHEN gap > 0 THEN gap ELSE 0 END) AS l, max("end") - min(start) AS sp FROM pg GROUP BY ALL),
pz AS (SELECT u.call_id, u.side, u.utt_num, round(t, 6) AS pause_total, n::INT AS pause_count, CASE WHEN t IS NULL THEN NULL ELSE round(CASE WHEN sp > 0 THEN t / sp ELSE 0 END, 6) END AS pause_rate, round(l, 6) AS pause_max FROM u LEFT JOIN pa USING (call_id, side, utt_num))
"""


@query(f"{PAUSES_SQL} SELECT * FROM pz")
def agg_pauses(spark, sf_dir):
    return O.pauses(corpus.utterances(spark, sf_dir), corpus.words(spark, sf_dir))
