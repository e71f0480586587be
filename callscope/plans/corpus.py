"""Calls out of the `conversations` table: a deterministic clock over its sentences, in Spark and in DuckDB.

Each sentence of a conversation is an utterance of one of two sides; every fourth one gets a short listener row. Times are
whole milliseconds until the end, so that both engines agree to the bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callscope.operators import order


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(call_id, n, side, text, n_tokens, start_ms, dur_ms) for the spoken sentences."""
    c = table(spark, sf_dir, "conversations").where("role <> 'system'")
    p = c.select("conv_id", "turn", "role", F.posexplode(F.split("text", r"[.\n]+")).alias("i", "p"))
    p = p.withColumn("p", F.regexp_replace("p", r"^\s+|\s+$", "")).where("p <> ''")
    p = p.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "i", "role", "p")))
    flip = (F.col("conv_id") * 7 + F.col("n") * 11) % 5 < 2
    side = F.when((F.col("role") == "user") != flip, "A").otherwise("B")
    n = F.col("n")
    lead = F.when(n % 9 == 3, "what ").when(n % 7 == 5, "um you know ").when(n % 6 == 2, "[laughter] ").otherwise("")
    text = F.concat(lead, "p", F.when(n % 6 == 4, " [noise]").otherwise(""))
    p = p.select(F.col("conv_id").alias("call_id"), "n", side.alias("side"), text.alias("text"))
    p = p.withColumn("n_tokens", F.size(F.split("text", r"\s+")))
    p = p.withColumn("dur_ms", 120 * F.col("n_tokens") + 300 * F.floor((F.col("n_tokens") - 1 + n % 8) / 8) + 200)
    gap = ((F.col("call_id") * 37 + n * 53) % 41 - 15) * 60
    before = Window.partitionBy("call_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return p.withColumn("start_ms", F.greatest(F.lit(0), F.coalesce(F.sum(F.col("dur_ms") + gap).over(before), F.lit(0))).cast("long"))


def calls(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """utterances and words of the same pieces, which are worked out once: for jobs with several inputs."""
    p = order.settled(pieces(spark, sf_dir))
    return {"utterances": order.settled(utterances(spark, sf_dir, p)), "words": order.settled(words(spark, sf_dir, p)), "pieces": p}


def utterances(spark: SparkSession, sf_dir: str, p: DataFrame | None = None) -> DataFrame:
    """(call_id, side, utt_num, start, end, text)."""
    p = p if p is not None else pieces(spark, sf_dir)
    heard_at = F.col("start_ms") + F.floor(F.col("dur_ms") / 2)
    other = F.when(F.col("side") == "A", "B").otherwise("A")
    heard_text = F.when(F.col("n") % 3 == 0, "uh-huh").when(F.col("n") % 3 == 1, "yeah right").otherwise("um-hum")
    row = lambda side, num, start, end, text: F.struct(side.alias("side"), num.alias("utt_num"), (start / 1000.0).alias("start"), (end / 1000.0).alias("end"), text.alias("text"))
    spoken = row(F.col("side"), F.col("n") * 2, F.col("start_ms"), F.col("start_ms") + F.col("dur_ms"), F.col("text"))
    heard = row(other, F.col("n") * 2 + 1, heard_at, heard_at + 400, heard_text)
    both = F.when(F.col("n") % 4 == 1, F.array(spoken, heard)).otherwise(F.array(spoken))  # one pass: a union would read the pieces twice
    return p.select("call_id", F.explode(both).alias("u")).select("call_id", "u.*")


def words(spark: SparkSession, sf_dir: str, p: DataFrame | None = None) -> DataFrame:
    """(call_id, side, utt_num, i, start, end, token) for the spoken sentences' words."""
    p = p if p is not None else pieces(spark, sf_dir)
    w = p.select("call_id", "side", "n", "start_ms", F.posexplode(F.split("text", r"\s+")).alias("i", "token"))
    at = F.col("start_ms") + 60 + 120 * F.col("i") + 300 * F.floor((F.col("i") + F.col("n") % 8) / 8)
    return w.select("call_id", "side", (F.col("n") * 2).alias("utt_num"), "i", (at / 1000.0).alias("start"), ((at + 90 + (F.col("i") * 13 % 4) * 10) / 1000.0).alias("end"), "token")


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(call_id, side, caller): who speaks on each side, a caller for 25 customers; one side in eleven is unmapped and absent."""
    calls = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("call_id")).distinct()
    both = calls.select("call_id", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("side"))
    b = (F.col("side") == "B").cast("long")
    people = table(spark, sf_dir, "customer").agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 25)).alias("k"))
    return both.where((F.col("call_id") + b) % 11 <= 9).crossJoin(F.broadcast(people)).select("call_id", "side", (1 + (F.col("call_id") * 2 + b) * 31 % F.col("k")).alias("caller"))  # one row


def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(caller, sex, birth_year, dialect, education) from customer and nation."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    k = F.col("c_custkey")
    return c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(k.alias("caller"), F.when(k % 2 == 0, "FEMALE").otherwise("MALE").alias("sex"), (1920 + k * 7 % 56).alias("birth_year"), F.when(k % 13 == 0, "UNK").otherwise(F.col("n_name")).alias("dialect"), (k % 4).alias("education"))


#: Tags the gold acts take in turn.
TAGS = ("sd", "b", "qy^d", "sv", "ba,fe", "qw", "sd(^q)*", "^2", "bh", "%", "qy^g", "+")


def acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold acts (call_id, side, act_id, tag, start, end): halves of each spoken sentence, shifted a little."""
    p = pieces(spark, sf_dir).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("h"))
    n, h = F.col("n"), F.col("h")
    half = F.floor(F.col("dur_ms") / 2)
    jitter = (n * 17 + h * 5) % 7 * 40 - 120
    start = F.col("start_ms") + h * half + jitter
    tag = F.element_at(F.array(*map(F.lit, TAGS)), ((n * 5 + h * 3 + F.col("call_id")) % 12 + 1).cast("int"))
    return p.select("call_id", "side", (n * 2 + h).alias("act_id"), tag.alias("tag"), (start / 1000.0).alias("start"), ((start + half) / 1000.0).alias("end"))


def frames(spark: SparkSession, sf_dir: str, p: DataFrame | None = None) -> DataFrame:
    """Frames every 40 ms of the spoken sentences: (call_id, side, utt_num, t, f0, rms); t from the utterance's start, f0 null where unvoiced."""
    p = (p if p is not None else pieces(spark, sf_dir)).where("n % 5 <> 4").select("*", F.explode(F.sequence(F.lit(0), F.floor(F.col("dur_ms") / 40).cast("int") - 1)).alias("f"))
    n, f = F.col("n"), F.col("f")
    voiced = (f * 7 + n) % 5 != 0
    f0 = 100 + (n * 13 % 60) + f * ((n % 7) - 3) * 0.5 + (f * 31 % 11) * 0.25
    return p.select("call_id", "side", (n * 2).alias("utt_num"), (f * 40 / 1000.0).alias("t"), F.when(voiced & (f0 > 50), f0.cast("double")).alias("f0"), ((f * 37 + n * 3) % 50 / 100.0).alias("rms"))


SQL = r"""
pc0 AS (SELECT conv_id, turn, role, string_split_regex(text, '[.\n]+') AS ps FROM conversations WHERE role <> 'system'),
pc1 AS (SELECT conv_id, turn, role, regexp_replace(p, '^\s+|\s+$', '', 'g') AS p, i FROM (SELECT conv_id, turn, role, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM pc0)),
pc2 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i, role, p) AS n FROM pc1 WHERE p <> ''),
pc3 AS (SELECT conv_id AS call_id, n, CASE WHEN (role = 'user') <> ((conv_id * 7 + n * 11) % 5 < 2) THEN 'A' ELSE 'B' END AS side,
  CASE WHEN n % 9 = 3 THEN 'what ' WHEN n % 7 = 5 THEN 'um you know ' WHEN n % 6 = 2 THEN '[laughter] ' ELSE '' END || p || CASE WHEN n % 6 = 4 THEN ' [noise]' ELSE '' END AS text FROM pc2),
pc4 AS (SELECT *, len(string_split_regex(text, '\s+')) AS n_tokens FROM pc3),
pc5 AS (SELECT *, 120 * n_tokens + 300 * ((n_tokens - 1 + n % 8) // 8) + 200 AS dur_ms, ((call_id * 37 + n * 53) % 41 - 15) * 60 AS gap_ms FROM pc4),
pc AS (SELECT *, greatest(0, coalesce(sum(dur_ms + gap_ms) OVER (PARTITION BY call_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start_ms FROM pc5),
u AS (SELECT call_id, side, n * 2 AS utt_num, start_ms / 1000.0::DOUBLE AS start, (start_ms + dur_ms) / 1000.0::DOUBLE AS "end", text FROM pc
  UNION ALL SELECT call_id, CASE side WHEN 'A' THEN 'B' ELSE 'A' END, n * 2 + 1, (start_ms + dur_ms // 2) / 1000.0::DOUBLE, (start_ms + dur_ms // 2 + 400) / 1000.0::DOUBLE, CASE n % 3 WHEN 0 THEN 'uh-huh' WHEN 1 THEN 'yeah right' ELSE 'um-hum' END FROM pc WHERE n % 4 = 1),
w0 AS (SELECT call_id, side, n, start_ms, unnest(string_split_regex(text, '\s+')) AS token, generate_subscripts(string_split_regex(text, '\s+'), 1) - 1 AS i FROM pc),
w AS (SELECT call_id, side, n * 2 AS utt_num, i, (start_ms + 60 + 120 * i + 300 * ((i + n % 8) // 8)) / 1000.0::DOUBLE AS start, (start_ms + 60 + 120 * i + 300 * ((i + n % 8) // 8) + 90 + (i * 13 % 4) * 10) / 1000.0::DOUBLE AS "end", token FROM w0),
sides AS (SELECT call_id, side, 1 + (call_id * 2 + (side = 'B')::INT) * 31 % (SELECT greatest(1, count(*) // 25) FROM customer) AS caller FROM (SELECT DISTINCT conv_id AS call_id FROM conversations), (VALUES ('A'), ('B')) v(side) WHERE (call_id + (side = 'B')::INT) % 11 <= 9),
callers AS (SELECT c_custkey AS caller, CASE c_custkey % 2 WHEN 0 THEN 'FEMALE' ELSE 'MALE' END AS sex, 1920 + c_custkey * 7 % 56 AS birth_year, CASE WHEN c_custkey % 13 = 0 THEN 'UNK' ELSE n_name END AS dialect, c_custkey % 4 AS education FROM customer JOIN nation ON c_nationkey = n_nationkey),
acts AS (SELECT call_id, side, n * 2 + h AS act_id, (['sd', 'b', 'qy^d', 'sv', 'ba,fe', 'qw', 'sd(^q)*', '^2', 'bh', '%', 'qy^g', '+'])[(n * 5 + h * 3 + call_id) % 12 + 1] AS tag,
  (start_ms + h * (dur_ms // 2) + (n * 17 + h * 5) % 7 * 40 - 120) / 1000.0::DOUBLE AS start, (start_ms + h * (dur_ms // 2) + (n * 17 + h * 5) % 7 * 40 - 120 + dur_ms // 2) / 1000.0::DOUBLE AS "end" FROM pc, (VALUES (0), (1)) v(h)),
fr0 AS (SELECT *, unnest(range(0, dur_ms // 40)) AS f FROM pc WHERE n % 5 <> 4),
fr AS (SELECT call_id, side, n * 2 AS utt_num, f * 40 / 1000.0::DOUBLE AS t, CASE WHEN (f * 7 + n) % 5 <> 0 AND 100 + n * 13 % 60 + f * (n % 7 - 3) * 0.5 + (f * 31 % 11) * 0.25 > 50 THEN (100 + n * 13 % 60 + f * (n % 7 - 3) * 0.5 + (f * 31 % 11) * 0.25)::DOUBLE END AS f0, (f * 37 + n * 3) % 50 / 100.0::DOUBLE AS rms FROM fr0)
"""
