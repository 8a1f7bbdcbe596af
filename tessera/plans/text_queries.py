"""Queries of text, payload, time and sampling expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import numeric as nm
from tessera.functions import payload as pl
from tessera.functions import sampling as sm
from tessera.functions import text as tx
from tessera.functions.intervals import frame_seconds, frame_window
from tessera.operators import query_package as qp
from tessera.operators import self_report as sr

from .registry import EP, episodes, query, spread, table

NORMAL_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'), '\b(the|an|a)\b', ' ', 'g'), ' +', ' ', 'g'))"
STOP_SQL = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
TOKENS_SQL = f"list_distinct(list_filter(string_split({{q}}, ' '), lambda w: w <> '' AND w NOT IN ({STOP_SQL})))"


@query(f"""
WITH n AS (SELECT doc_id, {NORMAL_SQL.format(c="text")} AS q FROM documents)
SELECT doc_id, md5(q) AS normal_md5, CAST(len({TOKENS_SQL.format(q="q")}) AS BIGINT) AS n_tokens FROM n""")
def normalize_query_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normal form of each whole text, as a digest, and how many distinct tokens it has."""
    q = table(spark, sf_dir, "documents").select("doc_id", tx.normal_query(F.col("text")).alias("q"))
    return q.select("doc_id", F.md5(F.col("q").cast("binary")).alias("normal_md5"), F.size(tx.tokens(F.col("q"))).cast("long").alias("n_tokens"))


#: Phrases of a part: a kind of thing in a place, clothes, an event, two things at once, or a long sentence.
PHRASE_SQL = """CASE p_partkey % 9 WHEN 0 THEN p_name || ' near the Shop' WHEN 1 THEN 'A victim in ' || p_name || ' jacket and the man in red shirt' WHEN 2 THEN p_name || '-smoke and ' || lower(p_type)
  WHEN 3 THEN 'attacker in a uniform' WHEN 4 THEN 'grab bag, ' || p_name || ' (the ground)' WHEN 5 THEN p_name || ' and ' || p_name || '_2' WHEN 6 THEN 'a person kicked and robbed on the road by two men' WHEN 7 THEN '  ' ELSE p_name || ' / flames/smoke' END"""
HAS_SQL = lambda words, c: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
EVENT_WORDS = [w for words, _, _ in tx.EVENTS for w in words]
KIND_SQL = f"CASE WHEN len({TOKENS_SQL.format(q='t')}) = 0 THEN 'object' WHEN list_has_any({TOKENS_SQL.format(q='t')}, [{', '.join(repr(w) for w in tx.SCENE_TERMS)}]) THEN 'scene_context' WHEN {HAS_SQL(tx.CLOTHING_TERMS, 't')} THEN 'attribute_object' WHEN {HAS_SQL(EVENT_WORDS, 't')} THEN 'event_relation' ELSE 'object' END"
WEAR_SQL = rf"'\b(person|man|woman|individual|victim|attacker)\s+in\s+([a-z0-9 ]{{1,40}}?(?:{'|'.join(tx.CLOTHING_TERMS)}))\b'"
EXPAND_CTES = rf"""ph AS (SELECT p_partkey, {PHRASE_SQL} AS raw FROM part),
nm AS (SELECT p_partkey, raw, {NORMAL_SQL.format(c="raw")} AS q FROM ph),
pt AS (SELECT p_partkey, unnest(string_split_regex(q, '\s+and\s+')) AS t, generate_subscripts(string_split_regex(q, '\s+and\s+'), 1) AS i FROM nm WHERE q <> ''),
wr AS (SELECT p_partkey, unnest(regexp_extract_all(q, {WEAR_SQL}, 1)) AS who, unnest(regexp_extract_all(q, {WEAR_SQL}, 2)) AS what, generate_subscripts(regexp_extract_all(q, {WEAR_SQL}, 1), 1) AS i FROM nm WHERE q <> ''),
en AS (SELECT p_partkey, 100 + i AS pos, t, {KIND_SQL} AS kind, 0.9 AS w FROM pt WHERE t <> '' AND len(string_split(t, ' ')) <= 4
  UNION ALL SELECT p_partkey, 200 + i, CASE WHEN who IN ('victim', 'attacker', 'individual') THEN 'person' ELSE who END || ' in ' || what, 'attribute_object', 1.0 FROM wr
  UNION ALL SELECT p_partkey, 300, t, {KIND_SQL}, 1.0 FROM (SELECT p_partkey, q AS t FROM nm) WHERE t <> '' AND len(string_split(t, ' ')) <= 4
  {' '.join(f"UNION ALL SELECT p_partkey, {400 + i}, '{text}', 'event_relation', {w} FROM nm WHERE {HAS_SQL(words, 'q')}" for i, (words, text, w) in enumerate(tx.EVENTS))}),
ex AS (SELECT p_partkey, t AS text, coalesce(arg_min(kind, pos) FILTER (WHERE kind <> 'object'), 'object') AS kind, CAST(max(w) AS DOUBLE) AS weight, min(pos) AS pos FROM en GROUP BY p_partkey, t)"""


@query(f"""WITH {EXPAND_CTES}
SELECT p_partkey, text, kind, weight, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY pos) AS INTEGER) AS place FROM ex""")
def phrase_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrase of each part as weighted queries, in order."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr(PHRASE_SQL).alias("raw"))
    return p.select("p_partkey", F.posexplode(qp.expand_phrases(F.array("raw"))).alias("i", "q")).select("p_partkey", "q.text", "q.kind", "q.weight", (F.col("i") + 1).alias("place"))


MOMENTS_SQL = """[{'moment_id': 'ev' || (p_partkey % 5), 'role': 'trigger', 'description': 'A ' || p_name || ' falls'}, {'moment_id': '', 'role': 'smoke', 'description': lower(p_type) || ' man'}, {'moment_id': 'ev9', 'role': NULL, 'description': 'road'}]"""


@query(f"""WITH {EXPAND_CTES},
mo AS (SELECT p_partkey, unnest({MOMENTS_SQL}) AS m, unnest([1, 2, 3]) AS i FROM part),
mt AS (SELECT p_partkey, i, m.moment_id AS id, coalesce(m.role, '') AS role, {TOKENS_SQL.format(q=NORMAL_SQL.format(c="coalesce(m.description, '') || ' ' || coalesce(m.role, '')"))} AS words FROM mo),
qt AS (SELECT p_partkey, pos, text, weight, {TOKENS_SQL.format(q="text")} AS words FROM ex),
lk AS (SELECT mt.p_partkey, mt.i, max(CASE WHEN list_has_any(mt.words, qt.words) THEN 1 ELSE 0 END) AS linked FROM mt JOIN qt ON mt.p_partkey = qt.p_partkey GROUP BY ALL),
li AS (SELECT mt.p_partkey, coalesce(string_agg(id, ',' ORDER BY mt.i) FILTER (WHERE linked = 1 AND id <> ''), '') AS ids, coalesce(string_agg(role, ',' ORDER BY mt.i) FILTER (WHERE linked = 1 AND role <> ''), '') AS roles,
         count(*) FILTER (WHERE linked = 1 AND id <> '') AS n_ids, max(CASE WHEN mt.i = 1 THEN linked END) AS first_linked FROM mt LEFT JOIN lk ON mt.p_partkey = lk.p_partkey AND mt.i = lk.i GROUP BY ALL),
sc AS (SELECT qt.p_partkey, text, pos, weight + CASE WHEN len(qt.words) > 0 THEN len(list_intersect(qt.words, mt.words)) / CAST(len(qt.words) AS DOUBLE) ELSE 0 END AS score FROM qt JOIN mt ON qt.p_partkey = mt.p_partkey AND mt.i = 1 JOIN li ON li.p_partkey = qt.p_partkey WHERE n_ids = 0 OR first_linked = 1),
be AS (SELECT p_partkey, text FROM sc QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, pos) = 1)
SELECT p.p_partkey, ids AS linked_ids, roles AS linked_roles, coalesce(be.text, 'sudden event') AS query, CASE WHEN be.text IS NULL THEN 'role_fallback' ELSE 'oracle_key_objects' END AS source
FROM part p JOIN li ON p.p_partkey = li.p_partkey LEFT JOIN be ON p.p_partkey = be.p_partkey""")
def token_overlap_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The moments that each part's phrase tells of, and the best of its queries for the first of them."""
    moment = lambda i, r, d: F.struct(i.alias("moment_id"), r.alias("role"), F.lit(0.0).alias("start_sec"), F.lit(1.0).alias("end_sec"), d.alias("description"))
    id_ = F.concat(F.lit("ev"), (F.col("p_partkey") % 5).cast("string"))
    moments = F.array(
        moment(id_, F.lit("trigger"), F.concat(F.lit("A "), "p_name", F.lit(" falls"))), moment(F.lit(""), F.lit("smoke"), F.concat(F.lower("p_type"), F.lit(" man"))),
        moment(F.lit("ev9"), F.lit(None).cast("string"), F.lit("road")),
    )
    p = spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", F.expr(PHRASE_SQL).alias("raw"), moments.alias("m"))
    p = p.withColumn("s", qp.supervision(F.array("raw"), F.col("m")))
    best = qp.query_for_moment(F.col("s"), F.get("m", F.lit(0)), F.lit("A sudden event!"))
    first = F.get("s", F.lit(0))
    return p.select("p_partkey", F.array_join(first["linked_moment_ids"], ",").alias("linked_ids"), F.array_join(first["linked_roles"], ",").alias("linked_roles"), best["text"].alias("query"), best["source"].alias("source"))


CLEAN_SQL = r"regexp_replace(regexp_replace(regexp_replace(lower(trim({c})), '[\s/-]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g')"


def _rule_sql(parts: tuple[str, ...], label: str) -> str:
    more = " AND contains(t, 'object')" if label == "object_falling" else " AND NOT contains(t, 'object')" if parts == ("fall",) else f" AND t <> '{tx.COMBINED}'" if label in ("explosion", "fire") else ""
    return f"WHEN {HAS_SQL(parts, 't')}{more} THEN '{label}'"


RULES_SQL = f"CASE WHEN existence = 'normal' THEN 'normal' WHEN t IN ('normal', {', '.join(repr(c) for c in tx.CATEGORIES)}) THEN t {' '.join(f'WHEN t = {a!r} THEN {c!r}' for a, c in tx.ALIASES.items())} {' '.join(_rule_sql(*r) for r in tx.SUBSTRINGS)} ELSE t END"
RAW_NAMES = [
    " Car/Accident ", "No-Anomaly", "armed  robbery", "Fire or Explosion", "object falling", "house fire", "object", "Drowning", "graffiti", "bag-snatch", "gun violence", "punch", "slip and fall", "person falls", "smoke", "brawl", "blast", "", "normal",
    "vehicle collision", "property damage",
]
RAW_SQL = "CASE p_partkey % 24 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(RAW_NAMES)) + " ELSE p_type END"
EXISTS_SQL = "CASE p_size % 3 WHEN 0 THEN 'anomaly' WHEN 1 THEN 'Normal ' END"


@query(f"""
WITH r AS (SELECT p_partkey, {RAW_SQL} AS raw, '' AS existence FROM part), c AS (SELECT p_partkey, existence, {CLEAN_SQL.format(c='raw')} AS t FROM r)
SELECT p_partkey, t AS cleaned, {RULES_SQL} AS category FROM c""")
def category_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "part").select("p_partkey", F.expr(RAW_SQL).alias("raw"))
    return r.select("p_partkey", tx.clean_category(F.col("raw")).alias("cleaned"), tx.category(F.col("raw")).alias("category"))


@query(f"""
WITH r AS (SELECT p_partkey, p_size, {RAW_SQL} AS raw, coalesce(lower(trim({EXISTS_SQL})), '') AS existence FROM part), c AS (SELECT *, {CLEAN_SQL.format(c='raw')} AS t FROM r), k AS (SELECT *, {RULES_SQL} AS category FROM c)
SELECT p_partkey, 'case_' || substr(sha1(CAST(p_partkey AS VARCHAR)), 1, 10) AS case_id, 'w' || lpad(CAST(p_size AS VARCHAR), 4, '0') AS window_id, category,
       CASE WHEN category = '' THEN CASE WHEN existence = 'anomaly' THEN 'missing_category' ELSE '' END WHEN category NOT IN ('normal', {', '.join(repr(c) for c in tx.CATEGORIES)}) THEN 'unknown_category'
            WHEN existence = 'anomaly' AND category = 'normal' THEN 'normal_category_of_anomaly' ELSE '' END AS error
FROM k""")
def payload_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public ids, the canonical category of each claim, and what is wrong with it."""
    r = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.expr(EXISTS_SQL).alias("x"), F.expr(RAW_SQL).alias("raw"))
    c = r.withColumn("category", tx.category(F.col("raw"), F.col("x")))
    error = F.coalesce(tx.claim_error(F.col("x"), F.col("category"), required=True), F.lit(""))
    return c.select("p_partkey", tx.case_id(F.col("p_partkey").cast("string")).alias("case_id"), tx.padded_id("w", F.col("p_size")).alias("window_id"), "category", error.alias("error"))


REPLY_SQL = """'<think>step ' || CAST(turn AS STRING) || ' <tool_call>{"name":"draft"}</tool_call></think>' || CASE turn % 4
  WHEN 0 THEN '<tool_call>{"name":"seek_evidence","arguments":{"start_time":"1:0' || CAST(conv_id % 10 AS STRING) || '","query":"q"}}</tool_call> tail'
  WHEN 1 THEN '<tool_call>{"a":1}</tool_call><answer>{"existence":"normal"}</answer>' WHEN 2 THEN 'no block' ELSE '<tool_call>{emit_alert: {"start_sec": 4.5}}</tool_call>' END"""


@query(rf"""
WITH r AS (SELECT conv_id, turn, {REPLY_SQL} AS reply FROM conversations),
b AS (SELECT *, regexp_extract_all(regexp_replace(reply, '(?s)<think>.*?</think>', '', 'g'), '(?s)<tool_call>.*?</tool_call>|<answer>.*?</answer>') AS o, regexp_extract_all(reply, '(?s)<tool_call>.*?</tool_call>|<answer>.*?</answer>') AS a FROM r)
SELECT conv_id, turn, CASE WHEN len(o) > 0 THEN o[len(o)] WHEN len(a) > 0 THEN a[len(a)] ELSE '' END AS last_block, CAST(length(regexp_extract(reply, '(?s)^.*?(?:</tool_call>|</answer>)')) AS BIGINT) AS first_end FROM b""")
def tagged_block_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(REPLY_SQL).alias("reply"))
    return r.select("conv_id", "turn", tx.last_block(F.col("reply")).alias("last_block"), F.length(tx.first_block(F.col("reply"))).cast("long").alias("first_end"))


@query(rf"""
WITH r AS (SELECT conv_id, turn, turn % 4 AS m, conv_id % 10 AS d FROM conversations)
SELECT conv_id, turn, CASE m WHEN 0 THEN 'seek_evidence' WHEN 1 THEN 'existence' WHEN 3 THEN 'emit_alert' ELSE 'draft' END AS tool_name, CAST(CASE m WHEN 0 THEN 60 + d WHEN 3 THEN 4.5 END AS DOUBLE) AS start_sec, m <> 3 AS valid_json FROM r""")
def parse_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name and start of the call in each reply; times are literals, names may lack quotes."""
    r = table(spark, sf_dir, "conversations").select("conv_id", "turn", pl.inside(tx.last_block(F.expr(REPLY_SQL))).alias("p"))
    args = pl.normal_arguments(pl.tool_name(F.col("p")), pl.arguments(F.col("p")))
    return r.select("conv_id", "turn", pl.tool_name(F.col("p")).alias("tool_name"), args["start_sec"].alias("start_sec"), pl.is_object(F.col("p")).alias("valid_json"))


@query("""
WITH e AS (SELECT event_id, event_id % 6 AS m, event_id % 60 AS s FROM events)
SELECT event_id, CASE m WHEN 0 THEN 'soft_alert' WHEN 1 THEN 'hard_alert' WHEN 2 THEN 'declare_normal' WHEN 3 THEN 'other' WHEN 4 THEN 'Hard_Alert' END AS decision, CASE m WHEN 0 THEN 'anomaly' WHEN 1 THEN 'anomaly' WHEN 2 THEN 'normal' WHEN 4 THEN 'unsure' END AS existence,
       CAST(CASE WHEN m < 3 THEN 120 + s ELSE s END AS DOUBLE) AS alert_sec, CASE WHEN m = 5 THEN 'given' ELSE 'told' END AS reason FROM e""")
def alert_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments of alerts under present names: decisions by type, existence by decision, times as seconds."""
    m, s = F.col("event_id") % 6, F.col("event_id") % 60
    kind = F.get(F.array(*[F.lit(x) for x in ("soft", " HARD", "normal", "other")]), m.cast("int"))
    payload = F.to_json(F.struct(
        F.when(m < 4, kind).alias("alert_type"), F.when(m == 4, "Hard_Alert").alias("decision"), F.when(m == 4, "unsure").alias("existence"),
        F.when(m < 3, F.format_string("2:%02d", s)).otherwise(F.concat(s.cast("string"), F.lit("s"))).alias("alert_sec"), F.lit("told").alias("description"), F.when(m == 5, "given").alias("reason"),
    ))
    a = table(spark, sf_dir, "events").select("event_id", pl.normal_arguments(F.lit("emit_alert"), payload).alias("a"))
    return a.select("event_id", *[F.col(f"a.{c}").alias(c) for c in ("decision", "existence", "alert_sec", "reason")])


@query(rf"""
WITH q AS (SELECT page_id, {NORMAL_SQL.format(c="url || CASE page_id % 5 WHEN 0 THEN ' the Street' WHEN 1 THEN ' red-hat' WHEN 2 THEN ' a man fell' ELSE '' END")} AS t FROM pages),
k AS (SELECT page_id, t AS q, {KIND_SQL} AS kind FROM q),
p AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'sudden fall' ELSE q END AS cue, CASE WHEN page_id % 3 = 0 THEN ['red bag', 'man'] ELSE ['red bag'] END AS objects, CASE WHEN page_id % 2 = 0 THEN 'street corner' ELSE 'lobby' END AS scene,
         CASE WHEN page_id % 6 = 0 THEN 'red bag' ELSE NULL END AS hypothesis FROM k),
e AS (SELECT page_id, cue AS t, 0.40 AS w FROM p UNION ALL SELECT page_id, unnest(objects), 0.20 FROM p UNION ALL SELECT page_id, scene, 0.10 FROM p UNION ALL SELECT page_id, coalesce(hypothesis, cue), 0.25 FROM p),
m AS (SELECT page_id, t, max(w) AS w FROM e WHERE t <> '' GROUP BY ALL),
s AS (SELECT page_id, count(*) AS n, sum(w) AS w FROM m GROUP BY page_id)
SELECT k.page_id, kind, CASE WHEN length(q) <= 40 THEN q ELSE rtrim(substr(q, 1, 37)) || '...' END AS clipped, p.cue AS event_cue, coalesce(hypothesis, p.cue) AS hypothesis, CAST(n AS BIGINT) AS n_positive, round(CAST(s.w - 0.15 AS DOUBLE), 6) AS package_weight
FROM k JOIN p ON k.page_id = p.page_id JOIN s ON k.page_id = s.page_id""")
def query_kind_and_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of each query, its clipped text, and its package: normal, with fallbacks, rendered to weighted texts."""
    i = F.col("page_id")
    more = F.expr("CASE page_id % 5 WHEN 0 THEN ' the Street' WHEN 1 THEN ' red-hat' WHEN 2 THEN ' a man fell' ELSE '' END")
    q = table(spark, sf_dir, "pages").select("page_id", F.concat("url", more).alias("raw"), tx.normal_query(F.concat("url", more)).alias("q"))
    package = F.struct(
        F.when(i % 4 == 0, "The sudden FALL ").alias("event_cue"), F.when(i % 3 == 0, F.array(F.lit("a red-bag"), F.lit("Man"), F.lit(" "), F.lit("red bag"))).otherwise(F.array(F.lit("Red Bag"))).alias("key_objects"),
        F.when(i % 2 == 0, "a street corner").alias("scene_context"), F.when(i % 6 == 0, "red bag").alias("hypothesis"), F.array(F.lit("no-smoke"), F.lit("no smoke")).alias("negative_constraints"), F.lit(None).cast("string").alias("rewrite_reason"),
    )
    p = q.withColumn("p", qp.normal_package(package, F.col("raw"), F.lit("Lobby")))
    good, bad = qp.rendered(F.col("p"))
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda n, t: n + t["weight"])
    return p.select(
        "page_id", tx.query_kind(F.col("q")).alias("kind"), tx.clip_text(F.col("q"), 40).alias("clipped"), F.col("p.event_cue").alias("event_cue"), F.col("p.hypothesis").alias("hypothesis"),
        F.size(good).cast("long").alias("n_positive"), F.round(total(good) - total(bad), 6).alias("package_weight"),
    )


@query(f"""
WITH {EP},
c AS (SELECT episode_id, step_index, k, CASE k % 4 WHEN 0 THEN CAST(k AS VARCHAR) || '.5s' WHEN 1 THEN '0' || CAST(k % 10 AS VARCHAR) || ':30' WHEN 2 THEN '1:02:0' || CAST(k % 10 AS VARCHAR) ELSE 'soon' END AS literal, CAST(2.5 AS DOUBLE) AS fps FROM ep)
SELECT episode_id, step_index, CAST(CASE k % 4 WHEN 0 THEN k + 0.5 WHEN 1 THEN (k % 10) * 60 + 30 WHEN 2 THEN 3720 + k % 10 END AS DOUBLE) AS seconds, k % 4 = 0 AS is_timestamp,
       round(greatest(k - 1, 0) / fps, 6) AS frame_sec, round(least(greatest((k - 1) / fps, 0), 30), 6) AS window_start, round(least(greatest((k + 9) / fps, 0), 30), 6) AS window_end,
       CAST(least(greatest(floor(k / fps * fps), 0), 74) AS BIGINT) AS start_frame, CAST(least(round_even(k / CAST(3 AS DOUBLE) * fps, 0), 74) AS BIGINT) AS nearest_frame
FROM c""")
def time_and_frame_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals as seconds; frames as seconds and back, clamped to a clip of 30 seconds."""
    k, fps = F.col("k"), F.lit(2.5)
    lit = F.expr("CASE k % 4 WHEN 0 THEN CAST(k AS STRING) || '.5s' WHEN 1 THEN '0' || CAST(k % 10 AS STRING) || ':30' WHEN 2 THEN '1:02:0' || CAST(k % 10 AS STRING) ELSE 'soon' END")
    w = frame_window(k, k + 9, F.lit(1), fps, F.lit(30.0))
    return episodes(spark, sf_dir).select(
        "episode_id", "step_index", tx.seconds(lit).alias("seconds"), tx.is_timestamp(lit).alias("is_timestamp"), frame_seconds(k, F.lit(1), fps).alias("frame_sec"), w["start"].alias("window_start"), w["end"].alias("window_end"),
        F.least(F.greatest(F.floor(k / fps * fps), F.lit(0)), F.lit(74)).cast("long").alias("start_frame"), F.least(nm.half_even(k / F.lit(3.0) * fps), F.lit(74)).cast("long").alias("nearest_frame"),
    )


@query(f"""
WITH {EP}
SELECT episode_id, step_index, CAST(CASE WHEN k % 3 = 0 THEN -1 WHEN k % 3 = 1 THEN k + 0.5 ELSE k END AS DOUBLE) AS as_double, CAST(CASE WHEN k % 3 = 2 THEN k ELSE -1 END AS BIGINT) AS as_int,
       greatest(0, least(1, value / 300)) AS unit, greatest(-1, least(1, (value - 250) / 200)) AS signed, round(CASE WHEN k % 2 = 0 THEN least(1, k / CAST(50 AS DOUBLE)) ELSE (least(1, k / CAST(50 AS DOUBLE)) + value / 500) / 2 END, 6) AS view_score
FROM ep""")
def safe_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coerced and clamped values. As in the SQL, ``view_score`` is the mean of its parts as they are; ``nm.view_score`` clamps them and the mean."""
    k, v = F.col("k"), F.col("value")
    raw = F.when(k % 3 == 0, "x").when(k % 3 == 1, F.concat(k.cast("string"), F.lit(".5"))).otherwise(k.cast("string"))
    part = F.least(F.lit(1.0), k / 50)
    return episodes(spark, sf_dir).select("episode_id", "step_index", nm.safe_double(raw, -1.0).alias("as_double"), nm.safe_int(raw, -1).alias("as_int"), nm.unit(v / 300).alias("unit"), nm.signed_unit((v - 250) / 200).alias("signed"), F.round(nm.overall_or_mean(F.when(k % 2 == 0, part), [part, v / 500]), 6).alias("view_score"))


#: A report's parts by line: decision, status, action; scores are discounts and taxes, sometimes under other names or out of range.
SAID_SQL = "CASE l_linenumber % 4 WHEN 0 THEN 'Sufficient ' WHEN 1 THEN 'nonsense' END"
STATUS_SQL = "CASE l_partkey % 5 WHEN 0 THEN 'complete' WHEN 1 THEN 'incomplete' WHEN 2 THEN 'misaligned' WHEN 3 THEN 'redundant' END"
ACTION_SQL = "CASE l_suppkey % 5 WHEN 0 THEN 'finalize' WHEN 1 THEN 'continue_search' WHEN 2 THEN 'revise_claim' WHEN 3 THEN 'refine_evidence' END"


def _report() -> Column:
    """The payload of a line as JSON; keys without a value are left out."""
    c, odd = F.col, F.col("l_linenumber") % 2 == 1
    return F.to_json(F.struct(
        F.expr(SAID_SQL).alias("verification_decision"), F.expr(STATUS_SQL).alias("primary_status"), F.expr(ACTION_SQL).alias("recommended_action"),
        F.when(odd, c("l_discount") * 12).alias("sufficiency_score"), F.when(odd, (c("l_tax") * 8).cast("string")).alias("necessity_score"),
        F.struct(F.when(~odd, c("l_discount") * 5).alias("sufficiency"), F.lit("n/a").alias("necessity"), (c("l_tax") * 10).alias("alertability")).alias("derived_scores"),
        F.when(c("l_partkey") % 3 == 0, F.array(F.lit("w1 "), F.lit(" "), F.lit("w2"))).alias("selected_window_ids"), F.lit("w3").alias("candidate_window_ids"),
    ))


@query(f"""
WITH j AS (SELECT l_orderkey, l_linenumber, lower(trim({SAID_SQL})) AS said, {STATUS_SQL} AS status, {ACTION_SQL} AS action, round(CAST(CASE WHEN l_linenumber % 2 = 1 THEN least(1, l_discount * 12) ELSE 0 END AS DOUBLE), 6) AS s,
  round(CAST(CASE WHEN l_linenumber % 2 = 1 THEN least(1, l_tax * 8) ELSE 0 END AS DOUBLE), 6) AS n, CASE WHEN l_linenumber % 2 = 1 THEN l_discount * 12 >= 0.75 AND l_tax * 8 >= 0.35 ELSE false END AS high FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN said IN ('sufficient', 'insufficient', 'misaligned', 'redundant') THEN said WHEN status = 'complete' THEN 'sufficient' WHEN status IN ('redundant', 'misaligned') THEN status
       WHEN action = 'finalize' THEN 'sufficient' WHEN action = 'revise_claim' THEN 'misaligned' WHEN action = 'refine_evidence' THEN 'redundant' WHEN high THEN 'sufficient' ELSE 'insufficient' END AS decision, s AS sufficiency, n AS necessity FROM j""")
def judge_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's decision and scores, from payloads that name them in several ways."""
    j = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", sr.judge_labels(_report()).alias("j"))
    return j.select("l_orderkey", "l_linenumber", "j.decision", F.col("j.scores.sufficiency").alias("sufficiency"), F.col("j.scores.necessity").alias("necessity"))


@query(f"""
WITH j AS (SELECT *, lower(trim({SAID_SQL})) AS said, {STATUS_SQL} AS st, {ACTION_SQL} AS ac, least(1, CASE WHEN l_linenumber % 2 = 1 THEN l_discount * 12 ELSE l_discount * 5 END) AS s, CASE WHEN l_linenumber % 2 = 1 THEN least(1, l_tax * 8) ELSE 0 END AS n, least(1, l_tax * 10) AS a,
  l_quantity > 25 AS alerted FROM lineitem),
d AS (SELECT *, CASE WHEN said IN ('sufficient', 'insufficient', 'misaligned', 'redundant') THEN said WHEN st = 'complete' THEN 'sufficient' WHEN st IN ('misaligned', 'redundant') THEN st ELSE 'insufficient' END AS decision,
  CASE WHEN NOT alerted THEN 'not_applicable' WHEN a >= 0.65 THEN 'justified' WHEN l_quantity > 40.5 THEN 'late' ELSE 'premature' END AS alert_status FROM j)
SELECT l_orderkey, l_linenumber, decision, coalesce(ac, CASE decision WHEN 'sufficient' THEN 'finalize' WHEN 'misaligned' THEN 'revise_claim' WHEN 'redundant' THEN 'refine_evidence' ELSE 'continue_search' END) AS action, alert_status,
       CASE WHEN l_partkey % 3 = 0 THEN 'w1,w2' ELSE 'w3' END AS windows, concat_ws(',', CASE decision WHEN 'insufficient' THEN 'selected_evidence_not_sufficient' WHEN 'misaligned' THEN 'selected_evidence_not_aligned_with_claim' WHEN 'redundant' THEN 'selected_evidence_not_necessary_enough' END,
       CASE alert_status WHEN 'premature' THEN 'alert_prefix_not_actionable' WHEN 'late' THEN 'alert_after_expected_actionable_time' END) AS reasons, round(CAST(greatest(s, n) AS DOUBLE), 4) AS confidence, round(CAST(CASE WHEN s <> 0 OR n <> 0 THEN 1 - abs(s - n) ELSE 0 END AS DOUBLE), 4) AS consistency,
       CASE WHEN said IS NULL THEN 'verification_decision,' ELSE '' END || CASE WHEN ac IS NULL THEN 'recommended_action' ELSE '' END AS some_missing
FROM d""")
def self_report_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A policy's own verification report, filled up where it is silent, and which of two required fields it lacks."""
    c = F.col
    lines = spread(table(spark, sf_dir, "lineitem"), "l_orderkey")
    r = sr.with_self_report(lines, _report(), c("l_quantity"), F.lit(40.0), c("l_quantity") > 25, F.lit("reward_only"))
    return r.select(
        "l_orderkey", "l_linenumber", c("verification_decision").alias("decision"), c("recommended_action").alias("action"), c("alert_status").alias("alert_status"), F.array_join("best_effort_window_ids", ",").alias("windows"),
        F.array_join("failure_reasons", ",").alias("reasons"), F.round("confidence", 4).alias("confidence"), F.round("derived_scores.consistency", 4).alias("consistency"),
        F.concat(F.when(F.array_contains("lacks", "verification_decision"), "verification_decision,").otherwise(""), F.when(F.array_contains("lacks", "recommended_action"), "recommended_action").otherwise("")).alias("some_missing"),
    )


@query("""
WITH r AS (SELECT conv_id, turn, turn % 5 AS m FROM conversations)
SELECT conv_id, turn, CASE m WHEN 0 THEN 'sufficient' WHEN 1 THEN 'misaligned' WHEN 2 THEN 'redundant' WHEN 3 THEN 'insufficient' ELSE '' END AS decision FROM r""")
def verify_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision in the verify call of each reply, explicit or told by its action; empty where neither tells."""
    reply = F.expr("""concat('<think>x</think><tool_call>{"name":"verify_hypothesis","arguments":{', CASE turn % 5 WHEN 0 THEN '"verification_decision":"sufficient"' WHEN 1 THEN '"recommended_action":"revise_claim"' WHEN 2 THEN '"recommended_action":"refine_evidence"' WHEN 3 THEN '"recommended_action":"continue_search"' ELSE '"primary_status":"complete"' END, '}}</tool_call>')""")
    args = pl.arguments(pl.inside(tx.last_block(reply)))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", sr.verify_decision(args).alias("decision"))


@query("""
WITH e AS (SELECT vec_id, vec_id % 40 AS s, vec_id % 40 + vec_id % 23 AS e, 1 + vec_id % 11 AS n FROM embeddings),
u AS (SELECT *, greatest(least(n, e - s + 1, 8), 1) AS m, least(e - s + 1, 8) AS m8, greatest(n // 2, 1) AS st FROM e),
x AS (SELECT *, list_distinct(list_concat(range(s, e + 1, st), [e])) AS raw FROM u)
SELECT vec_id, array_to_string(CASE WHEN m = 1 THEN [CAST(s AS BIGINT)] ELSE list_transform(range(0, m), lambda i: CAST(round_even(s + i * ((e - s) / CAST(m - 1 AS DOUBLE)), 0) AS BIGINT)) END, ',') AS uniform,
       array_to_string(CASE WHEN len(raw) > 8 THEN list_transform(range(0, m8), lambda i: CAST(round_even(s + i * ((e - s) / CAST(greatest(m8 - 1, 1) AS DOUBLE)), 0) AS BIGINT)) ELSE list_sort(raw) END, ',') AS strided
FROM x""")
def frame_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    e = table(spark, sf_dir, "embeddings").select("vec_id", (i % 40).alias("s"), (i % 40 + i % 23).alias("e"), (1 + i % 11).alias("n"))
    text = lambda a: F.array_join(a.cast("array<string>"), ",")
    stride = F.greatest(F.floor(F.col("n") / 2), F.lit(1))
    return e.select("vec_id", text(sm.uniform(F.col("s"), F.col("e"), F.col("n"))).alias("uniform"), text(sm.strided(F.col("s"), F.col("e"), stride)).alias("strided"))


@query("""
WITH e AS (SELECT vec_id, vec_id % 90 AS frames, CAST(vec_id % 7 AS DOUBLE) AS duration, CAST(vec_id % 4 AS DOUBLE) AS fps FROM embeddings),
n AS (SELECT *, greatest(1, least(frames, 12, CASE WHEN duration > 0 AND fps > 0 THEN ceil(duration * least(2, fps)) ELSE frames END)) AS n FROM e)
SELECT vec_id, CASE WHEN frames = 0 THEN '' WHEN n = 1 THEN '0' ELSE array_to_string(list_sort(list_distinct(list_transform(range(0, CAST(n AS BIGINT)), lambda i: CAST(round_even(i * ((frames - 1) / CAST(n - 1 AS DOUBLE)), 0) AS BIGINT)))), ',') END AS sampled,
       CAST(greatest(1, CASE WHEN fps > 0 THEN least(frames, 6, greatest(1, ceil(frames / fps * 0.5))) ELSE least(frames, 6) END) AS BIGINT) AS preview FROM n""")
def clip_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that stand for a whole clip, and how many its preview shows."""
    i = F.col("vec_id")
    frames, duration, fps = i % 90, (i % 7).cast("double"), (i % 4).cast("double")
    got = sm.clip_indices(frames, duration, fps, 2.0, 12)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(got.cast("array<string>"), ",").alias("sampled"), sm.preview_count(frames, fps, 6, 8, 0.5).cast("long").alias("preview"))


@query("""
WITH e AS (SELECT vec_id, 1 + vec_id % 17 AS n FROM embeddings)
SELECT vec_id, array_to_string(CASE WHEN n <= 4 THEN range(1, n + 1) ELSE list_transform(range(0, 4), lambda i: CAST(1 + round_even(i * (n - 1) / CAST(3 AS DOUBLE), 0) AS BIGINT)) END, ',') AS kept FROM e""")
def even_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = 1 + F.col("vec_id") % 17
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(sm.even_subset(F.sequence(F.lit(1).cast("long"), n), 4).cast("array<string>"), ",").alias("kept"))
