"""Queries on tables derived from the driver's, for operators whose inputs those lack: CJK text, memories, evidence, runs.

An input is one SQL text that Spark and DuckDB read alike; its tables are in braces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import answers as A
from .functions import text as T
from .operators import conversation, evidence, lookup, memory, retrieval, scoring
from .streaming import batches

WORDS = "[a-z][a-z0-9''-]+"  # as SQL text
TABLES = ("documents", "conversations", "events", "embeddings", "benchmark", "orders")


def _input(spark: SparkSession, d: str, query: str) -> DataFrame:
    return spark.sql(query, **{t: spark.read.parquet(f"{d}/{t}.parquet") for t in TABLES if f"{{{t}}}" in query})


def _duck(query: str) -> str:
    return query.format(**{t: t for t in TABLES})


# Questions in two scripts, one for each rule of the question classes and of the settings of a turn.
PHRASES = (
    "请不要记住这句话", "请忘记我的偏好", "以后改为用英文回答", "Please REMEMBER my name", "这次请用法语简短回答", "什么是边际效用", "为什么我总是失眠", "我一直在读这本书 every-day", "我觉得这本书不错",
    "作者的观点如何", "本轮分点详细说明 用日语", "仅这次用中文段落展开", "暂时 skip it", "",
)
_PHRASE = "CASE (conv_id * 7 + turn * 3) % 14 " + " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(PHRASES)) + " END"
QUESTIONS = f"SELECT conv_id, turn, {_PHRASE} AS q FROM {{conversations}}"


def question_rules(spark, d):
    said = T.turn_overrides(F.col("q"))
    return _input(spark, d, QUESTIONS).select(
        "conv_id", "turn", T.question_class(F.col("q")).alias("class"), F.array_join(F.transform(said, lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";").alias("overrides"),
        F.size(T.token_set(F.col("q"))).alias("n_set"), T.estimate_tokens(F.col("q")).alias("tokens"),
    )


def cjk_tokens(spark, d):
    rows = _input(spark, d, QUESTIONS).select(F.explode(T.tokens(F.col("q"))).alias("token"))
    return rows.groupBy("token").agg(F.count("*").alias("n"))


_CJK = """
SELECT conv_id, turn, q, list_concat(regexp_extract_all(lower(q), '[a-z][a-z0-9''-]+'),
  flatten(list_transform(regexp_extract_all(q, '[一-龥]+'), lambda r: list_concat(list_transform(range(1, length(r) + 1), lambda i: substr(r, i, 1)), list_transform(range(1, length(r)), lambda i: substr(r, i, 2)))))) AS w
FROM ({q})"""
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


VALUES = f"SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'preference.answer_length' WHEN 1 THEN 'preference.answer_format' WHEN 2 THEN 'preference.language' ELSE 'interest.topic:x' END AS k, CASE conv_id % 9 WHEN 0 THEN ' VERBOSE ' WHEN 1 THEN 'please be brief, not long' WHEN 2 THEN '分 点' WHEN 3 THEN '请用步骤列表' WHEN 4 THEN 'zh-CN' WHEN 5 THEN 'in French or german' WHEN 6 THEN '' ELSE {_PHRASE} END AS v FROM {{conversations}}"


def memory_values(spark, d):
    return _input(spark, d, VALUES).select("conv_id", "turn", A.memory_value(F.col("k"), F.col("v")).alias("value"))


def _value_sql() -> str:
    cases = []
    for key, values in A.ALIASES.items():
        names = [(name, value) for value, every in values.items() for name in every]
        exact = " ".join(f"WHEN '{n}' THEN '{v}'" for n, v in names)
        within = " ".join(f"WHEN contains(v, '{n}') THEN '{v}'" for n, v in sorted(names, key=lambda p: -len(p[0])) if len(n) > 1)
        cases.append(f"WHEN k = '{key}' THEN coalesce(CASE lower(regexp_replace(v, '\\s+', '', 'g')) {exact} END, CASE trim(v) {exact} END, CASE {within} END)")
    return f"SELECT conv_id, turn, CASE {' '.join(cases)} ELSE substr(trim(regexp_replace(v, '\\s+', ' ', 'g')), 1, 200) END AS value FROM ({_duck(VALUES)})"


_H = "(conv_id * 31 + turn * 17)"
CANDIDATES = f"""
SELECT conv_id, turn, CASE {_H} % 11 WHEN 0 THEN 'opinion' WHEN 1 THEN 'fact' WHEN 2 THEN 'interest' WHEN 3 THEN 'reading_goal' ELSE 'preference' END AS kind,
  CASE {_H} % 13 WHEN 0 THEN 'fact.role' WHEN 1 THEN 'interest.topic:maps' WHEN 2 THEN 'reading_goal.primary' WHEN 3 THEN 'preference.colour' WHEN 4 THEN 'interest.topic:Bad Key' WHEN 5 THEN 'fact.role' ELSE 'preference.language' END AS key,
  CASE {_H} % 7 WHEN 0 THEN 'book' WHEN 1 THEN 'team' ELSE 'user' END AS scope, CASE {_H} % 17 WHEN 0 THEN '  ' WHEN 1 THEN 'my password is x' ELSE 'likes it' END AS content,
  CASE {_H} % 19 WHEN 0 THEN 'klingon' ELSE 'en' END AS value, CASE {_H} % 23 WHEN 0 THEN CAST(NULL AS BIGINT) ELSE turn END AS source_id, CASE {_H} % 29 WHEN 0 THEN CAST(NULL AS STRING) ELSE text END AS source_text,
  CAST({_H} % 5 - CASE {_H} % 31 WHEN 0 THEN 9 ELSE 0 END AS INT) AS range_start, CAST({_H} % 37 + 1 AS INT) AS range_end,
  CASE {_H} % 41 WHEN 0 THEN 'guess' WHEN 1 THEN 'inferred' ELSE 'explicit' END AS statement_type, CASE {_H} % 43 WHEN 0 THEN 'often' WHEN 1 THEN 'one_turn' WHEN 2 THEN 'unknown' ELSE 'stable' END AS stability
FROM {{conversations}}"""


def candidate_verdicts(spark, d):
    return memory.validate(_input(spark, d, CANDIDATES)).select("conv_id", "turn", "verdict", "reason")


_VERDICT_SQL = f"""
WITH c AS (SELECT *, substr(source_text, range_start + 1, range_end - range_start) AS said FROM ({_duck(CANDIDATES)})),
r AS (SELECT *, CASE WHEN kind NOT IN ('preference', 'fact', 'interest', 'reading_goal', 'open_question') THEN 'kind'
    WHEN NOT (regexp_matches(key, '{T.MEMORY_KEY}') AND starts_with(key, CASE kind WHEN 'open_question' THEN 'open_question:' ELSE kind || '.' END)) THEN 'key'
    WHEN scope NOT IN ('user', 'book') THEN 'scope' WHEN kind IN ('reading_goal', 'open_question') AND scope <> 'book' THEN 'goal_scope' WHEN trim(content) = '' THEN 'content'
    WHEN source_id IS NULL OR source_text IS NULL THEN 'source_id' WHEN range_start < 0 OR range_end > length(source_text) OR range_start >= range_end OR trim(said, ' ') = '' THEN 'source_range'
    WHEN statement_type NOT IN ('explicit', 'inferred') THEN 'statement_type' WHEN stability NOT IN ('stable', 'one_turn', 'unknown') THEN 'stability' WHEN stability = 'one_turn' THEN 'one_turn'
    WHEN key = 'preference.language' AND value NOT IN ('zh', 'en', 'fr', 'ja', 'de', 'es', 'ru', 'other') THEN 'enum_value'
    WHEN contains(content, 'password') OR regexp_matches(said, '{T.SENSITIVE}') THEN 'sensitive' END AS reason FROM c)
SELECT conv_id, turn, CASE WHEN reason IS NULL THEN 'candidate' WHEN reason IN ('one_turn', 'sensitive') THEN 'skip' ELSE 'invalid' END AS verdict, reason FROM r"""


COMMANDS = """
SELECT user_id, CASE user_id % 3 WHEN 0 THEN CAST(NULL AS BIGINT) WHEN 1 THEN CAST(9007199254740993 AS BIGINT) ELSE user_id % 3 END AS scope_id, CASE event_id % 2 WHEN 0 THEN 'preference.language' ELSE 'fact.role' END AS key, event_id AS order_id,
  CASE event_id % 17 WHEN 0 THEN 'completed' WHEN 1 THEN 'expired' ELSE 'active' END AS status, CASE event_id % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' ELSE 'de' END AS value,
  CASE event_id % 19 WHEN 0 THEN 'user_edit' WHEN 1 THEN 'user_confirmation' ELSE 'user_message' END AS source_type, CASE event_id % 3 WHEN 0 THEN 'inferred' ELSE 'explicit' END AS statement_type,
  CASE event_id % 7 WHEN 0 THEN 'unknown' ELSE 'stable' END AS stability, event_id % 4 = 0 AS reopen FROM {events}"""


def memory_states(spark, d):
    return memory.apply_candidates(_input(spark, d, COMMANDS)).select("user_id", F.col("scope_id").cast("string").alias("scope_id"), "key", "status", "value", "revision", "source_type", "order_id")


_STATES_SQL = f"""
WITH RECURSIVE c AS (SELECT *, source_type IN ('user_edit', 'user_confirmation') AS manual, statement_type = 'explicit' AND stability = 'stable' AS sure,
    row_number() OVER (PARTITION BY user_id, scope_id, key ORDER BY order_id, value) AS n FROM ({_duck(COMMANDS)})),
s AS (SELECT user_id, scope_id, key, 0::BIGINT AS n, 'none' AS status, NULL::VARCHAR AS value, 0 AS revision, NULL::VARCHAR AS source_type, 0::BIGINT AS order_id FROM c WHERE n = 1
  UNION ALL SELECT user_id, scope_id, key, n, CASE WHEN close THEN cstatus WHEN take THEN 'active' ELSE status END, CASE WHEN take THEN cvalue ELSE value END,
    CASE WHEN close OR take THEN revision + 1 ELSE revision END, CASE WHEN take THEN csource ELSE source_type END, CASE WHEN take OR same THEN greatest(order_id, corder) ELSE order_id END
  FROM (SELECT s.user_id, s.scope_id, s.key, c.n, s.status, s.value, s.revision, s.source_type, s.order_id, c.status AS cstatus, c.value AS cvalue, c.source_type AS csource, c.order_id AS corder,
      c.status IN ('completed', 'expired') AND s.status = 'active' AS close,
      NOT c.status IN ('completed', 'expired') AND NOT c.manual AND s.status = 'active' AND s.value = c.value AS same,
      NOT c.status IN ('completed', 'expired') AND (c.manual OR (s.status = 'active' AND s.value <> c.value AND c.order_id > s.order_id AND s.source_type = 'user_message' AND c.sure)
        OR (s.status IN ('completed', 'expired') AND c.reopen AND c.statement_type = 'explicit') OR (s.status = 'none' AND c.sure)) AS take
    FROM s JOIN c ON s.user_id = c.user_id AND s.scope_id IS NOT DISTINCT FROM c.scope_id AND s.key = c.key AND c.n = s.n + 1))
SELECT user_id, CAST(scope_id AS VARCHAR) AS scope_id, key, status, value, revision, source_type, order_id FROM s QUALIFY row_number() OVER (PARTITION BY user_id, scope_id, key ORDER BY n DESC) = 1"""


MEMORIES = """
SELECT doc_id AS memory_id, doc_id % 20 AS user_id, CASE doc_id % 4 WHEN 0 THEN 'preference' WHEN 1 THEN 'reading_goal' ELSE 'interest' END AS kind, CASE doc_id % 3 WHEN 0 THEN 'book' ELSE 'user' END AS scope,
  doc_id % 2 AS book_id, substr(text, 1, 60 + CAST(doc_id % 7 AS INT) * 90) AS content, CASE doc_id % 9 WHEN 0 THEN 'completed' ELSE 'active' END AS status,
  CASE doc_id % 8 WHEN 0 THEN TIMESTAMP '2020-01-01 00:00:00' END AS expires_at, CASE doc_id % 10 WHEN 0 THEN 'user_edit' ELSE 'user_message' END AS source_type,
  CASE doc_id % 6 WHEN 0 THEN CAST(NULL AS TIMESTAMP) ELSE TIMESTAMP '2024-01-01 00:00:00' END AS last_seen_at, TIMESTAMP '2023-01-01 00:00:00' AS updated_at, doc_id % 5 AS salience FROM {documents}"""
ASKED = "SELECT doc_id % 20 AS user_id, doc_id AS question_id, doc_id % 2 AS book_id, substr(text, 1, 90) AS question FROM {documents} WHERE doc_id < 200"


def memory_recall(spark, d):
    found = memory.recall(_input(spark, d, MEMORIES), _input(spark, d, ASKED), F.lit("2022-01-01 00:00:00").cast("timestamp"))
    return found.select("user_id", "question_id", F.col("tokens").cast("long").alias("tokens"), F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["memory_id"].cast("string"), x["reason"])), ";").alias("items"))


_RECALL_SQL = f"""
WITH RECURSIVE m AS (SELECT *, list_distinct(regexp_extract_all(lower(content), '[a-z][a-z0-9''-]+')) AS w, ceil(length(content) * 0.6)::BIGINT AS t FROM ({_duck(MEMORIES)}) WHERE status = 'active' AND (expires_at IS NULL OR expires_at > TIMESTAMP '2022-01-01 00:00:00')),
a AS (SELECT *, list_distinct(regexp_extract_all(lower(question), '[a-z][a-z0-9''-]+')) AS q FROM ({_duck(ASKED)})),
b AS (SELECT a.user_id, question_id, memory_id, t, source_type, scope, coalesce(last_seen_at, updated_at) AS seen, salience, kind,
    CASE WHEN len(q) = 0 OR len(w) = 0 THEN 0 ELSE len(list_intersect(q, w)) / (len(q) + len(w) - len(list_intersect(q, w))) END AS j
  FROM a JOIN m ON a.user_id = m.user_id AND (scope = 'user' OR m.book_id = a.book_id)),
r AS (SELECT *, CASE WHEN kind = 'preference' THEN 'global_preference' WHEN kind = 'reading_goal' AND scope = 'book' THEN 'current_book' WHEN j >= 0.25 THEN 'relevant_topic' END AS reason FROM b),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id, question_id ORDER BY source_type <> 'user_edit', scope <> 'book', seen DESC, salience DESC, memory_id) AS pos FROM r WHERE reason IS NOT NULL),
s AS (SELECT user_id, question_id, 0::BIGINT AS pos, 0::BIGINT AS used, 0 AS n, '' AS items FROM p WHERE pos = 1
  UNION ALL SELECT s.user_id, s.question_id, p.pos, CASE WHEN n < 6 AND used + t <= 800 THEN used + t ELSE used END, CASE WHEN n < 6 AND used + t <= 800 THEN n + 1 ELSE n END,
    CASE WHEN n < 6 AND used + t <= 800 THEN items || CASE WHEN n > 0 THEN ';' ELSE '' END || memory_id || ':' || reason ELSE items END FROM s JOIN p ON p.user_id = s.user_id AND p.question_id = s.question_id AND p.pos = s.pos + 1)
SELECT user_id, question_id, used AS tokens, items FROM s QUALIFY row_number() OVER (PARTITION BY user_id, question_id ORDER BY pos DESC) = 1"""


SOURCES = "SELECT user_id, event_id AS message_id, event_id % 200 AS request_id, event_id % 3 AS epoch, CASE event_id % 11 WHEN 0 THEN 'processing' WHEN 1 THEN 'failed' WHEN 2 THEN 'done' WHEN 3 THEN 'skipped' ELSE 'pending' END AS state FROM {events} WHERE event_id % 13 < 6"
EPOCHS = "SELECT user_id, CAST(max(event_id) % 3 AS BIGINT) AS current_epoch, CAST(min(event_id) + 300 AS BIGINT) AS blocked_through FROM {events} WHERE user_id % 2 = 0 GROUP BY user_id"


def source_states(spark, d):
    return memory.barrier(_input(spark, d, SOURCES), _input(spark, d, EPOCHS)).select("message_id", "state")


def request_states(spark, d):
    return memory.request_status(memory.barrier(_input(spark, d, SOURCES), _input(spark, d, EPOCHS)))


_BARRIER = f"""
WITH s AS (SELECT message_id, request_id, CASE WHEN state = 'pending' AND (epoch < current_epoch OR message_id <= blocked_through) THEN 'skipped' ELSE state END AS state FROM ({_duck(SOURCES)}) LEFT JOIN ({_duck(EPOCHS)}) USING (user_id))"""


EVIDENCE = """
SELECT conv_id AS request_id, turn AS ordinal, CASE turn % 3 WHEN 0 THEN 'quote' ELSE 'hit' END AS kind, conv_id % 4 AS book_id, CASE turn % 2 WHEN 0 THEN 'h1' ELSE 'h2' END AS hash,
  CASE turn % 5 WHEN 0 THEN CAST(NULL AS INT) ELSE CAST(turn % 4 AS INT) END AS start, CASE turn % 5 WHEN 0 THEN CAST(NULL AS INT) ELSE CAST(turn % 4 + 9 AS INT) END AS "end",
  CASE turn % 7 WHEN 0 THEN 'same' ELSE role END AS text, 'h1' AS book_hash FROM {conversations}"""


def evidence_list(spark, d):
    rows = _input(spark, d, EVIDENCE.replace('"end"', "`end`"))
    return evidence.assign_evidence(rows).select("request_id", "ordinal", "evidence_id", "verified")


ANSWERS = "SELECT conv_id, turn, concat(text, ' [[E', CAST(turn AS STRING), ']] and [[E', CAST(turn % 3 + 1 AS STRING), ']], [[x]] [[E', CAST(turn % 3 + 1 AS STRING), ']]') AS answer FROM {conversations}"


def checked_citations(spark, d):
    known = F.array(F.lit("E1"), F.lit("E3"), F.lit("E12"))
    clean, cited = T.normalize_citations(F.col("answer"), known)
    return _input(spark, d, ANSWERS).select("conv_id", "turn", F.sha2(clean, 256).alias("answer_sha256"), F.array_join(cited, ",").alias("cited"))


_CITED_SQL = f"""
WITH a AS (SELECT *, list_filter(['E' || turn, 'E' || (turn % 3 + 1)], lambda x: x IN ('E1', 'E3', 'E12')) AS c FROM ({_duck(ANSWERS)})),
b AS (SELECT *, CASE WHEN 'E' || turn IN ('E1', 'E3', 'E12') THEN answer ELSE replace(answer, '[[E' || turn || ']]', '引用无效') END AS a1 FROM a),
e AS (SELECT *, CASE WHEN 'E' || (turn % 3 + 1) IN ('E1', 'E3', 'E12') THEN a1 ELSE replace(a1, '[[E' || (turn % 3 + 1) || ']]', '引用无效') END AS a2 FROM b)
SELECT conv_id, turn, sha256(replace(a2, '[[x', '引用无效x')) AS answer_sha256, array_to_string(CASE WHEN len(c) = 2 AND c[1] = c[2] THEN c[1:1] ELSE c END, ',') AS cited FROM e"""


GOLD = "SELECT conv_id AS run_id, turn AS gold_id, CASE turn % 3 WHEN 0 THEN 'interest.topic:*' WHEN 1 THEN 'fact.role' END AS key, CASE turn % 2 WHEN 0 THEN 'user|book' END AS scope, CASE turn % 5 WHEN 0 THEN 'candidate' ELSE 'active|candidate' END AS status, CASE turn % 4 WHEN 0 THEN 'v1' END AS value FROM {conversations} WHERE role = 'user'"
SAVED = "SELECT conv_id AS run_id, turn AS item_id, CASE turn % 5 WHEN 0 THEN 'interest.topic:maps' WHEN 1 THEN 'fact.role' ELSE 'preference.language' END AS key, CASE turn % 4 WHEN 0 THEN 'team' ELSE 'user' END AS scope, CASE turn % 3 WHEN 0 THEN 'candidate' ELSE 'active' END AS status, CASE conv_id % 2 WHEN 0 THEN 'v1' ELSE 'v2' END AS value FROM {conversations} WHERE role = 'assistant'"


def gold_matches(spark, d):
    s = scoring.gold_scores(_input(spark, d, GOLD), _input(spark, d, SAVED))
    return s.select("run_id", "n_gold", "n_found", "n_saved", "n_right", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


_FITS = "(g.key IS NULL OR s.key = g.key OR (ends_with(g.key, '*') AND starts_with(s.key, rtrim(g.key, '*')))) AND (g.scope IS NULL OR list_contains(string_split(g.scope, '|'), s.scope)) AND list_contains(string_split(g.status, '|'), s.status) AND (g.value IS NULL OR g.value = s.value)"
_GOLD_SQL = f"""
WITH g AS ({_duck(GOLD)}), s AS ({_duck(SAVED)}),
x AS (SELECT run_id, count(*) AS n_gold, count(*) FILTER (EXISTS (SELECT 1 FROM s WHERE s.run_id = g.run_id AND {_FITS})) AS n_found FROM g GROUP BY run_id),
y AS (SELECT run_id, count(*) AS n_saved, count(*) FILTER (EXISTS (SELECT 1 FROM g WHERE s.run_id = g.run_id AND {_FITS})) AS n_right FROM s GROUP BY run_id)
SELECT run_id, coalesce(n_gold, 0) AS n_gold, coalesce(n_found, 0) AS n_found, coalesce(n_saved, 0) AS n_saved, coalesce(n_right, 0) AS n_right, round(n_found / nullif(n_gold, 0), 6) AS recall, round(n_right / nullif(n_saved, 0), 6) AS precision FROM x FULL JOIN y USING (run_id)"""


ITEMS = "SELECT vec_id % 40 AS request_id, CAST(vec_id / 40 AS INT) AS ordinal, CASE WHEN vec_id % 40 < 20 THEN CAST(NULL AS INT) WHEN vec_id % 40 = 33 THEN 0 ELSE CAST(floor(vec_id / 40) AS INT) END AS item_index, CASE WHEN vec_id = 45 THEN NULL ELSE embedding END AS embedding FROM {embeddings} WHERE vec_id < 400 AND vec_id <> 87"
WANTED = "SELECT DISTINCT vec_id % 41 AS request_id, 10 AS n FROM {embeddings}"


def embedding_problems(spark, d):
    return scoring.check_embeddings(_input(spark, d, WANTED), _input(spark, d, ITEMS.replace("CAST(vec_id / 40 AS INT)", "CAST(floor(vec_id / 40) AS INT)")), 64)


_EMBEDDED_SQL = f"""
WITH i AS ({_duck(ITEMS.replace("CAST(vec_id / 40 AS INT)", "CAST(floor(vec_id / 40) AS INT)"))}),
g AS (SELECT request_id, count(*) AS got, count(item_index) AS indexed, count(DISTINCT item_index) AS d, min(item_index) AS lo, max(item_index) AS hi, bool_or(embedding IS NULL OR len(embedding) <> 64) AS bad FROM i GROUP BY request_id)
SELECT request_id, CASE WHEN coalesce(got, 0) <> n THEN 'count' WHEN indexed > 0 AND (d <> n OR lo < 0 OR hi >= n) THEN 'index' WHEN bad THEN 'dims' END AS problem FROM ({_duck(WANTED)}) LEFT JOIN g USING (request_id)"""


DELTAS = "SELECT conv_id AS response_id, turn AS seq, CASE turn % 4 WHEN 0 THEN CAST(NULL AS BIGINT) ELSE turn % 2 END AS call_index, CASE turn % 3 WHEN 0 THEN concat('call-', CAST(turn AS STRING)) WHEN 1 THEN '' END AS id, CASE turn % 5 WHEN 0 THEN role END AS name, substr(text, 1, 5) AS arguments FROM {conversations}"


def assembled_calls(spark, d):
    return lookup.assemble_calls(_input(spark, d, DELTAS))


KNOWN = "SELECT user_id, min(event_id) AS request_id, CASE user_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS fingerprint, CASE user_id % 5 WHEN 0 THEN 'running' WHEN 1 THEN 'failed' ELSE 'completed' END AS status FROM {events} GROUP BY user_id"
NEW = "SELECT user_id, event_id AS request_id, CASE event_id % 2 WHEN 0 THEN 'a' END AS fingerprint FROM {events} WHERE event_id < 3000"


def request_verdicts(spark, d):
    return lookup.judge_requests(_input(spark, d, KNOWN), _input(spark, d, NEW)).select("user_id", "request_id", "verdict")


SELECTIONS = "SELECT doc_id, text, CASE doc_id % 7 WHEN 0 THEN 'old' WHEN 1 THEN CAST(NULL AS STRING) ELSE 'h' END AS said_hash, CAST(doc_id % 11 - 1 AS INT) AS s, CAST(doc_id % 40 AS INT) AS e, substr(text, CAST(doc_id % 11 AS INT), CAST(CASE doc_id % 5 WHEN 0 THEN 3 ELSE doc_id % 40 - doc_id % 11 + 1 END AS INT)) AS said FROM {documents} WHERE doc_id % 11 > 0 AND doc_id % 40 >= doc_id % 11 AND length(text) > 50"


def checked_selections(spark, d):
    return _input(spark, d, SELECTIONS).select("doc_id", A.selection_verdict(F.col("text"), F.lit("h"), F.col("said_hash"), F.col("s"), F.col("e"), F.col("said")).alias("verdict"))


def rounds_dropped(spark, d):
    return conversation.rounds_to_drop(conversation.message_log(_input(spark, d, "SELECT * FROM {conversations}")), 4500)


def appended_events(spark, d):
    e = _input(spark, d, "SELECT user_id, event_type, count(*) AS n FROM {events} WHERE event_id % 3 = 0 GROUP BY user_id, event_type")
    new = _input(spark, d, "SELECT user_id, event_type, -count(*) AS n FROM {events} WHERE event_id % 2 = 0 GROUP BY user_id, event_type")
    return conversation.append_new(e, new, ["user_id", "event_type"])


def fresh_events(spark, d):
    marks = _input(spark, d, "SELECT user_id, 100 * (user_id % 50) AS mark FROM {events} WHERE user_id % 3 = 0 GROUP BY user_id")
    return batches.drop_late(_input(spark, d, "SELECT user_id, event_id FROM {events}"), "user_id", "event_id", marks)


def first_user_events(spark, d):
    rows = _input(spark, d, "SELECT user_id, event_type FROM {events}").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    return batches.first_by_key(rows, ["user_id", "event_type"]).select("user_id", "event_type")


CHAPTERED = "SELECT doc_id, concat(CASE doc_id % 2 WHEN 0 THEN concat('opening words', chr(10)) ELSE '' END, '第一章 start', chr(10), replace(text, chr(10), ' '), chr(10), ' 第2章 middle ', chr(10), 'x 第三章 no heading', chr(10), 'Chapter 3', chr(10), CASE doc_id % 3 WHEN 0 THEN '第一章 start' ELSE 'Chapter 04: end' END, chr(10), 'tail of it') AS text FROM {documents}"


def chapter_list(spark, d):
    return lookup.chapter_texts(_input(spark, d, CHAPTERED)).select("doc_id", "chapter_id", "ordinal", "title", "start", "end", F.sha2("text", 256).alias("text_sha256"))


ASKS = "SELECT doc_id AS ask_id, doc_id, CASE doc_id % 5 WHEN 0 THEN 'ch-1-0' END AS chapter_id, CASE doc_id % 5 WHEN 1 THEN CAST(2 AS INT) WHEN 4 THEN CAST(NULL AS INT) END AS chapter_index, CASE doc_id % 5 WHEN 2 THEN 'start' WHEN 3 THEN 'middle' WHEN 4 THEN 'tail of' END AS title FROM {documents}"


def chapters_found(spark, d):
    found = lookup.find_chapters(_input(spark, d, CHAPTERED), _input(spark, d, ASKS))
    return found.select("ask_id", "status", "n_chapters", "chapter_id", F.coalesce(F.size("matches"), F.lit(0)).cast("long").alias("n_matches"), "start", "end", F.sha2("text", 256).alias("text_sha256"), "truncated")


_CHAPTERS = f"""
WITH d AS ({_duck(CHAPTERED)}), l AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM d),
n AS (SELECT doc_id, text, unnest(range(1, len(l) + 1)) AS i, l FROM l),
o AS (SELECT doc_id, text, i, l[i] AS line, CAST(coalesce(list_sum(list_transform(l[1:i-1], lambda x: length(x) + 1)), 0) AS INTEGER) AS pos FROM n),
h AS (SELECT doc_id, text, trim(line) AS title, pos FROM o WHERE regexp_matches(trim(line), '^(第[一二三四五六七八九十零百千万]+[章节回部篇集]|第[0-9]+[章节回部篇集]|[一二三四五六七八九十零]+[、.]|[0-9]+[、.]|(?i:chapter\\s*[0-9]+))')
      UNION ALL SELECT doc_id, text, '前言', 0 FROM d WHERE doc_id % 2 = 0),
c AS (SELECT doc_id, text, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS ordinal, title, pos AS s, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos), length(text)) AS e FROM h),
k AS (SELECT doc_id, 'ch-' || ordinal || '-' || s AS chapter_id, ordinal, title, CAST(s AS INTEGER) AS s, CAST(e AS INTEGER) AS e, substr(text, s + 1, e - s) AS t FROM c)"""


_ALL = (
    question_rules, cjk_tokens, memory_values, candidate_verdicts, memory_states, memory_recall, source_states, request_states, evidence_list, checked_citations, gold_matches, embedding_problems, assembled_calls,
    request_verdicts, checked_selections, rounds_dropped, appended_events, fresh_events, first_user_events, chapter_list, chapters_found,
)
QUERIES = {f.__name__: f for f in _ALL}

_OVERRIDE = {"preference.answer_length": (("详细|详尽|展开", "detailed"), ("简洁|简短|简单", "concise")), "preference.answer_format": (("分点|列表|条目|要点", "bullets"), ("段落|连贯", "paragraphs"))}
_LANGUAGES = {"用法语": "fr", "用英文": "en", "用英语": "en", "用中文": "zh", "用日语": "ja", "用德语": "de"}
_SET = [f"CASE {' '.join(f"WHEN regexp_matches(q, '{p}') THEN '{k}={v}'" for p, v in rules)} END" for k, rules in _OVERRIDE.items()] + [f"CASE {' '.join(f"WHEN contains(q, '{w}') THEN 'preference.language={c}'" for w, c in _LANGUAGES.items())} END"]

ORACLES = {
    "question_rules": f"""
SELECT conv_id, turn, CASE WHEN regexp_matches(q, '不要记住|别记住|不用记|不需要记') THEN 'skip' WHEN regexp_matches(q, '忘记|忘掉|删除记忆|清除记忆|不要再记') THEN 'explicit' WHEN regexp_matches(q, '更正|纠正|改过来|以后改为|以后改成') THEN 'explicit'
  WHEN regexp_matches(lower(q), '请记住|记住|记下|remember') THEN 'explicit' WHEN regexp_matches(q, '这次|仅这次|本次|这一轮|本轮|暂时') THEN 'skip' WHEN regexp_matches(q, '^(什么是|为什么|怎么会|请问|翻译|解释|总结)') AND NOT contains(q, '我') THEN 'skip'
  WHEN regexp_matches(q, '我一直|我总是|我习惯|我喜欢|我偏好|我讨厌|我更喜欢|以后都|今后都|每次都|我的职业|我是一名') THEN 'strong' WHEN contains(q, '我') THEN 'weak' ELSE 'skip' END AS class,
  CASE WHEN regexp_matches(q, '这次|本次|这一轮|本轮') THEN concat_ws(';', {', '.join(_SET)}) ELSE '' END AS overrides,
  CAST(len(list_filter(list_distinct(w), lambda x: NOT list_contains({_STOP}, x))) AS INTEGER) AS n_set, CAST(ceil(length(q) * 0.6) AS INTEGER) AS tokens FROM ({_CJK.format(q=_duck(QUESTIONS))})""",
    "cjk_tokens": f"SELECT token, count(*) AS n FROM (SELECT unnest(w) AS token FROM ({_CJK.format(q=_duck(QUESTIONS))})) GROUP BY token",
    "memory_values": _value_sql(),
    "candidate_verdicts": _VERDICT_SQL,
    "memory_states": _STATES_SQL,
    "memory_recall": _RECALL_SQL,
    "source_states": f"{_BARRIER} SELECT message_id, state FROM s",
    "request_states": f"{_BARRIER} SELECT request_id, CASE WHEN bool_or(state IN ('pending', 'processing')) THEN 'pending' WHEN bool_or(state = 'failed') THEN 'failed' WHEN bool_or(state = 'done') THEN 'completed' ELSE 'skipped' END AS status FROM s GROUP BY request_id",
    "evidence_list": f"""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY request_id, kind, book_id, hash, start, "end", CASE WHEN start IS NULL THEN text END ORDER BY ordinal) AS n FROM ({_duck(EVIDENCE)}))
SELECT request_id, ordinal, 'E' || row_number() OVER (PARTITION BY request_id ORDER BY ordinal) AS evidence_id, start IS NOT NULL AND hash = book_hash AS verified FROM e WHERE n = 1""",
    "checked_citations": _CITED_SQL,
    "gold_matches": _GOLD_SQL,
    "embedding_problems": _EMBEDDED_SQL,
    "assembled_calls": f"""
SELECT response_id, coalesce(call_index, 0) AS call_index, coalesce(arg_max(id, seq) FILTER (length(id) > 0), '') AS id, coalesce(string_agg(name, '' ORDER BY seq, name, arguments), '') AS name, coalesce(string_agg(arguments, '' ORDER BY seq, name, arguments), '') AS arguments
FROM ({_duck(DELTAS)}) GROUP BY response_id, coalesce(call_index, 0)""",
    "request_verdicts": f"""
SELECT n.user_id, n.request_id, CASE WHEN k.status IS NULL THEN 'new' WHEN k.fingerprint IS DISTINCT FROM n.fingerprint THEN 'conflict' WHEN k.status IN ('completed', 'failed', 'cancelled', 'interrupted') THEN 'replay' ELSE 'running' END AS verdict
FROM ({_duck(NEW)}) n LEFT JOIN ({_duck(KNOWN)}) k USING (user_id, request_id)""",
    "checked_selections": f"SELECT doc_id, CASE WHEN said_hash IS DISTINCT FROM 'h' THEN 'BOOK_CONTENT_CHANGED' WHEN s >= 0 AND s < e AND e <= length(text) AND substr(text, s + 1, e - s) = said THEN 'ok' ELSE 'INVALID_SELECTION' END AS verdict FROM ({_duck(SELECTIONS)})",
    "rounds_dropped": """
WITH RECURSIVE l AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS seq, role, CAST(ceil(length(coalesce(text, '')) * 0.6) AS BIGINT) AS t FROM conversations),
u AS (SELECT conv_id, list(seq ORDER BY seq) FILTER (role = 'user') AS starts, count(*) AS n, list(t ORDER BY seq) AS ts FROM l GROUP BY conv_id),
s AS (SELECT conv_id, starts, ts, n, 0 AS dropped, list_sum(ts)::BIGINT AS left_, 1::BIGINT AS first FROM u
  UNION ALL SELECT conv_id, starts, ts, n, dropped + 1, list_sum(ts[starts[dropped + 2]:])::BIGINT, starts[dropped + 2] FROM s WHERE left_ > 4500 * 0.7 - 2500 AND len(starts) - dropped - 1 >= 3 AND n - starts[dropped + 2] + 1 >= 6)
SELECT conv_id, max(dropped)::INTEGER AS dropped, min(left_) AS tokens_left FROM s GROUP BY conv_id""",
    "appended_events": """
WITH o AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_id % 3 = 0 GROUP BY ALL), w AS (SELECT user_id, event_type, -count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY ALL)
SELECT * FROM o UNION ALL SELECT * FROM w ANTI JOIN o USING (user_id, event_type)""",
    "fresh_events": "SELECT user_id, event_id FROM events WHERE user_id % 3 <> 0 OR event_id > 100 * (user_id % 50)",
    "first_user_events": "SELECT DISTINCT user_id, event_type FROM events",
    "chapter_list": f'{_CHAPTERS} SELECT doc_id, chapter_id, ordinal, title, s AS start, e AS "end", sha256(t) AS text_sha256 FROM k',
    "chapters_found": f"""{_CHAPTERS},
a AS ({_duck(ASKS)}), b AS (SELECT a.*, k.chapter_id AS kid, k.ordinal, k.title AS kt, k.s, k.e, k.t FROM a JOIN k USING (doc_id)),
g AS (SELECT ask_id, doc_id, count(*) AS n_chapters, min(ordinal) FILTER (kid = chapter_id) AS by_id, min(ordinal) FILTER (ordinal = chapter_index) AS by_index, min(ordinal) FILTER (contains(t, title)) AS by_text,
    count(*) FILTER (contains(kt, title)) AS hits, min(ordinal) FILTER (contains(kt, title)) AS hit, any_value(chapter_id) AS want_id, any_value(chapter_index) AS want_index FROM b GROUP BY ask_id, doc_id),
v AS (SELECT *, want_id IS NULL AND want_index IS NULL AND hits > 1 AS several, CASE WHEN want_id IS NOT NULL THEN by_id WHEN want_index IS NOT NULL THEN by_index WHEN hits = 1 THEN hit WHEN hits = 0 THEN by_text END AS pick FROM g)
SELECT ask_id, CASE WHEN several THEN 'ambiguous' WHEN pick IS NOT NULL THEN 'ok' ELSE 'empty' END AS status, n_chapters, k.chapter_id, CASE WHEN several THEN hits ELSE 0 END AS n_matches, k.s AS start, CAST(least(k.e, k.s + 1500) AS INTEGER) AS "end",
  sha256(substr(k.t, 1, 1500)) AS text_sha256, k.e - k.s > 1500 AS truncated FROM v LEFT JOIN k ON k.doc_id = v.doc_id AND k.ordinal = v.pick""",
}
