"""Queries on derived tables for state changes and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .derived import WORDS, _duck, _input
from .functions import answers as A
from .functions import text as T
from .functions.vectors import embed_texts
from .operators import evaluation, governance, reports, retrieval, search
from .plans.layouts import Append, Layout, Step, missing_rows
from .plans.scratch import new_path
from .plans.tools import Tools
from .streaming import memory_commands

_ROWS = "SELECT event_id AS id, user_id, event_id % 4 AS revision, CASE event_id % 3 WHEN 0 THEN 'building' WHEN 1 THEN 'ready' ELSE 'retired' END AS status FROM {events} WHERE event_id % 2 = 0"
_COMMANDS = "SELECT event_id AS command_id, event_id - event_id % 5 AS id, CASE event_id % 7 WHEN 0 THEN CAST(NULL AS BIGINT) ELSE event_id % 4 END AS expected_revision, event_id % 3 AS expected_epoch FROM {events}"
_EPOCHS = "SELECT user_id, user_id % 3 AS current_epoch FROM {events} WHERE user_id % 4 > 0 GROUP BY user_id"
_MOVES = "SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN 'building' ELSE 'ready' END AS from_status, CASE event_id % 6 WHEN 0 THEN 'ready' ELSE 'retired' END AS to_status FROM {events} WHERE event_id % 6 < 5"
_STATES = "SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'processing' WHEN 1 THEN 'pending' WHEN 2 THEN 'done' WHEN 3 THEN 'failed' END AS state FROM {events}"
_ITEMS = """
SELECT event_id AS id, user_id, user_id % 3 AS book_id, CASE event_id % 2 WHEN 0 THEN 'book' ELSE 'user' END AS scope, CASE event_id % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'candidate' WHEN 2 THEN 'expired' ELSE 'completed' END AS status, event_id % 4 AS revision,
  CASE event_id % 3 WHEN 0 THEN 'open_question' ELSE 'fact' END AS kind, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY * (event_id % 200) AS created_at, event_id % 50 AS updated_at, event_type AS key FROM {events}"""
_DELETED = "SELECT user_id, user_id % 3 AS book_id FROM {events} WHERE user_id % 7 = 1"


def guarded_commands(spark, d):
    return governance.guarded(_input(spark, d, _ROWS), _input(spark, d, _COMMANDS), _input(spark, d, _EPOCHS)).select("command_id", "verdict")


def status_moves(spark, d):
    return governance.transition(_input(spark, d, _ROWS), _input(spark, d, _MOVES)).select("id", "status", "revision")


def recovered_sources(spark, d):
    return governance.recover(_input(spark, d, _STATES), "source", "state")


def cascade_deletion(spark, d):
    children = {"items": (_input(spark, d, _ITEMS), ["user_id", "book_id"]), "commands": (_input(spark, d, "SELECT event_id AS id, user_id AS owner, user_id % 3 AS book FROM {events} WHERE event_id % 2 = 0"), ["owner", "book"])}
    left = governance.delete_with(_input(spark, d, _DELETED), children, ["user_id", "book_id"])
    return left["items"].select("id", F.lit("items").alias("name")).unionByName(left["commands"].select("id", F.lit("commands").alias("name")))


def scoped_expiry(spark, d):
    return governance.expire_scoped(_input(spark, d, _ITEMS), _input(spark, d, _DELETED)).select("id", "status", "revision")


def timed_expiry(spark, d):
    out = governance.with_expiry(_input(spark, d, _ITEMS).withColumn("created_at", F.col("created_at").cast("timestamp")), F.lit("2024-05-01 00:00:00").cast("timestamp"))
    return out.select("id", "status", F.col("expires_at").cast("timestamp_ntz").alias("expires_at"))


def last_closed(spark, d):
    return governance.closed_latest(_input(spark, d, _ITEMS), ["user_id", "key"])


def own_messages(spark, d):
    conversations = _input(spark, d, "SELECT DISTINCT conv_id AS conversation_id, conv_id % 10 AS user_id FROM {conversations} WHERE conv_id % 4 > 0")
    requests = _input(spark, d, "SELECT conv_id * 100 + turn AS request_id, CASE turn % 4 WHEN 0 THEN 'failed' ELSE 'completed' END AS status FROM {conversations}")
    messages = _input(spark, d, "SELECT conv_id AS conversation_id, conv_id * 100 + turn AS request_id, turn, role, CASE turn % 3 WHEN 0 THEN 'user_text' ELSE 'tool' END AS origin FROM {conversations}")
    messages = messages.withColumn("metadata", F.to_json(F.struct("origin")))
    return governance.own_messages(messages, conversations, requests).select("conversation_id", "turn", "user_id")


def conversation_states(spark, d):
    rows = _input(spark, d, "SELECT event_id AS conversation_id, user_id, event_id % 3 AS book_id, event_id % 40 AS updated_at FROM {events}")
    return governance.active_conversations(rows).select("conversation_id", "status")


_REQUESTS = "SELECT event_id AS request_id, user_id, event_id % 3 AS book_id, CASE event_id % 5 WHEN 0 THEN 'h1' WHEN 1 THEN 'h2' END AS expected_hash FROM {events}"
_BOOKS = "SELECT DISTINCT user_id, event_id % 3 AS book_id, CASE (user_id + event_id % 3) % 6 WHEN 0 THEN CAST(NULL AS BIGINT) ELSE user_id * 3 + event_id % 3 END AS active_version FROM {events} WHERE user_id % 8 > 0"
_VERSIONS = "SELECT DISTINCT user_id * 3 + event_id % 3 AS version, CASE user_id % 11 WHEN 0 THEN -1 ELSE user_id END AS user_id, event_id % 3 AS book_id, CASE user_id % 7 WHEN 0 THEN 'building' ELSE 'ready' END AS status, 'h1' AS content_hash, CASE user_id % 5 WHEN 0 THEN 'bm25' ELSE 'embedding+bm25' END AS mode, 'f1' AS fingerprint FROM {events}"
_EMBEDDERS = "SELECT DISTINCT user_id, CASE user_id % 4 WHEN 0 THEN 'f2' ELSE 'f1' END AS fingerprint FROM {events} WHERE user_id % 6 > 0"
_FOUND = "SELECT event_id AS request_id, CASE event_id % 4 WHEN 0 THEN CAST(NULL AS BIGINT) ELSE event_id % 3 END AS bm25_hits, CASE event_id % 7 WHEN 0 THEN CAST(NULL AS BIGINT) ELSE event_id % 2 END AS vector_hits FROM {events}"


def retrieval_statuses(spark, d):
    return governance.retrieval_status(*(_input(spark, d, q) for q in (_REQUESTS, _BOOKS, _VERSIONS, _EMBEDDERS, _FOUND)))


_CALLS = "SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN CAST(NULL AS BIGINT) WHEN turn % 4 > 0 THEN turn * 3 END AS prompt_tokens, CASE WHEN conv_id % 3 = 0 THEN CAST(NULL AS BIGINT) WHEN turn % 4 > 1 THEN turn END AS completion_tokens, CASE WHEN conv_id % 3 > 0 AND turn % 4 = 0 THEN turn END AS total_tokens FROM {conversations}"


def token_use(spark, d):
    return reports.usage(_input(spark, d, _CALLS), "conv_id")


_RUNS = "SELECT event_type AS run, event_id % 3 = 0 AS right_, event_id % 5 > 0 AND event_type <> 'click' AS counted, event_id % 2 = 0 AS cited FROM {events}"


def run_rates(spark, d):
    r = reports.rates(_input(spark, d, _RUNS), ["run"], accuracy=(F.col("right_"), F.col("counted")), legality=(F.col("cited"), F.lit(True)))
    return r.select("run", F.round("accuracy", 6).alias("accuracy"), F.round("legality", 6).alias("legality"))


def reasons(spark, d):
    rows = _input(spark, d, "SELECT conv_id, turn, role, substr(text, 1, 4) AS said FROM {conversations}")
    return reports.by_reason(rows, "conv_id", "role", "said", "turn", "|")


def resolved_references(spark, d):
    refs = _input(spark, d, "SELECT conv_id, turn * 13 AS doc_id FROM {conversations}")
    return reports.resolve(refs, _input(spark, d, "SELECT doc_id, source FROM {documents} WHERE doc_id % 2 = 0"), "doc_id", "source")


def cached_summaries(spark, d):
    wanted = _input(spark, d, "SELECT doc_id, source, n_chars, lang FROM {documents}")
    cache = _input(spark, d, "SELECT DISTINCT source, lang, 'old' AS value FROM {documents} WHERE source IS NOT NULL AND lang IS NOT NULL AND n_chars % 2 = 0 AND doc_id < 40")
    done, _ = reports.cached(wanted.filter("source IS NOT NULL AND lang IS NOT NULL"), cache, ["source", "lang"], lambda m: m.withColumn("value", F.concat_ws("/", "source", "lang")))
    return done.select("doc_id", "value")


def length_grid(spark, d):
    docs = _input(spark, d, "SELECT n_chars FROM {documents}")
    run = lambda low, step: docs.filter(F.col("n_chars") >= low).agg(F.sum(F.ceil(F.col("n_chars") / step)).cast("long").alias("pieces"))
    return reports.grid(run, {"low": 100, "step": 500}, {"low": [0, 100, 1000], "step": [500, 1200]})


def window_estimates(spark, d):
    log = _input(spark, d, "SELECT conv_id, length(text) AS tokens FROM {conversations} WHERE conv_id % 5 > 0")
    return reports.window_estimate(log, _input(spark, d, "SELECT conv_id, turn AS seq, CASE WHEN turn % 3 = 2 THEN 90 ELSE -(turn * 40) END AS delta FROM {conversations} WHERE conv_id % 4 > 0"))


def shown_answers(spark, d):
    parts = _input(spark, d, "SELECT conv_id AS response_id, turn AS seq, CASE WHEN turn % 5 = 2 AND conv_id % 2 = 0 THEN 'retract' WHEN conv_id % 7 = 0 THEN 'done' ELSE 'chunk' END AS kind, substr(text, 1, 3) AS text FROM {conversations}")
    return reports.shown_answers(parts)


def first_and_last_turns(spark, d):
    e = reports.ends(_input(spark, d, "SELECT conv_id, turn, role FROM {conversations}"), "conv_id", "turn", "role")
    return e.select("conv_id", F.array_join("first", ",").alias("first"), F.array_join("last", ",").alias("last"))


_HEARD = """SELECT user_id, event_id AS seq, TIMESTAMP '2024-01-01 00:00:00' AS at, 'apply' AS op, 'fact' AS kind, 'fact.' || event_type AS key, 'v' || (event_id % 3) AS value, event_id AS order_id,
  CASE WHEN event_id % 4 < 3 THEN 'explicit' ELSE 'inferred' END AS statement_type, CASE WHEN event_id % 5 > 0 THEN 'stable' ELSE 'unknown' END AS stability FROM {events}"""
# Every op: candidates of three kinds, and what a person does to the items that the last commands made.
_LOG = """SELECT user_id, event_id AS seq, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY * FLOOR(event_id / 64) AS at, CASE event_id % 16 WHEN 3 THEN 'edit' WHEN 5 THEN 'confirm' WHEN 7 THEN 'complete' WHEN 9 THEN 'delete' WHEN 11 THEN 'enable' ELSE 'apply' END AS op,
  CASE WHEN event_id % 2 = 0 THEN user_id % 5 END AS scope_id, CASE user_id % 3 WHEN 0 THEN 'fact' WHEN 1 THEN 'open_question' ELSE 'preference' END AS kind,
  CASE user_id % 3 WHEN 0 THEN 'fact.' || event_type WHEN 1 THEN 'open_question:' || event_type ELSE 'preference.language' END AS key, CASE event_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' ELSE 'de' END AS value,
  CASE WHEN event_id % 4 < 3 THEN 'explicit' ELSE 'inferred' END AS statement_type, CASE WHEN event_id % 5 > 0 THEN 'stable' ELSE 'unknown' END AS stability, event_id % 6 = 0 AS reopen, event_id % 14 = 0 AS force, event_id AS order_id,
  CASE WHEN event_id % 16 = 5 OR event_id % 16 = 11 THEN event_id % 3 END AS epoch, CASE WHEN event_id % 8 = 3 THEN 2 ELSE 1 END AS revision, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS item_id, event_id % 32 = 11 AS enabled FROM {events}"""


def kept_memories(spark, d):
    items = memory_commands.current_items(memory_commands.fold_commands(_input(spark, d, _HEARD))).filter("status IN ('active', 'candidate')")
    return items.select("user_id", "key", "status", "value", "revision", "order_id")


def memory_changes(spark, d):
    log = memory_commands.fold_commands(_input(spark, d, _LOG))
    return log.select("user_id", "seq", "item_id", "n", "scope_id", "key", "status", "value", "revision", "source_type", "change", "reason")


def migrated_events(spark, d):
    """A table is made, backed up in two turns, split into a new layout, and a last step is taken back."""
    events = lambda rule: _input(spark, d, f"SELECT event_id, user_id, event_type, value FROM {{events}} WHERE {rule}")
    layout = Layout(spark, new_path(spark, "layout"))
    layout.migrate([
        Step("make", lambda read: {"events": events("event_id % 5 > 0")}),
        Step("backup", lambda read: {"backup": read("events").filter("user_id % 3 > 0")}),
        Step("backup_rest", lambda read: {"backup": Append(missing_rows(read("events"), read("backup"), ["event_id", "user_id"]))}),
        Step("split", lambda read: {"events": read("backup").withColumn("kind", F.when(F.col("event_type") == "error", "fault").otherwise("act")), "backup": None}),
        Step("wrong", lambda read: {"events": read("events").filter("kind = 'fault'")}),
    ])
    layout.roll_back("split")
    return layout.read("events")


# Answers to documents: evidence of up to three passages, some moved, some of an older text; citations, some of evidence that is not there; gold quotes for two in three.
_ANSWERS = """SELECT doc_id AS answer_id, lang AS run, CASE doc_id % 5 WHEN 0 THEN 'insufficient_evidence' WHEN 1 THEN CAST(NULL AS STRING) ELSE 'answer' END AS kind, CASE doc_id % 9 WHEN 0 THEN '书中没有提到' WHEN 4 THEN '  ' ELSE 'yes' END AS answer,
  CASE doc_id % 8 WHEN 0 THEN 'failed' WHEN 1 THEN CAST(NULL AS STRING) ELSE 'completed' END AS end_status, doc_id % 3 AS tool_calls, doc_id % 7 < 5 AS needs_evidence FROM {documents}"""
_SHOWN = """SELECT doc_id AS answer_id, concat('E', i) AS evidence_id, i AS ordinal, CASE WHEN (doc_id + i) % 6 > 0 THEN doc_id END AS doc_id, text AS whole, (doc_id + i) % 10 > 0 AS fresh, CASE WHEN (doc_id + i) % 6 > 0 THEN CAST(20 * i AS INT) END AS start,
  CASE WHEN (doc_id + i) % 6 > 0 THEN CAST(20 * i + 50 AS INT) END AS stop, substr(text, CASE WHEN doc_id % 13 = 0 THEN 2 ELSE 1 END + 20 * i, 50) AS text FROM {documents}, (SELECT 1 AS i UNION ALL SELECT 2 UNION ALL SELECT 3) n WHERE i <= doc_id % 4 AND length(text) > 200"""
_CITED = "SELECT doc_id AS answer_id, concat('E', i) AS evidence_id FROM {documents}, (SELECT 1 AS i UNION ALL SELECT 2) n WHERE doc_id % 2 = 0 AND i <= doc_id % 5"
_QUOTES = "SELECT doc_id AS answer_id, substr(text, 30 * i, 15) AS quote FROM {documents}, (SELECT 1 AS i UNION ALL SELECT 2 UNION ALL SELECT 4) n WHERE doc_id % 3 > 0 AND length(text) > 200"


def evidence_rates(spark, d):
    shown = _input(spark, d, _SHOWN).withColumn("content_hash", F.when(F.col("fresh"), T.content_hash(F.col("whole"))).otherwise("old")).drop("whole", "fresh").withColumnRenamed("stop", "end")
    documents = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return evaluation.answer_rates(_input(spark, d, _ANSWERS), shown, _input(spark, d, _CITED), _input(spark, d, _QUOTES), documents)


def tool_mentions(spark, d):
    """Each document is asked for its own first word, by a table function over a lateral join."""
    Tools.load().register(spark)
    found = _input(spark, d, "SELECT d.doc_id, m.rank, m.at, m.start, m.end, m.snippet FROM {documents} d, LATERAL lookupCharacter(text => d.text, name => regexp_extract(d.text, '[a-z]+', 0)) m")
    return found.select("doc_id", "rank", "at", "start", "end", F.sha2("snippet", 256).alias("text_sha256"))


_TOOL_CALLS = """SELECT doc_id AS call_id, doc_id, CASE doc_id % 4 WHEN 0 THEN 'lookupCharacter' WHEN 1 THEN 'findInText' WHEN 2 THEN 'getChapterInfo' ELSE 'other' END AS name,
  CASE doc_id % 9 WHEN 0 THEN '{{"name": "e", "query": "on", "chapterIndex": 1}}' WHEN 1 THEN '{{"name": "", "query": "x", "chapterIndex": 1.5}}' WHEN 2 THEN '{{"chapterIndex": "2"}}' WHEN 3 THEN '[1]' WHEN 4 THEN '{{'
  WHEN 6 THEN '{{"query": 3, "name": "an", "chapterTitle": 5, "chapterIndex": true}}' WHEN 7 THEN '{{"name": null, "query": "an", "chapterIndex": 2.0}}' WHEN 8 THEN '{{"chapterTitle": "nowhere", "name": "qu", "query": "  qu "}}' END AS arguments FROM {documents}"""


def tool_calls(spark, d):
    """Calls that are rows: unknown tools, arguments that are none, lacking or of another type, and what the good ones find."""
    done = Tools.load().run(_input(spark, d, _TOOL_CALLS), spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"))
    return done.select("call_id", "status", "code", "problem", "n")


# Twelve versions of two books of six users, one of them without a version, one unfinished, one another user's, some without vectors or with other ones.
_SHELF = "(SELECT DISTINCT doc_id % 6 AS u FROM {documents}) a, (SELECT 0 AS b UNION ALL SELECT 1) b"
_SHELVED = f"SELECT u AS user_id, b AS book_id, CASE WHEN u < 5 OR b = 0 THEN u * 2 + b END AS active_version FROM {_SHELF}"
_BUILT = f"SELECT u * 2 + b AS version, CASE WHEN u = 4 AND b = 1 THEN 0 ELSE u END AS user_id, b AS book_id, CASE WHEN u = 3 AND b = 0 THEN 'building' ELSE 'ready' END AS status, 'h1' AS content_hash, CASE u WHEN 1 THEN 'bm25' ELSE 'embedding+bm25' END AS mode, CASE WHEN u = 2 AND b = 1 THEN 'f2' ELSE 'f1' END AS fingerprint FROM {_SHELF}"
_MODELS = "SELECT DISTINCT doc_id % 6 AS user_id, 'f1' AS fingerprint FROM {documents} WHERE doc_id % 6 <> 3"
_ASKED = "SELECT item_id AS request_id, item_id % 7 AS user_id, item_id % 3 % 2 AS book_id, CASE item_id % 8 WHEN 0 THEN 'h1' WHEN 1 THEN 'h2' END AS expected_hash, CASE WHEN item_id % 9 = 4 THEN '--' ELSE text END AS text FROM {benchmark}"
_BODIES = "SELECT doc_id, doc_id % 12 AS version, text FROM {documents}"


def searches(spark, d):
    """Requests against their books' versions, with what became of each and its hits; every eleventh query gets no vector, every thirteenth no reranking."""
    asked, bodies = _input(spark, d, _ASKED), _input(spark, d, _BODIES)
    vectors = embed_texts(bodies.select("doc_id", "text")).join(bodies.select("doc_id", "version"), "doc_id").withColumn("fingerprint", F.expr("if(version = 5, 'f2', 'f1')"))
    query_vectors = embed_texts(asked.filter("request_id % 11 > 0").select(F.col("request_id").alias("doc_id"), "text")).select(F.col("doc_id").alias("request_id"), "embedding")
    reranker = lambda pool, texts, queries, k: retrieval.rerank(pool, texts, queries.filter("query_id % 13 > 0"), k)
    done = search.search(asked, _input(spark, d, _SHELVED), _input(spark, d, _BUILT), _input(spark, d, _MODELS), bodies, vectors, query_vectors, reranker=reranker)
    return done.withColumn("hits", F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["doc_id"].cast("string"), h["method"])), ","))


_ALL = (
    guarded_commands, status_moves, recovered_sources, cascade_deletion, scoped_expiry, timed_expiry, last_closed, own_messages, conversation_states, retrieval_statuses, token_use, run_rates, reasons, resolved_references, cached_summaries,
    length_grid, window_estimates, shown_answers, first_and_last_turns, kept_memories, memory_changes, migrated_events, evidence_rates, tool_mentions, tool_calls, searches,
)
QUERIES = {f.__name__: f for f in _ALL}

ORACLES = {
    "searches": f"""
WITH r AS ({_duck(_ASKED)}), b AS ({_duck(_SHELVED)}), v AS ({_duck(_BUILT)}), m AS ({_duck(_MODELS)}), docs AS ({_duck(_BODIES)}),
g AS (SELECT r.*, b.active_version AS version, CASE WHEN b.user_id IS NULL THEN 'INDEX_UNAVAILABLE' WHEN b.active_version IS NULL THEN 'INDEX_LEGACY' WHEN NOT coalesce(v.user_id = r.user_id AND v.book_id = r.book_id AND v.status = 'ready', false) THEN 'INDEX_UNAVAILABLE' WHEN r.expected_hash <> v.content_hash THEN 'INDEX_STALE' END AS blocked,
    CASE WHEN v.mode = 'bm25' THEN 'BM25_ONLY' WHEN m.fingerprint IS NULL THEN 'VECTOR_UNAVAILABLE' WHEN m.fingerprint <> v.fingerprint THEN 'VECTOR_INCOMPATIBLE' WHEN r.request_id % 11 = 0 THEN 'VECTOR_FAILED' END AS vc
  FROM r LEFT JOIN b ON b.user_id = r.user_id AND b.book_id = r.book_id LEFT JOIN v ON v.version = b.active_version LEFT JOIN m ON m.user_id = r.user_id),
d AS (SELECT doc_id, version, text, regexp_extract_all(lower(coalesce(text, '')), '{WORDS}') AS w FROM docs),
s AS (SELECT version, count(*) AS n, avg(len(w)) AS avg_len FROM d GROUP BY version),
tf AS (SELECT version, doc_id, token, count(*) AS tf, first(dl) AS dl FROM (SELECT version, doc_id, len(w) AS dl, unnest(w) AS token FROM d) GROUP BY ALL),
q AS (SELECT request_id, version, token, count(*) AS times FROM (SELECT request_id, version, unnest(regexp_extract_all(lower(coalesce(text, '')), '{WORDS}')) AS token FROM g WHERE blocked IS NULL) GROUP BY ALL),
df AS (SELECT version, token, count(*) AS df FROM tf GROUP BY ALL),
sc AS (SELECT request_id, doc_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_len))), 9) AS score FROM q JOIN tf USING (version, token) JOIN df USING (version, token) JOIN s USING (version) GROUP BY ALL),
x AS (SELECT request_id, doc_id, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, doc_id) AS r1 FROM sc WHERE score > 0 QUALIFY r1 <= 20),
src AS (SELECT 0 AS side, doc_id AS id, coalesce(text, '') AS text FROM docs UNION ALL SELECT 1, request_id, text FROM g WHERE blocked IS NULL AND vc IS NULL),
ch AS (SELECT side, id, unicode(c) AS u, count(*) AS n FROM (SELECT side, id, unnest(string_split(text, '')) AS c FROM src) WHERE c <> '' GROUP BY ALL),
dim AS (SELECT side, id, d, sum(v) AS v FROM (SELECT side, id, u % 1024 AS d, n::DOUBLE AS v FROM ch UNION ALL SELECT side, id, 31 * u % 1024, 0.5 * n FROM ch) GROUP BY ALL),
nrm AS (SELECT side, id, sqrt(sum(v * v)) AS l FROM dim GROUP BY ALL),
vec AS (SELECT src.side, src.id, list(coalesce(v / l, 0.0) ORDER BY d) AS e FROM src CROSS JOIN (SELECT unnest(range(1024)) AS d) LEFT JOIN dim USING (side, id, d) LEFT JOIN nrm USING (side, id) GROUP BY ALL),
y AS (SELECT g.request_id, t.id AS doc_id, row_number() OVER (PARTITION BY g.request_id ORDER BY round(list_distance(q.e, t.e), 9), t.id) AS r2 FROM g JOIN vec q ON q.side = 1 AND q.id = g.request_id JOIN docs ON docs.version = g.version JOIN vec t ON t.side = 0 AND t.id = docs.doc_id WHERE g.version <> 5 QUALIFY r2 <= 20),
u AS (SELECT request_id, doc_id, r1, r2, round(coalesce(1.0 / (60 + r1), 0.0) + coalesce(1.0 / (60 + r2), 0.0), 9) AS rrf FROM x FULL JOIN y USING (request_id, doc_id)),
p AS (SELECT *, CASE WHEN r1 IS NOT NULL AND r2 IS NOT NULL THEN 'hybrid' WHEN r1 IS NOT NULL THEN 'bm25' ELSE 'vector' END AS method, row_number() OVER (PARTITION BY request_id ORDER BY rrf DESC, r1 NULLS LAST, r2 NULLS LAST, doc_id) AS pr FROM u QUALIFY pr <= 10),
n AS (SELECT request_id, count(*) AS n FROM p GROUP BY request_id),
sh AS (SELECT p.*, n.n, n.n > 1 AND p.request_id % 13 > 0 AS redone, round(CASE WHEN regexp_matches(docs.text, '[^\\s]') THEN len(list_filter(string_split(docs.text, ''), lambda c: contains(g.text, c))) / greatest(length(docs.text), 1) ELSE 0.0 END, 9) AS share FROM p JOIN n USING (request_id) JOIN docs USING (doc_id) JOIN g USING (request_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN redone THEN -share END, pr) AS rank FROM sh),
h AS (SELECT request_id, string_agg(doc_id || ':' || method, ',' ORDER BY rank) AS hits, bool_or(redone) AS redone, bool_or(n > 1) AS several FROM o WHERE rank <= 5 GROUP BY request_id)
SELECT request_id, CASE WHEN blocked IS NULL THEN version END AS version, CASE WHEN blocked IS NOT NULL THEN 'unavailable' WHEN hits IS NULL THEN 'empty' ELSE 'ok' END AS status, blocked AS code, CASE WHEN blocked IS NULL THEN vc END AS vector_code, CASE WHEN several AND NOT redone THEN 'RERANK_FAILED' END AS rerank_code,
  CASE WHEN hits IS NOT NULL THEN CASE WHEN vc IS NULL THEN 'hybrid(embedding+bm25)' ELSE 'bm25' END || CASE WHEN redone THEN '+rerank' ELSE '' END END AS source, coalesce(hits, '') AS hits FROM g LEFT JOIN h USING (request_id)""",
    "evidence_rates": f"""
WITH a AS ({_duck(_ANSWERS)}), e AS ({_duck(_SHOWN)}), c AS ({_duck(_CITED)}), g AS ({_duck(_QUOTES)}),
x AS (SELECT answer_id, count(*) AS ne, count(start) AS nl, count(*) FILTER (start IS NOT NULL AND fresh AND text = substr(whole, start + 1, stop - start)) AS nx FROM e GROUP BY answer_id),
z AS (SELECT c.answer_id, count(*) AS nc, CASE WHEN bool_and(e.answer_id IS NOT NULL) THEN count(*) ELSE 0 END AS legal FROM c LEFT JOIN e ON e.answer_id = c.answer_id AND e.evidence_id = c.evidence_id GROUP BY c.answer_id),
q AS (SELECT g.answer_id, rn, min(e.ordinal) FILTER (contains(regexp_replace(e.text, '\\s', '', 'g'), regexp_replace(g.quote, '\\s', '', 'g'))) AS place FROM (SELECT *, row_number() OVER () AS rn FROM g) g LEFT JOIN e ON e.answer_id = g.answer_id GROUP BY g.answer_id, rn),
y AS (SELECT answer_id, count(*) AS ng, count(place) AS nf, min(place) AS place FROM q GROUP BY answer_id),
j AS (SELECT a.*, coalesce(ne, 0) AS ne, coalesce(nl, 0) AS nl, coalesce(nx, 0) AS nx, coalesce(nc, 0) AS nc, coalesce(legal, 0) AS legal, coalesce(ng, 0) AS ng, coalesce(nf, 0) AS nf, place FROM a LEFT JOIN x USING (answer_id) LEFT JOIN z USING (answer_id) LEFT JOIN y USING (answer_id))
SELECT run, count(*) AS n_answers, count(*) FILTER (end_status IS NULL OR end_status <> 'completed') AS n_errors, count(*) FILTER (trim(answer) = '') AS n_empty,
  round(CASE WHEN sum(nl) > 0 THEN sum(nx) / sum(nl) END, 6) AS coordinate_accuracy, round(CASE WHEN sum(nc) > 0 THEN sum(legal) / sum(nc) END, 6) AS citation_legality,
  round(avg(CASE WHEN nf > 0 THEN 1.0 ELSE 0.0 END) FILTER (ng > 0), 6) AS hit, round(avg(nf / ng) FILTER (ng > 0), 6) AS recall, round(avg(coalesce(1.0 / place, 0.0)) FILTER (ng > 0), 6) AS mrr,
  round(avg(CASE WHEN kind = 'answer' AND ne = 0 THEN 1.0 ELSE 0.0 END), 6) AS no_evidence_answers, round(avg(CASE WHEN tool_calls = 0 AND ne = 0 THEN 1.0 ELSE 0.0 END) FILTER (needs_evidence), 6) AS missed_retrieval,
  round(avg(CASE WHEN kind = 'insufficient_evidence' OR regexp_matches(answer, '{A.NO_ANSWER}') THEN 1.0 ELSE 0.0 END) FILTER (ng = 0), 6) AS no_answer_handling, round(avg(tool_calls), 6) AS avg_tool_calls FROM j GROUP BY run""",
    "tool_mentions": """
WITH d AS (SELECT doc_id, text, regexp_extract(text, '[a-z]+') AS w FROM documents WHERE regexp_matches(text, '[a-z]')),
p AS (SELECT *, string_split(text, w) AS pieces FROM d), r AS (SELECT *, unnest(range(1, least(7, len(pieces)))) AS rank FROM p),
a AS (SELECT *, CAST(list_sum(list_transform(pieces[1:rank], lambda x: length(x))) + (rank - 1) * length(w) AS INTEGER) AS place FROM r),
s AS (SELECT *, greatest(0, place - 80) AS lo, CAST(least(length(text), place + length(w) + 120) AS INTEGER) AS hi FROM a)
SELECT doc_id, CAST(rank AS INTEGER) AS rank, place AS "at", lo AS start, hi AS "end", sha256(substr(text, lo + 1, hi - lo)) AS text_sha256 FROM s""",
    "tool_calls": f"""
WITH c AS (SELECT c.*, d.text, CASE WHEN json_valid(arguments) THEN CAST(arguments AS JSON) END AS j FROM ({_duck(_TOOL_CALLS)}) c LEFT JOIN documents d USING (doc_id)),
o AS (SELECT *, coalesce(json_type(j) = 'OBJECT', false) AS is_object, json_type(j, '$.chapterIndex') AS it FROM c),
b AS (SELECT *, list_filter(json_keys(j), lambda k: (k = 'chapterTitle' AND json_type(j, '$.chapterTitle') <> 'VARCHAR') OR (k = 'chapterIndex' AND NOT (it IN ('UBIGINT', 'BIGINT') OR (it = 'DOUBLE' AND TRY_CAST(j->>'$.chapterIndex' AS DOUBLE) = floor(TRY_CAST(j->>'$.chapterIndex' AS DOUBLE))))))[1] AS bad FROM o),
v AS (SELECT *, CASE WHEN name = 'other' THEN NULL WHEN NOT is_object THEN 'not an object'
    WHEN name = 'lookupCharacter' THEN CASE WHEN coalesce(j->>'$.name', '') = '' THEN 'missing name' WHEN json_type(j, '$.name') <> 'VARCHAR' THEN 'not string name' END
    WHEN name = 'findInText' THEN CASE WHEN coalesce(j->>'$.query', '') = '' THEN 'missing query' WHEN json_type(j, '$.query') <> 'VARCHAR' THEN 'not string query' END
    WHEN bad IS NOT NULL THEN 'not ' || CASE bad WHEN 'chapterIndex' THEN 'integer ' ELSE 'string ' END || bad END AS problem FROM b),
n AS (SELECT *, name = 'other' OR problem IS NOT NULL AS failed, CASE name WHEN 'lookupCharacter' THEN j->>'$.name' WHEN 'findInText' THEN trim(j->>'$.query') END AS w FROM v),
f AS (SELECT *, CASE WHEN failed THEN NULL WHEN name = 'getChapterInfo' THEN CASE WHEN trim(coalesce(text, '')) = '' THEN 0 WHEN it IS NOT NULL THEN CASE WHEN TRY_CAST(j->>'$.chapterIndex' AS DOUBLE) = 1 THEN 1 ELSE 0 END WHEN contains(text, j->>'$.chapterTitle') THEN 1 ELSE 0 END
    WHEN name = 'findInText' AND length(w) < 2 THEN 0 ELSE least(CASE name WHEN 'findInText' THEN 3 ELSE 6 END, len(string_split(coalesce(text, ''), w)) - 1) END AS n FROM n)
SELECT call_id, CASE WHEN failed THEN 'error' WHEN n > 0 THEN 'ok' ELSE 'empty' END AS status, CASE WHEN name = 'other' THEN 'UNKNOWN_TOOL' WHEN failed THEN 'INVALID_TOOL_ARGS' END AS code, problem, CAST(n AS INTEGER) AS n FROM f""",
    "migrated_events": "SELECT event_id, user_id, event_type, value, CASE WHEN event_type = 'error' THEN 'fault' ELSE 'act' END AS kind FROM events WHERE event_id % 5 > 0",
    "kept_memories": """
WITH e AS (SELECT user_id, 'fact.' || event_type AS key, event_id AS seq, 'v' || (event_id % 3) AS value, event_id % 4 < 3 AND event_id % 5 > 0 AS sure FROM events),
s AS (SELECT *, value <> lag(value) OVER (PARTITION BY user_id, key ORDER BY seq) AS other FROM e WHERE sure),
a AS (SELECT user_id, key, arg_max(value, seq) AS held, min(seq) AS made, max(seq) FILTER (other) AS renewed, 1 + count(*) FILTER (other) AS revision FROM s GROUP BY ALL),
j AS (SELECT e.*, held, made, renewed, a.revision FROM e LEFT JOIN a USING (user_id, key))
SELECT user_id, key, 'active' AS status, held AS value, revision, max(seq) AS order_id FROM j WHERE value = held AND seq >= coalesce(renewed, made) GROUP BY ALL
UNION ALL SELECT user_id, key, 'candidate', value, 1, max(seq) FROM j WHERE NOT sure AND CASE WHEN renewed IS NOT NULL THEN seq > renewed AND value <> held ELSE made IS NULL OR seq < made OR value <> held END GROUP BY ALL""",
    "guarded_commands": f"""
SELECT command_id, CASE WHEN revision IS NULL THEN 'missing' WHEN expected_revision IS NULL THEN 'invalid' WHEN expected_revision <> revision THEN 'conflict' WHEN expected_epoch <> coalesce(current_epoch, 0) THEN 'conflict' ELSE 'ok' END AS verdict
FROM ({_duck(_COMMANDS)}) LEFT JOIN ({_duck(_ROWS)}) USING (id) LEFT JOIN ({_duck(_EPOCHS)}) USING (user_id)""",
    "status_moves": f"SELECT id, CASE WHEN status = from_status THEN to_status ELSE status END AS status, revision + CASE WHEN status = from_status THEN 1 ELSE 0 END AS revision FROM ({_duck(_ROWS)}) LEFT JOIN ({_duck(_MOVES)}) USING (id)",
    "recovered_sources": f"SELECT id, CASE state WHEN 'processing' THEN 'failed' WHEN 'pending' THEN 'skipped' ELSE state END AS state, CASE state WHEN 'processing' THEN 'RESTART' WHEN 'pending' THEN 'RESTART_PENDING' END AS error_code FROM ({_duck(_STATES)})",
    "cascade_deletion": "SELECT event_id AS id, 'items' AS name FROM events WHERE user_id % 7 <> 1 UNION ALL SELECT event_id, 'commands' FROM events WHERE event_id % 2 = 0 AND user_id % 7 <> 1",
    "scoped_expiry": f"""WITH i AS (SELECT *, user_id % 7 = 1 AND scope = 'book' AND status IN ('active', 'candidate') AS hit FROM ({_duck(_ITEMS)}))
SELECT id, CASE WHEN hit THEN 'expired' ELSE status END AS status, revision + CASE WHEN hit THEN 1 ELSE 0 END AS revision FROM i""",
    "timed_expiry": f"""WITH i AS (SELECT *, CASE WHEN status = 'candidate' THEN created_at + INTERVAL 30 DAY WHEN kind = 'open_question' AND status = 'active' THEN created_at + INTERVAL 90 DAY END AS expires_at FROM ({_duck(_ITEMS)}))
SELECT id, CASE WHEN expires_at <= TIMESTAMP '2024-05-01 00:00:00' THEN 'expired' ELSE status END AS status, expires_at FROM i""",
    "last_closed": f"SELECT user_id, key, id FROM ({_duck(_ITEMS)}) WHERE status IN ('completed', 'expired') QUALIFY row_number() OVER (PARTITION BY user_id, key ORDER BY updated_at DESC, id DESC) = 1",
    "own_messages": "SELECT conv_id AS conversation_id, turn, conv_id % 10 AS user_id FROM conversations WHERE role = 'user' AND turn % 3 = 0 AND conv_id % 4 > 0 AND turn % 4 <> 0",
    "conversation_states": "SELECT event_id AS conversation_id, CASE WHEN row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id % 40 DESC, event_id DESC) = 1 THEN 'active' ELSE 'archived' END AS status FROM events",
    "retrieval_statuses": f"""
WITH j AS (SELECT r.request_id, r.expected_hash, b.user_id AS known, b.active_version, v.user_id = r.user_id AND v.book_id = r.book_id AND v.status = 'ready' AS ready, v.content_hash, v.mode, v.fingerprint AS built, e.fingerprint AS now, f.bm25_hits AS bh, f.vector_hits AS vh
  FROM ({_duck(_REQUESTS)}) r LEFT JOIN ({_duck(_BOOKS)}) b ON b.user_id = r.user_id AND b.book_id = r.book_id LEFT JOIN ({_duck(_VERSIONS)}) v ON v.version = b.active_version LEFT JOIN ({_duck(_EMBEDDERS)}) e ON e.user_id = r.user_id LEFT JOIN ({_duck(_FOUND)}) f ON f.request_id = r.request_id),
c AS (SELECT *, CASE WHEN known IS NULL THEN 'INDEX_UNAVAILABLE' WHEN active_version IS NULL THEN 'INDEX_LEGACY' WHEN NOT coalesce(ready, false) THEN 'INDEX_UNAVAILABLE' WHEN expected_hash <> content_hash THEN 'INDEX_STALE' END AS blocked FROM j),
k AS (SELECT *, CASE WHEN blocked IS NULL THEN CASE WHEN mode = 'bm25' THEN 'BM25_ONLY' WHEN now IS NULL THEN 'VECTOR_UNAVAILABLE' WHEN now <> built THEN 'VECTOR_INCOMPATIBLE' WHEN vh IS NULL THEN 'VECTOR_FAILED' END END AS vector_code FROM c),
s AS (SELECT *, CASE WHEN vector_code IS NULL THEN vh END AS uh FROM k),
t AS (SELECT *, CASE WHEN blocked IS NOT NULL THEN 'unavailable' WHEN coalesce(bh, 0) + coalesce(uh, 0) > 0 THEN 'ok' WHEN bh IS NULL AND uh IS NULL THEN 'error' ELSE 'empty' END AS status FROM s)
SELECT request_id, status, CASE WHEN blocked IS NOT NULL THEN blocked WHEN status = 'error' THEN 'RETRIEVAL_FAILED' WHEN bh IS NULL THEN 'BM25_FAILED' END AS code, vector_code FROM t""",
    "token_use": f"SELECT conv_id, count(*) AS n_calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt, CAST(sum(completion_tokens) AS BIGINT) AS completion, CAST(sum(coalesce(total_tokens, prompt_tokens + completion_tokens)) AS BIGINT) AS total, CASE WHEN conv_id % 3 = 0 THEN 'unavailable' ELSE 'actual' END AS kind FROM ({_duck(_CALLS)}) GROUP BY conv_id",
    "run_rates": "SELECT event_type AS run, round(avg(CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.0 END) FILTER (event_id % 5 > 0 AND event_type <> 'click'), 6) AS accuracy, round(avg(CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 0.0 END), 6) AS legality FROM events GROUP BY event_type",
    "reasons": "SELECT conv_id, role, string_agg(substr(text, 1, 4), '|' ORDER BY turn, text) AS texts FROM conversations GROUP BY conv_id, role",
    "resolved_references": "SELECT c.turn * 13 AS doc_id, conv_id, coalesce(source, 'deleted:' || (c.turn * 13)) AS source FROM conversations c LEFT JOIN (SELECT doc_id, source FROM documents WHERE doc_id % 2 = 0) d ON d.doc_id = c.turn * 13",
    "cached_summaries": "SELECT doc_id, CASE WHEN (source, lang) IN (SELECT (source, lang) FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND n_chars % 2 = 0 AND doc_id < 40) THEN 'old' ELSE source || '/' || lang END AS value FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL",
    "length_grid": """WITH g AS (SELECT * FROM (VALUES ('base', 100, 500), ('low=0', 0, 500), ('low=1000', 1000, 500), ('step=1200', 100, 1200)) t(condition, low, step))
SELECT condition, CAST(sum(ceil(n_chars / step)) AS BIGINT) AS pieces FROM g, documents WHERE n_chars >= low GROUP BY condition""",
    "window_estimates": """WITH b AS (SELECT conv_id, sum(length(text)) AS t FROM conversations WHERE conv_id % 5 > 0 GROUP BY conv_id),
m AS (SELECT conv_id, list(d ORDER BY turn, d) AS ds FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 90 ELSE -(turn * 40) END AS d FROM conversations WHERE conv_id % 4 > 0) GROUP BY conv_id)
SELECT conv_id, CAST(list_reduce(list_concat([CAST(coalesce(t, 0) AS BIGINT)], list_transform(coalesce(ds, []), lambda x: CAST(x AS BIGINT))), lambda a, x: greatest(0, a + x)) AS BIGINT) AS tokens FROM b FULL JOIN m USING (conv_id)""",
    "shown_answers": """WITH p AS (SELECT conv_id AS response_id, turn AS seq, CASE WHEN turn % 5 = 2 AND conv_id % 2 = 0 THEN 'retract' WHEN conv_id % 7 = 0 THEN 'done' ELSE 'chunk' END AS kind, substr(text, 1, 3) AS text FROM conversations),
l AS (SELECT *, coalesce(max(CASE WHEN kind = 'retract' THEN seq END) OVER (PARTITION BY response_id), -1) AS last FROM p)
SELECT response_id, coalesce(string_agg(text, '' ORDER BY seq, text) FILTER (kind = 'chunk' AND seq > last), '') AS answer FROM l GROUP BY response_id""",
    "first_and_last_turns": "SELECT conv_id, array_to_string(list(role ORDER BY turn, role)[1:5], ',') AS first, array_to_string(list(role ORDER BY turn, role)[-3:], ',') AS last FROM conversations GROUP BY conv_id",
}
