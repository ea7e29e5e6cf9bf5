"""Queries of run records, messages and parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolake.functions import scalars as S
from chronolake.functions import text as X
from chronolake.operators import records as Q
from chronolake.plans.book import query
from chronolake.plans.views import table

_LOG = "lg AS (SELECT 'T' || user_id AS ticker, CAST(ts AS DATE) AS date, CASE user_id % 3 WHEN 0 THEN 'Trader' WHEN 1 THEN 'News Analyst' ELSE 'Market Analyst' END AS agent, CASE event_type WHEN 'view' THEN 'llm_turn' WHEN 'click' THEN 'tool_call' WHEN 'purchase' THEN 'agent_finish' WHEN 'signup' THEN 'agent_start' ELSE 'fail' END AS kind, event_id AS seq, props AS text FROM events)"


def _log(spark, sf):
    k, e = F.col("user_id") % 3, F.col("event_type")
    agent = F.when(k == 0, "Trader").when(k == 1, "News Analyst").otherwise("Market Analyst")
    kind = F.when(e == "view", "llm_turn").when(e == "click", "tool_call").when(e == "purchase", "agent_finish").when(e == "signup", "agent_start").otherwise("fail")
    return table(spark, sf, "events").select(F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("ticker"), F.col("ts").cast("date").alias("date"), agent.alias("agent"), kind.alias("kind"), F.col("event_id").alias("seq"), F.col("props").alias("text"))


@query([], f"""WITH {_LOG} SELECT ticker, date, agent, coalesce(arg_max(CASE kind WHEN 'agent_start' THEN 'in_progress' WHEN 'agent_finish' THEN 'completed' ELSE 'error' END, seq) FILTER (kind IN ('agent_start', 'agent_finish', 'fail')), 'pending') AS status,
  min(seq) FILTER (kind = 'agent_start') AS started_at, max(seq) FILTER (kind = 'agent_finish') AS finished_at, count(*) FILTER (kind = 'llm_turn') AS turns, count(*) FILTER (kind = 'tool_call') AS calls,
  CAST(coalesce(sum(length(text)) FILTER (kind = 'tool_call'), 0) AS BIGINT) AS result_chars, coalesce(arg_max(length(text), seq) FILTER (kind = 'agent_finish'), 0) AS output_chars FROM lg GROUP BY ticker, date, agent""")
def m12_k5_y32_run_records(spark, sf):
    return Q.fold(_log(spark, sf))


@query([], f"""WITH {_LOG}, f AS (SELECT ticker, date, agent, arg_max(kind, seq) FILTER (kind IN ('agent_start', 'agent_finish', 'fail')) AS last, count(*) FILTER (kind IN ('llm_turn', 'tool_call')) AS n FROM lg GROUP BY ALL),
c AS (SELECT * FROM f WHERE date <= DATE '2024-01-15' AND (last IN ('agent_finish', 'fail') OR last = 'agent_start' AND n > 0)) SELECT ticker, agent, max(date) AS date FROM c GROUP BY ticker, agent""")
def j9_p23_y46_agent_view(spark, sf):
    """The latest day up to the current one on which an agent has something to show."""
    f = Q.fold(_log(spark, sf)).where("date <= DATE '2024-01-15'").where(Q.has_content(F.col("status"), F.col("turns") + F.col("calls")))
    return f.groupBy("ticker", "agent").agg(F.max("date").alias("date"))


@query([], f"WITH {_LOG} SELECT ticker, list_sort(list(DISTINCT date)) AS days FROM lg GROUP BY ticker")
def s44_run_days(spark, sf):
    return _log(spark, sf).groupBy("ticker").agg(F.sort_array(F.collect_set("date")).alias("days"))  # a ticker's days are some thousand at most


_SET = """'{"deep_think_llm": "m' || event_id % 3 || '", "judge_iterations": ' || event_id % 2 || ', "other": ' || event_id || '}'"""
_DIG = """left(sha256('{"data_vendors": null, "deep_think_llm": "m' || event_id % 3 || '", "deep_think_provider": null, "judge_iterations": ' || event_id % 2 || ', "max_risk_discuss_rounds": null, "memory_min_similarity": null, "output_language": null, "quick_think_llm": null, "quick_think_provider": null, "social_nli_filter": null, "tool_vendors": null}'), 16)"""


@query([], f"SELECT event_id, {_DIG} AS digest FROM events")
def f8_settings_digest(spark, sf):
    i = F.col("event_id")
    raw = F.concat(F.lit('{"deep_think_llm": "m'), (i % 3).cast("string"), F.lit('", "judge_iterations": '), (i % 2).cast("string"), F.lit(', "other": '), i.cast("string"), F.lit("}"))
    return table(spark, sf, "events").select("event_id", Q.digest_column(raw).alias("digest"))


_NESTED = _DIG.replace('"data_vendors": null', '"data_vendors": {"core": "a", "news": ["x", \' || user_id % 4 || \']}')


@query([], f"SELECT event_id, {_NESTED} AS digest FROM events")
def f8_nested_settings(spark, sf):
    """Nested settings count by what they say, not by how they are written."""
    i, odd = F.col("event_id"), F.col("event_id") % 2 == 1
    vendors = F.when(odd, F.concat(F.lit('{"news":["x",'), (F.col("user_id") % 4).cast("string"), F.lit('],  "core":"a"}'))).otherwise(F.concat(F.lit('{"core": "a", "news": ["x", '), (F.col("user_id") % 4).cast("string"), F.lit("]}")))
    raw = F.concat(F.lit('{"deep_think_llm": "m'), (i % 3).cast("string"), F.lit('", "judge_iterations": '), (i % 2).cast("string"), F.lit(', "data_vendors": '), vendors, F.lit(', "other": '), i.cast("string"), F.lit("}"))
    return table(spark, sf, "events").select("event_id", Q.digest_column(raw).alias("digest"))


@query([], "SELECT event_id FROM events WHERE event_type = 'purchase' AND user_id % 3 = 1 AND event_id % 4 > 0")
def p24_replayable(spark, sf):
    i = F.col("event_id")
    rec = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "purchase", "completed").otherwise("running").alias("status"), F.concat(F.lit("d"), (F.col("user_id") % 3).cast("string")).alias("digest"), F.when(i % 4 > 0, "BUY").alias("final"))
    return Q.replayable(rec, F.lit("d1")).select("event_id")


@query([], "SELECT conv_id, turn, 'plan' AS key, text FROM conversations WHERE turn % 2 = 0 AND text <> '' UNION ALL SELECT conv_id, turn, 'debate.judge_decision', role FROM conversations")
def p20_p21_outputs(spark, sf):
    """The texts of a node's result: its own, those nested in its states, no messages."""
    plan = F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise("")
    raw = F.to_json(F.struct(plan.alias("plan"), F.lit("m").alias("messages"), F.struct(F.col("role").alias("judge_decision"), F.lit("").alias("current_response"), F.lit("x").alias("other")).alias("debate")))
    d = table(spark, sf, "conversations").select("conv_id", "turn", raw.alias("raw"))
    picked = d.where(Q.dig(F.col("raw"), "debate.judge_decision").isNotNull() & Q.dig(F.col("raw"), "debate.nothing").isNull())
    return picked.select("conv_id", "turn", F.explode(Q.outputs(F.col("raw"), ("plan", "messages", "debate"))).alias("o")).select("conv_id", "turn", "o.key", "o.text")


@query([], """SELECT event_id, CAST(ts AS DATE) || ': social ' || CASE WHEN event_id % 3 = 0 THEN '0/0' ELSE event_id % 5 || '/' || event_id % 9 END || ', news ' || (event_id % 7 + 2) || ', 10-K ' || CASE WHEN event_id % 2 = 0 THEN '10-Q' ELSE 'none' END || ', signal ' || event_type AS line,
  CASE WHEN event_id % 3 = 0 THEN 'Social: pending' ELSE 'Social SNR: ' || event_id % 5 || '/' || event_id % 9 || ' (50%)' END || chr(10) || 'News items: ' || (event_id % 7 + 2) || ' (a=' || event_id % 7 || ', b=2)' || chr(10) || CASE WHEN event_id % 2 = 0 THEN '10-K: 10-Q filed ?, 0 hits' ELSE '10-K: no filing on EDGAR' END AS text FROM events""")
def a27_y40_data_quality(spark, sf):
    i = F.col("event_id")
    s = lambda c: c.cast("string")
    social = F.when(i % 3 == 0, "").otherwise(F.concat(F.lit('"social": {"on_target": '), s(i % 5), F.lit(', "fetched": '), s(i % 9), F.lit(', "snr": 0.5}, ')))
    filing = F.when(i % 2 == 0, '"filing": {"available": true, "form": "10-Q"}').otherwise('"filing": {"available": false}')
    raw = F.concat(F.lit("{"), social, F.lit('"news": {"a": '), s(i % 7), F.lit(', "b": 2}, '), filing, F.lit("}"))
    return table(spark, sf, "events").select("event_id", Q.quality_line(F.col("ts").cast("date"), raw, F.col("event_type")).alias("line"), Q.quality_text(raw).alias("text"))


@query([], """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN trim(text, ' ') WHEN 1 THEN 'a ' || trim(text, ' ') WHEN 2 THEN trim(text, ' ') END AS content, CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN 'a' || chr(10) || text WHEN 2 THEN NULL ELSE '[]' END AS joined,
  CASE WHEN role = 'user' THEN CASE WHEN turn % 4 = 3 THEN 'Control' ELSE 'User' END WHEN role = 'assistant' THEN 'Agent' ELSE 'System' END AS kind FROM conversations""")
def x15_x16_x17_messages(spark, sf):
    """Messages as plain text, as lists of blocks, as objects and as nothing."""
    t, k = F.col("text"), F.col("turn") % 4
    block = lambda kind, x: F.struct(F.lit(kind).alias("type"), x.alias("text"))
    listed = F.to_json(F.array(block("reasoning", F.lit("hidden")), block("text", F.lit("a")), block("text", t)))
    raw = F.when(k == 0, t).when(k == 1, listed).when(k == 2, F.to_json(F.struct(t.alias("text")))).otherwise("[]")
    role = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "ai").otherwise(F.col("role"))
    joined = F.when(k == 2, None).when(k == 3, "[]").otherwise(Q.joined_blocks(raw))
    return table(spark, sf, "conversations").select("conv_id", "turn", Q.content_text(raw).alias("content"), joined.alias("joined"), Q.message_kind(role, F.when(k == 3, "Continue").otherwise(t)).alias("kind"))


@query([], "SELECT conv_id, turn, CASE WHEN turn % 3 > 0 THEN 'buy ' || role END AS bull, CASE WHEN turn % 3 > 0 THEN 'sell' || chr(10) || 'more' END AS bear FROM conversations")
def x11_judge_blocks(spark, sf):
    """Both directives of a judge, or neither."""
    t = F.concat(F.lit("text <bull_directive> buy "), "role", F.lit(" </bull_directive> x "), F.when(F.col("turn") % 3 > 0, "<BEAR_directive>sell\nmore </bear_directive>").otherwise(""))
    p = table(spark, sf, "conversations").select("conv_id", "turn", X.judge_directives(t).alias("p"))
    return p.select("conv_id", "turn", "p.bull", "p.bear")


_SEL = "(VALUES (0, 'market_report', 'Market Analyst'), (2, 'news_report', 'News Analyst'), (4, 'investment_plan', 'Research Manager'), (5, 'trader_investment_plan', 'Trader'), (6, 'final_trade_decision', 'Portfolio Manager')) s(place, section, agent)"


@query([], f"SELECT place, section, agent, count(o_orderkey) AS reports FROM {_SEL} LEFT JOIN orders ON (o_orderkey % 9 = place) GROUP BY ALL")
def m14a_sections(spark, sf):
    """The sections that the selected analysts lead to, and how many reports there are of each."""
    o = table(spark, sf, "orders").groupBy((F.col("o_orderkey") % 9).cast("int").alias("place")).agg(F.count("*").alias("reports"))
    return Q.sections(spark, ["Market", "news"]).join(o, "place", "left").withColumn("reports", F.coalesce("reports", F.lit(0)))


@query([], f"""WITH r AS (SELECT o_custkey AS run, CASE o_orderkey % 4 WHEN 0 THEN 'market_report' WHEN 1 THEN 'news_report' WHEN 2 THEN 'investment_plan' ELSE 'sentiment_report' END AS section, CASE WHEN o_orderstatus <> 'P' THEN 'x' END AS text FROM orders),
t AS (SELECT DISTINCT o_custkey AS run, CASE WHEN o_custkey % 3 = 0 THEN 'News Analyst' ELSE 'Market Analyst' END AS agent FROM orders WHERE o_custkey % 5 > 0), o AS (SELECT DISTINCT run, section FROM r WHERE text IS NOT NULL)
SELECT a.run, count(t.run) AS n FROM (SELECT DISTINCT run FROM r) a LEFT JOIN o USING (run) LEFT JOIN {_SEL} USING (section) LEFT JOIN t ON t.run = a.run AND t.agent = s.agent GROUP BY a.run""")
def y36_completed_reports(spark, sf):
    """Sections count once their text is there and the agent that completes them is done."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey") % 4
    section = F.when(k == 0, "market_report").when(k == 1, "news_report").when(k == 2, "investment_plan").otherwise("sentiment_report")
    reports = o.groupBy(F.col("o_custkey").alias("run"), section.alias("section")).agg(F.max(F.when(F.col("o_orderstatus") != "P", "x")).alias("text"))
    agent = F.when(F.col("run") % 3 == 0, "News Analyst").otherwise("Market Analyst")
    statuses = o.select(F.col("o_custkey").alias("run")).distinct().select("run", agent.alias("agent"), F.when(F.col("run") % 5 > 0, "completed").otherwise("pending").alias("status"))
    return Q.completed_reports(reports, statuses, Q.sections(spark, ["market", "news"]))


@query([], "SELECT c_custkey, c_name AS company, '2024-01-02' AS date, 0 AS count, '' AS history, '' AS speaker, '' AS report FROM customer")
def y30_initial_state(spark, sf):
    s = table(spark, sf, "customer").select("c_custkey", Q.initial_state(F.col("c_name"), F.lit("2024-01-02")).alias("s"))
    return s.select("c_custkey", F.col("s.messages")[0]["text"].alias("company"), F.col("s.trade_date").alias("date"), F.col("s.investment_debate_state.count").alias("count"), F.col("s.investment_debate_state.judge_history").alias("history"), F.col("s.risk_debate_state.latest_speaker").alias("speaker"), F.col("s.news_report").alias("report"))


@query([], """WITH n AS (SELECT 'Judge Researcher' AS node, unnest(['investment_debate_state.bull_history', 'investment_debate_state.bear_history']) AS path UNION ALL SELECT unnest(['Aggressive Analyst', 'Conservative Analyst', 'Neutral Analyst']), 'trader_investment_plan' UNION ALL SELECT unnest(['Aggressive Analyst', 'Conservative Analyst', 'Neutral Analyst']), 'risk_debate_state.history'),
s AS (SELECT conv_id, CASE turn % 4 WHEN 0 THEN 'Judge Researcher' WHEN 1 THEN 'Aggressive Analyst' WHEN 2 THEN 'Conservative Analyst' ELSE 'Neutral Analyst' END AS node FROM conversations)
SELECT conv_id, path, count(*) AS reads FROM s JOIN n USING (node) GROUP BY conv_id, path""")
def y31_reads_of_debaters(spark, sf):
    """How often the turns of each conversation, taken by the debating nodes, read each part of the state."""
    reads = spark.createDataFrame([(n, p) for n, paths in Q.READS.items() for p in paths], "node string, path string")
    k = F.col("turn") % 4
    node = F.when(k == 0, "Judge Researcher").when(k == 1, "Aggressive Analyst").when(k == 2, "Conservative Analyst").otherwise("Neutral Analyst")
    turns = table(spark, sf, "conversations").groupBy("conv_id", node.alias("node")).agg(F.count("*").alias("n"))
    return turns.join(F.broadcast(reads), "node").groupBy("conv_id", "path").agg(F.sum("n").alias("reads"))  # a node's paths are fixed


@query([], "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0.75::DOUBLE WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.0::DOUBLE ELSE (event_id % 100)::DOUBLE / 100 END AS overweight FROM events")
def p25_clamped_parameters(spark, sf):
    i = F.col("event_id")
    raw = F.when(i % 8 == 0, "NaN").when(i % 4 == 0, "many").when(i % 4 == 1, "7").when(i % 4 == 2, "-1").otherwise(((i % 100) / 100).cast("string"))
    return table(spark, sf, "events").select("event_id", Q.clamped(raw, 0.75, 0.0, 1.0).alias("overweight"))


@query([], """SELECT event_id, CASE event_id % 4 WHEN 0 THEN s WHEN 1 THEN s - INTERVAL 2 HOUR WHEN 2 THEN NULL ELSE s + INTERVAL 5 HOUR END AS utc, CASE event_id % 3 WHEN 0 THEN make_timestamp(event_id * 1000000) WHEN 1 THEN s END AS post,
  CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN -1 WHEN 2 THEN 0 END AS label, CASE WHEN event_id >= 1000 THEN printf('%.1fk', event_id / 1000.0::DOUBLE) ELSE CAST(event_id AS VARCHAR) END AS tokens,
  (event_id % 10)::DOUBLE / 10 AS entity, greatest(0.0::DOUBLE, round((event_id % 7 - event_id % 10)::DOUBLE / 10, 6)) AS person, greatest(0.0::DOUBLE, round((5 - event_id % 7)::DOUBLE / 10, 6)) AS date FROM (SELECT *, date_trunc('second', ts) AS s FROM events)""")
def f1_f3_f13_f15_f19_scalars(spark, sf):
    i, t = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    iso = F.when(i % 4 == 0, F.concat(t, F.lit("Z"))).when(i % 4 == 1, F.concat(t, F.lit("+02:00"))).when(i % 4 == 2, t).otherwise(F.concat(t, F.lit("-05:00")))
    raw = F.when(i % 3 == 0, i.cast("string")).when(i % 3 == 1, F.concat(t, F.lit("Z"))).otherwise("yesterday")
    label = F.when(i % 5 == 0, " 1 ").when(i % 5 == 1, "-1").when(i % 5 == 2, "0").when(i % 5 == 3, "1.0").otherwise("True")
    tenth = lambda c: c.cast("double") / 10
    s = S.sensitivity(tenth(i % 10), tenth(i % 7), F.lit(0.5))
    d = table(spark, sf, "events").select("event_id", S.iso_utc(iso).cast("timestamp_ntz").alias("utc"), S.post_time(raw).cast("timestamp_ntz").alias("post"), S.strict_label(label).alias("label"), S.thousands(i).alias("tokens"), s.alias("s"))
    return d.select("event_id", "utc", "post", "label", "tokens", "s.entity", F.round("s.person", 6).alias("person"), F.round("s.date", 6).alias("date"))
