"""Run records: an append-only log of events folded to documents, their digests, and what is read off them."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Settings that a run's conclusions depend on, fields of a node's output that are kept, and report sections with the agent that completes each.
DIGESTED = (
    "deep_think_provider", "deep_think_llm", "quick_think_provider", "quick_think_llm", "judge_iterations", "max_risk_discuss_rounds",
    "data_vendors", "tool_vendors", "output_language", "memory_min_similarity", "social_nli_filter",
)
NESTED = ("current_response", "judge_decision", "judge_critique_bull", "judge_critique_bear")
SECTIONS = (
    ("market_report", "market", "Market Analyst"), ("sentiment_report", "social", "Social Analyst"), ("news_report", "news", "News Analyst"), ("fundamentals_report", "fundamentals", "Fundamentals Analyst"),
    ("investment_plan", None, "Research Manager"), ("trader_investment_plan", None, "Trader"), ("final_trade_decision", None, "Portfolio Manager"),
)
REPORTS = ("market_report", "sentiment_report", "news_report", "fundamentals_report")
#: What each node of a run reads, as paths into its state.
READS = {
    "Researcher Round": (*REPORTS, "investment_debate_state.judge_critique_bull", "investment_debate_state.judge_critique_bear"),
    "Judge Researcher": ("investment_debate_state.bull_history", "investment_debate_state.bear_history"),
    "Research Manager": ("investment_debate_state.history", *REPORTS),
    "Trader": ("investment_plan", *REPORTS),
    "Aggressive Analyst": ("trader_investment_plan", "risk_debate_state.history"),
    "Conservative Analyst": ("trader_investment_plan", "risk_debate_state.history"),
    "Neutral Analyst": ("trader_investment_plan", "risk_debate_state.history"),
    "Portfolio Manager": ("investment_plan", "trader_investment_plan", "risk_debate_state.history"),
}
DEBATE = "struct<bull_history:string,bear_history:string,history:string,current_response:string,judge_decision:string,count:int,judge_history:string,judge_critique_bull:string,judge_critique_bear:string,judge_count:int>"
RISK = (
    "struct<aggressive_history:string,conservative_history:string,neutral_history:string,history:string,latest_speaker:string,current_aggressive_response:string,"
    "current_conservative_response:string,current_neutral_response:string,judge_decision:string,count:int>"
)


def settings_digest(settings: dict) -> str:
    """Sixteen hex digits that change with any setting that conclusions depend on, and with no other."""
    told = json.dumps({k: settings.get(k) for k in DIGESTED}, sort_keys=True, default=str)
    return hashlib.sha256(told.encode()).hexdigest()[:16]


def digest_column(raw: Column) -> Column:
    """The digest of a settings column of JSON text: the digested fields as canonical JSON, nested settings in order of name too.

    Text that isn't a JSON object counts as one without fields.
    """

    @F.arrow_udf("string")
    def told(texts: pa.Array) -> pa.Array:
        return pa.array([settings_digest(_object(t)) for t in texts.to_pylist()], pa.string())

    return told(raw)


def _object(text: str | None) -> dict:
    try:
        told = json.loads(text or "")
    except ValueError:
        return {}
    return told if isinstance(told, dict) else {}


def fold(log: DataFrame) -> DataFrame:
    """(ticker, date, agent) with status, times, numbers of turns and tool calls, characters of tool results and of output, from events (ticker, date, agent, kind, seq, text).

    A status is that of the last of start, finish and fail; only sums and maxima are kept, so a task holds no history.
    """
    kind, told = F.col("kind"), F.col("kind").isin("agent_start", "agent_finish", "fail")
    status = F.when(kind == "agent_start", "in_progress").when(kind == "agent_finish", "completed").otherwise("error")
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    return log.groupBy("ticker", "date", "agent").agg(
        F.coalesce(F.max_by(F.when(told, status), F.when(told, F.col("seq"))), F.lit("pending")).alias("status"),
        F.min(F.when(kind == "agent_start", F.col("seq"))).alias("started_at"), F.max(F.when(kind == "agent_finish", F.col("seq"))).alias("finished_at"),
        F.count_if(kind == "llm_turn").alias("turns"), F.count_if(kind == "tool_call").alias("calls"), F.coalesce(F.sum(F.when(kind == "tool_call", size)), F.lit(0)).alias("result_chars"),
        F.coalesce(F.max_by(F.when(kind == "agent_finish", size), F.when(kind == "agent_finish", F.col("seq"))), F.lit(0)).alias("output_chars"),
    )


def has_content(status: Column, items: Column) -> Column:
    """Whether an agent's entry is worth showing: done or failed, or under way with something to show."""
    return F.coalesce(status.isin("completed", "error") | (status == "in_progress") & (items > 0), F.lit(False))


def replayable(records: DataFrame, digest: Column) -> DataFrame:
    """Completed records of the same settings that have a final decision."""
    return records.where((F.col("status") == "completed") & (F.col("digest") == digest) & F.col("final").isNotNull())


def dig(state: Column, path: str) -> Column:
    """A field of a JSON state by its dotted path, null if absent."""
    return F.get_json_object(state, "$." + path)


def outputs(result: Column, keys: tuple[str, ...]) -> Column:
    """The texts that a node produced, as (key, text): its own non-empty fields but messages, and the nested ones that are kept."""
    own = [(k, F.get_json_object(result, f"$.{k}")) for k in keys if k != "messages"]
    inner = [(f"{k}.{n}", F.get_json_object(result, f"$.{k}.{n}")) for k in keys for n in NESTED]
    text = lambda k, v: F.when((F.length(v) > 0) & ~v.startswith("{"), F.struct(F.lit(k).alias("key"), v.alias("text")))
    return F.array_compact(F.array(*[text(k, v) for k, v in own + inner]))


def sections(spark, selected: list[str]) -> DataFrame:
    """(place, section, agent) of the report sections that the selected analysts lead to."""
    chosen = {a.lower() for a in selected}
    return spark.createDataFrame([(i, s, g) for i, (s, a, g) in enumerate(SECTIONS) if a is None or a in chosen], "place int, section string, agent string")


def completed_reports(reports: DataFrame, statuses: DataFrame, sections: DataFrame) -> DataFrame:
    """(run, n): sections with text whose completing agent is done; reports (run, section, text), statuses (run, agent, status)."""
    done = statuses.where("status = 'completed'").select("run", "agent")
    ready = reports.where("text IS NOT NULL").join(F.broadcast(sections), "section").join(done, ["run", "agent"], "left_semi")  # a section a row
    return reports.select("run").distinct().join(ready.groupBy("run").agg(F.count("*").alias("n")), "run", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def initial_state(company: Column, date: Column) -> Column:
    """The state that a run begins with: empty histories and reports, counts of 0."""
    blank = lambda kind: F.from_json(F.lit(json.dumps({f.split(":")[0]: 0 if f.endswith("int") else "" for f in kind[7:-1].split(",")})), kind)
    return F.struct(
        F.array(F.struct(F.lit("human").alias("role"), company.alias("text"))).alias("messages"), company.alias("company_of_interest"), date.cast("string").alias("trade_date"),
        blank(DEBATE).alias("investment_debate_state"), blank(RISK).alias("risk_debate_state"), *[F.lit("").alias(r) for r in REPORTS],
    )


def quality_line(date: Column, metrics: Column, signal: Column) -> Column:
    """One line on a day's data: posts on target and fetched, news items, the filing's form, the signal; what is absent counts as 0 or none."""
    number = lambda p: F.coalesce(F.get_json_object(metrics, p).try_cast("long"), F.lit(0)).cast("string")
    news = F.from_json(F.get_json_object(metrics, "$.news"), "map<string,bigint>")
    total = F.coalesce(F.aggregate(F.map_values(news), F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0)).cast("string")
    form = F.when(F.get_json_object(metrics, "$.filing.available") == "true", F.coalesce(F.get_json_object(metrics, "$.filing.form"), F.lit("none"))).otherwise("none")
    return F.concat(date.cast("string"), F.lit(": social "), number("$.social.on_target"), F.lit("/"), number("$.social.fetched"), F.lit(", news "), total, F.lit(", 10-K "), form, F.lit(", signal "), signal)


def quality_text(metrics: Column) -> Column:
    """Three lines on a day's data, with words for what isn't there yet."""
    at = lambda p: F.get_json_object(metrics, p)
    news = F.from_json(at("$.news"), "map<string,bigint>")
    total = F.aggregate(F.map_values(news), F.lit(0).cast("long"), lambda s, x: s + x)
    parts = F.array_join(F.transform(F.map_entries(news), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ", ")
    social = (
        F.when(at("$.social").isNull(), "Social: pending").when(at("$.social.status") == "no_relevant", "No on-target social posts today")
        .when(at("$.social.status") == "missing_historical", "No historical social data (backtest date)")
        .otherwise(F.concat(F.lit("Social SNR: "), F.coalesce(at("$.social.on_target"), F.lit("0")), F.lit("/"), F.coalesce(at("$.social.fetched"), F.lit("0")), F.lit(" ("), F.coalesce(F.format_string("%.0f%%", at("$.social.snr").try_cast("double") * 100), F.lit("n/a")), F.lit(")")))
    )
    items = F.when(F.coalesce(F.size(news), F.lit(0)) <= 0, "News: pending").otherwise(F.concat(F.lit("News items: "), total.cast("string"), F.lit(" ("), parts, F.lit(")")))
    filing = (
        F.when(at("$.filing").isNull(), "10-K: not queried yet").when(F.coalesce(at("$.filing.available"), F.lit("false")) != "true", "10-K: no filing on EDGAR")
        .otherwise(F.concat(F.lit("10-K: "), F.coalesce(at("$.filing.form"), F.lit("10-K")), F.lit(" filed "), F.coalesce(at("$.filing.filed_date"), F.lit("?")), F.lit(", "), F.coalesce(at("$.filing.n_hits"), F.lit("0")), F.lit(" hits")))
    )
    return F.concat_ws("\n", social, items, filing)


BLOCKS = "array<struct<type:string,text:string>>"


def blank(text: Column) -> Column:
    """Whether a text says nothing: empty, white space, or an empty literal."""
    t = F.trim(text)
    return F.coalesce(t.isin("", "[]", "{}", "()", "None", "0", "''", '""', "False", "set()", "0.0"), F.lit(True))


def content_text(raw: Column) -> Column:
    """A message's text from plain text, a JSON object with a text, or a JSON list of blocks (joined by a space); null without any."""
    listed = F.filter(F.from_json(raw, BLOCKS), lambda b: (b["type"] == "text") & ~blank(b["text"]))
    joined = F.array_join(F.transform(listed, lambda b: F.trim(b["text"])), " ")
    inner = F.get_json_object(raw, "$.text")
    text = F.when(F.trim(raw).startswith("["), joined).when(F.trim(raw).startswith("{"), inner).otherwise(raw)
    return F.when(~blank(raw) & ~blank(text), F.trim(text))


def joined_blocks(raw: Column) -> Column:
    """A model's answer as one text: blocks of text joined by line breaks, others left out; plain text as it is."""
    listed = F.filter(F.from_json(raw, BLOCKS), lambda b: (b["type"] == "text") & (F.length(b["text"]) > 0))
    return F.when(F.trim(raw).startswith("["), F.array_join(F.transform(listed, lambda b: b["text"]), "\n")).otherwise(raw)


def message_kind(role: Column, content: Column) -> Column:
    human = F.when(F.trim(content) == "Continue", "Control").otherwise("User")
    return F.when(role == "human", human).when(role == "tool", "Data").when(role == "ai", "Agent").otherwise("System")


def clamped(raw: Column, default: float, low: float, high: float) -> Column:
    """A parameter given as text within its range; the default if it is missing or no number."""
    v = raw.try_cast("double")
    return F.when(v.isNull() | F.isnan(v), F.lit(default)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), v)))
