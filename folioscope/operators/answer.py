"""Prompts, citation markers, answers without a model, chat requests, and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import is_blank, strip
from folioscope.operators.chunk import STRATEGIES

SNIPPET = 600
NOTHING_FOUND = "No passages match the question."
NO_MODEL = "No model is set up; these are the passages found."
RULE = "\n\n---\n\n"
#: US dollars for a million input and output tokens, a row for each model that is priced; a parameter of usage_cost.
PRICES = "model string, rate_in double, rate_out double"


def build_prompts(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, prompt): numbered passages with their names, sections and first pages, then the question.

    passages: query_id, position, document_name, text, section_path, page_no (null: none).
    """
    where = F.array_join(F.coalesce("section_path", F.array().cast("array<string>")), " > ")
    head = F.concat(
        F.format_string("[%d] %s", "position", "document_name"),
        F.when(where != "", F.concat(F.lit(" — "), where)).otherwise(F.lit("")),
        F.when(F.col("page_no").isNotNull(), F.format_string(" (page %d)", "page_no")).otherwise(F.lit("")),
    )
    one = passages.select("query_id", "position", F.concat(head, F.lit("\n"), F.col("text")).alias("p"))
    all_of = one.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "p"))), lambda x: x["p"]), RULE).alias("joined"))
    out = questions.join(all_of, "query_id", "left")
    return out.select("query_id", F.concat(F.lit("Passages:\n\n"), F.coalesce("joined", F.lit("")), F.lit(RULE), F.lit("Question: "), F.col("text")).alias("prompt"))


def cited_markers(answer: Column, n_passages: Column) -> Column:
    """The numbers of passages that an answer cites as [n], ascending, each once; numbers without a passage are dropped."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(r"\[([0-9]{1,2})\]"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda m: (m >= 1) & (m <= n_passages))))


def resolve_citations(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """A row for each passage that an answer cites: the passage's columns and marker. answers: query_id, answer."""
    n = passages.groupBy("query_id").agg(F.max("position").alias("_n"))
    marked = answers.join(n, "query_id").select("query_id", F.explode(cited_markers(F.col("answer"), F.col("_n"))).alias("marker"))
    p = passages.withColumnRenamed("query_id", "_q")
    return marked.join(p, (F.col("query_id") == F.col("_q")) & (F.col("marker") == F.col("position"))).drop("_q", "position")


def snippet(text: Column, most: int = SNIPPET) -> Column:
    """The text, trimmed; a long one is cut at the last space of its first characters."""
    inside = strip(text)
    head = F.substring(inside, 1, most)
    cut = F.when(head.contains(" "), F.regexp_replace(head, r"(?s) [^ ]*$", "")).otherwise(head)
    return F.when(F.length(inside) > most, F.concat(cut, F.lit("…"))).otherwise(inside)


def extractive_answers(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, answer): what is answered without a model: the passages, numbered, or a sentence that there are none."""
    one = passages.select("query_id", "position", F.concat(F.format_string("**[%d] %s**\n", "position", "document_name"), snippet(F.col("text")), F.lit("\n")).alias("p"))
    all_of = one.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "p"))), lambda x: x["p"]), "\n").alias("joined"))
    out = questions.join(all_of, "query_id", "left")
    return out.select("query_id", F.coalesce(F.concat(F.lit(f"_{NO_MODEL}_\n\n"), F.col("joined")), F.lit(NOTHING_FOUND)).alias("answer"))


def answer_frames(answers: DataFrame) -> DataFrame:
    """(query_id, seq, event): the order in which an answer's parts are sent."""
    events = F.array(*[F.lit(x) for x in ("passages", "delta", "citations", "usage", "done")])
    return answers.select("query_id", F.posexplode(events).alias("seq", "event"))


def usage_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage (model, input_tokens, output_tokens, ...) with priced and cost_usd; models without a price cost 0."""
    out = usage.join(prices.select(F.col("model").alias("_m"), "rate_in", "rate_out"), F.col("model") == F.col("_m"), "left")
    cost = (F.col("input_tokens") * F.col("rate_in") + F.col("output_tokens") * F.col("rate_out")) / 1_000_000
    return out.select(*usage.columns, F.col("_m").isNotNull().alias("priced"), F.coalesce(cost, F.lit(0.0)).alias("cost_usd"))


def price_table(spark: SparkSession, rows: list[tuple[str, float, float]]) -> DataFrame:
    return spark.createDataFrame(rows, PRICES)


def strategy_of(model: Column, prefix: str, default: str = "layout") -> Column:
    """struct(strategy, error) of a requested model name: the prefix alone, or the prefix, a hyphen and a strategy."""
    rest = F.substring(model, len(prefix) + 2, 1000)
    plain = model.isNull() | (model == "") | (model == prefix)
    strategy = F.when(plain, F.lit(default)).when(model.startswith(f"{prefix}-") & rest.isin(*STRATEGIES), rest)
    return F.struct(strategy.alias("strategy"), F.when(strategy.isNull(), F.concat(F.lit("model not found: "), model)).alias("error"))


def flat_content(parts: Column) -> Column:
    """The text parts of a message's content, array<struct<type, text>>, on lines of their own."""
    return F.array_join(F.transform(F.filter(parts, lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"]), "\n")


def last_user_turns(messages: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, query): the last message of a conversation's user that has a text; conversations without one have no row."""
    asked = messages.where((F.col("role") == "user") & ~is_blank(F.col("text")))
    return asked.groupBy(key).agg(F.max_by("text", F.struct(order, "text")).alias("query"))


def citation_payload(passages: DataFrame) -> DataFrame:
    """Passages as they go out with an answer, without ids and scores that mean nothing outside."""
    return passages.drop("chunk_id", "id", "score", "ranks", "contributions", "n_retrievers")
