"""Models that answer: registered by name, called with batches of prompts; and an answer's frames as they are sent."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from folioscope.operators import answer

#: From prompts to (text, input tokens, output tokens), one for each prompt in order.
Complete = Callable[[list[str]], Sequence[tuple[str, int, int]]]
MODELS: dict[str, Callable[[], Complete]] = {}
REPLY = "text string, input_tokens int, output_tokens int, error string"


def register_model(name: str, make: Callable[[], Complete]) -> None:
    """make() is called once in each Python worker."""
    MODELS[name] = make


def get_model(name: str | None) -> Callable[[], Complete] | None:
    """A registered model; None for no name: answers are extractive then."""
    if not name:
        return None
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}; expected one of {sorted(MODELS)}")
    return MODELS[name]


def complete(prompt: Column, make: Callable[[], Complete], batch: int = 16) -> Column:
    """struct(text, input_tokens, output_tokens, error) of each prompt; a batch that fails gives its message as the error of its rows."""

    @pandas_udf(REPLY)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make()
        for part in parts:
            prompts, out = part.fillna("").tolist(), []
            for k in range(0, len(prompts), batch):
                some = prompts[k : k + batch]
                try:
                    replies = list(model(some))
                    if len(replies) != len(some):
                        raise ValueError(f"the model gave {len(replies)} replies for {len(some)} prompts")
                    out += [(t, int(i), int(o), None) for t, i, o in replies]
                except Exception as e:  # a model's failure is its rows' error, and no other row's
                    out += [(None, 0, 0, f"{type(e).__name__}: {e}")] * len(some)
            yield pd.DataFrame(out, columns=["text", "input_tokens", "output_tokens", "error"])

    return run(prompt)


def answers(questions: DataFrame, passages: DataFrame, model: str | None = None, prices: DataFrame | None = None) -> DataFrame:
    """(query_id, answer, model, input_tokens, output_tokens, cost_usd, error) for each question.

    Without a model, or where it fails, the answer is the extractive one and costs nothing.
    """
    spare = answer.extractive_answers(questions, passages)
    make = get_model(model)
    if make is None:
        return spare.select("query_id", "answer", F.lit(None).cast("string").alias("model"), F.lit(0).alias("input_tokens"), F.lit(0).alias("output_tokens"), F.lit(0.0).alias("cost_usd"), F.lit(None).cast("string").alias("error"))
    got = answer.build_prompts(questions, passages).select("query_id", complete(F.col("prompt"), make).alias("r")).select("query_id", "r.*").withColumn("model", F.lit(model))
    got = answer.usage_cost(got, prices if prices is not None else answer.price_table(questions.sparkSession, []))
    out = got.join(spare, "query_id")
    return out.select("query_id", F.when(F.col("error").isNull(), F.col("text")).otherwise(F.col("answer")).alias("answer"), F.when(F.col("error").isNull(), F.col("model")).alias("model"), "input_tokens", "output_tokens", "cost_usd", "error")


def frames(answered: DataFrame, passages: DataFrame, most: int = 200) -> DataFrame:
    """(query_id, seq, event, data): an answer's parts as they are sent, data as JSON.

    The passages come first, then the answer in pieces of ``most`` characters, the passages it
    cites, what it cost, and the sentinel ``[DONE]``.
    """
    out = answer.citation_payload(passages)
    fields = [c for c in out.columns if c != "query_id"]
    shown = out.groupBy("query_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("position", *[c for c in fields if c != "position"])))).alias("passages"))
    cited = answer.citation_payload(answer.resolve_citations(answered.select("query_id", "answer"), passages))
    cited = cited.groupBy("query_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("marker", *[c for c in cited.columns if c not in ("query_id", "marker")])))).alias("citations"))
    rows = answered.join(shown, "query_id", "left").join(cited, "query_id", "left")
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("answer") - 1) / most).cast("int"))), lambda i: F.struct(F.lit("delta").alias("event"), F.to_json(F.struct(F.col("answer").substr(i * most + 1, F.lit(most)).alias("text"))).alias("data")))
    one = lambda event, data: F.array(F.struct(F.lit(event).alias("event"), data.alias("data")))
    usage = F.to_json(F.struct("model", "input_tokens", "output_tokens", "cost_usd"))
    parts = F.concat(one("passages", F.coalesce("passages", F.lit("[]"))), pieces, one("citations", F.coalesce("citations", F.lit("[]"))), one("usage", usage), one("done", F.lit("[DONE]")))
    return rows.select("query_id", F.posexplode(parts).alias("seq", "p")).select("query_id", "seq", "p.event", "p.data")
