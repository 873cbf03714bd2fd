"""Model output to facts, over DataFrames: Arrow batches in, structs out; failures are rows, not exceptions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.ddl import data_type, schema
from recollect.functions import parsing as P
from recollect.functions import text as X

NS = "namespace"


@F.pandas_udf(schema("subject string, attribute string, value string"))
def general_fact(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([P.general_fact(t or "") for t in text], columns=["subject", "attribute", "value"])


@F.pandas_udf(schema("json string, truncated boolean"))
def isolated_json(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([P.isolated(t or "") for t in text], columns=["json", "truncated"])


@F.pandas_udf(data_type("boolean"))
def ends_early(text: pd.Series) -> pd.Series:
    return pd.Series([P.ends_early(t or "") for t in text])


@F.pandas_udf(data_type("boolean"))
def token_loop(text: pd.Series) -> pd.Series:
    """Two equal neighbouring runs of eight to sixteen words; one pass over the words for each width."""
    return pd.Series([P.token_loop(t or "") for t in text])


@F.pandas_udf(data_type("boolean"))
def loops(text: pd.Series) -> pd.Series:
    return pd.Series([P.loops(t or "") for t in text])


FACT_STRUCT = "kind string, text string, source_turn_id bigint, subject string, attribute string, value string, is_correction boolean"
EXTRACTED = f"namespace string, call_id bigint, facts array<struct<{FACT_STRUCT.replace(', ', ',').replace(' ', ': ')}>>, flags map<string, boolean>, error string"


def extracted(responses: DataFrame, retry: Callable[[str, str, bool], str] | None = None) -> DataFrame:
    """responses (namespace, call_id, raw, turns array of (turn_id, content)) as facts, flags and error by call."""
    names = [f.split()[0] for f in FACT_STRUCT.split(", ")]

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                turns = [(int(t["turn_id"]), t["content"]) for t in (row["turns"] if row["turns"] is not None else [])]
                facts, flags, error = P.extract(row["raw"] or "", turns, retry)
                out.append({NS: row[NS], "call_id": row["call_id"], "facts": [{k: f.get(k) for k in names} for f in facts], "flags": flags, "error": error})
            yield pd.DataFrame(out, columns=[NS, "call_id", "facts", "flags", "error"])

    return responses.select(NS, "call_id", "raw", "turns").mapInPandas(run, EXTRACTED)


def extraction_telemetry(calls: DataFrame, by: list[str] | None = None) -> DataFrame:
    """extracted() rows counted: attempts, failures and how often each flag was set."""
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    flag = lambda n: F.coalesce(F.element_at("flags", F.lit(n)), F.lit(False))
    names = [n for n in P.FLAGS if n != "success"]
    return calls.groupBy(*(by or [])).agg(F.count("*").alias("attempts"), count(~flag("success")).alias("failures"), *[count(flag(n)).alias(n) for n in names])


def kept_first(items: DataFrame) -> DataFrame:
    """items (namespace, place, subject, attribute, raw): of equal slots and of equal items the first."""
    from pyspark.sql import Window as W

    slot = F.when(~X.blank(F.col("subject")) & ~X.blank(F.col("attribute")), F.concat_ws("\u0001", F.lower(F.trim("subject")), F.lower(F.trim("attribute")))).otherwise(F.concat(F.lit("raw:"), F.col("raw")))
    return items.withColumn("rank", F.row_number().over(W.partitionBy(NS, slot).orderBy("place"))).filter("rank = 1").drop("rank")


def repeated_ngrams(texts: DataFrame, n: int = 4, least: int = 3) -> DataFrame:
    """(namespace, gram, times): runs of n words with a key word, longer than 20 characters, that come least times or more."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - n, F.lit(1))), lambda i: F.array_join(F.slice("words", i, n), " "))
    rows = texts.withColumn("words", words).filter(F.size("words") > 12).select(NS, F.explode(grams).alias("gram"))
    return rows.filter((F.length("gram") > 20) & F.col("gram").rlike("subject|value|text")).groupBy(NS, "gram").agg(F.count("*").alias("times")).filter(F.col("times") >= least)


def card(responses: DataFrame) -> DataFrame:
    """responses (namespace, raw) as episode cards: summary and facts as JSON, or an error."""
    body = F.from_json(X.without_fences(F.col("raw")), "struct<facts: array<map<string,string>>, summary: string>")
    ok = body.isNotNull() & body["facts"].isNotNull() & (F.trim(F.coalesce(body["summary"], F.lit(""))) != "")
    return responses.select(NS, F.when(ok, F.trim(body["summary"])).alias("summary"), F.when(ok, F.size(body["facts"])).alias("n_facts"), F.when(~F.coalesce(ok, F.lit(False)), "not a card").alias("error"))

