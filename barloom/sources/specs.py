"""Feature specs, the indicator catalog, reports and ledgers as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEDGER = T.StructType.fromJson(
    {"type": "struct", "fields": [{"name": n, "type": t, "nullable": True, "metadata": {}} for n, t in (
        ("transaction_id", "long"), ("time_UTC", "timestamp"), ("ticker", "string"), ("current_price", "double"), ("transaction_type", "string"), ("quantity", "integer"), ("order_type", "string"),
        ("parent_id", "long"), ("child_tp_price", "double"), ("child_tp_id", "long"), ("child_sl_price", "double"), ("child_sl_id", "long"), ("child_maturity_id", "long"), ("child_maturity_UTC", "timestamp"))]}
)


def parse_specs(specs: DataFrame, column: str = "spec") -> DataFrame:
    """spec, ticker, function, params (a map of the other keys) and error of spec texts such as ``ticker=A&function=SMA&time_period=15``.

    A spec without a function, or with a period that is no whole number, has an error text; of a key that is given twice the
    last value counts. Null specs go.
    """
    pairs = F.filter(F.transform(F.split(column, "&"), lambda x: F.split(x, "=", 2)), lambda x: F.size(x) == 2)
    reverse = F.reverse(pairs)
    last = F.filter(reverse, lambda x, i: ~F.exists(F.slice(reverse, 1, i), lambda y: y[0] == x[0]))
    every = F.map_from_entries(F.transform(last, lambda x: F.struct(x[0], x[1])))
    rows = specs.where(F.col(column).isNotNull()).select(F.col(column).alias("spec"), every.alias("m"))
    params = F.map_filter("m", lambda k, v: ~k.isin("ticker", "function"))
    broken = F.exists(F.map_entries("params"), lambda e: e["key"].contains("period") & ~e["value"].rlike("^[0-9]+$"))
    found = rows.select("spec", F.try_element_at("m", F.lit("ticker")).alias("ticker"), F.try_element_at("m", F.lit("function")).alias("function"), params.alias("params"))
    return found.withColumn("error", F.when(F.col("function").isNull(), "no function").when(broken, "a period is no whole number"))


def typed(params: dict[str, str]) -> dict[str, object]:
    """Keys with 'period' as int, other numbers as float, the rest as text."""
    out: dict[str, object] = {}
    for k, v in params.items():
        try:
            out[k] = int(v) if "period" in k else float(v)
        except ValueError:
            if "period" in k:
                raise ValueError(f"{k} must be a whole number, not {v!r}") from None
            out[k] = v
    return out


def indicator_catalog(spark: SparkSession, requests: str, outputs: str) -> DataFrame:
    """function, request (a map of texts) and outputs (an array) of two JSON files: an object of request objects, and one of output names.

    A function in one file only has null in the other's column; a single name counts as an array of one.
    """
    whole = lambda path: spark.read.text(path, wholetext=True)
    asked = whole(requests).select(F.explode(F.from_json("value", "MAP<STRING, MAP<STRING, STRING>>")).alias("function", "request"))
    named = whole(outputs).select(F.explode(F.from_json("value", "MAP<STRING, STRING>")).alias("function", "text"))
    names = F.coalesce(F.from_json("text", "ARRAY<STRING>"), F.array("text"))
    return asked.join(named.select("function", names.alias("outputs")), "function", "full")


def report(spark: SparkSession, path: str) -> DataFrame:
    """A configuration or report file: one JSON object over many lines as one row."""
    return spark.read.json(path, multiLine=True)


def append_ledger(transactions: DataFrame, path: str) -> None:
    transactions.select(*[F.col(f.name).cast(f.dataType) for f in LEDGER.fields]).write.mode("append").csv(path, header=True, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=LEDGER, timestampFormat="yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX")
