"""The expressions as SQL functions of a session."""
from __future__ import annotations

from pyspark.sql import SparkSession

#: Temporary functions over expressions; Spark inlines them, so they need no Python.
SQL_FUNCTIONS = {
    "dot(a array<double>, b array<double>) returns double": "aggregate(zip_with(a, b, (x, y) -> x * y), 0d, (s, x) -> s + x)",
    "l2_norm(a array<double>) returns double": "sqrt(aggregate(a, 0d, (s, x) -> s + x * x))",
    "cosine_sim(a array<double>, b array<double>) returns double": "case when l2_norm(a) * l2_norm(b) = 0 then 0d else dot(a, b) / (l2_norm(a) * l2_norm(b)) end",
    "l2_sq(a array<double>, b array<double>) returns double": "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0d, (s, x) -> s + x)",
    "tokenize(t string) returns array<string>": r"array_remove(split(lower(t), '[^\\p{IsAlphabetic}\\p{N}]+'), '')",
    "slot_layer(flags int) returns int": "shiftright(flags, 8) & 3",
    "slot_flag(flags int, bit int) returns boolean": "(flags & bit) <> 0",
    "whole_days(a timestamp, b timestamp) returns bigint": "floor((unix_micros(b) - unix_micros(a)) / 86400000000)",
    "slug(t string) returns string": r"coalesce(nullif(trim(both '-' from regexp_replace(lower(t), '[^a-z0-9_-]+', '-')), ''), 'default')",
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions and chunk_words (one row a chunk, by a Python UDTF) available; their names."""
    from pyspark.sql.functions import udtf

    names = []
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {head} return {body}")
        names.append(head.split("(")[0])

    @udtf(returnType="at int, chunk string")
    class ChunkWords:
        def eval(self, text: str, words: int):
            parts = (text or "").split()
            for i in range(0, max(len(parts), 1), words):
                yield i // words, " ".join(parts[i : i + words])

    spark.udtf.register("chunk_words", ChunkWords)
    return [*names, "chunk_words"]
