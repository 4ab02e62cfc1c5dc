"""Encoding with a vocabulary larger than its broadcast part."""

from pyspark.sql import functions as F

from modaweave.operators import tokens
from modaweave.session import cut_lineage


def test_common_tokens_stay_in_their_row(spark):
    """Only tokens outside the broadcast part are shuffled; repeated ids, gaps and unknown tokens keep their rows."""
    rows = [(1, ["a", "b", "a", "rare", "a", "rare"]), (1, ["b", "x"]), (2, []), (3, None), (None, ["a", "rare"])]
    df = spark.createDataFrame(rows, "id bigint, tokens array<string>")
    vocab = cut_lineage(tokens.build_vocab(spark.createDataFrame([("a", 9), ("b", 7), ("rare", 2)], "token string, n bigint")))
    want = [(None, [2, 4], 2), (1, [2, 3, 2, 4, 2, 4], 6), (1, [3, 1], 2), (2, [], 0), (3, [], 0)]
    for most in (500, 4, 0):
        got = tokens.encode(df, "tokens", vocab, broadcast_tokens=most)
        assert sorted([tuple(r) for r in got.collect()], key=lambda r: (r[0] or 0, -r[2])) == want
    plan = tokens.encode(df.select("id", F.array_remove("tokens", "rare").alias("tokens")), "tokens", vocab, broadcast_tokens=4)._jdf.queryExecution().toString()
    assert "posexplode" not in plan.lower()
