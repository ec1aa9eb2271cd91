from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewren.llm.common import documents
from sedgewren.llm.kneser_ney import score, train
from sedgewren.llm.labelled import fold

FOLDS, HELD_OUT = 5, 1


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs.where(fold("doc_id", FOLDS) != HELD_OUT))
    scored = score(docs, model)
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return scored.select(
        "doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"), F.round(perplexity, 3).alias("perplexity"),
    )  # fmt: skip


QUERIES = {"op7_lm_scoring": op7_lm_scoring}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _discounts(counts: str) -> str:
    """One row d: no discount, D1, D2 and D3+ of modified Kneser-Ney from a table with the counts n."""
    return f"""(SELECT CASE WHEN least(n1, n2, n3, n4) = 0 THEN [0, 0.5, 0.5, 0.5]::DOUBLE[] ELSE [0,
        least(greatest(1 - 2 * y * n2 / n1, 0), 1), least(greatest(2 - 3 * y * n3 / n2, 0), 2), least(greatest(3 - 4 * y * n4 / n3, 0), 3)]::DOUBLE[] END AS d
      FROM (SELECT *, n1::DOUBLE / (n1 + 2 * n2) AS y FROM (SELECT count(*) FILTER (n = 1) AS n1, count(*) FILTER (n = 2) AS n2, count(*) FILTER (n = 3) AS n3, count(*) FILTER (n = 4) AS n4 FROM {counts})))"""


#: A space stands for the end of a text, two for its start: no word holds one.
SCORING_SQL = rf"""
    WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS table_),
    ids AS (SELECT row_number() OVER () AS r, doc_id, list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes,
                   regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^ 	-]+') AS w FROM documents),
    d AS (SELECT r, doc_id, w, coalesce(xor(list_reduce(bytes, lambda c, x: xor(c >> 8, table_[(xor(c, x) & 255) + 1]), 4294967295), 4294967295)::BIGINT % {FOLDS} = {HELD_OUT}, false) AS held_out FROM ids, crc),
    t AS (SELECT r, held_out, unnest(list_prepend('  ', w)) AS u, unnest(list_append(w, ' ')) AS v FROM d),
    words AS (SELECT v, count(*) AS n FROM t WHERE NOT held_out GROUP BY v),
    total AS (SELECT coalesce(sum(n), 0)::BIGINT AS n, count(*) AS v FROM words),
    pairs AS (SELECT u, v, count(*) AS n FROM t WHERE NOT held_out GROUP BY ALL),
    before AS (SELECT v, count(*) AS n FROM pairs GROUP BY v),
    d1 AS {_discounts("pairs")}, d0 AS {_discounts("before")},
    types AS (SELECT count(*) AS types FROM pairs),
    spread AS (SELECT sum(d[least(n, 3) + 1]) / max(types) AS spread FROM before, d0, types),
    contexts AS (SELECT u, sum(n) AS total, sum(d[least(n, 3) + 1]) AS freed FROM pairs, d1 GROUP BY u),
    each AS (
      SELECT t.r, coalesce(words.n, 0) AS c, coalesce(pairs.n, 0) AS n, contexts.total, contexts.freed, (coalesce(before.n, 0) - d0.d[least(coalesce(before.n, 0), 3) + 1]) / types + spread / (total.v + 1) AS lower, total.n AS tokens, total.v AS vocabulary
      FROM t LEFT JOIN words USING (v) LEFT JOIN pairs ON t.u = pairs.u AND t.v = pairs.v LEFT JOIN before ON t.v = before.v LEFT JOIN contexts ON t.u = contexts.u, d0, types, spread, total),
    scored AS (
      SELECT r, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, max(tokens) AS train_tokens, sum(log10((c + 0.5::DOUBLE) / (tokens + 0.5::DOUBLE * (vocabulary + 1)))) AS base_score,
             sum(log10(CASE WHEN total IS NULL THEN lower ELSE (n - d1.d[least(n, 3) + 1]) / total + freed / total * lower END)) AS score
      FROM each, d1 GROUP BY r)
    SELECT doc_id, held_out, n_tokens, n_known, train_tokens, round(base_score, 6) AS base_score, round(score, 6) AS score, round(pow(10, -score / n_tokens), 3) AS perplexity FROM d JOIN scored USING (r)"""

ORACLES = {"op7_lm_scoring": SCORING_SQL}
