"""Registered queries: task states, latencies, model names and order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hamming, latency, lsh, tasks
from ..storage import kept
from ..streaming import task_states
from . import bindings as B
from .catalog import _as_scores, _doc_simhash, query
from .more import _MODELS, _models

_COMMANDS = ["create", "run", "finish", "fail", "run"]
_CODES = "CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 2 END"


def _commands(spark, d):
    """A user's events as commands to a task, by turns of their ids."""
    e = B.table(spark, d, "events")
    return e.select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), F.element_at(F.lit(_COMMANDS), (F.col("event_id") % 5 + 1).cast("int")).alias("command"))


# A number holds the state (0 none, 1 PENDING, 2 RUNNING, 3 SUCCESS, 4 FAILED), the runs times 10 and the rejected commands times 10^7.
@query(f"""WITH c AS (SELECT user_id AS task_id, list({_CODES} ORDER BY event_id)::BIGINT[] AS c FROM events GROUP BY 1),
f AS (SELECT task_id, list_reduce(list_prepend(0::BIGINT, c), lambda a, x: CASE WHEN x = 1 AND a % 10 = 0 THEN a + 1 WHEN x = 2 AND a % 10 IN (1, 3, 4) THEN a - a % 10 + 12
  WHEN x IN (3, 4) AND a % 10 = 2 THEN a - 2 + x ELSE a + 10000000 END) AS s FROM c)
SELECT task_id, CASE s % 10 WHEN 1 THEN 'PENDING' WHEN 2 THEN 'RUNNING' WHEN 3 THEN 'SUCCESS' WHEN 4 THEN 'FAILED' END AS state, (s // 10 % 1000000)::INT AS run, (s // 10000000)::INT AS rejected FROM f""")
def task_final_states(spark, d):
    return task_states.states(_commands(spark, d))


@query()
def query_latency(spark, d):
    """Rows and milliseconds of single queries, as executed, for two ways of retrieval; five evenly spaced queries each. What they search is coded once, before any is asked."""
    coded, words = kept(B.coded(spark, d), "coded"), kept(_doc_simhash(spark, d), "signatures")
    one = {
        "lsh": (coded, lambda i: lsh.top_k(coded, coded.where(F.col("id") == i), 10, B.BANDS, B.WIDTH)),
        "simhash": (words, lambda i: hamming.nearest(words, words.where(F.col("id") == i).select(F.col("id").alias("q"), "word"), 10)),
    }
    return latency.measured(spark, one, most=5)


@query(f"""WITH {B.SCORED}, {_MODELS} SELECT model, CASE model WHEN 'hamming' THEN 'Sign code' WHEN 'cosine' THEN 'Embedding' ELSE 'Exact match' END AS display_name,
row_number() OVER (ORDER BY CASE model WHEN 'exact' THEN 1 WHEN 'hamming' THEN 2 ELSE 3 END)::INT AS place, f1 FROM models WHERE model IN ('exact', 'cosine')""")
def model_display(spark, d):
    """Two core models with their names, in display order."""
    named = tasks.displayed(_models(spark, d), {"exact": "Exact match", "hamming": "Sign code", "cosine": "Embedding"}, core=["exact", "cosine"])
    return named.select("model", "display_name", "place", "f1")
