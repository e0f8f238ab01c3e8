"""Model-backed extraction: pluggable client, result cache, bounded fan-out under a budget, and native reply parsing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalar import approx_input_tokens, approx_output_tokens, cache_key, extract_json, strip_frontmatter
from graphloom.model import Graph, graph
from graphloom.plans.rank import running_before

REPLY = "entities array<struct<id:string, type:string, label:string>>, relations array<struct<source:string, target:string, type:string>>, hyperedges array<struct<members:array<string>, type:string>>"


@dataclass(frozen=True)
class Reply:
    """What a client returns for one prompt."""

    text: str
    input_tokens: int = 0
    output_tokens: int = 0
    usd: float = 0.0


Client = Callable[[str], Reply]


def parse_replies(replies: DataFrame) -> Graph:
    """Graph of model replies (path, reply): a module per path that mentions its entities, relations and hyperedges.

    Replies without a JSON object give nothing; entities without id or label, relations without an end, and hyperedges
    of fewer than three named members are left out.
    """
    parsed = replies.where("path is not null").select("path", F.from_json(extract_json("reply"), REPLY).alias("r")).where("r is not null")
    module = F.concat(F.lit("doc:module:"), F.col("path"))
    entity = lambda c: F.concat(F.lit("doc:entity:"), F.col("path"), F.lit(":"), c)
    modules = parsed.select(module.alias("id"), F.col("path").alias("label"), F.col("path").alias("sourcefile"), F.lit("document").alias("filetype"))
    found = parsed.select("path", F.explode("r.entities").alias("e")).where("e.id <> '' and e.label <> ''")
    entities = found.select(entity(F.col("e.id")).alias("id"), F.col("e.label").alias("label"), F.col("path").alias("sourcefile"), F.lit("document").alias("filetype"))
    nodes = modules.unionByName(entities).groupBy("id").agg(F.min(F.struct("label", "sourcefile", "filetype")).alias("m")).select("id", "m.*")
    mentions = found.select(module.alias("source"), entity(F.col("e.id")).alias("target"), F.lit("mentions").alias("relation"))
    named = lambda c, otherwise: F.when(F.coalesce(c, F.lit("")) == "", otherwise).otherwise(c)
    rel = parsed.select("path", F.explode("r.relations").alias("e")).where("e.source <> '' and e.target <> ''")
    relations = rel.select(entity(F.col("e.source")).alias("source"), entity(F.col("e.target")).alias("target"), named(F.col("e.type"), "relates_to").alias("relation"))
    edges = mentions.unionByName(relations).distinct().withColumn("confidence", F.lit(1))
    hyper = parsed.select("path", F.explode("r.hyperedges").alias("h")).select("path", "h.type", F.filter("h.members", lambda m: m != "").alias("ms")).where("size(ms) >= 3")
    members = F.transform("ms", lambda m: F.concat(F.lit("doc:entity:"), F.col("path"), F.lit(":"), m))
    return graph(nodes, edges, hyper.select(members.alias("members"), named(F.col("type"), "co_occurs").alias("relation"), F.lit(1).alias("confidence")))


def estimates(jobs: DataFrame, size: Column, usd_per_million_in: float = 0.0, usd_per_million_out: float = 0.0) -> DataFrame:
    """Jobs with estimated input and output tokens and cost."""
    out = jobs.withColumn("input_tokens", approx_input_tokens(size)).withColumn("output_tokens", approx_output_tokens("input_tokens"))
    return out.withColumn("usd", (F.col("input_tokens") * usd_per_million_in + F.col("output_tokens") * usd_per_million_out) / 1e6)


def preflight(jobs: DataFrame) -> DataFrame:
    """One row ``jobs, input_tokens, output_tokens, usd``."""
    return jobs.agg(F.count(F.lit(1)).alias("jobs"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("usd").alias("usd"))


def within_budget(jobs: DataFrame, order: str, max_usd: float | None = None, max_tokens: int | None = None) -> DataFrame:
    """Jobs in ``order`` whose predecessors have not used up the budget (the job that passes it still runs)."""
    if max_usd is None and max_tokens is None:
        return jobs
    limits = {"_usd": (max_usd, "usd"), "_tokens": (max_tokens, "input_tokens + output_tokens")}
    used = running_before(jobs, order, {k: v for k, (limit, v) in limits.items() if limit is not None})
    for k, (limit, _) in limits.items():
        if limit is not None:
            used = used.where(F.col(k) < limit).drop(k)
    return used


def prompt_key(text: str | Column, model: str, prompt: str, mode: str = "text") -> Column:
    """Cache key of a document under one model, prompt and mode; front matter does not count in text mode."""
    c = F.col(text) if isinstance(text, str) else text
    return cache_key([F.lit(model), F.lit(prompt), F.lit(mode), strip_frontmatter(c) if mode == "text" else c])


def run_client(jobs: DataFrame, client: Client, fan_out: int = 4) -> DataFrame:
    """``key, path, reply, input_tokens, output_tokens, usd, error`` of ``jobs`` (key, path, prompt), ``fan_out`` at once.

    A failing job yields its error and no reply; the others are not affected.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, path, prompt in zip(pdf["key"], pdf["path"], pdf["prompt"]):
                try:
                    r = client(prompt)
                    rows.append((key, path, r.text, r.input_tokens, r.output_tokens, r.usd, None))
                except Exception as e:
                    rows.append((key, path, None, 0, 0, 0.0, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["key", "path", "reply", "input_tokens", "output_tokens", "usd", "error"])

    schema = "key string, path string, reply string, input_tokens bigint, output_tokens bigint, usd double, error string"
    return jobs.select("key", "path", "prompt").repartition(fan_out).mapInPandas(run, schema)


def extract_cached(jobs: DataFrame, cache: DataFrame, client: Client, fan_out: int = 4) -> tuple[DataFrame, DataFrame]:
    """Replies of all jobs, and the rows to add to the cache. Only jobs whose key is not cached reach the client."""
    known = cache.select("key", F.col("reply").alias("reply")).dropDuplicates(["key"])
    hits = jobs.join(known, "key").select("key", "path", "reply")
    fresh = run_client(jobs.join(known, "key", "left_anti").dropDuplicates(["key"]), client, fan_out)
    made = fresh.where("reply is not null")
    replies = jobs.join(known, "key", "left_anti").select("key", "path").join(made.select("key", "reply"), "key").select("key", "path", "reply")
    return hits.unionByName(replies), made.select("key", "reply")


def hub_prompt(hubs: list[str], override: str | None = None, most: int = 5) -> str:
    """Vocabulary hint for transcription: an override, else the first labels that are not blank."""
    return override if override else ", ".join([h.strip() for h in hubs if h.strip()][:most])
