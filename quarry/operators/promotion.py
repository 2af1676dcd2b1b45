"""Conjecture records from several searches, their promotion, archives by behaviour, and what identifies a population.

Candidate rows have an expression, R2, r and a description length (mdl); extrapolation and stability may be unknown.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.numeric import finite
from quarry.operators.candidates import merged_top, rank_key
from quarry.sources.steps import written

RECORD = ["source", "expression", "target", "r2", "r", "mdl", "level", "extrapolation", "stability"]
#: What a symbolic method adds to the length of its result; other methods add 1.5.
METHOD_PENALTY = {"polynomial_fallback": 0.0, "physics_templates": 0.5, "native_gp": 1.0, "pysr": 1.5, "operon": 1.5, "ai_feynman": 0.5}


def optional(hits: DataFrame, name: str) -> Column:
    return F.col(name).cast("double") if name in hits.columns else F.lit(None).cast("double")


def record(hits: DataFrame, source: str, target: str, expression: Column, r2: Column, r: Column, mdl: Column) -> DataFrame:
    level = F.when(r2 >= 0.75, 1).otherwise(0)
    return hits.select(
        F.lit(source).alias("source"), expression.alias("expression"), F.lit(target).alias("target"), r2.cast("double").alias("r2"), r.cast("double").alias("r"),
        mdl.cast("double").alias("mdl"), level.alias("level"), optional(hits, "extrapolation").alias("extrapolation"), optional(hits, "stability").alias("stability"),
    )


def metric_records(scores: DataFrame, target: str) -> DataFrame:
    """Records of scored candidates (candidate, mdl, r, r2)."""
    return record(scores, "metric_dsl", target, F.col("candidate"), F.col("r2"), F.col("r"), F.col("mdl"))


def symbolic_records(hits: DataFrame, target: str) -> DataFrame:
    """Records of symbolic fits (equation, method, terms, r2, r): r is the root of R2 where it is not finite; terms are counted by
    the signs of addition where they are not given; the length is terms, the method's penalty and a hundredth of the text."""
    penalty = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in METHOD_PENALTY.items() for v in kv]), F.col("method")), F.lit(1.5))
    signs = F.length("equation") - F.length(F.replace("equation", F.lit("+"), F.lit("")))
    terms = F.when(F.col("terms") > 0, F.col("terms")).otherwise(signs + 1)
    r = F.coalesce(finite(F.col("r")), F.sqrt(F.greatest("r2", F.lit(0.0))))
    return record(hits, "symbolic", target, F.col("equation"), F.col("r2"), r, terms + penalty + F.length("equation") * 0.01)


def latent_records(hits: DataFrame, target: str) -> DataFrame:
    """Records of interpreted latent columns (latent_column, equation, r2, main_target_correlation)."""
    text = F.concat(F.coalesce("latent_column", F.lit("latent")), F.lit(" ≈ "), F.coalesce("equation", F.lit("")))
    return record(hits, "latent_interpretation", target, text, F.col("r2"), F.col("main_target_correlation"), F.length(F.coalesce("equation", F.lit(""))) * 0.05 + 3.0)


def program_records(hits: DataFrame, target: str) -> DataFrame:
    """Records of searched programs (expression, fitness, r): the fitness stands for R2."""
    return record(hits, "gp", target, F.col("expression"), F.col("fitness"), F.col("r"), F.length("expression") * 0.05 + 2.0)


def promoted(records: DataFrame, most: int = 10, least_r2: float = 0.5) -> DataFrame:
    """The best records of at least that R2: of each source and expression one, by extrapolation, stability, R2, the shortest and
    |r|. An unknown R2 counts as 0."""
    named = records.withColumn("candidate", F.col("expression"))
    able = named.where(F.coalesce("r2", F.lit(0.0)) >= least_r2)
    return merged_top(able, ["source", "expression"], rank_key(named), most).drop("candidate")


def rejected(records: DataFrame, least_r2: float = 0.5) -> DataFrame:
    """Records below that R2, with the reason."""
    low = records.where(F.coalesce("r2", F.lit(0.0)) < least_r2)
    return low.withColumn("rejection_reason", F.lit("below_min_r_squared")).withColumn("min_r_squared", F.lit(least_r2))


def write_records(records: DataFrame, path: str) -> None:
    """Records as lines of JSON, in the order of promotion: `most` rows, as promoted() gives them."""
    records.coalesce(1).write.mode("error").json(path)


def elite_archive(rows: DataFrame, behaviour: dict[str, float], fitness: str, name: str, by: list[str] = ()) -> DataFrame:
    """(by..., bucket_<column>..., best, fitness): the fittest row of each bucket of behaviour, a bucket being so wide in each
    column; ties to the smallest name. Rows without a finite behaviour or fitness are in no bucket."""
    buckets = {f"bucket_{c}": F.floor(finite(F.col(c)) / width) for c, width in behaviour.items()}
    held = rows.withColumns(buckets | {"_fit": finite(F.col(fitness))}).dropna(subset=[*buckets, "_fit"])
    best = F.min(F.struct((-F.col("_fit")).alias("f"), F.col(name).alias("name"))).alias("e")
    return held.groupBy(*by, *buckets).agg(best).select(*by, *buckets, F.col("e.name").alias("best"), (-F.col("e.f")).alias("fitness"))


#: Zero terms of an expression's text, added ones and others.
ADDED_ZERO, OTHER_ZERO = r"\+0(\.0+)?(?=[+\-*)/]|$)", r"(?<=[+\-*/(])0(\.0+)?(?=[+\-*)/]|$)"


def canonical(expression: Column) -> Column:
    """A text form for comparison across runs: lower case, no blanks, ^ for powers, no zero terms; `empty` if nothing is left."""
    s = F.regexp_replace(F.lower(expression), r"\s+", "")
    s = F.replace(s, F.lit("**"), F.lit("^"))
    s = F.regexp_replace(F.regexp_replace(s, ADDED_ZERO, ""), OTHER_ZERO, "")
    return F.when(s == "", "empty").otherwise(s)


def forms(rows: DataFrame, expression: str, first: str) -> DataFrame:
    """(form, n, first): canonical forms, how many rows have each, and the smallest name among them."""
    return rows.groupBy(canonical(F.col(expression)).alias("form")).agg(F.count("*").alias("n"), F.min(first).alias("first"))


def population(rows: DataFrame, target: str) -> DataFrame:
    """(rows, columns, mark): what identifies the rows that results were computed on, whatever their order: their number, a digest
    of the sorted column names and the target's, and the sum of 60-bit digests of the target's values (null has one of its own)."""
    names = hashlib.sha256("\x1f".join([target, *sorted(rows.columns)]).encode()).hexdigest()
    digest = F.conv(F.substring(F.sha2(F.coalesce(F.concat(F.lit("="), F.col(target).cast("string")), F.lit("")), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(digest), F.lit(0)).cast("string").alias("mark")).select("rows", F.lit(names).alias("columns"), "mark")


def stability_summary(report: DataFrame, top: int = 20, strong: float = 0.5, held: float = 0.75) -> DataFrame:
    """(median_stability, stable) of a report's first rows: stable if three quarters of the strong columns keep their sign."""
    first = report.where(F.col("place") <= top)
    many = F.count(F.when(F.abs("r") >= strong, 1))
    good = F.count(F.when((F.abs("r") >= strong) & (F.col("stability") >= held), 1))
    return first.agg(F.median("stability").alias("median_stability"), ((good >= 0.75 * many) & (many > 0)).alias("stable"))


def cluster_separation(rows: DataFrame, cluster: Column, target: str, least: float = 0.75) -> DataFrame:
    """(separation, separated): the widest gap between the clusters' means in standard deviations of all rows."""
    y = finite(F.col(target))
    per = rows.groupBy(cluster.alias("cluster")).agg(F.avg(y).alias("m"), F.count(y).alias("n"), F.var_pop(y).alias("v")).where("n > 0")
    n, m = F.col("n"), F.col("m")
    spread = F.sqrt(F.sum(n * (F.col("v") + m * m)) / F.sum(n) - F.pow(F.sum(n * m) / F.sum(n), 2))
    gap = (F.max("m") - F.min("m")) / F.nullif(spread, F.lit(0.0))
    return per.agg(gap.alias("separation"), F.coalesce(gap >= least, F.lit(False)).alias("separated"))


def fragments(rows: DataFrame, expression: str, least: int = 2) -> DataFrame:
    """(fragment, count): names that recur in expressions, operations of arithmetic aside, most frequent first."""
    tokens = rows.select(F.explode(F.regexp_extract_all(F.col(expression), F.lit(r"[a-zA-Z_][\w.]*"), 0)).alias("fragment"))
    counts = tokens.where(~F.col("fragment").isin("add", "sub", "mul", "div")).groupBy("fragment").agg(F.count("*").alias("count"))
    return counts.where(F.col("count") >= least).orderBy(F.desc("count"), "fragment")


def rediscovery(seeds: DataFrame, seed: str, expression: str, fitness: str) -> DataFrame:
    """(form, seeds, share, best): canonical forms by the share of seeds that found them, and their best fitness."""
    found = written(seeds.select(F.col(seed).alias("seed"), canonical(F.col(expression)).alias("form"), F.col(fitness).alias("fitness")), "forms")
    all_seeds = found.agg(F.countDistinct("seed").alias("all"))  # one row
    per = found.groupBy("form").agg(F.countDistinct("seed").alias("seeds"), F.max("fitness").alias("best"))
    return per.join(F.broadcast(all_seeds), on=F.lit(True)).select("form", "seeds", (F.col("seeds") / F.col("all")).alias("share"), "best")
