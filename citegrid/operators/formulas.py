"""User-defined metrics (UD1-UD7): arithmetic expressions compiled to columns."""

from __future__ import annotations

import ast
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrid.functions.columns import finite
from citegrid.operators import indices, ranking, stats

MOST, LONGEST = 20, 500
BASE_FIELDS = (*indices.METRICS, "mean_authors_per_work", "share_single_authored", "n_flagged_works", "n_truncated_works")


@dataclass(frozen=True)
class Metric:
    id: str
    expression: str
    label: str = ""


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _divide(a: Column, b: Column) -> Column:
    return _zero(F.try_divide(a, b))


def _modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor; 0 for a divisor of 0."""
    return F.when(b == 0, 0.0).otherwise(a - b * F.floor(F.try_divide(a, b)))


#: Names a formula may call; invalid arguments give null, which counts as 0.
FUNCTIONS = {
    "abs": F.abs,
    "min": lambda *a: F.least(*a) if len(a) > 1 else a[0],
    "max": lambda *a: F.greatest(*a) if len(a) > 1 else a[0],
    "sqrt": lambda a: F.when(a >= 0, F.sqrt(a)),
    "log": lambda a: F.when(a > 0, F.log(a)),
    "log1p": lambda a: F.when(a > -1, F.log1p(a)),
    "exp": F.exp,
    "pow": F.pow,
    "round": lambda a, *d: F.bround(a, *(int(x) for x in d)),
    "floor": lambda a: F.floor(a).cast("double"),
    "ceil": lambda a: F.ceil(a).cast("double"),
}
CONSTANTS = {"pi": F.pi, "e": F.e}
OPERATORS = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: _divide, ast.Mod: _modulo, ast.Pow: F.pow}


def metric_id(raw: str, number: int = 1) -> str:
    """``custom_`` and the letters, digits and underscores of a name."""
    name = re.sub(r"[^a-z0-9_]+", "_", raw.strip().lower()).strip("_")
    name = name.removeprefix("custom_")
    return f"custom_{name or number}"


def names_in(expression: str) -> set[str]:
    """Fields that a formula reads (UD4), ``pr_`` ones with the prefix."""
    tree = ast.parse(expression, mode="eval")
    called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    return {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and n.id not in CONSTANTS and n.id not in FUNCTIONS and id(n) not in called}


def compile_formula(expression: str, fields: dict[str, Column]) -> Column:
    """The formula as a column; only arithmetic, the listed functions, fields and constants are allowed."""
    if len(expression) > LONGEST:
        raise ValueError("the formula is too long")
    try:
        tree = ast.parse(expression, mode="eval").body
    except SyntaxError as e:
        raise ValueError(f"not a formula: {expression}") from e

    def build(node: ast.expr) -> Column:
        match node:
            case ast.Constant(value=bool()):
                raise ValueError("truth values are not allowed")
            case ast.Constant(value=int() | float() as v):
                return F.lit(float(v))
            case ast.Name(id=name) if name in CONSTANTS:
                return CONSTANTS[name]()
            case ast.Name(id=name) if name in fields:
                return fields[name]
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -build(x)
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return build(x)
            case ast.BinOp(left=a, op=op, right=b) if type(op) in OPERATORS:
                return OPERATORS[type(op)](build(a), build(b))
            case ast.Call(func=ast.Name(id="round"), args=[x, ast.Constant(value=int() as d)], keywords=[]):
                return F.bround(build(x), d)
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in FUNCTIONS and args:
                return FUNCTIONS[name](*map(build, args))
        raise ValueError(f"not allowed in a formula: {ast.unparse(node)}")

    return finite(build(tree))


def parse_metrics(raw: Sequence[dict[str, str]]) -> list[Metric]:
    """Checked definitions (UD1): at most MOST, unique ids, expressions that compile."""
    if len(raw) > MOST:
        raise ValueError(f"at most {MOST} metrics")
    out: list[Metric] = []
    for i, d in enumerate(raw, 1):
        m = Metric(metric_id(d.get("id") or d.get("label") or "", i), d.get("expression", "").strip(), d.get("label", ""))
        if m.id in {x.id for x in out}:
            raise ValueError(f"metric {m.id} is defined twice")
        allowed = {n: F.lit(0.0) for f in BASE_FIELDS for n in (f, f"pr_{f}")}
        compile_formula(m.expression, allowed)
        out.append(m)
    return out


def with_metrics(rows: DataFrame, metrics: Sequence[Metric]) -> DataFrame:
    """``rows`` with a column for each metric (UD2); percentile inputs are made first, by run and mode where
    the table has them (UD3). A missing field is 0."""
    used = {n for m in metrics for n in names_in(m.expression)}
    scope = [c for c in indices.SCOPE if c in rows.columns]
    ranks = {n.removeprefix("pr_"): f"_{n}" for n in used if n.startswith("pr_") and n.removeprefix("pr_") in rows.columns}
    df = indices.percentile_rank(rows, ranks, scope) if scope else indices.percentile_rank(rows.withColumn("_all", F.lit(1)), ranks, ["_all"]).drop("_all")
    fields = {}
    for n in used:
        base = n.removeprefix("pr_")
        if base not in BASE_FIELDS:
            raise ValueError(f"unknown field: {n}")
        fields[n] = F.col(f"_{n}") if n.startswith("pr_") and base in rows.columns else F.coalesce(F.col(base).cast("double"), F.lit(0.0)) if n in rows.columns else F.lit(0.0)
    return df.withColumns({m.id: compile_formula(m.expression, fields) for m in metrics}).drop(*ranks.values()) if metrics else df


def resolve_template(template: str, parameters: dict[str, float]) -> str:
    """A formula template with its parameters put in (UD5)."""
    return re.sub(r"\{(\w+)\}", lambda m: repr(float(parameters[m[1]])), template)


def validate(rows: DataFrame, metric: Metric, against: Sequence[str] = ("p", "c", "c_frac", "h", "g", "i10"), top_n: int = 20) -> DataFrame:
    """How a formula's ranking compares with known metrics (UD6): Spearman of unique ranks, the shared part of the
    first ``top_n`` authors, tie rate, correlation with the number of co-authors, and warnings."""
    from citegrid.operators.resampling import ordinal_ranks

    names = [metric.id, *against]
    df = with_metrics(rows, [metric])
    wide = ordinal_ranks(df, names).groupBy("author_id").pivot("metric", names).agg(F.first("rank"))
    mine = F.col(metric.id)
    each = [F.struct(F.lit(m).alias("compared_with"), F.corr(mine, m).alias("spearman"), F.count_if((mine <= top_n) & (F.col(m) <= top_n)).alias("top_overlap")).alias(f"s{i}") for i, m in enumerate(against)]
    out = wide.agg(F.count(F.lit(1)).alias("n_authors"), *each)
    out = out.select("n_authors", F.explode(F.array(*(f"s{i}" for i in range(len(against))))).alias("s")).select("n_authors", "s.*")
    kinds = df.groupBy(F.round(metric.id, 12).alias("v")).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n"))
    tie = kinds.select((1 - F.try_divide("kinds", "n")).alias("tie_rate"))
    authors = df.agg(F.corr(F.coalesce(F.col(metric.id), F.lit(0.0)), F.coalesce("mean_authors_per_work", F.lit(0.0))).alias("coauthorship_score_correlation")) if "mean_authors_per_work" in df.columns else df.agg(F.lit(None).cast("double").alias("coauthorship_score_correlation"))
    out = out.crossJoin(F.broadcast(tie)).crossJoin(F.broadcast(authors))  # one row each
    warning = F.when(F.col("tie_rate") > 0.5, "high_tie_rate").when(F.col("spearman") > 0.98, "duplicates_core_metric")
    rate = F.try_divide("top_overlap", F.least(F.lit(top_n), F.col("n_authors")))
    return out.select(F.lit(metric.id).alias("metric"), "compared_with", "n_authors", "spearman", "top_overlap", rate.alias("top_overlap_rate"), "tie_rate", "coauthorship_score_correlation", warning.alias("warning"))


def validation(rows: DataFrame, metric: Metric, top_n: int = 20) -> dict[str, DataFrame]:
    """The whole report on a formula (UD6): comparison, distribution, readiness for charts, and its first authors."""
    df = with_metrics(rows, [metric])
    long = stats.to_long(df, [metric.id])
    return {"comparison": validate(rows, metric, top_n=top_n), "distribution": stats.distribution(long), "readiness": stats.readiness(long), "ranking_preview": ranking.metric_ranking(df, metric.id, top_n)}


def save_metric(saved: DataFrame, new: DataFrame) -> DataFrame:
    """Saved formulas with one added or replaced (UD7); the first creation time stays, the last text wins."""
    both = saved.unionByName(new)
    return both.groupBy("run_id", "metric_id").agg(
        F.max_by("expression", "updated_at").alias("expression"), F.max_by("enabled", "updated_at").alias("enabled"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at")
    )


def list_metrics(saved: DataFrame, run_id: str) -> DataFrame:
    return saved.filter(F.col("run_id") == run_id).orderBy(F.desc("updated_at"), "metric_id")


def delete_metric(saved: DataFrame, run_id: str, name: str) -> DataFrame:
    return saved.filter(~((F.col("run_id") == run_id) & (F.col("metric_id") == name)))


def enabled_metrics(saved: DataFrame, run_id: str) -> DataFrame:
    return list_metrics(saved, run_id).filter("enabled")
