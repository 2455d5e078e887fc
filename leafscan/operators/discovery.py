"""Entry points (U01-U04): HTTP routes, GraphQL fields and decorated class members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import rulebook as rb
from ..schema import UNITS, conform
from ..sources.files import candidate_rank
from .tokens import unquote


def _unit(kind_rank: int, kind: str, unit_id: list, name: Column, start: Column, end: Column,
          symbol: Column, meta: Column) -> list[Column]:
    c = F.col
    return [
        c("project"),
        F.concat_ws(":", F.lit(kind), c("file_path"), c("n").cast("string")).alias("unit_key"),
        F.concat_ws(":", *unit_id, c("file_path"), start.cast("string")).alias("unit_id"),
        F.struct(
            F.lit(0).alias("grp"), candidate_rank().alias("candidate_rank"), c("file_path").alias("file_path"),
            F.lit(kind_rank).alias("kind_rank"), c("n").alias("start")).alias("unit_ord"),
        F.lit(kind).alias("kind"), name.alias("name"), c("file_path").alias("entry_file"),
        start.alias("entry_start"), end.alias("entry_end"), symbol.cast("string").alias("entry_symbol"),
        meta.cast("map<string,string>").alias("meta"),
    ]


def _meta(**entries: Column) -> Column:
    return F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v)])


def http_units(facts: DataFrame) -> DataFrame:
    """``<receiver>.<method>("path", handler?)``."""
    c = F.col
    path = unquote(c("arg0_text"))
    symbol = F.when(c("arg1_kind") == "identifier", c("arg1_text"))
    handler = F.when(c("arg1_kind").isin("identifier", "member"), c("arg1_text")).otherwise("<inline>")
    calls = facts.filter(
        (c("fact") == "call") & c("name").isin(*rb.HTTP_METHODS) & (c("arg0_kind") == "string"))
    return conform(calls.select(*_unit(
        0, "http", [F.lit("http"), c("name"), path], F.concat_ws(" ", F.upper("name"), path),
        c("line_start"), c("line_end"), symbol, _meta(method=c("name"), path=path, handler=handler))), UNITS)


def graphql_units(facts: DataFrame) -> DataFrame:
    """The plain properties of a ``Query`` or ``Mutation`` map."""
    c = F.col
    field = F.concat_ws(".", "owner", "name")
    props = facts.filter((c("fact") == "prop") & c("owner").isin(*rb.GRAPHQL_TYPES))
    return conform(props.select(*_unit(
        1, "graphql", [F.lit("graphql"), field], field, c("line_start"), c("line_end"), c("symbol"),
        _meta(parentType=c("owner")))), UNITS)


def decorated_members(facts: DataFrame) -> DataFrame:
    """Decorators with the class member they stand on, met in one grouping per member."""
    c = F.col
    is_method = c("fact") == "method"
    rows = facts.filter(c("fact").isin("decorator", "method") & c("parent").isNotNull())
    members = rows.groupBy("project", "file_path", "parent", "member").agg(
        F.first(F.when(is_method, c("name")), ignorenulls=True).alias("method"),
        F.max(F.when(is_method, c("line_end"))).alias("line_end"),
        F.min(F.when(~is_method, c("line_start"))).alias("line_start"),
        F.sort_array(F.collect_list(F.when(~is_method, F.struct("n", "name", "symbol")))).alias("decorators"))
    return members.filter("method IS NOT NULL").select(
        "project", "file_path", "method", "line_start", "line_end", F.inline("decorators"))


def nest_http_units(facts: DataFrame) -> DataFrame:
    """``@Get("path")`` and its siblings on a class member."""
    c = F.col
    path = F.coalesce(c("symbol"), F.lit("/"))
    members = decorated_members(facts).filter(c("name").isin(*rb.HTTP_DECORATORS))
    return conform(members.select(*_unit(
        2, "nest-http", [F.lit("nest-http"), c("name"), path],
        F.concat(F.upper("name"), F.lit(" "), path, F.lit(" ("), c("method"), F.lit(")")),
        c("line_start"), c("line_end"), c("method"), _meta(decorator=c("name"), path=path))), UNITS)


def nest_graphql_units(facts: DataFrame) -> DataFrame:
    """``@Query("name")`` and ``@Mutation("name")`` on a class member."""
    c = F.col
    field = F.concat_ws(".", "name", F.coalesce(F.when(c("symbol") != "", c("symbol")), c("method")))
    members = decorated_members(facts).filter(c("name").isin(*rb.GRAPHQL_TYPES))
    return conform(members.select(*_unit(
        3, "nest-graphql", [F.lit("nest-graphql"), field], field,
        c("line_start"), c("line_end"), c("method"), _meta(decorator=c("name")))), UNITS)


def discovered_units(facts: DataFrame) -> DataFrame:
    """All four kinds; the order within a file is kind, then position."""
    return (
        http_units(facts).unionByName(graphql_units(facts))
        .unionByName(nest_http_units(facts)).unionByName(nest_graphql_units(facts)))
