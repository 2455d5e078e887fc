"""Imports and exports: what the modules of a project pass on to each other (part of J07).

``links_in`` reads them off a file's tokens, inside the lexer's pass. As rows they are a graph: a name in a file stands for a name in another file
or for another name of the same one. ``reached`` follows it from every bound name to the declaration at its end:

* a specifier is the first of its possible files that the collection has; a path alias of the nearest ``tsconfig`` is taken out first;
* files that a file re-exports whole (``export *``) are a closure of pairs with their distance, found by doubling until no pair is new;
* every name then has one successor, and pointers are doubled until each stands at its end. Cycles never arrive and are dropped.

All steps are equi-joins keyed by project, file and name; a cycle costs nothing but its rows. A closure holds a pair only once.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as tx

# --- Fixed values: guesses for a specifier, in the order they are tried; words that begin no plain default export
SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
NO_DEFAULT_NAME = frozenset("function class async new await abstract interface enum".split())
ENDS = frozenset(["", ";", "export", "import", "const", "let", "var", "function", "class", "module", "exports"])
CONFIG = "tsconfig.json"
CONFIG_SCHEMA = "compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>"
# --- End of fixed values ---------------------------------------------------------------------

_OPENING, _CLOSING = frozenset("{(["), frozenset("})]")
# Words that a link begins with.
_LINKING = frozenset(["import", "export", "const", "let", "var", "exports", "module", "require"])

BIND, FORWARD, STAR = "bind", "forward", "star"

# Travels with the lexer that calls it (see there).
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _text(token: str) -> str | None:
    return token[1:-1] if len(token) > 1 and token[0] in "\"'" else None


def _listed(tokens: list[str], at: int, between: str) -> tuple[list[tuple[str, str]], int]:
    """Pairs (name, other name) of ``{ a, b as c }`` or, with ``:``, ``{ a, b: c }`` that opens at ``at``, and the place behind it."""
    out, at, item, depth = [], at + 1, [], 1
    while at < len(tokens):
        t = tokens[at]
        depth += (t in ("{", "(", "[")) - (t in ("}", ")", "]"))
        if depth == 0 or depth == 1 and t == ",":
            item = item[1:] if len(item) in (2, 4) and item[0] == "type" else item
            if len(item) == 1:
                out.append((_text(item[0]) or item[0], _text(item[0]) or item[0]))
            elif len(item) == 3 and item[1] == between:
                out.append((_text(item[0]) or item[0], _text(item[2]) or item[2]))
            item = []
            if depth == 0:
                return out, at + 1
        else:
            item.append(t)
        at += 1
    return out, at


def _from(tokens: list[str], at: int) -> str | None:
    return _text(tokens[at + 1]) if at + 1 < len(tokens) and tokens[at] == "from" else None


def _required(tokens: list[str], at: int) -> str | None:
    return _text(tokens[at + 2]) if tokens[at:at + 2] == ["require", "("] and at + 3 < len(tokens) and tokens[at + 3] == ")" else None


def links_in(tokens: list[str]) -> list[tuple[str, str, str, str]]:
    """(kind, name, specifier, name there) of the top level of a file; a link without a specifier stays in the file."""
    if not any(w in tokens for w in ("import", "export", "require", "exports")):
        return []
    out: list[tuple[str, str, str, str]] = []
    depth, at, n = 0, 0, len(tokens)
    get = lambda k: tokens[k] if k < n else ""
    while at < n:
        t = tokens[at]
        if t in _OPENING:
            depth += 1
        elif t in _CLOSING:
            depth -= 1
        elif depth == 0 and t in _LINKING and (at == 0 or tokens[at - 1] not in (".", "?.")):
            k = at + 1
            if t == "import" and get(k) not in ("(", "."):
                if get(k) == "type" and get(k + 1) not in ("from", ",", "="):
                    k += 1
                default, pairs = None, []
                if get(k)[:1].isalpha() or get(k)[:1] in ("_", "$"):
                    default, k = get(k), k + 1
                    if get(k) == "=" and (spec := _required(tokens, k + 1)):
                        out.append((BIND, default, spec, "default"))
                    k += get(k) == ","
                if get(k) == "{":
                    pairs, k = _listed(tokens, k, "as")
                elif get(k) == "*":
                    k += 3
                if spec := _from(tokens, k):
                    out += [(BIND, own, spec, name) for name, own in [*([("default", default)] if default else []), *pairs]]
                    at = k + 1
            elif t == "export":
                k += get(k) == "type" and get(k + 1) in ("{", "*")
                if get(k) == "{":
                    pairs, k = _listed(tokens, k, "as")
                    spec = _from(tokens, k) or ""
                    out += [(FORWARD, other, spec, name) for name, other in pairs if spec or name != other]
                    at = k - 1 if not spec else k + 1
                elif get(k) == "*":
                    if spec := _from(tokens, k + 1):
                        out.append((STAR, "", spec, ""))
                elif get(k) == "default" and get(k + 1)[:1].isalpha() and get(k + 1) not in NO_DEFAULT_NAME and get(k + 2) in ENDS:
                    out.append((FORWARD, "default", "", get(k + 1)))
            elif t in ("const", "let", "var"):
                pairs = [("default", get(k))]
                if get(k) == "{":
                    pairs, k = _listed(tokens, k, ":")
                else:
                    k += 1
                if get(k) == "=" and (spec := _required(tokens, k + 1)):
                    picked = get(k + 6) if get(k + 5) == "." else None
                    out += [(BIND, own, spec, picked or name) for name, own in pairs if picked is None or len(pairs) == 1]
                    at = k + 4
            elif t == "exports" or t == "module" and tokens[at + 1:at + 3] == [".", "exports"]:
                k = at + (3 if t == "module" else 1)
                whole = get(k) == "=" and t == "module"
                name, k = (get(k + 1), k + 2) if get(k) == "." else ("default", k)
                if whole and get(k + 1) == "{":
                    pairs, _ = _listed(tokens, k + 1, ":")
                    out += [(FORWARD, other, "", own) for other, own in pairs if other != own]
                elif get(k) == "=" and get(k + 1)[:1].isalpha() and get(k + 1) not in NO_DEFAULT_NAME and get(k + 2) in ENDS and name != get(k + 1):
                    out.append((FORWARD, name, "", get(k + 1)))
            elif t == "require" and (spec := _required(tokens, at)) and get(at - 1) == "export":
                out.append((STAR, "", spec, ""))
        at += 1
    return out


def links_of(facts: DataFrame) -> DataFrame:
    """Links as rows (project, file_path, n, kind, name, spec, target)."""
    return facts.filter("fact = 'link'").select("project", "file_path", "n", F.col("owner").alias("kind"), "name", F.col("text").alias("spec"), F.col("symbol").alias("target"))


def path_aliases(configs: DataFrame) -> DataFrame:
    """Patterns (project, folder, head, tail, base) of the ``paths`` of each ``tsconfig``; comments in it are allowed.

    ``*`` cuts a pattern in ``head`` and ``tail`` (null without it), and a target in ``base`` and what is put behind. A base folder alone is the pattern ``*``.
    """
    c = F.col
    parsed = configs.filter(c("file_path").endswith("/" + CONFIG)).select(
        "project", F.regexp_replace("file_path", "/[^/]*$", "").alias("folder"),
        F.from_json("content", CONFIG_SCHEMA, {"allowComments": "true", "mode": "PERMISSIVE"})["compilerOptions"].alias("o"))
    base = tx.join_path(c("folder"), F.concat(F.lit("./"), F.coalesce(c("o.baseUrl"), F.lit("."))))
    named = parsed.select("project", "folder", base.alias("base"), F.explode_outer("o.paths").alias("pattern", "targets"), c("o.baseUrl").isNotNull().alias("based"))
    mapped = named.filter("pattern IS NOT NULL").select("project", "folder", "base", "pattern", F.posexplode("targets").alias("turn", "to"))
    plain = named.filter("based").select("project", "folder", "base", F.lit("*").alias("pattern"), F.lit(1 << 20).alias("turn"), F.lit("*").alias("to")).distinct()
    star = c("pattern").contains("*")
    return mapped.unionByName(plain).select(
        "project", "folder", "turn", F.split_part("pattern", F.lit("*"), F.lit(1)).alias("head"), F.when(star, F.split_part("pattern", F.lit("*"), F.lit(2))).alias("tail"),
        tx.join_path(c("base"), F.concat(F.lit("./"), F.split_part("to", F.lit("*"), F.lit(1)))).alias("to_head"),
        (F.split_part("to", F.lit("*"), F.lit(1)).endswith("/") | (F.split_part("to", F.lit("*"), F.lit(1)) == "")).alias("into"),
        F.when(c("to").contains("*"), F.split_part("to", F.lit("*"), F.lit(2))).alias("to_tail"))


def _ancestors(path: Column) -> Column:
    """All folders above a file, the nearest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def based(links: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """Distinct (project, file_path, spec, turn, base): the path a specifier names, without its ending; by aliases of the nearest config if it is not relative.

    The longest matching pattern wins: each specifier is cut at every place, and its beginnings meet the patterns' heads in an equi-join.
    """
    c = F.col
    specs = links.filter("spec <> ''").select("project", "file_path", "spec").distinct()
    relative = specs.filter(c("spec").startswith("."))
    folder = F.regexp_replace("file_path", "/?[^/]*$", "")
    found = relative.select("project", "file_path", "spec", F.lit(0).alias("turn"), tx.join_path(folder, c("spec")).alias("base"))
    if aliases is None:
        return found
    other = specs.filter(~c("spec").startswith("."))
    near = other.select("project", "file_path").distinct().select("project", "file_path", F.posexplode(_ancestors(c("file_path"))).alias("up", "folder"))
    owner = near.join(aliases.select("project", "folder").distinct(), ["project", "folder"]).groupBy("project", "file_path").agg(F.min(F.struct("up", "folder")).alias("o"))
    cut = other.join(owner.select("project", "file_path", c("o.folder").alias("folder")), ["project", "file_path"]).select(
        "*", F.explode(F.transform(F.sequence(F.lit(0), F.length("spec")), lambda k: F.substring(c("spec"), F.lit(1), k))).alias("head"))
    hit = cut.join(aliases, ["project", "folder", "head"]).filter(
        F.when(c("tail").isNull(), c("head") == c("spec")).otherwise(c("spec").endswith(c("tail")) & (F.length("spec") >= F.length("head") + F.length("tail"))))
    longest = W.partitionBy("project", "file_path", "spec")
    best = hit.withColumn("_most", F.max(F.struct(c("tail").isNull(), F.length("head"))).over(longest)).filter(F.struct(c("tail").isNull(), F.length("head")) == c("_most"))
    middle = F.when(c("tail").isNull() | c("to_tail").isNull(), "").otherwise(F.substring(c("spec"), F.length("head") + 1, F.length("spec") - F.length("head") - F.length("tail")))
    to = F.concat(c("to_head"), F.when(c("into") & (middle != ""), F.lit("/")).otherwise(F.lit("")), middle, F.coalesce(c("to_tail"), F.lit("")))
    return found.unionByName(best.select("project", "file_path", "spec", "turn", to.alias("base")))


def _files_named(bases: DataFrame, files: DataFrame) -> DataFrame:
    """(project, file_path, spec, to_file): the first file of the collection that a specifier can mean."""
    c = F.col
    guesses = F.array(
        *[F.struct(F.lit(i + 1).alias("guess"), F.concat(c("base"), F.lit(x)).alias("to_file")) for i, x in enumerate(SUFFIXES)],
        # A path written with the compiled extension means the TypeScript file.
        F.struct(F.lit(len(SUFFIXES) + 1).alias("guess"), F.regexp_replace("base", r"\.js(x?)$", ".ts$1").alias("to_file")))
    there = bases.select("project", "file_path", "spec", "turn", F.inline(guesses)).join(files.select("project", c("file_path").alias("to_file")), ["project", "to_file"])
    return there.groupBy("project", "file_path", "spec").agg(F.min(F.struct("turn", "guess", "to_file")).alias("t")).select("project", "file_path", "spec", "t.to_file")


def star_closure(stars: DataFrame, settle: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(project, file_path, to_file, far): all files that a file re-exports whole, by doubling until no pair is new or nearer."""
    pairs = settle(stars.groupBy("project", "file_path", "to_file").agg(F.min("far").alias("far")), "stars")
    size = pairs.agg(F.count(F.lit(1)), F.sum("far")).first()
    while True:
        ahead = pairs.select("project", F.col("file_path").alias("to_file"), F.col("to_file").alias("_next"), F.col("far").alias("_more"))
        longer = pairs.join(ahead, ["project", "to_file"]).select("project", "file_path", F.col("_next").alias("to_file"), (F.col("far") + F.col("_more")).alias("far"))
        pairs = settle(pairs.unionByName(longer).filter("file_path <> to_file").groupBy("project", "file_path", "to_file").agg(F.min("far").alias("far")), "stars")
        now = pairs.agg(F.count(F.lit(1)), F.sum("far")).first()
        if tuple(now) == tuple(size):
            return pairs
        size = now


def reached(decls: DataFrame, links: DataFrame, settle: Callable[[DataFrame, str], DataFrame], aliases: DataFrame | None = None) -> DataFrame:
    """(project, file_path, name, to_file, symbol, line) of every name that an import binds, followed to its declaration.

    ``decls``: (project, file_path, lookup, symbol, line). A name of a file is known under two scopes: inside it (``in``), where what is imported
    or required wins over declarations, and outside it (``out``), where forwards win over declarations and these over whole re-exports.
    """
    c, key = F.col, ["project", "file_path", "scope", "name"]
    files = decls.select("project", "file_path").unionByName(links.select("project", "file_path")).distinct()
    meant = settle(_files_named(based(links, aliases), files), "meant")
    out, own = F.lit("out"), F.lit("in")
    ends = decls.select("project", "file_path", c("lookup").alias("name"), "symbol", "line")
    # Top-level names count as exported, whether a statement says so or not.
    ends = ends.withColumn("scope", F.explode(F.array(own, out)))
    named = links.filter(c("kind") != STAR).join(meant, ["project", "file_path", "spec"], "left").filter("spec = '' OR to_file IS NOT NULL")
    first = named.groupBy("project", "file_path", F.when(c("kind") == BIND, own).otherwise(out).alias("scope"), "name").agg(
        F.min(F.struct("n", F.coalesce("to_file", "file_path").alias("file"), F.when(c("spec") == "", own).otherwise(out).alias("in"), "target")).alias("t"))
    edges = first.select(*key, c("t.file").alias("to_file"), c("t.in").alias("to_scope"), c("t.target").alias("to_name"))
    edges = settle(edges, "edges")
    # A declaration whose value is required stands for what it requires, inside and outside.
    required = edges.filter(c("scope") == own).select("project", "file_path", c("name").alias("symbol"), F.lit(True).alias("_bound"))
    ends = settle(ends.join(edges.select(*key), key, "left_anti").join(required, ["project", "file_path", "symbol"], "left"), "ends")
    passed = ends.filter("_bound").select(*key, c("file_path").alias("to_file"), own.alias("to_scope"), c("symbol").alias("to_name"))
    edges, ends = edges.unionByName(passed), ends.filter("_bound IS NULL").drop("_bound")
    stars = links.filter(c("kind") == STAR).join(meant, ["project", "file_path", "spec"]).select("project", "file_path", "to_file", F.lit(1).alias("far"))
    steps = edges
    if not stars.isEmpty():
        closure = star_closure(stars, settle)
        known = edges.select(*key).unionByName(ends.select(*key)).filter(c("scope") == out)
        asked = edges.filter((c("to_scope") == out) & (c("to_name") != "default")).select(
            "project", c("to_file").alias("file_path"), c("to_scope").alias("scope"), c("to_name").alias("name")).distinct().join(known, key, "left_anti")
        there = known.select("project", c("file_path").alias("to_file"), "name")
        hops = asked.join(closure, ["project", "file_path"]).join(there, ["project", "to_file", "name"]).groupBy(*key).agg(F.min(F.struct("far", "to_file")).alias("t"))
        steps = settle(edges.unionByName(hops.select(*key, c("t.to_file").alias("to_file"), out.alias("to_scope"), c("name").alias("to_name"))), "steps")
    to = ["project", "to_file", "to_scope", "to_name"]
    pointers, jump, total = steps, 1, None
    while True:
        ahead = pointers.select("project", c("file_path").alias("to_file"), c("scope").alias("to_scope"), c("name").alias("to_name"), F.struct(*to[1:]).alias("_next"))
        total = pointers.count() if total is None else total
        if jump > total or pointers.join(ahead, to, "left_semi").isEmpty():
            break
        landed = pointers.join(ahead, to, "left")
        pointers = settle(landed.select(*key, *[F.coalesce(c(f"_next.{x}"), c(x)).alias(x) for x in to[1:]]), "pointers")
        jump *= 2
    ends = ends.select("project", c("file_path").alias("to_file"), c("scope").alias("to_scope"), c("name").alias("to_name"), "symbol", "line")
    return settle(pointers.filter(c("scope") == own).join(ends, to).select("project", "file_path", "name", "to_file", "symbol", "line"), "reached")
