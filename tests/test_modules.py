"""Imports and exports: barrels, whole re-exports, require, forwarding, cycles, path aliases."""

import pytest

from builders import source_files
from leafscan import audit
from leafscan.operators import lexer, modules, scopes

TREE = {"p": {
    "routes/a.ts": 'import { list, save as store } from "../barrel";\nimport def from "../default";\nconst { old, kept: k } = require("../common.js");\nconst whole = require("../whole");\n'
                   'import { far } from "../far/index.js";\nimport { lost } from "../cycle/a";\nimport * as ns from "../barrel";\nimport { one } from "../picked";\n'
                   "r.get('/list', list);\nr.post('/save', store);\nr.get('/def', def);\nr.get('/old', old);\nr.get('/k', k);\nr.get('/whole', whole);\nr.get('/far', far);\n"
                   "r.get('/lost', lost);\nr.get('/one', one);\nr.get('/ns', ns);\n",
    "barrel.ts": 'export { list, put as save } from "./impl/store";\nexport { default } from "./default";\n',
    "impl/store.ts": "export function list(a) { return inner(a); }\nfunction inner(a) { return a; }\nconst write = (a) => a;\nexport { write as put };\n",
    "default.ts": "const handler = (a) => a;\nexport default handler;\n",
    "common.js": "function old(a) { return a; }\nfunction hidden(a) { return a; }\nmodule.exports = { old, kept: hidden };\n",
    "whole.js": "function main(a) { return a; }\nmodule.exports = main;\n",
    "far/index.ts": 'export * from "./b";\nexport * from "./other";\n',
    "far/b.ts": 'export * from "./c";\nexport * from ".";\n',
    "far/c.ts": 'import { deep } from "./d";\nexport { deep as far };\n',
    "far/d.ts": "export const deep = (a) => a;\n",
    "far/other.ts": "export const far2 = 1;\n",
    "cycle/a.ts": 'export { lost } from "./b";\n',
    "cycle/b.ts": 'export { lost } from "./a";\n',
    "picked.ts": "export const one = require('./impl/store').list;\n",
}}


def chains_of(spark, tree):
    a = audit(source_files(spark, tree))
    return {r["name"]: r["call_chain"] and [(s["file_path"], s["symbol"], s["line"]) for s in r["call_chain"]] for r in a.discovered.collect()}


def test_links_between_modules(spark):
    chains = chains_of(spark, TREE)
    store, deep = "/p/impl/store.ts", ("/p/far/d.ts", "deep", 1)
    assert chains == {
        "GET /list": [(store, "list", 1), (store, "inner", 2)], "POST /save": [(store, "write", 3)], "GET /def": [("/p/default.ts", "handler", 1)],
        "GET /old": [("/p/common.js", "old", 1)], "GET /k": [("/p/common.js", "hidden", 2)], "GET /whole": [("/p/whole.js", "main", 1)], "GET /far": [deep],
        "GET /lost": None, "GET /one": [(store, "list", 1), (store, "inner", 2)], "GET /ns": None}


def test_path_aliases(spark):
    tree = {"p": {
        "tsconfig.json": '{ // folders\n "compilerOptions": {"baseUrl": "./src", "paths": {"@/*": ["*"], "@/db/*": ["missing/*", "storage/*"], "exact": ["storage/exact.ts"], "~*": ["storage/t-*"]}} }',
        "src/r.ts": 'import { a } from "@/lib/a";\nimport { b } from "@/db/b";\nimport { c } from "exact";\nimport { d } from "lib/d";\nimport { e } from "express";\nimport { f } from "~f";\n'
                    "x.get('/a', a);\nx.get('/b', b);\nx.get('/c', c);\nx.get('/d', d);\nx.get('/e', e);\nx.get('/f', f);\n",
        "src/lib/a.ts": "export const a = 1;\n", "src/lib/d/index.ts": "export const d = 1;\n", "src/storage/b.ts": "export const b = 1;\n", "src/storage/exact.ts": "export const c = 1;\n",
        "src/storage/t-f.ts": "export const f = 1;\n",
        "sub/tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["./here/*"]}}}', "sub/r.ts": 'import { a } from "@/a";\ny.get("/sub", a);\n', "sub/here/a.ts": "export const a = 2;\n"}}
    chains = chains_of(spark, tree)
    assert {k: v and v[0][0] for k, v in chains.items()} == {
        "GET /a": "/p/src/lib/a.ts", "GET /b": "/p/src/storage/b.ts", "GET /c": "/p/src/storage/exact.ts", "GET /d": "/p/src/lib/d/index.ts", "GET /e": None,
        "GET /f": "/p/src/storage/t-f.ts", "GET /sub": "/p/sub/here/a.ts"}


@pytest.mark.parametrize("n", [1, 2, 3, 9, 40])
def test_long_roads_and_cycles_end(spark, n):
    road = {f"f{i}.ts": f'export {{ x{i} as x{i - 1} }} from "./f{i + 1}";\nexport * from "./f{i + 1}";\n' for i in range(1, n)}
    tree = {"p": {"r.ts": f'import {{ x0 }} from "./f1";\nimport {{ y }} from "./f1";\nq.get("/x", x0);\nq.get("/y", y);\n', **road,
                  f"f{n}.ts": f'export const x{n - 1} = 1;\nexport const y = 2;\nexport * from "./f1";\n'}}
    chains = chains_of(spark, tree)
    assert chains == {"GET /x": [(f"/p/f{n}.ts", f"x{n - 1}", 1)], "GET /y": [(f"/p/f{n}.ts", "y", 2)]}


def test_links_are_read_from_code_only():
    links = lambda text: modules.links_in(lexer.lex(text, every=True)[0][:-1])
    assert links('// import { a } from "./a"\n`import { b } from "./b"`;\nconst s = "export * from x"; f(import("./c"));') == []
    assert links('import type { T } from "./t";\nimport d, { type U, v as w } from "./u"\nimport "./side";\nexport type { X } from "./x";') == [
        ("bind", "T", "./t", "T"), ("bind", "d", "./u", "default"), ("bind", "U", "./u", "U"), ("bind", "w", "./u", "v"), ("forward", "X", "./x", "X")]
    assert links("exports.go = run;\nmodule.exports.stop = halt;\nexport default function f() {}\nexport * as ns from './n';\nimport e = require('./e');") == [
        ("forward", "go", "", "run"), ("forward", "stop", "", "halt"), ("bind", "e", "./e", "default")]


@pytest.mark.parametrize("code,local", [
    ("function a(x, f) { f(x); g(x); }", ["f"]),
    ("const a = (f, {h, k: m}, [n], ...r) => h(f(m(k(n(r())))));", ["h", "f", "m", "n", "r"]),
    ("const a = async f => { await f(1); q(); }; f(2)", ["f"]),
    ("function a(f: (x: T) => U, g = dflt()): Promise<X> { f(); g(); T(); }", ["f", "g"]),
    ("function o() { function inner(z) { z(); out(); } inner(1); const loc = 1; loc(); { let deep = 1; } deep(); }", ["z", "inner", "loc"]),
    ("class A { m(f, e) { f(); try { e() } catch (x) { x(); } } n() { f(); } }", ["f", "e", "x"]),
    ("export const f = 1; f(2); function b() { f(3); }", []),
    ("const t = `${((p) => p(1))(2)}`; p(3);", ["p"]),
    ("if (a) { b(c) } else { const b = 1; b(d) } b(e)", ["b"]),
    ("const a = { go(f) { return f(1) }, [k](w) { w() } }; f(2);", ["f", "w"]),
    ("const z = cond ? (x) : { y: x(1) };", []), ("", []), ("a(", [])])
def test_calls_of_inner_names(code, local):
    tokens = lexer.lex(code)[0]
    assert [tokens[k - 1] for k in sorted(scopes.local_calls(tokens))] == local
