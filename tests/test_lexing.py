"""Lexical cases of everyday TypeScript: type arguments, assertions, regular expressions, markup, broken files."""

import random

import pytest
from pyspark.sql import functions as F

from leafscan.operators import discovery, lexer, tokens
from leafscan.sources import corpus

CODE = {
    "type_args": "db.user.findMany<User>({skip: 5}); M.find<User>({}).skip(5); f.g<Map<A, B[]>>().skip(1);\nx.y<{a: string; b?: C<D>}>(1)",
    "asserted": "M.find({})!.skip(5); a[0]!.b(); if (!x.y()) z()",
    "compared": "if (a.b < c.d > (e)) q.skip(1)",
    "indented": "const p = [\n            /[(]/, 1];\nM.find().skip(5)",
    "arrow": "const f = x => /[(]/.test(x);\nM.find().skip(5)",
    "behind_bracket": "if (x) /[(]/.test(x);\nM.find().skip(5)",
    "returned": "function g(x) { return     /[)]/.exec(x) }\nM.find().skip(5)",
    "divided": "const r = (a) / b / c.d(1); i++ / 2 / k.l(2); M.find().skip(5)",
    "markup": "const v = <div>\n  <p>step 1) go</p>\n  <br />\n</div>;\nfunction h() { return M.find().skip(5) }",
    "unclosed": "M.find().skip(5);\nfunction f() {}\nconst g = (a => {\n  N.find().skip(6);",
    "broken": "M.find().skip(5)\n}}}\nN.find().skip(6)",
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("p", "/p", f"/p/{n}.ts", c) for n, c in CODE.items()], "project string, root string, file_path string, content string")


def test_calls(files):
    found = {}
    for r in tokens.member_calls(files).orderBy("file_path", "close_n").collect():
        found.setdefault(r.file_path[3:-3], []).append(tuple(r.names))
    assert found["type_args"] == [("findMany",), ("find",), ("find", "skip"), ("g",), ("g", "skip"), ("y",)]
    assert found["asserted"] == [("find",), ("find", "skip"), ("b",), ("y",)]
    assert found["compared"] == [("skip",)]
    for name in ("indented", "markup", "arrow", "behind_bracket", "returned"):
        assert found[name][-2:] == [("find",), ("find", "skip")], name
    assert found["arrow"][0] == ("test",) and found["returned"][0] == ("exec",)
    assert found["divided"] == [("d",), ("l",), ("find",), ("find", "skip")]
    assert found["broken"].count(("find", "skip")) == 2


def test_facts_of_files_that_do_not_balance(files):
    facts = tokens.token_facts(files)
    calls = facts.filter("fact = 'call' AND name = 'skip'").groupBy("file_path").count()
    counts = {r.file_path[3:-3]: r["count"] for r in calls.collect()}
    assert counts == {"type_args": 2, "asserted": 1, "compared": 1, "indented": 1, "arrow": 1, "behind_bracket": 1, "returned": 1, "divided": 1, "markup": 1, "unclosed": 1, "broken": 2}
    texts = {r.text for r in facts.filter("fact = 'call' AND name = 'findMany'").collect()}
    assert texts == {"db.user.findMany<User>({skip: 5})"}
    assert {r.file_path for r in facts.filter("fact = 'bad'").select("file_path").distinct().collect()} == {"/p/broken.ts", "/p/unclosed.ts"}


def test_no_resolvers_in_types(spark):
    code = ("type R = { Query: { feed: string } }\nexport interface S { Mutation: { a: string } }\n"
            "export const resolvers = { Query: { posts: () => 1 } };\napp.get<P>('/users', list)")
    files = spark.createDataFrame([("p", "/p", "/p/r.ts", code)], "project string, root string, file_path string, content string")
    units = discovery.discovered_units(tokens.token_facts(files))
    assert {r.name for r in units.select(F.col("name")).collect()} == {"Query.posts", "GET /users"}


MODES = {
    "const x = `${await M.find().skip(5)}`; N.x()": ["find", "skip", "x"],
    "const y = `a ${`b ${M.q().skip(1)} c`} d`; N.x()": ["q", "skip", "x"],
    "return <p>step (a</p>;\nM.find().skip(5)": ["find", "skip"],
    "const v = <div title=\"a(\">don't {M.find().skip(5)} can't<br/> <b>x</b></div>; N.x()": ["find", "skip", "x"],
    "const v = <A b={M.find()} {...c.d()}><>{e.f(<g.H i='('/>)}</></A>; N.x()": ["find", "d", "f", "x"],
    "const g = <T>(a: T) => a.b(); const h = <any>x.y();": ["b", "y"],
    "M.find<A<B<C<D<E<F>>>>>>({}).skip(5)": ["find", "skip"],
    "M.find<(a: X) => Y>({}).skip(5); M.g<A extends B ? C : D>().h()": ["find", "skip", "g", "h"],
    "if (a.b<c && d.e>(f)) g.h()": ["h"],
    "a.x(b.c; N.x()": ["x"], "for (let i = 0; i < a.b(); i++) { c.d() }": ["b", "d"], "x = `never closed ${ a.b() }; c.d()": ["b", "d"],
    "const re = /`[(]/; a.b(`\\``)": ["b"], "a.b(/* ( */ 1) // )": ["b"], "const s = 'it\\'s (', t = \"(\"; a.b()": ["b"],
}


@pytest.mark.parametrize("code", MODES)
def test_modes(code):
    tokens, _, _, _ = lexer.lex(code)
    assert [tokens[k + 1] for k, t in enumerate(tokens[:-2]) if t == "." and tokens[k + 2] == "("] == MODES[code]


def test_tokens_stand_where_they_are_in_any_text():
    rng = random.Random(11)
    parts = ["a", "b.c(", ")", "(", "{", "}", "[", "]", "`", "${", "<", ">", "</a>", "<a>", "<a b={", "/>", "/", "'", '"', ";", "\n", " ", "const ", "return ", "=>", "=", "//", "/*", "*/", "é", "\\", "import ", "x<y>("]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 40)))
        for every in (True, False):
            tokens, gaps, lines, wraps = lexer.lex(text, every)
            assert not every or not wraps
            at, line, open_ = 0, 0, []
            for t, gap, n in zip(tokens, gaps, lines):
                if t == "":
                    break
                assert n == text.count("\n", at, at + gap)
                at += gap
                assert text.startswith("}" if t == lexer.TEMPLATE_CLOSE else t, at)
                at += len(t)
                if not every:  # what is left balances
                    if t in ("(", "[", "{", "${"):
                        open_.append(t)
                    elif t in (")", "]", "}", lexer.TEMPLATE_CLOSE):
                        assert open_ and open_.pop() == {")": "(", "]": "[", "}": "{", lexer.TEMPLATE_CLOSE: "${"}[t], text
            assert not open_, text


GROUPED = {
    "(M.find({})).skip(5)": [("find",), ("find", "skip")],
    "const x = ((M.find({}))).skip(5).limit(1)": [("find",), ("find", "skip"), ("find", "skip", "limit")],
    "((M.find()).skip(5)).sort(a)": [("find",), ("find", "skip"), ("find", "skip", "sort")],
    "r = await (this.db.get('a').find(\n  f((1)))\n).skip(5)": [("get",), ("get", "find"), ("get", "find", "skip")],
    "(await M.find({})).skip(5); (a || M.find()).skip(6); (a?.find()).skip(7); (typeof M.find()).skip(8); (M.find).skip(9)":
        [("find",), ("skip",), ("find",), ("skip",), ("skip",), ("find",), ("skip",), ("skip",)],
    "q(M.find()).skip(5); if (M.find()) { N.skip(6) } (x ? M.find() : y).skip(7); (M.find())[0].skip(8)":
        [("find",), ("skip",), ("find",), ("skip",), ("find",), ("skip",), ("find",), ("skip",)],
    "a = (load()).skip(5); (() => M.find())().skip(6); (M.find() as any).skip(7)": [("skip",), ("find",), ("skip",), ("find",), ("skip",)],
}


def test_brackets_that_only_group(spark):
    files = spark.createDataFrame([("p", "/p", f"/p/{n}.ts", code) for n, code in enumerate(GROUPED)], "project string, root string, file_path string, content string")
    found = {}
    for r in tokens.member_calls(files).orderBy("file_path", "close_n").collect():
        found.setdefault(int(r.file_path[3:-3]), []).append(tuple(r.names))
    assert [found[n] for n in range(len(GROUPED))] == list(GROUPED.values())
    skips = tokens.token_facts(files).filter("fact = 'call' AND name = 'skip'").collect()
    shown = {(int(r.file_path[3:-3]), r.text, r.line_start, r.line_end) for r in skips}
    assert {(0, "(M.find({})).skip(5)", 1, 1), (1, "((M.find({}))).skip(5)", 1, 1), (2, "(M.find()).skip(5)", 1, 1),
            (3, "(this.db.get('a').find(\n  f((1)))\n).skip(5)", 1, 3), (4, "(a?.find()).skip(7)", 1, 1), (6, "(load()).skip(5)", 1, 1)} <= shown
    pairs = tokens.brackets(files).groupBy("file_path").count().collect()
    assert {int(r.file_path[3:-3]): r["count"] for r in pairs} == {n: sum(map(code.count, "([{")) for n, code in enumerate(GROUPED)}
    calls = tokens.token_facts(files).filter("fact = 'icall'").select("name").collect()
    assert not calls  # no declaration is around them


def test_deep_groups_are_read_in_a_moment():
    code = "(" * 2000 + "a.b()" + ").c()" * 2000
    assert lexer.lex(code)[0].count("(") == 2001
    assert lexer.lex("(" * 5000 + "a.b()" + ")" * 5000 + ".c()")[0].count("(") == 2
    assert lexer.lex("x(" + "(" * 5000 + "a.b()" + ")" * 5000 + ").c()")[0].count("(") == 5003


def test_texts_of_ascii_are_read_by_the_faster_pattern_with_the_same_tokens(monkeypatch):
    texts = [*corpus.EDGE_TEMPLATES, *(t for _, t in corpus.MODE_FILES + corpus.MODULE_FILES), "", "a\n// end", "a  \n", "x\x1cy\x0bz!.q", "`a${b}`!['c'] /= /[/]/g", "/* open", "'open\nx"]
    read = []
    monkeypatch.setattr(lexer, "_ASCII_CODE", lambda text, at, match=lexer._ASCII_CODE: read.append(text) or match(text, at))
    fast = [(lexer.lex(t), lexer.lex(t, True), lexer.lex(t, False, True)) for t in texts]
    assert set(read) == {t for t in texts if t.isascii()} and len(read) > len(texts)
    read.clear()
    assert lexer.lex("naïve²(x)")[0][:-1] == ["naïve", "²", "(", "x", ")"] and not read
    monkeypatch.setattr(lexer, "_ASCII_CODE", lexer._CODE)
    assert [(lexer.lex(t), lexer.lex(t, True), lexer.lex(t, False, True)) for t in texts] == fast


def test_patterns_of_the_standard_module_read_alike():
    def read(pattern, text):
        return [(m.lastindex, m.span(m.lastindex), m.end()) if (m := pattern(text, at)) else None for at in range(len(text))]

    for ch in map(chr, [*range(0xD800), *range(0xE000, 0x10000)]):
        for text in (f"a{ch}b", f"{ch}!.x"):
            assert read(lexer._PLANE_CODE, text) == read(lexer._CODE, text), hex(ord(ch))
    for text, pattern in (("ab", lexer._ASCII_CODE), ("é￿", lexer._PLANE_CODE), ("\ud800", lexer._PLANE_CODE), ("é𝒳", lexer._CODE), ("", lexer._ASCII_CODE)):
        assert lexer.Lexer(text).read == pattern
    assert lexer.lex("é.ñ𝒳(½)")[0][:6] == ["é", ".", "ñ𝒳", "(", "½", ")"]
