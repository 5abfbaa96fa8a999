import random

import pytest

from skeinflow.llm.syntax import deep, fault, lexmap
from skeinflow.llm.syntax.base import Bad
from skeinflow.llm.validity import broken, broken_rates

GOOD = {
    "javascript": ["", "a = b / c / d", "x = /[/]\\/(/g.test(s)", "`a${b + `c${d}`}e`", "async (x) => { for await (const y of x) {} }", "class A extends B { static #p = 1; get x() { return this.#p } static { f() } }", "label: for (;;) break label", "const {a, b: [c = 1], ...d} = e", "if (a) b; else c", "x?.y?.[z]?.(w) ?? v", "import a, {b as c} from 'd'\nexport default class {}", "var f = function*() { yield* g() }", "a\n++b", "return_ = 1", "new Foo", "!function(){}()", "x = <div a={1}>t{y}<b/></div>", "#!/usr/bin/env node\nf()", "let async = 1; async = 2", "({ get: 1, set, async x() {}, [k]: 2 })"],
    "typescript": ["interface A<T extends B = C> { x?: number[]; readonly [k: string]: T; f(a: string): void }", "type X = { [K in keyof T]?: T[K] } & (A | B)[]", "function f<T>(this: A, x?: T, ...r: T[]): x is T { return x as unknown as T }", "enum E { A = 1, B }", "abstract class A<T> implements I { private x!: number; constructor(private readonly y: string) { super() } abstract f(): void }", "const f = <T,>(x: T): T => x", "declare module 'x' { export const y: number }", "let v = a! as const; x = y satisfies Z", "export type { A } from './a'; import type B from 'b'", "type F = (a: number) => Promise<Map<string, number>>", "let x: typeof import('y')", "a < b && c > d"],
    "go": ["package p\n", "package p\nimport (\n\t\"a\"\n\tb \"c\"\n)\nfunc (r *T) F(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[k]; ok {\n\t\treturn v, nil\n\t}\n\tfor i := range 10 {\n\t}\n\tswitch x := y.(type) {\n\tcase int, *T:\n\tdefault:\n\t}\n\tselect {\n\tcase c <- 1:\n\tcase v := <-d:\n\t\t_ = v\n\t}\n\tgo func() {}()\n\treturn T{a: 1}.f(), &T{}\n}\ntype G[K comparable, V any] struct {\n\tA int `t:\"x\"`\n\t*B\n}\nvar x = map[string][]int{\"a\": {1, 2}}\nconst (\n\tA = iota\n\tB\n)\n"],
    "java": ["", "package a.b;\nimport static c.D.*;\n@A(b = {1, 2}) public final class X<T extends Y & Z> extends W<T> implements V {\n int[] a = {1, 2}, b[];\n static { f(); }\n X(int... q) throws E { super(q); }\n <U> U g(List<? super U> l) { for (var x : l) { if (x instanceof String s && !s.isEmpty()) continue; } return (U) l.get(0); }\n enum E { A(1) { void f() {} }, B; E(int... x) {} }\n Runnable r = () -> { try (var z = o()) { } catch (A | B e) { throw e; } finally { } };\n int h(int k) { return switch (k) { case 1, 2 -> 3; default -> { yield 4; } } + (k > 1 ? a[0] : b.<T>c()) << 2 >>> 1; }\n record P(int x) {}\n}\n"],
    "yaml": ["", "a: 1\nb:\n- x\n- y: z\n  w: [1, {q: r}]\n", "--- # c\na: |\n  text: with: colons\n\n  more\nb: >-\n  x\n...\n---\n- 'it''s'\n- \"a\\n\"\n", "plain text\nover lines\n", "? complex\n: value\n", "&a x: *b\n", "k: \"two\n  lines\"\nn: http://x.y/z#q\n", "{\"json\": [1, 2,\n 3]}\n"],
    "shell": ["", "#!/bin/bash\nset -e\nf() {\n local x=\"${1:-y}\" a=(1 2)\n if [[ $x =~ ^a(b)$ ]] && [ -f \"$x\" ]; then echo $((1 + 2)); elif ! true; then :; fi\n for i in a b; do echo \"$i\"; done | sort > out 2>&1 &\n case $x in a|b) echo 1;; *) ;; esac\n while read -r l; do echo; done < <(ls)\n cat <<EOF\n$(unbalanced ( in text\nEOF\n}\nfor ((i=0;i<3;i++)); do :; done\n"],
    "json": ["{}", "[1, \"a\", null]\n"],
    "toml": ["a = 1\n[b]\nc = [\"d\"]\n"],
    "python": ["", "def f(x: int = 1, /, *a, **k) -> None:\n    return f'{x!r:>{2}}'\n", "match x:\n    case [1, *_]: pass\n"],
}
BAD = {
    "javascript": ["a b", "function (", "x = 'open", "if (a) {", "}", "<<<<<<< HEAD\n", "let x = ;", "return 1", "const a;", "1 = 2", "`open ${x", "import x from y", "/* open", "class { }", "interface A {}", "for (x", "a ? b"],
    "typescript": ["interface A { x: }", "let x: = 1", "function f(a: number { }", "enum { A }", "class A { x: number = }"],
    "go": ["", "func f() {}", "package p\nfunc f() {\n\tif x\n\t{\n\t}\n}\n", "package p\nvar x = \"open\n", "package p\n}\n", "package p\nx := 1\n", "package p\nfunc f() { a b }\n", "package p\nfunc f() { for { }\n"],
    "java": ["class A {", "class A { int x = ; }", "class A { void f() { a b c; } }", "class A { void f() { x + 1; } }", "class A { String s = \"open; }", "int f() { return 1 }", "class A {} }"],
    "yaml": ["a: b: c\n", "a:\n\tb: 1\n", "a: \"x\" y\n", "a: [1, 2\n", "a: 1\n b: 2\n", "a: 1\n<<<<<<< main\n", "a:\n  - b\n c: d\n", "```\na: 1\n", "- a\nb: 1\n", "a: 'open\n"],
    "shell": ["if true; then echo; ", "f() {\n echo\n", "echo \"open", "for x in a; echo; done", "case x in a) echo", "fi", "a | | b", "<<<<<<< HEAD\n", "x=$(ls", "}", "while true; do"],
    "json": ["", "{'a': 1}", "[1,]", "{\"a\": NaN}", "{} {}", "// c\n{}"],
    "toml": ["a = ", "a\n", "[x\n"],
    "python": ["print 'x'\n", "def f(:\n    pass\n", "if x:\npass\n", "x = '\n"],
}


@pytest.mark.parametrize("language", sorted(GOOD))
def test_valid(language):
    for text in GOOD[language]:
        for body in (text, "﻿" + text, text.replace("\n", "\r\n"), text.rstrip("\n")):
            if language == "go" and body == "":
                continue
            assert fault(language, body.encode(), "x.js") is None, (text, fault(language, body.encode(), "x.js"))


@pytest.mark.parametrize("language", sorted(BAD))
def test_broken(language):
    for text in BAD[language]:
        assert fault(language, text.encode(), "x.js"), text


LEXED = {
    "java": GOOD["java"][1], "go": GOOD["go"][1] * 3, "json": '{"a": ["x{", {"b": "c\\"]"}]}\n', "toml": 'a = ["x]", \'y[\'] # [\n[t]\nb = """\n[ "q" \n"""\nc = \'\'\'\n{\'\'\'\n' * 3,
    "python": "x = (\n 'a)', \"b\\\"]\", # c(\n)\ny = \'\'\'\n((\n\'\'\'\nz = f'{x[0]}' + r'\\\\'\n" * 3,
    "typescript": "const a = `x ${b({c: `${d}`})}\n y`; // (\nif (a) /[(]/.test(a / b); /* {\n */ const s = 'it\\'s (';\n" * 3,
}


@pytest.mark.parametrize("language", sorted(LEXED))
def test_chunk_maps_agree_however_they_are_grouped(language):
    rng = random.Random(2)
    text = LEXED[language]
    assert lexmap.balanced([lexmap.summary(language, text, True)]) and lexmap.summary(language, text, True)["code"][0] in ("code", "line")
    for body in (text, text[: len(text) // 2 + 3], text + "}", "(" + text):
        whole = lexmap.balanced([lexmap.summary(language, body, True)])
        assert whole == (body == text) or len(body) < len(text)
        for size in (5, 30, 100):
            maps = [lexmap.summary(language, x, i == 0) for i, x in enumerate(lexmap.chunks(body, size))]
            one = lexmap.balanced(maps)
            assert one or not whole  # chunks of a script may leave more to the grammar
            while len(maps) > 1:
                i = rng.randrange(len(maps) - 1)
                maps[i : i + 2] = [lexmap.combine(maps[i], maps[i + 1])]
            assert lexmap.balanced(maps) == one


def test_what_only_the_grammar_can_tell_is_left_to_it():
    for language, text in (("javascript", "x = <p>don't (</p>\n"), ("python", "x = f'{d['a']}{'\n"), ("typescript", "let x = {} / 2 / '('.length\n"), ("typescript", "y\n/ 2 / ('\n")):
        assert lexmap.balanced([lexmap.summary(language, text, True)])
    assert fault("javascript", b"x = <p>don't (</p>\n", "a.jsx") is None
    for language, text in (("python", "x = 'a\n"), ("python", "x = (]\n"), ("typescript", "f(`${a)}`)\n"), ("toml", "a = 'x\n"), ("typescript", "a = /[)]/ + (\n")):
        assert not lexmap.balanced([lexmap.summary(language, text, True)])


@pytest.mark.parametrize("levels", [119, 400, 2500])
def test_depth_decides_nothing(levels):
    texts = {
        "javascript": ("x = " + "(" * levels + "1", ")" * levels), "typescript": ("let x = " + "[" * levels, "]" * levels), "go": ("package p\nvar x = " + "(" * levels + "1", ")" * levels + "\n"),
        "java": ("class A { int x = " + "(" * levels + "1", ")" * levels + "; }"), "shell": ("x=" + "$(" * levels + "ls", ")" * levels + "\n"), "yaml": ("a: " + "[" * levels, "]" * levels + "\n"),
        "json": ("[" * levels, "]" * levels), "toml": ("a = " + "[" * levels, "]" * levels + "\n"),
    }
    for language, (opening, closing) in texts.items():
        assert fault(language, (opening + closing).encode()) is None, language
        assert fault(language, (opening + closing.replace(closing[0], "", 1)).encode()), language
    assert fault("javascript", ("{" * levels + "}" * levels).encode()) is None and fault("javascript", ("{" * levels + "a b" + "}" * levels).encode())


def test_long_chains_of_python():
    n = 30_000
    for text in ("x = " + "-" * n + "1", "x = " + "not " * n + "y", "x = " + " + ".join(["a"] * n), "x = (" + " +\n".join(["a"] * n) + ")", "x = a" + ".b" * n, "if a:\n  pass\n" + "elif b:\n  pass\n" * n):
        assert fault("python", text.encode() + b"\n") is None
    for text in ("x = " + "-" * n, "x = " + " + ".join(["a"] * n) + " +", "x = a" + ".b" * n + ".", "if a:\n  pass\n" + "elif b:\n  pass\n" * n + "elif:", "x = " + "- " * n + "1 2"):
        assert fault("python", text.encode() + b"\n")


def test_deep_json_by_its_own_stack():
    n = 100_000
    assert fault("json", ("[" * n + "]" * n).encode()) is None
    for text in ("[" * n + "]" * n + "]", "[" * n + "1,]" + "]" * (n - 1), '{"a":' * n + "1" + "}" * (n - 1), "[" * n + "01" + "]" * n):
        assert fault("json", text.encode())
    for text in ('{"a": [1, -2.5e3, "x\\u0041", {}, []], "b": null}', "{}", "[]", '"x"', " 1 "):
        deep.check_json(text)
    for text in ("", "{", "[1 2]", '{"a" 1}', '{"a": 1,}', "{1: 2}", "[,]", "tru", "1 2", '"\\x"', "[1]]"):
        with pytest.raises(Bad):
            deep.check_json(text)


def test_operator(spark):
    long = "package p\n" + "func f() {\n\tg(\"}\")\n}\n" * 400
    files = [(1, "r", "a.py", None, b"x = (\n"), (2, "r", "b.PY", " Python ", b"x = 1\n"), (2, "r", "b.PY", " Python ", b"x = 1\n"), (3, "r", "c.go", "go", long.encode()), (4, "r", "d.go", "GO", (long + "}").encode()), (5, "r", "e.json", "json", b""), (6, "r", "f.sql", "sql", b"("), (7, "r", "g.py", "python", None), (8, "r", "h.py", "python", b"("), (9, None, None, "toml", b"a = 1\r\n"), (10, "r", "i.yaml", "", b"a: b: c")]
    frame = spark.createDataFrame([(i, r, p, lang, None if c is None else bytearray(c)) for i, r, p, lang, c in files], "file_id long, repo string, path string, language string, content binary")
    skipped = spark.createDataFrame([("r", "h.py"), (None, None)], "repo string, path string")
    from skeinflow.llm import validity

    judged = {r.file_id: r.bad for r in validity.broken_files(frame, chunk=500).collect()}
    assert {r.file_id: r.bad for r in validity.broken_files(frame, chunk=40).collect()} == judged  # more steps of the reduction
    assert judged == {1: True, 2: False, 3: False, 4: True, 5: True, 8: True, 9: False, 10: True}
    found = broken(frame, skipped)
    assert {r.file_id for r in found.filter("bad").collect()} == {1, 4, 5, 10}
    assert {(r.lang, r.n_files, r.n_broken) for r in broken_rates(found).filter("repo = 'r'").collect()} == {("python", 2, 1), ("go", 2, 1), ("json", 1, 1), ("yaml", 1, 1)}
    assert broken(frame.limit(0), skipped).count() == 0
