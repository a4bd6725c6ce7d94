import ast

import pytest

from skein.llm.syntax.faults import check_files, fault_rates
from skein.llm.syntax.parser import parsers
from skein.llm.syntax.tables import build
from skein.llm.syntax.run import first_error

GOOD = {
    "python": [
        "", "# only a comment", "x = 1\n", "def f(a, *, b=2, **k) -> int:\n    return a\n", "match x:\n    case {'a': int(n), **rest} if n: pass\n    case _: pass\n", "match = type = case = 1\nprint(match)\n",
        'f"{x!r:>{w}} {{}} {y=} {z:%H:%M}"\n', "async def g():\n\tasync with a as b, c: yield\n", "try:\n  a\nexcept* E as e: b\nfinally: c\n", "class A[T: int = str](B, m=C): x: int = 3\n", "type X[T] = list[T]\n",
        "lambda *a, k=1: (yield)\n", "if (n := 3) > 2: pass\nelse: ...\n", "a[1:2, ::3, *b] = c, *d = e\n", "x = (1,\n  # c\n  2)\n", "with (open(a) as f, b,): pass\n", "del a, (b, [c])\n", "@a.b(c)\ndef f(): pass", "print(*a, **b, c=1)", "f(a, *b, c=1, *d, **e, g=2,)", "f(x for x in y)", "é = 'ü'\n",
    ],
    "javascript": [
        "", "let a = 1\nlet b = 2", "const f = async ({a = 1, ...r}, [b,, c]) => ({ ...r, x() {}, get y() { return 1 }, async *z() {} })", "a = b / c / d; r = /[/]\\/x/gi.test(s)", "`a ${`b ${c}`} d`", "for await (const x of y) {}", "label: for (;;) break label",
        "class A extends B { #p = 1; static { this.x = 2 } static async *m() { yield* this.#p } }", "export default class {}\nimport x, { y as z } from 'm'; export * as n from 'k'", "a?.b?.[c]?.(d) ?? e", "if (a) b; else c\nreturn_ = 1", "x\n++y", "do x(); while (y) z()",
        "var { a, b: [c = 1] } = d, e", "switch (a) { case 1: default: b }", "new.target; new A; new A.B(c).d", "async () => { await x }", "({ a, b } = c)", "i = 1_000n + 0x1F + .5e3", "#!/usr/bin/env node\nx", "try { a } catch { b } finally { c }", "for (const a of b) { } for (let i, j; ; ) { }", "f(function () { if (a) { return } else return 1 }, () => { switch (a) { case 1: return } })",
    ],
    "typescript": [
        "let a: Array<Map<string, number>> = []", "type P<K extends string = string> = { readonly [Q in K]?: Array<{ a: Q }> } & { kind: 'a' | 'b' };", "class A { private readonly x: number = 1; constructor(private y: string[]) {} public f<T>(a?: T): a is B { return true } }",
        "interface I extends J<K> { a?: string; (x: number): void; new (y): I; readonly [k: string]: any }", "enum E { A = 1, B = 'x' }", "const f = <T,>(x: T): T => x as unknown as T", "declare module 'x' { export function f(a: string): void }", "abstract class B { abstract m(): void; get x(): number { return 1 } }",
        "type F = (a: number, ...b: string[]) => Promise<void>; let x!: F", "function f(this: Window, x: string): asserts x is 'a';", "a!.b!(c) satisfies D", "import type { A } from './a'; export type { B } from './b'", "namespace N.M { export const a = 1 }", "type C<T> = T extends (infer U)[] ? U : never", "let t: [a: string, b?: number] = ['x']", "for (const x of <any>y) {}",
    ],
    "go": [
        "package a\n", "package a\nimport (\n\t\"fmt\"\n\t. \"x\"\n)\nfunc (s *S) M(a, b int, c ...string) (x int, err error) { return }", "package a\ntype T[K comparable, V any] struct { K; f map[string][]int `tag`; *E }", "package a\nfunc f() { for i, v := range xs { if x := g(); x != nil { continue } else if y { } } }",
        "package a\nvar x = []T{{1, 2}, {a: 3}}; const ( A = iota; B )", "package a\nfunc f() { switch x := y.(type) { case int, string: default: } ; select { case c <- 1: case v, ok := <-c: } }", "package a\nfunc f() { defer func() { recover() }(); go g(a...); x.y[1:2:3] = <-c; L: goto L }", "package a\ntype I interface { M(int) error; ~int | ~string; io.Reader }",
    ],
    "rust": [
        "", "fn main() { let x: Vec<Vec<u8>> = vec![1, 2]; println!(\"{}\", x); }", "impl<'a, T: Ord + ?Sized> S<'a, T> for X where T: 'a { fn f(&mut self, (a, b): (i32, i32)) -> Result<(), Box<dyn E>> { Ok(()) } }", "fn f() { match x { Some(n) if n > 1 => 1, A { b, .. } | B(..) => {} 1..=5 | _ => 3 } }",
        "fn f() { if let Some(x) = y { } else if a && b { } for i in 0..n { } while true { break; } 'o: loop { break 'o } }", "use std::{io::{self, Read}, fmt as f, *};", "#[derive(Debug)] pub(crate) enum E { A(u8), B { x: i32 }, C = 3 }", "fn f() { let c = move |x: i32| -> i32 { x + 1 }; a.b::<T>(c)?.d[0].0.1; x as u32 < 3; }",
        "macro_rules! m { ($x:expr) => { $x }; }", "fn f() { let S { a, .. } = s else { return }; unsafe { *p = 1 } }", "trait T { type A: B; const C: u8 = 1; fn f(self: Box<Self>) where Self: Sized; }", "fn f<const N: usize>(x: [u8; N]) -> impl Fn(u8) -> u8 + '_ { |y| y }", "/* a /* b */ c */ fn f() { r#\"x\"#; b'c'; '\\u{1F}'; }",
    ],
    "java": [
        "", "package a.b; import static c.D.*; public final class E<T extends F & G> extends H<T> implements I { }", "class A { int[] x = {1, 2,}; <T> T f(List<? extends T> a, int... b) throws E { return (T) a.get(0); } A() { super(); } static { } }",
        "record P(int a, @X String b) { P { } }", "sealed interface S permits A, B { default void f() { } }", "enum E implements F { A(1) { }, B; E() { } }", "class A { void f() { var x = switch (y) { case 1, 2 -> 3; default -> { yield 4; } }; for (int i = 0, j = 1; i < 2; i++, j--) ; for (final var z : zs) { } } }",
        "class A { Object o = (a, b) -> a + b; Runnable r = this::f; Object p = A[]::new; Object q = new A<>() { }; int i = (int) 1L >>> 2; }", "class A { String s = \"\"\"\n  x \"y\"\n  \"\"\"; char c = '\\''; }", "@interface X { int v() default 1; }", "class A { void f() { try (var a = b; c) { } catch (X | Y e) { } finally { } if (o instanceof P(int a, var b) && a > 0) { } } }",
        "class A { void f() { synchronized (this) { } assert a : b; do { } while (x); l: break l; } }",
    ],
}
BAD = {
    "python": ["def f(:", "x = (1", "if a\n  b", "  x = 1", "a b", "'abc", "f'{x'", "else: pass", "x = 012", "def f():\n", "return = 1", "<<<<<<< HEAD\nx\n=======\ny\n>>>>>>> b", "if a:\n    b\n  c", "f'{}'", "class A\n  pass", "x = 1 +", "f(a=1, b)", "f(**a, *b)", "f(x for x in y, 1)"],
    "javascript": ["let a = ;", "function f( {", "`abc", "a b", "class A { private x; }", "let x: number = 1", "if (a {", "{ a: 1, b: 2 }", "return }", "import x from", "'abc\n'", "/abc", "for (;;", "<!DOCTYPE html>", "a => { b", "interface A { b: c }", "return 1", "if (a) { return }", "const a", "let { b }", "class A { static { return } }"],
    "typescript": ["let a: = 1", "type A = ", "interface I { a: }", "enum E { 1a }", "class A { x: number y: string }", "function f(a: string { }", "let x: Array<string = 1", "<<<<<<< HEAD"],
    "go": ["", "func f() {}", "package a\nfunc f() {", "package a\nfunc f()\n{\n}", "package a\nvar x = = 1", "package a\nx := 1", "package a\nfunc f() { if { } }", "package a\nimport \"x", "package a\nfunc f() { a b }"],
    "rust": ["fn f( {", "fn f() { let x = ; }", "struct S { a: i32 b: i32 }", "fn f() { match x { 1 = 2 } }", "use a::;", "let x = 1;", "fn f() { \"abc }", "impl T { x }", "fn f() { a b }", "enum E { A(u8 }"],
    "java": ["class A {", "class A { void f() { int x = 1 } }", "class { }", "void f() { }", "class A { int f( { } }", "class A { String s = \"abc; }", "class A { void f() { if (a { } } }", "import a", "class A { x = 1; }", "def f(): pass", "class A { void f() { a b c; } }", "class A { void f() { try { } } }"],
}


#: Cases of the language specifications: what the words of a rule allow, and what they forbid.
BY_SPECIFICATION = {
    "go": {
        True: [
            "package a\nfunc f() { if x == (T{1}) { } }", "package a\nfunc f() { for _, v := range []T{{1}} { } }", "package a\nfunc f() { if f(T{1}) { } ; if a[T{1}.b] { } ; if v, ok := m[K{1}]; ok { } }",
            "package a\nfunc f() { if err := g(func() error { return T{1} }); err != nil { } }", "package a\nfunc f() { for x.y { } ; for { } ; for ; ; { } }", "package a\nfunc f() { if x := struct{ a int }{1}; x.a == 1 { } }", "package a\nfunc f() { switch { default: } ; switch x := y.(type) { case int: } }",
            "package a\nvar x = [...]string{2: `a`, 3: \"b\"}", "package a\nvar x = map[string]struct{ a, b int }{\"k\": {1, 2}}", "package a\ntype F func(a, b int, z float64, opt ...interface{}) (success bool)", "package a\nfunc f() { select {} }", "package a\nfunc f() { Outer: for { break Outer } }",
            "package a\nfunc G[P interface{ ~int }](x P) P { return x }", "package a\nvar y = G[int](1)", "package a\nconst ( a, b = iota, iota + 1; c, d )", "package a\nfunc (p *T) M() {}\nvar f = (*T).M", "package a\nvar c = 0x1p-2 + 0b101 + 0o17 + 1_000i",
        ],
        False: [
            "package a\nfunc f() { if x == T{1} { } }", "package a\nfunc f() { for i := range T{1} { } }", "package a\nfunc f() { switch T{} { } }", "package a\nfunc f() { if x { } \n else { } }", "package a\nfunc f() { x := [3]int{1, 2, 3\n} }", "package a\nfunc f(a int, b) { } ; func",
            "package a\nfunc f() { var x int = }", "package a\nimport a.b", "package a\nfunc f() { for i := 0; i < 3 { } }", "package a\ntype T struct { a int, b int }", "package a\nfunc f() { x++ + 1 }", "package a\nfunc f() { return return }",
        ],
    },
    "typescript": {
        True: [
            "for (const a of b) { if (c) { continue } break }", "const f = ({ a = 1 }: T): void => {}", "({ a = 1 } = x)", "function f() { for (;;) { return } switch (a) { case 1: break } }", "abstract class A<T extends object = {}> extends B<T> implements C, D { protected abstract readonly x?: T; static #y = 1; declare z: string }",
            "function f<const T>(x: T): x is T; function f(x: any): any { return x }", "type A = `a${string}b` | keyof typeof x | T[K][number]", "let x = y as const, z = <T>y, w = y!.a!", "export abstract class A { abstract get x(): number; abstract set x(v: number) }", "type M = { -readonly [K in keyof T as `x${K}`]-?: T[K] }",
            "import x = require('y'); export = x", "declare global { interface Window { a: string } }", "let f: new (...args: any[]) => T; let g: (this: T, a?: number) => asserts a is string", "enum A { X = 1 << 2, Y = X | 1, 'z' }", "class A { constructor(readonly a: string, private b?: number) { super() } [k: string]: any }", "type T1 = [first: string, ...rest: number[]]",
        ],
        False: [
            "break", "continue", "let let: number = 1", "({ a = 1 })", "class A { x: }", "type A = { a: string", "interface I { a: string } }", "function f(a?: ) {}", "let x: Map<string, = 1", "enum E { A B }", "const f = (a: number b: string) => 1", "import { a from 'b'", "class A extends { }x", "let x: [a, = 1", "declare module { }",
        ],
    },
    "javascript": {
        True: [
            "({ a = 1 } = x)", "({ a = 1 }) => a", "async ({ a = 1 }) => a", "[{ a = 1 }] = x", "({ a: { b = 1 } } = x)", "({ a: [{ b = 1 }], c } = x)", "for ({ a = 1 } of b) ;", "x = { a, b: c, [d]: e, ...f }; [1, , 2, ...x,]; [,]; [, a]", "[a, b] = [b, a]", "var let = 1",
            "for (;;) { break; continue; if (a) break; else continue }", "while (a) { switch (b) { case 1: break; default: continue } }", "l: { break l }", "for (const x of y) for (const z of x) { try { break } catch (e) { continue } finally { break } }", "switch (a) { case 1: if (b) { break } { break } }", "do { if (a) continue } while (b)",
            "with (a) { b }", "a.with(1); ({ with: 1 }); class A { with() {} }", "'use strict'; a.with(1, 2)", "import x from 'y' with { type: 'json' }",
        ],
        False: [
            "({ a = 1 })", "f({ a = 1 })", "[{ a = 1 }]", "({ a: { b = 1 } })", "let let = 1", "const let = 1", "break;", "continue;", "switch (a) { case 1: continue }", "function f() { break }", "for (;;) { function f() { break } }", "for (;;) { x(() => { continue }) }", "'use strict'; with (a) { b }", "import x from 'y'\nwith (a) { b }", "export {}; with (a) b",
        ],
    },
}


@pytest.mark.parametrize("language", sorted(BY_SPECIFICATION))
def test_cases_of_the_specification(language):
    for valid, texts in BY_SPECIFICATION[language].items():
        assert not [t for t in texts if (parsers()[language].check(t) is None) != valid]


@pytest.mark.parametrize("language", sorted(GOOD))
def test_valid_texts(language):
    wrong = [(t, parsers()[language].check(t)) for t in GOOD[language] if parsers()[language].check(t)]
    assert not wrong


@pytest.mark.parametrize("language", sorted(BAD))
def test_invalid_texts(language):
    assert not [t for t in BAD[language] if parsers()[language].check(t) is None]


def test_python_agrees_with_the_language():
    for t in GOOD["python"] + BAD["python"]:
        try:
            ast.parse(t)
            valid = True
        except SyntaxError:
            valid = False
        assert (parsers()["python"].check(t) is None) == valid, t


def test_every_prefix_of_python_agrees():
    text = 'import a\n\nclass B:\n    """doc"""\n    def f(self, x=1):\n        if x:\n            return f"{x:>3}" + \'y\'\n        return [i for i in x if i]\n'
    for k in range(len(text) + 1):
        try:
            ast.parse(text[:k])
            valid = True
        except SyntaxError:
            valid = False
        assert (parsers()["python"].check(text[:k]) is None) == valid, text[:k]


def test_place_of_the_error():
    fault = parsers()["python"].check("a = 1\nb = = 2\n")
    assert (fault.line, fault.column) == (2, 5)


def test_ambiguous_grammar_runs_all_readings():
    t = build("s : e\ne : e 'o' e | 'x'")
    x, o = t["terminals"]["'x'"], t["terminals"]["'o'"]
    assert first_error(t, [x] + [o, x] * 30) == -1
    assert first_error(t, [x, o]) == 2 and first_error(t, [x, x]) == 1 and first_error(t, []) == 0


def test_long_and_deep_texts():
    assert parsers()["python"].check("x = [" + "1, " * 50_000 + "]\n") is None
    assert parsers()["javascript"].check("f(" * 5_000 + ")" * 5_000) is None
    assert parsers()["javascript"].check("f(" * 5_000 + ")" * 4_999) is not None
    assert parsers()["rust"].check("fn f() { " + "{" * 3_000 + "}" * 3_000 + " }") is None


SCHEMA = "file_id long, repo string, path string, language string, content string, recorded_at timestamp, valid string, token string"


def test_files(spark):
    import datetime as dt

    t = lambda d: dt.datetime(2025, 1, d)
    rows = [
        (1, "r", "a.py", "x", "x = (", t(1), "v", "t"), (1, "r", "a.py", "x", "x = 1", t(2), "v", "t"), (2, "r", "b.go", None, "", t(1), None, None), (3, "r", "c.py", "py", None, t(1), None, None),
        (4, None, "d.txt", None, "(((", t(1), None, None), (5, "r", None, None, "(((", t(1), None, None), (None, "r", "e.py", None, "(((", t(1), None, None), (6, "q", "e.py", None, "x = 1", t(1), None, None), (6, "q", "e.py", None, "x = (", t(3), None, None),
    ]
    got = check_files(spark.createDataFrame(rows, SCHEMA))
    assert {r.file_id: r.valid for r in got.collect()} == {1: True, 2: False, 3: None, 4: None, 5: None, 6: False}
    rates = {(r.repo, r.language): (r.n_files, r.n_invalid) for r in fault_rates(got).collect()}
    assert rates == {("r", "python"): (1, 0), ("r", "go"): (1, 1), ("q", "python"): (1, 1)}
    assert check_files(spark.createDataFrame([], SCHEMA)).count() == 0
