import ast

import pytest

from codeloom.llm import lexing, syntax

PYTHON = r'''#!/usr/bin/env python
"""Doc with <<<<<<< HEAD inside."""
from __future__ import annotations
import os, sys as s
from a.b import (c as d,
                 e)
from . import x

@app.route("/x", methods=["GET"])
class A(B, metaclass=M):
    """Doc."""
    y: int = 3

    async def f(self, a, *args, b=1, **kw) -> "T":
        async with open(a) as g, h():
            pass
        for i, (j, k) in enumerate([1, 2]):
            yield i
        else:
            z = lambda q, w=2: q + w
        try:
            return await self.g(*args, **kw)[1:2, ::3]
        except (E, F) as err:
            raise G from err
        finally:
            del a.b[c]
        x = {k: v for k, v in y.items() if not k}
        t = f"a{b!r:>{c}}" "more" r'\d'
        if a < b <= c is not None and d not in e: return
        elif x := f(1): ...
        while True: break
        print("a" if b else "c", end='')
        return \
            1

match x:
    case [a, b] if a > 1:
        pass
    case {"k": v} | None:
        pass
global_ = [i async for i in x]
assert a, "m"; a += 1
'''
JAVASCRIPT = """import a, { b as c } from "./x.js";
export default class A extends B.C {
  #p = 1;
  static async *gen() { yield* this.x(); }
  get v() { return `t${this.#p + `n${1}`}`; }
  constructor({ a, b = 2 }, ...rest) { super(a); }
}
const f = async (x) => { for await (const y of x) { if (y) continue; else break } };
var g = function (a) { return a ? b : { c: 1, [d]: 2, e() {}, ...f } }, h;
let re = /[/"'{(]+/g.test(s), n = a / b / c
do { i++ } while (i < 3)
switch (x) { case 1: y(); break; default: z() }
try { a() } catch { b() } finally { c() }
label: for (const k in o) { continue label }
const obj = { a, b, 'c': d, 1: 2 }
export { f, g as k };
"""
TYPESCRIPT = """interface P<T> extends Q { readonly a?: string; b(x: number): void; [k: string]: any }
type U = A | B[] | { c: number };
enum E { A = 1, B }
export abstract class S<T extends object> implements I {
  private items: Map<string, any> = new Map();
  constructor(private readonly a: string, public b?: number) {}
  public async get(x: any[], y: Record<string, number> = {}): Promise<T> { const z = x as any; return this.items.get(z)!; }
}
function g(this: any, cb: any): any { let v: number = 1; return cb; }
const h = (a: any, b: any): any => a;
"""
JAVA = """package a.b;
import java.util.*;
import static x.Y.z;
@Deprecated
public final class A<T extends B> extends C<T> implements D, E {
    private static final Map<String, List<T>> M = new HashMap<>();
    int[] a = { 1, 2 }, b[];
    char c = '\\'', d = '}';
    static { M.clear(); }
    public <R> R f(final int x, String... y) throws IOException, F {
        for (int i = 0, j = 1; i < x; i++) { if (x > 1 && y != null) continue; else a[i] += (int) 2.5; }
        for (String s : y) System.out.println("}" + s);
        try (Reader r = open()) { r.read(); } catch (IOException | RuntimeException e) { throw e; } finally { done(); }
        switch (x) { case 1: break; default: return null; }
        Runnable q = () -> { run(); };
        Object o = new Object() { public String toString() { return "x"; } };
        do { x--; } while (x > 0);
        return cond ? this.<R>g() : (R) o;
    }
    enum G { X(1), Y { void m() {} }; G() {} G(int i) {} }
    @interface N { int value() default 1; }
    abstract static class H { abstract void m(); }
}
"""
GO = """// c
package main

import (
	"fmt"
	m "math"
)

const (
	A = iota
	B
)

type S struct {
	a, b int `json:"a"`
	*T
	f func(int) (string, error)
}

type I interface {
	M(x int) error
}

func (s *S) M(xs ...int) (n int, err error) {
	if v, ok := s.m["k"]; ok && v > 1 {
		return v, nil
	} else if !ok {
		panic("x")
	}
	for i := 0; i < 3; i++ {
		n += i
	}
	for _, x := range xs {
		go func() { ch <- x }()
	}
	switch t := y.(type) {
	case int, string:
		fmt.Println(t)
	default:
	}
	z := map[string][]int{"a": {1, 2}, "b": nil}
	_ = []byte(`raw {`)
	p := &S{a: 1}
	defer p.close()
	return
}
"""
VALID = [
    ("python", PYTHON), ("javascript", JAVASCRIPT), ("typescript", TYPESCRIPT), ("typescript", JAVASCRIPT), ("java", JAVA), ("go", GO),
    ("json", '{"a": [1, -2.5e3, true, null, {"b": "\\u00e9 <<<<<<< x"}], "c": {}}'), ("json", "3"), ("python", ""), ("javascript", "\n"), ("typescript", ""), ("java", "  "),
    ("python", "\ufeffx = 1\r\n"), ("javascript", "// only\n/* comments */"), ("python", "x = 1\n    # odd comment\n"),
]
BROKEN = [
    ("python", "def f(x):\n"), ("python", "  x = 1\n"), ("python", "x = 'abc\n"), ("python", "if a\n  b\n"), ("python", "try:\n    x\n"), ("python", "x = (1,\n"), ("python", "<<<<<<< HEAD\nx = 1\n"),
    ("python", "x = 5ab3"), ("python", "the tree walks"), ("python", "const x = 1;"), ("python", '"""open'), ("python", "x = [1)"), ("python", "class A:\n    def f(self):\n        x\n   y"), ("python", "@a\nx = 1"),
    ("javascript", "function f() {"), ("javascript", "}\nf();"), ("javascript", "let x = 'a\n'"), ("javascript", "return 1;"), ("javascript", "const x;"), ("javascript", "var x: number = 1;"), ("javascript", "class A { private x; }"),
    ("javascript", "x = 1\n=======\ny = 2"), ("javascript", "# Title\n\nSome words here."), ("javascript", "f(a: any);"), ("javascript", "let a = ;"), ("javascript", "<!DOCTYPE html>\n<html></html>"), ("javascript", "`open ${x}"),
    ("typescript", "function f(x: any {"), ("typescript", "package main\n\nimport (\n)\n"), ("java", "public class A { void f() { int x = 1 } }"), ("java", "class A { String s = \"open; }"), ("java", "class A {"), ("java", "def f(): pass"),
    ("go", ""), ("go", "func main() {}"), ("go", "package main\nfunc f() {\n\tx := 1\n"), ("go", "package main\nlet x = 1;\nlet y = 2"), ("go", "package main\n>>>>>>> x\n"), ("json", ""), ("json", "{'a': 1}"), ("json", '{"a": 1,}'), ("json", "[1] 2"), ("json", '{"a": NaN}'), ("json", '["a\n"]'),
]


@pytest.mark.parametrize(("language", "text"), VALID)
def test_valid(language, text):
    assert lexing.problem(language, text) is None


@pytest.mark.parametrize(("language", "text"), BROKEN)
def test_broken(language, text):
    assert lexing.problem(language, text)


def test_truncated_python_agrees_with_the_parser():
    wrong = []
    for n in range(0, len(PYTHON), 3):
        for text in (PYTHON[:n], PYTHON[n:]):
            try:
                ast.parse(text)
                ok = True
            except (SyntaxError, ValueError):
                ok = False
            if ok != (lexing.problem("python", text) is None):
                wrong.append((n, ok))
    assert len(wrong) <= 0.03 * len(PYTHON) / 3 * 2, wrong[:10]


def test_long_and_deep_texts_end():
    assert lexing.problem("javascript", "f(" * 3000 + ")" * 3000) is None
    assert lexing.problem("python", "x = [" + "1, " * 200_000 + "]\n") is None
    assert lexing.problem("java", "class A { int x = " + "1 + " * 20_000 + "1; }") is None
    assert lexing.problem("go", "package a\n" + "var x = 1\n" * 20_000) is None


def test_many_distinct_names_stay_bounded():
    # More short names than the table of token classes holds, as a worker meets in a large input.
    names = [f"v{i}" for i in range(200_300)]
    assert lexing.problem("python", f"a = [{', '.join(names)}]\n") is None
    assert len(lexing._PY_CLASS) <= 200_000
    assert lexing._PY_WORDS.items() <= lexing._PY_CLASS.items()
    assert lexing.problem("python", PYTHON) is None
    assert lexing.problem("python", "def f(:\n    pass\n")


def test_table(spark):
    rows = [("r", "a.py", "x = 1"), ("r", "b.py", "x = ("), ("r", "b.py", "x = ("), ("r", "c.md", "("), ("r", "d.json", None), ("q", "e.py", None), ("q", "f.PY", "(")]
    df = spark.createDataFrame(rows, "repo_id string, file_path string, content string")
    assert {(r.repo_id, r.file_path) for r in syntax.unparsable(df).collect()} == {("r", "b.py"), ("r", "d.json"), ("q", "f.PY")}
    rates = {(r.repo_id, r.language): (r.files, r.unparsable, r.rate) for r in syntax.syntax_rates(df).collect()}
    assert rates == {("r", "python"): (2, 1, 0.5), ("r", "json"): (1, 1, 1.0), ("q", "python"): (2, 1, 0.5)}
    assert syntax.syntax_rates(df.limit(0)).count() == 0
