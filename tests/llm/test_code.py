"""Problems 2, 5 and 7 on small fixtures."""

import ast
import os
import warnings

import pytest

from lodestrand.llm import docpairs, handwritten, lexing, syntax

GOOD = {
    "a.py": "import os\n\n@dec(1)\nasync def f(a, *, b: int = 2, **k) -> None:\n    '''doc'''\n    async with a as b, c:\n        return [x async for x in y if x]\n\nclass A(B, metaclass=M):\n    x: int = 1\n    def g(self): return lambda *a: (yield)\n\nmatch x:\n    case [1, *rest] if rest:\n        pass\n    case {'k': v} | A(y=2):\n        pass\ntype T[X] = list[X]\nprint(f'{x!r:>{w}}', end='')\nx = y if z else w\nif (n := 3) > 2: pass\nelse:\n\tpass\ndel a[1:2, ::3]\ntry:\n    pass\nexcept* (A, B) as e:\n    raise X from e\nfinally:\n    pass\n",
    "b.js": "import a, { b as c } from './x';\nexport default class extends B { #p = 1; static async *gen() { yield* this.#p } get x() { return 1 } }\nlet {q, ...r} = await f(`t ${x}`)\nconst g = async ({a = 1}, [b]) => a?.b ?? c\nfor (const [k, v] of m) if (k) continue; else break\nvar re = /[/\"]+/g.test(s) / 2\nlabel: do { i++ } while (i < 3)\na = b\n++c\nexport { g as default2 }\n",
    "c.ts": "import type { A } from './a'\ninterface P<T extends object = {}> extends Q { readonly x?: T[]; f(a: number): void; [k: string]: unknown }\ntype U<T> = T extends (infer R)[] ? R : keyof T | 'lit'\nexport abstract class C<T> implements P<T> { constructor(private readonly a: Map<string, Array<number>>) { super() } abstract m(): asserts x is T\n  declare y: string; static #z?: number = 1 }\nenum E { A = 1, B }\nconst f = <T,>(x: T): x is T => x!.y as unknown as T\nfunction o(a: string): void\nfunction o(a: any) { return a satisfies object }\nnamespace N { export const x = f<number>(1) }\n",
    "d.go": "package main\n\nimport (\n\t\"fmt\"\n\tm \"math\"\n)\n\ntype S[T any] struct {\n\tA, B int `json:\"a\"`\n\tfmt.Stringer\n}\n\nfunc (s *S[T]) F(a int, b ...string) (x int, err error) {\n\tif v, ok := m[a]; ok && v > 1 {\n\t\treturn v, nil\n\t} else if x := 2; x > 1 {\n\t}\n\tfor i := range []int{1, 2} {\n\t\tgo func() { ch <- i }()\n\t}\n\tswitch t := y.(type) {\n\tcase int, *S[int]:\n\tdefault:\n\t}\n\tselect {\n\tcase <-c:\n\t}\n\treturn\n}\n",
    "E.java": "package a.b;\nimport static x.Y.*;\n@A(v = {1, 2})\npublic final class E<T extends Comparable<T> & X> extends B<T> implements C {\n  private final Map<String, List<? super T>> m = new HashMap<>();\n  enum K { A { void f() {} }, B(1); K() {} }\n  record R(int a, String... b) { R { } }\n  @Override public <U> int f(final int[] a, U u) throws X {\n    for (var x : a) { if (x > 1) continue; }\n    int y = (int) a[0] + (u instanceof String s ? s.length() : 0);\n    Runnable r = () -> System.out.println(\"x\");\n    switch (y) { case 1, 2 -> { } default -> throw new X(); }\n    try (var z = open()) { } catch (A | B e) { } finally { }\n    return List.<T>of().stream().map(String::valueOf).toList().size() >> 2;\n  }\n}\n",
}
BAD = {
    "a.py": ["def f(:\n    pass\n", "x = 'a\n", "if x\n    pass\n", "def f():\n", "<<<<<<< HEAD\nx = 1\n", "def f():\n    a\n     b\n", "x = (1,\n", "a b\n", "print 1\n", "x = 0b12\n", "return = 1\n"],
    "b.js": ["function f( {\n", "let x = ;\n", "class A { f() { }\n", "if (a {\n}\n", "x = 'a\n", "const a: number = 1\n", "if (a)\n", "for (let i = 0; i < 3) {}\n", "=======\n", "interface A {}\n", "a = `b\n", "function {{x}}(y) {}\n", "return x +\n"],
    "c.ts": ["function f(a: ) {}\n", "class A { x: number\n", "type = 1 2\n", "let x: = 2\n", "interface A { x: number\n", "def f(): pass\n"],
    "d.go": ["package a\nfunc f( {\n}\n", "func f() {}\n", "package a\nvar x = \"a\n", "package a\nfunc f() {\n", "package a\nx := 1\n", "package a\nfunc f() int\nif x {\n}\n", "package a;\nclass A {}\n"],
    "E.java": ["class A {\n", "class A { int f( { } }\n", "class A { void f() { int x = ; } }\n", "class A { void f() { x } }\n", "function f() {}\n", "class A { String s = \"a; }\n", "class A { void f() { 1 + 2; } }\n"],
}


@pytest.mark.parametrize("path", GOOD)
def test_valid_files_parse(path):
    check = syntax.checker(syntax.language_of(path))
    for text in (GOOD[path], GOOD[path].replace("\n", "\r\n"), "\ufeff" + GOOD[path], GOOD[path] * (1 if path[0] in "dE" else 40)):
        assert check.error_line(text) == 0
    if path == "a.py":
        ast.parse(GOOD[path])


@pytest.mark.parametrize("path", BAD)
def test_broken_files_are_flagged(path):
    check = syntax.checker(syntax.language_of(path))
    for text in BAD[path]:
        assert check.error_line(text) > 0, text
        if path == "a.py":
            with warnings.catch_warnings(), pytest.raises(SyntaxError):
                warnings.simplefilter("ignore")
                ast.parse(text)


def test_truncation_is_flagged_and_empty_is_valid():
    check = syntax.checker("typescript")
    text = GOOD["c.ts"].replace("\n", "\n")
    assert check.error_line(text[: text.index("unknown }") + 3]) > 0
    assert all(syntax.checker(k).error_line("") == (0 if k in ("python", "javascript", "typescript", "java") else 1) for k in ("python", "javascript", "typescript", "go"))


def test_forgetting_known_lines_changes_nothing(monkeypatch):
    check = syntax.Checker("javascript")
    before = [check.error_line(t) for t in [GOOD["b.js"], *BAD["b.js"]]]
    monkeypatch.setattr(check.recogniser, "LINES", 0)
    assert [check.error_line(t) for t in [GOOD["b.js"], *BAD["b.js"]]] == before


def frames(spark, texts):
    files = spark.createDataFrame([(k, 1, p, None, n) for k, (p, t, n) in enumerate(texts)], "id bigint, project_id bigint, path string, content string, line_count int")
    contents = spark.createDataFrame([(k, 9, t, n != -1, "clash") for k, (p, t, n) in enumerate(texts)], "file_id bigint, project_id bigint, content string, supported boolean, path string")
    return files, contents


def test_checked_table(spark):
    files, contents = frames(spark, [("a.py", "x = 1\n", 1), ("b.py", "x = (\n", 1), ("c.py", None, 1), ("d.py", "(", -1), ("e.md", "(", 1), (None, "(", 1), ("f.JS", "", 1), ("deep/g.ts", "let a: = 1", None)])
    got = {r.file_id: (r.language, r.valid, r.error_line) for r in syntax.checked(files, contents).collect()}
    assert got == {0: ("python", True, None), 1: ("python", False, 1), 6: ("javascript", True, None), 7: ("typescript", False, 1)} or got[1][1] is False and set(got) == {0, 1, 6, 7}
    assert syntax.checked(files.limit(0), contents).count() == 0


@pytest.mark.parametrize("text", ["/** TODO */", "# noqa", "...", "getUserName", "Gets the user name.", "// eslint-disable-next-line", "/**\n * @param a\n * @param b\n */", "x = y(1)\nreturn x", "-----\nget user name\n-----", "n/a", "FIXME missing docs, fill in later", "", None, "Description goes here", "{@inheritDoc}", "Args:\n    a: int"])
def test_comments_that_tell_nothing(text):
    assert not docpairs.tells(text, "getUserName")


@pytest.mark.parametrize("text", ["Null if absent.", "/** Walks the tree from the leaves. */", "# TODO speed this up. Caches at most ten rows.", "Возвращает имя или ничего.", "Gets the user name, cached for an hour.", "noqa: E501\nRetries twice."])
def test_comments_that_tell(text):
    assert docpairs.tells(text, "getUserName")


PY = 'class A:\n    # Walks all leaves.\n    @cache\n    def a(self,\n          x="# no: comment"):\n        return 1\n\n    # Not for b, as a blank line follows.\n\n    def b(self): return 2\n\n    def c(self) -> Dict[str, int]:\n        # first\n        """Sums what is left."""\n'
JS = "/* licence */\n\n/**\n * Sums {braces} and \"quotes\".\n */\nexport function one(a) {\n  if (a) { return '}'; }\n}\nconst s = \"// not a comment\";\nfunction two() {}\n// Retries twice.\n// Then fails.\nconst three = (a) => {\n  return `}`;\n};\n"


def test_documentation_in_the_source():
    py, js = docpairs.Source(PY, "py"), docpairs.Source(JS, "js")
    assert "Walks all leaves" in py.documentation(3) and "Walks all leaves" in py.documentation(4)
    assert py.documentation(10) == "" and "Sums what is left" in py.documentation(12)
    assert [n for n, _ in js.functions()] == ["one", "two", "three"]
    assert "Sums" in js.documentation(6) and js.documentation(10) == "" and "Retries twice" in js.documentation(13)
    assert (js.end_line(6), js.end_line(10), js.end_line(13), py.end_line(4)) == (8, 10, 15, 6)


def test_lexer_is_a_state_machine():
    def strings(text, language="js"):
        return [text[a:b] for a, b in lexing.Lexed(text, language).strings]

    def comments(text, language="js"):
        return [text[a:b] for a, b in lexing.Lexed(text, language).comments]

    assert comments("x = `a ${ f(`b // no ${ c /* yes */ }`) } // no`; // yes") == ["/* yes */", "// yes"]
    assert comments("if (ok) /['\"//]/.test(y); // yes") == ["// yes"] and comments("a = b / c; d = '/* no'; // yes") == ["// yes"]
    assert comments("let r = x\n  .map(v => v / 2) / 3 // yes") == ["// yes"] and comments("return /[/]\\/\"/g // yes") == ["// yes"]
    assert strings("s = 'it\\'s' + \"a\nb\"") == ["'it\\'s'", '"a', '"']
    assert comments("x = 'open\n# yes", "py") == ["# yes"] and strings('f = rb"""a # no\n"""', "py") == ['rb"""a # no\n"""']
    assert comments("s := `raw \\` // yes", "go") == ["// yes"] and comments("/* open", "go") == ["/* open"]
    lexed = lexing.Lexed("`${ {a: `${1}`} }` + {b}", "js")
    assert [c for _, c in lexed.brackets] == ["{", "}", "{", "}"]


@pytest.mark.parametrize("text", ["x", "asdf", "qwerty", "blah blah", "foo bar baz", "a", "zzz", "This function is the get user name function. Name: getUserName.", "hmm hmm hmm"])
def test_noise_tells_nothing(text):
    assert not docpairs.tells(text, "getUserName")


@pytest.mark.parametrize("text", ["Idempotent.", "O(n) in size", "Null if cold.", "SQL only", "Лениво.", "返回用户", "Never blocks."])
def test_short_words_tell(text):
    assert docpairs.tells(text, "getUserName")


def test_many_symbols_on_one_line(spark, monkeypatch):
    monkeypatch.setattr(docpairs, "CHUNK", 10)
    symbols = spark.createDataFrame([(k, 1, "a.js", f"f{k}", "function", "f()", 1, "Keeps the oldest entry.") for k in range(200)] + [(500 + k, None, None, "g", "method", None, None, "Keeps the oldest entry.") for k in range(20)], "id bigint, file_id bigint, file_path string, name string, kind string, signature string, line int, comment string")
    contents = spark.createDataFrame([(1, "x" * 100), (None, "y")], "file_id bigint, content string")
    groups = docpairs._by_file(symbols, contents).collect()
    assert sum(len(g.symbols) for g in groups) == 220 and max(len(g.symbols) for g in groups) < 40
    assert docpairs.documented_symbols(symbols, contents).count() == 220


def test_documented_symbols(spark):
    files, contents = frames(spark, [("a.py", PY, 1), ("b.js", JS.replace("\n", "\r\n"), 1), ("c.js", None, 1)])
    rows = [(1, 0, "a.py", "a", "method", 4, None), (2, 0, "a.py", "b", "method", 10, ""), (3, 1, "b.js", "one", "function", 6, "todo"), (3, 1, "b.js", "one", "function", 6, "todo"), (4, 1, "b.js", "two", "function", 999, None), (5, 2, "c.js", "x", "function", 1, "Frees the lock."), (6, 77, None, None, "FUNCTION", None, "Frees the lock."), (7, 1, "b.js", "K", "class", 6, "Frees the lock."), (8, None, None, "n", "function", -3, None), (None, 1, "b.js", "one", "function", 6, "Frees it.")]
    symbols = spark.createDataFrame([(*r, "sig", "clash") for r in rows], "id bigint, file_id bigint, file_path string, name string, kind string, line int, comment string, signature string, content string")
    got = {r.symbol_id: r.documentation for r in docpairs.documented_symbols(symbols, contents).collect()}
    assert set(got) == {1, 3, 5, 6} and got[5] == "Frees the lock."
    assert docpairs.documented_symbols(symbols.limit(0), contents).count() == 0
    assert {(r.file_id, r.name) for r in docpairs.extracted_functions(files, contents).collect()} == {(0, "a"), (0, "c"), (1, "one"), (1, "three")}


@pytest.mark.parametrize("path,text,what", [
    ("a.go", "// Code generated by x. DO NOT EDIT.\npackage a\n", "generated"), ("a.go", "package a\r\n\r\n// Generiert mit x. Nicht bearbeiten.\r\n", "generated"), ("x/vendor/p/a.md", "text", "copied"), ("x/vendors/a.py", "x = 1", None),
    ("lib/a.js", "/*!\n * Imported verbatim from x 1.2.3; send patches there.\n */\nf()", "copied"), ("a.js", "/* x 1.2 */\nvar a=1", "minified"), ("gen/a.py", "x = 1", "built"), ("a_pb2.py", "x = 1", "built"),
    ("a.py", "# The role is auto-generated elsewhere, here we only read it.\n", None), ("a.py", "# Writes generated files; this module itself is maintained by hand.\n", None), ("generators/a.py", "# Do not edit the order of the steps below.\n", None), ("a.txt", "Code generated by x", None), ("", "", None)])
def test_notices(path, text, what):
    assert handwritten.notice(path, text) == what


def test_forest_finds_what_is_not_marked(spark):
    hand = lambda k: f"# Notes on step {k}.\n\ndef step_{k}(rows, limit):\n    total = {k}\n    for row in rows:\n        if row > limit:\n            total += row * {k % 7}\n    return total\n\n\ndef other_{k}(name):\n    \"\"\"Says hello {k} times.\"\"\"\n    return name + '{k}'\n"
    made = lambda k: "".join(f"def _get_f{k}_{n}(message):\n    return message.fields[{n}]\n\n" for n in range(20))
    texts = [(f"src/m{k}.py", hand(k), 12) for k in range(120)]
    texts += [(f"src/g{k}.py", ("# @generated by tool\n" if k % 2 else "") + made(k), None) for k in range(40)]
    texts += [("src/blob.py", 't = "' + "aB3/9xZq+" * 200 + '"\n', 0), ("src/null.py", None, 1), (None, "x = 1\n", 1), ("src/empty.py", "", 0)]
    files, contents = frames(spark, texts)
    got = {r.file_id for r in handwritten.not_handwritten(files, contents).where("not handwritten").collect()}
    assert set(range(120, 161)) <= got and not got & set(range(120))
    only = handwritten.not_handwritten(files.where("id < 5"), contents).collect()
    assert len(only) == 5 and all(r.handwritten and r.score is None for r in only)
    assert handwritten.not_handwritten(files.limit(0), contents).count() == 0


# The interpreter's own parser says which of these are valid.
SNIPPETS = ['f"{"a"}"\n','f"{1 +}"\n','def f(a=1, b): pass\n','f(a=1, 2)\n','(a, b) += 1\n','if x:\n\ty\n        z\n','if x:\n        y\n\tz\n','f"{x!r:>{w}}"\n',"f'{a:{b}.{c}}' f'' 'x'\n",'f"{x=}"\n','f"{x = !r:^20}"\n','f"{{}}"\n','f"{{{x}}}"\n','f"}"\n','f"{}"\n','f"{x"\n','f"""\n{x\n}\n"""\n','f"{f"{f"{1}"}"}"\n','x = f"{a[\'b\']}" + f\'{d["k"]:>{n}}\'\n','f"{lambda x: 1}"\n','f"{(lambda x: 1)}"\n','f"{x:=5}"\n','f"{a != b}"\n','f"{a!x}"\n','f"{yield}"\n','f"{*a, b}"\n','rf"\\{x}\\d"\n','fr"{x}\\""\n','f(*a, b)\n','f(**k, *a)\n','f(**k, a=1)\n','f(**k, 1)\n','f(x for x in y)\n','f(x for x in y, 1)\n','def f(*, a): pass\n','def f(*): pass\n','def f(a, /, b=1, *c, d, **e): pass\n','def f(a=1, /, b=2): pass\n','def f(**k, a): pass\n','lambda a=1, b: 0\n','lambda *a, b, **c: 0\n','a.b += 1\n','a[1] += 1\n','(a) += 1\n','[a] += 1\n','f() += 1\n','class A(B, metaclass=M, **k): pass\n','print(f"{x:{"a"}}")\n','f"{x:%H:%M}"\n','f"{d[\'a:b\']}"\n','f"{x:}"\n','f"\\N{EM DASH}"\n','f"{x}" "{" f"{y}"\n','def f(a, b=1, c): pass\n','if x:\n\tif y:\n\t\tz\n\tw\n', 'bf"x"\n','x = 1 if f"{a}" else 2\n', "f'a\n'\n", 'f"{a:{b:{c}}}"\n','f"{a:{b!r}}"\n', "print(f'{', '.join(a)}')\n"]
SCRIPTS = [("x = `x ${ `y` } z`;\n",True),("if (ok) /re/.test(y);\n",True),("`${ 1 + }`\n",False),("let let = 1\n",False),("`a ${ {b: `c ${d}`}.b } e` + 1\n",True),("`${a} ${b}`\n",True),("`${a ${b}`\n",False),("`${}`\n",False),("while (x) /a\\/b/g.exec(s)\n",True),("(a) / b / c\n",True),("f(x) / 2\n",True),("`a\n${b}\nc`\nd()\n",True),("x = `a${b\n",False),("tag`x ${y}`\n",True),("const let = 1\n",False),("a.let = 1; b = {let: 1, static: 2}\n",True),("class A { static static() {} static x = 1; let() {} }\n",True),("x = y /* a */ / 2\n",True), ("`${ a => { return `b` } }`\n",True),("for (let i of `${x}`) {}\n",True)]


@pytest.mark.parametrize("text", SNIPPETS)
def test_python_snippets(text):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
            valid = True
        except SyntaxError:
            valid = False
    assert (syntax.checker("python").error_line(text) == 0) == valid


@pytest.mark.parametrize(("text", "valid"), [*SCRIPTS, ("const re =\n  /a\\/b/i\n", True), ("f(\n   /x/, 2)\n", True), ("x = a\n  / b\n", True)])
@pytest.mark.parametrize("language", ["javascript", "typescript"])
def test_script_snippets(text, valid, language):
    assert (syntax.checker(language).error_line(text) == 0) == valid


def test_typescript_templates_and_optional_parameters():
    assert syntax.checker("typescript").error_line("type A = `a${B | 'x'}c${number}`\nclass C { constructor(readonly a?: string, b?: T) {} }\n") == 0


def test_the_standard_library_is_valid():
    folder = os.path.dirname(ast.__file__)
    for name in sorted(os.listdir(folder))[:120]:
        if name.endswith(".py"):
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                assert syntax.checker("python").error_line(f.read()) == 0, name
