"""Scalar functions against plain Python, on awkward inputs."""

import re

import pytest
from pyspark.sql import functions as F

from tracewright.functions import code as C
from tracewright.functions import text as X

TEXTS = [
    "", None, "mail John Smith at john.smith@example.co.uk or https://a.b/c?d=1 now", "10.0.0.1 and 555-123-4567, 123-45-6789", "card 4111 1111 1111 1111", "eyJabc.eyJdef.ABCDEFGHIJKLMNOPQRSTUV",
    "key QWERTYUIOPASDFGHJKLZXCVBNM1234567890== end", "Stteä Zürich Über Alles", "fix the bug and add a new test", "plain",
]


def col(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_redaction_matches_python(spark):
    def python(t):
        for pattern, mask in X.PII if t else ():
            t = re.sub(pattern, mask, t)
        return t

    ascii_only = [t for t in TEXTS if t is None or t.isascii()]
    assert col(spark, ascii_only, X.redact) == [python(t) for t in ascii_only]
    assert col(spark, ["x = \"secret\" + 'b' + `c\nd`"], X.redact_code) == ['x = "[STR]" + \'[STR]\' + `[STR]`']


def test_symbols(spark):
    got = col(spark, ["code_change", None, "_x", "", "CODE.thing"], X.canonical_symbol)
    assert got[0] == got[4] == "EV_e6fb06" and got[2] == "EV_OTHER" and got[1] == got[3] and got[1].startswith("EV_")


def test_intents(spark):
    def python(t):
        found = [k for k, w in X.INTENT_WORDS.items() if any(x in (t or "").lower() for x in w)]
        return found or ["INTENT_OTHER"]

    assert col(spark, TEXTS, X.intents) == [python(t) for t in TEXTS]
    assert col(spark, ["fix a bug", "nothing", "plot a chart of data", None], X.prompt_intent) == ["debugging", "general", "data_visualization", "general"]


def test_file_ids(spark):
    def python(p):
        h = 0
        for c in p:
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        h = abs(h - (1 << 32) if h >> 31 else h)
        digits = ""
        while True:
            digits = "0123456789abcdefghijklmnopqrstuvwxyz"[h % 36] + digits
            h //= 36
            if not h:
                return "FILE_" + digits

    paths = ["src/a.py", "b", "a/very/long/path/to/some/file_name.tsx"]
    assert col(spark, paths, X.file_id) == [python(p) for p in paths]


def test_paths(spark):
    paths = ["src/m1/f.test.py", "README", "a/.env"]
    assert col(spark, paths, X.stem) == ["f.test", "README", ".env"]
    assert col(spark, paths, X.basename) == ["f.test.py", "README", ".env"]
    assert col(spark, paths, X.dirname) == ["src/m1", "", "a"]
    assert col(spark, ["x.PY", "x.rs", "x", None], X.file_type) == ["python", "rust", "other", "other"]
    assert col(spark, ["/u/me/w/src/a.py", "a/b"], X.anonymous_path) == ["<workspace>/w/src/a.py", "a/b"]


@pytest.mark.parametrize(("line", "kind"), [("if (x):", "IfStatement"), ("for x in y", "ForStatement"), ("def f(x):", "FunctionDeclaration"), ("from x import y", "ImportDeclaration"), ("return x", "ReturnStatement"), ("x = 1", "AssignmentExpression"), ("foo(1)", "CallExpression"), ("# x = 1", None), ("", None), ("else", None)])
def test_line_kinds(spark, line, kind):
    assert col(spark, [line], X.line_kind) == [kind]


def test_line_tokens(spark):
    got = col(spark, ["a == b", "x => y", "format", "default", "'s' 12", ""], C.line_tokens)
    assert got == [["IDENTIFIER", "ASSIGN", "ASSIGN", "IDENTIFIER"], ["IDENTIFIER", "ASSIGN", "GREATER", "IDENTIFIER"], ["FOR", "IDENTIFIER"], ["DEF", "IDENTIFIER"], ["STRING_LITERAL", "NUMBER"], []]


def test_generic_tokens(spark):
    assert col(spark, ['def f(x):\n  // no\n  y = "s" + 12'], C.generic_tokens) == [["DEF", "IDENTIFIER", "IDENTIFIER", "PAREN", "OPERATOR", "IDENTIFIER", "IDENTIFIER", "ASSIGN", "PLUS", "STRING_LITERAL", "NUMBER"]]


def test_numbering(spark):
    tokens = ["DEF", "IDENTIFIER", "IDENTIFIER", "CLASS", "IDENTIFIER", "CONST", "IDENTIFIER", "NEW", "IDENTIFIER", "VAR", "IDENTIFIER"]
    assert col(spark, [tokens], C.numbered, "array<string>") == [["DEF", "FUNC_000", "ID_000", "CLASS", "CLASS_000", "CONST", "VAR_000", "NEW", "CLASS_001", "VAR", "VAR_002"]]


def test_names_calls_and_imports(spark):
    code = "import a from './x/y'\nfrom lib import z\nfunction foo(a) { return bar(a) }\nconst g = (x) => 1\nclass K"
    assert col(spark, [code], C.function_names) == [["foo", "g", "K"]]
    assert col(spark, ["if (a(b)) c (d)"], C.calls) == [["a", "c"]]
    assert "./x/y" in col(spark, [code], C.imports)[0]
    assert col(spark, ["def a():\n  def b(): pass\nclass C: pass", "def (", None], C.python_names) == [["a", "C", "b"], [], []]
    assert col(spark, ["a + b * f(c)", "x ==", ""], C.operation_count) == [3, 0, 0]
