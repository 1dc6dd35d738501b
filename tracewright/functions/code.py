"""Functions over source code: tokens, functions, calls, imports and edit scripts, as Column expressions; what needs a
Python parse goes through Arrow-batched pandas UDFs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Keywords and operators of the generic tokenizer.
KEYWORDS = (
    "function", "def", "class", "const", "let", "var", "if", "else", "for", "while", "return", "import", "export", "from",
    "async", "await", "try", "catch", "throw", "new", "this", "super", "extends", "implements",
)
OPERATORS = (
    "=", "==", "===", "!=", "!==", "<", ">", "<=", ">=", "+", "-", "*", "/", "%",
    "&&", "||", "!", "++", "--", "+=", "-=", "*=", "/=", "?", "??", "?.", "=>",
)
# Prefixes in the order in which the line tokenizer tries them, and their tokens.
PREFIXES = {
    "function": "FUNCTION", "const": "CONST", "let": "LET", "var": "VAR", "if": "IF", "else": "ELSE", "for": "FOR", "while": "WHILE", "return": "RETURN", "import": "IMPORT", "export": "EXPORT", "class": "CLASS", "async": "ASYNC", "await": "AWAIT", "try": "TRY", "catch": "CATCH", "throw": "THROW", "new": "NEW", "this": "THIS", "super": "SUPER", "extends": "EXTENDS", "implements": "IMPLEMENTS", "interface": "INTERFACE", "type": "TYPE", "enum": "ENUM", "namespace": "NAMESPACE", "module": "MODULE", "def": "DEF", "lambda": "LAMBDA", "yield": "YIELD", "with": "WITH", "from": "FROM", "as": "AS", "default": "DEFAULT",
    "=": "ASSIGN", "+": "PLUS", "-": "MINUS", "*": "MULTIPLY", "/": "DIVIDE", "%": "MODULO", "==": "EQUAL", "===": "STRICT_EQUAL", "!=": "NOT_EQUAL", "!==": "STRICT_NOT_EQUAL", "<": "LESS", ">": "GREATER", "<=": "LESS_EQUAL", ">=": "GREATER_EQUAL", "&&": "AND", "||": "OR", "!": "NOT", "++": "INCREMENT", "--": "DECREMENT", "+=": "PLUS_ASSIGN", "-=": "MINUS_ASSIGN", "*=": "MULTIPLY_ASSIGN", "/=": "DIVIDE_ASSIGN", "?": "TERNARY", "??": "NULLISH", "?.": "OPTIONAL_CHAIN",
    "(": "LPAREN", ")": "RPAREN", "[": "LBRACKET", "]": "RBRACKET", "{": "LBRACE", "}": "RBRACE", ",": "COMMA", ";": "SEMICOLON", ":": "COLON", ".": "DOT", "...": "SPREAD", "=>": "ARROW",
}
# What names a function, and words before a bracket that are no calls.
FUNCTION_NAMES = (r"function\s+(\w+)", r"def\s+(\w+)", r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(", r"class\s+(\w+)")
NO_CALLS = ("if", "for", "while", "switch", "catch", "function", "return", "typeof")
IMPORTS = (r"import\s+.*?from\s+['\"]([^'\"]+)['\"]", r"require\(['\"]([^'\"]+)['\"]\)", r"(?m)^\s*import\s+([^\s;]+)", r"(?m)^\s*from\s+(\S+)\s+import")


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|/&" else c for c in text)


def padded(n: Column, digits: int = 3) -> Column:
    """A number with zeros before it up to so many digits; longer ones whole."""
    return F.when(n < 10**digits, F.lpad(n.cast("string"), digits, "0")).otherwise(n.cast("string"))


def lines(code: Column) -> Column:
    """Trimmed lines without blanks and comments."""
    return F.filter(F.transform(F.split(code, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~F.startswith(x, F.lit("//")) & ~F.startswith(x, F.lit("#")))


def generic_tokens(code: Column) -> Column:
    """Per line: words as keywords or IDENTIFIER, runs of signs, at most one STRING_LITERAL and one NUMBER."""
    words = lambda x: F.transform(F.regexp_extract_all(x, F.lit(r"\b([a-zA-Z_][a-zA-Z0-9_]*)\b")), lambda w: F.when(F.lower(w).isin(*KEYWORDS), F.upper(w)).otherwise("IDENTIFIER"))

    def sign(s: Column) -> Column:
        named = F.replace(F.replace(s, F.lit("="), F.lit("ASSIGN")), F.lit("+"), F.lit("PLUS"))
        return F.when(s.isin(*OPERATORS), named).when(s.isin("(", ")", "()"), "PAREN").when(s.isin("[", "]", "[]"), "BRACKET").when(s.isin("{", "}", "{}"), "BRACE").otherwise("OPERATOR")

    signs = lambda x: F.transform(F.regexp_extract_all(x, F.lit(r"([{}()\[\].,;:+\-*/=<>!&|?]+)")), sign)
    literal = lambda x: F.when(x.rlike("[\"'`]"), F.array(F.lit("STRING_LITERAL"))).otherwise(F.array().cast("array<string>"))
    number = lambda x: F.when(x.rlike(r"\d"), F.array(F.lit("NUMBER"))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(lines(code), lambda x: F.concat(words(x), signs(x), literal(x), number(x))))


def line_tokens(code: Column) -> Column:
    """Greedy prefix tokens: the first listed keyword or sign that a place begins with, else a string, number or name.
    One alternation in that order finds the same tokens, leftmost first."""
    pattern = "(" + "|".join([*map(_quoted, PREFIXES), r"\"[^\"]*\"", r"'[^']*'", "`[^`]*`", r"\d+(?:\.\d+)?", r"[A-Za-z_$][\w$]*"]) + ")"
    known = F.create_map(*(F.lit(x) for kv in PREFIXES.items() for x in kv))

    def name(m: Column) -> Column:
        return F.coalesce(F.try_element_at(known, m), F.when(m.rlike("^[\"'`]"), "STRING_LITERAL").when(m.rlike(r"^\d"), "NUMBER").otherwise("IDENTIFIER"))

    return F.transform(F.flatten(F.transform(F.split(code, "\n"), lambda x: F.regexp_extract_all(F.trim(x), F.lit(pattern)))), name)


def numbered(tokens: Column) -> Column:
    """Identifiers numbered by what stands before them: FUNC_ after FUNCTION or DEF, CLASS_ after CLASS, NEW, EXTENDS and
    their like, VAR_ after CONST, LET and VAR, else ID_. Type words use up a VAR_ number as well."""
    kinds = {"FUNC": ("FUNCTION", "DEF"), "CLASS": ("CLASS",), "TYPE": ("NEW", "EXTENDS", "IMPLEMENTS", "INTERFACE", "TYPE", "ENUM"), "VAR": ("CONST", "LET", "VAR")}
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("last"), *(F.lit(0).alias(k) for k in ("f", "c", "v", "i")))

    def step(s: Column, t: Column) -> Column:
        name = t == "IDENTIFIER"
        is_ = {k: name & s["last"].isin(*words) for k, words in kinds.items()}
        cls = is_["CLASS"] | is_["TYPE"]
        other = name & ~is_["FUNC"] & ~cls & ~is_["VAR"]
        label = lambda p, n: F.concat(F.lit(p), padded(n))
        out = F.when(is_["FUNC"], label("FUNC_", s["f"])).when(cls, label("CLASS_", s["c"])).when(is_["VAR"], label("VAR_", s["v"])).when(other, label("ID_", s["i"])).otherwise(t)
        return F.struct(F.concat(s["out"], F.array(out)).alias("out"), t.alias("last"), (s["f"] + is_["FUNC"].cast("int")).alias("f"), (s["c"] + cls.cast("int")).alias("c"), (s["v"] + (is_["VAR"] | is_["TYPE"]).cast("int")).alias("v"), (s["i"] + other.cast("int")).alias("i"))

    return F.aggregate(tokens, start, step, lambda s: s["out"])


def function_names(code: Column) -> Column:
    return F.array_distinct(F.concat(*(F.regexp_extract_all(code, F.lit(p)) for p in FUNCTION_NAMES)))


def calls(line: Column) -> Column:
    return F.filter(F.regexp_extract_all(line, F.lit(r"(\w+)\s*\(")), lambda n: ~n.isin(*NO_CALLS))


def imports(code: Column) -> Column:
    """Imported paths that name a file: those that begin with a dot or slash or hold a slash."""
    found = F.array_distinct(F.concat(*(F.regexp_extract_all(code, F.lit(p)) for p in IMPORTS)))
    return F.filter(found, lambda p: F.startswith(p, F.lit(".")) | F.contains(p, F.lit("/")))


def change_style(adds: Column, removes: Column, changes: Column) -> Column:
    kinds = (adds > 0).cast("int") + (removes > 0).cast("int") + (changes > 0).cast("int")
    return F.when(kinds > 1, "mixed").when(adds > 0, "add").when(removes > 0, "delete").otherwise("modify")


def model_family(name: Column) -> Column:
    """Provider of a model by its name."""
    rules = (("gpt|o1|davinci|openai", "openai"), ("gemini|palm|bard", "google"), ("llama|mistral|mixtral|deepseek|qwen", "open"))
    return reduce(lambda c, r: F.when(F.lower(name).rlike(r[0]), F.lit(r[1])).otherwise(c), reversed(rules), F.lit("unknown"))


@pandas_udf(T.ArrayType(T.StringType()))
def python_names(code):
    """Functions and classes of Python code, outermost first; none where it does not parse."""
    import ast

    def names(text):
        try:
            tree = ast.parse(text or "")
        except (SyntaxError, ValueError, RecursionError):
            return []
        return [n.name for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]

    return code.map(names)


@pandas_udf(T.LongType())
def operation_count(code):
    """Operators, calls and comparisons of Python code; 0 where it does not parse."""
    import ast

    def count(text):
        try:
            tree = ast.parse(text or "")
        except (SyntaxError, ValueError, RecursionError):
            return 0
        return sum(isinstance(n, (ast.BinOp, ast.UnaryOp, ast.BoolOp, ast.Compare, ast.Call)) for n in ast.walk(tree))

    return code.map(count)


@pandas_udf(T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("text", T.StringType())])))
def line_changes(before, after):
    """Inserted and deleted lines between two texts."""
    import difflib

    import pandas as pd

    def changed(a, b):
        out = []
        for x in difflib.ndiff((a or "").split("\n"), (b or "").split("\n")):
            if x[:2] in ("+ ", "- "):
                out.append({"kind": "insert" if x[0] == "+" else "delete", "line": len(out), "text": x[2:]})
        return out

    return pd.Series([changed(a, b) for a, b in zip(before, after, strict=True)])


# What begins a function in each language; the first pattern that fits a trimmed line names it.
DEFINITIONS = {
    "javascript": (
        r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(",
        r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\(",
        r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?function\s*\(",
        r"^\s*(\w+)\s*:\s*(?:async\s+)?\(",
        r"^\s*(\w+)\s*:\s*(?:async\s+)?function\s*\(",
    ),
    "typescript": (
        r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*[<\(]",
        r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*[:=]\s*(?:async\s+)?\(",
        r"^\s*(?:export\s+)?(?:public|private|protected)?\s*(?:async\s+)?(\w+)\s*\(",
    ),
    "python": (r"^\s*(?:async\s+)?def\s+(\w+)\s*\(", r"^\s*class\s+(\w+)\s*\("),
    "java": (r"^\s*(?:public|private|protected)?\s*(?:static)?\s*(?:\w+\s+)?(\w+)\s*\(",),
    "go": (r"^\s*func\s+(?:\w+\.)?(\w+)\s*\(",),
    "rust": (r"^\s*(?:pub\s+)?fn\s+(\w+)\s*\(",),
}
# Patterns of the simple extractor, and of imports by language.
SIMPLE_DEFINITIONS = {"javascript": r"^\s*(?:function|const|let|var)\s+(\w+)\s*[=\(]", "python": r"^\s*def\s+(\w+)\s*\("}
LINE_IMPORTS = {
    "javascript": (r"import\s+.*?\s+from\s+['\"](.+?)['\"]", r"require\(['\"](.+?)['\"]\)", r"import\(['\"](.+?)['\"]\)"),
    "typescript": (r"import\s+.*?\s+from\s+['\"](.+?)['\"]", r"import\s+['\"](.+?)['\"]"),
    "python": (r"^import\s+(\S+)", r"^from\s+(\S+)\s+import"),
}
# The edit that a new node of a kind is; other kinds are MODIFY_ and their name.
OPERATIONS = {
    "IfStatement": "ADD_IF_CONDITION", "ForStatement": "ADD_LOOP", "WhileStatement": "ADD_LOOP", "FunctionDeclaration": "ADD_FUNCTION",
    "ImportDeclaration": "ADD_IMPORT", "ExportDeclaration": "ADD_EXPORT", "ReturnStatement": "ADD_RETURN",
    "AssignmentExpression": "MODIFY_ASSIGNMENT", "CallExpression": "ADD_CALL", "ClassDeclaration": "ADD_CLASS",
    "TryStatement": "ADD_TRY", "CatchClause": "ADD_CATCH",
}
RESOLVED_SUFFIXES = (".js", ".ts", ".jsx", ".tsx", ".json", ".py")


def _first_group(line: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in patterns))


def definition(line: Column, language: Column) -> Column:
    """Name of the function that a line begins, by the patterns of its language (those of JavaScript for others); else null."""
    line = F.trim(line)
    others = _first_group(line, DEFINITIONS["javascript"])
    return reduce(lambda c, x: F.when(language == x[0], _first_group(line, x[1])).otherwise(c), DEFINITIONS.items(), others)


def simple_definition(line: Column, language: Column) -> Column:
    js, py = (F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in SIMPLE_DEFINITIONS.values())
    return F.when(language.isin("javascript", "typescript"), js).when(language == "python", py)


def line_imports(line: Column, language: Column) -> Column:
    """Paths that a line imports, in the order of the patterns of its language."""
    none = F.array().cast("array<string>")
    found = {k: F.concat(*(F.regexp_extract_all(line, F.lit(p)) for p in v)) for k, v in LINE_IMPORTS.items()}
    return F.coalesce(reduce(lambda c, x: F.when(language == x[0], x[1]).otherwise(c), found.items(), none), none)


def operation(kind: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in OPERATIONS.items() for x in kv))
    return F.coalesce(F.try_element_at(known, kind), F.concat(F.lit("MODIFY_"), F.upper(kind)))


def normal_path(path: Column) -> Column:
    """A path without empty, . and .. parts; .. beyond the root stays away."""
    def step(done: Column, part: Column) -> Column:
        return F.when(part.isin("", "."), done).when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def hidden_literals(tokens: Column) -> Column:
    """Strings as <STR> and numbers as <NUM>."""
    return F.transform(tokens, lambda t: F.when(t == "STRING_LITERAL", "<STR>").when(t == "NUMBER", "<NUM>").otherwise(t))


def counted_names(tokens: Column, most: int = 200) -> Column:
    """The first tokens, identifiers as ID_001, ID_002 and so on."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(1).alias("n"))

    def step(s: Column, t: Column) -> Column:
        name = t == "IDENTIFIER"
        return F.struct(F.concat(s["out"], F.array(F.when(name, F.concat(F.lit("ID_"), padded(s["n"]))).otherwise(t))).alias("out"), (s["n"] + name.cast("int")).alias("n"))

    return F.slice(F.aggregate(tokens, start, step, lambda s: s["out"]), 1, most)


@pandas_udf(T.ArrayType(T.StructType([T.StructField("line", T.IntegerType()), T.StructField("params", T.IntegerType()), T.StructField("returns", T.StringType())])))
def signatures(code, language):
    """Per line of the text its signature: parameters and return type, read ahead for ten lines at most by counting brackets."""
    import re

    import pandas as pd

    def read(lines, at, kind):
        text, braces, parens, params, inside = "", 0, 0, 0, False
        for line in lines[at : at + 10]:
            text += line + "\n"
            for c in line:
                inside = inside or c == "("
                parens += (c == "(") - (c == ")")
                braces += (c == "{") - (c == "}")
                if c == ")" and inside and not parens:
                    own = re.search(r"\(([^)]*)\)", text)
                    params = sum(bool(p.strip()) for p in own[1].split(",")) if own and own[1].strip() else params
                    break
            if inside and not parens and braces > 0:
                break
        found = re.search(r":\s*(\w+)", text, re.ASCII) if kind in ("typescript", "java") else None
        return {"line": at + 1, "params": params, "returns": found[1] if found else "unknown"}

    def all_of(text, kind):
        lines = (text or "").split("\n")
        return [read(lines, k, kind) for k in range(len(lines))]

    return pd.Series([all_of(c, k) for c, k in zip(code, language, strict=True)])


@pandas_udf(T.ArrayType(T.StringType()))
def syntax_tokens(code):
    """Kinds of the nodes of Python code, outermost first; null where it does not parse."""
    import ast

    one = {ast.Name: ["IDENTIFIER"], ast.Call: ["CALL"], ast.Attribute: ["ATTRIBUTE"], ast.Assign: ["ASSIGN"], ast.If: ["IF"], ast.For: ["FOR"]}
    one |= {ast.While: ["WHILE"], ast.Return: ["RETURN"], ast.Import: ["IMPORT"], ast.ImportFrom: ["IMPORT", "FROM"]}
    one |= {ast.FunctionDef: ["FUNCTION", "IDENTIFIER"], ast.ClassDef: ["CLASS", "IDENTIFIER"]}

    def kinds(node):
        if isinstance(node, ast.Constant):  # truth values count as numbers
            return ["STRING_LITERAL"] if isinstance(node.value, str) else ["NUMBER"] if isinstance(node.value, (int, float)) else []
        if isinstance(node, ast.Name) and isinstance(node.ctx, ast.Del):
            return []
        return one.get(type(node), [])

    def tokens(text):
        try:
            tree = ast.parse(text or "")
        except (SyntaxError, ValueError, RecursionError):
            return None
        return [k for n in ast.walk(tree) for k in kinds(n)]

    return code.map(tokens)


def code_tokens(code: Column, language: Column) -> Column:
    """Tokens by the language: Python by its syntax, all else and what does not parse by the generic tokenizer."""
    python = syntax_tokens(F.when(language == "python", code).otherwise(F.lit("(")))
    return F.coalesce(python, generic_tokens(code))


@pandas_udf(T.DoubleType())
def similarity(before, after):
    """Characters in common, in order, over the length of the longer text; 1 for two empty ones. The longest common
    subsequence is counted by the bits of one number, whole texts at a time."""
    import pandas as pd

    def common(a, b):
        if len(a) < len(b):
            a, b = b, a
        where, full = {}, (1 << len(a)) - 1
        for k, c in enumerate(a):
            where[c] = where.get(c, 0) | 1 << k
        row = full
        for c in b:
            hit = row & where.get(c, 0)
            row = (row + hit | row - hit) & full
        return len(a) - row.bit_count()

    def ratio(a, b):
        a, b = a or "", b or ""
        return common(a, b) / max(len(a), len(b)) if a or b else 1.0

    return pd.Series([ratio(a, b) for a, b in zip(before, after, strict=True)])
