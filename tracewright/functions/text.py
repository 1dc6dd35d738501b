"""Scalar functions over text, as Column expressions that stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Masks for personal data and secrets, in the order in which they apply.
PII = (
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL]"),
    (r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b", "[NAME]"),
    (r"https?://[^\s<>\"{}|\\^`\[\]]+", "[URL]"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[IP]"),
    (r"\beyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]{20,}\b", "[JWT_TOKEN]"),
    (r"\b[A-Za-z0-9+/]{32,}={0,2}\b", "[SECRET]"),
    (r"\b(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b", "[PHONE]"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]"),
    (r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", "[CREDIT_CARD]"),
)
STRING_LITERALS = (('"[^"]*"', '"[STR]"'), ("'[^']*'", "'[STR]'"), ("`[^`]*`", "`[STR]`"))

# Words by which a text shows an intent, in the order of the labels.
INTENT_WORDS = {
    "INTENT_DEBUG": ("fix", "error", "bug", "debug", "broken", "issue", "problem", "wrong", "crash", "exception"),
    "INTENT_FEATURE": ("add", "create", "implement", "new", "build", "make", "feature", "functionality"),
    "INTENT_REFACTOR": ("refactor", "clean", "improve", "optimize", "restructure", "reorganize", "simplify"),
    "INTENT_TEST": ("test", "verify", "check", "validate", "ensure", "assert", "spec"),
    "INTENT_DOCUMENT": ("document", "comment", "explain", "describe", "docstring", "readme", "docs"),
    "INTENT_EXPLAIN": ("review", "explain", "understand", "what", "how", "why", "analyze", "inspect"),
    "INTENT_NAVIGATE": ("browse", "explore", "find", "search", "look", "navigate", "goto"),
    "INTENT_CONFIGURE": ("config", "setup", "install", "configure", "settings", "preferences"),
    "INTENT_DEPLOY": ("deploy", "release", "publish", "ship", "production", "staging"),
    "INTENT_REVIEW": ("review", "pr", "pull request", "code review", "feedback"),
}
# The single best intent of a prompt, by most words present; the first of equals.
PROMPT_INTENTS = {
    "data_visualization": ("plot", "chart", "graph", "visualize", "matplotlib", "seaborn"),
    "data_analysis": ("analyze", "analysis", "data", "dataset", "pandas", "numpy"),
    "code_implementation": ("implement", "create", "build", "write", "function", "class"),
    "debugging": ("debug", "error", "bug", "fix", "issue", "problem"),
    "optimization": ("optimize", "performance", "speed", "efficient", "improve"),
    "documentation": ("document", "comment", "explain", "readme", "docstring"),
    "testing": ("test", "testing", "unit test", "assert", "verify"),
    "refactoring": ("refactor", "restructure", "reorganize", "clean up"),
}
FILE_TYPES = {".js": "javascript", ".ts": "typescript", ".py": "python", ".rs": "rust", ".go": "go"}


#: What a text must hold for a mask to apply; cheaper to look for than the mask itself.
_NEEDED = {"[EMAIL]": "@", "[URL]": "http", "[JWT_TOKEN]": "eyJ"}
_DIGITS = ("[IP]", "[PHONE]", "[SSN]", "[CREDIT_CARD]")


def redact(text: Column) -> Column:
    """Nine masks, one after the other, each where it may apply."""

    def mask(pattern: str, label: str):
        def put(v: Column) -> Column:
            masked = F.regexp_replace(v, F.lit(pattern), F.lit(label))
            if label in _NEEDED:
                return F.when(F.contains(v, F.lit(_NEEDED[label])), masked).otherwise(v)
            return F.when(v.rlike("[0-9]"), masked).otherwise(v) if label in _DIGITS else masked

        return put

    return F.element_at(reduce(lambda c, m: F.transform(c, mask(*m)), PII, F.array(text)), 1)


def redact_code(code: Column) -> Column:
    """Masks, then [STR] within the quotes of each string literal."""
    return reduce(lambda c, p: F.regexp_replace(c, *map(F.lit, p)), STRING_LITERALS, redact(code))


def sanitize_prompt(text: Column) -> Column:
    masked = F.regexp_replace(F.regexp_replace(text, r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "<EMAIL>"), r"https?://[^\s]+", "<URL>")
    return F.when(F.length(masked) > 2000, F.concat(F.substring(masked, 1, 2000), F.lit("...<truncated>"))).otherwise(F.coalesce(masked, F.lit("")))


def canonical_symbol(kind: Column) -> Column:
    """EV_ and six digits of the sha1 of the type's first part; EV_OTHER for an empty part."""
    head = F.trim(F.element_at(F.split(F.lower(F.coalesce(F.when(kind != "", kind), F.lit("other"))), r"[._/\\-]+"), 1))
    return F.when(head == "", F.lit("EV_OTHER")).otherwise(F.concat(F.lit("EV_"), F.substring(F.sha1(head), 1, 6)))


def _lowered(text: Column, f) -> Column:
    """f of the lower-cased text, which is made once however often f uses it."""
    return F.element_at(F.transform(F.array(F.lower(text)), f), 1)


def intents(text: Column) -> Column:
    """All labels of which a word occurs in the text, or INTENT_OTHER alone."""

    def labels(low: Column) -> Column:
        found = F.array_compact(F.array(*(F.when(reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words)), F.lit(label)) for label, words in INTENT_WORDS.items())))
        return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("INTENT_OTHER")))

    return _lowered(text, labels)


def prompt_intent(text: Column) -> Column:
    """The label of most words present, the first of equals; general if there is none."""

    def label(low: Column) -> Column:
        scores = F.array(*(F.struct(reduce(lambda a, b: a + b, (F.contains(low, F.lit(w)).cast("int") for w in words)).alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("label")) for i, (name, words) in enumerate(PROMPT_INTENTS.items())))
        best = F.array_max(scores)
        return F.when(best["n"] > 0, best["label"]).otherwise("general")

    return _lowered(text, label)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def file_type(path: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in FILE_TYPES.items() for x in kv))
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit("other"))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(.)\.[^.]*$", "$1")


def depth(path: Column) -> Column:
    return F.size(F.filter(F.split(path, "/"), lambda p: p != ""))


def anonymous_path(path: Column) -> Column:
    """The last three parts of a longer path."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 3, F.concat(F.lit("<workspace>/"), F.array_join(F.slice(parts, F.size(parts) - 2, 3), "/"))).otherwise(path)


def file_id(path: Column) -> Column:
    """FILE_ and the base-36 absolute value of the signed 32-bit hash h * 31 + c over the characters."""
    codes = F.transform(F.split(path, ""), lambda c: F.ascii(c).cast("long"))
    wrapped = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(1 << 32)))
    signed = F.when(wrapped >= 1 << 31, wrapped - (1 << 32)).otherwise(wrapped)
    return F.concat(F.lit("FILE_"), F.lower(F.conv(F.abs(signed).cast("string"), 10, 36)))


def size_bucket(lines: Column) -> Column:
    return F.when(lines < 100, F.lit("small")).when(lines < 500, F.lit("medium")).otherwise(F.lit("large"))


def net_diff(before: Column, after: Column, threshold: int = 10) -> Column:
    """Struct: lines and characters gained or lost on balance, and whether the change is significant."""
    b, a = F.coalesce(before, F.lit("")), F.coalesce(after, F.lit(""))
    chars = F.length(a) - F.length(b)
    lines = F.size(F.split(a, "\n")) - F.size(F.split(b, "\n"))
    zero = F.lit(0)
    return F.struct(F.greatest(zero, lines).alias("lines_added"), F.greatest(zero, -lines).alias("lines_removed"), F.greatest(zero, chars).alias("chars_added"), F.greatest(zero, -chars).alias("chars_deleted"), (F.abs(chars) >= threshold).alias("significant"))


def token_estimate(text: Column) -> Column:
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.ceil((words * 1.3 + F.length(text) / 4) / 2)


def strip_history(line: Column) -> Column:
    """A zsh history line without its time stamp."""
    return F.regexp_replace(line, r"^: \d+:\d+;", "")


def paths_in(command: Column) -> Column:
    """File paths named in a command, each once."""
    return F.array_distinct(F.regexp_extract_all(command, F.lit(r"([\w./-]+\.[A-Za-z]{1,5})\b"), F.lit(1)))


def csv_cell(value: Column) -> Column:
    """A value in a comma-separated file: line ends spelt out, quoted if it holds a quote or a comma; null is empty."""
    flat = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"\r?\n", r"\\n")
    return F.when(flat.rlike('[",]'), F.concat(F.lit('"'), F.replace(flat, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(flat)


# Kinds of a line of code, the first that fits.
LINE_KINDS = (
    (r"^\s*if\s*\(|^\s*elif\s+|^\s*else\s*:", "IfStatement"),
    (r"^\s*for\s+|^\s*foreach\s+", "ForStatement"),
    (r"^\s*(function|def|fn|const\s+\w+\s*=\s*\(|let\s+\w+\s*=\s*\(|var\s+\w+\s*=\s*\()", "FunctionDeclaration"),
    (r"^\s*(import|from|require|using|include)", "ImportDeclaration"),
    (r"^\s*return\s+", "ReturnStatement"),
    (r"^\s*\w+\s*[=:]", "AssignmentExpression"),
    (r"\w+\s*\(", "CallExpression"),
)


def line_kind(line: Column) -> Column:
    """Kind of a trimmed line of code; null for blanks, comments and all else."""
    found = reduce(lambda c, x: F.when(line.rlike(x[0]), F.lit(x[1])).otherwise(c), reversed(LINE_KINDS), F.lit(None).cast("string"))
    return F.when((line != "") & ~line.startswith("//") & ~line.startswith("#"), found)
