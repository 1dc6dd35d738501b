"""Scalar functions over events, prompts and models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions.text import extension

# File name parts and change summaries that show an intent.
PATH_SIGNS = {
    "INTENT_TEST": ("test", "spec", "__tests__", ".test.", ".spec."),
    "INTENT_CONFIGURE": ("config", "settings", ".env", "package.json", "requirements.txt", "setup.py"),
    "INTENT_DOCUMENT": ("readme", "docs", ".md", "docstring", "changelog"),
}
SUMMARY_SIGNS = {
    "INTENT_DEBUG": ("fix", "bug", "error", "issue", "broken", "crash", "exception"),
    "INTENT_FEATURE": ("add", "create", "implement", "new", "feature", "function", "method", "class"),
    "INTENT_REFACTOR": ("refactor", "clean", "improve", "optimize", "restructure", "reorganize", "simplify"),
    "INTENT_TEST": ("test", "spec", "assert", "verify", "validate"),
    "INTENT_DOCUMENT": ("document", "comment", "docstring", "readme", "docs"),
}
LANGUAGES = {".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".py": "python", ".java": "java", ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php", ".c": "c", ".cpp": "cpp", ".cs": "csharp", ".md": "markdown", ".json": "json"}


def truthy(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def _any(text: Column, signs: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(s)) for s in signs))


def event_intents(path: Column, summary: Column, added: Column, removed: Column, kind: Column) -> Column:
    """Labels of an event by its file, its summary and its size, each once; INTENT_OTHER if there is none."""
    p, s, a, r = F.lower(F.coalesce(path, F.lit(""))), F.lower(F.coalesce(summary, F.lit(""))), F.coalesce(added, F.lit(0)), F.coalesce(removed, F.lit(0))
    rules = [F.when(_any(p, signs), F.lit(label)) for label, signs in PATH_SIGNS.items()]
    rules += [F.when(_any(s, signs), F.lit(label)) for label, signs in SUMMARY_SIGNS.items()]
    rules += [F.when((a > 30) & (a > r * 1.5), F.lit("INTENT_FEATURE")), F.when((r > a * 2) & (r > 20), F.lit("INTENT_REFACTOR")), F.when(kind.isin("navigate", "search", "goto", "file_open"), F.lit("INTENT_NAVIGATE"))]
    found = F.array_distinct(F.array_compact(F.array(*rules)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("INTENT_OTHER")))


def language(path: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit("text"))


def complexity(text: Column) -> Column:
    """simple, moderate or complex, by words and sentences."""
    words, sentences = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")), F.size(F.filter(F.split(text, r"[.!?]+"), lambda s: F.trim(s) != ""))
    return F.when((words > 100) | (sentences > 5), "complex").when((words > 30) | (sentences > 2), "moderate").otherwise("simple")


def at_files(text: Column) -> Column:
    """Files that a prompt mentions with an at sign, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"@([\w./-]+\.\w+)")))


def fenced_blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?s)```(?:\w*)\n(.*?)```"))


def personal_class(text: Column) -> Column:
    """The first class of personal data or secrets that a value shows."""
    rules = (("EMAIL", r"[\w.+-]+@[\w-]+\.[\w.]+"), ("PHONE", r"\b\d{3}[-.]\d{3}[-.]\d{4}\b"), ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"), ("IP", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"), ("FILEPATH", r"(?:/[\w.-]+){2,}"))
    return reduce(lambda c, r: F.when(text.rlike(r[1]), F.lit(r[0])).otherwise(c), reversed(rules), F.lit(None).cast("string"))


def version_parts(version: Column) -> Column:
    """Numbers of a version, comparable as arrays."""
    return F.transform(F.split(F.regexp_replace(version, "^v", ""), r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))


def when_parsed(text: Column) -> Column:
    """A time from ISO text or epoch milliseconds; null where it is neither."""
    return F.coalesce(F.try_to_timestamp(text), F.timestamp_millis(text.try_cast("long")))


def link_event_type(confidence: Column) -> Column:
    return F.when(confidence.isNull() | (confidence == "none"), "MANUAL_EDIT").when(confidence.isin("high", "medium"), "AI_EDIT").otherwise("UNKNOWN")


def context_usage(tokens: Column, window: Column) -> Column:
    """Per cent of a model's window, at most 100; a window of 200,000 if none is named."""
    return F.least(F.lit(100.0), 100.0 * tokens / F.coalesce(F.nullif(window, F.lit(0)), F.lit(200_000)))


# How a response names files: between backticks, as a path, between quotes.
RESPONSE_FILES = (r"`([^`]+\.[a-zA-Z]+)`", r"\b([a-zA-Z0-9_-]+/[a-zA-Z0-9_/-]+\.[a-zA-Z]+)\b", r"['\"]([^'\"]+\.[a-zA-Z]+)['\"]")


def response_files(text: Column) -> Column:
    """Files that a response names, each once, of 3 to 199 characters."""
    found = F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(p)) for p in RESPONSE_FILES)))
    return F.filter(found, lambda x: F.length(x).between(3, 199))


# Words of a note that show an intent, the first that fits; and topics of notes and paths.
NOTE_INTENTS = (
    ("bug-fix", ("fix", "bug", "error")), ("feature", ("add", "feature", "implement")),
    ("refactor", ("refactor", "clean")), ("optimization", ("optimiz", "performance")),
)
NOTE_TOPICS = ("auth", "api", "database", "ui", "test", "config", "middleware", "route", "component")
PATH_TOPICS = (("authentication", ("auth",)), ("api", ("api",)), ("database", ("db", "database")), ("testing", ("test",)), ("ui", ("component", "ui")))


def _cascade(text: Column, rules: tuple, other: Column) -> Column:
    """The label of the first rule of which a word occurs in the text."""
    return reduce(lambda c, r: F.when(_any(text, r[1]), F.lit(r[0])).otherwise(c), reversed(rules), other)


def event_intent(annotation: Column, path: Column, intent: Column | None = None) -> Column:
    """An event's own intent, or one by its note, or testing by its path, or general."""
    by_path = F.when(_any(F.lower(F.coalesce(path, F.lit(""))), ("test", "spec")), "testing").otherwise("general")
    found = _cascade(F.lower(F.coalesce(annotation, F.lit(""))), NOTE_INTENTS, by_path)
    return found if intent is None else F.coalesce(F.nullif(intent, F.lit("")), found)


def event_topic(annotation: Column, path: Column) -> Column:
    by_path = _cascade(F.lower(F.coalesce(path, F.lit(""))), PATH_TOPICS, F.lit(None).cast("string"))
    return _cascade(F.lower(F.coalesce(annotation, F.lit(""))), tuple((x, (x,)) for x in NOTE_TOPICS), by_path)


def event_files(annotation: Column, path: Column) -> Column:
    """Files of an event: its own, and the first that its note names."""
    named = F.nullif(F.regexp_extract(F.coalesce(annotation, F.lit("")), r"[\w/\-.]+\.(js|tsx|ts|jsx|py|java|go|rs|cpp|c|h|json|yaml|yml)", 0), F.lit(""))
    return F.array_compact(F.array(path, named))


# Parts of an event's type and what they mean, in the order in which they are tried.
LEGACY_TYPES = (
    ("file.create", "CREATE"), ("file.new", "CREATE"), ("file.add", "CREATE"), ("file.rename", "MODIFY"), ("file.move", "MODIFY"), ("file.save", "MODIFY"),
    ("file.delete", "DELETE"), ("file.remove", "DELETE"), ("code_change", "MODIFY"), ("edit", "MODIFY"), ("modify", "MODIFY"), ("update", "MODIFY"),
    ("change", "MODIFY"), ("cursor.inserttext", "MODIFY"), ("cursor.deletetext", "DELETE"), ("cursor.replacetext", "MODIFY"), ("ai.applyedit", "AI_EDIT"),
    ("ai.suggestionaccepted", "AI_ACCEPT"), ("ai.suggestionrejected", "AI_REJECT"), ("prompt", "AI_PROMPT"), ("ai", "AI_INTERACTION"), ("test", "TEST"),
    ("run.test", "TEST"), ("debug", "DEBUG"), ("run.debug", "DEBUG"), ("run", "RUN"), ("execute", "RUN"), ("navigate", "NAVIGATE"), ("search", "SEARCH"),
    ("browse", "NAVIGATE"), ("build", "BUILD"), ("compile", "BUILD"), ("deploy", "DEPLOY"), ("git.commit", "COMMIT"), ("git.push", "PUSH"),
    ("git.pull", "PULL"), ("git.merge", "MERGE"),
)
LEGACY_NOTES = (
    ("CREATE", ("create", "add", "new", "generate")), ("MODIFY", ("modify", "edit", "update", "change", "refactor")), ("DELETE", ("delete", "remove", "drop")),
    ("TEST", ("test", "verify", "check")), ("DEBUG", ("debug", "fix", "error")), ("AI_INTERACTION", ("ai", "prompt", "suggest")),
)


def legacy_symbol(kind: Column, note: Column) -> Column:
    """A symbol by parts of the type, else by words of the note, else the type's last part or first ten letters."""
    low = F.lower(F.coalesce(kind, F.lit("")))
    by_type = _cascade(low, tuple((label, (part,)) for part, label in LEGACY_TYPES), F.lit(None).cast("string"))
    by_note = _cascade(F.lower(F.coalesce(note, F.lit(""))), LEGACY_NOTES, F.lit(None).cast("string"))
    rest = F.when(low == "", "OTHER").when(F.contains(low, F.lit(".")), F.upper(F.element_at(F.split(low, r"\."), -1))).otherwise(F.left(F.upper(low), F.lit(10)))
    return F.coalesce(by_type, by_note, rest)


def described(kind: Column, path: Column, summary: Column, added: Column, removed: Column, prompt: Column) -> Column:
    """What an event seems to be about, in parts joined by bars."""
    a, r = F.coalesce(added, F.lit(0)), F.coalesce(removed, F.lit(0))
    p = F.lower(F.coalesce(path, F.lit("")))
    parts = (
        F.when(F.length(summary) > 10, F.left(summary, F.lit(100))),
        F.when(F.length(prompt) > 5, F.concat(F.lit("prompted: "), F.left(F.lower(prompt), F.lit(200)))),
        F.when(a > 50, "large addition").when(r > a * 2, "major deletion or refactor").when((a > 0) & (r > 0), "modification"),
        _cascade(p, (("test-related", ("test",)), ("configuration", ("config", ".env")), ("documentation", ("readme", ".md"))), F.lit(None).cast("string")),
        _cascade(F.coalesce(kind, F.lit("unknown")), (("creating new file", ("create",)), ("removing file", ("delete",))), F.lit(None).cast("string")),
    )
    return F.coalesce(F.nullif(F.concat_ws(" | ", *parts), F.lit("")), F.lit("general code change"))


def intent_description(annotation: Column, kind: Column, path: Column, summary: Column, added: Column, removed: Column, prompt: Column, extractor=None) -> Column:
    """The note if it says enough, else what an extractor (a function of the event's columns, if given) says, else described()."""
    own = F.when(F.length(annotation) > 5, annotation)
    other = described(kind, path, summary, added, removed, prompt)
    return F.coalesce(own, *([extractor(kind, path, summary)] if extractor else []), other)


# What a file's name says of its domain, and a prompt's words of what is asked, the first that fits.
DOMAINS = (
    ("authentication", ("auth", "login", "user")), ("api", ("api", "endpoint", "route")), ("testing", ("test", "spec")),
    ("ui", ("component", "ui", "view")), ("database", ("db", "database", "model")), ("configuration", ("config", "setting")),
)
STATEMENTS = (
    ("Requested help or guidance", ("how", "help")), ("Requested bug fix or error resolution", ("fix", "error", "bug")),
    ("Requested feature addition or implementation", ("add", "create", "implement")), ("Requested code improvement or refactoring", ("refactor", "improve", "optimize")),
    ("Requested explanation or clarification", ("explain", "what", "why")), ("Requested testing or debugging assistance", ("test", "debug")),
)
WORKFLOWS = (
    ("bug_fixing", ("fix", "error", "bug")), ("feature_implementation", ("add", "create", "implement")),
    ("code_refactoring", ("refactor", "improve")), ("knowledge_seeking", ("explain", "how")),
)


def domain(name: Column) -> Column:
    return _cascade(F.lower(name), DOMAINS, F.lit("code"))


def code_abstract(name: Column, added: Column, removed: Column, chars_added: Column, chars_removed: Column) -> Column:
    """Level 1: the file and how much changed."""
    kb = lambda c: F.concat(F.format_string("%.1f", c / 1024), F.lit("KB"))
    lines = F.when((added > 0) | (removed > 0), F.concat(F.lit(" (+"), added.cast("string"), F.lit("/-"), removed.cast("string"), F.lit(" lines)"))).otherwise("")
    chars = F.when((chars_added > 0) | (chars_removed > 0), F.concat(F.lit(" ("), kb(chars_added), F.lit(" added, "), kb(chars_removed), F.lit(" removed)"))).otherwise("")
    return F.concat(F.lit("Modified "), name, lines, chars)


def code_statement(name: Column, added: Column, removed: Column) -> Column:
    """Level 2: what was done to which domain."""
    large, more, less = added + removed > 50, added > removed * 2, removed > added * 2
    action = F.when(more & large, "added functionality to").when(less & large, "removed code from").when(F.abs(added - removed) < 10, "refactored")
    action = action.when(more, "added code to").when(less, "removed code from").otherwise("modified")
    return F.concat(action, F.lit(" "), domain(name), F.lit(" in "), name)


def code_workflow(name: Column, added: Column, removed: Column) -> Column:
    """Level 3: the kind of work."""
    d = domain(name)
    feature = (added > removed * 2) & (added + removed > 50)
    return F.when(feature, F.concat(F.lit("adding_"), d, F.lit("_feature"))).when(removed > added, F.concat(F.lit("removing_"), d, F.lit("_code"))).otherwise(F.concat(F.lit("modifying_"), d))


def prompt_abstract(text: Column) -> Column:
    """Level 1: the first sentence, or 100 characters."""
    text = F.coalesce(text, F.lit(""))
    first = F.split(text, "[.!?]")[0]
    short = F.concat(F.lit("Short prompt ("), F.length(text).cast("string"), F.lit(" chars)"))
    return F.when(F.length(text) < 20, short).when(F.length(first) < 100, first).otherwise(F.concat(F.substring(text, 1, 100), F.lit("...")))


def prompt_statement(text: Column) -> Column:
    return _cascade(F.lower(F.coalesce(text, F.lit(""))), STATEMENTS, F.lit("AI interaction"))


def prompt_workflow(text: Column) -> Column:
    return _cascade(F.lower(F.coalesce(text, F.lit(""))), WORKFLOWS, F.lit("general_interaction"))


def context_files(text: Column) -> Column:
    """Paths of a prompt's context given as JSON: a list of names or objects, or an object whose attachedFiles, else
    codebaseFiles, else files count. Objects are named by path, else fileName; what has no name is left out."""
    objects = F.from_json(text, "array<struct<path:string,fileName:string>>")
    names = F.from_json(text, "array<string>")
    whole = F.from_json(text, "attachedFiles array<struct<path:string,fileName:string>>, codebaseFiles array<struct<path:string,fileName:string>>, files array<string>")
    path = lambda x: F.coalesce(F.nullif(x["path"], F.lit("")), x["fileName"])
    of = lambda items: F.transform(items, path)

    def named(x: Column) -> Column:
        return F.when(F.startswith(x, F.lit("{")), path(F.from_json(x, "path string, fileName string"))).otherwise(x)

    is_list = F.startswith(F.ltrim(text), F.lit("["))
    has = lambda key: F.get_json_object(text, f"$.{key}").isNotNull()
    found = F.when(is_list, F.coalesce(F.transform(names, named), of(objects))).when(has("attachedFiles"), of(whole["attachedFiles"]))
    found = found.when(has("codebaseFiles"), of(whole["codebaseFiles"])).when(has("files"), F.transform(whole["files"], named))
    return F.coalesce(F.filter(found, lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))
