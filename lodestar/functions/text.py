"""Text functions as column expressions. Null text counts as empty unless a function says otherwise."""

from __future__ import annotations

import sys
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a query.
STOP_WORDS = """
a an the of to in on at for from by with into onto as is are was were be been being it its this that these those
and or not no do does did how what where when why which who whom whose there here can could should would will
i we you they he she my our your their me us them if then than so such just also very about
""".split()

# Endings that a stem does without, in turn, and what is kept of a match (digits are groups).
ENDINGS = [("^(.{2,})ies$", "1y"), ("^(.{3,})(?:ing|ed)$|^(.{2,}[^s])s$", "12"), ("^(.{4,})e$", "1")]

# Patterns of identifiers, of dotted names and what file names end in, of citations and sentence ends.
DOTTED = "(?U)\\b([A-Za-z_]\\w*(?:\\.[A-Za-z_]\\w*)+)\\b"
FILE_ENDING = "\\.(py|md|txt|com|org)$"
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"
PARTS = "[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+"
CITATION = "[\\[`]([^\\[\\]`\\s]+?\\.\\w+):([0-9]+)(?:-([0-9]+))?[\\]`]"
RANGE_CITATION = "[\\[`]([^\\[\\]`\\s]+?\\.\\w+):([0-9]+)-([0-9]+)[\\]`]"
WIDE_CITATION = "【\\s*([^【】\\s]+?\\.\\w+:[0-9]+(?:-[0-9]+)?)\\s*】"
SENTENCE_END = "(?<=[.!?])\\s+(?=[A-Z\\[`*(-])|\\n+"
REFUSAL = (
    "(?i)couldn.?t find (this|that|it|any)|could not find (this|that|it|any)|"
    "not (present|found|shown) in the (retrieved|provided) (code|excerpts)|"
    "(excerpts|retrieved code) (do|does) not (contain|show|include)"
)
# Backticked words that are syntax, not names.
NOT_NAMES = "None True False self cls str int dict list bool bytes def class return raise if else for in and or not".split()
# Wording that asks for what a symbol uses, or for what uses it.
CALLEE_WORDING = "(?i)\\bdoes\\b.*\\b(call|calls|use|uses|invoke|depend|depends|rely)\\b"
CALLER_WORDING = (
    "(?i)\\b(calls?|called|callers?|uses?|used|usages?|invok\\w*|depend\\w*|breaks?|impact\\w*|affect\\w*|referenc\\w*|"
    "protected|wrapped|decorated|subclass\\w*|inherit\\w*)\\b"
)
# What keys look like and what replaces them; list marks before a search; repository addresses; import statements;
# what a Windows path may not hold.
HIDDEN_KEY = "[API key hidden]"
KEY = "gsk_[A-Za-z0-9]{8,}|sk-[A-Za-z0-9_-]{8,}"
LIST_MARK = "(?i)^\\s*(?:[-*•]|[0-9]+[.):]|line\\s*[0-9]+\\s*:)\\s*"
REPOSITORY = "^https://github\\.com/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+?)(?:\\.git)?/?$"
IMPORT = "(?m)^\\s*(?:from\\s+\\S+\\s+)?import\\s+(.+)$"
WINDOWS_BAD = '[<>:"|?*\\\\\\x00-\\x1f]'
WINDOWS_RESERVED = "(?i)^(con|prn|aux|nul|com[0-9]|lpt[0-9])(\\..*)?$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _text(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def lines(text: Column | str) -> Column:
    """Lines as universal newlines part them, without an empty last one. Empty text: no line."""
    t = _text(text)
    ends = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
    body = F.regexp_replace(t, f"(?:{ends})\\z", "")
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(body, ends, -1))


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


@cache
def _capitals() -> tuple[str, str]:
    """Characters that have a capital, and their capitals: one character each, so that ß is ẞ and ligatures stay."""
    found = {}
    for c in map(chr, range(sys.maxunicode + 1)):
        if c.upper() != c:
            one = [x for x in (c.upper(), c.title()) if len(x) == 1]
            found[c] = one[0] if one else c
    found["ß"] = "ẞ"
    kept = {c: u for c, u in found.items() if u != c}
    return "".join(kept), "".join(kept.values())


def capitals(text: Column | str) -> Column:
    """Null or a text in capitals, character by character as in SQL's ``upper``; Spark's writes ß as two letters."""
    return F.translate(text, *_capitals())


def stem(token: Column) -> Column:
    """Plural and verb endings off, then a closing e: decode, decoded and decoding meet."""
    for ending, kept in ENDINGS:
        token = F.regexp_replace(token, ending, "".join(f"${x}" if x.isdigit() else x for x in kept))
    return token


def parts(word: Column) -> Column:
    """Lower-case words of a snake_case or camelCase identifier."""
    return F.transform(_all(word, PARTS), F.lower)


def tokens(text: Column | str, drop_stop_words: bool = False) -> Column:
    """Stemmed search tokens, repeats kept: each identifier whole and, if it has several parts, its parts too."""

    def spread(word: Column) -> Column:
        def both(p: Column) -> Column:
            low = F.lower(word)
            return F.when((F.size(p) > 1) | word.contains("_"), F.concat(F.array(low), F.filter(p, lambda x: x != low))).otherwise(F.array(low))

        # most words are one part, which a pattern tells sooner than their parts
        return F.when(word.rlike("^(?:[A-Z]?[a-z]+|[A-Z]+)$"), F.array(F.lower(word))).otherwise(let(parts(word), both))

    found = F.flatten(F.transform(_all(_text(text), IDENTIFIER), spread))
    kept = F.filter(found, lambda t: (F.length(t) >= 2) & (~t.isin(STOP_WORDS) if drop_stop_words else F.lit(True)))
    return F.transform(kept, stem)


def hashing_tokens(text: Column | str) -> Column:
    """Tokens of the hashing embedder: each identifier in lower case and every part of more than one character."""
    both = lambda w: F.concat(F.array(F.lower(w)), F.filter(parts(w), lambda p: F.length(p) > 1))
    return F.flatten(F.transform(_all(_text(text), IDENTIFIER), both))


def identifier_terms(question: Column | str) -> Column:
    """The words of a question that look like code, in lower case and sorted.

    snake_case, camelCase, backticked words, dotted names (which hide their parts) and a single bare word count.
    """
    q = _text(question)
    words = _all(q, IDENTIFIER)
    ticked = _all(q, "`([A-Za-z_][A-Za-z0-9_.]*)`", 1)
    dotted = F.filter(F.array_distinct(_all(F.replace(q, F.lit("`"), F.lit("")), DOTTED, 1)), lambda d: ~d.rlike(FILE_ENDING))
    inner = F.flatten(F.transform(dotted, lambda d: F.split(d, "\\.")))
    looks = lambda w: F.regexp_replace(w, "^_+|_+$", "").contains("_") | w.rlike("[a-z0-9][A-Z]") | F.array_contains(ticked, w)
    plain = F.filter(words, lambda w: looks(w) & ~F.array_contains(inner, w))
    single = F.filter(ticked, lambda t: ~t.contains("."))
    lone = F.when(F.size(words) == 1, words).otherwise(F.array().cast("array<string>"))
    return F.sort_array(F.array_distinct(F.transform(F.concat(plain, single, dotted, lone), F.lower)))


def module_name(path: Column | str) -> Column:
    """Dotted module of a source path."""
    p = F.regexp_replace(F.regexp_replace(_text(path), "\\.py$", ""), "\\.ipynb$", "")
    p = F.regexp_replace(F.regexp_replace(p, "^src/", ""), "/__init__$", "")
    return F.replace(p, F.lit("/"), F.lit("."))


def approx_tokens(text: Column | str) -> Column:
    """About how many model tokens a text takes: a quarter of its characters, plus one."""
    return F.floor(F.length(_text(text)) / 4).cast("int") + 1


def normalize_citations(text: Column | str) -> Column:
    """Citations in full-width brackets rewritten with square ones."""
    return F.regexp_replace(_text(text), WIDE_CITATION, "[$1]")


def citations(text: Column | str, pattern: str = CITATION) -> Column:
    """array<struct<path, first, last>> of [path:first-last] or [path:first], in order."""

    def row(x: Column) -> Column:
        got = lambda g: F.regexp_extract(x, f"^(?:{pattern})$", g)
        last = F.when(got(3) == "", got(2)).otherwise(got(3))
        return F.struct(got(1).alias("path"), got(2).cast("long").alias("first"), last.cast("long").alias("last"))

    return F.transform(_all(_text(text), pattern), row)


def sentences(text: Column | str) -> Column:
    """Trimmed, non-empty sentences and lines."""
    return F.filter(F.transform(F.split(_text(text), SENTENCE_END, -1), strip), lambda s: s != "")


def claimed_names(sentence: Column | str) -> Column:
    """Names in backticks that a claim is about, reduced to what the code would contain; repeats kept."""
    spans = F.filter(_all(_text(sentence), "`([^`\\n]+)`", 1), lambda s: ~F.concat(F.lit("`"), s, F.lit("`")).rlike(f"^(?:{CITATION})$") & ~s.endswith(".py") & ~s.endswith(".md"))
    names = F.transform(spans, lambda s: F.element_at(F.split(strip(F.element_at(F.split(s, "\\(", -1), 1)), "\\.", -1), -1))
    return F.filter(names, lambda n: n.rlike("^[A-Za-z_][A-Za-z0-9_]*$") & (F.length(n) >= 3) & ~n.isin(NOT_NAMES))


def is_refusal(text: Column | str) -> Column:
    return _text(text).rlike(REFUSAL)


def intent(question: Column | str) -> Column:
    """callees, callers or related."""
    q = _text(question)
    return F.when(q.rlike(CALLEE_WORDING), "callees").when(q.rlike(CALLER_WORDING), "callers").otherwise("related")


def imported_names(text: Column | str) -> Column:
    """Names that import statements bring into a file."""
    lists = _all(_text(text), IMPORT, 1)
    items = F.flatten(F.transform(lists, lambda x: F.split(F.translate(x, "()", "  "), ",", -1)))
    words = F.filter(F.transform(items, strip), lambda x: x != "")
    return F.array_distinct(F.transform(words, lambda x: F.element_at(F.split(F.element_at(F.split(x, "\\s+", -1), -1), "\\.", -1), -1)))


def rewrites(answer: Column | str, most: int = 3) -> Column:
    """Search queries listed in a model's answer, one a line: bullets, numbers and quotes off, repeats out, the first ``most``."""
    def clean(x: Column) -> Column:
        q = strip(F.regexp_replace(x, LIST_MARK, ""))
        q = F.regexp_replace(F.regexp_replace(q, '^"+|"+$', ""), "^`+|`+$", "")
        return strip(q)

    found = F.filter(F.transform(lines(answer), clean), lambda q: F.length(q) >= 3)
    new = lambda acc, q: F.when(F.exists(acc, lambda o: F.lower(o) == F.lower(q)), acc).otherwise(F.array_append(acc, q))
    return F.slice(F.aggregate(found, F.array().cast("array<string>"), new), 1, most)


def scrub_keys(message: Column | str, key: Column | str | None = None) -> Column:
    """API keys hidden: the given one and anything that looks like one."""
    m = _text(message)
    if key is not None:
        k = _text(key)
        m = F.when(k == "", m).otherwise(F.replace(m, k, F.lit(HIDDEN_KEY)))
    return F.regexp_replace(m, KEY, HIDDEN_KEY)


def slug(text: Column | str) -> Column:
    """An id of at most 60 characters in lower case; "repo" if nothing is left."""
    cut = F.regexp_replace(F.regexp_replace(F.lower(_text(text)), "[^a-z0-9_-]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(cut, 1, 60), F.lit("")), F.lit("repo"))


def repository_name(url: Column | str) -> Column:
    """owner/name of a repository address, null if it is none."""
    u = strip(_text(url))
    return F.when(u.rlike(REPOSITORY), F.concat_ws("/", F.regexp_extract(u, REPOSITORY, 1), F.regexp_extract(u, REPOSITORY, 2)))


def gold_name(path: Column | str) -> Column:
    """Short name of a gold set's file."""
    p = F.replace(_text(path), F.lit("\\"), F.lit("/"))
    return F.regexp_replace(F.regexp_replace(p, "^eval/", ""), "\\.jsonl$", "")


def glob_pattern(glob: str) -> str:
    """A regular expression for a shell glob whose * crosses slashes."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and end > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\")
            out += f"[^{inner[1:]}]" if inner[0] == "!" else f"[{inner}]"
            i = end
        else:
            out += "\\" + c if not c.isalnum() and c not in "_/ " else c
        i += 1
    return f"(?s)^{out}$"


def matches_any(path: Column | str, globs: list[str]) -> Column:
    found = F.lit(False)
    for glob in globs:
        found = found | _text(path).rlike(glob_pattern(glob))
    return found


def windows_safe(path: Column | str) -> Column:
    """Whether every component of a relative path can be created on Windows, within 239 characters in all."""
    fine = lambda p: (p != "") & ~p.rlike(WINDOWS_BAD) & ~p.rlike(WINDOWS_RESERVED) & ~p.rlike("[ .]$")
    return F.forall(F.split(_text(path), "/", -1), fine) & (F.length(_text(path)) < 240)


def retry_after(value: Column | str) -> Column:
    """Seconds to wait that a rate-limit header names (7, 7.5s, 1m2.3s), and half a second more; null if it names none."""
    v = _text(value)
    minutes = "^([0-9.]+)m([0-9.]*)s?$"
    seconds = "^([0-9.]+)s*$"
    in_minutes = 60 * F.regexp_extract(v, minutes, 1).try_cast("double") + F.coalesce(F.nullif(F.regexp_extract(v, minutes, 2), F.lit("")).try_cast("double"), F.lit(0.0)) + 0.5
    return F.when(v.rlike(minutes), in_minutes).when(v.rlike(seconds), F.regexp_extract(v, seconds, 1).try_cast("double") + 0.5)


def stream_token(line: Column | str, provider: Column | str) -> Column:
    """The token in one line of a model's stream: JSON lines ("ollama") or server-sent events (any other)."""
    x, p = _text(line), _text(provider)
    data = strip(F.regexp_replace(x, "^data:", ""))
    event = F.when(x.startswith("data:") & (data != "[DONE]"), F.get_json_object(data, "$.choices[0].delta.content"))
    return F.coalesce(F.when(x == "", "").when(p == "ollama", F.get_json_object(x, "$.message.content")).otherwise(event), F.lit(""))


def cache_key(provider: Column, model: Column, temperature: Column, seed: Column, context: Column, messages: Column) -> Column:
    """Key of a cached answer: equal for equal requests of this engine."""
    return F.sha2(F.to_json(F.struct(provider.alias("p"), model.alias("m"), temperature.alias("t"), seed.alias("s"), context.alias("c"), messages.alias("x"))), 256)


def render(template: str, **values: Column) -> Column:
    """A prompt with its {names} filled in; {{ and }} are braces."""
    import string

    out = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            out.append(F.lit(literal))
        if name is not None:
            out.append(_text(values[name]))
    return F.concat(*out) if out else F.lit("")
