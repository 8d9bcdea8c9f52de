"""Text analysis as Column expressions: tokens, intent, request signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Where a run of letters and digits changes from one camel-case word to the next.
CAMEL_EDGE = r"(?<=[A-Z])(?=[A-Z][a-z0-9])|(?<=[a-z0-9])(?=[A-Z])"
CHARS_PER_TOKEN = 4


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits, camel-case runs taken apart."""
    return F.regexp_extract_all(lower_ascii(F.regexp_replace(text, CAMEL_EDGE, " ")), F.lit("[a-z0-9]+"), F.lit(0))


def distinct_tokens(text: Column) -> Column:
    """Tokens in order of first occurrence."""
    return F.array_distinct(tokens(text))


def compact_name(text: Column) -> Column:
    return F.array_join(tokens(text), "")


def token_estimate(text: Column) -> Column:
    """One token for each four code points begun, one at least."""
    return F.greatest(F.lit(1).cast("bigint"), F.ceil(F.length(text) / F.lit(float(CHARS_PER_TOKEN))).cast("bigint"))


# Phrases that tell a question's intent, checked in this order.
INTENT_PHRASES = (
    ("modification", (
        "where should i modify", "where should i change", "where do i modify",
        "how do i change", "how should i change", "what files should i change",
        "what files do i need to change", "modify", "modification", "edit",
        "change", "update to change", "add the feature", "fix the bug",
    )),
    ("dependency", (
        "what depends", "what uses", "uses", "depends on", "dependency",
        "dependencies", "impact of", "impact", "affected by", "affected",
        "who imports", "imports", "called by", "callers", "references",
    )),
    ("implementation", (
        "where is", "where's", "where can i find", "implemented", "implementation",
        "implement", "defined", "definition", "defines", "located where",
    )),
    ("explanation", (
        "how does", "how do", "how is", "how are", "explain", "work", "works",
        "flow", "flows", "functioning", "what happens when", "what does",
    )),
)

# Words that never name a symbol.
NOT_SYMBOLS = (
    "where", "what", "how", "which", "when", "who", "is", "are", "was",
    "does", "do", "did", "i", "the", "a", "an", "of", "to", "in", "and",
    "or", "that", "this", "it", "its", "for", "with", "from", "on", "at",
    "by", "should", "can", "could", "would", "me", "you", "not", "have",
    "has", "be", "so", "as", "if", "then", "than", "there",
    "explain", "implemented", "implementation", "implement", "defined",
    "definition", "modify", "modification", "change", "edited", "edit",
    "depend", "depends", "dependency", "dependencies", "impact", "work",
    "works", "flow", "function", "found", "find", "file", "files", "code",
    "many", "much", "about", "into", "onto", "over",
    "under", "cannot", "before", "after", "during",
    "whenever", "why", "ever", "need", "use", "used", "using", "update",
)

# Verbs of a change request and the action each stands for.
ACTION_OF_VERB = {
    "add": "add", "create": "add", "implement": "add",
    "remove": "remove", "delete": "remove", "drop": "remove",
    "modify": "modify", "change": "modify", "update": "modify",
    "rename": "rename", "refactor": "refactor", "replace": "replace",
    "fix": "fix", "repair": "fix", "extend": "extend", "migrate": "migrate",
}

# Words that carry no domain meaning in a request.
REQUEST_STOP_WORDS = (
    "a", "an", "the", "to", "in", "of", "for", "and", "or", "is", "it",
    "my", "our", "its", "with", "from", "by", "on", "at", "as", "be",
    "do", "if", "so", "no", "up", "we", "you", "they", "this", "that",
    "has", "had", "was", "are", "but", "not", "can", "will", "may",
    "new", "old", "all", "some", "any", "each", "than", "then",
    "also", "just", "only", "now", "how", "what", "why", "when", "where",
    "which", "should", "would", "could", "about", "into", "through",
    "during", "before", "after", "above", "below", "between", "support",
)

# The shapes of paths, dotted modules and type names in prose.
PATH_SHAPE = r"[a-zA-Z_][\w./]*(?:\.\w+)"
MODULE_SHAPE = r"[a-zA-Z_]\w*(?:\.[a-zA-Z_]\w*)+"
TYPE_SHAPE = r"\b([A-Z][a-zA-Z0-9]+)\b"


def intent(query: Column) -> Column:
    """modification, dependency, implementation, explanation or unknown.

    A phrase fits as whole words, or when the query begins with it.
    """
    padded = F.concat(F.lit(" "), F.lower(query), F.lit(" "))
    out = F.lit("unknown")
    for name, phrases in reversed(INTENT_PHRASES):
        fits = F.lit(False)
        for p in phrases:
            fits = fits | F.contains(padded, F.lit(f" {p} ")) | F.startswith(padded, F.lit(f" {p}"))
        out = F.when(fits, name).otherwise(out)
    return F.when(F.trim(F.coalesce(query, F.lit(""))) == "", "unknown").otherwise(out)


def symbol_tokens(query: Column) -> Column:
    """Words that may name a symbol, in order, each once."""
    words = F.transform(F.regexp_extract_all(query, F.lit("[A-Za-z0-9_]+"), F.lit(0)), lower_ascii)
    stop = F.array(*[F.lit(w) for w in NOT_SYMBOLS])
    return F.filter(F.array_except(words, stop), lambda w: w.rlike("[a-z]"))


def action(request: Column) -> Column:
    """The action of the first word that is a known verb."""
    words = F.transform(F.split(F.lower(request), r"\s+"), lambda w: F.regexp_replace(w, "[^a-z]", ""))
    verbs = F.create_map(*[F.lit(x) for pair in ACTION_OF_VERB.items() for x in pair])
    known = F.filter(F.transform(words, lambda w: verbs[w]), lambda a: a.isNotNull())
    return F.get(known, F.lit(0))


def domain_terms(request: Column) -> Column:
    """Tokens of two characters or more that aren't stop words, repeats kept."""
    return F.filter(tokens(request), lambda t: (F.length(t) > 1) & ~t.isin(*REQUEST_STOP_WORDS))


def path_mentions(request: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(request, F.lit(PATH_SHAPE), F.lit(0))))


def module_mentions(request: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(request, F.lit(MODULE_SHAPE), F.lit(0))))


def type_mentions(request: Column) -> Column:
    """Capitalised names in order, repeats kept."""
    return F.regexp_extract_all(request, F.lit(TYPE_SHAPE), F.lit(1))


def normal_symbol(name: Column) -> Column:
    return lower_ascii(F.replace(name, F.lit("_"), F.lit("")))


def loose_tokens(name: Column) -> Column:
    """Sorted distinct pieces of a name; capitals in a row fall apart."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(name, F.lit("[a-z0-9]+|[A-Z][a-z0-9]*"), F.lit(0)), lower_ascii)))


def loose_symbol_tokens(name: Column) -> Column:
    """The pieces of a symbol's name without single letters, unless it has no others."""
    parts = loose_tokens(name)
    long = F.filter(parts, lambda p: F.length(p) > 1)
    return F.when(F.size(long) > 0, long).otherwise(parts)
