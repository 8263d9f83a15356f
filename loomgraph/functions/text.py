"""Text expressions: tokens, weak stemming, fingerprints, sections, truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in a query.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores (ASCII); none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9_]+"), lambda t: t != "")


def stem(token: Column) -> Column:
    """A weak stem: the published S-stemmer (ies to y, es to e, final s)."""
    return (
        F.when(token.rlike("ies$") & ~token.rlike("(e|a)ies$"), F.regexp_replace(token, "ies$", "y"))
        .when(token.rlike("es$") & ~token.rlike("(a|e|o)es$"), F.regexp_replace(token, "es$", "e"))
        .when(token.rlike("s$") & ~token.rlike("(u|s)s$"), F.regexp_replace(token, "s$", ""))
        .otherwise(token)
    )


def stems(text: Column) -> Column:
    """Stems of the tokens that aren't stop words."""
    return F.transform(F.filter(tokens(text), lambda t: ~t.isin(*STOP_WORDS)), stem)


def stripped(text: Column) -> Column:
    """The text without white space at its ends, that of Unicode and line ends included."""
    return F.regexp_replace(text, r"(?U)^\s++|(?<!\s)\s++\z", "")


def normalised(text: Column) -> Column:
    """Lower case, white-space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "[ \\t\\n\\x0B\\f\\r]+", " "))


def fingerprint(text: Column) -> Column:
    """Equal for texts that differ in case and white space only."""
    return F.md5(normalised(text))


def truncated(text: Column, size: int = 2000) -> Column:
    """The text if it has at most `size` UTF-8 bytes, else its characters that end within them, and a mark."""
    raw = F.encode(text, "UTF-8")
    cut = F.coalesce(*(F.try_validate_utf8(F.substring(raw, 1, size - k).cast("string")) for k in range(4)))
    return F.when(F.octet_length(text) <= size, text).otherwise(F.concat(cut, F.lit("...[truncated]")))


def layer(path: Column) -> Column:
    """Architectural layer of a file: its first known folder, else by its name; null if neither tells."""
    known = F.create_map(*[F.lit(x) for folder, name in LAYER_FOLDERS.items() for x in (folder, name)])
    parts = F.transform(F.split(F.lower(path), "/"), lambda p: known[p])
    stem_ = F.regexp_replace(F.element_at(F.split(F.lower(path), "/"), -1), r"\.[^.]*$", "")
    by_name = (
        F.when(stem_.contains("test") | stem_.contains("spec"), "test")
        .when(stem_.contains("config") | stem_.contains("settings"), "config")
        .when(stem_.rlike("(controller|handler)$"), "api")
        .when(stem_.rlike("service$"), "service")
        .when(stem_.rlike("(model|entity|repository)$"), "data")
    )
    return F.coalesce(F.get(F.filter(parts, lambda p: p.isNotNull()), F.lit(0)), by_name)


#: Folders by layer.
LAYER_FOLDERS = {
    folder: name
    for name, folders in {
        "api": "api routes endpoints handlers controllers views rest graphql grpc",
        "service": "service services domain business logic usecases use_cases interactors",
        "data": "data database db models entities repository repositories persistence migrations schema dao",
        "ui": "ui components pages layouts widgets templates frontend client app",
        "middleware": "middleware interceptors filters pipes guards",
        "util": "util utils helpers common shared lib pkg internal",
        "test": "test tests spec specs __tests__ testing fixtures",
        "config": "config configuration settings env",
        "infra": "infra infrastructure deploy ci docker k8s terraform",
    }.items()
    for folder in folders.split()
}


def camel(name: Column) -> Column:
    """`users_controller` as `UsersController`."""
    return F.array_join(F.transform(F.split(name, "_"), lambda part: F.concat(F.upper(F.substr(part, F.lit(1), F.lit(1))), F.substr(part, F.lit(2)))), "")


def snake(name: Column) -> Column:
    """`UsersController` as `users_controller`; each capital but the first letter begins a word."""
    return F.lower(F.regexp_replace(name, r"(?<!^)(\p{Lu})", "_$1"))


def constant_path(constant: Column) -> Column:
    """The path under which a constant is loaded by name: `api/v1/users_controller` for `Api::V1::UsersController`."""
    return F.array_join(F.transform(F.split(F.regexp_replace(constant, "^::", ""), "::"), snake), "/")
