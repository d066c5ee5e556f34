"""File paths as column functions."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories that are never descended into.
SKIPPED_DIRS = (
    ".git", "node_modules", ".venv", "venv", "__pycache__", "dist", "build", ".mypy_cache", ".pytest_cache", "docs",
    "documentation", "website", "docusaurus", "storybook", "starlight_help", "collected_static", "staticfiles",
    "locale", "site-packages", ".next", ".nuxt", ".turbo", ".cache", "coverage", "htmlcov", ".tox", ".nox", ".yarn",
    ".pnpm-store",
)
SOURCE_SUFFIXES = (".py", ".ts", ".tsx", ".js", ".jsx", ".html", ".htm", ".graphql", ".gql")
LOCKFILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml")
MAX_SOURCE_BYTES = 1 << 20
#: Directories that hold a package rather than name an app.
PACKAGE_DIRS = ("models", "views", "serializers", "services", "tasks", "tests", "migrations", "management", "commands", "urls", "api", "forms", "admin", "signals", "permissions", "templatetags", "schema", "consumers", "selectors")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def in_skipped_dir(path: Column) -> Column:
    return F.exists(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), lambda d: d.isin(*SKIPPED_DIRS) | d.startswith("."))


def is_minified(name: Column) -> Column:
    name = F.lower(name)
    return name.contains(".min.") | name.endswith(".bundle.js") | name.endswith(".d.ts")


def is_lockfile(name: Column) -> Column:
    return F.lower(name).isin(*LOCKFILES)


def is_skippable(path: Column) -> Column:
    """Generated files, lock files, and files that hold no code."""
    return path.rlike(r"(node_modules/|generated/|__pycache__/|\.egg-info/|\.min\.js)") | is_lockfile(file_name(path)) | F.lower(path).rlike(r"\.(png|jpe?g|gif|svg|ico|woff2?|ttf|map|snap|lock)$")


def is_source(path: Column) -> Column:
    return path.rlike(r"\.(py|tsx?|jsx?)$")


def language(path: Column) -> Column:
    s = suffix(path)
    return F.when(s == ".py", "python").when(s.isin(".ts", ".tsx"), "typescript").when(s.isin(".js", ".jsx", ".mjs"), "javascript").when(s.isin(".html", ".htm"), "html").when(s.isin(".graphql", ".gql"), "graphql").otherwise("other")


def app_of(path: Column) -> Column:
    """The last directory that names an app."""
    return F.try_element_at(F.filter(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), lambda d: (d != "") & ~d.isin(*PACKAGE_DIRS)), F.lit(-1))


def template_name(path: Column) -> Column:
    found = F.regexp_extract(path, r"(?:^|/)templates/(.+)$", 1)
    return F.when(found != "", found).otherwise(path)


def is_shared(path: Column) -> Column:
    return path.contains("/shared/") | path.startswith("shared/")


def is_e2e(path: Column) -> Column:
    return path.rlike(r"(^|/)(e2e|cypress|playwright)/") | path.rlike(r"\.(e2e|cy)\.(ts|tsx|js|jsx)$")


def is_frontend_test(path: Column) -> Column:
    return path.rlike(r"\.(test|spec)\.(ts|tsx|js|jsx)$") | path.rlike(r"(^|/)__tests__/")


def slug(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "_"), F.lit("_"))


def redact(text: Column, *secrets: str) -> Column:
    """The given secrets, plain and percent-encoded, masked; besides, access tokens of hosting services and credentials in URLs."""
    for secret in filter(None, secrets):
        for form in dict.fromkeys((secret, quote(secret, safe=""))):
            text = F.replace(text, F.lit(form), F.lit("***"))
    text = F.regexp_replace(text, r"\b(gh[pousr]_|glpat-|github_pat_)[A-Za-z0-9_-]{8,}", "$1***")
    text = F.regexp_replace(text, r"(?i)(bearer|token)\s+[A-Za-z0-9._-]{12,}", "$1 ***")
    return F.regexp_replace(text, r"://[^/\s:@]+:[^/\s@]+@", "://***@")


def mask(value: Column) -> Column:
    """For display: the last four characters, if there are more than eight."""
    return F.when(value.isNull() | (value == ""), "").when(F.length(value) <= 8, "****").otherwise(F.concat(F.lit("****"), F.right(value, F.lit(4))))


def owner_pattern(glob: str) -> str:
    """Glob of an ownership rule to a regular expression over the whole path.

    ``*`` and ``?`` stay within a directory, ``**`` does not; a leading slash ties the rule to the root, a
    trailing one means all below. A directory owns what is below it.
    """
    tied, glob = glob.startswith("/"), glob.strip().lstrip("/")
    glob += "**" if glob.endswith("/") else ""
    tokens = re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", glob)
    wild = {"**/": "(.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    body = "".join(wild.get(t) or re.sub(r"([^A-Za-z0-9_/ -])", r"\\\1", t) for t in tokens)
    return f"^{'' if tied else '(.*/)?'}{body}(/.*)?$"


def glob_pattern(glob: Column) -> Column:
    """Glob of generated files, given as a value, to a regular expression over the whole path, as a column.

    A star and two of them run over directories, a question mark is one character; ``{a,b}`` is a choice, and ``[ab]``
    a class of characters.
    """
    g = F.replace(F.replace(F.replace(glob, F.lit("\\"), F.lit("/")), F.lit("**/"), F.lit("*")), F.lit("**"), F.lit("*"))
    g = F.regexp_replace(g, r"([.+^$()|\\])", r"\\$1")
    g = F.regexp_replace(F.regexp_replace(g, r"\*", ".*"), r"\?", ".")
    choice = F.regexp_extract(g, r"\{([^}]*)\}", 1)
    g = F.when(g.rlike(r"\{[^}]*\}"), F.concat(F.regexp_extract(g, r"^([^{]*)\{", 1), F.lit("("), F.replace(choice, F.lit(","), F.lit("|")), F.lit(")"), F.regexp_extract(g, r"\}(.*)$", 1))).otherwise(g)
    return F.concat(F.lit("^"), F.regexp_replace(g, r"\[!", "[^"), F.lit("$"))
