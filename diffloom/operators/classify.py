"""Changed files by language, type and purpose, and changed lines by kind.

The rule tables are parameters. The built-in catalogue is a compact one of common languages; a larger one can be
loaded from a YAML file in the layout of public language catalogues.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Languages with their type, extensions and file names. Of languages with one extension the first by name counts.
CATALOGUE = {
    "ActionScript": ("programming", ".as", ""), "AsciiDoc": ("prose", ".adoc .asc .asciidoc", ""), "Assembly": ("programming", ".asm .nas .nasm .s", ""), "Batchfile": ("programming", ".bat .cmd", ""), "C": ("programming", ".c .h .idc", ""),
    "C#": ("programming", ".cake .cs .csx", ""), "C++": ("programming", ".c++ .cc .cp .cpp .cxx .h .h++ .hh .hpp .hxx .inl .ipp .tcc .tpp", ""), "CMake": ("programming", ".cmake", "CMakeLists.txt"), "CSS": ("markup", ".css", ""), "CSV": ("data", ".csv", ""),
    "Cython": ("programming", ".pyx .pxd .pxi", ""), "Diff": ("data", ".diff .patch", ""), "Dockerfile": ("programming", ".dockerfile", "Containerfile Dockerfile"), "Gettext Catalog": ("prose", ".po .pot", ""), "Git Attributes": ("data", "", ".gitattributes"),
    "Git Config": ("data", ".gitconfig", ".gitconfig .gitmodules"), "Go": ("programming", ".go", ""), "Gradle": ("data", ".gradle", ""), "Groovy": ("programming", ".groovy .grt .gtpl .gvy", "Jenkinsfile"), "HTML": ("markup", ".htm .html .xht .xhtml", ""), "INI": ("data", ".cfg .ini .prefs .properties", ".flake8 .pylintrc buildozer.spec"),
    "Ignore List": ("data", ".gitignore", ".dockerignore .eslintignore .gitignore .npmignore .prettierignore"), "JSON": ("data", ".geojson .json .jsonl .topojson .webmanifest", ".watchmanconfig Pipfile.lock composer.lock"), "Java": ("programming", ".java .jav", ""), "JavaScript": ("programming", ".cjs .es6 .js .jsx .mjs", "Jakefile"),
    "Jinja": ("markup", ".j2 .jinja .jinja2", ""), "Julia": ("programming", ".jl", ""), "Jupyter Notebook": ("markup", ".ipynb", "Notebook"), "Kotlin": ("programming", ".kt .ktm .kts", ""), "Lex": ("programming", ".l .lex", "Lexer.x lexer.x"), "Lua": ("programming", ".lua .rockspec", ""), "M4": ("programming", ".m4 .mc", ""), "M4Sugar": ("programming", ".m4", "configure.ac"),
    "Makefile": ("programming", ".d .mak .make .makefile .mk .mkfile", "BSDmakefile GNUmakefile Kbuild Makefile Makefile.am Makefile.in Makefile.inc makefile"), "Markdown": ("prose", ".markdown .md .mdown .mkd .mkdn", "contents.lr"), "Meson": ("programming", "", "meson.build meson_options.txt"), "Nix": ("programming", ".nix", ""), "Objective-C": ("programming", ".h .m", ""), "Org": ("prose", ".org", ""), "PHP": ("programming", ".php .phps .phpt", ""),
    "Perl": ("programming", ".pl .pm .t", "Makefile.PL"), "Pip Requirements": ("data", "", "dev-requirements.txt requirements-dev.txt requirements.txt"), "Protocol Buffer": ("data", ".proto", ""), "Python": ("programming", ".py .pyi .pyp .pyt .pyw .spec .wsgi", "SConscript SConstruct wscript"), "R": ("programming", ".r .rd .rsx", ".Rprofile"), "RPM Spec": ("data", ".spec", ""), "Roff": ("markup", ".1 .2 .3 .4 .5 .6 .7 .8 .9 .l .man .me .ms .n .roff", "eqnrc mmn mmt"),
    "Ruby": ("programming", ".gemspec .rake .rb .spec", "Gemfile Podfile Rakefile Vagrantfile"), "Rust": ("programming", ".rs", ""), "SCSS": ("markup", ".scss", ""), "SQL": ("data", ".sql", ""), "SVG": ("data", ".svg", ""), "Scala": ("programming", ".sbt .sc .scala", ""), "Shell": ("programming", ".bash .sh .zsh", ".bashrc .profile .zshrc"), "Solidity": ("programming", ".sol", ""), "Swift": ("programming", ".swift", ""),
    "TOML": ("data", ".toml", "Cargo.lock Gopkg.lock Pipfile poetry.lock"), "TSX": ("programming", ".tsx", ""), "TeX": ("markup", ".bib .cls .ltx .sty .tex", ""), "Text": ("prose", ".fr .nb .txt", "CITATION COPYING COPYRIGHT.regex FONTLOG INSTALL LICENSE LICENSE.mysql NEWS README.me go.mod go.sum"), "TypeScript": ("programming", ".cts .mts .ts", ""), "XML": ("data", ".csproj .plist .rng .rs .ts .tsx .vcxproj .xml .xsd .xsl", "App.config"),
    "YAML": ("data", ".yaml .yml", ".clang-format .clang-tidy CITATION.cff"), "Yacc": ("programming", ".y .yacc .yy", ""), "reStructuredText": ("prose", ".rest .rst", ""),
}
# Languages of file names, before the catalogue's.
FILENAME_LANGUAGES = {
    "AUTHORS": "Text", "COPYING": "Text", "ChangeLog": "Text", "CHANGELOG": "Text", "INSTALL": "Text", "NEWS": "Text", "PACKAGERS": "Text", "README": "Text", "THANKS": "Text", "TODO": "Text", "MANIFEST.in": "Text",
    "Makefile": "Makefile", "build.cake": "C#", "configure.ac": "M4Sugar", "flake.lock": "JSON", ".pylintrc": "INI",
}
# Languages of extensions, before the catalogue's and without exceptions.
EXTENSION_LANGUAGES = {
    ".as": "ActionScript", ".asm": "ASM", ".cfg": "INI", ".cs": "C#", ".h": "C", ".html": "HTML", ".json": "JSON", ".md": "Markdown", ".MD": "Markdown", ".php": "PHP", ".pl": "Perl", ".pm": "Perl", ".plist": "XML",
    ".properties": "INI", ".rs": "Rust", ".sol": "Solidity", ".sql": "SQL", ".t": "Perl", ".ts": "TypeScript", ".txt": "Text", ".TXT": "Text", ".tsx": "TSX", ".yaml": "YAML", ".yml": "YAML",
}
# Path patterns with a purpose, first match first; patterns are matched from the right, part by part.
PURPOSES = (
    ("*.cmake", "project"), (".nuspec", "project"), ("BUILD", "project"), ("build.cake", "project"), ("CMakeLists.txt", "project"), ("Cargo.toml", "project"), ("Dockerfile", "project"), ("Gemfile", "project"), ("Makefile", "project"),
    ("Podfile", "project"), ("bower.json", "project"), ("build.gradle", "project"), ("build.gradle.kts", "project"), ("build.sbt", "project"), ("buildfile", "project"), ("bun.lockb", "project"), ("*.cabal", "project"), ("composer.json", "project"),
    ("conanfile.py", "project"), ("conanfile.txt", "project"), ("flake.lock", "project"), ("flake.nix", "project"), ("go.mod", "project"), ("info/index.json", "project"), ("ivy.xml", "project"), ("manifest", "project"), ("MANIFEST.in", "project"),
    ("meson.build", "project"), (".node-version", "project"), ("package.json", "project"), ("pom.xml", "project"), ("project.clj", "project"), ("pyproject.toml", "project"), (".pylintrc", "project"), ("requirements.txt", "project"), ("setup.cfg", "project"),
    (".tool-versions", "project"), ("vcpkg.json", "project"), (".gitignore", "project"), (".hgignore", "project"), ("doc", "documentation"), ("docs", "documentation"), ("documentation", "documentation"), ("man", "documentation"),
)


@dataclass(frozen=True)
class Rules:
    """The rule tables of a classification; the two tables of languages go before the catalogue."""

    catalogue: dict[str, tuple[str, str, str]] = field(default_factory=lambda: dict(CATALOGUE))
    filename_overrides: dict[str, str] = field(default_factory=lambda: dict(FILENAME_LANGUAGES))
    extension_overrides: dict[str, str] = field(default_factory=lambda: dict(EXTENSION_LANGUAGES))
    purposes: tuple[tuple[str, str], ...] = PURPOSES
    purpose_to_type: dict[str, str] = field(default_factory=lambda: {"documentation": "documentation"})

    def extensions(self) -> dict[str, list[str]]:
        """The languages of each extension of the catalogue, in its order."""
        return self._reverse(1)

    def filenames(self) -> dict[str, list[str]]:
        return self._reverse(2) | {name: [language] for name, language in self.filename_overrides.items()}

    def _reverse(self, part: int) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for language, row in self.catalogue.items():
            for key in row[part].split():
                out.setdefault(key, []).append(language)
        return out

    def updated(self, extensions: Iterable[str] = (), filenames: Iterable[str] = (), purposes: Iterable[str] = (), purpose_to_type: Iterable[str] = ()) -> Rules:
        """These rules with more of them, as texts ``key:value``, one after the other.

        An empty text empties its table, so that only what comes after it counts. A key that is there keeps its place and gets
        the new value. A purpose alone, without a colon, is its own type.
        """
        return replace(
            self, extension_overrides=_changed(self.extension_overrides, extensions), filename_overrides=_changed(self.filename_overrides, filenames),
            purposes=tuple(_changed(dict(self.purposes), purposes).items()), purpose_to_type=_changed(self.purpose_to_type, purpose_to_type),
        )


def colon_pair(text: str) -> tuple[str, str]:
    """(a, b) of ``a:b``, and (a, a) of ``a``; what stands after a second colon is left out."""
    parts = text.split(":")
    return parts[0], parts[1] if len(parts) > 1 else parts[0]


def _changed(table: dict[str, str], rules: Iterable[str]) -> dict[str, str]:
    out = dict(table)
    for rule in rules:
        if rule:
            key, value = colon_pair(rule)
            out[key] = value
        else:
            out = {}
    return out


def load_catalogue(path: str) -> dict[str, tuple[str, str, str]]:
    """A catalogue from YAML: language to its type, extensions (primary ones first) and filenames, in the file's order."""
    import yaml

    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f)
    names = lambda v, *keys: " ".join(dict.fromkeys(x for k in keys for x in (v.get(k) or []) if " " not in x))
    return {k: (v.get("type") or "other", names(v, "primary_extension", "extensions"), names(v, "filenames")) for k, v in raw.items()}


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key] if table else F.lit(None).cast("string")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def suffix(path: Column) -> Column:
    """The last suffix of a file's name, empty if it has none or only starts with a dot."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1)


def language(path: Column, rules: Rules) -> Column:
    """By name, else by suffix, as they are written; ``/dev/null`` is its own, an unknown file ``unknown``.

    Where a name or a suffix of the catalogue has several languages, a few paths and languages are told apart by rule; else
    the catalogue's first one counts.
    """
    lists = lambda table: _lookup(basename(path), {k: "\n".join(v) for k, v in table.items()})
    of_suffix = _lookup(suffix(path), {k: "\n".join(v) for k, v in rules.extensions().items()})
    found = F.coalesce(_told_apart(path, lists(rules.filenames())), _lookup(suffix(path), rules.extension_overrides), _told_apart(path, of_suffix))
    return F.coalesce(found, F.when(path.contains("/dev/null"), "/dev/null"), F.lit("unknown"))


def _told_apart(path: Column, languages: Column) -> Column:
    """One of ``languages``, a text with one in each line."""
    every, low = F.split(languages, "\n"), F.lower(path)
    has = lambda name: F.array_contains(every, name)
    out = F.when(low.contains("spark") & has("Roff"), "Text").when(low.contains("kconfig") & has("Lex"), "Lex")
    for name in ("HTML", "Roff", "M4"):
        out = out.when(has(name), name)
    out = out.when(path.startswith("rpm/") & path.endswith(".spec"), "RPM Spec").otherwise(F.get(every, F.lit(0)))
    return F.when(languages.isNotNull(), out)


def kind(lang: Column, rules: Rules) -> Column:
    return F.coalesce(_lookup(lang, {k: v[0] for k, v in rules.catalogue.items()}), F.lit("other"))


def glob_regex(pattern: str) -> str:
    """The regular expression of a path pattern that is matched from the right, part by part; ``**`` is ``*``."""
    import re

    parts = ["".join("[^/]*" if x in ("*", "**") else "[^/]" if x == "?" else re.escape(x) for x in re.split(r"(\*\*|\*|\?)", part)) for part in pattern.strip("/").split("/")]
    return "(^|/)" + "/".join(parts) + "$"


def purpose(path: Column, type_: Column, rules: Rules) -> Column:
    """``test`` in the path, else the first pattern, else prose is documentation, else the type, else ``unknown``."""
    out = F.when(F.lower(path).contains("test"), "test")
    for pattern, name in rules.purposes:
        out = out.when(path.rlike(glob_regex(pattern)), name)
    return out.when(type_ == "prose", "documentation").when(type_.isin("programming", "data", "markup", "other"), type_).otherwise("unknown")


def classify(files: DataFrame, rules: Rules | None = None, path: str = "file_name", finder: Callable[[str], tuple[str, str]] | None = None) -> DataFrame:
    """``files`` with ``path_language``, ``path_type`` and ``path_purpose`` by their path alone; null for a null path.

    ``finder`` takes the place of the tables of languages: it gives the language and type of a path; the purpose follows from
    both as usual. It runs in Arrow batches.
    """
    rules = rules or Rules()
    known = F.col(path).isNotNull()
    if finder:

        @F.pandas_udf("language string, type string")
        def find(paths: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for series in paths:
                yield pd.DataFrame([finder(p) if isinstance(p, str) else (None, None) for p in series], columns=["language", "type"])

        found = files.withColumn("_found", find(F.col(path)))
        out = found.withColumn("path_language", F.col("_found.language")).withColumn("path_type", F.col("_found.type")).drop("_found")
    else:
        out = files.withColumn("path_language", F.when(known, language(F.col(path), rules)))
        out = out.withColumn("path_type", F.when(known, kind(F.col("path_language"), rules)))
    return out.withColumn("path_purpose", F.when(known, purpose(F.col(path), F.col("path_type"), rules)))


def token_is(token: Column, *path: str) -> Column:
    """Whether a token's type begins with ``path``."""
    test = F.size(token["type"]) >= len(path)
    for i, p in enumerate(path):
        test = test & (F.get(token["type"], F.lit(i)) == p)
    return F.coalesce(test, F.lit(False))


def is_comment_token(token: Column) -> Column:
    return token_is(token, "Comment") | token_is(token, "Literal", "String", "Doc")


def is_blank_token(token: Column) -> Column:
    return token_is(token, "Text", "Whitespace") | F.coalesce(F.trim(F.regexp_replace(token["text"], r"\s+", "")) == "", F.lit(False))


def line_is_empty(tokens: Column) -> Column:
    """One token, which is a line end."""
    return (F.size(tokens) == 1) & F.coalesce(F.get(tokens, F.lit(0))["text"].isin("\n", "\r\n"), F.lit(False))


def line_is_whitespace(tokens: Column) -> Column:
    """Only blank tokens; true for no tokens."""
    return F.forall(tokens, is_blank_token)


def line_is_comment(tokens: Column) -> Column:
    """At least one comment, and else only blank tokens."""
    return F.exists(tokens, is_comment_token) & F.forall(tokens, lambda t: is_comment_token(t) | is_blank_token(t))


def line_type(file_purpose: Column, tokens: Column, callback: Column | None = None, rules: Rules | None = None) -> Column:
    """The kind of a line: what its file's purpose decides, else what the callback says, else documentation for a comment, else
    ``code`` in programming files, else the file's purpose. Null tokens are no tokens."""
    tokens = F.coalesce(tokens, F.array().cast("array<struct<idx:int,type:array<string>,text:string>>"))
    rules = rules or Rules()
    default = F.when(file_purpose == "programming", "code").otherwise(file_purpose)
    parts = [_lookup(file_purpose, rules.purpose_to_type), callback, F.when(line_is_comment(tokens), "documentation"), default]
    return F.coalesce(*[p for p in parts if p is not None])


#: Callbacks that give some lines a kind of their own.
CALLBACKS = {
    "empty": lambda tokens: F.when(line_is_empty(tokens), "empty"),
    "whitespace": lambda tokens: F.when(line_is_whitespace(tokens), "whitespace"),
    "bugfix": lambda tokens: F.when(line_is_whitespace(tokens) | line_is_comment(tokens), None).otherwise("bug(fix)"),
}


def python_callback(function: Callable[[list[tuple[int, list[str], str]]], str | None]) -> Callable[[Column], Column]:
    """A callback made of a Python function of a line's tokens, (offset, type, text) each; it runs in Arrow batches.

    Only functions are taken, never their text. Where columns can say the same, as in :data:`CALLBACKS`, they are faster.
    """

    @F.pandas_udf("string")
    def run(lines: pd.Series) -> pd.Series:
        return lines.map(lambda tokens: function([(t["idx"], list(t["type"] if t["type"] is not None else ()), t["text"]) for t in (tokens if tokens is not None else ())]))

    return lambda tokens: run(tokens)
