"""Tokens of source lines: whole texts go through a lexer chosen by file name, tokens are cut at line ends and grouped by line."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

TOKENS = "array<struct<idx:int,type:array<string>,text:string>>"
#: A frame of tokens goes to Spark once it has so many lines, so that memory doesn't grow with the batch.
FRAME_LINES = 5000
#: Lines end as in a diff, with \\n only: a lone \\r or another separator is part of its line.
_LINES = re.compile(r"[^\n]*\n|[^\n]+")
_LEXERS: dict[str, object] = {}


def lexer_for(name: str):
    """The lexer for a file's name, kept by its whole last part; plain text for an unknown one."""
    from pygments.lexers import TextLexer, get_lexer_for_filename
    from pygments.util import ClassNotFound

    base = name.rpartition("/")[2]
    key = base.rpartition(".")[2] if "." in base else base
    if key not in _LEXERS:
        try:
            _LEXERS[key] = get_lexer_for_filename(base, stripnl=False, ensurenl=False)
        except ClassNotFound:
            _LEXERS[key] = TextLexer(stripnl=False, ensurenl=False)
    return _LEXERS[key]


def lex_lines(name: str, text: str) -> list[list[tuple[int, list[str], str]]]:
    """The tokens (offset in the text, type path, text) of each line; a token over several lines is cut at their ends."""
    lines: list[list] = [[]]
    for at, kind, value in lexer_for(name).get_tokens_unprocessed(text):
        path = [str(x) for x in kind]
        for part in _LINES.findall(value):
            lines[-1].append((at, path, part))
            at += len(part)
            if part[-1] == "\n":
                lines.append([])
    if not lines[-1]:
        lines.pop()
    return lines


def with_tokens(files: DataFrame, name: str = "file_name", text: str = "content", keys: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """(keys, line_no, tokens) of every line of ``files``; null and empty texts have none. Only rows that need lexing should come here."""
    kinds = ", ".join(f"`{k}` {files.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for *key, n, t in zip(*[pdf[k] for k in keys], pdf[name], pdf[text]):
                for i, tokens in enumerate(lex_lines(n or "", t) if isinstance(t, str) else (), 1):
                    rows.append((*key, i, [{"idx": a, "type": p, "text": v} for a, p, v in tokens]))
                if len(rows) >= FRAME_LINES:
                    yield pd.DataFrame(rows, columns=[*keys, "line_no", "tokens"])
                    rows = []
            yield pd.DataFrame(rows, columns=[*keys, "line_no", "tokens"])

    return files.select(*keys, name, text).mapInPandas(run, f"{kinds}, line_no int, tokens {TOKENS}")
