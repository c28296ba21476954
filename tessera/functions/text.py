"""Text functions as Column expressions: code tokens, identifiers, token budgets, lines and paths.

Everything here stays in the JVM. code_tokens_py is the plain reading of the same rules, for tests.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The recognised token kinds, tried in this order at each place. A line comment may be led by one more
# slash; a block comment that is never closed runs to the end; a string is no token of its own.
COMMENT = r"//[^\n]*|/\*(?s:.*?)(?:\*/|\z)"
IDENTIFIER = r"[A-Za-z0-9_]+"
OTHER = r"[^\sA-Za-z0-9_]"
_TOKEN = rf"(?:{COMMENT})|{IDENTIFIER}|{OTHER}"
#: Between an identifier's words: underscores, lower to upper case, and before the last capital of a run.
_BOUNDARY = r"_|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"


def _split_nonempty(text: Column, pattern: str) -> Column:
    return F.array_remove(F.split(text, pattern), "")  # compiled, as a filter by a lambda is not


def split_identifier(name: Column) -> Column:
    """Words of an identifier in lower case; digits stay with the letters beside them."""
    return F.transform(_split_nonempty(name, _BOUNDARY), F.lower)


def code_tokens(text: Column) -> Column:
    """Tokens of source code: words of comments (runs of Unicode letters and digits), words of ASCII identifiers, and
    every other visible character by itself. Null gives an empty array."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TOKEN), F.lit(0))

    def words(piece: Column) -> Column:
        comment = F.transform(_split_nonempty(piece, r"[^\p{L}\p{N}]+"), F.lower)
        is_comment = piece.startswith("//") | piece.startswith("/*")
        return F.when(is_comment, comment).when(piece.rlike(r"^[A-Za-z0-9_]"), split_identifier(piece)).otherwise(F.array(piece))

    return F.flatten(F.transform(pieces, words))


def code_tokens_py(text: str | None) -> list[str]:
    """code_tokens, read character by character."""
    out: list[str] = []
    i, text = 0, text or ""
    while i < len(text):
        c = text[i]
        if text.startswith("//", i) or text.startswith("/*", i):
            end = text.find("\n" if text[i + 1] == "/" else "*/", i + 2)
            stop = len(text) if end < 0 else end + (0 if text[i + 1] == "/" else 2)
            out += [w.lower() for w in re.split(r"[\W_]+", text[i:stop]) if w]
            i = stop
        elif c.isascii() and (c.isalnum() or c == "_"):
            stop = i
            while stop < len(text) and text[stop].isascii() and (text[stop].isalnum() or text[stop] == "_"):
                stop += 1
            out += [w.lower() for w in re.split(_BOUNDARY, text[i:stop]) if w]
            i = stop
        else:
            if not c.isspace():
                out.append(c)
            i += 1
    return out


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits of prose."""
    return _split_nonempty(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")


def token_count(text: Column) -> Column:
    return F.size(code_tokens(text))


def approx_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def trim_to_tokens(text: Column, most: int) -> Column:
    """The longest head of at most `most` approximate tokens."""
    return F.when(approx_tokens(text) > most, F.substring(text, 1, 4 * most)).otherwise(text)


def truncate_lines(text: Column, most: int, marker: str = "... [truncated]") -> Column:
    """The first lines, and a marker line if there were more."""
    lines = F.split(text, "\n")
    return F.when(F.size(lines) > most, F.concat(F.array_join(F.slice(lines, 1, most), "\n"), F.lit("\n" + marker))).otherwise(text)


def truncate_for_model(text: Column, context_tokens: int, policy: str) -> Column:
    """A text that is longer than a model reads: cut (truncate), made null (reject) or left alone (pass)."""
    over = approx_tokens(text) > context_tokens
    if policy == "truncate":
        return trim_to_tokens(text, context_tokens)
    if policy == "reject":
        return F.when(~over, text)
    if policy == "pass":
        return text
    raise ValueError(f"unknown policy {policy}")


def canonical_path(module_path: Column, name: Column) -> Column:
    return F.concat_ws("::", F.array_join(module_path, "::"), name)


def top_k_for_budget(budget: Column) -> Column:
    """How many results a token budget asks for: one in 200 tokens, from 5 to 20."""
    return F.greatest(F.lit(5), F.least(F.lit(20), F.floor(budget / 200))).cast("int")


def plain(title: Column, path: Column, text: Column) -> Column:
    return F.format_string("%s (%s)\n%s", title, path, text)


def markdown(title: Column, path: Column, text: Column) -> Column:
    return F.format_string("### %s\n`%s`\n```rust\n%s\n```", title, path, text)


def splice(content: Column, edits: Column) -> Column:
    """Apply edits (array of struct<start, end, text>, byte offsets) to a binary content, from the last to the first.
    Offsets beyond the content are clamped, edits whose start lies behind their end are skipped."""
    edits = F.array_sort(edits, lambda a, b: (b["start"] - a["start"]).cast("int"))

    def one(body: Column, edit: Column) -> Column:
        size = F.length(body)
        lo, hi = F.least(edit["start"], size.cast("long")), F.least(edit["end"], size.cast("long"))
        new = F.concat(F.substring(body, F.lit(1), lo.cast("int")), F.encode(edit["text"], "UTF-8"), F.substring(body, (hi + 1).cast("int"), size))
        return F.when(lo <= hi, new).otherwise(body)

    return F.aggregate(edits, content, one)
