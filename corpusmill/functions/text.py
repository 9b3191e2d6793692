"""Column functions over text. Lengths are code points, budgets UTF-8 bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Character classes that mean the same in Java's and in RE2's regular expressions.
WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
PUNCT = r"[^\p{L}\p{N}_\t-\r\x1c-\x20\x{85}\p{Z}]"
PIECE = f"{WS}+|{WORD}+|{PUNCT}"

#: Columns that hold a record's text, in order of preference.
TEXT_COLUMNS = ("text", "content", "trajectory", "prompt", "response")
TEXT_COLUMNS_WITH_QUESTION = ("text", "content", "trajectory", "prompt", "response", "question")
SYNTHESIS_COLUMNS = ("text", "content", "passage", "question", "problem", "instruction")
LABELLED_COLUMNS = ("problem", "question", "prompt", "facts", "hypothesis")
ANSWER_COLUMNS = ("solution", "answer", "response")
PLAIN_COLUMNS = ("text", "content", "trajectory")


def strip(c: Column) -> Column:
    """Without white space, as Unicode has it, at either end."""
    return F.regexp_replace(c, rf"\A{WS}+|{WS}+\z", "")


def collapse_space(c: Column) -> Column:
    return F.regexp_replace(strip(c), f"{WS}+", " ")


def trim_text(c: Column, limit: int = 0) -> Column:
    """Stripped and cut to ``limit`` code points (0: uncut); null where nothing is left."""
    s = strip(c)
    cut = F.substring(s, 1, limit) if limit else s
    return F.when(s != "", cut)


def utf8_length(c: Column) -> Column:
    return F.octet_length(c)


def text_column(schema: T.StructType, wanted: tuple[str, ...] = TEXT_COLUMNS) -> str | None:
    """The preferred string column of a schema, else its first string column, else None."""
    strings = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
    return next((n for n in wanted if n in strings), strings[0] if strings else None)


def _strings(df: DataFrame, names: tuple[str, ...]) -> list[str]:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return [n for n in names if isinstance(kinds.get(n), T.StringType)]


def longest_string(df: DataFrame, names: list[str]) -> Column:
    """The longest of the string columns, the first of equally long ones; '' where all are null."""
    best: Column = F.lit("")
    for n in names:
        best = F.when(F.length(F.col(n)) > F.length(best), F.col(n)).otherwise(best)
    return best


def canonical_text(df: DataFrame) -> Column:
    """One text for a record of whatever schema: labelled parts in a fixed order, else its plain text, else its longest string."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    parts: list[Column] = []
    if isinstance(kinds.get("messages"), T.ArrayType):
        spoken = "role" in getattr(kinds["messages"].elementType, "names", [])  # messages without the key are the user's
        lines = F.transform(
            F.filter("messages", lambda m: m.isNotNull()),
            lambda m: F.concat(F.coalesce(m["role"], F.lit("None")) if spoken else F.lit("user"), F.lit(": "), F.coalesce(m["content"], F.lit("None"))),
        )
        parts.append(F.when(F.size(lines) > 0, F.array_join(lines, "\n")))
    parts += [F.concat(F.lit(f"{n.capitalize()}: "), F.col(n)) for n in _strings(df, LABELLED_COLUMNS)]
    if isinstance(kinds.get("proofs"), T.ArrayType):
        parts.append(F.concat(F.lit("Proof: "), F.array_join("proofs", " ")))
    parts += [F.concat(F.lit(f"{n.capitalize()}: "), F.col(n)) for n in _strings(df, ANSWER_COLUMNS)]
    plain = [F.col(n) for n in _strings(df, PLAIN_COLUMNS)]
    rest = longest_string(df, _strings(df, tuple(df.columns)))
    fallback = F.coalesce(*plain, rest) if plain else rest
    if not parts:
        return fallback
    any_part = parts[0].isNotNull()
    for p in parts[1:]:
        any_part = any_part | p.isNotNull()
    return F.when(any_part, F.concat_ws("\n", *parts)).otherwise(fallback)


def pieces(c: Column) -> Column:
    """Runs of white space, runs of word characters and single other characters, in order."""
    return F.regexp_extract_all(c, F.lit(f"({PIECE})"), F.lit(1))


def piece_words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({WORD}+)"), F.lit(1))


def characters(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("((?s).)"), F.lit(1))


def rejoin(pieces_: Column, allowed: Column) -> Column:
    """Text of pieces without the words that ``allowed`` (an array of the same length) refuses; null where nothing is left.

    What a piece emits depends on the piece before alone: white space becomes a line break if it holds one, else one
    blank; a refused word one blank, unless blanks or nothing stand before it; other pieces themselves, after one blank
    if a word or sign stands before.
    """

    def emit(x: Column, i: Column) -> Column:
        before, was_allowed = F.get(pieces_, i - 1), F.get(allowed, i - 1)
        space, word = x.rlike(rf"\A{WS}"), x.rlike(rf"\A{WORD}")
        before_space, before_word = before.rlike(rf"\A{WS}"), before.rlike(rf"\A{WORD}")
        refused = word & ~F.get(allowed, i)
        kept_before = before.isNotNull() & ~before_space & (~before_word | was_allowed)
        blank_before = before.isNull() | (before_space & ~F.contains(before, F.lit("\n")))
        return (
            F.when(space, F.when(F.contains(x, F.lit("\n")), "\n").otherwise(" "))
            .when(refused, F.when(blank_before, "").otherwise(" "))
            .otherwise(F.concat(F.when(kept_before, " ").otherwise(""), x))
        )

    joined = strip(F.array_join(F.transform(pieces_, emit), ""))
    return F.when(joined != "", joined)


def flatten_lines(c: Column) -> Column:
    return strip(F.replace(c, F.lit("\n"), F.lit(" ")))


def unix_lines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def without_thoughts(c: Column) -> Column:
    return strip(F.regexp_replace(c, rf"(?s)<think>.*?</think>{WS}*", ""))


def thought_and_answer(c: Column) -> tuple[Column, Column]:
    """What stands between the first opening tag and the next closing one, and what follows; both null without either tag."""
    opened = F.instr(c, "<think>")
    after = F.when(opened > 0, F.substr(c, opened + F.lit(7)))
    closed = F.instr(after, "</think>")
    thought = F.when(closed > 0, strip(F.substr(after, F.lit(1), closed - 1)))
    answer = F.when(closed > 0, strip(F.substr(after, closed + F.lit(8))))
    return thought, answer


def ratio_text(ratio: Column) -> Column:
    """``n/a``, or the ratio with the share of tokens saved or added."""
    share = F.format_string("%.1f", F.abs(1 - ratio) * 100)
    return F.when(ratio.isNull(), "n/a").otherwise(
        F.concat(F.format_string("%.3f", ratio), F.lit(" ("), share, F.when(ratio <= 1, "% fewer tokens)").otherwise("% more tokens)"))
    )


def byte_markers(c: Column) -> Column:
    return F.regexp_count(c, F.lit("<0x[0-9A-Fa-f]{2}>"))
