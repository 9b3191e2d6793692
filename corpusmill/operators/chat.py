"""Chat records: one form for all schemas, rendering, labels, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.charcodes import char_ids
from corpusmill.functions.text import without_thoughts

#: Markers and the label of tokens that are not trained on.
START, STOP, LINE = 27, 28, 29
IGNORED = -100
MESSAGES = "array<struct<role:string,content:string>>"


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _one_of(df: DataFrame, *names: str) -> Column:
    """The first of the columns that is there and holds text; '' where none does."""
    there = [F.when(F.col(n) != "", F.col(n)) for n in names if n in df.columns]
    return F.coalesce(*there, F.lit(""))


def to_messages(df: DataFrame) -> Column:
    """Messages of a record: its own, or a conversation's, or made of problem and solution, of query, tools and answers, or of an instruction pair; else none."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    rule: Column | None = None

    def add(condition: Column, value: Column) -> None:
        nonlocal rule
        value = value.cast(MESSAGES)
        rule = F.when(condition, value) if rule is None else rule.when(condition, value)

    for name in ("messages", "conversations"):
        if isinstance(kinds.get(name), T.ArrayType):
            fields = kinds[name].elementType.names
            role, content = ("role", "content") if "role" in fields else ("from", "value")
            own = F.transform(F.col(name), lambda m: F.struct(m[role].alias("role"), m[content].alias("content")))  # noqa: B023
            add(F.size(name) > 0, own)
    problem, solution = _one_of(df, "problem", "question", "prompt"), _one_of(df, "generated_solution", "solution", "response")
    wrapped = F.concat(F.lit("<think>\n"), solution, F.lit("\n</think>"))
    add((problem != "") & (solution != ""), F.array(_message("user", problem), _message("assistant", wrapped)))
    query, tools = _one_of(df, "query"), _one_of(df, "tools")
    if "query" in df.columns and "tools" in df.columns:
        answers = F.coalesce(F.col("answers"), F.lit("None")) if "answers" in df.columns else F.lit("")
        offered = F.concat(F.lit("You have access to the following tools:\n"), tools)
        add((query != "") & (tools != ""), F.array(_message("system", offered), _message("user", query), _message("assistant", answers)))
    for asked in ("instruction", "input"):
        for said in ("output", "response"):
            if asked in df.columns and said in df.columns:
                add(F.lit(True), F.array(_message("user", F.coalesce(asked, F.lit("None"))), _message("assistant", F.coalesce(said, F.lit("None")))))
    return F.coalesce(rule, F.array().cast(MESSAGES))


def common_roles(messages: Column) -> Column:
    """human and gpt become user and assistant; a missing role is ''."""
    role = lambda m: F.when(m["role"] == "human", "user").when(m["role"] == "gpt", "assistant").otherwise(F.coalesce(m["role"], F.lit("")))
    return F.transform(messages, lambda m: F.struct(role(m).alias("role"), F.coalesce(m["content"], F.lit("")).alias("content")))


def with_system(messages: Column, prompt: str) -> Column:
    """A system message first, unless there is one already."""
    first = F.coalesce(F.get(messages, 0)["role"], F.lit(""))
    return F.when((F.size(messages) > 0) & (first != "system"), F.concat(F.array(_message("system", F.lit(prompt))), messages)).otherwise(messages)


def drop_thoughts(messages: Column) -> Column:
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), F.when(m["role"] == "assistant", without_thoughts(m["content"])).otherwise(m["content"]).alias("content")))


def reasoning_switched(messages: Column, key: Column, off: float, prompt_on: str, prompt_off: str, seed: int = 0) -> Column:
    """Chats of which a share ``off`` lose their reasoning; a system prompt says which, unless the chat brings its own.

    The draw is a hash of ``key`` and ``seed``, so that a repeated task decides alike.
    """
    draw = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) / F.lit(1_000_000.0)
    return F.when(draw < off, with_system(drop_thoughts(messages), prompt_off)).otherwise(with_system(messages, prompt_on))


def render(messages: Column) -> Column:
    """Text of a chat with its markers."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))), "")


def chat_ids(messages: Column, limit: int) -> tuple[Column, Column]:
    """Input ids and labels, cut at ``limit``: only what an assistant says, and the marks that close it, is trained on.

    A chat without messages becomes one end token that is not trained on.
    """
    # Lengths are known before a message is cut into characters: what begins beyond the limit never is, and no text more than once a result.
    length = lambda m: F.length(m["role"]) + F.length(m["content"]) + 4
    before = F.aggregate(
        messages, F.struct(F.lit(0).alias("upto"), F.array().cast("array<int>").alias("begins")),
        lambda a, m: F.struct((a["upto"] + length(m)).alias("upto"), F.array_append(a["begins"], a["upto"]).alias("begins")), lambda a: a["begins"],
    )
    timed = F.filter(F.zip_with(messages, before, lambda m, b: F.struct(m["role"].alias("role"), m["content"].alias("content"), (F.lit(limit) - b).alias("room"))), lambda m: m["room"] > 0)
    body = lambda m: F.concat(char_ids(F.substr(m["content"], F.lit(1), F.greatest(m["room"], F.lit(0)))), F.array(F.lit(STOP), F.lit(LINE)))
    header = lambda m: F.concat(F.array(F.lit(START)), char_ids(m["role"]), F.array(F.lit(LINE)))
    hidden = lambda n: F.array_repeat(F.lit(IGNORED), n)
    ids = F.flatten(F.transform(timed, lambda m: F.concat(header(m), body(m))))
    labels = F.flatten(F.transform(timed, lambda m: F.when(m["role"] == "assistant", F.concat(hidden(F.length(m["role"]) + 2), body(m))).otherwise(hidden(F.least(length(m), m["room"])))))
    empty = F.size(messages) == 0
    return F.when(empty, F.array(F.lit(0))).otherwise(F.slice(ids, 1, limit)), F.when(empty, F.array(F.lit(IGNORED))).otherwise(F.slice(labels, 1, limit))
