"""Chat formatting: turns of a conversation as one training text with a loss mask, in SQL functions only.

Turns are collected as structs, sorted by turn (then role and text, so ties have one order) and adjacent
turns of one role merged into a block by an array aggregation. Blocks are written as

    [INST] text [/INST]          user
    <<SYS>> text <</SYS>>        system
    <s> text </s>                assistant
    [ROLE] name [/ROLE] text [END]   any other role; a null role has an empty name

one a line; [TURN] stands between merged turns. One blank on each side of a text belongs to the marks.
A control string inside a text gets a backslash before it, and backslashes right before it are doubled,
so that a mark is real exactly if no backslash precedes it, and ``unescape`` gives the text back.

The loss mask lists (start, length) of the assistant texts in characters of the output.

Null texts are empty; null turns come first; a null conversation id is a conversation of its own; repeated
rows are repeated turns. One conversation is one output row, as large as its turns together. Time grows with the
length of the texts, also of runs of backslashes, and with n * sqrt(n) of a conversation's n turns.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let

# The control strings of the template.
OPEN = {"user": "[INST]", "system": "<<SYS>>", "assistant": "<s>"}
CLOSE = {"user": "[/INST]", "system": "<</SYS>>", "assistant": "</s>"}
ROLE, NAMED, END, TURN = "[ROLE]", "[/ROLE]", "[END]", "[TURN]"
CONTROLS = [*OPEN.values(), *CLOSE.values(), ROLE, NAMED, END, TURN]

_ANY = "|".join(re.escape(c) for c in CONTROLS)


def escape(text: Column) -> Column:
    # Each run of backslashes is looked at once, from its start.
    return F.regexp_replace(text, rf"(?<!\\)(\\*+)({_ANY})", r"$1$1\\$2")


def unescape(text: Column) -> Column:
    # Of an odd run of backslashes before a control string: half of it, and the last one goes. What follows
    # the run is looked at once, from its start; every further match goes on from the one before.
    return F.regexp_replace(text, rf"(?:(?<!\\)(?=(?:\\\\)*+\\(?:{_ANY}))|\G(?<=\\))\\(\\|(?={_ANY}))", "$1")


def cut(array: Column, starts: Column) -> Column:
    """The runs of an array that begin at ``starts`` (from 0, ascending), up to the next start or the end."""
    return F.transform(starts, lambda s, k: F.slice(array, s + 1, F.coalesce(F.get(starts, k + 1), F.size(array)) - s))


def positions(array: Column) -> Column:
    """0, 1, ... of an array."""
    return F.transform(array, lambda x, i: i)


def blocks_of(array: Column) -> Column:
    """An array cut into about as many pieces as a piece has elements: work inside them grows with n * sqrt(n)."""
    size = F.greatest(F.ceil(F.sqrt(F.size(array))).cast("int"), F.lit(1))
    return let(size, lambda n: cut(array, F.filter(positions(array), lambda i: i % n == 0)))


def merged(turns: Column) -> Column:
    """array<struct<role, texts>>: adjacent turns of one role as one block."""
    def begins(turn: Column, i: Column) -> Column:
        return (i == 0) | ~turn["role"].eqNullSafe(F.get(turns, i - 1)["role"])

    flags = F.transform(turns, lambda t, i: F.when(begins(t, i), i))
    return let(F.array_compact(flags), lambda starts: F.transform(cut(turns, starts), lambda run: F.struct(
        F.get(run, 0)["role"].alias("role"), F.transform(run, lambda t: t["text"]).alias("texts"))))


def segments(blocks: Column) -> Column:
    """array<struct<text, loss>>: the output in order, marks and escaped texts apart."""
    def by_role(role: Column, marks: dict[str, str], other: Column) -> Column:
        out = other
        for name, mark in marks.items():
            out = F.when(role == name, F.lit(mark)).otherwise(out)
        return out

    def mark(text: Column) -> Column:
        return F.struct(text.alias("text"), F.lit(False).alias("loss"))

    def block(b: Column, k: Column) -> Column:
        named = F.concat(F.lit(f"{ROLE} "), escape(F.coalesce(b["role"], F.lit(""))), F.lit(f" {NAMED}"))
        opened = F.concat(F.when(k > 0, F.lit("\n")).otherwise(F.lit("")), by_role(b["role"], OPEN, named), F.lit(" "))
        texts = F.flatten(F.transform(b["texts"], lambda t, i: F.array(
            mark(F.when(i > 0, F.lit(f" {TURN} ")).otherwise(opened)),
            F.struct(escape(t).alias("text"), F.coalesce(b["role"] == "assistant", F.lit(False)).alias("loss")))))
        return F.concat(texts, F.array(mark(F.concat(F.lit(" "), by_role(b["role"], CLOSE, F.lit(END))))))

    return F.flatten(F.transform(blocks, block))


def loss_spans(parts: Column) -> Column:
    """array<struct<start, length>> of the parts under the mask, in characters, from 0."""
    def running(items: Column, zero: Column, length) -> Column:
        """array<int>: for each item ``zero`` and the lengths of the items before it."""
        def step(acc: Column, x: Column) -> Column:
            return F.struct((acc["at"] + length(x)).alias("at"), F.concat(acc["seen"], F.array(acc["at"])).alias("seen"))

        start = F.struct(zero.alias("at"), F.array().cast("array<int>").alias("seen"))
        return F.aggregate(items, start, step)["seen"]

    def spans(block: Column, at: Column) -> Column:
        found = F.transform(F.arrays_zip(block.alias("p"), running(block, at, lambda x: x["n"]).alias("at")), lambda x: F.when(
            x["p"]["loss"], F.struct(x["at"].alias("start"), x["p"]["n"].alias("length"))))
        return F.array_compact(found)

    total = lambda block: F.aggregate(block, F.lit(0), lambda acc, x: acc + x["n"])
    sizes = F.transform(parts, lambda p: F.struct(F.length(p["text"]).alias("n"), p["loss"].alias("loss")))
    return let(let(sizes, blocks_of), lambda bs: let(running(bs, F.lit(0), total), lambda ats: F.flatten(
        F.transform(bs, lambda b, i: spans(b, F.get(ats, i))))))


def masked(formatted: Column, loss: Column) -> Column:
    """array<string>: the texts under a loss mask, unescaped."""
    def texts(whole: Column, block: Column) -> Column:
        # A place in a string is found by walking from its start: a stretch is cut out first, then its spans.
        low = F.get(block, 0)["start"]
        last = F.get(block, F.size(block) - 1)
        stretch = F.substring(whole, low + 1, last["start"] + last["length"] - low)
        return let(stretch, lambda t: F.transform(block, lambda s: unescape(F.substring(t, s["start"] - low + 1, s["length"]))))

    return let(formatted, lambda whole: let(loss, lambda spans: F.flatten(
        F.transform(blocks_of(spans), lambda block: texts(whole, block)))))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss: array<struct<start, length>>) of turns (conv_id, turn, role, text)."""
    one = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    built = grouped.select("conv_id", let(F.col("turns"), lambda t: let(merged(t), lambda b: let(segments(b), lambda p: F.struct(
        F.array_join(F.transform(p, lambda x: x["text"]), "").alias("formatted"), loss_spans(p).alias("loss"))))).alias("out"))
    return built.select("conv_id", "out.formatted", "out.loss")


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns that a formatted text holds."""
    opens = "|".join(re.escape(m) for m in [*OPEN.values(), ROLE, NAMED, TURN])
    closes = "|".join(re.escape(m) for m in [*CLOSE.values(), NAMED, END, TURN])
    pattern = F.lit(rf"(?s)(?<!\\)({opens}) (.*?) (?=(?<!\\)(?:{closes}))")
    found = F.arrays_zip(F.regexp_extract_all(formatted, pattern, F.lit(1)).alias("mark"),
                         F.regexp_extract_all(formatted, pattern, F.lit(2)).alias("text"))
    names = {mark: role for role, mark in OPEN.items()}

    def turns(run: Column) -> Column:
        """The turns of a block: its first piece has the mark of its role, or [ROLE] and the name."""
        head = F.get(run, 0)
        role = F.when(head["mark"] == ROLE, unescape(head["text"]))
        for mark, name in names.items():
            role = role.when(head["mark"] == mark, F.lit(name))
        said = F.filter(run, lambda piece: piece["mark"] != ROLE)
        return let(role, lambda r: F.transform(said, lambda piece: F.struct(r.alias("role"), unescape(piece["text"]).alias("text"))))

    def starts(pieces: Column) -> Column:
        return F.array_compact(F.transform(pieces, lambda p, i: F.when(~p["mark"].isin(NAMED, TURN), i)))

    return let(found, lambda f: let(starts(f), lambda s: F.flatten(F.transform(cut(f, s), turns))))


def report(chats: DataFrame) -> DataFrame:
    """Figures read back from the output of ``format_chats``."""
    turns = F.transform(read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    under = F.array_join(masked(F.col("formatted"), F.col("loss")), "")
    read = chats.select("conv_id", turns.alias("turns"), under.alias("learned"), F.length("formatted").alias("chars"))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.col("chars").cast("long").alias("formatted_chars"))


def report_sql(extra: str) -> str:
    """``report`` over conversations, and one more with ``extra`` as both texts, as SQL of the same template."""
    sql = lambda s: "'" + s.replace("'", "''") + "'"
    case = lambda marks, other: "CASE role " + " ".join(f"WHEN '{r}' THEN {sql(m)}" for r, m in marks.items()) + f" ELSE {other} END"
    esc = lambda c: rf"regexp_replace({c}, '(\\*)({_ANY})', '\1\1\\\2', 'g')"
    named = f"'{ROLE} ' || {esc("coalesce(role, '')")} || ' {NAMED}'"
    return f"""
WITH all_turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', {sql(extra)} UNION ALL SELECT -1, 1, 'assistant', {sql(extra)}),
placed AS (
  SELECT *, row_number() OVER w AS k, lag(role) OVER w IS NOT DISTINCT FROM role AND lag(text) OVER w IS NOT NULL AS follows,
    lead(role) OVER w IS NOT DISTINCT FROM role AND lead(text) OVER w IS NOT NULL AS continues
  FROM all_turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text)),
written AS (
  SELECT *, CASE WHEN follows THEN ' {TURN} ' ELSE CASE WHEN k > 1 THEN chr(10) ELSE '' END || {case(OPEN, named)} || ' ' END
    || {esc('text')} || CASE WHEN continues THEN '' ELSE ' ' || {case(CLOSE, sql(END))} END AS piece FROM placed)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(piece)) AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id
"""
