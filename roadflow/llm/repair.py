"""Structure of conversations: faults of their turns and the cheapest edits that make the roles alternate.

``damage`` spoils rows by a digest of their id (drops, empties, cuts off ends, repeats, changes roles). ``repair``
then names the first fault of every row (blank, duplicate, truncated) and finds the cheapest edits after which the
role initials read ``(s?(ua)+)?``: Keep 0, Rerole to user or assistant 2, Delete 3 (the only way for blank and
duplicate rows), Insert an empty user or assistant turn 2; a truncated row that stays costs 1 more. Among equal
costs the audit (initials of the edits in order) that is least in ASCII is taken.

Suffix-shared automaton: what the edits cost depends on the signature alone, one symbol a row for role and fault. A
node is a symbol and the node that follows it; it stands for one ending of signatures. Signatures are sorted by
their reversed form, dealt by range, so equal endings are neighbours: a task keeps the nodes of the last
signature and solves those that the next one does not share. A node holds, for each state of the role grammar, the
cost to the end, the first edit and the state after it: cost-to-go and audit of the whole ending, worked out
once for all conversations that end this way (again only where two ranges meet).

How it runs: rows are placed by conversation, sorted on disk where they must be, and read as a stream; a task holds
one symbol a row of the conversation it reads, never its texts. A hash of a whole conversation is read in order by
nature, so one conversation is one stream. A signature that many conversations share is broadcast, not shuffled.

Nulls: roles and texts count as one blank, also in the digest; null turns sort first and are left out of ``gaps``;
rows without conv_id form one conversation. A role that is empty or starts with another letter is never legal.
Rows of one turn are ordered by role, then text, then copy, so equal rows are duplicates of each other. Long texts
and long conversations are taken whole. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage
from .text import join_unique, slices

BLANKS = " \t\n\x0b\f\r"
ENDS = ".!?"
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1

# States of the role grammar (s?(ua)+)?: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (START, ASSISTANT)
#: What may stay in a state, and the state after it.
LEGAL = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The one role an edit can put in a state, and the state after it.
PUT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
NEVER = 1 << 60

#: Best way from a node in one state: cost, first edit, state after the edit.
Way = tuple[int, str, int]


def damage(turns: DataFrame) -> DataFrame:
    """``conversations`` rows spoilt by crc32 of ``conv_id:turn`` modulo 20: (key, conv_id, turn, role, text, copy, alive).

    A dropped row stays as one that is not alive, so that its conversation is known.
    """
    key, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    kind = F.crc32(F.concat(key, F.lit(":"), turn).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select(
        key.alias("key"), "conv_id", "turn", kind.alias("kind"), F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ENDS, "")).otherwise(text).alias("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("*", F.explode(copies).alias("copy"), (F.col("kind") != 0).alias("alive")).drop("kind")


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` in their place (``pos`` from 1), with the role's ``initial`` and the first ``fault``."""
    # One shuffle by conversation serves both windows.
    place = Window.partitionBy("key").orderBy("turn", "role", "text", "copy")
    earlier = Window.partitionBy("key", "alive", "role", "text").orderBy("turn", "copy")
    last = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    first = F.substring("role", 1, 1)
    fault = (F.when(last == "", "blank").when(F.row_number().over(earlier) > 1, "duplicate")
             .when(~last.isin(*ENDS), "truncated").otherwise(""))
    return rows.withColumn("pos", F.row_number().over(place)).select(
        "key", "conv_id", "turn", "role", "text", "alive", "pos",
        F.when(first.isin("s", "u", "a"), first).otherwise("x").alias("initial"), fault.alias("fault"))


def in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key", "pos")


SUMMARY = "key string, conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, signature string"


def summaries(rows: DataFrame) -> DataFrame:
    """Of every conversation: counts of its faults and its signature, symbols s, u, a, x (upper case: truncated) and -."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SUMMARY.split(", ")]
        schema = pa.schema([(n, pa.string() if n in ("key", "signature") else pa.int64()) for n in names])
        done, now, key = [], None, None
        for batch in slices(batches, 5000):
            columns = (batch.column(c).to_pylist() for c in ("key", "conv_id", "turn", "alive", "initial", "fault"))
            for k, conv, turn, alive, initial, fault in zip(*columns):
                if now is None or k != key:
                    if now:
                        done.append(now.row())
                    now, key = Conversation(k, conv), k
                if alive:
                    now.add(turn, initial, fault)
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, d)) for d in done], schema)
                done = []
        if now:
            yield pa.RecordBatch.from_pylist([dict(zip(names, now.row()))], schema)

    return in_order(rows.select("key", "conv_id", "turn", "alive", "initial", "fault", "pos")).drop("pos").mapInArrow(run, SUMMARY)


class Conversation:
    """What is told of a conversation whose rows come in order."""

    def __init__(self, key: str, conv_id: int | None) -> None:
        self.key, self.conv_id = key, conv_id
        self.low = self.high = self.before = None
        self.turns = self.illegal = 0
        self.count = {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        self.symbols = bytearray()

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        if turn is not None and turn != self.high:  # turns rise
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        self.count[fault] += 1
        self.symbols += (b"-" if fault in ("blank", "duplicate") else
                         initial.upper().encode() if fault == "truncated" else initial.encode())

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.key, self.conv_id, gaps, self.count["blank"], self.count["duplicate"], self.count["truncated"],
                self.illegal, self.symbols.decode())


def node(symbol: str | None, after: list[Way] | None) -> list[Way]:
    """The best way from each state, where ``symbol`` is next and ``after`` are the ways from what follows it.

    No two edits of one state share an initial, so the initial alone decides between equal costs.
    """
    ways: list[Way] = []
    for state in range(4):
        if symbol is None:
            ways.append((0, "", state) if state in FINAL else (NEVER, "", state))
            continue
        found = [(DELETE + after[state][0], "D", state)]
        if symbol != "-":
            stays = TRUNCATED if symbol.isupper() else 0
            kept = LEGAL.get((state, symbol.lower()))
            if kept is not None:
                found.append((stays + after[kept][0], "K", kept))
            put = PUT[state]
            found.append((REROLE + stays + after[put][0], "R", put))
        ways.append(min(found))
    # Inserts stay at the node. Two in a row from user come back to it, so one look ahead is enough.
    user, assistant = ways[USER], ways[ASSISTANT]
    ways[USER] = min(user, (INSERT + assistant[0], "I", ASSISTANT))
    ways[ASSISTANT] = min(assistant, (INSERT + user[0], "I", USER))
    for state in (START, SYSTEM):
        ways[state] = min(ways[state], (INSERT + ways[USER][0], "I", USER))
    return ways


class Endings:
    """Nodes of the last signature, from its end; the next one reuses those of their common ending."""

    def __init__(self) -> None:
        self.symbols = ""
        self.nodes = [node(None, None)]
        self.solved = 0

    def plan(self, backward: str) -> tuple[int, str]:
        """Cost and audit of a signature, given from its end."""
        shared = sum(1 for _ in takewhile(lambda pair: pair[0] == pair[1], zip(self.symbols, backward)))
        del self.nodes[shared + 1:]
        for symbol in backward[shared:]:
            self.nodes.append(node(symbol, self.nodes[-1]))
        self.solved += len(backward) - shared
        self.symbols = backward
        at, state, audit = len(backward), START, []
        while (way := self.nodes[at][state])[1]:
            audit.append(way[1])
            at -= way[1] != "I"
            state = way[2]
        return self.nodes[-1][START][0], "".join(audit)


def plans(summary: DataFrame) -> DataFrame:
    """(signature, cost, audit) of every distinct signature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        endings = Endings()
        for batch in slices(batches):
            solved = [endings.plan(b) for b in batch.column("backward").to_pylist()]
            cost, audit = zip(*solved) if solved else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("signature"), pa.array(cost, pa.int64()), pa.array(audit, pa.string())],
                names=["signature", "cost", "audit"])

    distinct = stage(summary.select("signature").distinct().withColumn("backward", F.reverse("signature")), "signatures")
    placed = distinct.repartitionByRange("backward").sortWithinPartitions("backward")
    return placed.mapInArrow(run, "signature string, cost long, audit string")


RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")


class Repaired:
    """Carries out an audit on rows that come in order, and hashes what it leaves."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, START
        self.hash, self.empty = hashlib.sha256(), True

    def put(self, role: str, text: str) -> None:
        self.hash.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.empty = False

    def inserts(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            self.state = PUT[self.state]
            self.put(ROLES[self.state], "")

    def row(self, role: str, text: str, initial: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return
        self.state = LEGAL[self.state, initial] if edit == "K" else PUT[self.state]
        self.put(role if edit == "K" else ROLES[self.state], text)

    def digest(self) -> str:
        self.inserts()
        return self.hash.hexdigest()


def carried_out(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """One row a conversation: what ``solved`` tells of it, and the hash of its repaired turns."""
    # What is known of a conversation comes as a row in front of its turns, so audits are not copied to each.
    facts = [f for f in RESULT.split(", ")[:-1]]
    names = [f.split()[0] for f in facts]
    head = solved.select("key", F.lit(0).alias("pos"), F.struct(*names).alias("head"), *[
        F.lit(None).cast("string").alias(c) for c in ("role", "text", "initial")])
    turns = rows.where("alive").select("key", "pos", F.lit(None).cast(head.schema["head"].dataType).alias("head"),
                                       "role", "text", "initial")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.string() if n == "audit" else pa.int64()) for n in names] + [("repaired_sha256", pa.string())])
        done, now, told = [], None, None
        for batch in slices(batches):
            for head, role, text, initial in zip(*(batch.column(c).to_pylist() for c in ("head", "role", "text", "initial"))):
                if head is not None:
                    if now:
                        done.append({**told, "repaired_sha256": now.digest()})
                    now, told = Repaired(head["audit"]), head
                else:
                    now.row(role, text, initial)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if now:
            yield pa.RecordBatch.from_pylist([{**told, "repaired_sha256": now.digest()}], schema)

    return in_order(head.unionByName(turns)).drop("key", "pos").mapInArrow(run, RESULT)


def repair(damaged: DataFrame) -> DataFrame:
    """Faults, cheapest edits and the hash of the repaired turns of every conversation of ``damage``'s rows."""
    rows = stage(faults(damaged), "turns")
    summary = stage(summaries(rows), "conversations")
    solved = join_unique(summary, stage(plans(summary), "plans"), "signature")
    return carried_out(rows, solved)
