"""Conversation structure repair: the cheapest edits that give a conversation the roles (system? (user assistant)+)?.

A forward Viterbi pass over the turns of each conversation keeps, for each of the grammar's four states, the least (cost,
audit): audit is the initials of the edits so far. A turn's layer is made by deleting, keeping or reroling the turn, and
closed by inserted turns, of which two lead from any state to any other that inserts can reach. The cost is a function of the
audit, so of two equal costs in a layer neither audit begins the other, and the lesser one stays the lesser whatever follows.

Rows are dealt by conversation, sorted, and stream by: a conversation's texts are not held. A path carries the hash of its
repaired text along. What all paths have in common is decided and put away, and a path is dropped once it costs so much that
another one does better whatever follows, so the paths stay short. What a task keeps of a conversation is its audit and 16
bytes for each distinct turn, and on demand the repaired turns. The digest of a whole conversation is sequential work by
nature, so that one conversation is read by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space, as texts are stripped of it; ends of whole texts; fixed values.
WHITE, ENDS = " \t\n\v\f\r", ".!?"
#: Costs of the edits; a truncated turn that stays adds one.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: What another path costs at most beyond any path from the same turn on, whatever its state (a system turn to delete and an
#: answer to insert): a path that costs more than this above the least one is never the cheapest.
MOST_BEHIND = DELETE + INSERT
#: The grammar's states: at the start, after the system turn, after a question, after an answer; by initial of a role.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
WHOLE = (0, 3)
ROLES = {"u": "user", "a": "assistant"}


class Path(NamedTuple):
    cost: int
    audit: str
    digest: object  # of hashlib; None before the first turn
    turns: tuple | None  # (turns before, role, text)


class Repair:
    """One conversation: turns go in by add(), done() gives its row."""

    def __init__(self, key: object, with_turns: bool):
        self.key, self.with_turns = key, with_turns
        self.decided: list[str] = []
        self.seen: set[bytes] = set()
        self.low = self.high = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before: str | None = None
        self.layer = self._closed([((0, ""), Path(0, "", None, None), ()), None, None, None])

    def _closed(self, found: list) -> list[Path | None]:
        """The paths of a layer: of (key, path before, turns it adds) by state, after inserts."""
        for _ in range(2):
            for state, own in enumerate(found):
                if own:
                    (cost, audit), path, turns = own
                    for initial, to in NEXT[state].items():
                        key = (cost + INSERT, audit + "I")
                        if initial in ROLES and (found[to] is None or key < found[to][0]):
                            found[to] = (key, path, (*turns, (ROLES[initial], "")))
        least = min(own[0][0] for own in found if own)
        return [self._extended(*own) if own and own[0][0] <= least + MOST_BEHIND else None for own in found]

    def _extended(self, key: tuple[int, str], path: Path, turns: tuple) -> Path:
        digest, held = path.digest, path.turns
        if turns:
            text = "\n".join(f"{role}:{text}" for role, text in turns)
            digest = digest.copy() if digest else None
            if digest:
                digest.update(b"\n")
            else:
                digest = hashlib.sha256()
            digest.update(text.encode("utf-8", "replace"))
            if self.with_turns:
                for role, own in turns:
                    held = (held, role, own)
        return Path(*key, digest, held)

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            self.distinct += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        stripped = text.strip(WHITE)
        mark = xxhash.xxh3_128_digest(f"{len(role)}:{role}{text}".encode("utf-8", "replace"))
        blank, again = not stripped, mark in self.seen
        self.seen.add(mark)
        cut = not blank and not again and stripped[-1] not in ENDS
        self.blank += blank
        self.duplicate += again and not blank
        self.truncated += cut
        found: list = [None] * 4

        def offer(to: int, path: Path, cost: int, edit: str, turns: tuple) -> None:
            key = (path.cost + cost, path.audit + edit)
            if found[to] is None or key < found[to][0]:
                found[to] = (key, path, turns)

        for state, path in enumerate(self.layer):
            if path:
                offer(state, path, DELETE, "D", ())
                if not blank and not again:
                    for c, to in NEXT[state].items():
                        if c == initial:
                            offer(to, path, cut * TRUNCATED, "K", ((role, text),))
                        if c in ROLES:
                            offer(to, path, REROLE + cut * TRUNCATED, "R", ((ROLES[c], text),))
        self.layer = self._closed(found)
        paths = [p for p in self.layer if p]
        if len(paths[0].audit) > 32 and (common := commonprefix([p.audit for p in paths])):
            self.decided.append(common)
            self.layer = [p and p._replace(audit=p.audit[len(common) :]) for p in self.layer]

    def done(self) -> tuple:
        best = min((p for s in WHOLE if (p := self.layer[s])), key=lambda p: (p.cost, p.audit))
        turns, at = [], best.turns
        while at:
            turns.append({"role": at[1], "text": at[2]})
            at = at[0]
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        digest = (best.digest or hashlib.sha256()).hexdigest()
        return (self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, best.cost, "".join([*self.decided, best.audit]), digest, *([turns[::-1]] if self.with_turns else []))


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair(rows: DataFrame, absent: Column | None = None, with_turns: bool = True, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: its id, gaps (numbers that are missing between the first and the last turn), blank,
    duplicate and truncated (turns by their first fault), illegal (neighbours whose role initials are not su, ua or au), cost,
    audit, repaired_sha256 (of role:text of the repaired turns, joined by line feeds) and, with_turns, the turns.

    Turns are taken by number, null numbers first, equal ones by role and text. Null roles and texts count as one space, which
    is blank; a null id is a conversation like others. Blank turns and repetitions of an earlier role and text must go; a
    conversation of which nothing is left has an empty audit or one of deletions. Rows for which `absent` holds are no
    turns, but their conversation has a row. Other columns are not read. Numbers must fit 64 bits."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col)]
    gone = F.lit(False) if absent is None else F.coalesce(absent, F.lit(False))
    turns = rows.select(F.col(conv_col).alias("c"), F.col(turn_col).cast("bigint").alias("n"), texts[0].alias("r"), texts[1].alias("t"), gone.alias("gone"))
    dealt = turns.repartition("c").sortWithinPartitions("c", F.col("n").asc_nulls_first(), "r", "t")
    kind = rows.schema[conv_col].dataType.simpleString()
    schema = f"`{conv_col}` {kind}, {', '.join(f'{c} bigint' for c in COUNTS)}, audit string, repaired_sha256 string" + ", turns array<struct<role:string,text:string>>" * with_turns
    from pyspark.sql.pandas.types import to_arrow_type

    held = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    kinds = [to_arrow_type(rows.schema[conv_col].dataType), *[pa.int64()] * len(COUNTS), pa.string(), pa.string(), *[held] * with_turns]
    names = [conv_col, *COUNTS, "audit", "repaired_sha256", *["turns"] * with_turns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, size, own = [], 0, None

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*made, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for c, n, r, t, away in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if own is None or c != own.key:
                    if own is not None:
                        made.append(own.done())
                        size += 1
                    own = Repair(c, with_turns)
                if not away:
                    own.add(n, r, t)
                    size += len(t) * with_turns // 1000
                if size > 1000:
                    if made:
                        yield table()
                    made, size = [], 0
        if own is not None:
            made.append(own.done())
        if made:
            yield table()

    return dealt.mapInArrow(run, schema)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, by crc32 of conv_id:turn modulo 20: 0 leaves the row as absent, 1 empties the text,
    2 removes its sentence ends, 3 repeats the row, 4 makes it the user's. Nulls count as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.encode(F.concat(space("conv_id"), F.lit(":"), space("turn")), "utf-8")) % 20
    faulty = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return faulty.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fault") == 0).alias("absent"), times.alias("copy")).drop("copy")
