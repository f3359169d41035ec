"""Streamed answers of remote services as they arrive: how each ends, told as soon as it is known."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What is no white space, as for the batch query.
_VISIBLE = re.compile(r"[^ \t\n\x0b\f\r]")
#: What is kept of an answer: one state for each key, with a timer.
STATE = "text string, any boolean, used int, prompt_tok bigint, cand_tok bigint, total_tok bigint, known boolean, over boolean"


class Answer:
    """What has come of one answer so far."""

    def __init__(self, state: tuple | None = None):
        self.text, self.any, self.used, self.prompt, self.cand, self.total, self.known, self.over = state or ("", False, 0, None, None, None, False, False)

    def state(self) -> tuple:
        return self.text, self.any, self.used, self.prompt, self.cand, self.total, self.known, self.over

    def take(self, text: str | None, prompt: int | None, cand: int | None, total: int | None, least: float, early_exit: bool) -> str | None:
        """Adds an event; the outcome if it decides the answer."""
        self.used += 1
        known = prompt is not None and total is not None
        if known and not self.known:
            self.prompt, self.cand, self.total, self.known = prompt, cand, total, True
        aborted = not self.any and known and max(0, total - prompt - (cand or 0)) >= least
        self.text += text or ""
        self.any = self.any or bool(text)
        return "reasoning abort" if aborted else "early exit" if early_exit and _VISIBLE.search(self.text) else None

    def row(self, call: object, outcome: str | None) -> dict:
        text = self.text.strip()
        outcome = outcome or ("full" if text else "fallback")
        return {"call": call, "outcome": outcome, "text": "" if outcome == "reasoning abort" else text, "used": self.used, "prompt_tok": self.prompt, "cand_tok": self.cand, "total_tok": self.total}


def _whole(x: object) -> int | None:
    return None if pd.isna(x) else int(x)


def _rows(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["call", "outcome", "text", "used", "prompt_tok", "cand_tok", "total_tok"])
    return out.astype({"used": "int32", **dict.fromkeys(("prompt_tok", "cand_tok", "total_tok"), "Int64")})


def live_outcomes(events: DataFrame, call: str = "call", order: str = "seq", last: str | None = None, budget: int = 8192, share: float = 0.6, early_exit: bool = True, wait_seconds: float = 60.0) -> DataFrame:
    """The rows of stream_outcomes from a stream of events (call, seq, text, prompt_tok, cand_tok, total_tok), each once: when
    an event decides the answer, when the event that `last` marks has come, or when none has come for wait_seconds. An answer's
    events must arrive in order, within a batch in any. A decided answer's
    later events are let pass until its state goes, with the mark or by the timer. Output mode update."""
    kind = events.schema[call].dataType.simpleString()
    whole = lambda c: F.col(c).cast("bigint").alias(c)
    own = events.select(F.col(call).alias("call"), F.col(order).alias("seq"), "text", whole("prompt_tok"), whole("cand_tok"), whole("total_tok"), (F.col(last) if last else F.lit(False)).cast("boolean").alias("last"))
    least, wait_ms = share * budget, int(wait_seconds * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        answer = Answer(state.get if state.exists else None)
        if state.hasTimedOut:
            state.remove()
            if not answer.over:
                yield _rows([answer.row(key[0], None)])
            return
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        ended, outcome = bool(rows["last"].eq(True).any()), None
        for e in rows.itertuples(index=False):
            if answer.over:
                break
            outcome = answer.take(None if pd.isna(e.text) else e.text, _whole(e.prompt_tok), _whole(e.cand_tok), _whole(e.total_tok), least, early_exit)
            if outcome:
                yield _rows([answer.row(key[0], outcome)])
                answer.over, answer.text = True, ""
        if ended:
            if not answer.over:
                yield _rows([answer.row(key[0], None)])
            if state.exists:
                state.remove()
        else:
            state.update(answer.state())
            state.setTimeoutDuration(wait_ms)

    schema = f"call {kind}, outcome string, text string, used int, prompt_tok bigint, cand_tok bigint, total_tok bigint"
    found = own.groupBy("call").applyInPandasWithState(run, schema, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)
    return found.withColumnRenamed("call", call)
