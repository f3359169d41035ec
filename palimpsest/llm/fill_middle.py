"""Fill-in-middle: a document is cut at two boundaries of its units and put together with its middle last.

A unit grammar is a few classes of characters. Each of them says where its units end, which is between two neighbouring
characters: the translation is a regular expression of no width, looking back at one class and ahead at another. Spark's
split cuts there and keeps every piece; an empty text, which split would give as one piece, has no units. Where the cuts
fall, and in which order the parts come, follows from a hash of the id. All is SQL functions, in one pass without a shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Unit:
    """Units of one class of characters, written as between square brackets: a run of them, one of them (run=False), or a
    run that may be empty up to a character of the class `end`; what a text ends with may lack the end."""

    body: str
    run: bool = True
    end: str | None = None

    @property
    def pattern(self) -> str:
        """The units as a regular expression that is matched from left to right."""
        return f"[{self.body}]*[{self.end}]|[{self.body}]+" if self.end else f"[{self.body}]" + "+" * self.run

    @property
    def boundary(self) -> str:
        """Where such a unit ends before another character."""
        other = self.body.removeprefix("^") if self.body.startswith("^") else f"^{self.body}"
        after, before = (self.end, r"\s\S") if self.end else (self.body, other if self.run else r"\s\S")
        return f"(?<=[{after}])(?=[{before}])"


#: Grammars by name; their classes leave no character out.
GRAMMARS = {
    "lines": (Unit(r"^\n", end=r"\n"),),
    "sentences": (Unit(r"^.!?\n", end=r".!?\n"),),
    "words": (Unit(r"\p{L}\p{M}\p{N}_"), Unit(r"\s"), Unit(r"^\p{L}\p{M}\p{N}_\s", run=False)),
    "characters": (Unit(r"\s\S", run=False),),
}


def boundary(grammar: str | tuple[Unit, ...]) -> str:
    """A regular expression of no width that matches between neighbouring units."""
    return "|".join(u.boundary for u in (GRAMMARS[grammar] if isinstance(grammar, str) else grammar))


def units(text: Column, grammar: str | tuple[Unit, ...] = "lines") -> Column:
    """The units of a text; none for an empty or null one."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) > 0, F.split(text, boundary(grammar))).otherwise(F.array().cast("array<string>"))


def id_hashes(key: Column, seed: int) -> Column:
    """The first four groups of eight digits of the hex sha256 of seed:id, as whole numbers; a null id is an empty text."""
    digest = F.array(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256))
    return F.transform(digest, lambda d: F.array(*[F.conv(F.substring(d, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]))[0]


def restored(output: Column, form: Column, sentinels: tuple[str, str, str]) -> Column:
    """The text that an output was made from: no part holds a sentinel, so it is cut at them."""
    parts = F.split(output, "|".join(map(re.escape, sentinels)))
    at = lambda *k: F.concat(*[F.get(parts, F.lit(i)) for i in k])
    return F.when(form == "plain", output).when(form == "psm", at(1, 3, 2)).otherwise(at(2, 3, 1))


def fill_in_middle(docs: DataFrame, grammar: str | tuple[Unit, ...] = "lines", rate: int = 100, spm: int = 50, seed: int = 7, sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n (units), form, prefix, middle and suffix (null if plain), output, restored.

    rate is the percentage of documents that are transformed, spm that of these which take the form spm; sentinels stand
    before prefix, suffix and middle. Empty and null texts, and such as hold a sentinel, are plain. Both cuts can be the
    same, and at either end. Rows of one id and text get one result, null ids that of an empty id; other columns are not read."""
    if not all(sentinels) or any(a != b and a in b or a[-k:] == b[:k] for a in sentinels for b in sentinels for k in range(1, min(len(a), len(b)))):
        raise ValueError("no sentinel may hold another one, or end as one begins")
    p, s, m = map(F.lit, sentinels)
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = docs.select(F.col(id_col), text.alias("_text"), units(text, grammar).alias("_units"), id_hashes(F.col(id_col), seed).alias("_h"))
    n, h = F.size("_units"), lambda i: F.col("_h")[i]
    first, second = (F.pmod(h(i), n + 1).cast("int") for i in (0, 1))
    plain = (n == 0) | F.contains("_text", p) | F.contains("_text", s) | F.contains("_text", m) | (h(2) % 100 >= rate)
    form = F.when(plain, "plain").when(h(3) % 100 < spm, "spm").otherwise("psm")
    cut = cut.select(id_col, "_text", "_units", n.cast("bigint").alias("n"), form.alias("form"), F.least(first, second).alias("_a"), F.greatest(first, second).alias("_b"))
    part = lambda start, size: F.when(F.col("form") != "plain", F.array_join(F.slice("_units", start, size), ""))
    a, b = F.col("_a"), F.col("_b")
    cut = cut.select(id_col, "_text", "n", "form", part(F.lit(1), a).alias("prefix"), part(a + 1, b - a).alias("middle"), part(b + 1, F.greatest(F.col("n").cast("int") - b, F.lit(0))).alias("suffix"))
    psm, other = F.concat(p, "prefix", s, "suffix", m, "middle"), F.concat(s, "suffix", p, "prefix", m, "middle")
    out = F.when(F.col("form") == "plain", F.col("_text")).when(F.col("form") == "psm", psm).otherwise(other)
    made = cut.select(id_col, "n", "form", "prefix", "middle", "suffix", out.alias("output"))
    return made.withColumn("restored", restored(F.col("output"), F.col("form"), sentinels))
