"""Fill-in-middle transformation by lookaround splitting.

A grammar of units names character classes and the pairs of neighbouring classes that stay
together. It becomes one zero-width expression, which matches between two characters whose
classes aren't such a pair; Spark's split by it keeps every piece. An empty text, which split
would call one empty piece, has no units.

Whether there is a boundary depends on two neighbouring characters only, so a long text is
split a chunk at a time, with one character of overlap, and no array holds all of its units.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.llm.common import whole

#: Characters that are split at once.
CHUNK = 1 << 17
#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Of a hundred documents, how many are transformed, and of a hundred of these, how many put the
#: suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20


@dataclass(frozen=True)
class Grammar:
    """classes: name to the inside of a character class of java.util.regex; together they hold
    every character, each in one. joined: pairs (left, right) without a boundary between them."""

    classes: dict[str, str]
    joined: tuple[tuple[str, str], ...] = ()

    def boundary(self) -> str:
        """The zero-width expression of the places between units."""
        cuts = []
        for left, inside in self.classes.items():
            right = "".join(c for name, c in self.classes.items() if (left, name) not in self.joined)
            if right:
                cuts.append(f"(?<=[{inside}])(?=[{right}])")
        return "|".join(cuts) or "(?!)"


_WORD, _SPACE = r"\p{L}\p{M}\p{N}_", r"\p{Z}\x09-\x0D"
GRAMMARS = {
    "code_point": Grammar({"any": r"\x{0}-\x{10FFFF}"}),
    # a unit is a word with the white space before it, or a run of other characters
    "word": Grammar({"word": _WORD, "space": _SPACE, "other": rf"[^{_WORD}{_SPACE}]"}, (("word", "word"), ("space", "space"), ("space", "word"), ("other", "other"))),
    # a unit is a line with its end
    "line": Grammar({"end": r"\n", "rest": r"[^\n]"}, (("rest", "rest"), ("rest", "end"))),
}


def _pieces(text: Column, chunk: Column, boundary: str) -> Column:
    """Units of a chunk and of the character after it."""
    return F.split(F.substring(text, chunk * CHUNK + 1, F.lit(CHUNK + 1)), boundary)


def _with(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is computed once, however often fn uses it."""
    return F.transform(F.array(value), fn)[0]


def _length(pieces: Column, k: Column) -> Column:
    """Characters of the first k pieces."""
    return F.char_length(F.array_join(F.slice(pieces, F.lit(1), k.cast("int")), ""))


def _state(n: Column, first: Column, second: Column) -> Column:
    return F.struct(n.cast("long").alias("n"), first.cast("long").alias("first"), second.cast("long").alias("second"))


def _ends(n: Column) -> tuple[Column, Column]:
    """Units before the end of the prefix and of the middle."""
    drawn = [F.col(h) % (n + 1) for h in ("h1", "h2")]
    return F.least(*drawn), F.greatest(*drawn)


def _in_one(boundary: str) -> Column:
    """Units of a text that is split at once, and the characters before both ends."""

    def found(pieces: Column) -> Column:
        n = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.size(pieces))
        return _state(n, *[F.when(F.col("drawn"), _length(pieces, k)) for k in _ends(n)])

    return _with(F.split("text", boundary), found)


def _cuts(boundary: str) -> Column:
    """Boundaries in each chunk of a text."""
    chunks = F.sequence(F.lit(0), F.floor(F.greatest(F.col("size") - 1, F.lit(0)) / CHUNK).cast("int"))
    return F.transform(chunks, lambda i: F.size(_pieces(F.col("text"), i, boundary)) - 1)


def _in_chunks(boundary: str) -> Column:
    """As _in_one for a longer text, by its column ``cuts``: chunks in which the prefix or the
    middle ends are split again."""

    def places(n: Column) -> Column:
        ends = _ends(n)

        def step(acc: Column, i: Column) -> Column:
            after = acc["n"] + F.col("cuts")[i]
            here = [(k > acc["n"]) & (k <= after) for k in ends]
            split = lambda p: _state(after, *[F.when(e, i * CHUNK + _length(p, k - acc["n"])).otherwise(acc[name]) for k, e, name in zip(ends, here, ("first", "second"))])
            return F.when(here[0] | here[1], _with(_pieces(F.col("text"), i, boundary), split)).otherwise(_state(after, acc["first"], acc["second"]))

        # where no boundary ends the units, it is the text's end, or its start
        edges = [F.when(k == 0, F.lit(0)).otherwise(F.col("size")) for k in ends]
        chunks = F.when(F.col("drawn"), F.sequence(F.lit(0), F.size("cuts") - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(chunks, _state(F.lit(0), *edges), step, lambda acc: _state(n, *[F.when(F.col("drawn"), acc[name]) for name in ("first", "second")]))

    return _with(1 + F.aggregate("cuts", F.lit(0).cast("long"), lambda a, x: a + x), places)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The exact text of an output: marks stand in it once each, since texts with one are plain."""
    parts = F.split(output, "|".join(f"\\Q{m}\\E" for m in marks))
    rebuilt = _with(parts, lambda p: F.when(form == "psm", F.concat(p[1], p[3], p[2])).otherwise(F.concat(p[2], p[3], p[1])))
    return F.when(form == "plain", output).otherwise(rebuilt)


def fill_in_middle(docs: DataFrame, grammar: Grammar | str = "code_point", marks: tuple[str, str, str] = MARKS, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST, seed: str = "1") -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of every whole text.

    Cuts and form are drawn from the SHA-256 of seed, a colon and doc_id, so a row's result
    depends on nothing but its id and text. form is ``plain`` (output is the text, the lengths
    are null) for texts that are empty or hold a mark and for those not drawn, ``spm`` (suffix,
    prefix, middle) or ``psm``. A null text counts as empty; a null doc_id draws like an empty
    one. Repeated rows get the same values, an empty table an empty result; only doc_id and
    text are read. Very long texts are split a chunk at a time. All of it is SQL functions.
    """
    boundary = (GRAMMARS[grammar] if isinstance(grammar, str) else grammar).boundary()
    prefix_mark, suffix_mark, middle_mark = marks
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    drawn = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select("doc_id", whole()).select("doc_id", "text", F.char_length("text").alias("size"), *drawn)
    rows = rows.withColumn("drawn", ~((F.col("size") == 0) | F.contains("text", F.lit(prefix_mark)) | F.contains("text", F.lit(suffix_mark)) | F.contains("text", F.lit(middle_mark)) | (F.col("h3") % 100 >= transformed)))
    rows = rows.withColumn("cuts", F.when(F.col("size") > CHUNK, _cuts(boundary)))
    rows = rows.withColumn("units", F.when(F.col("cuts").isNull(), _in_one(boundary)).otherwise(_in_chunks(boundary)))
    rows = rows.withColumn("form", F.when(~F.col("drawn"), "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm"))
    first, second = F.col("units.first"), F.col("units.second")
    part = lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int"))
    prefix, middle, suffix = part(F.lit(0), first), part(first, second), part(second, F.col("size"))
    psm = F.concat(F.lit(prefix_mark), prefix, F.lit(suffix_mark), suffix, F.lit(middle_mark), middle)
    spm = F.concat(F.lit(suffix_mark), suffix, F.lit(prefix_mark), prefix, F.lit(middle_mark), middle)
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return rows.select("doc_id", F.col("units.n").alias("n"), "form", first.alias("prefix_chars"), (second - first).alias("middle_chars"), output.alias("output"))
