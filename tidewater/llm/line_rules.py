"""Quality rules that look at lines first.

Each line is judged by punctuation, navigation and boilerplate rules; failing lines are removed,
and a document that loses too much of its text is rejected. A few whole-text counts (repeated
three-word windows, repeated lines) come along and give the base rules.

All of it is one projection of built-in functions: no shuffle, no Python, one task per file split.

Edge cases: null and empty texts have no words and fail the base rule; a text of one huge line is
one line; repeated rows are judged alike; an empty table gives no rows; only doc_id and text are
read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_column

BLANKS = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
#: Marks that running prose seldom has; a line made of more than NOISE_PERCENT of them is no prose.
NOISE = "#*$%&|<>!{}[]=_~^+\\"
NOISE_PERCENT = 10
SEPARATORS = "|>»•·"
ENDS = ".!?:;,…\"'”’)]。！？"
#: A line of so many words that ends without a mark is no sentence; longer ones are prose cut short.
UNENDED_WORDS = (3, 20)
#: Phrases of site furniture and licences; a line counts if it is no longer than BOILERPLATE_CHARS.
BOILERPLATE = (
    "cookie", "javascript", "lorem ipsum", "terms of use", "terms of service", "privacy policy", "all rights reserved", "©", "copyright",
    "licensed under", "spdx-license", "subscribe", "sign up", "sign in", "click here", "read more", "share this",
)
BOILERPLATE_CHARS = 400
MAX_LOST_PERCENT = 50
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def without(c, chars: str):
    return F.translate(c, chars, "")


def bare(c):
    """c without blanks at its ends."""
    return F.trim(c, F.lit(BLANKS))


def times(c, mark: str):
    """How often a single character occurs."""
    return (F.octet_length(c) - F.octet_length(F.replace(c, F.lit(mark), F.lit("")))) / len(mark.encode())


def any_of(tests):
    out = None
    for t in tests:
        out = t if out is None else out | t
    return out


def let(value, body):
    """body over value, computed once; lambdas share no subexpressions otherwise."""
    return F.element_at(F.transform(F.array(value), body), 1)


def line_fault(line):
    """The rule that a line fails, or null; blank lines pass. Words of a line: its spaces and one."""
    boilerplate = (F.char_length(line) <= BOILERPLATE_CHARS) & let(F.lower(line), lambda low: any_of(F.contains(low, F.lit(x)) for x in BOILERPLATE))
    separators = sum((times(line, c) for c in SEPARATORS[1:]), times(line, SEPARATORS[0]))
    sizes = F.struct(
        F.char_length(line).alias("chars"),
        (times(line, " ") + 1).alias("words"),
        separators.alias("separators"),
        F.char_length(without(line, NOISE)).alias("quiet"),
    )
    return (
        F.when(bare(line) == "", None)
        .when(boilerplate, "boilerplate")
        .otherwise(
            let(
                sizes,
                lambda n: F.when((n["separators"] >= 2) & (n["separators"] * 4 >= n["words"]), "navigation")
                .when((n["chars"] - n["quiet"]) * 100 > (n["chars"] - n["words"] + 1) * NOISE_PERCENT, "punctuation")
                .when(n["words"].between(*UNENDED_WORDS) & ~F.contains(F.lit(ENDS), F.right(bare(line), F.lit(1))), "punctuation"),
            )
        )
    )


def judged(docs: DataFrame) -> DataFrame:
    """Per document: base counts, lines and characters lost, and both verdicts."""
    lines_of = docs.select("doc_id", text_column(docs).alias("text")).select(
        "doc_id",
        "text",
        F.filter(F.split(F.translate("text", BLANKS, " " * len(BLANKS)), " "), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: bare(x) != "").alias("lines"),
    )
    counted = lines_of.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("codes"),
        F.size("lines").cast("long").alias("n_lines"),
        F.transform("lines", lambda x: F.struct(F.char_length(x).cast("long").alias("chars"), line_fault(x).alias("fault"))).alias("faults"),
    )
    #: Windows sorted by their 64-bit code and place: equal windows stand side by side.
    windows = counted.withColumn(
        "windows",
        F.expr("""if(size(codes) < 3, cast(array() AS array<struct<code:bigint,at:int>>),
                     sort_array(transform(sequence(0, size(codes) - 3), i -> named_struct('code', xxhash64(codes[i], codes[i + 1], codes[i + 2]), 'at', i))))"""),
    )
    repeated = windows.withColumn(
        "starts",
        F.expr("""transform(filter(windows, (w, k) -> coalesce(get(windows, k - 1).code = w.code, false) OR coalesce(get(windows, k + 1).code = w.code, false)), w -> w.at)"""),
    )
    lost = lambda c: F.aggregate(F.filter("faults", lambda x: x["fault"].isNotNull()), F.lit(0).cast("long"), lambda a, x: a + c(x))
    out = repeated.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.size(F.array_distinct(F.concat("starts", F.transform("starts", lambda s: s + 1), F.transform("starts", lambda s: s + 2)))).cast("long").alias("n_repeat_words"),
        "n_lines",
        lost(lambda x: F.lit(1).cast("long")).alias("n_lines_removed"),
        lost(lambda x: x["chars"]).alias("chars_removed"),
        F.aggregate("faults", F.lit(0).cast("long"), lambda a, x: a + x["chars"]).alias("line_chars"),
    )
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return out.withColumn("base_failed", base).withColumn(
        "kept", ~F.col("base_failed") & (F.col("chars_removed") * 100 <= F.col("line_chars") * MAX_LOST_PERCENT)
    )


def clean_text(c):
    """The text without its failing lines; blank lines stay."""
    return F.array_join(F.filter(F.split(c, "\n"), lambda x: line_fault(x).isNull()), "\n")


def clean(docs: DataFrame) -> DataFrame:
    """docs with cleaned texts, rejected documents left out."""
    kept = judged(docs).where("kept").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").withColumn("text", clean_text(text_column(docs)))
