"""Line-first cleaning with DataFrame functions only.

Rules look at each line by itself: punctuation (no sentence ends in the
line, and the next line doesn't go on in lower case), symbols, shouting,
navigation and boilerplate.  Failing lines are removed, as are repeats of
an earlier line, and a document that loses more than ``MAX_LOST`` of the
characters of its lines with a word is rejected.  The base statistics
beside them follow fixed definitions.

Words are runs of characters other than space, tab and the line breaks
from 0x0A to 0x0D.  Edge cases: a null text counts as empty; an empty
text has no words, fails the base rules and has a null ``cleaned`` only
if the text was null; lines without a word are neither removed nor
counted; an empty table gives no rows; repeated rows give repeated
results; other columns of the input are ignored.  A line's last character
U+E000, which is of private use, is not kept in ``cleaned``: it marks
lines that go on.  Everything is one projection: no shuffle, no state
beyond the row, so very long texts only need memory in proportion to
their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of the characters of a document's lines that may go with the failing ones.
MAX_LOST = 0.5
#: Words under which a document fails the base rules.
MIN_WORDS = 50

SPACE = r"[\x20\x09-\x0D]+"
#: Separators of navigation lines.
SEPARATOR = r"[|\u00bb\u203a\u00b7\u2022\u2192]"
#: The end of a sentence inside a line or at its end.
SENTENCE_END = r"[.!?:;\u2026][\x22')\]\u201d\u2019\u00bb]*(?:[\x20\x09-\x0D]|$)|[\u3002\uff01\uff1f]"
#: Marks a line whose sentence goes on in the next one.
GOES_ON = "\ue000"
#: Runs of letters that aren't capitals; one letter stands for each run where only marks, capitals and words count.
SMALL = r"[\p{L}&&[^\p{Lu}]]+"
#: Fixed phrases of boilerplate lines.
BOILERPLATE = (
    "cookie", "privacy policy", "terms of use", "terms of service", "all rights reserved", "copyright (c)", "subscribe to", "sign up for",
    "click here", "read more", "share this", "log in", "javascript", "released under the", "licensed under", "lorem ipsum",
)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def has_word(text: Column) -> Column:
    return F.rlike(text, F.lit(r"[^\x20\x09-\x0D]"))


def bind(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once, as Catalyst copies an expression to each place that names it."""
    return F.transform(F.array(value), use)[0]


def repeat_words(words: Column) -> Column:
    """Words inside windows of three words that occur at least twice in the text.

    Windows are sorted by hash, so equal ones are neighbours; the start
    positions of repeated windows then tell the covered words.
    """

    def covered(starts: Column) -> Column:
        steps = F.zip_with(F.slice(starts, 2, F.size(starts)), F.slice(starts, 1, F.greatest(F.size(starts) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(3)))
        return F.when(F.size(starts) == 0, F.lit(0)).otherwise(F.aggregate(steps, F.lit(3), lambda acc, x: acc + x))

    def starts(found: Column) -> Column:
        again = F.zip_with(
            F.slice(found, 2, F.size(found)),
            F.slice(found, 1, F.size(found) - 1),
            lambda b, a: F.when(a["h"] == b["h"], F.array(a["at"], b["at"])),
        )
        return F.array_sort(F.array_distinct(F.flatten(F.filter(again, lambda x: x.isNotNull()))))

    def windows(w: Column) -> Column:
        return F.array_sort(
            F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("at")))
        )

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

    # Most texts repeat no window: distinct hashes tell, without sorting.
    def repeated(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes(w))) == F.size(w) - 2, F.lit(0)).otherwise(bind(bind(windows(w), starts), covered))

    return bind(words, lambda w: F.when(F.size(w) >= 4, repeated(w)).otherwise(F.lit(0))).cast("long")


def line_fails(line: Column) -> Column:
    """The per-line rules; a line without a word passes.  GOES_ON at its end says that its sentence goes on.

    Most counts are of a reduced line, in which one letter stands for a
    run of small ones, as those are cheap on long texts.
    """

    goes_on = F.endswith(line, F.lit(GOES_ON))

    def counted(reduced: Column) -> Column:
        n_words = F.regexp_count(reduced, F.lit(r"[^\x20\x09-\x0D]+"))
        n = F.length(line) - goes_on.cast("int") - F.regexp_count(reduced, F.lit(r"[\x20\x09-\x0D]"))  # characters beside the blanks
        return bind(F.regexp_replace(reduced, r"[\p{L}\x20\x09-\x0D]+", ""), lambda marks: judged(reduced, marks, n_words, n))

    def judged(reduced: Column, marks: Column, n_words: Column, n: Column) -> Column:
        """marks: the characters that are neither letters nor blanks, once joined."""
        others = F.length(marks)
        letters = n - others
        pipes = F.regexp_count(marks, F.lit(SEPARATOR))
        symbols = F.regexp_count(marks, F.lit(r"[#*$%&|<>{}~^=\\@_]"))
        symbolic = (others * 5 > n) & (symbols * 5 > n)
        navigation = (pipes >= 2) & (pipes * 2 >= n_words - pipes)
        no_prose = (letters * 2 < n) & (n >= 8)
        shouting = (letters >= 12) & (n_words >= 3) & F.rlike(reduced, F.lit(r"\p{Lu}[^\p{L}]?\p{Lu}")) & (F.regexp_count(reduced, F.lit(r"\p{Lu}")) * 2 > letters)
        boilerplate = (n_words <= 12) & bind(F.lower(line), lambda low: F.exists(F.array(*map(F.lit, BOILERPLATE)), lambda b: F.contains(low, b)))
        unpunctuated = ~goes_on & ~F.rlike(reduced, F.lit(SENTENCE_END))
        return symbolic | navigation | no_prose | shouting | boilerplate | unpunctuated

    return has_word(line) & bind(F.regexp_replace(F.regexp_replace(line, SMALL, "a"), f"{GOES_ON}$", ""), counted)


def first_lines(marked: Column) -> Column:
    """The lines without those that repeat an earlier one; the first of equals keeps its own mark.

    Lines that occur both with and without a mark are rare, so only texts
    with such a line are sorted to find the first of each.
    """
    bare = lambda x: F.regexp_replace(x, f"{GOES_ON}$", "")

    def sorted_out(lines: Column) -> Column:
        numbered = F.array_sort(F.transform(lines, lambda x, i: F.struct(bare(x).alias("line"), i.alias("at"), x.alias("marked"))))
        new = lambda s: F.zip_with(F.slice(s, 2, F.size(s)), F.slice(s, 1, F.size(s) - 1), lambda x, before: F.when(x["line"] != before["line"], x))
        firsts = F.transform(bind(numbered, lambda s: F.concat(F.slice(s, 1, 1), F.filter(new(s), lambda x: x.isNotNull()))), lambda x: F.struct(x["at"].alias("at"), x["marked"].alias("marked")))
        return F.transform(F.array_sort(firsts), lambda x: x["marked"])

    def judged(lines: Column) -> Column:
        with_mark = F.filter(lines, lambda x: F.endswith(x, F.lit(GOES_ON)))
        both = (F.size(with_mark) > 0) & F.arrays_overlap(F.transform(with_mark, bare), lines)
        return F.when(both, sorted_out(lines)).otherwise(lines)

    return bind(F.array_distinct(marked), judged)


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """doc_id, base statistics, base_failed, kept, lost (share of characters removed) and cleaned (the text left)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.col(text_col).isNull().alias("absent"))
    rows = rows.select("*", words_of(F.col("text")).alias("words"), F.split("text", "\n", -1).alias("lines"))
    rows = rows.select(
        "doc_id",
        "text",
        "absent",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        F.filter("lines", has_word).alias("worded"),
        # A line that begins with a small letter goes on from the one before it.
        F.filter(first_lines(F.split(F.regexp_replace("text", r"\n(?=\p{Ll})", f"{GOES_ON}\n"), "\n", -1)), lambda x: ~line_fails(x)).alias("passing"),
    )
    rows = rows.withColumn("passing", F.transform("passing", lambda x: F.regexp_replace(x, f"{GOES_ON}$", "")))
    size = lambda ls: F.aggregate(ls, F.lit(0), lambda acc, x: acc + F.length(x))
    rows = rows.select(
        "doc_id",
        "absent",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.when(F.col("word_chars") > 0, F.greatest(F.lit(0.0), 1 - size(F.filter("passing", has_word)) / size(F.col("worded")))).otherwise(F.lit(0.0)).alias("lost"),
        F.array_join("passing", "\n").alias("cleaned"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("lost") <= max_lost)).alias("kept"),
        "lost",
        F.when(~F.col("absent"), F.col("cleaned")).alias("cleaned"),
    )
