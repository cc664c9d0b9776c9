"""Line-first cleaning with native column expressions only.

Every line of a text is judged by punctuation, navigation and boilerplate rules; failing lines are removed and a
document that loses too much of its text is rejected. Whole texts are judged inside one projection: no shuffle, no
Python workers, and memory bounded by one text.

Defined cases: a null text counts as empty (no lines, no words, rejected); repeated rows and ties are judged each by
itself; a very long text is judged whole; an empty table gives no rows; columns of the input are kept, and an input
column with the name of a result column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm.names import spare

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules and of the verdict."""

    terminal: str = ".!?:;…。！？\"'”’»)]"
    sentence_end: str = r"[.!?。！？] "
    #: End marks of further scripts (Arabic, Urdu, Indic, Ethiopic, Burmese, Khmer, Tibetan, Armenian, Hebrew, full width).
    other_terminal: str = "؟؛۔।॥።፧၊။។៕།༎։׃．｡：；」』）】》〉］"
    other_sentence_end: str = r"[؟۔।॥።፧။។៕։׃] |[。！？｡][^。！？｡]"
    #: Scripts that write sentences without end marks.
    unmarked: str = r"[\p{IsThai}\p{IsLao}]"
    cased: str = r"[\p{Lu}\p{Ll}]"
    uncased: str = r"[\p{Lo}&&[^ªº]]"
    separators: str = "[|>»·•]"
    symbols: str = "[#*$%&|<>]"
    max_separator_share: float = 0.2
    max_symbols_per_word: float = 0.3
    max_shouts_per_word: float = 0.3
    boilerplate_words: int = 30
    boilerplate: str = (
        r"(?i)\b(all rights reserved|terms of (use|service)|privacy policy|cookie (policy|settings|consent)|"
        r"(enable|requires?) javascript|lorem ipsum|click here|read more|sign (in|up)|log ?in|subscribe (now|to)|"
        r"skip to (main )?content|share (this|on)|licensed under)\b"
    )
    max_lost_share: float = 0.5


def let(value: Column, body) -> Column:
    """Bind ``value`` once for use inside higher-order functions, where a repeated expression would be evaluated anew."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_array(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space."""
    return F.array_remove(F.split(text, "[ \\x09-\\x0D]+"), "")


def _count_of(text: Column, pattern: str) -> Column:
    """How many characters of ``text`` match a one-character pattern; texts without any are only scanned."""
    return F.when(text.rlike(pattern), F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).otherwise(0)


def repeated_word_count(words: Column, few: int = 32) -> Column:
    """Words inside 3-word windows that occur at least twice in the text, first occurrences included.

    A hashed pass finds the windows that may repeat (texts with over ``few`` different ones keep all their windows);
    these are sorted as strings, so the count doesn't rest on hashes.
    """

    def window(w: Column, i: Column) -> Column:
        return F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("w"), i.alias("i"))

    def flagged(s: Column) -> Column:
        hit = F.filter(
            F.transform(
                s,
                lambda x, k: F.when(((k > 0) & (F.get(s, k - 1)["w"] == x["w"])) | ((k < F.size(s) - 1) & (F.get(s, k + 1)["w"] == x["w"])), x["i"]),
            ),
            lambda i: i.isNotNull(),
        )
        return let(F.sort_array(hit), covered)

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda i, k: F.when(k < F.size(p) - 1, F.least(F.lit(3), F.get(p, k + 1) - i)).otherwise(3))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def of_hashes(w: Column, h: Column) -> Column:
        sorted_ = F.sort_array(h)
        twice = let(sorted_, lambda s: F.array_distinct(F.filter(s, lambda x, k: (k > 0) & (x == F.get(s, k - 1)))))
        places = F.sequence(F.lit(0), F.size(w) - 3)

        def of_twice(t: Column) -> Column:
            maybe = F.when(F.size(t) <= few, F.filter(places, lambda i: F.array_contains(t, F.get(h, i)))).otherwise(places)
            return let(F.array_sort(F.transform(maybe, lambda i: window(w, i))), flagged)

        return let(twice, of_twice)

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    zero = F.lit(0).cast("long")

    def of_words(w: Column) -> Column:
        some = let(hashes(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), zero).otherwise(of_hashes(w, h)))
        return F.when(F.size(w) < 4, zero).otherwise(some)

    return let(words, of_words)


def base_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long)."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike("[^ \\x09-\\x0D]"))
    counts = let(
        word_array(body),
        lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("c"), repeated_word_count(w).alias("r")),
    )
    held = spare(df, "counts")
    return (
        df.withColumn(held, counts)
        .withColumn("n_words", F.col(f"{held}.n"))
        .withColumn("word_chars", F.col(f"{held}.c"))
        .withColumn("n_symbols", _count_of(body, "[#*$%&|<>]").cast("long"))
        .withColumn("n_dup_lines", let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")))
        .withColumn("n_repeat_words", F.col(f"{held}.r"))
        .drop(held)
    )


def line_verdict(line: Column, rules: LineRules = LineRules()) -> Column:
    """The name of the first rule that a line fails, or null for a line to keep; blank lines are kept.

    Words of a line are counted as its blanks plus one. Separators, symbols and shouts ("!!") are counted only in
    lines that have any; a line fails on punctuation if it neither ends with a terminal mark nor holds a finished
    sentence (lines mostly in a script without end marks never do), on shouting also if it has three words, no small
    letter and no more letters of scripts without case than capitals, on boilerplate only if it is short.
    """

    def unmarked(bare: Column) -> Column:
        return bare.rlike(rules.unmarked) & (_count_of(bare, rules.unmarked) > _count_of(bare, rules.cased))

    def ends(bare: Column) -> Column:
        last = F.right(bare, F.lit(1))
        marked = (F.instr(F.lit(rules.terminal), last) > 0) | bare.rlike(rules.sentence_end)
        return marked | (F.instr(F.lit(rules.other_terminal), last) > 0) | bare.rlike(rules.other_sentence_end) | unmarked(bare)

    def judge_bare(bare: Column) -> Column:
        n_words = F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit(""))) + 1
        noisy = F.when(bare.rlike(f"{rules.separators}|{rules.symbols}|!!"), let(n_words, lambda n: of_noise(bare, n)))
        loud = ~bare.rlike(r"\p{Ll}") & (n_words >= 3) & (_count_of(bare, rules.uncased) <= _count_of(bare, r"\p{Lu}"))
        return (
            F.when(bare == "", None)
            .when(~ends(bare), "punctuation")
            .when(loud, "shouting")
            .when((n_words <= rules.boilerplate_words) & bare.rlike(rules.boilerplate), "boilerplate")
            .otherwise(noisy)
        )

    def of_noise(bare: Column, n: Column) -> Column:
        return (
            F.when(_count_of(bare, rules.separators) >= F.greatest(F.lit(2), n * rules.max_separator_share), "navigation")
            .when(_count_of(bare, rules.symbols) > n * rules.max_symbols_per_word, "symbols")
            .when((F.length(bare) - F.length(F.replace(bare, F.lit("!!"), F.lit("")))) / 2 > n * rules.max_shouts_per_word, "shouting")
        )

    return let(F.btrim(line, F.lit(SPACE)), judge_bare)


def clean_lines(df: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """Add cleaned_text, n_lines, n_lines_removed, lost_share and lines_kept (the method's verdict).

    lost_share is the share of the lines' code points that is in removed lines (1 for a text without any);
    lines_kept is lost_share <= rules.max_lost_share.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(body, "\n")
    split = let(
        F.filter(lines, lambda x: line_verdict(x, rules).isNull()),
        lambda g: let(F.array_join(g, "\n"), lambda t: F.struct(t.alias("text"), F.size(g).cast("long").alias("n"), (F.length(t) - F.size(g) + 1).alias("kept"))),
    )
    total = F.length(body) - F.size(lines) + 1
    good = spare(df, "good")
    return (
        df.withColumn(good, split)
        .withColumn("cleaned_text", F.col(f"{good}.text"))
        .withColumn("n_lines", F.size(lines).cast("long"))
        .withColumn("n_lines_removed", F.col("n_lines") - F.col(f"{good}.n"))
        .withColumn("lost_share", F.when((total <= 0) | (F.col(f"{good}.n") == 0), F.lit(1.0)).otherwise(1 - F.col(f"{good}.kept") / total))
        .withColumn("lines_kept", F.col("lost_share") <= rules.max_lost_share)
        .drop(good)
    )


def judge(df: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """Base counts, cleaned text and verdicts: base_failed and kept are added to the rows."""
    out = clean_lines(base_counts(df, text), text, rules)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & F.col("lines_kept"))
