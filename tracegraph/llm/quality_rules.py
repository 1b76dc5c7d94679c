"""Line-first cleaning: rules judge every line, failed lines go, documents that lose too much text go.

Everything is a column expression over the row, so nothing is shuffled and no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracegraph.llm.common import WORD, fresh

SPACE = r"[\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
SENTENCE_MARK = "[.!?,;:。،।…]"
NAVIGATION_MARK = r"(^|\s)[|»›•>](\s|$)"
# words that make a line navigation if nothing else stands in it
NAVIGATION = ("home|menu|log ?in|log ?out|sign ?in|sign ?up|register|next|previous|search|contact( us)?|about( us)?|back to top|"
              "share|read more|skip to content|sitemap|help|faq")
BOILERPLATE = ("all rights reserved|licensed under|released under the|cookie policy|we use cookies|privacy policy|"
               "terms of (use|service)|copyright|©|enable javascript|subscribe to|click here|powered by")


def line_fails(line: Column) -> dict[str, Column]:
    """The rules by name; a line without words fails none."""
    words = F.regexp_count(line, F.lit(WORD))
    marks = F.regexp_count(line, F.lit(SYMBOL))
    shouts = F.regexp_count(line, F.lit("[!?]{2}"))
    return {
        "punctuation": (words > 0) & ((4 * marks > words) | (4 * shouts > words) | ((words >= 20) & ~line.rlike(SENTENCE_MARK))),
        "navigation": words.between(1, 10) & (line.rlike(NAVIGATION_MARK) | line.rlike(rf"(?i)^\W*({NAVIGATION})\W*$")),
        "boilerplate": words.between(1, 30) & line.rlike(f"(?i)({BOILERPLATE})"),
    }


def _repeat_words(grams: str, sorted_grams: str) -> Column:
    """Words inside 3-word windows that occur twice or more, from the windows sorted by (code, place)."""
    s = F.col(sorted_grams)
    n = F.size(grams)
    same = lambda x, j: F.get(s, j)["h"] == x["h"]
    hit = F.filter(s, lambda x, i: F.coalesce((i > 0) & same(x, i - 1), F.lit(False)) | F.coalesce((i < n - 1) & same(x, i + 1), F.lit(False)))
    return F.size(F.array_distinct(F.flatten(F.transform(hit, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))


def clean_lines(docs: DataFrame, text: str = "text", max_lost: float = 0.5, min_words: int = 50) -> DataFrame:
    """Add base counts, verdicts and the cleaned text to ``docs``.

    Added columns: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (base counts over the
    whole text), lost_words (words of failed lines), base_failed, kept, cleaned (text without failed lines; null for
    null). A column of ``docs`` with one of these names gives way. A null or blank text has no words, so it
    fails the base; repeated rows are judged alike; an empty table stays empty. Windows are compared
    by 64-bit codes, so two different ones count as equal with a chance below 1e-10 even in a text of 20,000 words.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words", "base_failed", "kept", "cleaned"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added])
    t, w, g, s, lines, bad = (fresh(docs.columns, f"_{x}") for x in ("t", "w", "g", "s", "lines", "bad"))
    tc = F.col(t)
    x = docs.withColumn(t, F.coalesce(F.col(f"`{text}`"), F.lit("")))
    x = x.withColumn(w, F.filter(F.split(tc, f"{SPACE}+"), lambda v: v != ""))
    n = F.size(w)
    wc = F.col(w)
    x = x.withColumn(g, F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(F.get(wc, i), F.get(wc, i + 1), F.get(wc, i + 2)))))
    some = F.size(F.array_distinct(g)) < F.size(g)
    pairs = F.transform(F.col(g), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    x = x.withColumn(s, F.when(some, F.sort_array(pairs)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    x = x.withColumn(lines, F.split(tc, "\n"))
    fails = lambda v: F.coalesce(line_fails(v)["punctuation"] | line_fails(v)["navigation"] | line_fails(v)["boilerplate"], F.lit(False))
    x = x.withColumn(bad, F.filter(F.col(lines), fails))
    worded = F.filter(F.col(lines), lambda v: v.rlike(WORD))
    x = x.withColumns({
        "n_words": n.cast("bigint"),
        "word_chars": (F.length(tc) - F.regexp_count(tc, F.lit(SPACE))).cast("bigint"),
        "n_symbols": F.regexp_count(tc, F.lit(SYMBOL)).cast("bigint"),
        "n_dup_lines": (F.size(worded) - F.size(F.array_distinct(worded))).cast("bigint"),
        "n_repeat_words": _repeat_words(g, s).cast("bigint"),
        "lost_words": F.aggregate(F.col(bad), F.lit(0), lambda a, v: a + F.regexp_count(v, F.lit(WORD))).cast("bigint"),
        "cleaned": F.when(F.col(f"`{text}`").isNotNull(), F.array_join(F.filter(F.col(lines), lambda v: ~fails(v)), "\n")),
    })
    x = x.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    x = x.withColumn("kept", ~F.col("base_failed") & (F.col("lost_words") <= max_lost * F.col("n_words")))
    return x.drop(t, w, g, s, lines, bad)
