"""Search keywords: filter, word segmentation, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.times import millis_to_time
from tidemark.operators.skew import lookup_join

# Runs searched for dictionary words, and runs that are a word by themselves.
HAN_RUNS = r"\p{IsHan}+"
WORD_RUNS = r"[\p{L}\p{M}\p{N}&&[^\p{IsHan}]]+"


def search_keywords(pages: DataFrame) -> DataFrame:
    """What was searched for, and when: pages reached from the search page that name an item.

    ``page`` may be a struct or a map of text.
    """
    found = (F.col("page")["last_page_id"] == "search") & F.col("page")["item"].isNotNull()
    return pages.where(found).select(
        F.col("page")["item"].alias("keyword"), "ts", millis_to_time("ts").alias("rt")
    )


def word_lengths(dictionary: DataFrame) -> list[int]:
    """The lengths that dictionary words have (a few numbers are brought to the driver)."""
    return sorted(row[0] for row in dictionary.select(F.length("word")).distinct().collect() if row[0])


def _runs(text: str, pattern: str) -> Column:
    return F.regexp_extract_all(F.lower(F.col(text)), F.lit(pattern), F.lit(0))


def _substrings(run: Column, lengths: list[int]) -> Column:
    """Every substring that has one of these lengths, one per start and length."""

    def from_start(start: Column) -> Column:
        fitting = F.filter(F.array(*map(F.lit, lengths)), lambda size: size <= F.length(run) - start + 1)
        return F.transform(fitting, lambda size: F.substr(run, start, size))

    return F.flatten(F.transform(F.sequence(F.lit(1), F.length(run)), from_start))


def _tried(text: str, dictionary_runs: str, lengths: list[int]) -> Column:
    """Substrings of a text that may be dictionary words."""
    if not lengths:
        return F.array().cast("array<string>")
    return F.flatten(F.transform(_runs(text, dictionary_runs), lambda run: _substrings(run, lengths)))


def split_keywords(
    rows: DataFrame,
    text: str,
    dictionary: DataFrame,
    dictionary_runs: str = HAN_RUNS,
    word_runs: str = WORD_RUNS,
) -> DataFrame:
    """One row per word of ``text``, with the row's other columns and ``word``.

    Words are lower case. A run of letters and digits is a word. A run of ``dictionary_runs`` (by
    default Chinese characters, which are written without spaces) gives every dictionary word in
    it, overlapping ones too. A text without any word gives itself once; a null text gives nothing.

    All substrings of the lengths that dictionary words have are tried, so no word is missed. Runs and
    substrings come from one pass over the rows. Batch only: a text is known to have no word only after
    all of them were tried.
    """
    lengths = word_lengths(dictionary)
    known = dictionary.select("word").distinct().withColumn("is_known", F.lit(True))
    rows = rows.where(F.col(text).isNotNull())
    columns = [*rows.columns, "word"]
    tokens = F.transform(_runs(text, word_runs), lambda word: F.struct(word.alias("word"), F.lit(True).alias("is_run")))
    tried = _tried(text, dictionary_runs, lengths)
    tried = F.transform(tried, lambda word: F.struct(word.alias("word"), F.lit(False).alias("is_run")))
    candidates = rows.withColumn("tried", F.explode(F.concat(tokens, tried))).select(*rows.columns, "tried.*")
    found = lookup_join(candidates, known, ["word"], "left").where(F.col("is_run") | F.col("is_known"))
    # Only texts without a letter or digit run can turn out to have no word.
    silent = rows.where(F.size(_runs(text, word_runs)) == 0)
    if lengths:
        texts = silent.select(text).distinct()
        hits = texts.withColumn("word", F.explode(_tried(text, dictionary_runs, lengths)))
        hits = lookup_join(hits, known, ["word"]).select(text).distinct()
        silent = silent.join(hits, text, "left_anti")
    return found.select(*columns).unionByName(silent.withColumn("word", F.col(text)).select(*columns))


def keyword_counts(keywords: DataFrame, window: str = "10 seconds", watermark: str = "2 seconds") -> DataFrame:
    """How often each whole keyword was searched per window (first step of ``keyword_stats``)."""
    if keywords.isStreaming:
        keywords = keywords.withWatermark("rt", watermark)
    return keywords.groupBy(F.window("rt", window).alias("window"), "keyword").agg(
        F.count("*").alias("searches"), F.min(F.unix_millis("rt")).alias("ts")
    )


def word_counts(
    counts: DataFrame,
    dictionary: DataFrame,
    dictionary_runs: str = HAN_RUNS,
    word_runs: str = WORD_RUNS,
    source: str = "search",
) -> DataFrame:
    """Words per window from ``keyword_counts`` (second step of ``keyword_stats``)."""
    words = split_keywords(counts, "keyword", dictionary, dictionary_runs, word_runs)
    return (
        words.groupBy("window", "word")
        .agg(F.sum("searches").alias("ct"), F.min("ts").alias("ts"))
        .select(
            F.col("word").alias("keyword"),
            "ct",
            F.lit(source).alias("source"),
            F.col("window.start").alias("stt"),
            F.col("window.end").alias("edt"),
            "ts",
        )
    )


def keyword_stats(
    keywords: DataFrame,
    dictionary: DataFrame,
    window: str = "10 seconds",
    dictionary_runs: str = HAN_RUNS,
    word_runs: str = WORD_RUNS,
    source: str = "search",
) -> DataFrame:
    """Searches per word and window.

    A keyword is split once per window however often it was searched, so a keyword everybody
    searches for is one row by then. Batch only; on a stream write ``keyword_counts`` with
    ``foreachBatch`` and apply ``word_counts`` there (``tidemark.streaming.jobs``).
    """
    return word_counts(keyword_counts(keywords, window), dictionary, dictionary_runs, word_runs, source)


def register_split_function(
    spark: SparkSession,
    dictionary: DataFrame,
    name: str = "split_keyword",
    dictionary_runs: str = HAN_RUNS,
    word_runs: str = WORD_RUNS,
) -> None:
    """Make ``split_keywords`` a SQL table function for lateral joins.

    ``SELECT word, rt FROM searches, LATERAL split_keyword(keyword)`` gives one row per word. The
    function is SQL itself, so Spark plans it as joins and runs no Python per row.
    """
    words = f"{name}_dictionary"
    dictionary.select("word").distinct().createOrReplaceTempView(words)
    lengths = ", ".join(map(str, word_lengths(dictionary))) or "0"
    word_runs, dictionary_runs = (pattern.replace("\\", "\\\\") for pattern in (word_runs, dictionary_runs))
    spark.sql(
        f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(keyword STRING) RETURNS TABLE (word STRING) RETURN
        SELECT explode(IF(size(found) > 0, found, array(whole))) AS word
        FROM (
          SELECT collect_list(word) AS found, max(whole) AS whole
          FROM (
            SELECT NULL AS word, keyword AS whole
            UNION ALL
            SELECT explode(regexp_extract_all(lower(keyword), '{word_runs}', 0)), NULL
            UNION ALL
            SELECT tried.word, NULL
            FROM (
              SELECT explode(flatten(transform(
                regexp_extract_all(lower(keyword), '{dictionary_runs}', 0),
                run -> flatten(transform(
                  sequence(1, length(run)),
                  start -> transform(
                    filter(array({lengths}), size -> size <= length(run) - start + 1),
                    size -> substr(run, start, size))))))) AS word
            ) AS tried JOIN {words} AS known ON tried.word = known.word
          )
        )
        WHERE whole IS NOT NULL
        """
    )
