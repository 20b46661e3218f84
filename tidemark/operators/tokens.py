"""Vocabulary: generated or counted, lookup with an unknown id, token rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tidemark.functions.text import BLANKS, MASK, PAD, SPECIALS, UNK, UNK_ID, attention_mask, pad_to_block, words
from tidemark.operators.ordering import join_same

# Fixed values of the log format: service words and connection flags, in id order.
SERVICES = (
    "dns,sip", "dhcp", "other", "sip", "http,socks", "smtp,ssl", "http,irc", "socks", "ssh", "http,ssh", "http",
    "krb_tcp", "irc", "radius", "ftp-data", "snmp", "dns", "pop3", "ftp", "krb", "smtp", "ssl", "rdp",
)
FLAGS = ("OTH", "REJ", "RSTO", "RSTOS0", "RSTR", "RSTRH", "S0", "S1", "S2", "S3", "SF", "SH", "SHR")
BINNED_COLUMNS = (0, 2, 3)
TRAINED_SPECIALS = (PAD, UNK, MASK)  # id order of a counted vocabulary
VOCAB_LIMIT = 30_000


def small_table(spark: SparkSession, columns: Sequence[str], rows: Sequence[tuple]) -> DataFrame:
    """A table of literals. Spark knows its size, so a join with it is a broadcast and moves no rows."""

    def literal(v) -> str:
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else str(v)

    names = [c.split()[0] for c in columns]
    values = ", ".join(f"({', '.join(map(literal, row))})" for row in rows)
    typed = ", ".join(f"CAST({n} AS {c.split()[1]}) AS {n}" for n, c in zip(names, columns))
    return spark.sql(f"SELECT {typed} FROM VALUES {values} AS t({', '.join(names)})")


# Fixed values as well: the spellings of a rate, in id order.
def rate_tokens() -> list[str]:
    """0.00 .. 1.00 in steps of 0.01; each multiple of 0.1 also in its short spelling."""
    out = ["0.0"]
    for i in range(101):
        out.append(f"{i / 100:.2f}")
        if i and i % 10 == 0:
            out.append(f"{i / 100:.1f}")
    return out


def vocab_generate(spark: SparkSession, bins: int = 233) -> DataFrame:
    """(token, id) of the binned log format: 951 tokens for 233 bins."""
    tokens = list(SPECIALS)
    for column in BINNED_COLUMNS:
        tokens += [f"c{column}{i}" for i in range(bins)]
    tokens += [*SERVICES, *rate_tokens(), *[str(i) for i in range(101)], *FLAGS]
    return small_table(spark, ["token string", "id int"], [(t, i) for i, t in enumerate(tokens)])


def word_rows(df: DataFrame, text: str) -> DataFrame:
    """One row per word of the whole text; empty words are filtered after the explode."""
    return df.select(F.explode(F.split(F.col(text), BLANKS)).alias("token")).filter("token <> ''")


def vocab_train(df: DataFrame, text: str, size: int = VOCAB_LIMIT) -> DataFrame:
    """(token, id, n): specials first, then the most frequent words (ties by word)."""
    counts = word_rows(df, text).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.filter(~F.col("token").isin(*TRAINED_SPECIALS))
    top = counts.orderBy(F.desc("n"), "token").limit(size - len(TRAINED_SPECIALS))
    place = F.row_number().over(W.orderBy(F.desc("n"), "token"))  # at most `size` rows
    learnt = top.select("token", (place + len(TRAINED_SPECIALS) - 1).alias("id"), "n")
    rows = [(t, i, 0) for i, t in enumerate(TRAINED_SPECIALS)]
    specials = small_table(df.sparkSession, ["token string", "id int", "n bigint"], rows)
    return specials.unionByName(learnt)


def vocab_size(df: DataFrame, text: str) -> DataFrame:
    return word_rows(df, text).distinct().agg(F.count(F.lit(1)).alias("n_tokens"))


def vocab_lookup(df: DataFrame, column: str, vocab: DataFrame, name: str, unknown: int = UNK_ID) -> DataFrame:
    """Add the id of a one-word column, ``unknown`` if it is not in the vocabulary."""
    entries = vocab.select(F.col("token").alias(column), F.col("id").alias(name))
    return join_same(df, entries, [column], "left").withColumn(name, F.coalesce(name, F.lit(unknown)))


def tokenize_columns(df: DataFrame, columns: Sequence[str], vocab: DataFrame, block: int) -> DataFrame:
    """Add ``input_ids`` and ``attention_mask`` for rows whose columns are one word each.

    One lookup per column against the same small table; rows are never exploded.
    """
    ids = [f"_id_{c}" for c in columns]
    out = df
    for column, name in zip(columns, ids):
        out = vocab_lookup(out, column, vocab, name)
    out = out.withColumn("input_ids", pad_to_block(F.array(*ids), block)).drop(*ids)
    return out.withColumn("attention_mask", attention_mask(F.col("input_ids")))


def tokenize_sentences(df: DataFrame, key: Sequence[str], sentence: str, vocab: DataFrame, block: int) -> DataFrame:
    """(key..., input_ids, attention_mask) for sentences of any number of words.

    ``block`` is the fixed length of a token row, so longer sentences are cut there. Each of its positions
    is one lookup, as for columns: rows are not taken apart, so equal rows stay apart and none is shuffled.
    """
    kept = F.slice(words(F.col(sentence)), 1, block)
    cells = [f"_word_{i}" for i in range(block)]
    rows = df.select(*key, kept.alias("_words"))
    rows = rows.select(*key, F.size("_words").alias("_n"), *[F.get("_words", F.lit(i)).alias(c) for i, c in enumerate(cells)])
    for c in cells:
        rows = vocab_lookup(rows, c, vocab, f"{c}_id")
    found = F.slice(F.array(*[f"{c}_id" for c in cells]), F.lit(1), F.coalesce("_n", F.lit(0)))
    ids = pad_to_block(found, block)
    return rows.select(*key, ids.alias("input_ids")).withColumn("attention_mask", attention_mask(F.col("input_ids")))
