"""Small tables that hold every odd case at once."""

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, tokens long, _row string, fp long, _h string, "
    "text_sha256 string, score double, `a.b` string, _text string, place string, uid string, _slice string, start string"
)
EXTRA = (7, "r", 1, "h", "s", 0.5, "dot", "t", "p", "u", "sl", "st")


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    parts = ["an", "ber", "cil", "dor", "eth", "fus", "gan", "hil", "ist", "jor"]
    common = ["the", "of", "and", "in", "is"]
    return " ".join(
        rng.choice(common) if rng.random() < 0.3 else "".join(rng.choice(parts) for _ in range(rng.randint(2, 4)))
        for _ in range(words)
    )


def odd_texts() -> list[str | None]:
    return [
        None, "", " \n\t ", "one", "two words", "A b C", "a B c", "..!!", "é ß İ K ſ", prose(1, 80), prose(1, 80), prose(1, 80).upper(),
        prose(2, 400) + " x", prose(2, 400) + " y", "long " * 20_000, "7" * 5000, "1 " * 4000, "a@b.c_x@d.e " * 300,
        "x" * 60_000, "token: secret: abcdefghij", "漢字 " * 50, "\U0001f600 " * 30, prose(3, 2000),
    ]


def odd_rows() -> list[tuple]:
    texts = odd_texts()
    rows = [(i, t, "en", f"src{i % 3}" if i % 5 else None, len(t) if t else None) for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (3, "another text under a used id", None, "src0", 5), (None, "no id", "en", "src1", 5)]
    rows += [(None, None, None, None, None), (None, None, None, None, None), (-5, "the last of the negatives", "en", "src2", 1)]
    return rows


def odd(spark):
    return spark.createDataFrame([r + EXTRA for r in odd_rows()], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=((1, 1, 0), (2, 0, 0), (2, 1, 1), (None, 1, 1), (3, 1, None))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
