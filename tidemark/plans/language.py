"""Queries: vocabularies, token rows, masking and the categorical count model."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.text import row_to_sentence
from tidemark.operators import catmodel, metrics, tokens
from tidemark.operators.encoding import long_form
from tidemark.plans.evaluate import rounded
from tidemark.plans.flow import FLOW, flow, labelled, table, testing, training
from tidemark.plans.prepare import numbered
from tidemark.plans.registry import long_metrics, metrics_sql, query, with_flow
from tidemark.sources import sinks, tables
from tidemark.sources.staging import new_path, stage

CAT = list(FLOW.cat)
CELLS = ["0", "1", "2", "4", "5", "6", "7", "13"]  # sentence columns of the numbered table
BLOCK = 14
PROTOCOL_YEARS = range(1995, 2002)
SEED = 42


def _values(items) -> str:
    return ", ".join(f"({i}, '{t}')" for i, t in enumerate(items))


VOCAB_SQL = f""",
words0 AS (
  SELECT 0 AS grp, i AS ord, t AS token FROM (VALUES (0, '[UNK]'), (1, '[PAD]'), (2, '[MASK]')) s(i, t)
  UNION ALL SELECT 1, c * 1000 + i, 'c' || c || i FROM (VALUES (0), (2), (3)) k(c) CROSS JOIN range(233) r(i)
  UNION ALL SELECT 2, i, t FROM (VALUES {_values(tokens.SERVICES)}) s(i, t)
  UNION ALL SELECT 3, 2 * i, printf('%.2f', i / 100.0) FROM range(101) r(i)
  UNION ALL SELECT 3, CASE i WHEN 0 THEN -1 ELSE 2 * i + 1 END, printf('%.1f', i / 100.0) FROM range(101) r(i) WHERE i % 10 = 0
  UNION ALL SELECT 4, i, i::VARCHAR FROM range(101) r(i)
  UNION ALL SELECT 5, i, t FROM (VALUES {_values(tokens.FLAGS)}) s(i, t)),
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY grp, ord) - 1 AS INTEGER) AS id FROM words0)"""

_TEXTS = {
    "0": "cat_price", "1": "cat_type", "2": "cat_quantity", "13": "cat_status",
    **{n: f"CAST(CAST({c} AS DECIMAL(18,2)) AS VARCHAR)"
       for n, c in (("4", "num_quantity"), ("5", "num_price"), ("6", "num_discount"), ("7", "num_tax"))},
}
CELLS_SQL = ", cells AS (" + " UNION ALL ".join(
    f"SELECT row_key, {i} AS pos, {_TEXTS[c]} AS token FROM flow" for i, c in enumerate(CELLS)
) + ")"


@query(
    "vocab_generate",
    with_flow(VOCAB_SQL + CELLS_SQL + " SELECT v.token, v.id, count(c.token) AS n_uses FROM vocab v LEFT JOIN cells c USING (token) GROUP BY 1, 2"),
)
def vocab_generate(spark, sf_dir):
    used = long_form(numbered(spark, sf_dir), [], CELLS, value="token").groupBy("token").agg(F.count(F.lit(1)).alias("n_uses"))
    vocab = tokens.vocab_generate(spark)
    return vocab.join(used, "token", "left").select("token", "id", F.coalesce("n_uses", F.lit(0)).alias("n_uses"))


@query(
    "vocab_lookup",
    with_flow(VOCAB_SQL + """ SELECT row_key, coalesce(p.id, 0) AS price_id, coalesce(t.id, 0) AS type_id
FROM flow LEFT JOIN vocab p ON p.token = cat_price LEFT JOIN vocab t ON t.token = cat_type"""),
)
def vocab_lookup(spark, sf_dir):
    vocab = tokens.vocab_generate(spark)
    rows = flow(spark, sf_dir).select("row_key", "cat_price", "cat_type")
    rows = tokens.vocab_lookup(rows, "cat_price", vocab, "price_id")
    return tokens.vocab_lookup(rows, "cat_type", vocab, "type_id").select("row_key", "price_id", "type_id")


TOKEN_SQL = VOCAB_SQL + CELLS_SQL + f""",
ids AS (SELECT row_key, list(coalesce(id, 0) ORDER BY pos) AS a FROM cells LEFT JOIN vocab USING (token) GROUP BY 1)
SELECT row_key, array_to_string(list_concat(a, list_transform(range({BLOCK} - len(a)), lambda i: 1)), ' ') AS input_ids,
  array_to_string(list_concat(list_transform(a, lambda i: 1), list_transform(range({BLOCK} - len(a)), lambda i: 0)), ' ') AS mask FROM ids"""


def _id_text(df: DataFrame) -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), " ")
    return df.select("row_key", text("input_ids").alias("input_ids"), text("attention_mask").alias("mask"))


@query("tokenize_ws", with_flow(TOKEN_SQL))
def tokenize_ws(spark, sf_dir):
    return _id_text(tokens.tokenize_columns(numbered(spark, sf_dir), CELLS, tokens.vocab_generate(spark), BLOCK))


@query("tokenize_sentences", with_flow(TOKEN_SQL))
def tokenize_sentences(spark, sf_dir):
    rows = numbered(spark, sf_dir).select("row_key", row_to_sentence([f"`{c}`" for c in CELLS]).alias("sentence"))
    return _id_text(tokens.tokenize_sentences(rows, ["row_key"], "sentence", tokens.vocab_generate(spark), BLOCK))


@query(
    "row_to_sentence",
    with_flow("SELECT row_key, concat_ws(' ', " + ", ".join(_TEXTS[c] for c in CELLS) + ", 'nan') AS sentence FROM flow"),
)
def row_sentences(spark, sf_dir):
    gap = numbered(spark, sf_dir).withColumn("gap", F.lit(None).cast("string"))
    return gap.select("row_key", row_to_sentence([*[f"`{c}`" for c in CELLS], "gap"]).alias("sentence"))


# --- counted vocabularies --------------------------------------------------------------

# the Unicode white-space characters, for a regular-expression engine without a class for them
BLANKS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
WORDS_SQL = f"""WITH w AS (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '{BLANKS}')) AS token FROM documents)
  WHERE token <> '' AND token NOT IN ('[PAD]', '[UNK]', '[MASK]') GROUP BY 1),
top AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 2 AS id FROM w),
vocab AS (SELECT token, CAST(id AS INTEGER) AS id, n FROM top WHERE id < 30000
  UNION ALL SELECT * FROM (VALUES ('[PAD]', 0, 0), ('[UNK]', 1, 0), ('[MASK]', 2, 0)))"""


def trained(spark, sf_dir) -> DataFrame:
    return tokens.vocab_train(table(spark, sf_dir, "documents"), "text")


@query("vocab_train", WORDS_SQL + " SELECT token, id, n FROM vocab")
def vocab_train(spark, sf_dir):
    return trained(spark, sf_dir)


@query(
    "vocab_size",
    f"SELECT count(DISTINCT token) AS n_tokens FROM (SELECT unnest(regexp_split_to_array(text, '{BLANKS}')) AS token FROM documents) WHERE token <> ''",
)
def vocab_size(spark, sf_dir):
    return tokens.vocab_size(table(spark, sf_dir, "documents"), "text")


@query("scan_vocab", WORDS_SQL + " SELECT token, id FROM vocab")
def scan_vocab(spark, sf_dir):
    path = new_path(spark, "vocab")
    sinks.sink_vocab(trained(spark, sf_dir).select("token", "id"), path)
    return tables.scan_vocab(spark, path)


@query("sink_vocab", WORDS_SQL + " SELECT 'WordLevel' AS kind, '[UNK]' AS unk_token, count(*) AS n_tokens, max(id) AS last_id FROM vocab")
def sink_vocab(spark, sf_dir):
    path = new_path(spark, "vocab")
    sinks.sink_vocab(trained(spark, sf_dir).select("token", "id"), path)
    model = F.from_json("value", "model struct<type:string,unk_token:string,vocab:map<string,int>>")["model"]
    saved = spark.read.text(path).select(model.alias("m"))
    return saved.select(
        F.col("m.type").alias("kind"),
        F.col("m.unk_token").alias("unk_token"),
        F.size("m.vocab").cast("long").alias("n_tokens"),
        F.array_max(F.map_values("m.vocab")).alias("last_id"),
    )


# --- masking ---------------------------------------------------------------------------

SENTENCES_SQL = ", s AS (SELECT DISTINCT " + " || ' ' || ".join(CAT) + " AS sentence FROM test)"


def sentences(spark, sf_dir) -> DataFrame:
    """Distinct test sentences with their padded ids."""
    rows = testing(flow(spark, sf_dir)).select(*CAT).distinct()
    rows = tokens.tokenize_columns(rows, CAT, tokens.vocab_generate(spark), BLOCK)
    return rows.withColumn("sentence", row_to_sentence(CAT))


@query(
    "mask_positions",
    with_flow(SENTENCES_SQL + f""" SELECT sentence, CAST(trial AS INTEGER) AS trial, CAST(p AS INTEGER) AS pos
FROM s CROSS JOIN range(15) t(trial) CROSS JOIN range({len(CAT) + 1}) q(p)
QUALIFY row_number() OVER (PARTITION BY sentence, trial ORDER BY md5(concat_ws('|', {SEED}, sentence, trial, p))) <= ceil(0.15 * {len(CAT) + 1})"""),
)
def mask_positions(spark, sf_dir):
    return catmodel.mask_positions(sentences(spark, sf_dir), ["sentence"], "sentence", "input_ids", SEED)


@query(
    "mlm_corrupt",
    with_flow(VOCAB_SQL + SENTENCES_SQL + f""",
ids AS (SELECT sentence, p, CASE WHEN p < {len(CAT)} THEN coalesce(id, 0) ELSE 1 END AS id,
    p < {len(CAT)} AND ('0x' || substr(md5(concat_ws('|', {SEED}, sentence, p)), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.15 AS hit
  FROM s CROSS JOIN range({BLOCK}) r(p) LEFT JOIN vocab ON token = split_part(sentence, ' ', CAST(p + 1 AS INTEGER)))
SELECT sentence, string_agg(CASE WHEN hit THEN 2 ELSE id END::VARCHAR, ' ' ORDER BY p) AS input_ids,
  string_agg(CASE WHEN hit THEN id ELSE -100 END::VARCHAR, ' ' ORDER BY p) AS labels FROM ids GROUP BY 1"""),
)
def mlm_corrupt(spark, sf_dir):
    pairs = catmodel.mlm_corrupt(sentences(spark, sf_dir), ["sentence"], "sentence", "input_ids", SEED)
    text = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), " ")
    return pairs.select("sentence", text("input_ids").alias("input_ids"), text("labels").alias("labels"))


# --- count model -----------------------------------------------------------------------

D = len(CAT)


def model_sql(source: str, tests: str, weight: str | None = None, distil: bool = False) -> str:
    """Named query ``scored(year, split, label, sentence, score)`` per test row.

    ``source``: train rows; ``tests``: test rows with ``model_year``; ``weight``: weight of
    count year k in model year y (1 for every year if absent).
    """
    w = weight or "1"
    cells = " UNION ALL ".join(f"SELECT rid, year, {i} AS c, {col} AS v FROM src" for i, col in enumerate(CAT))
    sent = " UNION ALL ".join(f"SELECT sentence, model_year, {i} AS c, {col} AS v FROM sen" for i, col in enumerate(CAT))
    if distil:
        prob = f"sum({w} * (coalesce(n_ij, 0) + 1) / (coalesce(n_i, 0) + nv))"
    else:
        prob = f"(sum({w} * coalesce(n_ij, 0)) + 1) / (sum({w} * coalesce(n_i, 0)) + max(nv))"
    return f""",
src AS (SELECT *, row_number() OVER () AS rid FROM {source}),
tst AS (SELECT *, {" || ' ' || ".join(CAT)} AS sentence FROM {tests}),
sen AS (SELECT DISTINCT sentence, model_year, {", ".join(CAT)} FROM tst),
cel AS ({cells}),
nij AS (SELECT a.c AS ci, a.v AS vi, b.c AS cj, b.v AS vj, a.year AS k, count(*) AS n_ij FROM cel a JOIN cel b ON a.rid = b.rid AND a.c <> b.c GROUP BY ALL),
ni AS (SELECT c, v, year AS k, count(*) AS n_i FROM cel GROUP BY ALL),
vs AS (SELECT c, count(DISTINCT v) AS nv FROM cel GROUP BY 1),
yrs AS (SELECT DISTINCT year AS k FROM src),
sc AS ({sent}),
cond AS (SELECT a.sentence, a.model_year, a.c AS ci, b.c AS cj, {prob} AS p
  FROM sc a JOIN sc b ON a.sentence = b.sentence AND a.model_year = b.model_year AND a.c <> b.c JOIN vs ON vs.c = b.c CROSS JOIN yrs
  LEFT JOIN nij ON nij.ci = a.c AND nij.vi = a.v AND nij.cj = b.c AND nij.vj = b.v AND nij.k = yrs.k
  LEFT JOIN ni ON ni.c = a.c AND ni.v = a.v AND ni.k = yrs.k GROUP BY ALL),
mk AS (SELECT sentence, t, p FROM (SELECT DISTINCT sentence FROM sen) CROSS JOIN range(15) x(t) CROSS JOIN range({D}) y(p)
  QUALIFY row_number() OVER (PARTITION BY sentence, t ORDER BY md5(concat_ws('|', {SEED}, sentence, t, p))) <= ceil(0.15 * {D})),
tok AS (SELECT mk.sentence, model_year, t, mk.p AS j, avg(cond.p) AS pr FROM mk JOIN cond ON cond.sentence = mk.sentence AND cj = mk.p
  WHERE NOT EXISTS (SELECT 1 FROM mk h WHERE h.sentence = mk.sentence AND h.t = mk.t AND h.p = cond.ci) GROUP BY ALL),
lm AS (SELECT sentence, model_year, round(1 - avg(pr), 9) AS score FROM tok GROUP BY ALL),
scored AS (SELECT year, split, label, sentence, score FROM tst JOIN lm USING (sentence, model_year))"""


IID_SQL = model_sql("train", "(SELECT *, 0 AS model_year FROM test)")


def pooled_scores(spark, sf_dir) -> DataFrame:
    base = flow(spark, sf_dir)
    model = catmodel.CountModel(training(base), CAT, PROTOCOL_YEARS)
    scored = catmodel.score_rows(model, testing(base), catmodel.pooled, SEED)
    return rounded(scored, "score", digits=9)


@query("cat_lm", with_flow(IID_SQL + " SELECT year, split, label, sentence, count(*) AS n, round(max(score), 6) AS score FROM scored GROUP BY 1, 2, 3, 4"))
def cat_lm(spark, sf_dir):
    return rounded(pooled_scores(spark, sf_dir).select("year", "split", "label", "sentence", "n", "score"), "score")


@query(
    "lm_anomaly_score",
    with_flow(IID_SQL + " SELECT year, label, round(avg(score), 6) AS mean_score, count(*) AS n FROM scored GROUP BY 1, 2"),
)
def lm_anomaly_score(spark, sf_dir):
    scored = pooled_scores(spark, sf_dir)
    means = scored.groupBy("year", "label").agg(
        (F.sum(F.col("n") * F.col("score")) / F.sum("n")).alias("mean_score"), F.sum("n").alias("n")
    )
    return rounded(means, "mean_score")


def regime_metrics(scored: DataFrame) -> DataFrame:
    return rounded(metrics.eval_grid(scored, ["year"], weight="n"), "value")


METRICS_BY_YEAR = metrics_sql("year") + long_metrics("year") + " SELECT year, metric, round(value, 6) AS value FROM metrics"


@query("regime_iid", with_flow(IID_SQL + METRICS_BY_YEAR))
def regime_iid(spark, sf_dir):
    return regime_metrics(pooled_scores(spark, sf_dir))


# the continued and distilled models of year y - 1 score year y
INLIERS = "(SELECT * FROM flow WHERE label = 0 AND part = 'train')"
NEXT_YEAR = "(SELECT *, year - 1 AS model_year FROM flow WHERE year > 1995)"
DECAY = 0.5
FINETUNE_WEIGHT = f"CASE WHEN yrs.k <= a.model_year THEN pow({DECAY}::DOUBLE, a.model_year - yrs.k) ELSE 0 END"
DISTIL_WEIGHT = """CASE WHEN yrs.k > a.model_year THEN 0 ELSE pow(0.9::DOUBLE, a.model_year - yrs.k)
  * CASE WHEN yrs.k = 1995 THEN 1 ELSE 1 - 0.9::DOUBLE END END"""


def yearly_scores(spark, sf_dir, regime) -> DataFrame:
    rows = labelled(flow(spark, sf_dir))
    train = rows.filter((F.col("label") == 0) & (F.col("part") == "train"))
    model = catmodel.CountModel(train, CAT, PROTOCOL_YEARS)
    test = rows.filter(F.col("year") > 1995).withColumn("model_year", F.col("year") - 1)
    weigh = regime(model.years, F.col("model_year"))
    scored = catmodel.score_rows(model, test, weigh, SEED, ["model_year"], keep=("year", "label", "model_year"))
    return rounded(scored, "score", digits=9)


@query("regime_finetune", with_flow(model_sql(INLIERS, NEXT_YEAR, FINETUNE_WEIGHT) + METRICS_BY_YEAR))
def regime_finetune(spark, sf_dir):
    return regime_metrics(yearly_scores(spark, sf_dir, lambda ys, y: catmodel.continued(ys, y, DECAY)))


@query("regime_distil", with_flow(model_sql(INLIERS, NEXT_YEAR, DISTIL_WEIGHT, distil=True) + METRICS_BY_YEAR))
def regime_distil(spark, sf_dir):
    return regime_metrics(yearly_scores(spark, sf_dir, catmodel.distilled))


# --- teacher and student ---------------------------------------------------------------

PAIR_SQL = """,
k AS (SELECT cat_type, year, cat_price, count(*) AS n FROM flow WHERE part = 'train' GROUP BY ALL),
ctx AS (SELECT DISTINCT a.cat_type, a.year FROM k a JOIN k b ON a.cat_type = b.cat_type AND b.year = a.year - 1),
pairs AS (SELECT ctx.cat_type, ctx.year, v.cat_price, coalesce(s.n, 0) AS n_student, coalesce(t.n, 0) AS n_teacher
  FROM ctx JOIN (SELECT DISTINCT cat_price FROM k) v ON true
  LEFT JOIN k s ON s.cat_type = ctx.cat_type AND s.year = ctx.year AND s.cat_price = v.cat_price
  LEFT JOIN k t ON t.cat_type = ctx.cat_type AND t.year = ctx.year - 1 AND t.cat_price = v.cat_price
  WHERE s.n IS NOT NULL OR t.n IS NOT NULL)"""


def teacher_student(spark, sf_dir) -> DataFrame:
    rows = flow(spark, sf_dir).filter(F.col("part") == "train")
    counts = stage(rows.groupBy("cat_type", "year", "cat_price").agg(F.count(F.lit(1)).alias("n")), "counts")
    return catmodel.teacher_student_pair(counts, ["cat_type"], "cat_price")


@query("teacher_student_pair", with_flow(PAIR_SQL + " SELECT cat_type, year, cat_price, n_student, n_teacher FROM pairs"))
def teacher_student_pair(spark, sf_dir):
    return teacher_student(spark, sf_dir).select("cat_type", "year", "cat_price", "n_student", "n_teacher")


@query(
    "soft_labels",
    with_flow(PAIR_SQL + """,
sm AS (SELECT *, pow(n_student + 1, 0.25) / sum(pow(n_student + 1, 0.25)) OVER w AS ps, pow(n_teacher + 1, 0.25) / sum(pow(n_teacher + 1, 0.25)) OVER w AS pt,
    (n_student + 1) / sum(n_student + 1) OVER w AS p1, n_student / sum(n_student) OVER w AS f
  FROM pairs WINDOW w AS (PARTITION BY cat_type, year)),
ls AS (SELECT cat_type, year, -sum(f * ln(p1)) AS ce, sum(pt * ln(pt / ps)) AS kl FROM sm GROUP BY 1, 2)
SELECT cat_type, year, round(ce, 6) AS ce, round(kl, 6) AS kl, round(0.1 * ce + 0.9 * kl, 6) AS loss FROM ls"""),
)
def soft_labels(spark, sf_dir):
    loss = catmodel.soft_labels(teacher_student(spark, sf_dir), ["cat_type", "year"])
    return rounded(loss, "ce", "kl", "loss")
