"""Categorical count model: masked-token scores from pairwise conditional counts.

These are count models, not neural language models: the probability of a token is the
mean, over the visible columns, of its smoothed conditional frequency in train rows.
Yearly regimes (pooled, continued, distilled) combine the same per-year counts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.hashing import hash_uniform, seeded_hash
from tidemark.functions.text import MASK_ID, PAD_ID, row_to_sentence
from tidemark.operators.ordering import join_same
from tidemark.sources.staging import stage

MASK_SHARE = 0.15
TRIALS = 15
ALPHA = 1.0  # add-one smoothing
TEMPERATURE = 4.0
TEACHER_WEIGHT = 0.9


def masked_positions(sentence: Column, length: Column, trial: Column, seed, share: float = MASK_SHARE) -> Column:
    """``ceil(share * length)`` distinct 0-based positions, in seeded hash order."""
    n = F.ceil(F.lit(share) * length).cast("int")
    drawn = F.transform(
        F.sequence(F.lit(0), length - 1), lambda p: F.struct(seeded_hash(seed, sentence, trial, p).alias("h"), p.alias("p"))
    )
    return F.transform(F.slice(F.array_sort(drawn), F.lit(1), n), lambda e: e["p"])


def mask_positions(df: DataFrame, key: Sequence[str], sentence: str, ids: str, seed, trials: int = TRIALS) -> DataFrame:
    """(key..., trial, pos). The length counts the tokens and, if padded, the first pad."""
    pad = F.array_position(F.col(ids), PAD_ID)
    length = F.when(pad > 0, pad).otherwise(F.size(ids)).cast("int")
    out = df.select(*key, sentence, length.alias("_len"), F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))
    drawn = masked_positions(F.col(sentence), F.col("_len"), F.col("trial"), seed)
    return out.select(*key, "trial", F.explode(drawn).alias("pos"))


def mlm_corrupt(df: DataFrame, key: Sequence[str], sentence: str, ids: str, seed, share: float = MASK_SHARE) -> DataFrame:
    """Training pairs: each token is masked with probability ``share``; labels keep it, else -100."""

    def hit(i):
        return hash_uniform(seeded_hash(seed, F.col(sentence), i)) < share

    corrupted = F.transform(F.col(ids), lambda t, i: F.when(hit(i) & (t != PAD_ID), F.lit(MASK_ID)).otherwise(t))
    labels = F.transform(F.col(ids), lambda t, i: F.when(hit(i) & (t != PAD_ID), t).otherwise(F.lit(-100)))
    return df.select(*key, corrupted.alias("input_ids"), labels.alias("labels"))


def pair_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., ci, vi, cj, vj, n): rows in which column ci is vi and column cj is vj.

    The pairs are taken inside a row (d*(d+1)/2 of them) and counted before the shuffle;
    the mirrored half is added afterwards. ci = cj gives the single counts.
    """
    cells = []
    for i, a in enumerate(columns):
        for j, b in enumerate(columns[i:], start=i):
            cells.append(
                F.struct(
                    F.lit(i).alias("ci"), F.col(a).cast("string").alias("vi"),
                    F.lit(j).alias("cj"), F.col(b).cast("string").alias("vj"),
                )
            )
    pairs = df.select(*by, F.inline(F.array(*cells)))
    half = pairs.groupBy(*by, "ci", "vi", "cj", "vj").agg(F.count(F.lit(1)).alias("n"))
    both = F.array(
        F.struct("ci", "vi", "cj", "vj"),
        F.struct(F.col("cj").alias("ci"), F.col("vj").alias("vi"), F.col("ci").alias("cj"), F.col("vi").alias("vj")),
    )
    kept = F.when(F.col("ci") == F.col("cj"), F.slice(both, 1, 1)).otherwise(both)
    return half.select(*by, "n", F.inline(kept)).select(*by, "ci", "vi", "cj", "vj", "n")


class CountModel:
    """Staged pair counts with, per pair, the count of every train year in ``years``.

    The years are the protocol's, not the data's: rows of other years are an error.
    """

    def __init__(self, train: DataFrame, columns: Sequence[str], years: Sequence[int], year: str = "year"):
        self.columns = list(columns)
        counts = stage(pair_counts(train, columns, [year]), "pair_counts")
        self.years = sorted(years)
        if not counts.filter(~F.coalesce(F.col(year).isin(*self.years), F.lit(False))).isEmpty():
            raise ValueError(f"train rows outside the years {self.years}")
        per_year = F.array(
            *[F.coalesce(F.sum(F.when(F.col(year) == y, F.col("n"))), F.lit(0)).cast("double") for y in self.years]
        )
        pairs = counts.groupBy("ci", "vi", "cj", "vj").agg(per_year.alias("n_ij"))
        self.pairs = stage(pairs.filter("ci <> cj"), "pairs")
        self.singles = stage(pairs.filter("ci = cj").select("ci", "vi", F.col("n_ij").alias("n_i")), "singles")
        self._count_sizes()

    @classmethod
    def of(cls, pairs: DataFrame, singles: DataFrame, columns: Sequence[str], years: Sequence[int]) -> CountModel:
        """A model fitted before, from its tables."""
        model = cls.__new__(cls)
        model.columns, model.years, model.pairs, model.singles = list(columns), sorted(years), pairs, singles
        model._count_sizes()
        return model

    def _count_sizes(self) -> None:
        sizes = self.singles.groupBy("ci").agg(F.count(F.lit(1)).alias("v")).collect()  # one row per column
        self.sizes = {r["ci"]: r["v"] for r in sizes}

    def conditional(self, weigh: Callable[[Column, Column, Column], Column], sentences: DataFrame, key: str) -> DataFrame:
        """(key, p): entries p(column j's token | column i's token) over i <> j, by i then j.

        ``sentences`` has one row per distinct sentence; ``weigh`` turns the yearly counts
        of the pair, those of the condition and the vocabulary size into a probability.
        """
        d = len(self.columns)
        cells = [
            F.struct(
                F.lit(i).alias("ci"), F.col(a).cast("string").alias("vi"),
                F.lit(j).alias("cj"), F.col(b).cast("string").alias("vj"),
            )
            for i, a in enumerate(self.columns)
            for j, b in enumerate(self.columns)
            if i != j
        ]
        carried = [c for c in sentences.columns if c not in self.columns and c != key]
        spelled = sentences.select(key, *carried, F.inline(F.array(*cells)))
        long = join_same(spelled, self.pairs, ["ci", "vi", "cj", "vj"], "left")
        long = join_same(long, self.singles, ["ci", "vi"], "left")
        none = F.array_repeat(F.lit(0.0), len(self.years))
        sizes = F.array(*[F.lit(float(self.sizes.get(j, 1))) for j in range(d)])
        p = weigh(F.coalesce("n_ij", none), F.coalesce("n_i", none), F.get(sizes, F.col("cj")))
        entry = F.struct((F.col("ci") * d + F.col("cj")).alias("k"), p.alias("p"))
        return long.groupBy(key, *carried).agg(F.array_sort(F.collect_list(entry)).alias("p"))  # d * (d - 1) entries


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def pooled(n_ij: Column, n_i: Column, v: Column) -> Column:
    """All years weigh the same."""
    return (_total(n_ij) + ALPHA) / (_total(n_i) + ALPHA * v)


def _weights(years: Sequence[int], weight: Callable[[int, int], float]) -> Column:
    """Literal table: row per model year, weight per count year."""
    return F.array(*[F.array(*[F.lit(float(weight(y, k))) for k in range(len(years))]) for y in range(len(years))])


def continued(years: Sequence[int], model_year: Column, decay: float):
    """Counts of the model year plus ``decay`` times the continued counts of the year before."""
    table = _weights(years, lambda y, k: decay ** (y - k) if k <= y else 0.0)
    mine = F.get(table, F.array_position(F.array(*[F.lit(y) for y in years]), model_year).cast("int") - 1)

    def weigh(n_ij, n_i, v):
        return (_total(F.zip_with(n_ij, mine, lambda n, w: n * w)) + ALPHA) / (
            _total(F.zip_with(n_i, mine, lambda n, w: n * w)) + ALPHA * v
        )

    return weigh


def distilled(years: Sequence[int], model_year: Column, teacher: float = TEACHER_WEIGHT):
    """Own-year probability mixed with the distilled model of the year before (the teacher)."""

    def weight(y, k):
        if k > y:
            return 0.0
        return teacher ** (y - k) * (1.0 if k == 0 else 1.0 - teacher)

    table = _weights(years, weight)
    mine = F.get(table, F.array_position(F.array(*[F.lit(y) for y in years]), model_year).cast("int") - 1)

    def weigh(n_ij, n_i, v):
        each = F.zip_with(n_ij, n_i, lambda a, b: (a + ALPHA) / (b + ALPHA * v))
        return _total(F.zip_with(each, mine, lambda p, w: p * w))

    return weigh


def lm_anomaly_score(model_p: DataFrame, key: str, d: int, seed, sentence: str = "sentence", trials: int = TRIALS) -> DataFrame:
    """Add ``score`` = 1 - mean probability of the true token at the masked positions.

    Masks are drawn per distinct sentence; a token's probability averages the conditionals
    from the columns that the same trial leaves visible.
    """
    p = F.col("p")
    every = F.sequence(F.lit(0), F.lit(d - 1))

    def probability(i, j):  # position of (i, j), i <> j, in the row-major list without the diagonal
        return F.get(p, i * (d - 1) + j - F.when(j > i, 1).otherwise(0))["p"]

    def trial_mean(trial):
        probs = F.transform(
            trial["masked"],
            lambda j: _total(F.transform(trial["visible"], lambda i: probability(i, j))) / F.size(trial["visible"]),
        )
        return _total(probs) / F.size(trial["masked"])

    # each step is one array, so that masks are drawn once and not once per use
    drawn = F.transform(
        F.sequence(F.lit(0), F.lit(trials - 1)), lambda t: masked_positions(F.col(sentence), F.lit(d), t, seed)
    )
    sides = F.transform(drawn, lambda m: F.struct(m.alias("masked"), F.array_except(every, m).alias("visible")))
    means = F.transform(sides, trial_mean)
    return model_p.withColumn("score", F.lit(1.0) - _total(means) / F.lit(float(trials))).drop("p")


def score_each(model: CountModel, test: DataFrame, weigh, seed, trials: int = TRIALS) -> DataFrame:
    """Add ``score`` to every row of ``test``; equal sentences are scored once and met again by their text.

    A row with a null in a modelled column gets a null score.
    """
    known = F.lit(True)
    for c in model.columns:
        known = known & F.col(c).isNotNull()
    spelled = F.concat_ws("\u001f", *[F.col(c).cast("string") for c in model.columns])  # unlike the sentence, tells columns apart
    named = test.withColumn("_id", F.when(known, spelled)).withColumn("_sentence", row_to_sentence(model.columns))
    distinct = named.filter("_id IS NOT NULL").select("_id", "_sentence", *model.columns).dropDuplicates(["_id"])
    probs = model.conditional(weigh, stage(distinct, "sentences"), "_id")
    scored = lm_anomaly_score(probs, "_id", len(model.columns), seed, "_sentence", trials)
    scored = stage(scored.select("_id", "score"), "sentence_scores")
    return join_same(named, scored, ["_id"], "left").select(*test.columns, "score")


def score_rows(
    model: CountModel, test: DataFrame, weigh, seed, carry: Sequence[str] = (), trials: int = TRIALS,
    keep: Sequence[str] = ("year", "split", "label"),
) -> DataFrame:
    """(keep..., score, n): distinct sentences per group with their multiplicity.

    Equal sentences share a score, so they are scored once; ``n`` keeps the table whole
    and feeds the weighted metrics.
    """
    named = test.withColumn("sentence", row_to_sentence(model.columns))
    counted = named.groupBy("sentence", *model.columns, *keep).agg(F.count(F.lit(1)).alias("n"))
    counted = stage(counted, "sentences")
    distinct = counted.select("sentence", *model.columns, *carry).distinct()
    probs = model.conditional(weigh, distinct, "sentence")
    scored = lm_anomaly_score(probs, "sentence", len(model.columns), seed, trials=trials)
    return join_same(counted.drop(*model.columns), scored, ["sentence", *carry])


def teacher_student_pair(counts: DataFrame, context: Sequence[str], token: str, time: str = "year") -> DataFrame:
    """(context..., time, token, n_student, n_teacher): each year with the year before it as teacher.

    The token set of a pair is the union of both years; a missing side counts 0.
    """
    student = counts.select(*context, time, token, F.col("n").alias("n_student"), F.lit(0).cast("long").alias("n_teacher"))
    teacher = counts.select(
        *context, (F.col(time) + 1).alias(time), token, F.lit(0).cast("long").alias("n_student"), F.col("n").alias("n_teacher")
    )
    keys = [*context, time, token]
    pairs = student.unionByName(teacher).groupBy(*keys).agg(
        F.sum("n_student").alias("n_student"), F.sum("n_teacher").alias("n_teacher")
    )
    per = pairs.groupBy(*context, time).agg(F.sum("n_student").alias("s"), F.sum("n_teacher").alias("t"))
    return pairs.join(per.filter("s > 0 AND t > 0").drop("s", "t"), [*context, time])


def soft_labels(pairs: DataFrame, context: Sequence[str], temperature: float = TEMPERATURE, alpha: float = TEACHER_WEIGHT) -> DataFrame:
    """(context..., ce, kl, loss) with softmax targets at a temperature.

    Logits are ``ln(n + 1)``. ``kl`` compares teacher with student at the temperature, ``ce``
    the student (temperature 1) with its own frequencies; loss = (1-alpha) ce + alpha kl.
    """
    zs, zt = F.log(F.col("n_student") + 1), F.log(F.col("n_teacher") + 1)
    tops = pairs.select("*", zs.alias("zs"), zt.alias("zt"))
    norms = tops.groupBy(*context).agg(
        F.sum("n_student").alias("n"),
        # exp(ln(n+1)/T) = (n+1)^(1/T): no overflow for counts, so one pass is enough
        F.sum(F.exp(F.col("zs"))).alias("e1"),
        F.sum(F.exp(F.col("zs") / temperature)).alias("es"),
        F.sum(F.exp(F.col("zt") / temperature)).alias("et"),
    )
    rows = tops.join(norms, list(context))
    log_s = F.col("zs") / temperature - F.log("es")
    log_t = F.col("zt") / temperature - F.log("et")
    out = rows.groupBy(*context).agg(
        F.sum(-(F.col("n_student") / F.col("n")) * (F.col("zs") - F.log("e1"))).alias("ce"),
        F.sum(F.exp(log_t) * (log_t - log_s)).alias("kl"),
    )
    return out.withColumn("loss", (1 - alpha) * F.col("ce") + alpha * F.col("kl"))
