"""Detectors by name: fitted to tables, saved in a folder, loaded again in any session, open to users.

A detector is a pair of functions. ``fit`` takes train rows and gives named tables; ``score`` takes rows and those tables
and adds a column ``score`` (higher: more anomalous). Nothing else is kept between the two, so a saved
model is a folder of parquet tables::

    model = detectors.fit("ecod", train, numeric=["num_4"], categorical=["cat_0"])
    model.save("/shared/models/ecod")
    detectors.load(spark, "/shared/models/ecod").score(test)      # in another session as well

``register("mine", fit, score)`` adds a detector, which then is fitted, saved and loaded in the same way.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import catmodel, centre, encoding, forest, neighbours, sparse, tails
from tidemark.operators.ordering import join_same
from tidemark.sources.staging import delete, stage

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Features:
    """Columns a detector reads, the row id it may join by, and its own options."""

    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    row_id: tuple[str, ...] = ("copy_id",)
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Detector:
    fit: Callable[[DataFrame, Features], Tables]
    score: Callable[[DataFrame, Tables, Features], DataFrame]


_DETECTORS: dict[str, Detector] = {}


def register(name: str, fit: Callable, score: Callable, replace: bool = False) -> None:
    """Add a detector under a name; an existing name is an error unless ``replace`` is set."""
    if name in _DETECTORS and not replace:
        raise ValueError(f"there is a detector {name} already")
    _DETECTORS[name] = Detector(fit, score)


def names() -> list[str]:
    return sorted(_DETECTORS)


def _known(name: str) -> Detector:
    if name not in _DETECTORS:
        raise ValueError(f"no detector {name}; there are {', '.join(names())}")
    return _DETECTORS[name]


class Model:
    """A fitted detector: its name, its columns and its tables."""

    def __init__(self, name: str, features: Features, tables: Tables, path: str | None = None):
        self.name, self.features, self.tables, self.path = name, features, tables, path

    def score(self, test: DataFrame) -> DataFrame:
        """Add ``score`` to every row of ``test``."""
        return _known(self.name).score(test, self.tables, self.features)

    def save(self, path: str) -> None:
        """Write the tables below ``path``, replacing a model saved there.

        ``about`` is taken away first and written last, so ``load`` refuses a folder whose writing was cut off.
        A model must not be saved over the folder it was loaded from.
        """
        if not self.tables:
            raise ValueError("a model has at least one table")
        spark = next(iter(self.tables.values())).sparkSession
        if path.rstrip("/") == self.path:
            raise ValueError(f"this model is read from {path}")
        delete(spark, f"{path}/about")
        for name, table in self.tables.items():
            table.write.mode("overwrite").parquet(f"{path}/tables/{name}")
        about = json.dumps({"detector": self.name, "tables": sorted(self.tables), **asdict(self.features)})
        spark.createDataFrame([(about,)], "about string").coalesce(1).write.text(f"{path}/about")


def fit(
    name: str, train: DataFrame, numeric: Sequence[str] = (), categorical: Sequence[str] = (),
    row_id: Sequence[str] = ("copy_id",), **options,
) -> Model:
    """Fit the detector ``name`` to all rows of ``train``. Options must be values that JSON keeps."""
    features = Features(tuple(numeric), tuple(categorical), tuple(row_id), options)
    return Model(name, features, _known(name).fit(train, features))


def load(spark: SparkSession, path: str) -> Model:
    """A saved model; its detector must be registered."""
    about = json.loads(spark.read.text(f"{path}/about").first()["value"])
    tables = {t: spark.read.parquet(f"{path}/tables/{t}") for t in about["tables"]}
    features = Features(tuple(about["numeric"]), tuple(about["categorical"]), tuple(about["row_id"]), about["options"])
    _known(about["detector"])
    return Model(about["detector"], features, tables, path.rstrip("/"))


# --- the library's detectors -----------------------------------------------------------

VECTOR = "_vector"
NEIGHBOURS = 5
COMPONENTS = 2


def _with_vector(df: DataFrame, f: Features, params: DataFrame | None = None) -> DataFrame:
    """Add the numeric columns as one vector, robust-scaled if ``params`` are given; null if one of them is null or not a number."""
    numbers = [F.col(c).cast("double") for c in f.numeric]
    known = F.lit(True)
    for c in numbers:
        known = known & c.isNotNull() & ~F.isnan(c)
    if params is not None:
        middles, spreads = encoding.as_map(params, "median"), encoding.as_map(params, "iqr")
        numbers = [(c - middles[name]) / spreads[name] for c, name in zip(numbers, f.numeric)]
    return df.withColumn(VECTOR, F.when(known, F.array(*numbers)))


def _fit_tails(train: DataFrame, f: Features) -> Tables:
    return tails.TailModel(train, f.numeric, f.categorical).tables()


def _score_tails(rule: str):
    def score(test: DataFrame, tables: Tables, f: Features) -> DataFrame:
        return tails.TailModel.of(tables, f.numeric, f.categorical).score(test, rule, f.row_id)

    return score


def _fit_forest(train: DataFrame, f: Features) -> Tables:
    return {"nodes": forest.fit_forest(train, f.numeric, **f.options).nodes}


def _score_forest(test: DataFrame, tables: Tables, f: Features) -> DataFrame:
    return forest.Forest(tables["nodes"], f.numeric).score(test)


def _fit_pca(train: DataFrame, f: Features) -> Tables:
    model = centre.PcaModel(_with_vector(train, f), VECTOR, f.options.get("components", COMPONENTS))
    return {"axes": model.table(train.sparkSession)}


def _score_pca(test: DataFrame, tables: Tables, f: Features) -> DataFrame:
    return centre.PcaModel.of(tables["axes"], VECTOR).score(_with_vector(test, f)).drop(VECTOR)


def _fit_kernel(train: DataFrame, f: Features) -> Tables:
    return sparse.SparseKernel(train, f.numeric, f.categorical, **f.options).tables()


def _score_kernel(test: DataFrame, tables: Tables, f: Features) -> DataFrame:
    return sparse.SparseKernel.of(tables, f.numeric, f.categorical, f.options.get("seed", 42)).score(test)


def _fit_centre(train: DataFrame, f: Features) -> Tables:
    params = encoding.robust_params(train, f.numeric)
    rows = _with_vector(train.select(*f.numeric), f, params).filter(F.col(VECTOR).isNotNull())
    return {"params": params, "centre": stage(centre.centre_vector(rows, VECTOR), "centre")}


def _score_centre(test: DataFrame, tables: Tables, f: Features) -> DataFrame:
    return centre.centre_distance(_with_vector(test, f, tables["params"]), VECTOR, tables["centre"], "score").drop(VECTOR)


def _fit_spread(train: DataFrame, f: Features) -> Tables:
    return {"params": encoding.std_params(train, f.numeric)}


def _score_spread(test: DataFrame, tables: Tables, f: Features) -> DataFrame:
    return encoding.max_abs_z(test, f.numeric, tables["params"])


def _fit_counts(train: DataFrame, f: Features) -> Tables:
    model = catmodel.CountModel(train.withColumn("_year", F.lit(0)), f.categorical, [0], "_year")
    return {"pairs": model.pairs, "singles": model.singles}


def _score_counts(test: DataFrame, tables: Tables, f: Features) -> DataFrame:
    model = catmodel.CountModel.of(tables["pairs"], tables["singles"], f.categorical, [0])
    return catmodel.score_each(model, test, catmodel.pooled, f.options.get("seed", 42))


def _key(f: Features) -> str:
    if len(f.row_id) != 1:
        raise ValueError("neighbours need one id column")
    return f.row_id[0]


def _fitted_rows(train: DataFrame, f: Features) -> Tables:
    params = encoding.robust_params(train, f.numeric)
    rows = _with_vector(train.select(_key(f), *f.numeric), f, params).filter(F.col(VECTOR).isNotNull())
    return {"params": params, "rows": stage(rows.select(_key(f), VECTOR), "fitted_rows")}


def _met(test: DataFrame, scored: DataFrame, f: Features) -> DataFrame:
    return join_same(test, scored.withColumnRenamed("id", _key(f)), [_key(f)], "left")


def _asked(test: DataFrame, tables: Tables, f: Features) -> DataFrame:
    rows = _with_vector(test.select(_key(f), *f.numeric), f, tables["params"])
    return rows.filter(F.col(VECTOR).isNotNull()).select(_key(f), VECTOR)


def _score_distance(test: DataFrame, tables: Tables, f: Features) -> DataFrame:
    k = f.options.get("k", NEIGHBOURS)
    return _met(test, neighbours.knn_distance(_asked(test, tables, f), tables["rows"], k, _key(f), VECTOR), f)


def _fit_lof(train: DataFrame, f: Features) -> Tables:
    tables = _fitted_rows(train, f)
    return {**tables, "density": neighbours.fit_lof(tables["rows"], f.options.get("k", NEIGHBOURS), _key(f), VECTOR)}


def _score_lof(test: DataFrame, tables: Tables, f: Features) -> DataFrame:
    k = f.options.get("k", NEIGHBOURS)
    return _met(test, neighbours.score_lof(_asked(test, tables, f), tables["rows"], tables["density"], k, _key(f), VECTOR), f)


register("ecod", _fit_tails, _score_tails("ecod"))
register("copod", _fit_tails, _score_tails("copod"))
register("isolation_forest", _fit_forest, _score_forest)
register("pca", _fit_pca, _score_pca)
register("kernel", _fit_kernel, _score_kernel)
register("centre", _fit_centre, _score_centre)
register("max_abs_z", _fit_spread, _score_spread)
register("count_model", _fit_counts, _score_counts)
register("knn_distance", _fitted_rows, _score_distance)
register("lof", _fit_lof, _score_lof)
