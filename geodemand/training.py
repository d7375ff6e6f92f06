"""The training job: geographic folds, boosted models, out-of-fold predictions, metrics, shapes and the saved model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geodemand.operators import additive as AD
from geodemand.operators.boosting import Boosting, Fit, Store, fit_boosted
from geodemand.operators.kmeans import fit_centres, with_group


@dataclass
class Training:
    """``rows`` have grp, fold and part; ``fit`` the models by fold and ``final``."""

    rows: DataFrame
    fit: Fit
    y: str

    def out_of_fold(self, out: str = "pred_log") -> DataFrame:
        """Every row once, predicted by the model that has not seen its fold."""
        parts = [m.score(self.rows.where(F.col("fold") == f), out) for f, m in self.fit.models.items() if f != "final"]
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        return found

    def metrics(self) -> DataFrame:
        """(label, fold, rmse_log, r2, n) of each fold and, without a fold, of all out-of-fold predictions."""
        return fold_metrics(self.out_of_fold(), self.y)

    def shapes(self) -> DataFrame:
        return self.fit.models["final"].shape_table(self.rows.sparkSession)

    def importance(self) -> DataFrame:
        return self.rows.sparkSession.createDataFrame(AD.importance(self.fit.models["final"]),
                                                      "feature string, mean_abs_score double, score_range double, n_bins int")

    def write(self, folder: str) -> None:
        """Metrics, out-of-fold predictions, shapes, importance and the final model, as Parquet tables under the folder."""
        oof = self.out_of_fold().checkpoint()
        for name, table in (("oof", oof), ("metrics", fold_metrics(oof, self.y)), ("shapes", self.shapes()), ("importance", self.importance())):
            table.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")
        AD.save_model(self.fit.models["final"], self.rows.sparkSession, f"{folder.rstrip('/')}/model")


def fold_metrics(oof: DataFrame, y: str = "y", pred: str = "pred_log") -> DataFrame:
    err = F.col(y) - F.col(pred)
    measures = [F.sqrt(F.avg(err * err)).alias("rmse_log"), F.try_divide(F.sum(err * err), F.var_pop(y) * F.count(y)).alias("_left"), F.count(y).alias("n")]
    each = oof.groupBy("fold").agg(*measures).withColumn("label", F.concat(F.lit("fold_"), (F.col("fold") + 1).cast("string")))
    whole = oof.agg(*measures).withColumns({"label": F.lit("oof_overall"), "fold": F.lit(None).cast("int")})
    return each.unionByName(whole).select("label", F.col("fold").cast("int").alias("fold"), "rmse_log", (1 - F.col("_left")).alias("r2"), "n")


def grouped_folds(rows: DataFrame, y: str = "y", *, groups: int = 20, folds: int = 5, strata: int = 5, restarts: int = 10, seed: int = 42) -> DataFrame:
    """``rows`` with ``grp`` (k-means of lat, lon) and ``fold``: groups stay whole, folds have near equal shares of each stratum of y."""
    spark = rows.sparkSession
    labelled = with_group(rows, fit_centres(rows, groups, seed, restarts))
    with_stratum, _ = AD.quantile_strata(labelled, y, strata, exact=True)
    counts: dict = {}
    for r in with_stratum.groupBy("grp", "stratum").agg(F.count(F.lit(1)).alias("n")).collect():  # groups x strata
        counts.setdefault(r.grp, {})[r.stratum] = r.n
    of = spark.createDataFrame([(int(g), int(f)) for g, f in AD.assign_group_folds(counts, folds).items()], "grp int, fold int")
    return labelled.join(F.broadcast(of), "grp")


def train(rows: DataFrame, features: list[str], categorical: list[str] = (), *, y: str = "y", id_col: str = "id", how: Boosting = Boosting(),  # noqa: B008
          groups: int = 20, folds: int = 5, strata: int = 5, restarts: int = 10, validation: float = 0.15, seed: int = 42,
          folder: str | None = None) -> Training:
    """Cross-validated fit of ``y`` on the features of ``rows`` (id, features, y, lat, lon; any others stay).

    Rows without y are left out. A share of the rows, by the hash of their id,
    decides when a model's rounds end. With a ``folder`` in shared storage, the
    folds, bins, moments and rounds are kept there: a call with the same folder
    goes on where a lost driver stopped, and the outputs are written there at the
    end (:meth:`Training.write`).
    """
    store = Store(rows.sparkSession, folder)
    part = (F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(10_000)) < int(validation * 10_000)).cast("int")

    def assigned() -> DataFrame:
        known = rows.where(F.col(y).isNotNull())
        known = grouped_folds(known, y, groups=groups, folds=folds, strata=strata, restarts=restarts, seed=seed)
        return known.withColumn("part", part)

    kept = store.table("assigned", assigned)
    fit = fit_boosted(kept.select(*features, F.col(y).alias("y"), "fold", "part"), features, list(categorical), how, folds=folds, folder=folder)
    done = Training(kept, fit, y)
    if folder:
        done.write(folder)
    return done


def train_final(rows: DataFrame, features: list[str], categorical: list[str] = (), *, y: str = "y", id_col: str = "id", how: Boosting = Boosting(),  # noqa: B008
                validation: float = 0.15, seed: int = 42) -> AD.AdditiveModel:
    """The model on all rows alone, without folds."""
    part = (F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(10_000)) < int(validation * 10_000)).cast("int")
    kept = rows.where(F.col(y).isNotNull()).select(*features, F.col(y).alias("y"), part.alias("part"))
    return fit_boosted(kept, features, list(categorical), how).models["final"]
