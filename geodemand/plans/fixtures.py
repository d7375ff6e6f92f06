"""Domain inputs derived from the base tables with the DataFrame API.

Each builder maps TPC-H-ish base tables onto one role of the domain model
(sites with coordinates, weighted places, noisy observations, a timetable,
dirty area statistics). All of them grow with the scale factor. The same
derivations as SQL text live in ``fixture_sql.py`` for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geodemand.sources.tables import table


def _numbered(prefix: str, k):
    return F.concat(F.lit(prefix), F.lpad(k.cast("string"), 9, "0"))


class Fixtures:
    """Lazily built derived inputs for one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        from geodemand.session import ensure_checkpoint_dir, ship_package
        ensure_checkpoint_dir(spark)
        ship_package(spark)
        self.spark = spark
        self.sf_dir = sf_dir
        self._memo: dict[str, DataFrame] = {}

    def t(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def _get(self, key, build):
        if key not in self._memo:
            self._memo[key] = build()
        return self._memo[key]

    # -- spatial roles -------------------------------------------------------------
    def sites(self) -> DataFrame:
        """Entities with coordinates: one row per supplier, block = nation."""
        def build():
            s = self.t("supplier")
            k = F.col("s_suppkey")
            return s.select(
                k.alias("site_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("state"),
                F.col("s_acctbal").alias("value"),
                (F.lit(35.0) + (k * 7919 % 1000) / F.lit(100.0)).alias("lat"),
                (F.lit(-85.0) + (k * 6151 % 1000) / F.lit(100.0)).alias("lon"),
            )
        return self._get("sites", build)

    def places(self) -> DataFrame:
        """Weighted reference points: one row per customer, weight 0 .. 1,000,000.

        ``town`` is a dirty label: some places share it, every tenth bears the name of a site.
        """
        def build():
            c = self.t("customer")
            k = F.col("c_custkey")
            return c.select(
                k.alias("place_id"), F.col("c_name").alias("name"),
                F.when(k % 10 == 0, F.concat(F.lit(" "), F.upper(_numbered("Supplier#", F.expr("c_custkey div 10"))), F.lit(" ")))
                .otherwise(_numbered("Customer#", k - k % 3)).alias("town"), F.col("c_nationkey").alias("state"),
                F.floor(F.greatest(F.col("c_acctbal"), F.lit(0.0)) * 100).cast("bigint").alias("pop"),
                (F.lit(35.0) + ((k + 17) * 3571 % 9973) / F.lit(1000.0)).alias("lat"),
                (F.lit(-85.0) + ((k + 17) * 7907 % 9967) / F.lit(1000.0)).alias("lon"),
            )
        return self._get("places", build)

    def obs(self) -> DataFrame:
        """Noisy observations of sites: jittered coordinates, dirty names, every 11th in the wrong block."""
        def build():
            sites = self.sites()
            # Scalar action: the number of sites is a distributed count, not data through the driver.
            n_sites = sites.count()
            c = self.t("customer").select("c_custkey", "c_acctbal")
            k = F.col("c_custkey")
            c = c.withColumn("_site", k % F.lit(n_sites))
            j = c.join(sites, c["_site"] == sites["site_id"], "inner")
            raw_name = F.when(
                k % 3 == 0,
                F.concat(F.lit("#"), F.expr("right(name, 9)"), F.lit(" Supplier (Lot "), k.cast("string"),
                         F.lit("), XX")),
            ).otherwise(F.concat(F.col("name"), F.lit(" Station, XX")))
            return j.select(
                k.alias("obs_id"), F.col("site_id").alias("true_site"), F.col("c_acctbal").alias("value"),
                F.when(k % 11 == 0, (F.col("state") + 1) % 25).otherwise(F.col("state")).alias("state"),
                raw_name.alias("raw_name"),
                (F.col("lat") + ((k * 37 % 101) - 50) / F.lit(400.0)).alias("lat"),
                (F.col("lon") + ((k * 53 % 103) - 51) / F.lit(400.0)).alias("lon"),
            )
        return self._get("obs", build)

    def obs_gaps(self) -> DataFrame:
        """Observations with NULL coordinates (every 17th) and NULL blocks (every 19th)."""
        def build():
            o = self.obs()
            i = F.col("obs_id")
            return o.select(
                "obs_id", "raw_name", "value",
                F.when(i % 19 == 0, F.lit(None)).otherwise(F.col("state")).alias("state"),
                F.when(i % 17 == 0, F.lit(None)).otherwise(F.col("lat")).alias("lat"),
                F.when(i % 17 == 0, F.lit(None)).otherwise(F.col("lon")).alias("lon"),
            )
        return self._get("obs_gaps", build)

    def facilities(self) -> DataFrame:
        """Transport facilities at site coordinates with coded service columns (0-3) and a class code."""
        def build():
            s = self.sites()
            k = F.col("site_id")
            return s.select(
                F.col("site_id").alias("facility_id"), F.col("lat"), F.col("lon"),
                (k % 4).cast("int").alias("rail_code"), ((k * 7 + 1) % 4).cast("int").alias("bus_code"),
                (F.col("state") % 4).cast("int").alias("air_code"), (k % 3).cast("int").alias("class_code"),
            )
        return self._get("facilities", build)

    # -- timetable roles -----------------------------------------------------------
    def trips(self) -> DataFrame:
        def build():
            o = self.t("orders")
            return o.select(
                F.col("o_orderkey").alias("trip_id"), F.expr("o_custkey div 3").alias("route_id"),
                F.col("o_orderpriority").alias("service_id"),
                (F.col("o_orderkey") % 2).cast("int").alias("direction_id"),
                F.col("o_orderstatus").alias("kind"),
            )
        return self._get("trips", build)

    def calendar(self) -> DataFrame:
        """Service calendar ('5-LOW' deliberately absent, so its trips run 0 days)."""
        def build():
            # The four service patterns of the derived timetable.
            rows = [("1-URGENT", 1, 1, 1, 1, 1, 1, 1), ("2-HIGH", 1, 1, 1, 1, 1, 0, 0),
                    ("3-MEDIUM", 0, 0, 0, 0, 0, 1, 1), ("4-NOT SPECIFIED", 1, 0, 1, 0, 1, 0, 0)]
            return self.spark.createDataFrame(
                rows, "service_id string, mon int, tue int, wed int, thu int, fri int, sat int, sun int")
        return self._get("calendar", build)

    def stop_times(self) -> DataFrame:
        """Ordered visits: one per line item, sequence by a total order inside each order."""
        def build():
            li = self.t("lineitem")
            order = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
                     "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
            w = Window.partitionBy("l_orderkey").orderBy(*order)
            x = li.select(
                F.col("l_orderkey").alias("trip_id"), F.col("l_suppkey").alias("stop_id"),
                F.floor(F.col("l_quantity")).cast("int").alias("qty"),
                F.row_number().over(w).cast("int").alias("stop_sequence"),
            )
            hh = F.lpad((F.lit(6) + F.col("stop_sequence") * 3).cast("string"), 2, "0")
            mm = F.lpad((F.col("stop_id") * 7 % 60).cast("string"), 2, "0")
            return x.select(
                "trip_id", "stop_id", "stop_sequence",
                F.concat(hh, F.lit(":"), mm, F.lit(":00")).alias("arrival_time"),
                F.concat(hh, F.lit(":"), mm, F.lit(":"), F.lpad(F.col("qty").cast("string"), 2, "0")).alias(
                    "departure_time"),
            )
        return self._get("stop_times", build)

    def stops(self) -> DataFrame:
        """Stops of the timetable are the sites (stop_id = site_id)."""
        return self.sites().select(F.col("site_id").alias("stop_id"), F.col("name").alias("stop_name"),
                                   F.col("lat").alias("stop_lat"), F.col("lon").alias("stop_lon"))

    # -- area statistics -----------------------------------------------------------
    def area_stats(self) -> DataFrame:
        def build():
            n = self.t("nation")
            k = F.col("n_nationkey")
            return n.select(
                F.lpad(k.cast("string"), 5, "0").alias("area_fips"),
                F.when(k % 7 == 0, F.lit("-")).otherwise((1000 + k * 13).cast("string")).alias("total_raw"),
                F.when(k % 5 == 0, F.lit("N")).otherwise((100 + k * 3).cast("string")).alias("part_raw"),
                F.when(k % 6 == 0, F.lit("250,000+")).otherwise((50000 + k * 1000).cast("string")).alias(
                    "income_raw"),
            )
        return self._get("area_stats", build)

    # -- modelling table -----------------------------------------------------------
    def model_table(self) -> DataFrame:
        """One row per customer: order features and target log1p(total spend)."""
        def build():
            c = self.t("customer")
            o = self.t("orders")
            per = o.groupBy("o_custkey").agg(
                F.count(F.lit(1)).alias("n_orders"),
                F.sum("o_totalprice").alias("spend"),
                F.avg("o_totalprice").alias("avg_price"),
                F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("n_finished"),
            )
            places = self.places().select("place_id", "lat", "lon", "pop")
            j = (c.join(per, c["c_custkey"] == per["o_custkey"], "inner")
                 .join(places, c["c_custkey"] == places["place_id"], "inner"))
            return j.select(
                F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                F.col("c_nationkey").cast("double").alias("nation"),
                F.col("c_acctbal").alias("balance"),
                F.col("c_mktsegment").alias("segment"),
                F.col("n_orders").cast("double").alias("n_orders"),
                F.col("avg_price"), F.col("n_finished").cast("double").alias("n_finished"),
                F.col("lat"), F.col("lon"), F.col("pop").cast("double").alias("pop"),
                F.col("spend"), F.log1p(F.col("spend")).alias("y"),
            )
        return self._get("model_table", build)
