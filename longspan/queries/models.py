"""Linear models, forests, clustering and principal scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from longspan.operators import cluster, forest, linear, metrics, ranking, splits, typology
from longspan.operators.windows import Trajectory, as_of
from longspan.plans import panels
from longspan.sources.workspace import written

from .base import LABELS, PEOPLE, WEEKS, query, rounded

T = Trajectory()


def _samples(spark, d):
    w = panels.supplier_weeks(spark, d)
    w = w.withColumn("y", F.log1p("qty_sum")).withColumn("recent", T.trailing_mean(F.col("y"), 7)).withColumn("spread", T.trailing_sd(F.col("y"), 42)).where("recent IS NOT NULL")
    return splits.forecast(w, T, 0.35)


@query(f"""WITH {WEEKS}, f AS (SELECT cohort, unit, date, ln(1 + qty_sum) AS y FROM weeks), g AS (SELECT *, CASE WHEN count(y) OVER w >= 7 THEN avg(y) OVER w END AS x FROM f WINDOW w AS (PARTITION BY cohort, unit ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, row_number() OVER (PARTITION BY cohort, unit ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY cohort, unit) AS n FROM g WHERE x IS NOT NULL), s AS (SELECT *, pos >= least(greatest(1, floor(n * (1 - 35e-2))::BIGINT), n - 1) AS test FROM r WHERE n >= 5),
m AS (SELECT cohort, avg(x) AS mx, CASE WHEN stddev_pop(x) > 1e-12 THEN stddev_pop(x) ELSE 1 END AS sx, avg(y) AS my FROM s WHERE NOT test GROUP BY ALL),
b AS (SELECT cohort, any_value(mx) AS mx, any_value(sx) AS sx, any_value(my) AS my, sum((x - mx) / sx * (y - my)) / (sum(((x - mx) / sx) ** 2) + 1) AS beta FROM s JOIN m USING (cohort) WHERE NOT test GROUP BY ALL)
SELECT cohort, count(*) AS n, round(avg(abs(y - (my + beta * (x - mx) / sx))), 5) AS mae FROM s JOIN b USING (cohort) WHERE test GROUP BY ALL""")
def mdl01_mdl03_ridge_one_feature(spark, d):
    fit = linear.ridge(_samples(spark, d), ["recent"], "y", ["cohort"]).where("role = 'test'")
    return metrics.regression(fit, "y", "prediction", ["cohort"]).select("cohort", "n", F.round("mae", 5).alias("mae"))


@query()
def mdl04_mdl14_ridge_models(spark, d):
    """Held-out errors of three feature sets, one model a cohort each, from one table of cross-products."""
    models = {"calendar": (["position"], 1.0), "history": (["recent", "spread"], 1.0), "full": (["position", "recent", "spread", "mean_tax"], 10.0)}
    return metrics.regressions(linear.ridge_models(_samples(spark, d), models, "y", ["cohort"]).where("role = 'test'"), "y", list(models), ["cohort"])


BLOCKS = f"""WITH {WEEKS}, f AS (SELECT cohort, unit, date, ln(1 + qty_sum) AS y FROM weeks), g AS (SELECT *, CASE WHEN count(y) OVER w >= 7 THEN avg(y) OVER w END AS x, CASE WHEN count(y) OVER v >= 7 THEN stddev_samp(y) OVER v END AS z FROM f
 WINDOW w AS (PARTITION BY cohort, unit ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), v AS (PARTITION BY cohort, unit ORDER BY date ROWS BETWEEN 42 PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, row_number() OVER (PARTITION BY cohort, unit ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY cohort, unit) AS n FROM g WHERE x IS NOT NULL), s AS (SELECT *, pos >= least(greatest(1, floor(n * (1 - 35e-2))::BIGINT), n - 1) AS test FROM r WHERE n >= 5),
m AS (SELECT cohort, avg(pos) AS mp, stddev_pop(pos) AS sp, avg(x) AS mx, stddev_pop(x) AS sx, avg(z) AS mz, stddev_pop(z) AS sz, avg(y) AS my FROM s WHERE NOT test GROUP BY ALL),
k AS (SELECT s.cohort, test, y, my, (pos - mp) / sp AS p, (x - mx) / sx AS x, (z - mz) / sz AS z FROM s JOIN m USING (cohort)),
b AS (SELECT cohort, sum(p * (y - my)) / (sum(p * p) + 1) AS bp, sum(x * x) + 1 AS xx, sum(z * z) + 1 AS zz, sum(x * z) AS xz, sum(x * (y - my)) AS xy, sum(z * (y - my)) AS zy FROM k WHERE NOT test GROUP BY ALL),
e AS (SELECT cohort, y, my + bp * p AS calendar, my + (zz * xy - xz * zy) / (xx * zz - xz * xz) * x + (xx * zy - xz * xy) / (xx * zz - xz * xz) * z AS history FROM k JOIN b USING (cohort) WHERE test)"""


@query(BLOCKS + " ".join(f" {u} SELECT cohort, '{m}' AS model, count(*) AS n, round(avg(abs(y - {m})), 5) AS mae, round(1 - sum((y - {m}) ** 2) / (var_pop(y) * count(*)), 5) AS r2, round(covar_pop(y, {m}) / sqrt(var_pop(y) * var_pop({m})), 5) AS r FROM e GROUP BY ALL" for u, m in (("", "calendar"), ("UNION ALL", "history"))))
def mdl04_ridge_blocks(spark, d):
    """The blocks of one and of two features out of the same cross-products, beside a larger model."""
    models = {"calendar": (["position"], 1.0), "history": (["recent", "spread"], 1.0), "full": (["position", "recent", "spread", "mean_tax"], 10.0)}
    fit = linear.ridge_models(_samples(spark, d), models, "y", ["cohort"]).where("role = 'test'")
    return rounded(metrics.regressions(fit, "y", ["calendar", "history"], ["cohort"]), 5)


def _increment(spark, d, alpha=10.0):
    """regime, cohort, unit, target, half: errors of a target's own history and of all targets' histories, per half of each trajectory.

    Rows are written once, with their places.  The cross-products of all targets and histories are
    summed once for every block of places; a target's own model is a sub-block.  Only test rows
    are dealt to regimes.
    """
    w = panels.supplier_weeks(spark, d)
    own, recents = [f"log_{t}" for t in panels.TARGETS], [f"recent_{t}" for t in panels.TARGETS]
    w = w.withColumns({f"log_{t}": F.log1p(F.greatest(F.col(t), F.lit(0.0))) for t in panels.TARGETS})  # 0 where a target is null
    w = w.withColumns({f"recent_{t}": T.trailing_mean(F.col(f"log_{t}"), 7, 7) for t in panels.TARGETS}).where("recent_line_count IS NOT NULL")
    rows = w.withColumn("position", T.position()).withColumn("n_rows", T.size()).select("cohort", "unit", "position", "n_rows", *own, *recents)
    rows = written(rows, "histories")
    place, n = F.col("position"), F.col("n_rows")
    trained = [(regime, half, (place >= low) & (place < high)) for regime, half, role, low, high in splits.blocks(n) if role == "train"]
    models = {f"{m}_{t}": (features, alpha, f"log_{t}") for t in panels.TARGETS for m, features in (("own", [f"recent_{t}"]), ("all_targets", recents))}
    fits = linear.ridge_blocks(rows, [inside for _, _, inside in trained], models, own + recents)
    fits = {(regime, half): fit for (regime, half, _), fit in zip(trained, fits) if fit}
    test = rows.withColumn("block", F.explode(splits.regimes(place, n, "test"))).select("block.regime", "block.half", "cohort", "unit", *own, *recents)

    def errors(parts):
        for part in parts:
            y, x = part[own].to_numpy(float), part[own + recents].to_numpy(float)
            out = part[["regime", "half", "cohort", "unit"]].copy()
            away, fitted = np.zeros((len(part), len(models))), np.zeros(len(part), bool)
            for (regime, half), fit in fits.items():
                at = ((part["regime"] == regime) & (part["half"] == half)).to_numpy()
                fitted |= at
                intercepts, weights = np.array([a for a, _ in fit.values()]), np.column_stack([b for _, b in fit.values()])
                away[at] = np.abs(np.repeat(y[at], 2, axis=1) - intercepts - x[at] @ weights)
            yield out.assign(**{m: away[:, i] for i, m in enumerate(models)})[fitted]

    kinds = ", ".join(f"{c} {test.schema[c].dataType.simpleString()}" for c in ("regime", "half", "cohort", "unit"))
    e = test.mapInPandas(errors, f"{kinds}, {', '.join(f'{m} double' for m in models)}").groupBy("regime", "cohort", "unit", "half")
    e = e.agg(F.count(F.lit(1)).alias("n_obs"), *[F.avg(m).alias(m) for m in models]).where("n_obs >= 10")
    each = F.array(*[F.struct(F.lit(t).alias("target"), F.col("n_obs"), F.col(f"own_{t}").alias("mae_own"), F.col(f"all_targets_{t}").alias("mae_all_targets")) for t in panels.TARGETS])
    out = e.select("regime", "cohort", "unit", "half", F.inline(each))
    return out.withColumn("increment", 1 - F.col("mae_all_targets") / F.greatest("mae_own", F.lit(1e-8)))


@query()
def inf24_cross_domain_increment(spark, d):
    """What the histories of all targets add to a target's own, and whether persons keep it from half to half in every regime."""
    inc = written(_increment(spark, d), "increments")
    person = inc.groupBy("regime", "cohort", "unit", "half").agg(F.avg("increment").alias("increment"), F.count(F.lit(1)).alias("n")).where("n >= 4")
    wide = person.groupBy("regime", "cohort", "unit").agg(*[F.max(F.when(F.col("half") == h, F.col("increment"))).alias(h) for h in ("early", "late")])
    kept = metrics.pearson(wide, "early", "late", ["regime"]).withColumnRenamed("r", "stability")
    mean = inc.groupBy("regime").agg(F.count(F.lit(1)).alias("n_target_halves"), F.avg("increment").alias("mean_increment"), F.avg((F.col("increment") > 0).cast("double")).alias("share_positive"))
    return kept.join(F.broadcast(mean), "regime").withColumn("adds", (F.col("mean_increment") > 0) & (F.col("stability") >= 0.3))


@query()
def mdl02_logistic(spark, d):
    w = panels.labelled_weeks(spark, d).withColumn("recent", T.trailing_mean(F.col("label").cast("double"), 7, 3))
    fit = linear.logistic(splits.floor_split(w, T), ["recent", "mean_tax", "line_count"], "label").where("role = 'test'")
    return metrics.auroc(fit, "label", "probability", ["cohort"]).join(metrics.classification(fit, "label", "probability", ["cohort"]), "cohort")


#: Shares of test rows and seeds of the grid of splits, and the feature sets whose areas are compared.
SPLITS, SEEDS = [0.25, 0.35, 0.45], [11, 42, 73]
FEATURE_SETS = {"prior": ["prior_rate"], "day_plus_prior": ["mean_tax", "line_count", "mean_discount", "prior_rate"], "history_plus_prior": ["recent_tax", "recent_lines", "spread_lines", "prior_rate"]}


def _labelled_features(spark, d):
    w = panels.labelled_weeks(spark, d)
    w = w.withColumn("prior_rate", T.prior_rate(F.col("label") == 1, F.lit(None))).withColumn("recent_tax", T.trailing_mean(F.col("mean_tax"), 7, 3))
    w = w.withColumn("recent_lines", T.trailing_mean(F.col("line_count"), 7, 3)).withColumn("spread_lines", T.trailing_sd(F.col("line_count"), 14, 3))
    return w.select("cohort", "unit", "date", "label", *dict.fromkeys(f for fs in FEATURE_SETS.values() for f in fs))


def _contrast_gate(areas, keys):
    """Areas by cell and model (``keys``: what else tells cells apart) to contrasts and the rule over all cells of a kind."""
    wide = areas.groupBy("kind", "cell", *keys).agg(*[F.max(F.when(F.col("model") == m, F.col("auroc"))).alias(m) for m in FEATURE_SETS])
    both = F.array(*[F.struct(F.lit(m).alias("contrast"), (F.col(m) - F.col("prior")).alias("delta")) for m in FEATURE_SETS if m != "prior"])
    d = wide.select("kind", F.inline(both)).where("delta IS NOT NULL")
    g = d.groupBy("kind", "contrast").agg(F.count(F.lit(1)).alias("n_cells"), F.median("delta").alias("median_delta"), F.min("delta").alias("least_delta"), F.max("delta").alias("largest_delta"), F.count_if(F.col("delta") <= 0).alias("n_nonpositive"))
    # of nine cells seven at least; the same share of as many as a kind has
    return g.withColumn("no_material_increment", (F.col("median_delta") <= 0) & (9 * F.col("n_nonpositive") >= 7 * F.col("n_cells")) & (F.col("largest_delta") < 0.01))


def _logistic_areas(spark, d):
    rows = splits.role_bits(_labelled_features(spark, d), T, SPLITS)
    p = linear.logistic_grid(rows, FEATURE_SETS, "label", [str(s) for s in SPLITS])
    return ranking.areas(p, "label", "probability", ["cell", "model"])


@query()
def spl08_mdl06_logistic_grid(spark, d):
    """Area of every feature set in every split, all nine fits from one table by one aggregate a step."""
    return _logistic_areas(spark, d)


@query()
def gat03_logistic_contrasts(spark, d):
    """What a day's or the history's features add to the prior rate of labels, over the splits; no seed enters these fits."""
    return _contrast_gate(_logistic_areas(spark, d).withColumn("kind", F.lit("logistic")), [])


@query()
def mdl05_mdl06_spl08_forest_grid(spark, d):
    """The same contrasts by forests of 300 trees in all nine cells of splits and seeds, beside the logistic ones."""
    rows = written(splits.role_bits(_labelled_features(spark, d), T, SPLITS), "labelled-features")
    cells = [str(s) for s in SPLITS]
    logistic = ranking.areas(linear.logistic_grid(rows, FEATURE_SETS, "label", cells), "label", "probability", ["cell", "model"])
    out = logistic.select(F.lit("logistic").alias("kind"), "cell", "model", F.lit(0).alias("seed"), "auroc")
    grown = forest.areas(rows, FEATURE_SETS, "label", cells, SEEDS).select(F.lit("forest").alias("kind"), "cell", "model", "seed", "auroc")
    return _contrast_gate(written(out.unionByName(grown), "grid-areas"), ["seed"])


@query(f"""WITH {PEOPLE}, p AS (SELECT unit, spent AS y, n_orders AS x FROM people WHERE spent IS NOT NULL AND n_orders IS NOT NULL)
SELECT unit, round(y - regr_intercept(y, x) OVER () - regr_slope(y, x) OVER () * x, 5) AS residual FROM p""")
def mdl07_mdl08_residual_by_pseudo_inverse(spark, d):
    p = panels.people(spark, d).select("unit", "spent", "n_orders").withColumn("copy", F.col("n_orders") * 2)
    return linear.residual_wide(p, "spent", ["n_orders", "copy"], [], "residual").select("unit", F.round("residual", 5).alias("residual"))


@query()
def mdl10_principal_scores(spark, d):
    return cluster.principal_scores(panels.people(spark, d), ["balance", "n_orders", "spent", "n_closed"], ["unit"])


@query("""WITH c AS (SELECT vec_id AS k, embedding AS c FROM embeddings WHERE vec_id < 3), s AS (SELECT e.vec_id, k, list_dot_product(e.embedding::DOUBLE[], c::DOUBLE[]) / sqrt(list_dot_product(c::DOUBLE[], c::DOUBLE[])) AS v FROM embeddings e, c)
SELECT vec_id, (row_number() OVER () * 0 + k)::INT AS cluster FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, k) AS r FROM s) WHERE r = 1""")
def mdl12_assign_by_cosine(spark, d):
    e = panels.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    centroids = [r["u"] for r in e.where("vec_id < 3").orderBy("vec_id").select(cluster.unit(F.col("v")).alias("u")).collect()]
    return cluster.assign(e, "v", centroids).select("vec_id", F.col("cluster").cast("int").alias("cluster"))


@query()
def mdl11_mdl13_agg39_spherical_kmeans(spark, d):
    """Clusters of the embeddings against their labels, with the mean silhouette."""
    e = panels.table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    e = cluster.directions(e, "v", "vec_id")
    a = written(cluster.assign(e, "v", cluster.spherical_kmeans(e, "v", 10, restarts=3)), "clusters")
    s = cluster.exact_silhouette(a, "v", "vec_id", "cluster").agg(F.avg("silhouette").alias("silhouette"))
    return metrics.adjusted_rand(a, "cluster", "label", []).join(F.broadcast(s), F.lit(True))


@query("""WITH f AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id, a.label AS la, b.label AS lb, 1 - list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) AS d FROM f a, f b WHERE a.vec_id <> b.vec_id),
m AS (SELECT vec_id, la, lb, avg(d) AS d FROM p GROUP BY ALL), s AS (SELECT vec_id, max(d) FILTER (la = lb) AS a, min(d) FILTER (la <> lb) AS b FROM m GROUP BY ALL) SELECT vec_id, round(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM s""")
def mdl13_exact_silhouette(spark, d):
    e = panels.table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    return rounded(cluster.exact_silhouette(e, "v", "vec_id", "label"))


REGIMES = ["fixed", "disjoint"]


def _profiles(spark, d):
    """Early and late profiles of what skill keeps beyond spread and entropy, in two regimes, with gaps at zero; written once."""
    from longspan.plans import robustness

    from .robust import _metrics

    m = robustness.residual_z(_metrics(spark, d), "history_skill_z", ["observed_sd_z", "observed_entropy_z"], "residual_z")
    p = robustness.profiles(m.where(F.col("regime").isin(REGIMES)), "residual_z", panels.TARGETS, 4)
    fill = lambda c: F.transform(c, lambda x: F.coalesce(x, F.lit(0.0))).alias(c)
    return written(p.select("regime", "cohort", "unit", fill("early"), fill("late")), "typology-profiles")


def _typology(spark, d, restarts=30, all_restarts=0):
    p = _profiles(spark, d)
    cohorts = [r["cohort"] for r in p.select("cohort").distinct().orderBy("cohort").collect()]
    return p, typology.fit(p, typology.grid(REGIMES, cohorts, range(2, 6), restarts, all_restarts))


@query()
def inf17_inf18_typology_folds(spark, d):
    """Two to five clusters learned from other cohorts' early profiles: do a left-out cohort's early and late assignments agree?"""
    return typology.validated(*_typology(spark, d))


@query()
def inf17_inf18_gat08_typology(spark, d):
    """Which number of clusters is supported in both regimes, with the domains that stand out in each cluster of all rows."""
    p, found = _typology(spark, d, all_restarts=100)
    out = typology.summarised(typology.validated(p, found), REGIMES)
    tops = [(r, k, [panels.TARGETS[i] for i in c.argmax(1)], [panels.TARGETS[i] for i in c.argmin(1)]) for (r, held, k), c in found.items() if held is None]
    tops = spark.createDataFrame(tops, "regime string, k int, top_positive array<string>, top_negative array<string>")
    return out.join(F.broadcast(tops), ["regime", "k"], "left")  # a row for each model of all rows


@query(f"""WITH {LABELS}, p AS (SELECT *, last_value(returned_qty IGNORE NULLS) OVER w AS prior, row_number() OVER (PARTITION BY cohort, unit ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY cohort, unit) AS n FROM labelled WINDOW w AS (PARTITION BY cohort, unit ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT cohort, returned_qty AS y, prior AS x, pos >= least(greatest(1, floor(n * 65e-2)::BIGINT), n - 1) AS test FROM p WHERE n >= 4 AND returned_qty IS NOT NULL AND prior IS NOT NULL),
m AS (SELECT cohort, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my FROM s WHERE NOT test GROUP BY ALL), b AS (SELECT cohort, any_value(mx) AS mx, any_value(sx) AS sx, any_value(my) AS my, sum((x - mx) / sx * (y - my)) / (sum(((x - mx) / sx) ** 2) + 10) AS beta FROM s JOIN m USING (cohort) WHERE NOT test GROUP BY ALL)
SELECT cohort, count(*) AS n, round(1 - sum((y - my - beta * (x - mx) / sx) ** 2) / (var_pop(y) * count(*)), 5) AS r2 FROM s JOIN b USING (cohort) WHERE test GROUP BY ALL""")
def inf19_prior_model(spark, d):
    w = panels.labelled_weeks(spark, d).withColumn("prior", T.last_known(F.col("returned_qty")))
    s = splits.floor_split(w, T).where("returned_qty IS NOT NULL AND prior IS NOT NULL")
    fit = linear.ridge(s, ["prior"], "returned_qty", ["cohort"], alpha=10.0).where("role = 'test'")
    return metrics.regression(fit, "returned_qty", "prediction", ["cohort"]).select("cohort", "n", F.round("r2", 5).alias("r2"))


def _priors(spark, d):
    """Every fourth week's returns with their own last value and the last discount of another stream of weeks, split by time."""
    w = written(panels.supplier_weeks(spark, d).select("cohort", "unit", "date", "returned_qty", "mean_discount", F.pmod(F.floor(F.unix_date("date") / 7), F.lit(4)).alias("phase")), "weeks")
    own = w.where("phase = 0").select("cohort", "unit", "date", "returned_qty")
    other = w.where("phase IN (0, 2)").select("cohort", "unit", "date", "mean_discount")
    rows = as_of(own, own.withColumnRenamed("returned_qty", "own"), ["cohort", "unit"], ["own"])
    rows = as_of(rows, other.withColumnRenamed("mean_discount", "other"), ["cohort", "unit"], ["other"])
    rows = splits.floor_split(rows.where("returned_qty IS NOT NULL AND prior_own IS NOT NULL"), T).withColumn("all", F.lit(1))
    train = F.when(F.col("role") == "train", F.col("returned_qty"))
    m = rows.agg(F.avg(train).alias("m"), F.stddev_pop(train).alias("s"))
    return rows.join(F.broadcast(m), F.lit(True)).withColumn("y", (F.col("returned_qty") - F.col("m")) / F.col("s")).drop("m", "s")


PRIORS = f"""WITH {WEEKS}, w AS (SELECT *, floor((date - DATE '1970-01-01') / 7e0)::BIGINT % 4 AS phase FROM weeks), o AS (SELECT cohort, unit, date, returned_qty FROM w WHERE phase = 0),
p AS (SELECT o.*, (SELECT arg_max(x.returned_qty, x.date) FROM o x WHERE x.cohort = o.cohort AND x.unit = o.unit AND x.date < o.date AND x.returned_qty IS NOT NULL) AS a,
 (SELECT arg_max(x.mean_discount, x.date) FROM w x WHERE x.phase IN (0, 2) AND x.cohort = o.cohort AND x.unit = o.unit AND x.date < o.date) AS b FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY cohort, unit ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY cohort, unit) AS n FROM p WHERE returned_qty IS NOT NULL AND a IS NOT NULL), s AS (SELECT *, pos >= least(greatest(1, floor(n * 65e-2)::BIGINT), n - 1) AS test FROM r WHERE n >= 4),
m AS (SELECT avg(returned_qty) AS my, stddev_pop(returned_qty) AS sy, median(b) AS mb FROM s WHERE NOT test), z AS (SELECT test, (returned_qty - my) / sy AS y, a, coalesce(b, mb) AS b FROM s, m),
t AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, avg(y) AS my FROM z WHERE NOT test), k AS (SELECT test, y, my, (a - ma) / sa AS a, (b - mb) / sb AS b FROM z, t),
c AS (SELECT sum(a * a) + 10 AS aa, sum(b * b) + 10 AS bb, sum(a * b) AS ab, sum(a * (y - my)) AS ay, sum(b * (y - my)) AS b_y FROM k WHERE NOT test),
e AS (SELECT y, my + ay / aa * a AS own, my + b_y / bb * b AS other, my + (bb * ay - ab * b_y) / (aa * bb - ab * ab) * a + (aa * b_y - ab * ay) / (aa * bb - ab * ab) * b AS "both" FROM k, c WHERE test)"""


@query(PRIORS + "".join(f""" {u} SELECT '{m}' AS model, count(*) AS n, round(1 - sum((y - "{m}") ** 2) / (var_pop(y) * count(*)), 5) AS r2, round(covar_pop(y, "{m}") / sqrt(var_pop(y) * var_pop("{m}")), 5) AS r FROM e""" for u, m in (("", "own"), ("UNION ALL", "other"), ("UNION ALL", "both"))))
def inf19_prior_models(spark, d):
    """A construct from its own last value, from another construct's, and from both; nothing of the same day is used."""
    models = {"own": (["prior_own"], 10.0), "other": (["prior_other"], 10.0), "both": (["prior_own", "prior_other"], 10.0)}
    fit = linear.ridge_models(_priors(spark, d), models, "y", ["all"]).where("role = 'test'")
    return metrics.regressions(fit, "y", list(models), ["all"]).select("model", "n", F.round("r2", 5).alias("r2"), F.round("r", 5).alias("r"))


@query()
def inf19_prior_models_with_days(spark, d):
    """The same with the days since each last value."""
    own, other = ["prior_own", "days_since_own"], ["prior_other", "days_since_other"]
    models = {"own_prior_only": (own, 10.0), "other_construct_priors": (other, 10.0), "own_plus_other_priors": ([*own, *other], 10.0)}
    rows = _priors(spark, d)
    fit = linear.ridge_models(rows, models, "y", ["all"]).where("role = 'test'")
    users = fit.agg(F.count_distinct("cohort", "unit").alias("n_test_units"))
    return metrics.regressions(fit, "y", list(models), ["all"]).select("model", F.col("n").alias("n_test"), "r2", "r").join(F.broadcast(users), F.lit(True))
