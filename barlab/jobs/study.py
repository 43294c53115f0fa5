"""The nested study and the search as stored predictions, and the evidence on what they select.

A study fits once: its predictions, folds and fits are written to the shared
folder and read by every query. It runs with the protocol's four features, and
with one, for which SQL can follow the fit too.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from barlab.functions.storage import checkpointed, stored_once
from barlab.functions.windows import by_symbol
from barlab.jobs import registry as R, sql as S
from barlab.jobs.registry import P, query, r6, sel
from barlab.operators import bootstrap as boot, features as ft, labels as lb, models as md, newton, scoring as sc, serving as sv, walkforward as wf

ONE = ("ma200",)
CUTS = [date(y, m, 1) for y in range(R.MONTHS[0].year, R.MONTHS[1].year + 1) for m in range(1, 13) if R.MONTHS[0] <= date(y, m, 1) < R.MONTHS[1]]


def nested_rows(bars: DataFrame, horizon: int, names: tuple[str, ...]) -> DataFrame:
    got = lb.close_to_close(ft.all_features(bars), horizon)
    return lb.dataset(got.where("score IS NOT NULL"), list(names), start=P.research_start).select("symbol", "date", "label_end", "target", "score", *names)


def nested_fits(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return newton.newton_folds(rows, ["symbol"], list(names), CUTS, penalty=P.penalty)


def nested_wide(spark: SparkSession, rows: DataFrame, fits: DataFrame, horizon: int, names: tuple[str, ...]) -> DataFrame:
    """symbol, date, label_end, target, cutoff and the probability of every candidate."""
    at = wf.predictions(rows, R.fold_probs(spark, rows, horizon), ["symbol"]).join(fits.select("symbol", "cutoff", "center", "scale", "coefficients"), ["symbol", "cutoff"])
    z = md.scaled(F.array(*names), F.col("center"), F.col("scale"))
    both = md.blends(at.withColumn("logistic", md.logistic_probability(z, F.col("coefficients"))), P.prior_weight)
    return both.select("symbol", "date", "label_end", "target", "cutoff", F.col("prior").alias("historical_prior"), F.col("regime").alias("regime_shrunk"), "logistic_shrunk", "equal_blend", "always_up", "coin_flip")


class Study:
    """The parts of the nested study over the given tables, each written once; both horizons together."""

    def __init__(self, spark: SparkSession, sf_dir: str, names: tuple[str, ...]):
        self.spark, self.sf_dir, self.names = spark, sf_dir, names

    def _once(self, part: str, of) -> DataFrame:
        """``of`` for each horizon, one after the other, with a column horizon."""

        def build() -> DataFrame:
            parts = [of(h).withColumn("horizon", F.lit(h)) for h in P.horizons]
            return parts[0].unionByName(parts[1])

        return stored_once(self.spark, f"{self.sf_dir}|{self.names}|{part}", build)

    @property
    def bars(self) -> DataFrame:
        return stored_once(self.spark, f"{self.sf_dir}|bars", lambda: R.index_bars(self.spark, self.sf_dir))

    @property
    def rows(self) -> DataFrame:
        return self._once("rows", lambda h: nested_rows(self.bars, h, self.names))

    def _of(self, df: DataFrame, horizon: int) -> DataFrame:
        return df.where(F.col("horizon") == horizon).drop("horizon")

    @property
    def fits(self) -> DataFrame:
        return self._once("fits", lambda h: nested_fits(self._of(self.rows, h), self.names))

    @property
    def probabilities(self) -> DataFrame:
        return self._once("probabilities", lambda h: R.fold_probs(self.spark, self._of(self.rows, h), h))

    @property
    def wide(self) -> DataFrame:
        return self._once("wide", lambda h: nested_wide(self.spark, self._of(self.rows, h), self._of(self.fits, h), h, self.names))

    @property
    def long(self) -> DataFrame:
        return wf.long_candidates(self.wide, ["symbol", "horizon"], [*P.selectable, "always_up", "coin_flip"])

    @property
    def selection(self) -> DataFrame:
        return wf.select_from_past(self.long, R.outer(self.spark), ["symbol", "horizon"], list(P.selectable))

    @property
    def outer(self) -> DataFrame:
        """Rows of the outer years: name (nested_primary or a candidate), probability, and the prior's."""
        keys = ["symbol", "horizon"]
        years = self.long.where(F.year("date").isin(*P.reuse_years))
        primary = wf.nested_predictions(years, self.selection, keys).select(*keys, "date", "target", F.lit("nested_primary").alias("name"), "probability")
        named = years.select(*keys, "date", "target", F.col("candidate").alias("name"), "probability")
        prior = self.wide.select(*keys, "date", F.col("historical_prior").alias("prior"))
        return primary.unionByName(named).join(prior, [*keys, "date"])

    def uncertainty(self) -> DataFrame:
        """Paired intervals of the primary and of each candidate but the prior, for each block length."""
        judged = self.outer.where(F.col("name").isin("nested_primary", *[c for c in P.selectable if c != "historical_prior"]))
        return boot.paired_uncertainty(judged, ["symbol", "horizon", "name"], blocks=P.blocks, reps=P.nested_reps, seed=P.seed)

    def gate(self) -> DataFrame:
        """Evidence over the prior: both gains of the primary certain at every block length and horizon, no outer year worse."""
        primary = self.outer.where("name = 'nested_primary'")
        found = boot.paired_uncertainty(primary, ["symbol", "horizon"], blocks=P.blocks, reps=P.nested_reps, seed=P.seed)
        low = found.select("symbol", F.explode(F.array("accuracy_gain_low", "brier_gain_low")).alias("low"))
        miss = lambda c: F.avg((F.col(c) - F.col("target")) ** 2)
        yearly = primary.groupBy("symbol", "horizon", F.year("date").alias("year")).agg(miss("probability").alias("brier"), miss("prior").alias("prior_brier"))
        return boot.evidence_gate(low, yearly, ["symbol"])

    def frozen(self) -> DataFrame:
        """What serves the last month, for each horizon."""
        return wf.current_freeze(self.probabilities, self.selection, ["symbol", "horizon"], self.fits, names=self.names)


# ---- the study of the protocol's four features


@query("w9_blends")
def w9(spark, d):
    """The leaderboard of all candidates of the nested study, seven days ahead."""
    return r6(wf.leaderboard(Study(spark, d, P.nested_features).long.where("horizon = 7"), ["symbol"]))


@query("w13_nested_study")
def w13n(spark, d):
    """What each outer year selects among the four candidates, for both horizons."""
    return r6(Study(spark, d, P.nested_features).selection)


@query("w14_nested_study")
def w14n(spark, d):
    """Metrics of the nested predictions beside those of the prior, for both horizons."""
    return r6(sc.metrics(Study(spark, d, P.nested_features).outer, ["symbol", "horizon", "name"]))


@query("w15_frozen_artifact")
def w15a(spark, d):
    """What serves the last month: the selected candidate with all parameters, for both horizons."""
    got = Study(spark, d, P.nested_features).frozen()
    numbers = {c: F.to_json(F.transform(c, lambda x: F.round(x, 6))) for c in ("center", "scale", "coefficients")}
    regime = F.to_json(F.transform_values("regime_probabilities", lambda _, v: F.round(v, 6)))
    return r6(got.withColumns({**numbers, "regime_probabilities": regime, "feature_names": F.to_json("feature_names"), "clip": F.lit(md.CLIP), "prior_weight": F.lit(P.prior_weight)}))


@query("u2_four_feature_intervals")
def u2f(spark, d):
    return r6(Study(spark, d, P.nested_features).uncertainty())


# ---- the study of one feature, in SQL with its fit

_STEPS = 9
_ORDER = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(P.selectable))


def fitted(h: int) -> str:
    """CTEs up to np: the monthly one-feature fits by Newton's method, and all candidates' probabilities."""
    return f"""{S.folds(h)}, fe1 AS (SELECT symbol, date, close / sma - 1 AS x FROM ind WHERE sma IS NOT NULL), nx AS (SELECT r.symbol, r.date, r.label_end, r.target, x FROM rows r JOIN fe1 USING (symbol, date)),
pa AS (SELECT symbol, cutoff, count(*) AS n, sum(target) AS ups, avg(x) AS c, stddev_pop(x) AS s, max(label_end) AS train_label_end FROM nx JOIN cut ON label_end < cutoff GROUP BY 1, 2 HAVING count(*) >= 365),
tr AS (SELECT p.symbol, p.cutoff, target AS y, greatest(-8, least(8, (x - c) / s)) AS z FROM pa p JOIN nx n ON n.symbol = p.symbol AND n.label_end < p.cutoff),
it AS (SELECT symbol, cutoff, 0 AS k, ln((ups + 1) / (n - ups + 1)) AS b0, 0.0::DOUBLE AS b1 FROM pa UNION ALL
  SELECT symbol, cutoff, k + 1, b0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (
    SELECT symbol, cutoff, k, b0, b1, avg(p - y) AS g0, avg((p - y) * z) + {P.penalty} * b1 AS g1, avg(p * (1 - p)) AS h00, avg(p * (1 - p) * z) AS h01, avg(p * (1 - p) * z * z) + {P.penalty} AS h11
    FROM (SELECT i.symbol, i.cutoff, k, b0, b1, y, z, 1 / (1 + exp(-(b0 + b1 * z))) AS p FROM it i JOIN tr USING (symbol, cutoff) WHERE k < {_STEPS}) GROUP BY 1, 2, 3, 4, 5)),
fits AS (SELECT i.symbol, i.cutoff, b0, b1, c, s, n, train_label_end FROM it i JOIN pa USING (symbol, cutoff) WHERE k = {_STEPS}),
np AS (SELECT w.symbol, w.date, w.label_end, w.target, w.cutoff, prior, regime, {P.prior_weight} * prior + {1 - P.prior_weight} / (1 + exp(-(b0 + b1 * greatest(-8, least(8, (x - c) / s))))) AS shrunk FROM wide w JOIN fe1 USING (symbol, date) JOIN fits f ON f.symbol = w.symbol AND f.cutoff = w.cutoff)"""


def studied(h: int) -> str:
    """CTEs up to ot: what the outer years select, and the rows of every name in them."""
    return f"""{fitted(h)}, ca AS (SELECT symbol, date, label_end, target, prior, 'historical_prior' AS candidate, prior AS probability FROM np UNION ALL SELECT symbol, date, label_end, target, prior, 'regime_shrunk', regime FROM np UNION ALL SELECT symbol, date, label_end, target, prior, 'logistic_shrunk', shrunk FROM np UNION ALL SELECT symbol, date, label_end, target, prior, 'equal_blend', (regime + shrunk) / 2 FROM np),
yb AS (SELECT symbol, o.cutoff, candidate, year(date) AS y, avg((probability - target) ** 2) AS b, count(*) AS n FROM ca JOIN (SELECT DATE '2000-01-01' AS cutoff UNION ALL SELECT DATE '2001-01-01') o ON label_end < o.cutoff GROUP BY 1, 2, 3, 4),
mb AS (SELECT symbol, cutoff, candidate, avg(b) AS mean_annual_brier, sum(n)::BIGINT AS validation_rows FROM yb GROUP BY 1, 2, 3),
ns AS (SELECT symbol, cutoff, candidate AS selected, mean_annual_brier, validation_rows FROM (SELECT *, row_number() OVER (PARTITION BY symbol, cutoff ORDER BY mean_annual_brier, CASE candidate {_ORDER} END) AS i FROM mb) WHERE i = 1),
ot AS (SELECT c.symbol, c.date, c.target, c.prior, 'nested_primary' AS name, probability FROM ca c JOIN ns s ON s.symbol = c.symbol AND s.selected = c.candidate AND year(s.cutoff) = year(c.date) UNION ALL SELECT symbol, date, target, prior, candidate, probability FROM ca WHERE year(date) IN {P.reuse_years} UNION ALL SELECT symbol, date, target, prior, 'always_up', 1.0 FROM np WHERE year(date) IN {P.reuse_years} UNION ALL SELECT symbol, date, target, prior, 'coin_flip', 0.5 FROM np WHERE year(date) IN {P.reuse_years})"""


def both(of) -> str:
    return " UNION ALL ".join(f"SELECT {h}::BIGINT AS horizon, * FROM ({of(h)})" for h in P.horizons)


@query("w6_newton_folds", f"{fitted(7)} SELECT symbol, cutoff, n AS train_rows, train_label_end, round(c, 6) AS center, round(s, 6) AS scale, round(b0, 6) AS intercept, round(b1, 6) AS slope FROM fits")
def w6n(spark, d):
    """Monthly one-feature fits by Newton steps over all folds at once."""
    fits = Study(spark, d, ONE).fits.where("horizon = 7")
    at = lambda c, i: F.get(c, F.lit(i))
    return r6(fits.select("symbol", "cutoff", "train_rows", "train_label_end", at("center", 0).alias("center"), at("scale", 0).alias("scale"), at("coefficients", 0).alias("intercept"), at("coefficients", 1).alias("slope")))


_POOLED = f"""{S.folds(7)}, fe1 AS (SELECT symbol, date, close / sma - 1 AS x FROM ind WHERE sma IS NOT NULL), nx AS (SELECT r.date, r.label_end, r.target, x FROM rows r JOIN fe1 USING (symbol, date)), qc AS (SELECT cutoff FROM cut WHERE month(cutoff) IN (1, 4, 7, 10)),
pa AS (SELECT cutoff, count(*) AS n, sum(target) AS ups, avg(x) AS c, stddev_pop(x) AS s FROM nx JOIN qc ON label_end < cutoff AND date >= cutoff - 730 GROUP BY 1),
tr AS (SELECT p.cutoff, target AS y, greatest(-8, least(8, (x - c) / s)) AS z FROM pa p JOIN nx n ON n.label_end < p.cutoff AND n.date >= p.cutoff - 730),
it AS (SELECT cutoff, 0 AS k, ln((ups + 1) / (n - ups + 1)) AS b0, 0.0::DOUBLE AS b1 FROM pa UNION ALL
  SELECT cutoff, k + 1, b0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (
    SELECT cutoff, k, b0, b1, avg(p - y) AS g0, avg((p - y) * z) + 0.01 * b1 AS g1, avg(p * (1 - p)) AS h00, avg(p * (1 - p) * z) AS h01, avg(p * (1 - p) * z * z) + 0.01 AS h11
    FROM (SELECT i.cutoff, k, b0, b1, y, z, 1 / (1 + exp(-(b0 + b1 * z))) AS p FROM it i JOIN tr USING (cutoff) WHERE k < {_STEPS}) GROUP BY 1, 2, 3, 4))
SELECT cutoff, n AS train_rows, round(b0, 6) AS intercept, round(b1, 6) AS slope FROM it JOIN pa USING (cutoff) WHERE k = {_STEPS}"""


@query("w6_newton_pooled", _POOLED)
def w6p(spark, d):
    """Quarterly fits over all symbols together, with a window of two years."""
    rows = Study(spark, d, ONE).rows.where("horizon = 7").drop("horizon")
    fits = newton.newton_folds(rows, [], list(ONE), R._CUTS, penalty=0.01, window_days=730)
    return r6(fits.select("cutoff", "train_rows", F.get("coefficients", F.lit(0)).alias("intercept"), F.get("coefficients", F.lit(1)).alias("slope")))


@query("w9_one_feature_board", f"""{studied(7)}, yy AS (SELECT symbol, candidate, year(date) AS y, avg(CAST((probability >= 0.5) = (target = 1) AS INT)) AS a, sum(CAST((probability >= 0.5) = (target = 1) AS INT)) AS r, count(*) AS n, sum((probability - target) ** 2) AS l FROM (SELECT symbol, date, target, candidate, probability FROM ca UNION ALL SELECT symbol, date, target, 'always_up', 1.0 FROM np UNION ALL SELECT symbol, date, target, 'coin_flip', 0.5 FROM np) GROUP BY 1, 2, 3), bo AS (SELECT symbol, candidate, sum(n)::BIGINT AS total, sum(r) / sum(n) AS accuracy, avg(a) AS mean_year_accuracy, min(a) AS worst_year_accuracy, sum(l) / sum(n) AS brier FROM yy GROUP BY 1, 2)
SELECT {sel('symbol candidate total *accuracy *mean_year_accuracy *worst_year_accuracy *brier')}, row_number() OVER (PARTITION BY symbol ORDER BY mean_year_accuracy DESC, worst_year_accuracy DESC, brier, candidate) AS place FROM bo""")
def w9o(spark, d):
    return r6(wf.leaderboard(Study(spark, d, ONE).long.where("horizon = 7"), ["symbol"]))


@query("w13_one_feature_study", both(lambda h: f"{studied(h)} SELECT {sel('symbol cutoff selected *mean_annual_brier validation_rows')} FROM ns"))
def w13o(spark, d):
    """What each outer year selects, with fits that SQL follows."""
    return r6(Study(spark, d, ONE).selection)


@query("w14_one_feature_study", both(lambda h: f"{studied(h)} SELECT symbol, name, {S.METRICS} FROM ot GROUP BY 1, 2"))
def w14o(spark, d):
    return r6(sc.metrics(Study(spark, d, ONE).outer, ["symbol", "horizon", "name"]))


@query("w15_one_feature_artifact", both(lambda h: f"{studied(h)}, la AS (SELECT symbol, max_by(selected, cutoff) AS selected, max(cutoff) AS selection_date FROM ns GROUP BY 1) SELECT symbol, cutoff AS refit_date, CAST(cutoff + INTERVAL 1 MONTH AS DATE) AS valid_until, selected, selection_date, CAST(train_rows AS BIGINT) AS train_rows, f.train_label_end, round(prior, 6) AS probability, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2, round(c, 6) AS center, round(s, 6) AS scale, round(b0, 6) AS intercept, round(b1, 6) AS slope, 'ma200' AS feature FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY cutoff DESC) AS i FROM prob2) JOIN la USING (symbol) JOIN fits f USING (symbol, cutoff) WHERE i = 1"))
def w15o(spark, d):
    got = Study(spark, d, ONE).frozen()
    at = lambda c, i, name: F.get(c, F.lit(i)).alias(name)
    regime = [F.element_at("regime_probabilities", F.lit(i)).alias(f"p{i}") for i in (0, 1, 2)]
    numbers = [at("center", 0, "center"), at("scale", 0, "scale"), at("coefficients", 0, "intercept"), at("coefficients", 1, "slope"), at("feature_names", 0, "feature")]
    return r6(got.select("symbol", "horizon", "refit_date", "valid_until", "selected", "selection_date", "train_rows", "train_label_end", "probability", *regime, *numbers))


_JUDGED = both(lambda h: f"{studied(h)} SELECT symbol, name, date, year(date) AS y, CAST((probability >= 0.5) = (target = 1) AS INT) AS good, CAST((probability >= 0.5) = (target = 1) AS INT) - CAST((prior >= 0.5) = (target = 1) AS INT) AS more, (prior - target) ** 2 - (probability - target) ** 2 AS gain FROM ot WHERE name NOT IN ('historical_prior', 'always_up', 'coin_flip')")
_BOUNDS = f"""WITH v AS ({_JUDGED}),{S.bootstrap('v', 'symbol, horizon, name', 'avg(good) AS accuracy, avg(more) AS accuracy_gain, avg(gain) AS brier_gain', P.blocks, P.nested_reps, P.seed)},
iv AS (SELECT symbol, horizon, name, b AS block, count(*) AS reps, {', '.join(f"quantile_cont({v}, {q}) AS {v}_{end}" for v in ('accuracy', 'accuracy_gain', 'brier_gain') for end, q in (('low', 0.025), ('high', 0.975)))} FROM resamples GROUP BY 1, 2, 3, 4)"""


@query("u2_nested_intervals", f"{_BOUNDS} SELECT {sel('symbol horizon name #block reps *accuracy_low *accuracy_high *accuracy_gain_low *accuracy_gain_high *brier_gain_low *brier_gain_high')} FROM iv")
def u2n(spark, d):
    """Intervals of the one-feature study's primary and of each candidate but the prior."""
    return r6(Study(spark, d, ONE).uncertainty())


_GATE = f"{_BOUNDS} SELECT symbol, certain, no_year_worse, certain AND no_year_worse AS evidence FROM (SELECT symbol, bool_and(accuracy_gain_low > 0 AND brier_gain_low > 0) AS certain FROM iv WHERE name = 'nested_primary' GROUP BY 1) JOIN (SELECT symbol, bool_and(g >= 0) AS no_year_worse FROM (SELECT symbol, horizon, y, avg(gain) AS g FROM v WHERE name = 'nested_primary' GROUP BY 1, 2, 3) GROUP BY 1) USING (symbol)"


@query("u4_nested_evidence", _GATE)
def u4n(spark, d):
    """The gate on the nested primary of the one-feature study, 2,000 repetitions."""
    return Study(spark, d, ONE).gate()


@query("u4_four_feature_evidence")
def u4f(spark, d):
    """The gate on the nested primary of the protocol's four features."""
    return Study(spark, d, P.nested_features).gate()


@query("c8_nested_envelope", f"{_BOUNDS} SELECT symbol, horizon, name, round(min(brier_gain_low), 6) AS low, round(max(brier_gain_high), 6) AS high FROM iv GROUP BY 1, 2, 3")
def c8n(spark, d):
    found = Study(spark, d, ONE).uncertainty().select("symbol", "horizon", "name", "block", F.col("brier_gain_low").alias("low"), F.col("brier_gain_high").alias("high"))
    return r6(sc.ci_envelope(found, ["symbol", "horizon", "name"]))


# ---- leakage over the whole study


@query("v5_study_leakage", f"""{S.BASE} SELECT symbol, 'features' AS part, max(date) AS date, 'peek' AS what FROM bars WHERE date <= DATE '2001-03-31' AND symbol IN (SELECT symbol FROM ind WHERE sma IS NOT NULL) GROUP BY symbol""")
def v5s(spark, d):
    """Prices after a day are tripled: features, fits, predictions and selections up to it must be the same; only a planted feature that looks a bar ahead is not."""
    cut, horizon = date(2001, 3, 31), 7
    b = checkpointed(R.index_bars(spark, d))
    later = b.withColumns({c: F.when(F.col("date") > F.lit(cut), F.col(c) * 3).otherwise(F.col(c)) for c in ("open", "high", "low", "close")})

    def parts(bars: DataFrame) -> dict[str, DataFrame]:
        fe = ft.all_features(bars).withColumn("peek", F.lead("close").over(by_symbol()))
        rows = checkpointed(nested_rows(bars, horizon, ONE))
        fits = checkpointed(nested_fits(rows, ONE))
        wide = checkpointed(nested_wide(spark, rows, fits, horizon, ONE))
        chosen = wf.select_from_past(wf.long_candidates(wide, ["symbol"], list(P.selectable)), R.outer(spark), ["symbol"], list(P.selectable))
        probabilities = ["historical_prior", "regime_shrunk", "logistic_shrunk", "equal_blend"]
        fitted_ = fits.select("symbol", F.col("cutoff").alias("date"), "train_rows", *[F.get(c, F.lit(i)).alias(f"{c}_{i}") for c, n in (("center", 1), ("scale", 1), ("coefficients", 2)) for i in range(n)])
        return {"features": fe.drop("open", "close"), "fits": fitted_, "predictions": wide.select("symbol", "date", *probabilities), "selections": chosen.withColumnRenamed("cutoff", "date")}

    return sv.study_leaks(parts(b), parts(later), ["symbol", "date"], cut)


# ---- the search's selected candidate on the reused years


def selected_of_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reuse-year rows of the candidate that leads the development board, with the prior's probability."""
    found = R._search(spark, sf_dir)
    lead = wf.leaderboard(found.where("phase = 'development'"), ["symbol"]).where("place = 1").select("symbol", "candidate")
    reused = found.where("phase = 'reuse'")
    prior = reused.where("candidate = 'historical_prior'").select("symbol", "date", F.col("probability").alias("prior"))
    return reused.join(lead, ["symbol", "candidate"]).join(prior, ["symbol", "date"], "left")


def search_goal(rows: DataFrame) -> DataFrame:
    """Whether the selected candidate's accuracy is above the goal at full coverage, in each reused year, and at each interval's lower bound."""
    known = rows.withColumn("good", (sc.classify("probability") == F.col("target")).cast("double"))
    overall = known.groupBy("symbol").agg(F.avg("good").alias("accuracy"), F.avg(F.col("probability").isNotNull().cast("double")).alias("coverage"))
    yearly = known.groupBy("symbol", F.year("date").alias("year")).agg(F.avg("good").alias("accuracy"))
    bounds = boot.mean_intervals(known, ["symbol"], "good", blocks=P.blocks, reps=P.reps, seed=P.seed)
    return boot.primary_goal(overall, yearly, bounds, ["symbol"]).join(overall, ["symbol"])


@query("u5_search_goal")
def u5s(spark, d):
    """The goal for the candidate that the search of all 40 selects, thirty days ahead."""
    return r6(search_goal(selected_of_search(spark, d)))


_COUNTED = """always_up historical_prior regime_expanding regime_730d""".split()
_ANNUAL = f"""{R._ROWS30.replace('SELECT symbol, date, label_end FROM k30', "SELECT symbol, date, label_end, CAST(fr > 0 AS INT) AS target, CASE WHEN ma200 IS NOT NULL AND return_63 IS NOT NULL THEN CAST(ma200 > 0 AS INT) + CAST(return_63 > 0 AS INT) END AS score FROM k30")},
yc AS (SELECT make_date(y, 1, 1) AS cutoff, w FROM (SELECT unnest([1998, 1999, 2000, 2001]) AS y), (SELECT unnest([100000, 730]) AS w)),
ct AS (SELECT symbol, cutoff, w, count(*) AS n, sum(target) AS ups, {', '.join(f"count(*) FILTER (WHERE score = {k}) AS n{k}, count(*) FILTER (WHERE score = {k} AND target = 1) AS ups{k}" for k in (0, 1, 2))} FROM sr JOIN yc ON label_end < cutoff AND date >= cutoff - w GROUP BY 1, 2, 3 HAVING count(*) >= 200),
pw AS (SELECT r.symbol, r.date, r.label_end, r.target, w, (ups + 1) / (n + 2) AS prior, CASE score WHEN 0 THEN (ups0 + 1) / (n0 + 2) WHEN 1 THEN (ups1 + 1) / (n1 + 2) ELSE (ups2 + 1) / (n2 + 2) END AS regime FROM sr r JOIN ct ON ct.symbol = r.symbol AND year(cutoff) = year(r.date)),
sp AS (SELECT symbol, date, label_end, target, 'always_up' AS candidate, 1.0::DOUBLE AS probability FROM pw WHERE w > 730 UNION ALL SELECT symbol, date, label_end, target, 'historical_prior', prior FROM pw WHERE w > 730 UNION ALL SELECT symbol, date, label_end, target, CASE w WHEN 730 THEN 'regime_730d' ELSE 'regime_expanding' END, regime FROM pw),
ph AS (SELECT *, CASE WHEN year(date) IN (1998, 1999) AND label_end < DATE '2000-01-01' THEN 'development' WHEN date >= DATE '2000-01-01' THEN 'reuse' END AS phase, CAST((probability >= 0.5) = (target = 1) AS INT) AS good FROM sp),
yy AS (SELECT symbol, candidate, year(date) AS y, avg(good) AS a, count(*) AS n, sum((probability - target) ** 2) AS l FROM ph WHERE phase = 'development' GROUP BY 1, 2, 3), bo AS (SELECT symbol, candidate, avg(a) AS ma, min(a) AS wa, sum(l) / sum(n) AS brier FROM yy GROUP BY 1, 2),
ld AS (SELECT symbol, candidate FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ma DESC, wa DESC, brier, candidate) AS k FROM bo) WHERE k = 1),
v AS (SELECT p.symbol, p.date, p.target, p.probability, p.good, year(p.date) AS y FROM ph p JOIN ld USING (symbol, candidate) WHERE phase = 'reuse')"""


@query("u5_search_goal_of_counts", f"""{_ANNUAL},{S.bootstrap('v', 'symbol', 'avg(good) AS good', P.blocks, P.reps, P.seed)}, iv AS (SELECT symbol, b, quantile_cont(good, 0.025) AS low FROM resamples GROUP BY 1, 2)
SELECT symbol, achieved, every_year, every_bound, accuracy, coverage FROM (SELECT symbol, avg(good) > 0.9 AS achieved, round(avg(good), 6) AS accuracy, 1.0::DOUBLE AS coverage FROM v GROUP BY 1) JOIN (SELECT symbol, bool_and(a > 0.9) AS every_year FROM (SELECT symbol, y, avg(good) AS a FROM v GROUP BY 1, 2) GROUP BY 1) USING (symbol) JOIN (SELECT symbol, bool_and(low > 0.9) AS every_bound FROM iv GROUP BY 1) USING (symbol)""")
def u5c(spark, d):
    """The same where only the candidates that are counts stand for election, which SQL can follow."""
    found = R._search(spark, d).where(F.col("candidate").isin(*_COUNTED))
    lead = wf.leaderboard(found.where("phase = 'development'"), ["symbol"]).where("place = 1").select("symbol", "candidate")
    return r6(search_goal(found.where("phase = 'reuse'").join(lead, ["symbol", "candidate"])))


# ---- two model versions on equal dates and targets


@query("l7_two_versions", f"""WITH a AS (SELECT symbol, date, target, probability FROM ({R._SCOREDH(30)} SELECT symbol, date, target, probability FROM sco)), b AS (SELECT symbol, date, target, probability FROM ({_ANNUAL} SELECT symbol, date, target, probability FROM ph WHERE phase = 'reuse' AND candidate = 'regime_expanding'))
SELECT symbol, count(*) AS n, round(avg(CAST((a.probability >= 0.5) = (a.target = 1) AS INT)), 6) AS accuracy, round(avg(CAST((b.probability >= 0.5) = (b.target = 1) AS INT)), 6) AS other_accuracy, round(avg((b.probability - b.target) ** 2 - (a.probability - a.target) ** 2), 6) AS brier_gain, round(avg(abs(a.probability - b.probability)), 6) AS mean_distance FROM a JOIN b USING (symbol, date) GROUP BY 1""")
def l7v(spark, d):
    """The frozen calibration and the search's expanding regimes, thirty days ahead: equal dates and targets are asserted, then they are compared."""
    first = R._scored(spark, d, P.search_horizon).select("symbol", "date", "target", "probability")
    second = R._search(spark, d).where("phase = 'reuse' AND candidate = 'regime_expanding'").select("symbol", "date", "target", "probability")
    both = checkpointed(lb.paired_versions(first, second, ["symbol", "date"]))
    right = lambda c: F.avg((sc.classify(c) == F.col("target")).cast("double"))
    miss = lambda c: (F.col(c) - F.col("target")) ** 2
    return r6(both.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), right("probability").alias("accuracy"), right("other").alias("other_accuracy"), F.avg(miss("other") - miss("probability")).alias("brier_gain"), F.avg(F.abs(F.col("probability") - F.col("other"))).alias("mean_distance")))
