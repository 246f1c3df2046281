"""Quality rules: base statistics of a text and a robust multivariate outlier verdict, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, stored, table

SYMBOLS, BLANKS = "#*$%&|<>", "\t\n\x0b\x0c\r "
PRIOR_ROWS = 50.0  # rows that a language counts as in the estimate of its sources: ten for each statistic
KEPT_SHARE = 0.75  # of a group's rows that the estimate rests on
SCALE = 1.41  # 0.75 over the chi-square(7) distribution at the 0.75 quantile of chi-square(5): makes the covariance consistent
CUTOFF = 12.83  # the 0.975 quantile of chi-square(5), usual for this estimate: of a normal group one row in 40 lies beyond
FEATURES = ["length", "word_length", "symbols", "dup_lines", "repeats"]
FLOORS = [0.5, 0.08, 0.08, 0.5, 0.15]  # least standard deviation of each: a statistic that is nearly always 0 stays usable


def text_statistics(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """id, `keep`, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, in one pass over the texts.

    The 8-word windows are hashed; only where a hash comes twice are they sorted to find which words they
    cover. Sorting and scanning are n log n in the words of one text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)], text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    d = d.select(
        "id", *[f"k_{i}" for i in range(len(keep))],
        F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "").alias("w"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    n = F.size("w")
    d = d.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    d = d.withColumn("n_words", n.cast("long")).withColumn("h", F.when(n > 8, F.transform(F.sequence(F.lit(1), n - 7), lambda i: F.xxhash64(F.slice(F.col("w"), i, F.lit(8)))))).drop("w")
    twice = F.size(F.array_distinct("h")) < F.size("h")
    d = d.withColumn("s", F.when(twice, F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop("h")
    d = d.withColumn("s", F.zip_with(F.zip_with("s", F.slice("s", F.lit(2), F.greatest(F.size("s"), F.lit(1))), lambda x, y: F.struct(x["i"].alias("i"), x["h"].alias("h"), F.coalesce(x["h"] == y["h"], F.lit(False)).alias("as_next"))),
                                     F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.col("s")), lambda x, y: F.struct(x["i"].alias("i"), (x["as_next"] | F.coalesce(x["h"] == y["h"], F.lit(False))).alias("again"))))
    at = F.array_sort(F.transform(F.filter("s", lambda x: F.coalesce(x["again"], F.lit(False)) & x["i"].isNotNull()), lambda x: x["i"]))
    start = F.struct(F.lit(-8).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(at, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(8), i - a["last"])).alias("n")), lambda a: a["n"])
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("s")
    return d.select(F.col("id").alias(id_col), *[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _features() -> list[Column]:
    return [
        F.log1p("n_words").alias("length"),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))).alias("word_length"),
        F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))).alias("symbols"),
        F.log1p("n_dup_lines").alias("dup_lines"),
        F.sqrt(F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1))).alias("repeats"),
    ]


N = range(len(FEATURES))
LOWER = [(i, j) for i in N for j in range(i + 1)]
MOMENTS = {f"e_{i}": f for i, f in enumerate(FEATURES)} | {f"e_{i}_{j}": f"{FEATURES[i]} * {FEATURES[j]}" for i, j in LOWER}
MEANS = [f"m_{i}" for i in N]


def _with_distance(rows: DataFrame, estimates: DataFrame, groups: int) -> DataFrame:
    """Rows with d2, the squared Mahalanobis distance by forward substitution with the factor's columns l_i_j and means m_i."""
    y = [f"({f} - m_{i}{''.join(f' - l_{i}_{j} * y_{j}' for j in range(i))}) / l_{i}_{i} AS y_{i}" for i, f in enumerate(FEATURES)]
    near = rows.join(bounded_broadcast(estimates, groups, 20_000), "key")
    return near.selectExpr(*[f"`{c}`" for c in rows.columns], *y, " + ".join(f"y_{i} * y_{i}" for i in N) + " AS d2").drop(*[f"y_{i}" for i in N])


def _factor(moments: DataFrame, scale: float) -> DataFrame:
    """key, means and the Cholesky factor of the covariance, floors added, from mean features e_i and mean products e_i_j."""
    out = []
    for j in N:  # column by column: each refers to those before it
        for i in range(j, len(FEATURES)):
            c = f"{scale} * (e_{i}_{j} - e_{i} * e_{j})"
            c = f"greatest({c}, 0D) + {FLOORS[i] ** 2}D" if i == j else c
            c += "".join(f" - l_{i}_{k} * l_{j}_{k}" for k in range(j))
            out.append(f"sqrt(greatest({c}, 1e-9D)) AS l_{i}_{j}" if i == j else f"({c}) / l_{j}_{j} AS l_{i}_{j}")
    return moments.selectExpr("key", *[f"e_{i} AS m_{i}" for i in N], *out)


def _shrunk(own: DataFrame, lang: DataFrame, all_: DataFrame, names: list[str], prior: float) -> DataFrame:
    """key and `names` of each group, drawn towards its language's, which are drawn towards those of all.

    The upper level's value counts as `prior` rows. `own` has parent, key, n; `lang` parent, n; `all_` n, one row.
    """
    up = lang.selectExpr("parent", "n AS n1", *[f"{c} AS p_{c}" for c in names]).crossJoin(F.broadcast(all_.selectExpr(*[f"{c} AS a_{c}" for c in names])))
    mixed = lambda n, low, high: f"coalesce(({n} * {low} + {prior} * {high}) / ({n} + {prior}), {high})"
    up = up.selectExpr("parent", *[f"{mixed('n1', f'p_{c}', f'a_{c}')} AS u_{c}" for c in names])
    return own.join(up, "parent").selectExpr("key", *[f"{mixed('n', c, f'u_{c}')} AS {c}" for c in names])


def _quantiles(rows: DataFrame, values: dict[str, str], at: float, prior: float) -> DataFrame:
    """Quantile `at` of each expression for each group, language and all in one rollup, then `_shrunk`."""
    r = stored(rows.rollup("parent", "key").agg(F.count("*").alias("n"), F.grouping_id().alias("level"), *[F.expr(f"percentile_approx({c}, {at}D, 1000) AS {name}") for name, c in values.items()]))
    return _shrunk(r.where("level = 0"), r.where("level = 1"), r.where("level = 3"), list(values), prior)


def _moments(rows: DataFrame, keys: DataFrame, prior: float) -> DataFrame:
    """Mean features e_i and mean products e_i_j of each group, shrunk; a group that lost all its rows takes its language's."""
    sums = rows.groupBy("key").agg(F.count("*").alias("n"), *[F.expr(f"sum({c}) AS {t}") for t, c in MOMENTS.items()])
    sums = stored(keys.join(sums, "key", "left").selectExpr("parent", "key", "coalesce(n, 0L) AS n", *MOMENTS))
    mean = [F.expr(f"sum({t}) / sum(n) AS {t}") for t in MOMENTS]
    own = sums.selectExpr("parent", "key", "n", *[f"{t} / n AS {t}" for t in MOMENTS])
    return _shrunk(own, sums.groupBy("parent").agg(F.sum("n").alias("n"), *mean), sums.agg(*mean), list(MOMENTS), prior)


def _starts(rows: DataFrame, keys: DataFrame, groups: int, prior: float) -> list[DataFrame]:
    """Two first estimates about the medians: the deviations alone, and with the correlations of tanh of what they scale."""
    mid = _quantiles(rows, {f"m_{i}": f for i, f in enumerate(FEATURES)}, 0.5, prior)
    off = _quantiles(rows.join(bounded_broadcast(mid, groups, 20_000), "key"), {f"d_{i}": f"abs({f} - m_{i})" for i, f in enumerate(FEATURES)}, 0.5, prior)
    base = stored(mid.join(off, "key").selectExpr("key", *MEANS, *[f"sqrt(pow(1.4826D * d_{i}, 2) + {FLOORS[i] ** 2}D) AS d_{i}" for i in N]))
    plain = base.selectExpr("key", *MEANS, *[f"d_{i} AS l_{i}_{j}" if i == j else f"0D AS l_{i}_{j}" for i, j in LOWER])
    bent = rows.join(bounded_broadcast(base, groups, 20_000), "key").selectExpr("key", *[f"tanh(({f} - m_{i}) / d_{i}) AS {f}" for i, f in enumerate(FEATURES)])
    spread = [f"greatest(e_{i}_{i} - e_{i} * e_{i}, 1e-9D) AS v_{i}" for i in N]
    cov = [f"d_{i} * d_{j} * " + ("1D" if i == j else f"(e_{i}_{j} - e_{i} * e_{j}) / sqrt(v_{i} * v_{j})") + f" + m_{i} * m_{j} AS c_{i}_{j}" for i, j in LOWER]
    e = _moments(bent, keys, prior).join(base, "key").selectExpr("key", *MEANS, *spread, *cov)
    return [plain, stored(_factor(e.selectExpr("key", *[f"m_{i} AS e_{i}" for i in N], *[f"c_{i}_{j} AS e_{i}_{j}" for i, j in LOWER]), 1.0))]


def robust_estimates(rows: DataFrame, steps: int = 3, prior: float = PRIOR_ROWS, cutoff: float = CUTOFF) -> DataFrame:
    """Minimum-covariance-determinant estimate of each key of rows (parent, key, features), drawn towards its parent's.

    From each of two starts, concentration steps take the KEPT_SHARE of a group's rows that are nearest under
    the present estimate and compute mean and covariance of these; of a group's two ends the one of the lesser
    determinant is taken, and a last step weighs out what lies beyond `cutoff`. Each moment and each quantile
    is mixed with the language's, counted as `prior` rows, and that with the one of all rows: a group of a few
    rows is judged nearly as its language, one of thousands by itself, with no size at which this changes. All
    are grouped sums and quantile sketches (a thousandth of the rows): a group of any size is pre-aggregated.
    """
    keys = stored(rows.select("parent", "key").distinct())
    groups = keys.count()  # rows of a hot group stay where they are while groups are few; only sketches and sums move
    factor = [*MEANS, *[f"l_{i}_{j}" for i, j in LOWER]]
    ends = []
    for start, now in enumerate(_starts(rows, keys, groups, prior)):
        for _ in range(steps):
            near = _with_distance(rows, now, groups)
            edge = _quantiles(near, {"edge": "d2"}, KEPT_SHARE, prior)
            now = stored(_factor(_moments(near.join(bounded_broadcast(edge, groups, 20_000), "key").where("d2 <= edge"), keys, prior), SCALE))
        det = " + ".join(f"ln(l_{i}_{i})" for i in N)
        ends.append(now.selectExpr("key", f"struct(round({det}, 9) AS det, {start} AS start, {', '.join(factor)}) AS e"))
    best = stored(reduce(DataFrame.unionByName, ends).groupBy("key").agg(F.min("e").alias("e")).selectExpr("key", *[f"e.{c}" for c in factor]))
    return stored(_factor(_moments(_with_distance(rows, best, groups).where(F.col("d2") <= cutoff), keys, prior), 1.0))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", prior: float = PRIOR_ROWS, cutoff: float = CUTOFF) -> DataFrame:
    """id, the base statistics, base_failed, kept and distance of every row.

    Estimates are made for each language and source from the rows that pass the base rules, drawn towards the
    language's and these towards all rows', which count as `prior` rows; a null language or source is one of
    its own. A row is kept if it passes the base rules and its squared distance is within `cutoff`; a row that
    fails them has no distance. A null text has no words and fails. Repeated rows stay and count; other columns
    are not carried; an empty table gives an empty one.
    """
    s = text_statistics(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source")), "id", "text", ["lang", "source"])
    named = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    s = stored(s.withColumn("base_failed", base_failed()).select("*", *_features(), named("lang").alias("parent"), named("lang", "source").alias("key")).drop("lang", "source"))
    rows = s.where("NOT base_failed")
    est = robust_estimates(rows, prior=prior, cutoff=cutoff)
    judged = _with_distance(rows, est, est.count()).withColumn("distance", F.sqrt("d2"))
    both = judged.unionByName(s.where("base_failed"), allowMissingColumns=True)
    out = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return both.select(F.col("id").alias(id_col), *out, (~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff**0.5, F.lit(False))).alias("kept"), "distance")


def op6_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"))


QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLE_SQL = {}
