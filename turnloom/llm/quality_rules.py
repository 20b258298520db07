"""Quality rules: counts of each text, and robust multivariate outliers among their transformed values.

``counts`` adds the counts, ``judge`` adds a verdict. Documents are compared within their language and
source by a minimum-covariance-determinant estimate (centre and covariance of the tightest part of the
group), and rejected by their Mahalanobis distance from it. Column expressions and joins only.

An estimate takes a fixed number of concentration steps from two starts. A step sends each document to a
bin of its distance and adds up moments by group and bin, combined in the tasks before the shuffle, so a
group may hold any share of the rows; the nearest bins that together hold ``share`` of the group make the
next estimate. Whichever start ends with the smaller determinant is taken, and reweighted once.

Every group is estimated, however small: its centre and covariance are those of its own rows together with
``prior`` rows of its language, whose estimate is shrunk towards that of all rows in the same way, so no verdict
switches at a size. Null languages and
sources are groups of their own. A null text has no words and fails the plain rules. Rows are judged one
by one, so repeated rows get the same verdict; an empty table gives an empty table. Columns named like an
output are replaced, all others pass through.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from turnloom.llm.rows import Carried
from turnloom.llm.storage import stored

SPACES = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
LOUD = "ABCDEFGHIJKLMNOPQRSTUVWXYZ!"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_loud", "n_dup_lines", "n_repeat_words"]
WINDOW = 8
# Values are damped as if so many words and characters of average text were added to each.
DAMP_WORDS, DAMP_CHARS = 50, 250
# What the counts of the shortest text that passes the plain rules scatter by chance alone, whatever the spread of a
# group; added to its variances. A count scatters by its root, so its root by a half and its logarithm by
# one over its root; the mean length of words by their own relative spread (0.55) over the root of their number;
# one repeated window more or less, half of the time, is half a window of words.
SHORTEST = 20
_WORDS, _CHARS = SHORTEST + DAMP_WORDS, 5 * SHORTEST + DAMP_CHARS
FLOORS = [SHORTEST ** -0.5, 0.55 * _WORDS ** -0.5, 0.5 * _CHARS ** -0.5, 0.5 * _CHARS ** -0.5, 0.5 * _WORDS ** -0.5, 0.5 * WINDOW / _WORDS]
DIMENSIONS = len(FLOORS)
_P = range(DIMENSIONS)
_BINS_PER_OCTAVE = 8
SENT = 20_000
SALTS = 64


def _without(text: Column, letters: str) -> Column:
    return F.length(F.translate(text, letters, ""))


def _joined(hashes: Column, step: int, size: Column) -> Column:
    """Hashes of runs twice as long: each with the one ``step`` places on."""
    n = F.greatest(size - step, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, 1 + step, n), lambda a, b: F.xxhash64(a, b))


def counts(df: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_loud``, ``n_dup_lines``, ``n_repeat_words``.

    Words are runs without spaces. ``n_repeat_words`` counts the words that lie in a window of eight words
    found twice or more in the text; windows are compared by 64-bit hashes.
    """
    own = Carried(df, [*COUNTS, *([] if keep_text else [text])])
    return _counted(df.select(own.packed(), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_t"))).select(
        *own.columns(), *COUNTS)


def _counted(df: DataFrame) -> DataFrame:
    """The counts of ``_t`` beside ``row``."""
    lines = F.filter(F.split("_t", "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    df = df.select(
        "row", _without(F.col("_t"), SPACES).cast("long").alias("word_chars"),
        (F.length("_t") - _without(F.col("_t"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.length("_t") - _without(F.col("_t"), LOUD)).cast("long").alias("n_loud"),
        F.array_remove(F.split("_t", GAP), "").alias("_w"), lines.alias("_l"))
    df = df.select(
        "row", "word_chars", "n_symbols", "n_loud", F.size("_w").alias("_n"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    size, step = F.col("_n"), 1
    while step < WINDOW:
        df = df.withColumn("_h", _joined(F.col("_h"), step, size))
        size, step = F.greatest(size - step, F.lit(0)), 2 * step
    found = F.size(F.array_distinct("_h")) < F.size("_h")
    df = df.withColumn("_s", F.when(found, F.sort_array(F.transform(
        "_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_h")
    repeated = F.filter("_s", lambda e, i: (e["h"] == F.get("_s", i - 1)["h"]) | (e["h"] == F.get("_s", i + 1)["h"]))
    df = df.withColumn("_p", F.sort_array(F.transform(repeated, lambda e: e["i"]))).drop("_s")
    reach = F.transform("_p", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", i + 1) - p, F.lit(WINDOW))))
    covered = F.coalesce(F.aggregate(reach, F.lit(0), lambda a, b: a + b), F.lit(0))
    return df.select("row", F.col("_n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_loud",
                     "n_dup_lines", covered.cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    """The plain rules: too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < SHORTEST) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def values() -> list[Column]:
    """The counts as values that do not scatter more in short texts than in long ones.

    Shares are taken over the text and a fixed number of average words, so a short text cannot stray far.
    """
    words, chars = F.col("n_words") + DAMP_WORDS, F.col("word_chars") + DAMP_CHARS
    return [
        F.log1p(F.col("n_words").cast("double")), F.log(chars / words),
        F.sqrt(F.col("n_symbols") / chars), F.sqrt((F.col("n_loud") + 5) / chars),
        F.sqrt(F.col("n_dup_lines") / words), F.col("n_repeat_words") / words]


def chi_square(p: float, dimensions: int = DIMENSIONS) -> float:
    """Quantile of the chi-square distribution (Wilson and Hilferty's approximation)."""
    spread = 2 / (9 * dimensions)
    return dimensions * (1 - spread + NormalDist().inv_cdf(p) * spread ** 0.5) ** 3


# One SQL string an expression: building these column by column costs more than running them on small tables.
def _moments() -> list[Column]:
    sums = ["count(*) AS n", *(f"sum(x{i}) AS s{i}" for i in _P), *(f"sum(x{i} * x{j}) AS s{i}_{j}" for i in _P for j in range(i + 1))]
    return [F.expr(e) for e in sums]


def _added(names: list[str]) -> list[Column]:
    return [F.expr(f"sum({c}) AS {c}") for c in names]


_SUMS = ["n", *(f"s{i}" for i in _P), *(f"s{i}_{j}" for i in _P for j in range(i + 1))]
_ESTIMATE = [*(f"m{i}" for i in _P), *(f"l{i}_{j}" for i in _P for j in range(i + 1))]


def _factored(df: DataFrame, keys: list[str]) -> DataFrame:
    """Centre and Cholesky factor of the covariance from moments; variances get the floors."""
    return _cholesky(df.selectExpr(
        *keys, *(f"s{i} / n AS m{i}" for i in _P),
        *(f"s{i}_{j} / n - s{i} * s{j} / n / n + {FLOORS[i] ** 2 if i == j else 0.0!r}D AS c{i}_{j}" for i in _P for j in range(i + 1))), keys)


def _cholesky(df: DataFrame, keys: list[str]) -> DataFrame:
    """Centre and Cholesky factor from centre and covariance."""
    steps = []
    for j in _P:
        for i in range(j, DIMENSIONS):
            rest = " - ".join([f"c{i}_{j}", *(f"l{i}_{k} * l{j}_{k}" for k in range(j))])
            # Rounding may leave a variance below its floor.
            steps.append(f"sqrt(greatest({rest}, {FLOORS[j] ** 2!r}D)) AS l{i}_{j}" if i == j else f"({rest}) / l{j}_{j} AS l{i}_{j}")
    return df.selectExpr("*", *steps).select(*keys, *_ESTIMATE)


def _with_distance(df: DataFrame) -> DataFrame:
    """``d2``, the squared Mahalanobis distance of ``x0…`` from the estimate beside them."""
    steps = [f"({' - '.join([f'x{i} - m{i}', *(f'l{i}_{k} * z{k}' for k in range(i))])}) / l{i}_{i} AS z{i}" for i in _P]
    steps.append(f"{' + '.join(f'z{i} * z{i}' for i in _P)} AS d2")
    return df.selectExpr("*", *steps).drop(*(f"z{i}" for i in _P))


def _beside(x: DataFrame, estimates: DataFrame, rows: int) -> DataFrame:
    """Rows with the estimate of their group; ``estimates`` is stored and has ``rows`` rows.

    It is sent to the tasks as long as it has at most ``SENT`` of them (some 300 bytes each). Otherwise rows of a group
    are dealt over ``SALTS`` keys, as one group may have any share of them.
    """
    if rows <= SENT:
        return x.join(F.broadcast(estimates), "_g")
    salted = x.withColumn("_salt", F.pmod(F.xxhash64(*(f"x{i}" for i in _P)), F.lit(SALTS)).cast("int"))
    every = estimates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(every, ["_g", "_salt"]).drop("_salt")


def _binned(x: DataFrame, estimates: DataFrame, rows: int, keys: list[str]) -> DataFrame:
    """Moments by group and bin of distance."""
    near = F.floor(_BINS_PER_OCTAVE * F.log2(F.col("d2") + 1e-3)).cast("int")
    return (_with_distance(_beside(x, estimates, rows)).withColumn("bin", near)
            .groupBy(*keys, "bin").agg(*_moments()))


def _edge(bin_: Column) -> Column:
    return F.pow(F.lit(2.0), (bin_ + 1) / _BINS_PER_OCTAVE)


def estimates(x: DataFrame, share: float = 0.75, steps: int = 4) -> DataFrame:
    """Centre, Cholesky factor and distance scale of each group ``_g`` of ``x0…``; ``x`` is read by every step."""
    middle = x.groupBy("_g").agg(*(F.expr(f"percentile_approx(x{i}, array(0.25D, 0.5D, 0.75D), 1000) AS q{i}") for i in _P))
    robust = middle.selectExpr(
        "_g", "0 AS start", *(f"q{i}[1] AS m{i}" for i in _P),
        *(f"sqrt(pow(0.7413D * (q{i}[2] - q{i}[0]), 2) + {FLOORS[i] ** 2!r}D) AS l{i}_{j}" if i == j else f"0.0D AS l{i}_{j}"
          for i in _P for j in range(i + 1)))
    plain = _factored(x.groupBy("_g").agg(*_moments()), ["_g"]).withColumn("start", F.lit(1))
    now = stored(robust.unionByName(plain), "rules-start")
    rows = now.count()
    keys = ["_g", "start"]
    upto = W.partitionBy(*keys).orderBy("bin")
    for _ in range(steps):
        bins = (_binned(x, now, rows, keys)
                .withColumn("before", F.sum("n").over(upto) - F.col("n"))
                .withColumn("all", F.sum("n").over(W.partitionBy(*keys))))
        inner = bins.filter(F.col("before") < share * F.col("all")).groupBy(*keys).agg(*_added(_SUMS))
        now = stored(_factored(inner, keys), "rules-step")
    spread = F.expr(" + ".join(f"ln(l{i}_{i})" for i in _P))
    best = now.withColumn("k", F.row_number().over(W.partitionBy("_g").orderBy(spread, "start"))).filter("k = 1")
    best = stored(best.select("_g", *_ESTIMATE), "rules-best")
    reweighted = stored(_scaled(x, best, rows, chi_square(0.975)), "rules-reweighted")
    return stored(_scaled(x, reweighted, rows, None), "rules-estimate")


def _scaled(x: DataFrame, estimate: DataFrame, rows: int, cut: float | None) -> DataFrame:
    """Scale of the distances by their median; with ``cut``, the estimate from the rows within it instead."""
    by = W.partitionBy("_g")
    bins = (_binned(x, estimate, rows, ["_g"])
            .withColumn("upto", F.sum("n").over(by.orderBy("bin"))).withColumn("all", F.sum("n").over(by))
            .withColumn("median", F.min(F.when(F.col("upto") >= 0.5 * F.col("all"), _edge(F.col("bin")))).over(by))
            .withColumn("scale", F.greatest(F.lit(1.0), F.col("median") / chi_square(0.5))))
    if cut is None:
        return estimate.join(bins.groupBy("_g").agg(F.max("scale").alias("scale")), "_g")
    inner = bins.filter(_edge(F.col("bin")) <= cut * F.col("scale"))
    return _factored(inner.groupBy("_g").agg(*_added(_SUMS)), ["_g"])


def _numbers(lang: Column, source: Column) -> tuple[Column, Column]:
    """Numbers ``_g`` of the language and source, and ``_up`` of the language; nulls are values of their own."""
    return (F.xxhash64(F.lit(2), lang, source, lang.isNull(), source.isNull()).alias("_g"),
            F.xxhash64(F.lit(1), lang, lang.isNull()).alias("_up"))


def _covariances(found: DataFrame) -> DataFrame:
    """``_g``, centre and covariance, with the scale of the distances in it."""
    return found.selectExpr("_g", *(f"m{i}" for i in _P), *(
        f"scale * ({' + '.join(f'l{i}_{k} * l{j}_{k}' for k in range(j + 1))}) AS c{i}_{j}" for i in _P for j in range(i + 1)))


def _shrunk(own: DataFrame, above: DataFrame, prior: int) -> DataFrame:
    """Moments of the ``n`` rows of a group and ``prior`` rows of the group ``_up``, from the estimates of both."""
    names = [*(f"m{i}" for i in _P), *(f"c{i}_{j}" for i in _P for j in range(i + 1))]
    up = above.selectExpr("_g AS _up", *(f"{c} AS u{c}" for c in names))
    joined = own.join(up, "_up").withColumn("w", F.expr(f"n / (n + {prior})"))
    return joined.selectExpr("_g", *(f"w * m{i} + (1 - w) * um{i} AS m{i}" for i in _P), *(
        f"w * c{i}_{j} + (1 - w) * uc{i}_{j} + w * (1 - w) * (m{i} - um{i}) * (m{j} - um{j}) AS c{i}_{j}"
        for i in _P for j in range(i + 1)))


def shrunk_estimates(x: DataFrame, groups: DataFrame, share: float, prior: int) -> DataFrame:
    """Like ``estimates``, of every group however small: shrunk towards its language's, and that towards that of all rows."""
    every = F.xxhash64(F.lit(0))
    levels = x.select(F.explode(F.array("_g", "_up", every)).alias("_g"), *(f"x{i}" for i in _P))
    raw = stored(_covariances(estimates(levels, share)), "rules-levels")
    languages = groups.groupBy(F.col("_up").alias("_g")).agg(F.sum("n").alias("n")).withColumn("_up", every)
    top = raw.filter(F.col("_g") == every)
    middle = stored(_shrunk(raw.join(languages, "_g"), top, prior), "rules-languages")
    found = _shrunk(raw.join(groups.select("_g", "_up", "n"), "_g"), middle, prior)
    return stored(_cholesky(found, ["_g"]).withColumn("scale", F.lit(1.0)), "rules-shrunk")


def judge(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep_text: bool = True,
          share: float = 0.75, tail: float = 1e-3, prior: int = 100) -> DataFrame:
    """``df`` with the counts, ``base_failed``, ``distance`` and ``kept``.

    ``share`` of a group makes its tightest part; a document is rejected where the plain rules fail or
    its squared distance exceeds the chi-square quantile of ``1 - tail``. A group's own estimate
    counts as its rows do, its language's as ``prior`` rows, in tables of any size.
    """
    own = Carried(df, [*COUNTS, "base_failed", "distance", "kept", *([] if keep_text else [text])])
    group, up = _numbers(F.col(f"`{lang}`"), F.col(f"`{source}`"))
    packed = F.struct(own.packed("own"), group, up).alias("row")
    counted = _counted(df.select(packed, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_t")))
    x = stored(counted.select(F.col("row.own").alias("row"), "row._g", "row._up", *COUNTS,
                              *(v.alias(f"x{i}") for i, v in enumerate(values()))), "rules-counts")
    groups = stored(x.groupBy("_g", "_up").agg(F.count("*").alias("n")), "rules-groups")
    found = shrunk_estimates(x.select("_g", "_up", *(f"x{i}" for i in _P)), groups, share, prior)
    judged = _with_distance(_beside(x, found, found.count()))
    far = F.col("d2") > chi_square(1 - tail) * F.col("scale")
    return judged.select(
        *own.columns(), *COUNTS, base_failed().alias("base_failed"), F.sqrt(F.col("d2") / F.col("scale")).alias("distance"),
        (~base_failed() & ~far).alias("kept"))
