"""Quality rules by robust multivariate outliers, with DataFrame functions only.

Each text becomes a vector of log-transformed statistics in whole thousandths. Per language and source a minimum-covariance-determinant
estimate tells where and how wide the bulk lies: from two deterministic starts (medians with quartile widths, and mean with
covariance) concentration steps go on to the half of the rows nearest to the last estimate, the start whose half ends
with the smaller determinant wins, and one reweighting follows. A row is rejected if its Mahalanobis distance passes a chi-square quantile.

Sums are sums of whole numbers and cutoffs are discrete quantiles of rounded distances, so no result depends on how rows are dealt.
An aggregate holds a few dozen sums, or one count per rounded value (some ten thousand at most), whatever the size of a group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import saved
from tripweave.runtime import small

SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of the words

# Transformed statistics in thousandths, as SQL that Spark and others read alike; n_words > 0 where they are used.
STATISTICS = (
    "ln(1.0D + n_words)",
    "ln(word_chars / (1.0D * n_words))",
    "ln(1.0D + 100.0D * n_symbols / word_chars)",
    "ln(1.0D + 100.0D * n_dup_lines / n_lines)",
    "ln(1.0D + 100.0D * n_repeat_words / n_words)",
)
# Least spread of each statistic, in thousandths: added to the variances, so that a constant statistic neither
# makes the determinant vanish nor rejects the first row that differs a little.
FLOORS = (500, 100, 400, 900, 1000)
SIZE = len(STATISTICS)
LEAST_ROWS = 60  # of a group with an estimate of its own
STEPS = 3  # concentration steps from each start
# Quantiles of the chi-square distribution with 5 degrees of freedom, at 0.5, 0.975 and 0.99999.
CHI_HALF, CHI_WEIGHT, CHI_REJECT = 4.351460191095526, 12.832501994030027, 30.856189940457096
GROUP_ROWS = 1_000_000  # broadcast bound of the tables with one row of some 25 numbers per group

_J = range(SIZE)
_PAIRS = [(j, k) for j in _J for k in range(j + 1)]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it, also inside its lambdas."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """How many words lie in a window of three that occurs twice or more; windows are told apart by 64-bit hashes."""

    def covered(windows: Column) -> Column:
        def starts(placed: Column) -> Column:
            same = lambda p, j: F.get(placed, j)["hash"] == p["hash"]
            found = F.filter(placed, lambda p, j: F.coalesce(same(p, j - 1), F.lit(False)) | F.coalesce(same(p, j + 1), F.lit(False)))
            return F.sort_array(F.transform(found, lambda p: p["at"]))

        def widths(at: Column) -> Column:
            each = F.transform(at, lambda a, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1), a + 3) - a))
            return F.aggregate(each, F.lit(0), lambda total, x: total + x)

        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("hash"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(let(placed, starts), widths))

    hashes = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(F.slice(hashes, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))), covered))


def text_statistics(text: Column) -> Column:
    """A struct of ``n_lines`` and ``COUNTS`` of a whole text; null is the empty text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]")))

    def of(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            (F.size(F.split(text, SYMBOL)) - 1).cast("long").alias("n_symbols"),
            _repeated(words).cast("long").alias("n_repeat_words"),
        )

    def lines_of(found: Column) -> Column:
        return F.struct(F.size(found).cast("long").alias("n_lines"), (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"))

    return F.struct(let(F.array_remove(F.split(text, SPACE), ""), of).alias("words"), let(lines, lines_of).alias("lines"))


def _names(letter: str, pairs: bool = False) -> list[str]:
    return [f"{letter}{j}{k}" for j, k in _PAIRS] if pairs else [f"{letter}{j}" for j in _J]


def estimate_sql() -> list[str]:
    """From ``n``, the sums ``s`` and the sums of products ``p``: means ``m``, covariances ``c`` with their floors, and the rows ``l`` of
    their triangular root; each expression may name earlier ones."""
    made = [f"s{j} / (1.0D * n) AS m{j}" for j in _J]
    for j, k in _PAIRS:
        floor = f" + {float(FLOORS[j] ** 2)}D" if j == k else ""
        made.append(f"p{j}{k} / (1.0D * n) - m{j} * m{k}{floor} AS c{j}{k}")
    return made + root_sql()


def root_sql() -> list[str]:
    made = []
    for j, k in _PAIRS:
        rest = "".join(f" - l{j}{i} * l{k}{i}" for i in range(k))
        made.append(f"sqrt(c{j}{j}{rest}) AS l{j}{j}" if j == k else f"(c{j}{k}{rest}) / l{k}{k} AS l{j}{k}")
    return made


def distance_sql() -> str:
    """Squared Mahalanobis distance of ``a`` from ``m`` under the root ``l``; ``y`` are its solved coordinates."""
    return " + ".join(f"y{j} * y{j}" for j in _J)


def solved_sql() -> list[str]:
    return [f"(a{j} - m{j}{''.join(f' - l{j}{i} * y{i}' for i in range(j))}) / l{j}{j} AS y{j}" for j in _J]


# Distances are ranked in thousandths of their logarithm, which leaves at most some ten thousand values.
RANKED = "CAST(floor(1000.0D * ln(1.0D + d)) AS BIGINT)"
_KEYS = ["lang_group", "source_group"]
_START = [*_KEYS, "start"]
_ESTIMATE = [*_names("m"), *_names("l", True)]


def _sums() -> list[Column]:
    products = [F.sum(F.col(f"a{j}") * F.col(f"a{k}")).alias(f"p{j}{k}") for j, k in _PAIRS]
    return [F.count(F.lit(1)).alias("n"), *[F.sum(f"a{j}").alias(f"s{j}") for j in _J], *products]


def _estimated(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*_sums()).selectExpr("*", *estimate_sql())


def _measured(rows: DataFrame, estimates: DataFrame, groups: int) -> DataFrame:
    """``rows`` with ``d``, their squared distance from each start's estimate of their group."""
    own = small(estimates.select(*[c for c in _START if c in estimates.columns], *_ESTIMATE), 2 * groups, GROUP_ROWS)
    return rows.join(own, _KEYS).selectExpr("*", *solved_sql()).selectExpr(*[c for c in _START if c in estimates.columns], *_names("a"), f"{distance_sql()} AS d")


def _middle(measured: DataFrame, keys: list[str]) -> DataFrame:
    return measured.groupBy(*keys).agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {RANKED})").alias("half"))


def starts_of(rows: DataFrame) -> DataFrame:
    """Two estimates of each group: ``q`` from medians and the widths between quartiles, ``s`` from mean and covariance of all rows."""
    wide = rows.groupBy(*_KEYS).agg(
        *[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY a{j})").alias(f"{name}{j}") for j in _J for name, p in (("lo", 0.25), ("m", 0.5), ("hi", 0.75))]
    )
    spread = [f"(hi{j} - lo{j}) * (hi{j} - lo{j}) / 1.8196D + {float(FLOORS[j] ** 2)}D AS c{j}{j}" if j == k else f"0.0D AS c{j}{k}" for j, k in _PAIRS]
    quartiles = wide.selectExpr(*_KEYS, "'q' AS start", *[f"CAST(m{j} AS DOUBLE) AS m{j}" for j in _J], *spread).selectExpr("*", *root_sql())
    sums = _estimated(rows, _KEYS).withColumn("start", F.lit("s"))
    return quartiles.select(*_START, *_ESTIMATE).unionByName(sums.select(*_START, *_ESTIMATE))


def robust_estimates(rows: DataFrame, groups: int, steps: int = STEPS) -> DataFrame:
    """``lang_group, source_group``, the estimate ``m``, ``l`` of each group of ``rows`` and ``n_used``, the rows it rests on."""
    estimates = saved(starts_of(rows))
    for _ in range(steps):
        measured = _measured(rows, estimates, groups)
        cut = small(saved(_middle(measured, _START)), 2 * groups, GROUP_ROWS)
        estimates = saved(_estimated(measured.join(cut, _START).where(F.expr(f"{RANKED} <= half")), _START))
    root = " * ".join(f"l{j}{j}" for j in _J)
    best = estimates.groupBy(*_KEYS).agg(F.min(F.struct(F.expr(root).alias("root"), F.col("start"))).alias("best")).select(*_KEYS, F.col("best.start").alias("start"))
    chosen = saved(estimates.join(best, _START).drop("start"))
    # The half's covariance is too small by the ratio of the median distance to the median of the chi-square distribution.
    measured = _measured(rows, chosen, groups)
    scale = _middle(measured, _KEYS).selectExpr(*_KEYS, f"exp(half / 1000.0D) / {CHI_HALF}D AS scale")
    scale = small(saved(scale), groups, GROUP_ROWS)
    inside = measured.join(scale, _KEYS).where(F.expr(f"d <= {CHI_WEIGHT}D * greatest(scale, 1.0D)"))
    return saved(_estimated(inside, _KEYS).select(*_KEYS, *_ESTIMATE, F.col("n").alias("n_used")))


def robust_rules(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance`` of every row.

    Null and empty texts have no words and fail the base rules. Rows that pass them are judged by the estimate of their language and source,
    null being a value of its own; in sources with fewer than ``LEAST_ROWS`` such rows by that of the whole language, and where that has
    fewer rows too nothing is rejected and ``distance`` is null. Repeated rows and ids all count and all stay. Other columns
    are not read, whatever their names. A group may have 2 * 10 ** 10 rows before a sum of products overflows.
    """
    found = documents.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.concat(F.lit("l"), F.col(lang)), F.lit("n")).alias("lang_group"),
        F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n")).alias("own_group"), text_statistics(F.col(text)).alias("t"),
    )
    found = found.select("doc_id", "lang_group", "own_group", "t.words.*", "t.lines.*").withColumn(
        "base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    )
    values = [f"CASE WHEN NOT base_failed THEN CAST(floor(1000.0D * {s}) AS BIGINT) END AS a{j}" for j, s in enumerate(STATISTICS)]
    found = saved(found.selectExpr("*", *values))

    of_source = found.where("NOT base_failed").groupBy("lang_group", "own_group").agg(F.count(F.lit(1)).alias("n"))
    of_source = saved(of_source)
    of_lang = of_source.groupBy("lang_group").agg(F.sum("n").alias("n_lang"), (F.min("n") < LEAST_ROWS).alias("mixed"))
    named = of_source.join(of_lang, "lang_group").where(F.col("n_lang") >= LEAST_ROWS)
    named = saved(named.select("lang_group", "own_group", "mixed", F.when(F.col("n") >= LEAST_ROWS, F.col("own_group")).otherwise("all").alias("source_group")))
    groups = 2 * named.count()  # with one of each language
    grouped = found.join(small(named, groups, GROUP_ROWS), ["lang_group", "own_group"], "left")
    passed = grouped.where("NOT base_failed AND source_group IS NOT NULL")
    # A language's own estimate rests on all its rows, those of large sources too.
    part_of = F.array_distinct(F.when(F.col("mixed"), F.array("source_group", F.lit("all"))).otherwise(F.array("source_group")))
    rows = passed.select("lang_group", F.explode(part_of).alias("source_group"), *_names("a"))
    estimates = robust_estimates(rows, groups)
    judged = grouped.join(small(estimates, groups, GROUP_ROWS), _KEYS, "left").selectExpr("*", *solved_sql()).withColumn("distance", F.expr(distance_sql()))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CHI_REJECT, F.lit(True))
    return judged.select("doc_id", *COUNTS, "base_failed", kept.alias("kept"), "distance").withColumnRenamed("doc_id", doc_id)
