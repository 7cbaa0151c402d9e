"""Quality rules: counts of each text, a base rule, and robust multivariate outliers.

Each document has a vector of transformed statistics: square roots of the shares of
symbols, repeated words, repeated lines, capitals and punctuation, and the log of the
mean word length.  For each (language, source) a minimum-covariance-determinant estimate
is searched: the half of the documents with the smallest covariance determinant.  The
search starts from the three quartiles with quartile ranges as scales, and from mean and
covariance of all.  A concentration step takes the half with the smallest distances and
its mean and covariance; after two steps from each start a group goes on with the start of
the least determinant, until no determinant moves.  So a group may hold nearly as much junk
as good text.  A median distance above that of normal data scales a group's distances down.

A document whose squared Mahalanobis distance exceeds the chi-square quantile for ``level``
is rejected: of normal data, one document in 1 / level.  Statistics of texts have heavier
tails than normal data, so the level is low.

Everything is DataFrame expressions.  Order statistics come from counts in fine bins, so
no group is ever gathered, and joins with the groups' table are salted; moments are partial
sums; the Cholesky factor of a group's covariance, whose diagonal also gives the
determinant, is a set of column expressions on a table with one row for each group and
start.  A variance floor for each statistic says which deviations are too small to matter
and keeps groups in which one never varies from rejecting its first other value.  Groups
under ``min_group`` documents are pooled by language, and what is still too small is pooled
altogether; a pool of fewer than twice the number of statistics rejects nothing.

Null, empty and blank texts have no words and fail the base rule.  Texts of any length are
used whole: 3-word windows are compared by 64-bit hashes, and n_repeat_words could be too
large where two different windows of one text agree in theirs (for 20,000 words, one text in
10^11).  Repeated rows count as often as they occur and share their verdict; null languages,
sources and ids are values of their own; an empty table stays empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import SPACE_CHARS, bind, join_small, released, word_array, written

SYMBOLS = "#*$%&|<>"
#: Statistic and the least standard deviation that it is taken to have.
STATISTICS = {"s_sym": 0.05, "s_rep": 0.15, "s_dup": 0.15, "s_len": 0.08, "s_cap": 0.05, "s_pun": 0.06}


def chi2_quantile(tail: float, degrees: int = len(STATISTICS)) -> float:
    """What a chi-square variable with an even number of degrees exceeds with probability tail."""
    lo, hi = 0.0, 2000.0
    while hi - lo > 1e-9:
        x = (lo + hi) / 2
        over = math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(degrees // 2))
        lo, hi = (x, hi) if over > tail else (lo, x)
    return hi


CHI2_MEDIAN = chi2_quantile(0.5)
#: Share of normal data that the distance rejects.
LEVEL = 1e-6


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed.

    A null text counts as empty.  Words are ``[^\\x20\\x09-\\x0D]+``.
    """
    t = F.coalesce(F.col(text), F.lit(""))

    def repeats(h: Column) -> Column:
        # h: hashes of the 3-word windows by position.  Sorted with their positions, equal
        # ones are neighbours.
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def covered(p: Column) -> Column:
            n = F.size(p)
            twin = F.filter(
                p,
                lambda e, k: ((k > 0) & (F.get(p, k - 1)["x"] == e["x"])) | ((k < n - 1) & (F.get(p, k + 1)["x"] == e["x"])),
            )
            starts = F.array_sort(F.transform(twin, lambda e: e["i"]))
            # Each window covers three words less its overlap with the next one.
            return bind(
                starts,
                lambda s: F.aggregate(
                    F.transform(s, lambda a, k: F.least(F.lit(3), F.coalesce(F.get(s, k + 1) - a, F.lit(3)))), F.lit(0), lambda x, y: x + y
                ),
            )

        return bind(pairs, covered)

    def per_words(w: Column) -> Column:
        n = F.size(w)
        hashes = F.transform(
            F.slice(w, 1, F.greatest(F.lit(0), n - 2)), lambda a, i: F.xxhash64(a, F.get(w, i + 1), F.get(w, i + 2))
        )
        return F.struct(n.cast("long").alias("n_words"), bind(hashes, repeats).cast("long").alias("n_repeat_words"))

    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0)
    by_line = bind(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    out = docs.withColumns({"__w": bind(word_array(F.col(text)), per_words), "__l": by_line, "__c": F.length(F.translate(t, SPACE_CHARS, "")).cast("long")})
    return out.withColumns(
        {
            "n_words": F.col("__w.n_words"),
            "word_chars": F.col("__c"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.col("__l.n") - F.col("__l.d")).cast("long"),
            "n_repeat_words": F.col("__w.n_repeat_words"),
            "n_lines": F.col("__l.n").cast("long"),
            "n_capitals": (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}", ""))).cast("long"),
            "n_letters": F.length(F.regexp_replace(t, r"\P{L}+", "")).cast("long"),
            "base_failed": (F.col("__w.n_words") < 50) | (100 * F.col("__w.n_repeat_words") > 50 * F.col("__w.n_words")),
        }
    ).drop("__w", "__l", "__c")


def statistics(rows: DataFrame) -> DataFrame:
    """The transformed statistics of counted rows."""

    def share(a: Column, b: str) -> Column:
        return F.sqrt(F.least(F.lit(1.0), a / F.greatest(F.col(b), F.lit(1))))

    return rows.withColumns(
        {
            "s_sym": share(F.col("n_symbols"), "n_words"),
            "s_rep": share(F.col("n_repeat_words"), "n_words"),
            "s_dup": share(F.col("n_dup_lines"), "n_lines"),
            "s_len": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
            "s_cap": share(F.col("n_capitals"), "word_chars"),
            "s_pun": share(F.greatest(F.lit(0), F.col("word_chars") - F.col("n_letters") - F.col("n_symbols")), "word_chars"),
        }
    )


def _groups(rows: DataFrame, min_group: int) -> DataFrame:
    """lang, source and the name g of the group whose estimate their documents use."""
    own = rows.groupBy("lang", "source").agg(F.sum(F.when(F.col("base_failed"), 0).otherwise(1)).alias("n"))
    # One row for each language and source from here on.
    small = F.when(F.col("n") < min_group, F.col("n")).otherwise(0)
    pooled = own.withColumn("m", F.sum(small).over(Window.partitionBy("lang")))
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("?")) for c in ("lang", "source"))
    g = F.when(F.col("n") >= min_group, F.concat_ws("\x1f", lang, source)).when(F.col("m") >= min_group, lang).otherwise(F.lit(""))
    return pooled.select("lang", "source", g.alias("g"))


def _named(rows: DataFrame, groups: DataFrame) -> DataFrame:
    return join_small(rows, groups, ["lang", "source"], F.col("doc_id"))


def _half(n: Column) -> Column:
    """The least subset of n rows whose estimate withstands as much junk as any can."""
    return F.least(n, F.floor((n + len(STATISTICS) + 1) / 2))


def _quantile(counted: DataFrame, by: list[str], bin_: str, q: float | None, name: str) -> DataFrame:
    """The first bin of each group at which a share q of the rows is reached; None: ``_half`` of them."""
    upto = Window.partitionBy(*by).orderBy(bin_)
    whole = Window.partitionBy(*by)
    return (
        counted.withColumns({"__u": F.sum("n").over(upto), "__t": F.sum("n").over(whole)})
        .filter(F.col("__u") >= (_half(F.col("__t")) if q is None else q * F.col("__t")))
        .groupBy(*by)
        .agg(F.min(bin_).alias(name))
    )


_STEP = 32.0


def _bin(d2: Column) -> Column:
    return F.floor(F.log2(d2 + 1e-6) * _STEP).cast("int")


#: Starts of the search: a quartile as the centre, or the moments of all rows.
STARTS = ("mid", "lo", "hi", "all")


def _starts(rows: DataFrame, starts: tuple[str, ...], grid: float = 512.0) -> DataFrame:
    """A parameter row for each group and start; scales are quartile ranges."""
    long = rows.select("g", F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.floor(F.col(c) * grid).cast("int").alias("b")) for i, c in enumerate(STATISTICS)])).alias("e"))
    counted = long.groupBy("g", "e.k", "e.b").agg(F.count(F.lit(1)).alias("n"))
    parts = None
    for q, name in ((0.25, "lo"), (0.5, "mid"), (0.75, "hi")):
        x = _quantile(counted, ["g", "k"], "b", q, name)
        parts = x if parts is None else parts.join(x, ["g", "k"])
    wide = parts.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("lo", "mid", "hi")))).alias("m"))
    wide = wide.withColumn("start", F.explode(F.array(*[F.lit(x) for x in starts if x != "all"])))
    out = ["g", "start"]
    for i, floor in enumerate(STATISTICS.values()):
        out.append(f"((CASE start WHEN 'lo' THEN m[{i}].lo WHEN 'hi' THEN m[{i}].hi ELSE m[{i}].mid END) + 0.5D) / {grid}D AS m{i}")
        out.append(f"sqrt(pow((m[{i}].hi - m[{i}].lo) / {grid}D / 1.349D, 2) + {floor**2!r}D) AS l{i}{i}")
        out += [f"0D AS l{i}{j}" for j in range(i)]
    made = _inverted(wide.selectExpr(*out))
    if "all" not in starts:
        return made
    return made.unionByName(_factored(rows.groupBy("g").agg(*_sums()).withColumn("start", F.lit("all"))))


def _least(params: DataFrame) -> DataFrame:
    """For each group the start with the least covariance determinant."""
    best = F.min_by(F.struct(*[c for c in params.columns if c != "g"]), F.struct("log_det", "start"))
    return params.groupBy("g").agg(best.alias("b")).select("g", "b.*")


def _with_distance(rows: DataFrame, params: DataFrame, how: str = "inner", keep: tuple[str, ...] = ()) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance from their group's estimate, and kept parameters."""
    used = params.select("g", *keep, *_MEANS, *[f"w{i}{j}" for i, j in _PAIRS])
    joined = join_small(rows, used, ["g"], F.col("doc_id"), how)
    shifts = [f"({c} - m{i})" for i, c in enumerate(STATISTICS)]
    parts = [" + ".join(f"w{i}{j} * {shifts[j]}" for j in range(i + 1)) for i in range(len(STATISTICS))]
    return joined.select(*rows.columns, *keep, F.expr(" + ".join(f"pow({x}, 2)" for x in parts)).alias("d2"))


_PAIRS = [(i, j) for i in range(len(STATISTICS)) for j in range(i + 1)]
_MEANS = [f"m{i}" for i in range(len(STATISTICS))]
#: Sums from which moments are made.
_SUMS = {"n": "count(1)"} | {f"a{i}": f"sum({c})" for i, c in enumerate(STATISTICS)}
_SUMS |= {f"p{i}{j}": f"sum({list(STATISTICS)[i]} * {list(STATISTICS)[j]})" for i, j in _PAIRS}


def _sums() -> list[Column]:
    return [F.expr(v).alias(k) for k, v in _SUMS.items()]


def _factored(sums: DataFrame, others: list[str] = []) -> DataFrame:
    """g, start, the mean, the Cholesky factor l of covariance plus floors, its inverse w, and log_det.

    sums: a row for each group and start.  Each column may use those before it.
    """
    out = ["g", "start", *others]
    out += [f"a{i} / n AS m{i}" for i in range(len(STATISTICS))]
    for i, j in _PAIRS:
        cov = f"p{i}{j} / n - m{i} * m{j}"
        v = f"greatest({cov}, 0D) + {list(STATISTICS.values())[i] ** 2!r}D" if i == j else cov
        v += "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        out.append(f"sqrt(greatest({v}, 1e-6D)) AS l{i}{j}" if i == j else f"({v}) / l{j}{j} AS l{i}{j}")
    return _inverted(sums.selectExpr(*out), others)


def _inverted(factors: DataFrame, others: list[str] = []) -> DataFrame:
    """factors (l) with their inverse w and log_det."""
    out = ["g", "start", *others, *_MEANS, *[f"l{i}{j}" for i, j in _PAIRS]]
    for i, j in _PAIRS:
        dots = " + ".join(f"l{i}{k} * w{k}{j}" for k in range(j, i))
        out.append(f"1 / l{i}{i} AS w{i}{j}" if i == j else f"-({dots}) / l{i}{i} AS w{i}{j}")
    out.append("2 * (" + " + ".join(f"ln(l{i}{i})" for i in range(len(STATISTICS))) + ") AS log_det")
    return factors.selectExpr(*out)


def _settled(before: DataFrame, after: DataFrame) -> bool:
    """Whether a step moved no group's log determinant by more than a ten-thousandth."""
    return not after.filter("abs(log_det - log_det_before) > 1e-4").take(1)


def _concentrated(rows: DataFrame, params: DataFrame, share: float | None) -> DataFrame:
    """The parameters after one concentration step of each group and start.

    Moments are summed by bins of distance, so one pass over the rows gives both the
    distance that bounds the subset and the subset's moments.
    """
    before = params.drop("log_det_before").withColumnRenamed("log_det", "log_det_before")
    near = _with_distance(rows, before, keep=("start", "log_det_before")).withColumn("b", _bin(F.col("d2")))
    by = ["g", "start"]
    # From here on there is a row for each group, start and bin.
    bins = near.groupBy(*by, "b").agg(*_sums(), F.first("log_det_before").alias("log_det_before"))
    upto = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("n").over(Window.partitionBy(*by))
    wanted = _half(F.col("__t")) if share is None else share * F.col("__t")
    inside = bins.withColumns({"__u": upto, "__t": whole}).filter(F.col("__u") < wanted)
    sums = inside.groupBy(*by).agg(*[F.sum(c).alias(c) for c in _SUMS], F.first("log_det_before").alias("log_det_before"))
    return written(_factored(sums, ["log_det_before"]))


def estimates(rows: DataFrame, *, share: float | None = 0.75, steps: int = 3, starts: tuple[str, ...] = ("mid",), trial: int = 2) -> DataFrame:
    """The parameter table after the search with at most ``steps`` steps, with n and scale.

    rows: doc_id, g and the statistics of the documents that the base rule lets through.
    A share of junk over 1 - ``share`` gets into the subset; None takes the least subset,
    which is about one half.  Of several starts each makes ``trial`` steps, and the one with
    the least determinant goes on.
    """
    params = written(_starts(rows, starts))
    if len(starts) > 1:
        for _ in range(trial):
            params = _concentrated(rows, params, share)
        params = written(_least(params))
    for _ in range(steps):
        before = params
        params = _concentrated(rows, params, share)
        if _settled(before, params):
            break
    params = params.drop("start", "log_det_before")
    last = _with_distance(rows, params).groupBy("g", _bin(F.col("d2")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    middle = _quantile(last, ["g"], "b", 0.5, "mid")
    size = last.groupBy("g").agg(F.sum("n").alias("n_group"))
    scale = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), (F.col("mid") + 0.5) / _STEP) / CHI2_MEDIAN)
    return params.join(middle.join(size, "g").select("g", "n_group", scale.alias("scale")), "g")


MADE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_letters", "base_failed", *STATISTICS, "g", "d2", "kept")


def fit(docs: DataFrame, *, text: str = "text", min_group: int = 60) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs without text but with its statistics, group of each language and source, estimates)."""
    rows = written(statistics(counts(docs.drop(*MADE), text)).drop(text))
    groups = written(_groups(rows, min_group))
    named = _named(rows, groups)
    used = written(named.filter(~F.col("base_failed")).select("doc_id", "g", *STATISTICS))
    params = written(estimates(used, share=None, steps=20, starts=STARTS))
    released(used)
    return rows, groups, params


def verdicts(rows: DataFrame, groups: DataFrame, params: DataFrame, level: float = LEVEL) -> DataFrame:
    """rows (with statistics) with d2 and kept, by estimates of ``fit``."""
    far = _with_distance(_named(rows, groups), params, "left", ("n_group", "scale"))
    d2 = F.when(F.col("n_group") >= 2 * len(STATISTICS), F.col("d2") / F.col("scale")).otherwise(0.0)
    kept = ~F.col("base_failed") & (F.col("d2") <= chi2_quantile(level))
    return far.withColumn("d2", d2).withColumn("kept", kept).drop("n_group", "scale", "g")


def judge(docs: DataFrame, *, text: str = "text", level: float = LEVEL, min_group: int = 60) -> DataFrame:
    """The columns of docs but its text, with the counts, d2 and kept.

    kept is false where the base rule fails or d2 exceeds the quantile for ``level``.  Needs
    columns doc_id, lang and source; null ones are groups of their own.  Columns of docs that
    clash are replaced.
    """
    others = [c for c in docs.columns if c not in (*MADE, text)]
    carried = docs.select(F.struct(*others).alias("__row"), "doc_id", "lang", "source", text)
    made = [c for c in MADE if c != "g"]
    return verdicts(*fit(carried, text=text, min_group=min_group), level).select("__row.*", *made)


def keep(docs: DataFrame, *, text: str = "text", level: float = LEVEL, min_group: int = 60) -> DataFrame:
    """The rows of docs that ``judge`` keeps, with all their columns as they are.

    Rows are written once with their statistics, so texts don't move to meet their verdicts
    and are looked through once.
    """
    carried = docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "lang", "source", text)
    return verdicts(*fit(carried, text=text, min_group=min_group), level).filter("kept").select("__row.*")
