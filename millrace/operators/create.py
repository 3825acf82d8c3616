"""Feature creation by expressions: interactions, ratios, polynomials, dates, text, bins, cycles, groups."""

import math
from itertools import combinations, combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.columns import numeric_columns, numeric_or
from millrace.operators.transform import _add
from millrace.plans.lookup import attach
from millrace.plans.quantiles import column_quantiles, number
from millrace.plans.sizing import keep
from millrace.plans.spec import step

_PAIR = {
    "product": ("_x_", lambda a, b: a * b),
    "sum": ("_plus_", lambda a, b: a + b),
    "diff": ("_minus_", lambda a, b: a - b),
    "ratio": ("_div_", lambda a, b: F.try_divide(a, b + F.lit(1e-8))),
}


def _fit_interactions(df, columns, pairs=None, interaction_type="product"):
    if interaction_type not in _PAIR:
        raise ValueError(f"unknown interaction {interaction_type}")
    return {"pairs": pairs or [list(p) for p in combinations(numeric_or(df, columns), 2)], "interaction_type": interaction_type}


@step("interactions", _fit_interactions)
def interactions(df, learned):
    sep, f = _PAIR[learned["interaction_type"]]
    return _add(df, {f"{a}{sep}{b}": f(number(a), number(b)) for a, b in learned["pairs"]})


@step("ratios")
def ratios(df, learned):
    num, den = learned["numerators"], learned["denominators"]
    if learned.get("all_combinations"):
        pairs = [(a, b) for a in num for b in den if a != b]
    elif len(num) == len(den):
        pairs = list(zip(num, den))
    else:
        raise ValueError("numerators and denominators differ in length")
    suffixes = learned.get("suffixes") or []
    eps = learned.get("epsilon", 1e-10)
    name = lambda i, a, b: f"ratio_{suffixes[i]}" if i < len(suffixes) else f"ratio_{a}_to_{b}"
    return _add(df, {name(i, a, b): F.try_divide(number(a), number(b) + F.lit(eps)) for i, (a, b) in enumerate(pairs)})


def polynomial_terms(columns, degree=2, interaction_only=False):
    """Exponent tuples beyond the columns themselves, by degree and then by column order."""
    pick = combinations if interaction_only else combinations_with_replacement
    return [t for d in range(2, degree + 1) for t in pick(columns, d)]


def term_name(term):
    parts = []
    for c in dict.fromkeys(term):
        n = term.count(c)
        parts.append(c if n == 1 else f"{c}^{n}")
    return " ".join(parts)


def _fit_poly(df, columns, degree=2, interaction_only=False, include_bias=False):
    return {"columns": numeric_or(df, columns), "degree": degree, "interaction_only": interaction_only, "include_bias": include_bias}


@step("polynomial", _fit_poly)
def polynomial(df, learned):
    new = {"1": F.lit(1.0)} if learned.get("include_bias") else {}
    for term in polynomial_terms(learned["columns"], learned["degree"], learned["interaction_only"]):
        e = number(term[0])
        for c in term[1:]:
            e = e * number(c)
        new[term_name(term)] = e
    return _add(df, new)


_DATE_PARTS = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second,
    "weekday": F.weekday, "quarter": F.quarter, "day_of_year": F.dayofyear, "week_of_year": F.weekofyear,
    "is_weekend": lambda c: (F.weekday(c) >= 5).cast("int"),
    "is_month_start": lambda c: (F.dayofmonth(c) == 1).cast("int"),
    "is_month_end": lambda c: (F.to_date(c) == F.last_day(c)).cast("int"),
}
DATE_FEATURES = tuple(_DATE_PARTS)


@step("datetime_features")
def datetime_features(df, learned):
    features = learned.get("features") or DATE_FEATURES
    unknown = set(features) - set(_DATE_PARTS)
    if unknown:
        raise ValueError(f"unknown date features {sorted(unknown)}")
    out = _add(df, {f"{c}_{f}": _DATE_PARTS[f](F.col(c)) for c in learned["columns"] for f in features})
    return out.drop(*learned["columns"]) if learned.get("drop_original") else out


# White space beyond the ASCII kind, as a text splitter sees it, and counted punctuation.
WIDE_SPACE = r"\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}"
SPACE = r"\s" + WIDE_SPACE
PUNCTUATION = r"""[.,;:!?()\[\]{}"']"""


def plain_spaces(c):
    """Wide white space as blanks, one for one, so that the short ASCII classes find every gap."""
    return F.regexp_replace(c, f"[{WIDE_SPACE}]", " ")


def words(c):
    """Words of a text with plain spaces: maximal runs of non-space characters."""
    return F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0))


def _word_count(c):
    return F.regexp_count(c, F.lit(r"\S+"))


def _kept(c, dropped):
    """Number of characters left when the runs of the other characters are removed."""
    return F.length(F.regexp_replace(c, dropped, ""))


_TEXT_PARTS = {
    "char_count": F.length,
    "word_count": _word_count,
    "sentence_count": lambda c: F.regexp_count(c, F.lit("[.!?]+")),
    "avg_word_length": lambda c: F.coalesce(F.try_divide(_kept(c, r"\s+"), _word_count(c)), F.lit(0.0)),
    "special_char_count": lambda c: _kept(c, r"[a-zA-Z0-9\s]+"),
    "uppercase_count": lambda c: F.regexp_count(c, F.lit("[A-Z]")),
    "lowercase_count": lambda c: _kept(c, "[^a-z]+"),
    "digit_count": lambda c: F.regexp_count(c, F.lit("[0-9]")),
    "unique_word_count": lambda c: F.size(F.array_distinct(words(F.lower(c)))),
    "word_density": lambda c: _word_count(c) / (F.length(c) + 1),
    "punctuation_count": lambda c: F.regexp_count(c, F.lit(PUNCTUATION)),
    "char_length": F.length,
}
TEXT_FEATURES = ("char_count", "word_count", "sentence_count", "avg_word_length", "special_char_count")


@step("text_features")
def text_features(df, learned):
    """Character, word and sentence counts of text columns; a missing text counts as the text 'nan'."""
    features = learned.get("features") or TEXT_FEATURES
    plain = {f"_plain_{c}": plain_spaces(F.coalesce(F.col(c).cast("string"), F.lit("nan"))) for c in learned["columns"]}
    df = df.withColumns(plain)
    new = {}
    for c in learned["columns"]:
        text = F.col(f"_plain_{c}")
        for f in features:
            if f == "stopword_count":
                new[f"{c}_{f}"] = stopword_count(text, learned.get("language", "english"))
            elif f in _TEXT_PARTS:
                new[f"{c}_{f}"] = _TEXT_PARTS[f](text)
            else:
                raise ValueError(f"unknown text feature {f}")
    out = _add(df, new).drop(*plain)
    return out.drop(*learned["columns"]) if learned.get("drop_original") else out


def stopword_count(c, language="english"):
    """Number of word tokens (letter runs, apostrophes kept inside) in the language's stop-word list."""
    from pyspark.ml.feature import StopWordsRemover

    stop = StopWordsRemover.loadDefaultStopWords(language)
    # Possessive, since a run of letters never has to be given back; isin is one hash lookup per token.
    tokens = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}++(?:'\p{L}++)*+)"), F.lit(1))
    return F.size(F.filter(tokens, lambda w: w.isin(stop)))


def _fit_bins(df, columns, bins=5, strategy="uniform", one_hot=False):
    cols = numeric_or(df, columns)
    count = lambda c: bins[c] if isinstance(bins, dict) else bins
    edges = {}
    if strategy == "uniform":
        row = df.agg(*[f(number(c)).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("a", F.min), ("b", F.max))]).first()
        for i, c in enumerate(cols):
            a, b, k = row[f"a{i}"], row[f"b{i}"], count(c)
            # A constant column has one bin.
            edges[c] = [] if a is None else [a, b] if a == b else [a + (b - a) * j / k for j in range(k)] + [b]
    elif strategy == "quantile":
        for c in cols:
            q = column_quantiles(df, [c], [j / count(c) for j in range(count(c) + 1)])[c]
            edges[c] = sorted(set(q)) if q[0] is not None else []
    elif strategy == "kmeans":
        for c in cols:
            edges[c] = kmeans_edges(df, c, count(c))
    else:
        raise ValueError(f"unknown binning strategy {strategy}")
    return {"edges": edges, "one_hot": one_hot}


def kmeans_edges(df: DataFrame, column, k, seed=42):
    """Bin edges half-way between the centres of a one-dimensional k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    values = df.select(number(column).alias("v")).na.drop()
    x = VectorAssembler(inputCols=["v"], outputCol="features").transform(values)
    centres = sorted({float(c[0]) for c in KMeans(k=k, seed=seed, maxIter=50).fit(x).clusterCenters()})
    lo, hi = values.agg(F.min("v"), F.max("v")).first()
    return [lo] + [(a + b) / 2 for a, b in zip(centres, centres[1:])] + [hi]


@step("bins", _fit_bins)
def bins(df, learned):
    """Ordinal bin (left-closed, last bin closed on the right) or one 0/1 column per bin."""
    new = {}
    for c, edges in learned["edges"].items():
        inner = edges[1:-1]
        v = number(c)
        index = F.lit(0)
        for e in inner:
            index = index + F.when(v >= F.lit(e), 1).otherwise(0)
        index = F.when(v.isNotNull(), index).cast("long")
        if learned["one_hot"]:
            new.update({f"{c}_bin_{j}": (index == j).cast("double") for j in range(max(1, len(edges) - 1))})
        else:
            new[f"{c}_bin"] = index
    return _add(df, new)


@step("cut")
def cut(df, learned):
    """Right-closed bins with explicit edges, the lowest edge included; labels or bin numbers."""
    edges, labels = learned["edges"], learned.get("labels")
    new = {}
    for c in learned["columns"]:
        v = number(c)
        e = None
        for i in range(len(edges) - 1):
            inside = (v >= edges[0]) & (v <= edges[1]) if i == 0 else (v > edges[i]) & (v <= edges[i + 1])
            value = F.lit(labels[i]) if labels else F.lit(i).cast("long")
            e = F.when(inside, value) if e is None else e.when(inside, value)
        new[f"{c}_bin"] = e
    return _add(df, new)


# Name parts that imply a period, in the order they are tried, and ranges of values.
PERIOD_BY_NAME = (
    (("hour", "hr"), 24), (("day", "weekday"), 7), (("month",), 12), (("quarter",), 4), (("year",), 365),
    (("minute", "min"), 60), (("second", "sec"), 60), (("week",), 52),
)
PERIOD_BY_RANGE = ((0, 24, 24), (1, 7, 7), (1, 12, 12), (1, 31, 31), (1, 366, 366))


def _fit_cyclical(df, columns, periods=None):
    periods = dict(periods or {})
    open_ = []
    for c in columns:
        if c not in periods:
            named = next((p for parts, p in PERIOD_BY_NAME if any(x in c.lower() for x in parts)), None)
            if named:
                periods[c] = named
            else:
                open_.append(c)
    if open_:
        row = df.agg(*[f(number(c)).alias(f"{n}{i}") for i, c in enumerate(open_) for n, f in (("a", F.min), ("b", F.max))]).first()
        for i, c in enumerate(open_):
            lo, hi = row[f"a{i}"], row[f"b{i}"]
            p = next((p for a, b, p in PERIOD_BY_RANGE if lo is not None and a <= lo and hi <= b), None)
            if p:
                periods[c] = p
    return {"periods": {c: periods[c] for c in columns if c in periods}}


@step("cyclical", _fit_cyclical)
def cyclical(df, learned):
    new = {}
    for c, p in learned["periods"].items():
        angle = F.lit(2 * math.pi) * number(c) / F.lit(float(p))
        new[f"{c}_sin"], new[f"{c}_cos"] = F.sin(angle), F.cos(angle)
    return _add(df, new)


@step("custom")
def custom_features(df, learned):
    """New columns from SQL expressions: {name: expression}."""
    return _add(df, {n: F.expr(e) for n, e in learned["expressions"].items()})


def custom_function(df: DataFrame, name, function, inputs, returns="double"):
    """New column from a vectorised Python function over pandas Series."""
    return df.withColumn(name, F.pandas_udf(function, returns)(*[F.col(c) for c in inputs]))


_GROUP_AGG = {"mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev, "count": F.count, "sum": F.sum}


def group_aggregates(df: DataFrame, group_by, columns, functions=("mean", "min", "max", "std", "count")):
    """Per-group aggregates joined back as ``<column>_<function>``; NULL groups get NULL.

    The aggregate combines before its shuffle and the result is joined as a small table, so a group
    holding a large share of the rows is never gathered in one task.
    """
    groups = list(group_by)
    known = df.na.drop(subset=groups)
    aggs = [_GROUP_AGG[f](number(c) if c in numeric_columns(df) else F.col(c)).alias(f"{c}_{f}") for c in columns for f in functions]
    table = keep(known.groupBy(*groups).agg(*aggs, F.count("*").alias("_n")))
    return attach(df, table, groups, [f"{c}_{f}" for c in columns for f in functions], weight="_n")
